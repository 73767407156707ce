"""Carrying all columns of a table, whatever their names, past an operator's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(column: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col(f"`{column.replace('`', '``')}`")


def packed(docs: DataFrame) -> Column:
    """All columns in one struct `row`."""
    return F.struct(*[named(c) for c in docs.columns]).alias("row")


def unpacked(docs: DataFrame, result: str = "") -> list[Column]:
    """The columns of `row` again, but for one that has the name of the operator's result, which replaces it."""
    return [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() != result.lower()]


def others(columns: list[str], result: str) -> list[str]:
    """The columns that stay beside a result of that name."""
    return [c for c in columns if c.lower() != result.lower()]
