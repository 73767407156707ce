"""Names of the library's queries, their plans and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans import queries as plans
from corpusloom.plans import sql
from corpusloom.session import ship


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.flagship(spark, sf_dir)


def _shipped(plan: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return plan(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"q_{p.__name__}": _shipped(p) for p in plans.ALL}


def oracle_sql() -> dict[str, str]:
    return {f"q_{name}": text for name, text in sql.ALL.items()}
