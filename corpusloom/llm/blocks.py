"""Comparing the members of a group in pairs of blocks, so that no task holds a group.

A group of any size is dealt into blocks by a hash of the member; a row goes to the pairs of its block with every block,
itself included, and each pair of blocks is one unit of work of bounded size. Units stream through `mapInArrow`, sorted
by key, so a task holds one unit at a time however many it gets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deal(rows: DataFrame, group: str, member: str, blocks: str) -> DataFrame:
    """rows once per pair of blocks: columns `block` (the row's own), `lo` and `hi` (the pair) are added."""
    own = F.pmod(F.xxhash64(member), F.col(blocks)).cast("int")
    dealt = rows.withColumn("block", own).withColumn("_j", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))))
    dealt = dealt.select("*", F.least("block", "_j").alias("lo"), F.greatest("block", "_j").alias("hi")).drop("_j", blocks)
    return gather(dealt, group)


def visits(rows: DataFrame, sizes: DataFrame, group: str, member: str) -> DataFrame:
    """rows (group, member, guest, ...) dealt so that every guest of a group meets every member in some unit.

    sizes (group, homes, rounds) has the numbers of blocks of a group's members and of its guests. A member is at home in
    one block and receives all rounds of guests; a guest is in one round and visits all blocks: columns `lo` and `hi`
    (block, round) and `visits` are added. A group with few guests sends each member once, however large it is.
    """
    block = lambda n: F.pmod(F.xxhash64(member), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    placed = rows.join(sizes, group)
    home = placed.select(*rows.columns, F.lit(False).alias("visits"), block("homes").alias("lo"), every("rounds").alias("hi"))
    guest = placed.filter("guest").select(*rows.columns, F.lit(True).alias("visits"), every("homes").alias("lo"), block("rounds").alias("hi"))
    return home.union(guest)


def gather(rows: DataFrame, group: str) -> DataFrame:
    """rows with `lo` and `hi`, those of a unit in one place and order."""
    return rows.repartition(group, "lo", "hi").sortWithinPartitions(group, "lo", "hi")


def units(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[pa.Table]:
    """The rows of each (group, lo, hi), from batches sorted by that key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (group, "lo", "hi")), strict=True))
        start = 0
        for i, key in enumerate(keys):
            if key != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, key
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def per_unit(rows: DataFrame, group: str, work: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """What `work` makes of each unit of `deal`ed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches, group):
            made = work(unit)
            if made is not None and made.num_rows:
                yield made

    return rows.mapInArrow(run, schema)
