"""Connected components by alternating large-star and small-star, as DataFrame joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut

#: Parts that the edges of one node may be dealt in.
SALTS = 256


def _stamp(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def _with_least(edges: DataFrame) -> DataFrame:
    """edges (u, v) with `m`, the least of u and of all v beside it.

    Edges are dealt by node and by a part of the other end. The least of each part is a partial result; a node's parts,
    SALTS at most, meet, and its least goes back to each of them, so a hub's edges are never in one task.
    """
    dealt = edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    parts = dealt.groupBy("u", "s").agg(F.min(F.least("u", "v")).alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("s").alias("s"))
    return dealt.join(least.select("u", "m", F.explode("s").alias("s")), ["u", "s"]).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of `edges` (a, b), component being the smallest node reachable.

    Large-star ties the larger neighbours of each node to the least node around it, small-star its smaller ones; the
    two alternate until the edges are stars that no longer change. Each round writes as many rows as it has edges.
    Loops, null ends and repeated edges are ignored; no edges give no rows. Each round is checkpointed, and only its row
    count and checksum reach the driver.
    """
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    stamp = _stamp(e)
    while stamp[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large)
        # the edge to the least one ties u to it, the others tie themselves
        moved = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut(moved.distinct())
        before, stamp = stamp, _stamp(e)
        if before == stamp:
            break
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
