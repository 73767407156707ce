"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

The mix is as long as the whole input. Each source has a target in words: its weighted share, held at `cap` times
its own size, with the excess reshared by weight (water filling). Equal blocks of words are dealt to the sources by
highest quotients (votes / 1, 3, 5, ...), then the blocks of a source to its shards the same way, so every shard has an
integer quota. In a shard the documents lie on a line in seeded order; the quota is the run of blocks that starts at the
line's first document (in the query, at a seeded block) and goes round the line, over and over if the quota is longer.

Whole documents: only the document in which a run ends is taken in part, so rounding to whole copies shifts the words of
a shard by half a document at most. Shards are sized by the source's own documents (none for fewer than 1 Ki), so that
is little of a source unless it has only a few documents.

Scale: a shard is a hash part of a source, about 1 Ki to 16 Ki documents, so no task holds a large source; the only
tables in one task have a row per source (with three candidate quotients at most, summed over all) or per shard of one.

Edge cases: a null text, like one of blanks, has size 0 and takes nothing; null sources are one source, ranked last;
rows that repeat a doc_id are mixed one by one; an empty table gives no rows; other columns of the input are kept by
`mix` untouched, but for one named `mix`, which the result replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.columns import packed, unpacked
from corpusloom.session import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
CAP = 3
BLOCK = 32
SEED = "mix-1"
MIN_SHARDS = 64
SHARD_DOCS = 16384
LEAST_DOCS = 1024
BROADCAST_SOURCES = 100_000


def water_fill(sources: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources (source, source_size), one row each, with target: the capped share of the sum of sizes.

    In order of cap per weight, a source is held at its cap exactly if its share of what the earlier ones leave
    would be over it; the held ones come first, so two running sums replace the repeated resharing.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", w).withColumn("limit", F.col("source_size") * F.lit(cap))
    by_cap = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    upto, whole = by_cap.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    run = ranked.select(
        "*",
        (F.sum("limit").over(upto) - F.col("limit")).alias("spent"),
        (F.sum("weight").over(whole) - F.sum("weight").over(upto) + F.col("weight")).alias("left"),
        F.sum("source_size").over(whole).alias("total"),
    )
    held = F.col("limit") < F.col("weight") * (F.col("total") - F.col("spent")) / F.col("left")
    run = run.withColumn("held", held)
    free = F.sum(F.when(F.col("held"), F.col("limit")).otherwise(0)).over(whole)
    open_w = F.sum(F.when(F.col("held"), 0).otherwise(F.col("weight"))).over(whole)
    level = F.col("weight") * (F.col("total") - free).cast("double") / F.greatest(open_w, F.lit(1))
    return run.select("source", "source_size", "total", F.when(F.col("held"), F.col("limit").cast("double")).otherwise(level).alias("target"))


def apportion(rows: DataFrame, group: list[str], tie: list[str], vote: str, seats: str, out: str) -> DataFrame:
    """rows with `out`: seats by highest quotients vote / (2 s - 1) within each group, ties by the `tie` columns.

    Rounding every vote at the divisor total / (seats - k / 2), k candidates, never gives out too many and leaves
    fewer than k seats; only those go by comparing quotients, of which each candidate needs its share of k, plus one.
    """
    w = Window.partitionBy(*group)
    total, k = F.sum(vote).over(w), F.count(F.lit(1)).over(w)
    based = rows.withColumn("_t", total).withColumn("_k", k)
    share = F.col(vote) * (2 * F.col(seats) - F.col("_k")).cast("double") / F.greatest(2 * F.col("_t"), F.lit(1))
    based = based.withColumn("_base", F.greatest(F.floor(share + 0.5), F.lit(0)))
    based = based.withColumn("_rest", F.when(F.col("_t") > 0, F.col(seats) - F.sum("_base").over(w)).otherwise(0))
    most = F.ceil(F.col(vote) * F.col("_k").cast("double") / F.greatest(F.col("_t"), F.lit(1))) + 1
    based = based.withColumn("_most", F.least(most, F.col("_rest")).cast("int"))
    tries = based.filter("_most > 0").select(*group, *[c for c in tie if c not in group], vote, "_base", "_rest", F.explode(F.sequence(F.lit(1), F.col("_most"))).alias("_j"))
    quotient = F.col(vote) / (2 * (F.col("_base") + F.col("_j")) - 1)
    order = Window.partitionBy(*group).orderBy(quotient.desc(), *[F.col(c).asc_nulls_last() for c in tie], "_j")
    keys = list(dict.fromkeys([*group, *tie]))
    won = tries.withColumn("_r", F.row_number().over(order)).filter("_r <= _rest").groupBy(*keys).agg(F.count(F.lit(1)).alias("_more"))
    b, m = based.alias("b"), won.alias("m")
    on: Column = F.lit(True)
    for c in keys:
        on = on & F.col(f"b.{c}").eqNullSafe(F.col(f"m.{c}"))
    return b.join(m, on, "left").select(*[F.col(f"b.{c}") for c in rows.columns], (F.col("b._base") + F.coalesce(F.col("m._more"), F.lit(0))).alias(out))


def _own_shards(docs: DataFrame) -> DataFrame:
    """(of, shards) of the sources of more than LEAST_DOCS documents: up to MIN_SHARDS of LEAST_DOCS, then of SHARD_DOCS."""
    n = docs.groupBy(F.col("source").alias("of")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LEAST_DOCS)
    shards = F.greatest(F.least(F.ceil(F.col("n") / LEAST_DOCS), F.lit(MIN_SHARDS)), F.ceil(F.col("n") / SHARD_DOCS))
    own = cut(n.select("of", shards.cast("long").alias("shards")))
    return F.broadcast(own) if own.count() <= BROADCAST_SOURCES else own


def mix(docs: DataFrame, text: str = "text", block: int = BLOCK, cap: int = CAP, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, alike: bool = False) -> DataFrame:
    """docs with a struct column `mix` (size, source_size, target, taken), taken being the words the mix takes.

    Shards are sized by each source's own documents and runs start with a whole document; if `alike`, all sources have
    as many shards as the whole table needs and runs start at a seeded block.
    """
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(packed(docs), F.col("source").alias("source"), size.alias("size"), key.alias("key"))
    if alike:
        rows = rows.withColumn("shards", F.lit(max(MIN_SHARDS, -(-docs.count() // SHARD_DOCS))))
    else:
        rows = rows.join(_own_shards(docs), F.col("source").eqNullSafe(F.col("of")), "left").drop("of").withColumn("shards", F.coalesce("shards", F.lit(1)))
    rows = rows.withColumn("shard", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % F.col("shards"))).drop("shards")
    parts = cut(rows.groupBy("source", "shard").agg(F.sum("size").alias("shard_size")))
    targets = water_fill(parts.groupBy("source").agg(F.sum("shard_size").alias("source_size")), cap, weights)
    voted = targets.select("*", F.round(F.col("target") * 64).cast("long").alias("vote"), F.round(F.col("total") / block).cast("long").alias("blocks"))
    dealt = apportion(voted, [], ["source"], "vote", "blocks", "seats")
    p, d = parts.alias("p"), dealt.alias("d")
    both = p.join(d, F.col("p.source").eqNullSafe(F.col("d.source"))).select("p.*", "d.source_size", "d.target", "d.seats")
    quotas = apportion(both, ["source"], ["shard"], "shard_size", "seats", "quota_blocks")
    start = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "shard", F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("long")
    quotas = quotas.select(
        "*",
        F.least(F.col("quota_blocks") * block, F.col("shard_size") * cap).alias("quota"),
        ((start % F.greatest(F.ceil(F.col("shard_size") / block), F.lit(1))) * block if alike else F.lit(0)).alias("offset"),
    )
    # null sources as columns of their own: the join and the window below deal the rows by the same keys, once
    keyed = lambda d: d.withColumns({"filled": F.coalesce("source", F.lit("")), "missing": F.col("source").isNull()})
    quotas = keyed(quotas).select("filled", "missing", "shard", "shard_size", "source_size", "target", "quota", "offset")
    placed = keyed(rows).join(quotas, ["filled", "missing", "shard"])
    line = Window.partitionBy("filled", "missing", "shard").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("end", F.sum("size").over(line))
    laps = F.floor(F.col("quota") / F.greatest(F.col("shard_size"), F.lit(1)))
    rest = F.col("quota") - laps * F.col("shard_size")
    begin, stop = F.col("end") - F.col("size"), F.col("offset") + rest
    ahead = F.greatest(F.least("end", stop) - F.greatest(begin, F.col("offset")), F.lit(0))
    round_ = F.greatest(F.least(F.col("end"), stop - F.col("shard_size")) - begin, F.lit(0))
    taken = F.when(F.col("size") > 0, laps * F.col("size") + ahead + round_).otherwise(0).cast("long")
    return placed.select(*unpacked(docs, "mix"), F.struct("size", "source_size", "target", taken.alias("taken")).alias("mix"))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: every document as often as its taken words fill it, rounded; documents stay whole."""
    d = mix(docs, **settings)
    copies = F.floor(F.col("mix.taken") / F.greatest(F.col("mix.size"), F.lit(1)) + 0.5).cast("int")
    return d.withColumn("mix", F.explode(F.array_repeat(F.lit(0), copies))).drop("mix")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs, alike=True).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


SQL = rf"""
WITH par AS (SELECT greatest({MIN_SHARDS}, (count(*) + {SHARD_DOCS} - 1) // {SHARD_DOCS}) AS shards FROM documents),
d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
r AS (SELECT d.*, ('0x' || substr(k, 1, 8))::BIGINT % shards AS shard FROM d, par),
p AS (SELECT source, shard, sum(size)::BIGINT AS shard_size FROM r GROUP BY ALL),
s AS (SELECT source, sum(shard_size)::BIGINT AS source_size FROM p GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM s),
s2 AS (SELECT *, (rnk - 1) % 3 + 1 AS weight, source_size * {CAP} AS lim FROM s1),
s3 AS (SELECT *, sum(lim) OVER o - lim AS spent, sum(weight) OVER () - sum(weight) OVER o + weight AS lft, sum(source_size) OVER () AS total FROM s2
       WINDOW o AS (ORDER BY lim::DOUBLE / weight, rnk ROWS UNBOUNDED PRECEDING)),
s4 AS (SELECT *, lim < weight * (total - spent)::DOUBLE / lft AS held FROM s3),
t AS (SELECT source, source_size, total::BIGINT AS total, CASE WHEN held THEN lim::DOUBLE ELSE weight * (total - sum(CASE WHEN held THEN lim ELSE 0 END) OVER ())::DOUBLE
      / greatest(sum(CASE WHEN held THEN 0 ELSE weight END) OVER (), 1) END AS target FROM s4),
v AS (SELECT *, round(target * 64)::BIGINT AS vote, round(total::DOUBLE / {BLOCK})::BIGINT AS blocks FROM t),
a0 AS (SELECT *, sum(vote) OVER () AS tt, count(*) OVER () AS kk FROM v),
a1 AS (SELECT *, greatest(floor(vote * (2 * blocks - kk)::DOUBLE / greatest(2 * tt, 1) + 0.5), 0)::BIGINT AS base FROM a0),
a2 AS (SELECT *, CASE WHEN tt > 0 THEN blocks - sum(base) OVER () ELSE 0 END AS rest FROM a1),
a3 AS (SELECT source, rest, vote::DOUBLE / (2 * (base + j) - 1) AS quo, j FROM (SELECT *, unnest(range(1, least(ceil(vote * kk::DOUBLE / greatest(tt, 1)) + 1, rest)::BIGINT + 1)) AS j FROM a2)),
a4 AS (SELECT source, count(*) AS more FROM (SELECT *, row_number() OVER (ORDER BY quo DESC, source NULLS LAST, j) AS n FROM a3) WHERE n <= rest GROUP BY source),
g AS (SELECT a2.source, a2.source_size, a2.target, (base + coalesce(more, 0))::BIGINT AS seats FROM a2 LEFT JOIN a4 ON a2.source IS NOT DISTINCT FROM a4.source),
b0 AS (SELECT p.*, g.source_size, g.target, g.seats, sum(shard_size) OVER w AS tt, count(*) OVER w AS kk FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source WINDOW w AS (PARTITION BY p.source)),
b1 AS (SELECT *, greatest(floor(shard_size * (2 * seats - kk)::DOUBLE / greatest(2 * tt, 1) + 0.5), 0)::BIGINT AS base FROM b0),
b2 AS (SELECT *, CASE WHEN tt > 0 THEN seats - sum(base) OVER (PARTITION BY source) ELSE 0 END AS rest FROM b1),
b3 AS (SELECT source, shard, rest, shard_size::DOUBLE / (2 * (base + j) - 1) AS quo, j FROM (SELECT *, unnest(range(1, least(ceil(shard_size * kk::DOUBLE / greatest(tt, 1)) + 1, rest)::BIGINT + 1)) AS j FROM b2)),
b4 AS (SELECT source, shard, count(*) AS more FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY quo DESC, shard, j) AS n FROM b3) WHERE n <= rest GROUP BY ALL),
q AS (SELECT b2.source, b2.shard, b2.shard_size, b2.source_size, b2.target, least((base + coalesce(more, 0)) * {BLOCK}, b2.shard_size * {CAP})::BIGINT AS quota,
      (('0x' || substr(md5('{SEED}|' || b2.shard::VARCHAR || '|' || coalesce(b2.source, '')), 1, 8))::BIGINT % greatest(ceil(b2.shard_size::DOUBLE / {BLOCK}), 1)::BIGINT) * {BLOCK} AS off
      FROM b2 LEFT JOIN b4 ON b2.source IS NOT DISTINCT FROM b4.source AND b2.shard = b4.shard),
l AS (SELECT r.doc_id, r.size, q.*, sum(r.size) OVER (PARTITION BY r.source, r.shard ORDER BY r.k, r.size ROWS UNBOUNDED PRECEDING)::BIGINT AS fin
      FROM r JOIN q ON r.source IS NOT DISTINCT FROM q.source AND r.shard = q.shard),
m AS (SELECT *, quota // greatest(shard_size, 1) AS laps, off + quota - (quota // greatest(shard_size, 1)) * shard_size AS stop FROM l)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN laps * size + greatest(least(fin, stop) - greatest(fin - size, off), 0) + greatest(least(fin, stop - shard_size) - (fin - size), 0) ELSE 0 END::BIGINT AS taken FROM m
"""
