"""Building a corpus: dedup, caps, prompts, formatting, splits, manifest. Functions take and return DataFrames.

Orders are by a hash of (seed, id), so results depend on nothing else and are the same however rows are partitioned.
Ranks within a register are taken over ids and hashes only; texts do not travel through the sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import append_once, chat_template, normal_hash, words

REGISTERS = ("casual", "email_prof", "academic")
TAGS = {"casual": "[CASUAL]", "email_prof": "[EMAIL-PROF]", "academic": "[ACADÉMICO]"}
MAX_TOKENS = 2048


def seeded(seed: int | str, *ids: str | Column) -> Column:
    """The order of a seed: md5 of the seed and the ids."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(i) if isinstance(i, str) else i).cast("string") for i in ids]))


def register_of(doc_id: str | Column) -> Column:
    """A register for tables that have none."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.element_at(F.array(*[F.lit(r) for r in REGISTERS]), (F.pmod(c, F.lit(len(REGISTERS))) + 1).cast("int"))


def first_occurrence(df: DataFrame, text: str, order: str, by: list[str] | None = None) -> DataFrame:
    """The first row, by `order`, of each normal form (per `by`); the least order per hash is a partial aggregate, and
    the rows come back by a join that adaptive execution may split, so a text that fills a third of the table is no
    bottleneck. Missing texts count as empty. `order` has to be unique."""
    by = by or []
    key = normal_hash(F.coalesce(F.col(text), F.lit("")))
    firsts = df.select(*by, key.alias("_k"), order).groupBy(*by, "_k").agg(F.min(order).alias(order)).select(order)
    return df.join(firsts, order, "left_semi")


def ranked(df: DataFrame, by: list[str], seed: int | str, ident: str) -> DataFrame:
    """df with `rank`, from 1, and `n`, the rows of the group, in seeded order.

    The order is cut into 4096 ranges of the hash: rows are ranked inside a range, and the ranges' counts, a few thousand
    numbers a group, say where each begins. So a group of any size is sorted in many tasks.
    """
    slim = df.select(*by, ident).withColumn("_h", seeded(seed, ident)).withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    group = Window.partitionBy(*by)
    counts = slim.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    begin = counts.select(*by, "_b", (F.sum("_c").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_o"), F.sum("_c").over(group).alias("n"))
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", ident))
    ranks = slim.withColumn("_r", inside).join(begin, [*by, "_b"]).select(ident, (F.col("_r") + F.col("_o")).alias("rank"), "n")
    return df.join(ranks, ident)


def cap(df: DataFrame, by: list[str], most: int, seed: int | str = 42, ident: str = "doc_id") -> DataFrame:
    """At most `most` rows of each group, the first in seeded order (a sample without replacement)."""
    w = Window.partitionBy(*by).orderBy(seeded(seed, ident), ident)
    kept = df.select(*by, ident).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).select(ident)
    return df.join(kept, ident, "left_semi")


def assign_prompts(df: DataFrame, prompts: DataFrame, seed: int | str = 42, ident: str = "doc_id") -> DataFrame:
    """df with a prompt of its register, chosen by hash: an equality join on (register, position) with the catalogue.

    A register without a catalogue gets the default prompt "[REGISTER] ..." of its name. Catalogues are a few lines per
    register, numbered from 0 in `pos`.
    """
    sizes = prompts.groupBy("register").agg(F.count(F.lit(1)).alias("_n"))
    number = F.conv(F.substring(seeded(seed, ident), 1, 8), 16, 10).cast("long")
    placed = df.join(sizes, "register", "left").withColumn("pos", number % F.col("_n")).drop("_n")
    joined = placed.join(prompts.select("register", "pos", "prompt"), ["register", "pos"], "left").drop("pos")
    return joined.withColumn("prompt", F.coalesce("prompt", F.concat(F.lit("["), F.upper("register"), F.lit("] ..."))))


def format_examples(df: DataFrame, text: str = "text", eos: str = "", most: int = MAX_TOKENS, tokens=None) -> DataFrame:
    """(…, text formatted, original_text): template, EOS once, and no example over `most` tokens.

    `tokens` counts tokens of a text column (white-space words unless given). Rows without a text are dropped.
    """
    tokens = tokens or (lambda c: F.size(words(c)))
    made = df.filter(F.col(text).isNotNull()).withColumn("original_text", F.col(text)).withColumn(text, append_once(chat_template("prompt", text), eos))
    return made.filter(tokens(F.col(text)) <= most)


def split(df: DataFrame, by: list[str], test: float = 0.1, val: float = 0.1, seed: int | str = 42, ident: str = "doc_id") -> DataFrame:
    """df with `split`: in each group the first test share of the seeded order is test, then val of the rest, then train."""
    r = ranked(df, by, seed, ident)
    n_test = F.round(F.col("n") * test)
    n_val = F.round((F.col("n") - n_test) * (val / (1 - test)))
    part = F.when(F.col("rank") <= n_test, "test").when(F.col("rank") <= n_test + n_val, "val").otherwise("train")
    return r.withColumn("split", part).drop("rank", "n")


def balanced_head(df: DataFrame, label: str, most: int, order: str) -> DataFrame:
    """The first rows of each label by `order`, as many of each: the least group's size, at most `most`."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("c")).agg(F.least(F.min("c"), F.lit(most)).alias("_m"))
    w = Window.partitionBy(label).orderBy(order)
    kept = df.select(label, order).withColumn("_r", F.row_number().over(w)).join(F.broadcast(n)).filter("_r <= _m").select(order)
    return df.join(kept, order, "left_semi")


def digest(df: DataFrame, by: list[str]) -> DataFrame:
    """Row count and an order-free digest of each group's rows: SHA-256 over two sums of parts of the rows' SHA-256.

    Sums are partial aggregates, so no task gathers a group. It differs from the digest of a file's bytes, which would
    depend on the order of parts.
    """
    row = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(c for c in df.columns if c not in by)])
    part = lambda at: F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    sums = df.select(*by, F.sha2(row, 256).alias("h")).groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), part(1).alias("a"), part(16).alias("b"))
    return sums.select(*by, "rows", F.sha2(F.concat_ws("-", "a", "b"), 256).alias("sha256"))


def manifest(df: DataFrame, prompts: DataFrame, seed: int | str = 42, most: int = 1000) -> DataFrame:
    """One row: settings, counts by split and register, digests by split and of the catalogues; `to_json` makes a file."""
    d = digest(df.select("split", "register", "text", "original_text"), ["split"])
    totals = d.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "rows")))).alias("counts"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "sha256")))).alias("sha256"))
    per = df.groupBy("split", "register").count()
    maps = per.agg(
        *[F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("split") == s, F.struct("register", "count"))))).alias(f"{s}_by_register") for s in ("train", "test")]
    )
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "prompt"))), lambda x: x["prompt"]), "\n")
    sha = prompts.groupBy("register").agg(F.sha1(lines).alias("s")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("register", "s")))).alias("prompts_sha1"))
    fixed = [F.current_timestamp().alias("created_at"), F.lit(seed).alias("seed"), F.lit(most).alias("max_per_register"), F.lit(MAX_TOKENS).alias("max_token_len")]
    return totals.crossJoin(maps).crossJoin(sha).select(*fixed, "*")  # one row each


def build_dataset(items: DataFrame, prompts: DataFrame, most: int = 1000, seed: int | str = 42, test: float = 0.1, val: float = 0.1, eos: str = "", tokens=None) -> DataFrame:
    """The whole build over (doc_id, text, register): dedup per register, cap, prompts, format and filter, split."""
    one = first_occurrence(items, "text", "doc_id", ["register"])
    formatted = format_examples(assign_prompts(cap(one, ["register"], most, seed), prompts, seed), eos=eos, tokens=tokens)
    return split(formatted, ["register"], test, val, seed).select("doc_id", "register", "split", "text", "original_text")


def write_splits(df: DataFrame, path: str) -> None:
    """JSON lines by split; the validation part again under the name `valid`."""
    again = df.filter("split = 'val'").withColumn("split", F.lit("valid"))
    df.unionByName(again).write.mode("overwrite").partitionBy("split").json(path)
