"""Generation requests and their logs: validation, forbidden tokens, rate and concurrency limits, model status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import strip

#: Tokens and tags that a prompt may not hold.
FORBIDDEN = r"(?iu)<start_of_turn>|<end_of_turn>|<bos>|<eos>|<\|[^|]+\|>|\[CASUAL\]|\[EMAIL-PROF\]|\[ACADÉMICO\]"
API_TAGS = {"casual": "[CASUAL]", "professional": "[EMAIL-PROF]", "academic": "[ACADÉMICO]"}


def forbidden(prompt: str | Column) -> Column:
    return (F.col(prompt) if isinstance(prompt, str) else prompt).rlike(FORBIDDEN)


def violations(prompt: str = "prompt", register: str = "register", max_tokens: str = "max_tokens") -> Column:
    """Names of the rules that a request breaks; a null prompt is an empty one, a null register or count the default."""
    n = F.length(strip(F.coalesce(F.col(prompt), F.lit(""))))
    rules = [
        (n < 1, "prompt_empty"),
        (n > 4000, "prompt_too_long"),
        (~F.coalesce(F.col(register), F.lit("casual")).isin(*API_TAGS), "register_unknown"),
        (~F.coalesce(F.col(max_tokens), F.lit(500)).between(1, 2000), "max_tokens_out_of_range"),
    ]
    return F.filter(F.array(*[F.when(bad, name) for bad, name in rules]), lambda v: v.isNotNull())


def status(prompt: str = "prompt", register: str = "register", max_tokens: str = "max_tokens") -> Column:
    """422 for invalid requests, 400 for forbidden tokens, else 200."""
    return F.when(F.size(violations(prompt, register, max_tokens)) > 0, 422).when(forbidden(prompt), 400).otherwise(200)


def tagged(prompt: str, register: str, tags: dict[str, str] = API_TAGS) -> Column:
    """The prompt after its register's tag; unknown registers get the casual one."""
    table = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv])
    return F.concat_ws(" ", F.coalesce(F.element_at(table, F.col(register)), F.lit(tags["casual"])), F.col(prompt))


def rate_limited(events: DataFrame, client: str, ts: str, order: str, limit: int = 10, every: str = "1 minute") -> DataFrame:
    """events with `window_start` and `limited`: true for those after the first `limit` of a client's fixed window."""
    start = F.window(F.col(ts).cast("timestamp"), every)["start"]
    w = Window.partitionBy(client, "window_start").orderBy(ts, order)
    return events.withColumn("window_start", start).withColumn("limited", F.row_number().over(w) > limit)


def concurrency(calls: DataFrame, begin: str, end: str, by: str, limit: int = 3, every: int = 3600) -> DataFrame:
    """(by, at, running, over): calls running after each start or end, by a running sum of +1 and -1; ends come first.

    Time is cut into slices of `every` seconds: sums run inside a slice, on top of what the sums of earlier slices leave,
    so a key with all calls is summed in many tasks.
    """
    moves = calls.select(by, F.explode(F.array(F.struct(F.col(begin).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("m"))
    net = moves.groupBy(by, "m.at").agg(F.sum("m.d").alias("d")).withColumn("_s", F.floor(F.unix_seconds(F.col("at").cast("timestamp")) / every))
    upto = Window.partitionBy(by).orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    slices = net.groupBy(by, "_s").agg(F.sum("d").alias("_d")).select(by, "_s", (F.sum("_d").over(upto) - F.col("_d")).alias("_o"))
    inside = F.sum("d").over(Window.partitionBy(by, "_s").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    running = net.withColumn("_i", inside).join(slices, [by, "_s"]).withColumn("running", F.col("_i") + F.col("_o"))
    return running.select(by, "at", "running", (F.col("running") > limit).alias("over"))


def call_status(seconds: Column, failed: Column, timeout: int = 120) -> Column:
    """HTTP status of a finished call: 504 over the timeout, 500 for another failure, else 200."""
    return F.when(seconds > timeout, 504).when(failed, 500).otherwise(200)


def call_error(status: Column, streamed: Column) -> Column:
    """What a client is told: an error event for a stream, a detail otherwise; nothing for a success."""
    name = F.when(status == 504, "upstream_timeout").when(status == 500, "internal")
    return F.when(name.isNull(), None).when(streamed, F.concat(F.lit("data: "), F.to_json(F.struct(name.alias("error"))), F.lit("\n\n"))).otherwise(name)


def model_status(models: str | Column, name: str) -> Column:
    """ok if a listed model's name holds `name`, degraded if not, error without a list. models: array<struct<name>>."""
    c = F.col(models) if isinstance(models, str) else models
    return F.when(c.isNull(), "error").when(F.exists(c, lambda m: F.contains(m["name"], F.lit(name))), "ok").otherwise("degraded")
