"""Windows and limits over event streams; each has a batch twin in the operators and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, by: list[str], size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window_start, by, n): tumbling windows, or sliding ones with `slide`; on a stream, closed by the watermark."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    e = e.withWatermark("_ts", late) if events.isStreaming else e
    w = F.window("_ts", size, slide) if slide else F.window("_ts", size)
    return e.groupBy(w, *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), *by, "n")


def sessions(events: DataFrame, ts: str, by: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(session_start, session_end, by, n)"""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    e = e.withWatermark("_ts", late) if events.isStreaming else e
    s = e.groupBy(F.session_window("_ts", gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return s.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")


def over_limit(events: DataFrame, ts: str, client: str, limit: int = 10, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(window_start, client, n, rejected): clients over the limit of a fixed window, with how many requests it refuses."""
    return windowed_counts(events, ts, [client], every, late=late).filter(F.col("n") > limit).withColumn("rejected", F.col("n") - limit)
