"""Sinks: JSON lines, manifests, blind pairs, generations kept between runs, result summaries; settings from the environment."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.files import generation_key


def write_jsonl(df: DataFrame, path: str, files: int | None = None) -> None:
    """One JSON object a line, characters as they are; `files` gathers the parts, for small results only."""
    (df.coalesce(files) if files else df).write.mode("overwrite").json(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """The one-row manifest as indented JSON."""
    manifest.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_pairs(pairs: DataFrame, key: DataFrame, pairs_path: str, key_path: str) -> None:
    """Pairs and their key in the same shuffled order; a test for judges is small, so each is one file."""
    for df, path in ((pairs, pairs_path), (key, key_path)):
        df.orderBy("shuffle_rank", "id").drop("shuffle_rank").coalesce(1).write.mode("overwrite").json(path)


def cached_generations(prompts: DataFrame, generate: Callable[[Column, Column], Column], path: str) -> DataFrame:
    """prompts (register, prompt, ...) with `generated`: read from `path` where known, made and kept where not.

    Entries are keyed by the content of register and prompt, so a changed prompt is made anew and a rerun makes nothing.
    What is missing goes to a new folder under `path`, never to one that is being read; of two runs that made the same
    entry the least text counts.
    """
    spark = prompts.sparkSession
    keyed = prompts.withColumn("key", generation_key(F.col("register"), F.col("prompt")))
    read = lambda: spark.read.schema("key string, generated string").parquet(f"{path}/batch-*")
    try:
        missing = keyed.join(read().select("key"), "key", "left_anti")
    except AnalysisException:  # nothing has been kept yet
        missing = keyed
    made = missing.select("key", "register", "prompt").dropDuplicates(["key"]).withColumn("generated", generate(F.col("register"), F.col("prompt")))
    made.select("key", "generated").write.parquet(f"{path}/batch-{uuid.uuid4()}")
    return keyed.join(read().groupBy("key").agg(F.min("generated").alias("generated")), "key").drop("key")


def summary(spark, results: dict[str, float | None]) -> DataFrame:
    """Headline results as one row with the time; a missing one is null, that is, pending."""
    row = ", ".join(f"{k} double" for k in results)
    return spark.createDataFrame([tuple(results.values())], row).withColumn("created_at", F.current_timestamp())


@dataclass(frozen=True)
class Settings:
    """Service limits, overridable by variables of the environment of the same names in capitals."""

    max_concurrent_streams: int = 3
    generate_per_minute: int = 10
    health_per_minute: int = 30
    timeout_seconds: int = 120
    allowed_origins: tuple[str, ...] = ("http://localhost:8000",)

    @classmethod
    def from_environment(cls) -> Settings:
        own = cls()
        number = lambda name: int(os.environ.get(name.upper(), getattr(own, name)))
        origins = tuple(o.strip() for o in os.environ.get("ALLOWED_ORIGINS", ",".join(own.allowed_origins)).split(",") if o.strip())
        return cls(*(number(n) for n in ("max_concurrent_streams", "generate_per_minute", "health_per_minute", "timeout_seconds")), origins)
