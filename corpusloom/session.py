"""Session building and the few session-wide services the operators share."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A local session with the settings the library expects; on a cluster, pass your own session instead."""
    return (
        SparkSession.builder.master(master)
        .appName("corpusloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed: its parent goes on their path.

    Clusters usually install the package or pass it with --py-files; a path that an executor lacks does no harm.
    """
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([*parts, root])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineages: what spark.checkpoint.dir names.

    A local session may go without and gets a temporary folder; anywhere else, executors would not share one, so that the
    setting is required.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpusloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, which survives lost executors.

    The planner's guess of the size is cut, too: over rounds of joins such guesses grow to numbers of a million digits.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)
