"""Sums over resamples equal those over their rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.draws import hashed_numbers
from corpusloom.operators import evaluate


@pytest.mark.parametrize(("prefix", "n"), [("42|7|", 12345), ("x" * 52, 1234), ("é|", 3), ("", 0)])
def test_hashed_numbers(prefix, n):
    got = [int(x) for part in hashed_numbers(prefix, n) for x in part]
    assert got == [int(hashlib.md5(f"{prefix}{i}".encode()).hexdigest()[:8], 16) for i in range(n)]


@pytest.mark.parametrize("slab", [1 << 23, 64])
def test_sums(spark, monkeypatch, slab):
    monkeypatch.setattr(evaluate, "SLAB", slab)
    df = spark.createDataFrame([(i, float(i * i % 97) if i % 9 else None) for i in range(150)], "doc_id long, v double")
    rows = evaluate.resampled(df, "doc_id", 60).groupBy("replicate").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))
    made = evaluate.resampled_sums(df, ["v"], "doc_id", 60)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, rows.collect()))
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")[0]
    assert evaluate.resampled_sums(df.limit(0), ["v"], "doc_id", 60).count() == 0


def test_mean_difference(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", None if i == 7 else float(i)) for i in range(90)], "doc_id long, s string, v double")
    got = evaluate.bootstrap_mean_difference(df, "s", "a", "v", "doc_id", 40).first()
    means = [{r.replicate: r.m for r in evaluate.resampled(df.filter(F.col("s") == s), "doc_id", 40).groupBy("replicate").agg(F.avg("v").alias("m")).collect()} for s in "ab"]
    d = [abs(means[0][r] - means[1][r]) for r in range(40)]
    assert (got.ci_low, got.ci_high) == pytest.approx(tuple(np.quantile(d, [0.025, 0.975])))
