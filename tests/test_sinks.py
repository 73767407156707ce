"""Sinks and settings."""

import json

from pyspark.sql import functions as F

from corpusloom.operators import corpus, evaluate
from corpusloom.sources import sinks
from tests.test_operators import items, prompts


def read_one(path):
    return "".join(p.read_text(encoding="utf-8") for p in sorted(path.glob("part-*")))


def test_jsonl_and_manifest(spark, tmp_path):
    sinks.write_jsonl(spark.createDataFrame([("ñandú",)], "text string"), str(tmp_path / "j"), 1)
    assert json.loads(read_one(tmp_path / "j")) == {"text": "ñandú"}
    built = corpus.build_dataset(items(spark, 30), prompts(spark))
    sinks.write_manifest(corpus.manifest(built, prompts(spark)), str(tmp_path / "m"))
    m = json.loads(read_one(tmp_path / "m"))
    assert sum(m["counts"].values()) == 30 and m["seed"] == 42


def test_pairs_share_an_order(spark, tmp_path):
    pairs, key = evaluate.blind_pairs(items(spark, 30), prompts(spark), lambda r, p: F.upper(p), per_register=3)
    sinks.write_pairs(pairs, key, str(tmp_path / "p"), str(tmp_path / "k"))
    ids = [[json.loads(x)["id"] for x in read_one(tmp_path / n).splitlines()] for n in ("p", "k")]
    assert ids[0] == ids[1] and len(ids[0]) == 9 and ids[0] != sorted(ids[0])


def test_generations_are_kept(spark, tmp_path):
    path = str(tmp_path / "g")
    one = sinks.cached_generations(prompts(spark, 2), lambda r, p: F.concat(F.lit("first "), p), path).collect()
    two = sinks.cached_generations(prompts(spark, 3), lambda r, p: F.concat(F.lit("second "), p), path).collect()
    assert {r.generated for r in one} == {"first prompt 0", "first prompt 1"}
    assert {r.generated for r in two} == {"first prompt 0", "first prompt 1", "second prompt 2"} and len(two) == 9


def test_summary_and_settings(spark, monkeypatch):
    row = sinks.summary(spark, {"e1_gain": 21.5, "e3_accuracy": None}).first()
    assert row.e1_gain == 21.5 and row.e3_accuracy is None
    monkeypatch.setenv("GENERATE_PER_MINUTE", "7")
    monkeypatch.setenv("ALLOWED_ORIGINS", "http://a.example, http://b.example")
    s = sinks.Settings.from_environment()
    assert s.generate_per_minute == 7 and s.allowed_origins == ("http://a.example", "http://b.example") and s.timeout_seconds == 120
