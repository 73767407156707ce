"""Corpus building, requests, evaluation and streams on small tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import corpus, evaluate, requests
from corpusloom.streaming import events


def prompts(spark, n=3):
    return spark.createDataFrame([(r, i, f"prompt {i}") for r in corpus.REGISTERS for i in range(n)], "register string, pos long, prompt string")


def items(spark, n):
    return spark.createDataFrame([(i, f"text number {i}", corpus.REGISTERS[i % 3]) for i in range(n)], "doc_id long, text string, register string")


def test_first_occurrence(spark):
    df = spark.createDataFrame([(3, "A  b"), (1, "a B "), (2, "c"), (4, None), (5, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus.first_occurrence(df, "text", "doc_id").collect()) == [1, 2, 4]
    assert corpus.first_occurrence(df.limit(0), "text", "doc_id").count() == 0


def test_split_is_a_partition(spark):
    df = items(spark, 300)
    one, again = (sorted(tuple(r) for r in corpus.split(df.repartition(k), ["register"]).select("doc_id", "split").collect()) for k in (2, 7))
    assert one == again and len(one) == 300
    assert Counter(s for _, s in one) == {"train": 240, "val": 30, "test": 30}


def test_build(spark):
    built = corpus.build_dataset(items(spark, 120).union(items(spark, 3).withColumn("doc_id", F.col("doc_id") + 1000)), prompts(spark), most=30, eos="<eos>").cache()
    rows = built.collect()
    assert Counter(r.register for r in rows) == {r: 30 for r in corpus.REGISTERS}
    assert all(r.text.endswith("<eos>") and r.original_text in r.text and "prompt " in r.text for r in rows)
    m = corpus.manifest(built, prompts(spark), most=30).first()
    assert sum(m.counts.values()) == 90 and set(m.sha256) == {"train", "val", "test"} and sum(m.train_by_register.values()) == m.counts["train"]
    again = corpus.manifest(built.repartition(5), prompts(spark), most=30).first()
    assert again.sha256 == m.sha256
    none = corpus.build_dataset(items(spark, 30), prompts(spark), tokens=lambda c: F.lit(9999))
    assert none.count() == 0


def test_missing_catalogue(spark):
    got = corpus.assign_prompts(items(spark, 3), prompts(spark).filter("register <> 'academic'"))
    assert {r.register: r.prompt for r in got.collect()}["academic"] == "[ACADEMIC] ..."


def test_write_splits(spark, tmp_path):
    corpus.write_splits(corpus.build_dataset(items(spark, 60), prompts(spark)), str(tmp_path / "out"))
    n = {r.split: r["count"] for r in spark.read.json(str(tmp_path / "out")).groupBy("split").count().collect()}
    assert n == {"train": 48, "val": 6, "valid": 6, "test": 6}


@pytest.mark.parametrize("bad", ["<start_of_turn>", "x <END_OF_TURN>", "<bos>", "<eos>", "<|im_start|>", "[casual] hi", "[EMAIL-PROF]", "[académico]"])
def test_forbidden(spark, bad):
    assert spark.createDataFrame([(bad,)], "p string").select(requests.forbidden("p")).first()[0]


def test_validation(spark):
    rows = [("hi", "casual", 500), ("  ", "casual", 500), ("x" * 4001, "academic", 1), ("ok", "other", 2001), (None, None, None), ("<bos>", "casual", 10)]
    got = spark.createDataFrame(rows, "prompt string, register string, max_tokens int").select(requests.violations().alias("v"), requests.status().alias("s")).collect()
    assert [r.v for r in got] == [[], ["prompt_empty"], ["prompt_too_long"], ["register_unknown", "max_tokens_out_of_range"], ["prompt_empty"], []]
    assert [r.s for r in got] == [200, 422, 422, 422, 422, 400]


def test_limits(spark):
    e = spark.createDataFrame([(i, "a", f"2024-01-01 00:00:{i:02d}") for i in range(12)] + [(50, "b", "2024-01-01 00:00:01"), (51, "a", "2024-01-01 00:01:00")], "id int, client string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.id for r in requests.rate_limited(e, "client", "ts", "id").filter("limited").collect()) == [10, 11]
    assert [(r.client, r.n, r.rejected) for r in events.over_limit(e, "ts", "client").collect()] == [("a", 12, 2)]
    c = spark.createDataFrame([("m", 0, 10), ("m", 1, 5), ("m", 2, 6), ("m", 3, 4), ("m", 10, 12)], "k string, a int, z int")
    assert max(r.running for r in requests.concurrency(c, "a", "z", "k").collect()) == 4
    assert [r["at"] for r in requests.concurrency(c, "a", "z", "k").filter("over").collect()] == [3]


def test_model_status(spark):
    df = spark.createDataFrame([(1, [("m:latest",)]), (2, [("x",)]), (3, None)], "i int, models array<struct<name:string>>")
    assert [r[0] for r in df.orderBy("i").select(requests.model_status("models", "m:")).collect()] == ["ok", "degraded", "error"]


def test_mann_whitney(spark):
    rng = random.Random(5)
    a, b = [rng.randint(0, 6) for _ in range(30)], [rng.randint(3, 10) for _ in range(25)]
    long = spark.createDataFrame([("a", "m", float(x)) for x in a] + [("b", "m", float(x)) for x in b], "s string, metric string, value double")
    got = evaluate.mann_whitney(long, "s", "a").first()
    assert got.u == sum((x > y) + (x == y) / 2 for x in a for y in b)
    assert 0 < got.p_value < 0.05
    tied = spark.createDataFrame([("a", "m", 1.0), ("b", "m", 1.0)], "s string, metric string, value double")
    assert evaluate.mann_whitney(tied, "s", "a").first().p_value is None


def test_perplexity(spark):
    df = spark.createDataFrame([(1, 10.0, 5), (2, 2.0, 1), (3, 0.0, 0)], "id int, nll_sum double, n_tokens long")
    assert evaluate.perplexity(df).first().ppl == pytest.approx(2.718281828459045**2)
    b = evaluate.bootstrap_perplexity(df, "id", 50).first()
    assert b.ci_low <= b.median <= b.ci_high


def test_report(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (1, 1)], "y int, g int")
    got = {r["class"]: (r.precision, r.recall, r.support) for r in evaluate.classification_report(df, "y", "g").collect()}
    assert got[1] == (1.0, pytest.approx(2 / 3), 3) and got[0] == (pytest.approx(2 / 3), 1.0, 2)
    assert evaluate.accuracy(df.limit(0), "y", "g").first().accuracy is None


def test_pairs(spark):
    pairs, key = evaluate.blind_pairs(items(spark, 60), prompts(spark, 5), lambda r, p: F.concat(F.lit("made "), p), per_register=4)
    rows = {r.id: r for r in pairs.collect()}
    assert len(rows) == 12
    for k in key.collect():
        real, made = (rows[k.id].text_a, rows[k.id].text_b) if k.real_position == "a" else (rows[k.id].text_b, rows[k.id].text_a)
        assert real.startswith("text number") and made == f"made {k.prompt_used}"


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "event_type", "user_id")
    src.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = events.windowed_counts(live, "ts", ["event_type"], "1 hour").writeStream.format("memory").queryName("live_windows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.sql("SELECT * FROM live_windows").collect()}
    want = {tuple(r) for r in events.windowed_counts(src, "ts", ["event_type"], "1 hour").collect()}
    assert got <= want and len(got) > 0.9 * len(want)  # the watermark keeps the last windows open
