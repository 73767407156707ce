"""Operators do the whole job: findings of the first review."""

from pyspark.sql import functions as F

from corpusloom.llm import mixing, pii


# --- mixing


def off_target(docs):
    """By source: words the mix emits over its target, in halves of the source's longest document (less a block)."""
    size = F.regexp_count("text", F.lit(mixing.WORD))
    want = {r.source: (r.t, r.m) for r in mixing.mix(docs).groupBy("source").agg(F.first("mix.target").alias("t"), F.max("mix.size").alias("m")).collect()}
    got = {r.source: r.n for r in mixing.mixed(docs).groupBy("source").agg(F.sum(size).alias("n")).collect()}
    return {s: (abs(got.get(s, 0) - t) - mixing.BLOCK) / max(m / 2, 1) for s, (t, m) in want.items()}


def test_emitted_words_meet_targets(spark, small_dir):
    for folder in (small_dir, small_dir.replace("0.001", "0.01")):
        docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "text")
        assert max(off_target(docs).values()) <= 1


def test_emitted_words_of_many_shards(spark):
    big = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 > 0, "big").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"))
    assert max(off_target(big).values()) <= -(-4900 // mixing.LEAST_DOCS)


# --- PII


def test_shared_signature_is_revealing(spark):
    # the same 48 code points stand around the address in every text
    foot = "Kind regards from the whole of the sales department team, Jane Zarvoski, jane@firm.example, Head of Sales of the whole firm and of its daughters"
    rows = [(i, f"Note {i}: topic{chr(97 + i)} is due. {foot}") for i in range(9)]
    rows += [(100 + i, f"Note {i} is due. {foot.replace('Jane Zarvoski, jane@firm.example', 'nobody')} {i}") for i in range(90)] + [(60, "a word with Zarvoski")]
    out = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "pii.*").collect()}
    assert [s.value for s in out[60].terms] == ["Zarvoski"] and [s.value for s in out[0].terms] == ["Jane", "Zarvoski"] and out[100].terms == []


def test_far_term_is_revealing(spark):
    rows = [(i, f"Zarvoski {'and so on ' * 20} item {i}: z.boss@firm.example") for i in range(5)] + [(10 + i, f"and so on item {i}") for i in range(60)]
    out = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "pii.*").collect()}
    assert all([s.value for s in out[i].terms] == ["Zarvoski"] for i in range(5)) and out[12].terms == []
