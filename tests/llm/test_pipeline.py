"""The pipeline, stage by stage, against brute-force versions on the smallest documents."""

import hashlib
from collections import Counter

import corpus_pipeline
from corpusloom.llm import mixing, quality, registry
from tests.llm.test_native import windows_away
from tests.llm.test_near import reach, shingled


def test_stages(spark, small_dir, tmp_path):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small_dir)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen.append(name)
        if name != "byte_bpe":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        a, b = {r.doc_id: r.text for r in before.collect()}, docs.collect()
        if name == "quality_classifier":
            model = quality.fit(before, spark.read.parquet(f"{small_dir}/labels.parquet"))
            good = {r.doc_id for r in quality.score(before, model).filter("quality_score >= 0.3").collect()}
            assert {r.doc_id for r in b} == good and 0.6 < len(good) / len(a) < 1
        elif name == "line_dedup":
            want = {i: t for i, t in windows_away(a).items() if t.strip() or t == a[i]}
            assert {r.doc_id: r.text for r in b} == want and all(r.n_chars == len(r.text) for r in b)
        elif name == "minhash_near_dedup":
            sets = {i: shingled(t, 5) for i, t in a.items()}
            links = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
            assert {r.doc_id for r in b} == set(reach(sets, links).values())
        elif name == "source_mixing":
            rows = mixing.mix(before).select("doc_id", "mix.size", "mix.taken").collect()
            assert Counter(r.doc_id for r in b) == Counter({r.doc_id: int(r.taken / max(r["size"], 1) + 0.5) for r in rows if int(r.taken / max(r["size"], 1) + 0.5)})
        else:
            assert all(r.decoded_sha256 == hashlib.sha256(a[r.doc_id].encode()).hexdigest() and len(r.ids) == 4 * r.n_tokens for r in b)
    assert seen == ["quality_classifier", "line_dedup", "minhash_near_dedup", "source_mixing", "byte_bpe"]


def test_run(spark, small_dir):
    assert registry.queries()["pipeline"](spark, small_dir).count() > 50
    assert corpus_pipeline.ORACLE_SQL is None


def test_odd(spark, odd_docs, small_dir):
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda d: sorted(str(r.doc_id) for r in d.select("doc_id").collect())
    scored = quality.score(odd_docs, quality.fit(odd_docs, spark.read.parquet(f"{small_dir}/labels.parquet")))
    assert ids(stages["quality_classifier"](spark, odd_docs, small_dir)) == ids(scored.filter("quality_score >= 0.3"))
    left = stages["line_dedup"](spark, odd_docs, small_dir)
    assert ids(left) == ["1", "2", "2", "3", "4", "5", "6", "7", "9", "None"]  # 8 has the four lines of 7
    one = stages["minhash_near_dedup"](spark, left, small_dir)
    assert ids(one) == ["1", "3", "4", "5", "6", "7", "9", "None"]
    mix = stages["source_mixing"](spark, one, small_dir)
    assert set(ids(mix)) <= {"1", "6", "7", "9", "None"} and "6" in ids(mix)  # texts without words are in no mix
    texts = {str(r.doc_id): r.text for r in one.collect()}
    out = stages["byte_bpe"](spark, mix, small_dir)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"]
    assert all(r.decoded_sha256 == hashlib.sha256(texts[str(r.doc_id)].encode()).hexdigest() for r in out.collect())
    empty = odd_docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, small_dir)
    assert empty.count() == 0
