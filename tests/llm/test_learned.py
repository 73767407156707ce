"""Quality and toxicity: held-out accuracy, and the odd cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import labelled, quality, shingles, toxicity
from tests.llm.conftest import kept


def corpus(spark, n=400):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(n):
        words = rng.choice(["river", "stone", "green", "walks", "under", "quiet", "house", "paper"], 30).tolist()
        bad, toxic = i % 4 == 0, i % 5 == 0
        if toxic:
            words[7], words[20] = "snarkle", "grubnok" + "aeiou"[i % 3]
        text = " ".join(words) + "."
        rows.append((i, "!! ".join(text.upper().split()) if bad else text))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out(spark):
    df = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long")
    for i, h in df.select("doc_id", labelled.held_out()).collect():
        assert h == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0)


def test_quality(spark):
    docs, labels = corpus(spark)
    # labels of held-out rows must not matter
    lies = labels.join(docs.select("doc_id", labelled.held_out().alias("h")), "doc_id").select("doc_id", F.when(F.col("h"), 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"))
    model = quality.fit(docs, labels)
    other = quality.fit(docs, lies)
    assert np.array_equal(model.weights, other.weights) and model.shift == other.shift
    got = quality.score(docs, model).join(labels, "doc_id").filter(labelled.held_out()).collect()
    assert np.mean([(r.quality_score >= 0.3) == bool(r.quality) for r in got]) > 0.97


def test_toxicity(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").filter(labelled.held_out()).collect()
    assert np.mean([(r.toxicity.score >= 0.5) == bool(r.toxic) for r in got]) > 0.97
    marked = [{r.text[s.start : s.end].lower() for s in r.toxicity.spans} for r in got]
    assert set().union(*marked) <= {"snarkle", "grubnoka", "grubnoke", "grubnoki"}
    assert np.mean([bool(m) == bool(r.toxic) for m, r in zip(marked, got, strict=True)]) > 0.9


def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    at = np.array([0, 4, 4, 5, 11])
    emit, move = rng.normal(size=11), rng.normal(size=(2, 2))
    p, stay, leave = toxicity.Lattice(at).marginals(emit, move)
    assert np.allclose(toxicity.Lattice(at).toxic(emit, move), p)
    for a, z in zip(at[:-1], at[1:], strict=True):
        n, total = z - a, 0.0
        one, both, out = np.zeros(n), np.zeros(n), np.zeros(n)
        for code in range(2**n if n else 0):
            y = [(code >> k) & 1 for k in range(n)]
            w = np.exp(sum(emit[a + k] for k in range(n) if y[k]) + sum(move[y[k - 1], y[k]] for k in range(1, n)))
            total += w
            for k in range(n):
                one[k] += w * y[k]
                if k:
                    both[k] += w * (y[k - 1] and y[k])
                    out[k] += w * (y[k - 1] and not y[k])
        if n:
            assert np.allclose(p[a:z], one / total) and np.allclose(stay[a:z], both / total) and np.allclose(leave[a:z], out / total)


def test_scores_do_not_depend_on_the_batch(spark):
    docs, labels = corpus(spark, 120)
    for fit, score, get in ((quality.fit, quality.score, "quality_score"), (toxicity.fit, toxicity.score, "toxicity.score")):
        model = fit(docs, labels)
        one, other = (sorted((r.doc_id, r.s) for r in score(docs.repartition(k), model).select("doc_id", F.col(get).alias("s")).collect()) for k in (1, 9))
        assert one == other


@pytest.mark.parametrize("few", [True, False])
def test_odd(spark, odd_docs, no_docs, few):
    docs, labels = corpus(spark, 120)
    labels = labels.limit(0) if few else labels.union(spark.createDataFrame([(None, None, None), (3, None, 1), (999999, 1, 1)], labels.schema))
    q, t = quality.fit(docs, labels), toxicity.fit(docs, labels)
    scored = kept(toxicity.score(quality.score(odd_docs, q), t), odd_docs)
    for r in scored.select("quality_score", "toxicity.score").collect():
        assert 0 <= r[0] <= 1 and 0 <= r[1] < 0.5
    assert quality.score(no_docs, q).count() == 0 and toxicity.score(no_docs, t).count() == 0
    assert toxicity.fit(no_docs, labels).document is not None and quality.fit(no_docs, labels).shift == 0.0


def test_word_hashes():
    data = "Ab  cd\nAB".encode() + b"ab x"
    words, at = shingles.hash_words(np.frombuffer(data, np.uint8), np.array([0, 9, 9, 13]))
    assert at.tolist() == [0, 3, 3, 5] and words[0] == words[2] == words[3] and len(set(words.tolist())) == 3


def test_token_labels_by_sets():
    """A token of a toxic text is toxic if it or a beginning of it is in many toxic texts and few others."""
    bad = ["the snarkled cat", "a snarkle here", "snarkles and the rest", "we snarkle", "so snarkling today", "nothing at all"]
    good = [f"the quiet house number {i} and a cat" for i in range(40)]
    texts, y = bad + good, np.array([1] * len(bad) + [0] * len(good))
    feats = [toxicity.tokens(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[3] for t in texts]
    marks = toxicity._token_labels(feats, y, toxicity._frequencies(feats, y))
    own = lambda w: {("word", w), *((k, w[:k]) for k in toxicity.PREFIXES)}
    count = lambda f, label: sum(any(f in own(w) for w in t.split()) for t, v in zip(texts, y, strict=True) if v == label)
    for t, label, mark in zip(texts, y, marks, strict=True):
        for word, m in zip(t.split(), mark, strict=True):
            telling = [f for f in own(word) if count(f, 1) >= 4 and (count(f, 1) + 0.25) / len(bad) >= toxicity.RATIO * (count(f, 0) + 0.25) / len(good)]
            assert bool(m) == (bool(telling) and label == 1), (t, word)


def test_scores_by_enumeration(spark):
    """Marginals over all labellings of short texts, their summary and the calibration, step by step."""
    docs, labels = corpus(spark, 200)
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.index.tolist(), model.weight.tolist(), strict=True))
    texts = ["green snarkle walks", "grubnoka", "", "under the quiet stone", "snarkle grubnoke snarkle house paper"]
    got = [r.s for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), model, "t").orderBy("i").select("toxicity.score").withColumnRenamed("score", "s").collect()]
    for t, s in zip(texts, got, strict=True):
        f = toxicity.tokens(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[3].tolist()
        emit = [sum(weight.get(k, 0.0) for k in row) + model.bias for row in f]
        n, total, one = len(f), 0.0, np.zeros(len(f))
        for code in range(2**n if n else 0):
            z = [(code >> k) & 1 for k in range(n)]
            w = np.exp(sum(e for e, v in zip(emit, z, strict=True) if v) + sum(model.move[a, b] for a, b in zip(z, z[1:], strict=False)))
            total, one = total + w, one + w * np.array(z)
        p = one / total if n else one
        most, sure = np.clip(p.max(initial=0), 1e-6, 1 - 1e-6), p[p >= toxicity.COUNTED].sum()
        x = np.array([np.log(most / (1 - most)) / 5, np.log1p(sure), 10 * sure / max(n, 1), 1.0])
        assert s == pytest.approx(1 / (1 + np.exp(-(x * model.document).sum())), abs=1e-4)


def test_ranking_by_gradient_descent():
    """The fitted ranking has the loss of one found by plain descent on the same pairs, and its cut is the quantile."""
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 300)
    x = rng.normal(size=(300, quality.N_FEATURES)) + y[:, None] * np.linspace(0, 0.4, quality.N_FEATURES)
    model = quality.fit_pairs(x, y, pairs=4000)
    z = np.clip((x - x.mean(0)) / np.maximum(x.std(0), 1e-3), -6, 6)
    pick = np.random.default_rng(1952)
    d = z[pick.choice(np.flatnonzero(y == 1), 4000)] - z[pick.choice(np.flatnonzero(y == 0), 4000)]
    w = np.zeros(d.shape[1])
    for _ in range(4000):
        w -= 2e-4 * (-(d / (1 + np.exp(d @ w))[:, None]).sum(0) + 20 * w)
    assert np.allclose(w, model.weights, atol=1e-3)
    assert np.mean(model.scores(x) < quality.THRESHOLD) == pytest.approx((y == 0).mean(), abs=0.01)


def all_pairs(x, y):
    """Weights and shift by brute force: every pair of a better and a worse row, once."""
    z = np.clip((x - x.mean(0)) / np.maximum(x.std(0), 1e-3), -6, 6)
    d = (z[y == 1][:, None] - z[y == 0]).reshape(-1, x.shape[1])
    w = labelled.logistic(d, np.ones(len(d)), ridge=quality.RIDGE * len(d))
    return w, np.log(quality.THRESHOLD / (1 - quality.THRESHOLD)) - np.quantile((z * w).sum(1), (y == 0).mean())


def made(texts):
    data = [t.encode() for t in texts]
    return quality.features(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))


@pytest.mark.parametrize("apart", [0.0, 0.4, 3.0, 40.0])
def test_ranking_on_all_pairs(apart):
    rng = np.random.default_rng(6)
    y = (rng.random(400) < 0.8).astype(int)
    x = rng.normal(size=(400, quality.N_FEATURES)) + y[:, None] * np.linspace(0, apart, quality.N_FEATURES)
    model, (w, shift) = quality.fit_pairs(x, y), all_pairs(x, y)
    assert np.allclose(model.weights, w, rtol=0, atol=1e-8) and model.shift == pytest.approx(shift, abs=1e-7)


def test_fit_on_all_pairs(spark, monkeypatch):
    """The distributed fit is that of all pairs, in one block or in many, whatever the order of the rows."""
    docs, labels = corpus(spark)
    rows = sorted(r for r in docs.join(labels, "doc_id").filter(~labelled.held_out()).select("doc_id", "text", "quality").collect())
    w, shift = all_pairs(made([r.text for r in rows]), np.array([r.quality for r in rows]))
    twice = docs.union(docs).repartition(7), labels.union(labels.withColumn("quality", F.lit(0))).repartition(3)
    for block in (8192, 40):
        monkeypatch.setattr(quality, "BLOCK", block)
        one, other = quality.fit(docs, labels), quality.fit(*twice)
        assert np.allclose(one.weights, w, rtol=0, atol=1e-8) and one.shift == pytest.approx(shift, abs=1e-7)
        assert np.array_equal(one.weights, other.weights) and one.shift == other.shift


def test_fit_on_all_rows(spark):
    """More labelled rows than any bound of a sample."""
    docs = spark.range(26000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sha2(F.col("id").cast("string"), 256), F.lit("green"), F.hex("id"), F.when(F.col("id") % 7 == 0, "stone!!")).alias("text"))
    labels = docs.select("doc_id", (F.xxhash64("doc_id") % 3 == 0).cast("int").alias("quality"))
    rows = docs.join(labels, "doc_id").filter(~labelled.held_out()).collect()
    assert len(rows) > 20500
    x, y = made([r.text for r in rows]), np.array([r.quality for r in rows])
    got, want = quality.fit(docs, labels), quality.fit_pairs(x, y)
    assert np.allclose(got.mean, x.mean(0)) and np.allclose(got.weights, want.weights, rtol=0, atol=1e-8)
    z = np.clip((x - x.mean(0)) / np.maximum(x.std(0), 1e-3), -6, 6)
    cut = np.quantile((z * got.weights).sum(1), (y == 0).mean())
    assert got.shift == pytest.approx(np.log(quality.THRESHOLD / (1 - quality.THRESHOLD)) - cut, abs=1e-9)


def test_scores_at_ranks():
    rng = np.random.default_rng(7)
    s = np.concatenate([rng.normal(size=500), [0.0, -0.0, 0.0], np.repeat(-0.25, 90), rng.normal(size=50) * 1e-300, [1e300, -1e300]])
    x = s[:, None]
    run = lambda f, add=np.add: quality._fold([(x, x)], f, add, 64)
    for at in (0, 1, 250, 300, 320, len(s) - 2):
        assert quality._at_ranks(run, lambda x: x[:, 0], [at, at + 1]) == np.sort(s)[at : at + 2].tolist()
