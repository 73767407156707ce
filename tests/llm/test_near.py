"""Near-duplicates of vectors and documents against brute force, components, shingles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import lattice, minhash
from corpusloom.llm.components import components
from tests.llm.test_codecs import thue_morse


def reach(nodes, links):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 40)] + [(5, 5)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    want = reach({x for l in links for x in l}, links)
    ends = {x for a, b in links if a != b for x in (a, b)}
    assert got == {n: c for n, c in want.items() if n in ends}
    assert components(df.limit(0)).count() == 0


def shingled(text, width):
    w = [x.lower() for x in (text or "").encode().split()]
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_documents(spark, width, percent):
    rng = random.Random(width)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([8, 60, 150]))]
        for _ in range(8):
            edited = list(words)
            for _ in range(rng.randrange(4)):
                edited[rng.randrange(len(edited))] = f"x{rng.randrange(99)}"
            texts.append(" ".join(edited))
    texts += ["Short", "short", "two words", None, "", "  ", "TWO\twords"]
    df = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    sets = {i * 3: shingled(t, width) for i, t in enumerate(texts)}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = reach(sets, links)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, width=width, percent=percent).collect()}
    assert got == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 300)  # many blocks
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 3)
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words[:k] + ["edit"] + words[k + 1 :]) for k in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(df, width=3, percent=85).collect()} == {0}


def test_documents_odd(odd_docs, no_docs):
    rows = minhash.near_duplicates(odd_docs)
    assert rows.count() == 11
    got = {(r.doc_id, r.component_id, r.kept) for r in rows.collect()}
    assert {(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (5, 5, True), (None, None, True), (7, 7, True), (8, 7, False)} <= got
    kept = minhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "6", "7", "9", "None"]
    assert minhash.near_duplicates(no_docs).count() == 0 and minhash.keep_one(no_docs).count() == 0


def brute(rows, width, percent):
    """(doc_id, text, component_id, kept) by all pairs; nodes are distinct sets, ids name them only."""
    sets = [shingled(t, width) for _, t in rows]
    nodes = [(s, k if not s else None) for k, s in enumerate(sets)]  # a text without shingles is a node of its own
    first = {}
    for k, n in enumerate(nodes):
        first.setdefault(n, k)
    own = [first[n] for n in nodes]
    links = [(a, b) for a in set(own) for b in set(own) if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    top = reach(set(own), links)
    least = {}
    for k, (i, _) in enumerate(rows):
        c = top[own[k]]
        least[c] = min(least.get(c, (True, 0)), (i is None, i or 0))
    return [(i, t, None if least[top[own[k]]][0] else least[top[own[k]]][1]) for k, (i, t) in enumerate(rows)]


def test_repeated_and_missing_ids(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(900)}"
    base = [[word() for _ in range(60)] for _ in range(6)]
    edit = lambda w: [*w[:20], "edit", *w[21:]]
    rows = [(5, base[0]), (9, edit(base[0])), (9, base[1]), (None, [*base[0][:-1], "end"]), (None, base[2]), (9, base[1]), (9, base[3]), (2, edit(base[3])), (None, base[4]), (None, base[4]), (None, edit(base[4])), (0, base[5]), (0, edit(base[5])), (0, [])]
    rows = [(i, " ".join(w)) for i, w in rows] + [(None, None), (None, ""), (None, ""), (3, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows, 5, 80)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted(((i, len(shingled(t, 5)), c) for i, t, c in want), key=str)
    kept = [(r.doc_id, r.text) for r in minhash.keep_one(df).collect()]
    texts = dict(enumerate(" ".join(b) for b in base))
    assert {(5, texts[0]), (9, texts[1]), (None, texts[2])} <= set(kept) and len(kept) == len(set(kept))
    # one document of each group of texts, all texts without shingles
    groups = {}
    for i, t, c in want:
        if shingled(t, 5):
            key = next(k for k, w in enumerate(base) if len(shingled(t, 5) & shingled(" ".join(w), 5)) > 30)
            groups.setdefault(key, set()).add((i, t))
    for members in groups.values():
        assert len(members & set(kept)) == 1
    assert {k for k in kept if not shingled(k[1], 5)} == {(0, ""), (None, None), (None, ""), (3, " ")}


def test_words_of_one_polynomial_hash(spark):
    for n in (1024, 8192):
        a, b = thue_morse(n)
        df = spark.createDataFrame([(1, f"{a} {a} x"), (2, f"{b} {b} x")], "doc_id long, text string")
        assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(df, width=3, percent=85).collect()} == {(1, 1), (2, 2)}


def test_chained_buckets(spark):
    """Texts linked in chains and in groups of several labels, with small blocks."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(60):  # each differs from the next by a word or two, ends differ a lot
        words = list(words)
        words[rng.randrange(120)] = f"e{k}"
        rows.append((100 - k, " ".join(words)))
    want = {i: c for i, _, c in brute(rows, 3, 85)}
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()}
    assert got == want


def test_signatures_estimate():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    b = np.concatenate([a[:1800], rng.integers(0, 2**63, 200, dtype=np.uint64)])
    s = minhash.signatures([a, b], 2000)
    assert (s[0] == s[1]).mean() == pytest.approx(1800 / 2200, abs=0.03)


def test_lattice_points():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)) * 2
    p = lattice.nearest(x)
    whole = np.abs(p - np.rint(p)).max(1) == 0
    assert (np.abs(2 * p - np.rint(2 * p)) == 0).all() and (p[whole].sum(1) % 2 == 0).all() and ((p[~whole] - 0.5) == np.rint(p[~whole] - 0.5)).all()
    assert (p[~whole].sum(1) % 2 == 0).all()
    around = p[:, None] + lattice.MINIMAL[None]
    assert (((x[:, None] - around) ** 2).sum(2).min(1) >= ((x - p) ** 2).sum(1) - 1e-12).all()
    assert len({tuple(m) for m in lattice.MINIMAL.tolist()}) == 240 and np.allclose((lattice.MINIMAL**2).sum(1), 2)


@pytest.mark.parametrize("shape", [None, lattice.RUNGS[3][1]])
def test_vectors(spark, shape):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 64))
    rows = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0, 0.1, 0.25, 0.33)] + [base[:1] + rng.normal(size=(150, 64)) * 0.2]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int").repartition(4)
    x = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1)[:, None]
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    want = reach(range(len(rows)), [(int(a), int(b)) for a, b in zip(*np.nonzero(linked), strict=True) if a < b])
    got = {r.vec_id: r for r in lattice.near_vectors(df, shape=shape).collect()}
    found = sum(r.n_links for r in got.values())
    assert all(r.n_links <= linked[i].sum() for i, r in got.items())  # nothing below the threshold, nothing twice
    assert found >= 0.995 * linked.sum()
    assert np.mean([got[i].component_id == want[i] for i in want]) > 0.98


@pytest.mark.parametrize("rung", range(5))
def test_recall_at_the_threshold(rung):
    share, shape = lattice.RUNGS[rung]
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    n = rng.normal(size=x.shape)
    n -= (n * x).sum(1)[:, None] * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * n / np.linalg.norm(n, axis=1)[:, None]
    a, b = lattice.cell_keys(x, **shape), lattice.cell_keys(y, **shape)
    assert np.mean([bool(set(p) & set(q)) for p, q in zip(a.tolist(), b.tolist(), strict=True)]) > 0.998
    near = sum(np.bitwise_count(s.view(np.uint64) ^ t.view(np.uint64)).astype(int) for s, t in zip(lattice.signs(x).T, lattice.signs(y).T, strict=True))
    assert np.quantile(near, 0.5) < 22 and near.max() < 40
    # pairs of random vectors meet as rarely as the rung says
    met = sum((c * (c - 1) / 2).sum() for c in [np.unique(np.concatenate([np.unique(k) for k in a]), return_counts=True)[1]])
    assert met / (2000 * 1999 / 2) < 1.5 * share + 1e-5


def test_comparisons_a_vector_stay_bounded():
    for n in (1000, 10_000, 50_000, 10**6, 10**8):
        shape = lattice.plan(n)
        assert n * next(s for s, r in lattice.RUNGS if r is shape) <= lattice.COMPARED * (1.2 if n == 10**8 else 1)


def test_vectors_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0, None]), (8, [nan, 1.0]), (9, [inf, 1.0]), (None, [0.0, 1e300]), (None, [0.0, 1.0]), (10, [-1.0, 0.0]), (11, [1e-300, 0.0])]
    df = spark.createDataFrame([(*r, i, i) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, id int, vec int")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in lattice.near_vectors(df).collect())
    alone = [(str(i), 0, str(i), True) for i in (3, 4, 5, 6, 7, 8, 9, 10)]
    assert got == sorted([*alone, ("1", 3, "1", True), ("2", 3, "1", False), ("2", 3, "1", False), ("11", 3, "1", False), ("None", 1, "None", False), ("None", 1, "None", True)])
    # rows that share an id, or have none, are linked by their vectors only
    same = spark.createDataFrame([(7, [1.0, 0.1]), (7, [0.0, 1.0]), (None, [-1.0, 0.0]), (None, [0.01, 1.0]), (None, [0.0, -1.0])], "vec_id long, embedding array<double>")
    assert sorted(map(str, lattice.near_vectors(same).select("vec_id", "n_links", "component_id").collect())) == sorted(
        map(str, spark.createDataFrame([(7, 0, 7), (7, 1, 7), (None, 0, None), (None, 1, 7), (None, 0, None)], "vec_id long, n_links long, component_id long").collect())
    )
    assert lattice.near_vectors(df.limit(0)).count() == 0
    hot = spark.range(500).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    assert {(r.n_links, r.component_id) for r in lattice.near_vectors(hot).collect()} == {(499, 0)}
