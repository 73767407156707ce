"""Unigram scores equal brute force, however few tokens of the model are sent to all tasks."""

import math
from collections import Counter

import pytest

from corpusloom.operators import evaluate

TEXTS = [(0, "a", "one two two three"), (1, "b", "Two, one!"), (2, "a", "rare words once"), (3, "b", ""), (4, "a", None), (5, "b", "one one one one two")]


@pytest.mark.parametrize("head", [0, 2, 1 << 17])
def test_scores(spark, monkeypatch, head):
    monkeypatch.setattr(evaluate, "HEAD", head)
    df = spark.createDataFrame(TEXTS, "doc_id long, g string, text string")
    words = {i: (t or "").lower().replace(",", "").replace("!", "").split() for i, _, t in TEXTS}
    f = Counter(w for ws in words.values() for w in ws)
    t = sum(f.values()) + len(f)
    want = {i: (-sum(math.log((f[w] + 1) / t) for w in ws), len(ws)) for i, ws in words.items() if ws}
    for of, keep in ((None, {0, 1, 2, 5}), (df.filter("doc_id IN (2, 3)"), {2})):
        got = {r.doc_id: (r.nll_sum, r.n_tokens) for r in evaluate.unigram_nll(df, "doc_id", "text", of=of).collect()}
        assert set(got) == keep and all(got[i] == pytest.approx(want[i]) for i in keep)
    per = {r.g: (r.n, r.ppl_base) for r in evaluate.unigram_perplexities(df, "text", "g").collect()}
    for g, ids in (("a", (0, 2)), ("b", (1, 5))):
        assert per[g] == (2, pytest.approx(math.exp(sum(want[i][0] for i in ids) / sum(want[i][1] for i in ids))))
