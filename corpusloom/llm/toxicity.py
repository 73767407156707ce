"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens are runs of letters, digits and non-ASCII bytes; a token's features are hashes of itself, of its first 3 to 6
bytes and of the tokens before and after it (A-Z as a-z). The chain has two states, clean and toxic, a weight for every
feature that two training documents or more have, toxic or not, and a weight per transition.

Labels come per document, so token labels are derived: in a document labelled toxic, a token is toxic if the token or one
of its beginnings is found in toxic training documents far more often than in the others; all other tokens are clean. On
these sequences the field is fitted by stochastic gradient ascent of its likelihood, in at least STEPS steps; for that,
and for nothing else, sequences are cut into segments of SEGMENT tokens, so the transition at a cut is not trained on.
Forward-backward marginals give each token's chance to be toxic; their maximum, sum and share go through a logistic
calibration to the document's score.

Scale: one pass without a shuffle over whole texts; forward and backward steps run side by side for all texts of a slice.
Fitting takes place on the driver and is bounded in rows and bytes: at most `rows` toxic documents (2 000) of SIZE bytes
together (8 MB), and four times as many clean ones of four times the bytes, in the order of a hash of their ids; a
document that is larger than the bound by itself is not taken.

Edge cases: null and empty texts have no tokens and get the score of a text without any toxic token; without labels of
both kinds nothing is learned and every score is below 0.5; of several labels of an id the greatest counts, of several
texts of an id the one of the least hash; other columns pass through, but for one named `toxicity`, which the result
replaces; an empty table gives no rows; spans are in code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import labelled, shingles
from corpusloom.llm.columns import named, others
from corpusloom.session import ship

U = np.uint64
ROWS = 2_000
CLEAN_TIMES = 4
PREFIXES = (3, 4, 5, 6)
OWN = 1 + len(PREFIXES)
FEATURES = OWN + 2
SIZE = 8_000_000
BITS = 22
RATIO = 10.0
SHARE = 0.008
SPAN_AT = 0.5
SEGMENT = 200
COUNTED = 0.1
STEPS = 60

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def tokens(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start bytes, end bytes, number of each text's first token, features: tokens x FEATURES) of a slice."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64), np.zeros((0, FEATURES), np.int32)
    word = _WORD[data]
    full = ends[1:] > ends[:-1]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    first[ends[:-1][full]] = word[ends[:-1][full]]
    last[ends[1:][full] - 1] = word[ends[1:][full] - 1]
    a, z = np.flatnonzero(first), np.flatnonzero(last) + 1
    low = shingles.LOWER[data]
    feats = np.empty((len(a), FEATURES), np.int32)
    words, at = shingles.hash_spans(low, a, z), np.searchsorted(a, ends)
    feats[:, 0] = words >> U(64 - BITS)
    for k, (near, missing) in enumerate(((np.roll(words, 1), at[:-1][at[1:] > at[:-1]]), (np.roll(words, -1), at[1:][at[1:] > at[:-1]] - 1))):
        near[missing] = 0
        feats[:, OWN + k] = shingles.mix(near + U(101 + k)) >> U(64 - BITS)
    block = shingles.eights(low)[a]
    for k, size in enumerate(PREFIXES):
        n = np.minimum(z - a, size)
        feats[:, k + 1] = shingles.mix(shingles.mix(block & shingles.HEAD[n]) + U(size)) >> U(64 - BITS)
    return a, z, at, feats


class Lattice:
    """Token sequences of several texts side by side: step t holds the t-th token of every text that has one."""

    def __init__(self, at: np.ndarray) -> None:
        sizes = np.diff(at)
        order = np.argsort(-sizes, kind="stable")
        self.longest = int(sizes.max(initial=0))
        self.width = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(self.longest), "right")
        begin = np.concatenate([[0], np.cumsum(self.width)])
        rank = np.empty(len(sizes), np.int64)
        rank[order] = np.arange(len(sizes))
        step = np.arange(at[-1] - at[0]) - np.repeat(at[:-1] - at[0], sizes)
        self.place = begin[step] + np.repeat(rank, sizes)  # of each token, in text order
        self.begin, self.last = begin, sizes

    def _messages(self, emit: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Emissions, forward and backward messages by step, as ratios toxic : clean, so one number a token is enough."""
        e = np.empty(len(emit))
        e[self.place] = np.exp(np.clip(emit, -30, 30))
        ahead, back = e.copy(), np.ones_like(e)
        for t in range(1, self.longest):
            a, b, w = self.begin[t], self.begin[t - 1], self.width[t]
            r = ahead[b : b + w]
            ahead[a : a + w] *= (m[0, 1] + m[1, 1] * r) / (m[0, 0] + m[1, 0] * r)
        for t in range(self.longest - 2, -1, -1):
            a, b, w = self.begin[t], self.begin[t + 1], self.width[t + 1]
            x = e[b : b + w] * back[b : b + w]
            back[a : a + w] = (m[1, 0] + m[1, 1] * x) / (m[0, 0] + m[0, 1] * x)
        return e, ahead, back

    def toxic(self, emit: np.ndarray, move: np.ndarray) -> np.ndarray:
        """P(toxic) of each token, in text order.

        emit: log odds of toxic per token; move: weights [[clean-clean, clean-toxic], [toxic-clean, toxic-toxic]].
        """
        _, ahead, back = self._messages(emit, np.exp(move))
        odds = ahead * back
        return (odds / (1 + odds))[self.place]

    def marginals(self, emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(toxic) of each token, P(toxic before and now), P(toxic before, clean now), in text order."""
        m = np.exp(move)
        e, ahead, back = self._messages(emit, m)
        odds = ahead * back
        stay, leave = np.zeros_like(e), np.zeros_like(e)
        for t in range(1, self.longest):
            a, b, w = self.begin[t], self.begin[t - 1], self.width[t]
            r, x = ahead[b : b + w], e[a : a + w] * back[a : a + w]
            total = m[0, 0] + m[1, 0] * r + x * (m[0, 1] + m[1, 1] * r)
            stay[a : a + w], leave[a : a + w] = m[1, 1] * r * x / total, m[1, 0] * r / total
        return (odds / (1 + odds))[self.place], stay[self.place], leave[self.place]


def summary(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per text: log odds of the most toxic token, log expected toxic tokens (of those that are likely enough to count, so
    that length alone adds nothing), their share, and one."""
    n = len(at) - 1
    most, total = np.zeros(n), np.zeros(n)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        most[full] = np.maximum.reduceat(p, at[full])
        total[full] = np.add.reduceat(np.where(p >= COUNTED, p, 0.0), at[full])
    most = np.clip(most, 1e-6, 1 - 1e-6)
    return np.stack([np.log(most / (1 - most)) / 5, np.log1p(total), 10 * total / np.maximum(np.diff(at), 1), np.ones(n)], 1)


@dataclass
class Model:
    """Feature weights (sparse), a bias, transitions and the calibration of document scores."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    move: np.ndarray
    document: np.ndarray

    def table(self) -> np.ndarray:
        full = np.zeros(1 << BITS, np.float32)
        full[self.index] = self.weight
        return full

    def read(self, table: np.ndarray, feats: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(P(toxic) of each token, score of each text)"""
        emit = table[feats].sum(1, dtype=np.float64) + self.bias
        p = Lattice(at).toxic(emit, self.move) if len(emit) else emit
        s = (summary(p, at) * self.document).sum(1)
        return p, 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def _frequencies(feats: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """In how many clean and toxic documents each feature is found."""
    found = np.zeros((2, 1 << BITS), np.float32)
    for f, label in zip(feats, y.tolist(), strict=True):
        found[label, np.unique(f)] += 1
    return found


def _token_labels(feats: list[np.ndarray], y: np.ndarray, found: np.ndarray) -> list[np.ndarray]:
    """Toxic tokens of toxic documents: those with a feature of their own of many toxic documents and few others."""
    n = np.maximum(np.bincount(y, minlength=2), 1)
    rate = (found + np.float32(0.25)) / n[:, None].astype(np.float32)
    telling = (found[1] >= max(4, SHARE * n[1])) & (rate[1] >= RATIO * rate[0])
    return [telling[f[:, :OWN]].any(1) if label else np.zeros(len(f), bool) for f, label in zip(feats, y.tolist(), strict=True)]


def fit_texts(texts: list[str], y: np.ndarray, epochs: int = 3, batch: int = 256, rate: float = 0.3) -> Model:
    """The field learned from texts and their labels (1 toxic)."""
    feats = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        feats.append(tokens(raw, np.array([0, len(raw)]))[3])
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), -5.0, np.zeros((2, 2)), np.array([1.0, 0.0, 0.0, -1.0]))
    found = _frequencies(feats, y)
    marks = _token_labels(feats, y, found)
    used = np.flatnonzero(found.sum(0) >= 2)
    del found
    small = np.full(1 << BITS, len(used), np.int32)  # features of a single document share one place, held at 0
    small[used] = np.arange(len(used))
    feats = [small[f] for f in feats]
    w, gw = np.zeros(len(used) + 1), np.full(len(used) + 1, 1e-6)
    bias, move, gb, gm = -3.0, np.zeros((2, 2)), 1e-6, np.full((2, 2), 1e-6)
    # Sequences are cut into segments for training only, so that a batch has as many steps as a segment has tokens.
    parts = [(f[k : k + SEGMENT], m[k : k + SEGMENT]) for f, m in zip(feats, marks, strict=True) for k in range(0, len(f), SEGMENT)]
    rng = np.random.default_rng(1)
    for _ in range(max(epochs, -(-STEPS * batch // max(len(parts), 1)))):
        order = rng.permutation(len(parts))
        for k in range(0, len(order), batch):
            part = [parts[i] for i in order[k : k + batch].tolist()]
            f, m = np.concatenate([x for x, _ in part]), np.concatenate([x for _, x in part]).astype(float)
            at = np.concatenate([[0], np.cumsum([len(x) for x, _ in part])])
            p, stay, leave = Lattice(at).marginals(w[f].sum(1) + bias, move)
            before = np.concatenate([[0.0], m[:-1]])
            before[at[:-1]] = 0
            head = np.zeros(len(m), bool)
            head[at[:-1]] = True
            seen = np.array([[0.0, ((1 - before) * m)[~head].sum()], [(before * (1 - m)).sum(), (before * m).sum()]])
            expect = np.array([[0.0, (p - stay)[~head].sum()], [leave.sum(), stay.sum()]])
            grad = np.bincount(f.ravel(), np.repeat(m - p, f.shape[1]), minlength=len(w)) - 1e-3 * w
            grad[-1] = 0
            gw += grad**2
            w += rate * grad / np.sqrt(gw)
            g = float((m - p).sum())
            gb += g * g
            bias += rate * g / gb**0.5
            gm += (seen - expect) ** 2
            move = np.clip(move + 0.1 * (seen - expect) / np.sqrt(gm), -4, 4)
    model = Model(used.astype(np.int64), w[:-1].astype(np.float32), bias, move, np.zeros(4))
    table = np.append(model.weight, np.float32(0))
    x = np.zeros((len(feats), 4))
    by_size = np.argsort([len(f) for f in feats], kind="stable")
    for k in range(0, len(by_size), 256):
        part = by_size[k : k + 256]
        at = np.concatenate([[0], np.cumsum([len(feats[i]) for i in part.tolist()])])
        emit = table[np.concatenate([feats[i] for i in part.tolist()])].sum(1, dtype=np.float64) + bias
        x[part] = summary(Lattice(at).toxic(emit, move) if len(emit) else emit, at)
    model.document = labelled.logistic(x, y.astype(float), ridge=1.0)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = ROWS, size: int = SIZE) -> Model:
    """The field learned from at most `rows` toxic documents of `size` bytes and four times as much of others, outside the
    held-out fifth."""
    texts, y = [], []
    for kind, times in ((1, 1), (0, CLEAN_TIMES)):
        some = labelled.sample(docs, labels, label, rows * times, kind).filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= size * times)
        left = size * times
        for r in some.orderBy("seat").select("text").toLocalIterator():
            left -= len((r.text or "").encode())
            if left < 0:
                break
            texts.append(r.text or "")
            y.append(kind)
    return fit_texts(texts, np.array(y, np.int64))


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or their columns `keep`) with a struct `toxicity` (score, spans: array of (start, end, chance))."""
    spark = docs.sparkSession
    ship(spark)
    cols = others(docs.columns if keep is None else keep, "toxicity")
    names = [f"c{i}" for i in range(len(cols))]
    flat = docs.select(named(text).alias("t"), *[named(c).alias(n) for c, n in zip(cols, names, strict=True)])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("chance", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            data, ends = shingles.string_buffers(batch.column(0))
            for i, j in shingles.chunks(ends, 4 * shingles.CHUNK):
                raw, stops = data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
                a, z, at, feats = tokens(raw, stops)
                p, s = model.read(table, feats, at)
                hits = np.flatnonzero(p >= SPAN_AT)
                owner = np.searchsorted(at, hits, "right") - 1
                spans: list[list] = [[] for _ in range(j - i)]
                points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                base = points[stops[owner]]
                for o, begin, end, c in zip(owner.tolist(), (points[a[hits]] - base).tolist(), (points[z[hits]] - base).tolist(), p[hits].tolist(), strict=True):
                    spans[o].append({"start": begin, "end": end, "chance": c})
                yield pa.RecordBatch.from_arrays([*(batch.column(k + 1).slice(i, j - i) for k in range(len(names))), pa.array(s), pa.array(spans, span)], names=[*names, "s", "spans"])

    kinds = "".join(f"{n} {f.dataType.simpleString()}, " for n, f in zip(names, flat.schema.fields[1:], strict=True))
    out = flat.mapInArrow(run, f"{kinds}s double, spans array<struct<start:long,end:long,chance:double>>")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, cols, strict=True)], F.struct(F.col("s").alias("score"), "spans").alias("toxicity"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model, keep=["doc_id"]).withColumn("score", F.col("toxicity.score"))
    spans = F.array_join(F.transform("toxicity.spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", labelled.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), spans.alias("spans"))
