"""Quality scores by Bradley-Terry ranking: preference pairs, a logistic loss on feature differences, a quantile cut.

Every pair (better, worse) of labelled documents says that the first is preferred; the model P(i over j) =
sigmoid(s_i - s_j), s = w . features, is fitted by Newton's method on all pairs of all labelled documents. The cut is the
quantile of the training scores at the share of worse documents; scores are shifted so that it becomes `threshold` and
squashed to 0..1.

Features see the text alone: shares of character kinds, word and line lengths, repetition of words and lines.

Scale: nothing is sampled. Fitting makes the features, some 20 numbers a document, of all texts outside the held-out
fifth, joins them to the labels by id and keeps those of labelled documents in a checkpoint, in blocks by a hash of the
id and in its order. Then it passes over the blocks, twice for a Newton step; each block gives sums of bounded size, and
the driver adds them in the order of the blocks, so that a fit of the same rows is the same to the bit. Sums over all
pairs need no pairs: the logistic function of s_i - s_j is interpolated in both scores at Chebyshev nodes, as many as
bring the error near that of doubles, so that a pair's part depends on sums by node of the better and of the worse ones.
The quantile is exact: the scores' bits are counted from the highest down.

Edge cases: null, empty and blank texts have all-zero features and a score like any other; without labels of both kinds
nothing is learned and every score is 0.5; of several labels of an id the greatest counts, of several texts of an id the
one of the least hash; other columns pass through, but for one named
`quality_score`, which the result replaces; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.polynomial import chebyshev
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import labelled, shingles
from corpusloom.llm.columns import named, others
from corpusloom.session import cut, ship

THRESHOLD = 0.3
#: Penalty of half the squared weights, against the mean loss of a pair.
RIDGE = 1 / 3000
#: Labelled rows of a block, and blocks at most; beyond that they grow and are read in batches.
BLOCK, BLOCKS = 8192, 256
#: Interpolation leaves out what is below exp(-DIGITS).
DIGITS = 32
#: Bits that passes of the quantile have yet to see, from the highest down.
_BITS = (64, 53, 42, 31, 20, 9, 0)
_KINDS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",", b"!", b"?", b"|", b"$%#&*", b"<>{}[]\\^~=+@_/", b"'\"()-:;", b"\n", b" \t\r")
N_FEATURES = len(_KINDS) + 12


def features(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Features (texts x N_FEATURES) of the texts in `data`, ending at `ends`."""
    ends = ends - ends[0]
    words, at = shingles.hash_words(data, ends)
    out = np.zeros((len(ends) - 1, N_FEATURES))
    table = [np.frombuffer(k, np.uint8) for k in _KINDS]
    for i, (a, z, p, q) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if q == p:
            continue
        own, text = words[p:q], data[a:z]
        count = np.bincount(text, minlength=256)
        n, m = z - a, q - p
        shares = [count[k].sum() / n for k in table]
        lines = [x for x in text.tobytes().split(b"\n") if x.strip()]
        same = float((own[1:] == own[:-1]).sum()) / m
        distinct = len(np.unique(own))
        out[i] = [
            *(np.log1p(50 * s) for s in shares),
            np.log1p(50 * count[128:].sum() / n),
            np.log1p(n),
            np.log1p(m),
            n / m,
            np.log1p(50 * same),
            distinct / m,
            np.log1p(distinct) / np.log1p(m),
            len(set(lines)) / max(len(lines), 1),
            np.log1p(m / max(len(lines), 1)),
            np.log1p(50 * count[list(b"!|$%#&*")].sum() / m),
            np.log1p(50 * float(np.bincount(np.unique(own, return_inverse=True)[1]).max()) / m),
            1.0 if m < 5 else 0.0,
        ]
    return out


@dataclass
class Model:
    """score = sigmoid(weights . ((features - mean) / scale) + shift)"""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        # summed by rows, so that a score does not depend on the batch that its text came in
        return 1 / (1 + np.exp(-np.clip((z * self.weights).sum(1) + self.shift, -30, 30)))


#: run(f, add): f(features, labels) of all rows, piece by piece, put together by `add` and flat; None without rows.
Run = Callable[..., np.ndarray | None]


def _fold(pieces: Iterable[tuple[np.ndarray, np.ndarray]], f: Callable, add: np.ufunc, size: int = 2048) -> np.ndarray | None:
    total = None
    for x, y in pieces:
        for i in range(0, len(y), size):
            one = np.asarray(f(x[i : i + size], y[i : i + size]), float).ravel()
            total = one if total is None else add(total, one)
    return total


def _over(rows: DataFrame) -> Run:
    """A Run over the partitions of a checkpoint (x, y), whose sums are added in the order of the partitions."""

    def run(f: Callable, add: np.ufunc = np.add) -> np.ndarray | None:
        def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces = ((b.column(0).flatten().to_numpy().reshape(-1, N_FEATURES), b.column(1).to_numpy()) for b in batches)
            total = _fold(pieces, f, add)
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()])], names=["block", "total"])

        got = sorted(rows.mapInArrow(block, "block int, total binary").collect(), key=lambda r: r.block)
        total = None
        for r in got:
            one = np.frombuffer(r.total)
            total = one if total is None else add(total, one)
        return total

    return run


def _ordered(s: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers in the same order."""
    b = (s + 0.0).view(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(b >= top, ~b, b | top)


def _at_ranks(run: Run, scores: Callable, ranks: list[int]) -> list[float]:
    """The scores at these ranks, from 0, of all rows in ascending order."""
    found, left = [0] * len(ranks), list(ranks)
    for high, low in zip(_BITS, _BITS[1:], strict=False):
        wide = 1 << (high - low)
        base = [np.uint64(f * wide) for f in found]

        def counts(x: np.ndarray, _: np.ndarray, low: int = low, wide: int = wide, base: list = base) -> list[np.ndarray]:
            key = _ordered(scores(x)) >> np.uint64(low)
            past = [key - b for b in base]
            return [np.bincount(d[d < wide].astype(np.int64), minlength=wide) for d in past]

        for k, n in enumerate(run(counts).reshape(len(ranks), wide).cumsum(1)):
            digit = int(np.searchsorted(n, left[k], "right"))
            left[k] -= int(n[digit - 1]) if digit else 0
            found[k] = found[k] * wide + digit
    keys = np.array(found, np.uint64)
    top = np.uint64(1 << 63)
    return np.where(keys >= top, keys ^ top, ~keys).view(float).tolist()


def _all_pairs(run: Run, unit: Callable) -> np.ndarray:
    """Weights that minimise the mean logistic loss of all pairs of a better and a worse row, by Newton's method."""
    low, high = run(lambda x, _: [-unit(x).min(0), unit(x).max(0)], np.maximum).reshape(2, -1) * [[-1], [1]]
    w, last, step, best = np.zeros(len(low)), np.zeros(len(low)), np.zeros(len(low)), np.inf
    for _ in range(50):
        # all scores lie within `half` of `mid`; the logistic function's poles are pi away from the line
        ends = np.minimum(w * low, w * high).sum(), np.maximum(w * low, w * high).sum()
        mid, half = sum(ends) / 2, max((ends[1] - ends[0]) / 2, 1.0)
        k = int(np.ceil(DIGITS / np.arcsinh(np.pi / half)))
        nodes = np.cos(np.pi * (np.arange(k) + 0.5) / k)
        basis = chebyshev.chebvander(nodes, k - 1) * 2 / k
        basis[:, 0] /= 2

        def place(z: np.ndarray, w: np.ndarray = w, mid: float = mid, half: float = half) -> np.ndarray:
            return np.clip(((z * w).sum(1) - mid) / half, -1, 1)

        def sums(x: np.ndarray, y: np.ndarray, place: Callable = place, k: int = k) -> list[np.ndarray]:
            z = unit(x)
            powers, one = chebyshev.chebvander(place(z), k - 1), np.column_stack([np.ones(len(z)), z])
            return [powers[y == c].T @ one[y == c] for c in (0, 1)]

        bad, good = basis @ run(sums).reshape(2, k, -1)
        pairs = bad[:, 0].sum() * good[:, 0].sum()
        d = half * (nodes - nodes[:, None])
        loss = good[:, 0] @ np.logaddexp(0, d) @ bad[:, 0] / pairs + RIDGE / 2 * w @ w
        if loss > best + 1e-9:
            step = step / 2
            w = last + step
            continue
        p = 1 / (1 + np.exp(-d))
        q = p * (1 - p)
        grad = (bad[:, 1:].T @ (good[:, 0] @ p) - good[:, 1:].T @ (p @ bad[:, 0])) / pairs + RIDGE * w
        of_bad, of_good = basis.T @ (good[:, 0] @ q), basis.T @ (q @ bad[:, 0])

        def squares(x: np.ndarray, y: np.ndarray, place: Callable = place, of_bad: np.ndarray = of_bad, of_good: np.ndarray = of_good) -> np.ndarray:
            z = unit(x)
            t = place(z)
            return (z * np.where(y == 1, chebyshev.chebval(t, of_good), chebyshev.chebval(t, of_bad))[:, None]).T @ z

        cross = good[:, 1:].T @ q @ bad[:, 1:]
        hess = (run(squares).reshape(cross.shape) - cross - cross.T) / pairs + RIDGE * np.eye(len(w))
        last, best, step = w, loss, -np.linalg.solve(hess, grad)
        w = last + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _learn(run: Run, threshold: float, weights: Callable = _all_pairs) -> Model:
    first = run(lambda x, y: [len(y), (y == 1).sum(), *x.sum(0)])
    if first is None or not 0 < first[1] < first[0]:
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0)
    n, mean = int(first[0]), first[2:] / first[0]
    scale = np.maximum(np.sqrt(run(lambda x, _: ((x - mean) ** 2).sum(0)) / n), 1e-3)

    def unit(x: np.ndarray) -> np.ndarray:
        return np.clip((x - mean) / scale, -6, 6)

    w = weights(run, unit)
    at = (n - 1) * (1 - first[1] / n)
    low, high = _at_ranks(run, lambda x: (unit(x) * w).sum(1), [int(at), min(int(at) + 1, n - 1)])
    return Model(mean, scale, w, float(np.log(threshold / (1 - threshold)) - low - (high - low) * (at - int(at))))


def fit_pairs(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD, pairs: int | None = None) -> Model:
    """The ranking learned from labelled features (y: 1 better, 0 worse), on all pairs; on `pairs` drawn ones if given."""

    def drawn(_: Run, unit: Callable) -> np.ndarray:
        z, rng = unit(x), np.random.default_rng(1952)
        i, j = rng.choice(np.flatnonzero(y == 1), pairs), rng.choice(np.flatnonzero(y == 0), pairs)
        return labelled.logistic(z[i] - z[j], np.ones(pairs), ridge=20.0)

    return _learn(lambda f, add=np.add: _fold([(x, y)], f, add), threshold, drawn if pairs else _all_pairs)


def _featurizer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, ends = shingles.string_buffers(batch.column(0))
        for i, j in shingles.chunks(ends):
            x = features(data[ends[i] : ends[j]], ends[i : j + 1])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * N_FEATURES, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([flat, *(batch.column(k).slice(i, j - i) for k in (1, 2))], names=["x", "h", "doc_id"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> Model:
    """The model learned from all labelled documents outside the held-out fifth."""
    ship(docs.sparkSession)
    known = labelled.known(labels, label)
    # features go through the shuffle, not texts
    texts = docs.select("text", F.xxhash64("text").alias("h"), "doc_id").filter(F.col("doc_id").isNotNull() & ~labelled.held_out())
    made = texts.mapInArrow(_featurizer, f"x array<double>, h long, doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    one = made.groupBy("doc_id").agg(F.min(F.struct("h", "x")).alias("t"))
    blocks = min(BLOCKS, known.count() // BLOCK + 1)
    rows = one.join(known, "doc_id").repartition(blocks, "doc_id").sortWithinPartitions("doc_id").select("t.x", "y")
    return _learn(_over(cut(rows)), threshold)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or their columns `keep`) with a column `quality_score`, 0 to 1."""
    ship(docs.sparkSession)
    cols = others(docs.columns if keep is None else keep, "quality_score")
    names = [f"c{i}" for i in range(len(cols))]
    flat = docs.select(named(text).alias("t"), *[named(c).alias(n) for c, n in zip(cols, names, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = shingles.string_buffers(batch.column(0))
            for i, j in shingles.chunks(ends):
                s = model.scores(features(data[ends[i] : ends[j]], ends[i : j + 1]))
                yield pa.RecordBatch.from_arrays([*(batch.column(k + 1).slice(i, j - i) for k in range(len(names))), pa.array(s)], names=[*names, "s"])

    kinds = "".join(f"{n} {f.dataType.simpleString()}, " for n, f in zip(names, flat.schema.fields[1:], strict=True))
    out = flat.mapInArrow(run, f"{kinds}s double")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, cols, strict=True)], F.col("s").alias("quality_score"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model, keep=["doc_id"])
    return out.select("doc_id", labelled.held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
