"""Near-duplicate vectors: random projections decoded to E8 lattice points, neighbouring cells probed, cosines verified.

In each of `tables` tables a unit vector is projected to `wide` times 8 dimensions, scaled, and each eight decoded to
their nearest point of the E8 lattice; that cell and the `probes` cells nearest to the projection among the 240 around
each of its parts are the vector's buckets. Vectors that share a bucket are compared: a sketch of 128 signs lets a pair
through unless it lies 4.5 standard deviations over the angle of the threshold, and cosines in double precision decide.

Cells get smaller as the table grows: `plan` takes the first rung of RUNGS whose expected number of chance comparisons a
vector is at most COMPARED, so work a vector grows with the number of keys (as about the square root of the rows), not
with the rows. On every rung a pair at cosine 0.9 shares no bucket with a chance of 1e-4 (simulated; tests measure it).

Every pair is counted once though it may meet in many buckets: only in the one with the smallest key that the two share.
Buckets never give out pairs: a unit of work (a pair of blocks of a bucket, at most 2 x BLOCK vectors) gives the members
that need their vectors, then a count per vector and a spanning forest of its links. Equal vectors are one class with a
multiplicity, and a number of its own, before anything is bucketed.

Scale: buckets shuffle as (key, class, sketch), and only buckets of several classes; vectors follow to those units where
they have a partner by their sketch; a hot bucket is dealt in block pairs. A bucket whose members are all alike costs the
square of their number in comparisons, as each has to be counted.

Edge cases: a vector that is null, empty or zero, or holds a null, NaN or infinite component, has no links and is its own
component; vectors of different lengths never link; each row is a vector, so repeated rows are linked to each other;
rows that share a vec_id, or have none, are linked by their vectors only; component_id is the least vec_id of the
component, null if it has none; other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import blocks
from corpusloom.llm.components import components
from corpusloom.llm.shingles import mix
from corpusloom.session import cut, ship

U = np.uint64
#: Chance comparisons a vector; for each rung the share of random pairs that meet, and the shape of its keys.
COMPARED = 1500
RUNGS = [
    (1.1e-1, {"wide": 1, "scale": 1.5, "probes": 8, "tables": 3}),
    (2.6e-2, {"wide": 2, "scale": 2.2, "probes": 8, "tables": 7}),
    (3.4e-3, {"wide": 2, "scale": 1.8, "probes": 8, "tables": 13}),
    (6.0e-4, {"wide": 2, "scale": 1.5, "probes": 8, "tables": 24}),
    (6.3e-5, {"wide": 3, "scale": 1.8, "probes": 16, "tables": 28}),
    (1.7e-5, {"wide": 3, "scale": 1.6, "probes": 24, "tables": 38}),
    (1.9e-6, {"wide": 4, "scale": 1.8, "probes": 24, "tables": 69}),
]
SIGNS = 128
BLOCK = 512
KNOWN = 20_000


def plan(n: int) -> dict:
    """The keys for n vectors: the first rung with at most COMPARED chance comparisons a vector, else the last."""
    return next((shape for share, shape in RUNGS if n * share <= COMPARED), RUNGS[-1][1])


def _minimal() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    whole = np.zeros((112, 8))
    pairs = itertools.product(itertools.combinations(range(8), 2), itertools.product((1, -1), repeat=2))
    for row, ((i, j), (s, t)) in zip(whole, pairs, strict=True):
        row[i], row[j] = s, t
    halves = [h for h in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in h) % 2 == 0]
    return np.concatenate([whole, np.array(halves)])


MINIMAL = _minimal()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and where the sum is odd turn the least certain entry."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1) % 2)
    k = np.abs(off[odd]).argmax(1)
    near[odd, k] += np.where(off[odd, k] >= 0, 1, -1)
    return near


def nearest(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: E8 is D8 and D8 shifted by one half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(closer[:, None], a, b)


def _cells(points: np.ndarray, part: np.ndarray) -> np.ndarray:
    turn = np.random.default_rng(8).integers(0, 2**63, 8, dtype=np.uint64) * U(2) + U(1)
    key = part.astype(U)
    for k in range(8):
        key = mix(key + (2 * points[..., k]).astype(np.int64).view(U) * turn[k])
    return key


@functools.lru_cache(maxsize=8)
def _planes(dim: int, wide: int, tables: int) -> np.ndarray:
    """The projections of all tables and parts side by side."""
    return np.concatenate([np.random.default_rng((t, part, dim)).normal(size=(dim, 8)) for t in range(tables) for part in range(wide)], 1)


def cell_keys(unit: np.ndarray, wide: int, scale: float, probes: int, tables: int) -> np.ndarray:
    """Keys (vectors x tables * (1 + probes)) of the home cell and of the probed ones, which differ from it in one part.

    All tables at once, for so many vectors at a time that their reach stays under 32 MB.
    """
    n, dim = unit.shape
    step = max(1, 16384 // (tables * wide))
    if n > step:
        return np.concatenate([cell_keys(unit[at : at + step], wide, scale, probes, tables) for at in range(0, n, step)])
    x = (unit @ _planes(dim, wide, tables)).reshape(-1, 8) / scale
    home = nearest(x)
    mixed = mix(_cells(home, np.tile(np.arange(wide), n * tables))).reshape(-1, wide)
    whole = np.tile(np.arange(tables) * 1000003 + dim, n).astype(U) + mixed.sum(1)  # a sum, so that a probe changes its part's share alone
    reach = ((x - home) @ MINIMAL.T).reshape(n * tables, -1)
    by = np.argpartition(-reach, probes, axis=1)[:, :probes]
    row, part = np.arange(n * tables)[:, None], by // 240
    moved = home.reshape(-1, wide, 8)[row, part] + MINIMAL[by % 240]
    probed = whole[:, None] - mixed[row, part] + mix(_cells(moved, part))
    return mix(np.concatenate([whole[:, None], probed], 1).reshape(n, -1))


def signs(unit: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers a vector: on which side of SIGNS random planes it lies."""
    side = unit @ np.random.default_rng((99, unit.shape[1])).normal(size=(unit.shape[1], SIGNS)) > 0
    return np.packbits(side, axis=1).view("<i8")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _encoder(kind: str):
    """(id, vec): the bytes of each proper vector, null for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            made: list = [None] * len(vectors)
            sizes = np.array(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            for dim in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == dim)
                flat = vectors.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(float("nan"))
                x = flat.to_numpy(zero_copy_only=False).reshape(len(rows), dim)
                good = np.isfinite(x).all(1) & (x != 0).any(1)
                for r, v in zip(rows[good].tolist(), x[good].astype(kind), strict=True):
                    made[r] = v.tobytes()
            yield pa.RecordBatch.from_arrays([ids, pa.array(made, pa.binary())], names=["id", "vec"])

    return run


def _keyer(kind: str, shape: dict):
    """(node, s0, s1, keys) of the classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                nodes, vecs = batch.column(0).slice(at, 2048), batch.column(1).slice(at, 2048).to_pylist()
                sizes = np.array([len(v) for v in vecs])
                for size in np.unique(sizes).tolist():
                    rows = np.flatnonzero(sizes == size)
                    x = _unit(np.frombuffer(b"".join(vecs[r] for r in rows.tolist()), kind).reshape(len(rows), -1))
                    s, keys = signs(x), cell_keys(x, **shape).view(np.int64)
                    keys = [np.unique(k) for k in keys]
                    ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
                    yield pa.RecordBatch.from_arrays([nodes.take(pa.array(rows)), pa.array(s[:, 0]), pa.array(s[:, 1]), lists], names=["node", "s0", "s1", "keys"])

    return run


def _sifter(least: float):
    """The rows (key, lo, hi, block, node) of units in which they have a partner by their signs.

    Batches are sorted by unit. Row i is set against row i + d for d = 1, 2, ... as long as units reach, all rows at once.
    """
    share = np.arccos(min(max(least, -1.0), 1.0)) / np.pi
    most = SIGNS * share + 4.5 * np.sqrt(SIGNS * share * (1 - share)) + 1
    names = ["key", "lo", "hi", "block", "node", "s0", "s1"]

    def sift(rows: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        n = len(rows["key"])
        new = np.ones(n, bool)
        new[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["lo"][1:] != rows["lo"][:-1]) | (rows["hi"][1:] != rows["hi"][:-1])
        starts = np.flatnonzero(new)
        left = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n))) - np.arange(n)  # rows of the unit from here on
        s0, s1, crossed, side = rows["s0"].view(U), rows["s1"].view(U), rows["lo"] != rows["hi"], rows["block"]
        hit = np.zeros(n, bool)
        live, d = np.flatnonzero(left > 1), 1
        while len(live):
            close = np.bitwise_count(s0[live] ^ s0[live + d]) + np.bitwise_count(s1[live] ^ s1[live + d]) <= most
            near = live[close & (~crossed[live] | (side[live] != side[live + d]))]
            hit[near] = hit[near + d] = True
            d += 1
            live = live[left[live] > d]
        some = np.flatnonzero(hit)
        return pa.RecordBatch.from_arrays([pa.array(rows[c][some]) for c in names[:5]], names=names[:5]) if len(some) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            own = {c: batch.column(batch.schema.get_field_index(c)).to_numpy() for c in names}
            rows = {c: np.concatenate([held[c], own[c]]) for c in names} if held else own
            if not len(rows["key"]):
                continue
            # the last unit may go on in the next batch
            same = (rows["key"] == rows["key"][-1]) & (rows["lo"] == rows["lo"][-1]) & (rows["hi"] == rows["hi"][-1])
            cut_at = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            held = {c: rows[c][cut_at:].copy() for c in names}
            if cut_at and (made := sift({c: rows[c][:cut_at] for c in names})) is not None:
                yield made
        if held and (made := sift(held)) is not None:
            yield made

    return run


def _compare(kind: str, least: float, shape: dict):
    known: dict[int, np.ndarray] = {}  # keys of vectors that the task has seen; emptied when full

    def work(unit: pa.Table) -> pa.RecordBatch | None:
        n = unit.num_rows
        if n < 2:
            return None
        vecs = unit.column("vec").to_pylist()
        if len({len(v) for v in vecs}) > 1:  # keys of different lengths of vectors fell together
            return None
        x = _unit(np.frombuffer(b"".join(vecs), kind).reshape(n, -1))
        side = unit.column("block").to_numpy()
        linked = x @ x.T >= least
        linked &= side[:, None] != side[None, :] if unit.column("lo")[0] != unit.column("hi")[0] else True
        np.fill_diagonal(linked, False)
        some = np.flatnonzero(linked.any(1))
        if not len(some):
            return None
        linked = linked[np.ix_(some, some)]
        node = unit.column("node").to_numpy()[some]
        if len(known) > KNOWN:
            known.clear()
        new = [k for k, v in enumerate(node.tolist()) if v not in known]
        if new:
            made = np.sort(cell_keys(x[some[new]], **shape).view(np.int64), 1)
            made[:, 1:][made[:, 1:] == made[:, :-1]] = np.iinfo(np.int64).max  # repeated keys of a vector count once
            known.update(zip(node[new].tolist(), made, strict=True))
        keys = np.stack([known[v] for v in node.tolist()])
        here = unit.column("key")[0].as_py()
        value, number, count = np.unique(keys, return_inverse=True, return_counts=True)
        lower = np.flatnonzero((value < here) & (count > 1))
        for at in range(0, len(lower), 4096):  # pairs that share a smaller key are counted there
            part = lower[at : at + 4096]
            place = np.full(len(value), -1)
            place[part] = np.arange(len(part))
            has = np.zeros((len(some), len(part)), np.float32)
            r, c = np.nonzero(place[number.reshape(keys.shape)] >= 0)
            has[r, place[number.reshape(keys.shape)[r, c]]] = 1
            linked &= has @ has.T == 0
        mult = unit.column("mult").to_numpy()[some]
        many = linked @ mult.astype(np.float64)
        root = np.arange(len(some))
        extra: list[tuple[int, int]] = []
        for i in np.flatnonzero(many).tolist():
            for j in np.flatnonzero(linked[i] & (root != root[i])).tolist():
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    extra.append((int(node[i]), int(node[j])))
        hit = np.flatnonzero(many)
        a, b = zip(*extra, strict=True) if extra else ((), ())
        none = [None] * len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array([*node[hit].tolist(), *a], pa.int64()), pa.array([*many[hit].astype(np.int64).tolist(), *none], pa.int64()), pa.array([*[None] * len(hit), *b], pa.int64())],
            names=["node", "links", "tied"],
        )

    return work


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.9, shape: dict | None = None) -> DataFrame:
    """A row per vector: vec_id, n_links (others at cosine >= `least`), component_id, kept (it represents its component).

    `shape` has the keys of a rung of RUNGS; without it, the number of different vectors decides.
    """
    ship(vectors.sparkSession)
    kind = "<f4" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "<f8"
    coded = cut(vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("e")).mapInArrow(_encoder(kind), "id long, vec binary").withColumn("cid", F.xxhash64("vec")))
    classes = coded.filter("vec IS NOT NULL").groupBy("cid", "vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("mult"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    shape = shape or plan(classes.count())
    keyed = cut(classes.select("node", "vec").mapInArrow(_keyer(kind, shape), "node long, s0 long, s1 long, keys array<long>"))
    entries = keyed.select("node", "s0", "s1", F.explode("keys").alias("key"))
    shared = cut(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / BLOCK).alias("parts")))
    dealt = blocks.deal(entries.join(shared, "key"), "key", "node", "parts")
    some = cut(dealt.select("key", "lo", "hi", "block", "node", "s0", "s1").mapInArrow(_sifter(least), "key long, lo int, hi int, block int, node long"))
    met = some.join(classes.select("node", "vec", "mult"), "node")
    made = cut(blocks.per_unit(blocks.gather(met, "key"), "key", _compare(kind, least, shape), "node long, links long, tied long"))
    counts = made.filter("links IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
    label = components(made.filter("tied IS NOT NULL").select(F.col("node").alias("a"), F.col("tied").alias("b")))
    linked = cut(classes.join(counts, "node", "left").join(label, "node", "left").withColumn("c", F.coalesce("component", "node")).withColumn("links", F.coalesce("links", F.lit(0)) + F.col("mult") - 1).filter("links > 0"))
    # the vector that represents a component: of least id, null last, then of the least class
    heads = cut(linked.groupBy("c").agg(F.min(F.struct(F.col("rep").isNull().alias("no_id"), "rep", "cid", "node")).alias("head")))
    named = cut(linked.join(heads, "c").select("cid", "vec", "links", F.col("head.rep").alias("head"), (F.col("head.node") == F.col("node")).alias("first")))
    out = coded.join(named, ["cid", "vec"], "left")
    alone = F.col("links").isNull()
    return out.select(
        F.col("id").alias("vec_id"),
        F.coalesce("links", F.lit(0)).alias("n_links"),
        F.when(alone, F.col("id")).otherwise(F.col("head")).alias("component_id"),
        F.when(alone, True).otherwise(F.col("first") & F.col("head").eqNullSafe(F.col("id"))).alias("kept"),
    )


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
