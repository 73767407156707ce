"""Near-duplicate documents: MinHash signatures in bands, verified on whole shingle sets, joined into components.

1. Every whole text becomes its set of word shingles (64-bit hashes); `hashes` universal functions (a x + b mod 2^64,
   high half) give a signature of minima, whose bands of `rows` minima are bucket keys. 2. Texts with equal sets
   (128-bit fingerprint) are one class, a node with a number of its own, whatever ids its documents have. 3. Every class
   is compared with the first class of the buckets it is in, the one it shares most of them with; components of these
   links give each class a label. 4. In each bucket that still holds several labels, the classes that have not its most
   frequent label are compared with all that have another one; buckets with the same members are looked at once. Every
   pair that shares a band is thus compared or known to be connected; no others are. 5. Large-star and small-star on the
   confirmed links give the components.

A comparison looks at sizes, then at signatures, then, exactly, at the full sets; pairs already connected in their unit
need none, and a unit emits a spanning forest, never all pairs.

Recall: (1 - t^rows)^bands is below 1e-5 at the threshold t, and a signature is let through unless it lies over five
standard deviations low. Precision is exact up to collisions of 64-bit shingle hashes.

Scale: exact copies meet in a partial aggregate; a bucket shuffles as (key, node); units of comparison hold at most two
blocks of BLOCK_TEXTS texts and BLOCK_SHINGLES shingles (or one text that is larger); sets exist only for classes that
share a bucket. A bucket of k labels of m classes each costs k (k - 1) / 2 m^2 comparisons, in parallel units. Joins with
aggregates read these from a checkpoint, so that adaptive execution can split a hot side. Nothing about all documents
reaches the driver.

Edge cases: null, empty and blank texts have no shingles and stay alone; a text of fewer words than a shingle is one
shingle; there is a result row for each input row, by its text: rows that share a doc_id, or have none, are linked by
their texts only; component_id is the least doc_id of the component, null if it has none; `kept` is true for the rows of
the class that represents the component (the one of least doc_id, null last, then of least fingerprint) that have its
doc_id; the result has its own four columns, so columns of the input cannot clash with it; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import blocks, shingles
from corpusloom.llm.columns import packed, unpacked
from corpusloom.llm.components import components
from corpusloom.session import cut, ship

U = np.uint64
MISS = 1e-5
BLOCK_SHINGLES, BLOCK_TEXTS = 200_000, 512


def banding(percent: int) -> tuple[int, int]:
    """(rows, bands) whose chance to miss a pair at the threshold is below MISS."""
    t = percent / 100
    rows = 6 if t >= 0.85 else 5 if t >= 0.75 else 4 if t >= 0.6 else 3
    return rows, math.ceil(math.log(MISS) / math.log(1 - t**rows))


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1997)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * U(2) + U(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def signatures(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """Minima (texts x hashes, 32 bits each) of the universal functions over non-empty sets."""
    a, b = _family(hashes)
    flat = np.concatenate(sets) >> U(32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out, buf = np.empty((hashes, len(sets)), U), np.empty(len(flat), U)
    for k in range(hashes):
        np.multiply(flat, a[k], out=buf)
        np.add(buf, b[k], out=buf)
        out[k] = np.minimum.reduceat(buf, starts)
    return (out >> U(32)).T


def _sketcher(width: int, rows: int, bands: int):
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("fa", pa.int64()), ("fb", pa.int64()), ("bands", pa.list_(pa.int64()))])
    turn = np.random.default_rng(7).integers(0, 2**63, rows, dtype=np.uint64) * U(2) + U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = shingles.string_buffers(batch.column(2))
            for i, j in shingles.chunks(ends):
                sets = shingles.shingle_sets(data[ends[i] : ends[j]], ends[i : j + 1], width)
                full = [s for s in sets if len(s)]
                keys: list = [None] * len(sets)
                if full:
                    sig = signatures(full, rows * bands).reshape(len(full), bands, rows)
                    h = np.broadcast_to(np.arange(bands, dtype=U), sig.shape[:2])
                    for k in range(rows):
                        h = shingles.mix(h + sig[:, :, k] * turn[k])
                    it = iter(h.view(np.int64).tolist())
                    keys = [next(it) if len(s) else None for s in sets]
                prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                two = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(keys, pa.list_(pa.int64()))],
                    schema=schema,
                )

    return run


def _setter(width: int, hashes: int):
    """(node, sig, members): sets and 8-bit signatures of the texts that share a bucket with another, repeated rows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            data, ends = shingles.string_buffers(batch.column(1))
            for i, j in shingles.chunks(ends):
                new = [k for k in range(i, j) if nodes[k] != (nodes[k - 1] if k else last)]
                if not new:
                    continue
                sets = shingles.shingle_sets(data[ends[i] : ends[j]], ends[i : j + 1], width)
                some = [sets[k - i] for k in new]
                sig = (signatures(some, hashes) & U(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([nodes[k] for k in new], pa.int64()), pa.array([s.tobytes() for s in sig], pa.binary()), pa.array([s.tobytes() for s in some], pa.binary())], names=["node", "sig", "members"]
                )
            last = nodes[-1] if nodes else last

    return run


def _verifier(percent: int, hashes: int):
    t = percent / 100
    least = math.floor(hashes * t - 5 * math.sqrt(hashes * t * (1 - t)))

    def work(unit: pa.Table) -> pa.RecordBatch | None:
        guests = np.flatnonzero(unit.column("visits").to_numpy())
        homes = np.flatnonzero(~unit.column("visits").to_numpy())
        if not len(guests) or not len(homes):
            return None
        nodes = unit.column("node").to_numpy()
        sets = [np.frombuffer(b, U) for b in unit.column("members").to_pylist()]
        sig = np.frombuffer(b"".join(unit.column("sig").to_pylist()), np.uint8).reshape(len(nodes), hashes)
        sizes = np.array([len(s) for s in sets])
        root = unit.column("label").to_numpy().copy()
        post = None
        edges = []
        for i in guests.tolist():
            at = np.flatnonzero(root[homes] != root[i])
            # sizes that differ too much cannot reach the threshold
            at = at[np.minimum(sizes[homes[at]], sizes[i]) * 100 >= percent * np.maximum(sizes[homes[at]], sizes[i])]
            if len(at):
                at = at[(sig[homes[at]] == sig[i]).sum(1) >= least]
            if not len(at):
                continue
            j = homes[at]
            if len(j) <= 4:
                both = np.array([np.isin(sets[i], sets[k], assume_unique=True).sum() for k in j.tolist()])
            else:
                if post is None:
                    post = _postings([sets[k] for k in homes.tolist()])
                both = _common(post, sets[i], len(homes))[at]
            j = j[100 * both >= percent * (sizes[i] + sizes[j] - both)]
            for k in j.tolist():
                if root[k] != root[i]:
                    edges.append((int(nodes[i]), int(nodes[k])))
                    root[root == root[k]] = root[i]
        if not edges:
            return None
        a, b = zip(*edges, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return work


def _postings(sets: list[np.ndarray]) -> tuple:
    """An inverted index of sets: the distinct members in order, and the numbers of the sets of each."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    values, starts = np.unique(flat[order], return_index=True)
    return values, owner[order], np.append(starts, len(flat))


def _common(post: tuple, members: np.ndarray, n: int) -> np.ndarray:
    """How many of the members each of the n sets has."""
    values, owner, starts = post
    at = np.searchsorted(values, members)
    at = at[at < len(values)] if len(at) and at[-1] >= len(values) else at
    at = at[values[at] == members[: len(at)]]
    a, size = starts[at], starts[at + 1] - starts[at]
    where = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    return np.bincount(owner[where], minlength=n)


def _confirmed(cells: DataFrame, sets: DataFrame, percent: int, hashes: int) -> DataFrame:
    """Links (a, b) between the guests of each group and its members of other labels.

    cells: (cell, node, n, label, guest); sets: (node, sig, members).
    """
    blocks_of = lambda some: F.greatest(F.ceil(F.greatest(F.sum(F.when(some, F.col("n"))) / BLOCK_SHINGLES, F.count(F.when(some, 1)) / BLOCK_TEXTS)), F.lit(1))
    sizes = cut(cells.groupBy("cell").agg(blocks_of(F.lit(True)).alias("homes"), blocks_of(F.col("guest")).alias("rounds")))
    dealt = blocks.visits(cells.select("cell", "node", "label", "guest"), sizes, "cell", "node").select("cell", "node", "label", "visits", "lo", "hi")
    return blocks.per_unit(blocks.gather(dealt.join(sets, "node"), "cell"), "cell", _verifier(percent, hashes), "a long, b long")


def _labelled(docs: DataFrame, text: str, width: int, percent: int) -> DataFrame:
    """(doc_id, h, n, c, kept) for each row of docs: its text's hash, shingles and component, and whether it stays."""
    ship(docs.sparkSession)
    rows, bands = banding(percent)
    hashes = rows * bands
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    sk = cut(read.mapInArrow(_sketcher(width, rows, bands), "doc_id long, h long, n long, fa long, fb long, bands array<long>"))
    # 2. classes; the order of documents puts missing ids last
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    classes = sk.filter("n > 0").groupBy("fa", "fb").agg(F.min(place).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    # buckets of several classes
    keys = classes.select("node", "n", F.explode("bands").alias("cell"))
    shared = cut(keys.groupBy("cell").agg(F.min("node").alias("lead"), F.max("node").alias("last")).filter("lead <> last").select("cell", "lead"))
    met = cut(keys.join(shared, "cell"))
    # 3. every class and the first one of its buckets
    pairs = met.filter("node <> lead").groupBy("node", "n", "lead").agg(F.count(F.lit(1)).alias("times"))
    best = cut(pairs.groupBy("node", "n").agg(F.max(F.struct("times", (-F.col("lead")).alias("back"))).alias("m")).select("node", "n", (-F.col("m.back")).alias("cell")))
    members = met.select("node").distinct().join(classes.select("node", "rep"), "node")
    r, m = read.alias("r"), members.alias("m")
    texts = r.join(m, F.col("r.doc_id").eqNullSafe(F.col("m.rep.doc_id")) & (F.col("r.h") == F.col("m.rep.h"))).select("m.node", "r.text")
    sets = cut(texts.mapInArrow(_setter(width, hashes), "node long, sig binary, members binary"))
    leads = best.select("cell").distinct().select("cell", F.col("cell").alias("node"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("guest"))
    stars = best.select("cell", "node", "n", F.lit(False).alias("guest")).union(leads.select("cell", "node", "n", "guest")).withColumn("label", F.col("node"))
    label = cut(components(_confirmed(stars, sets, percent, hashes)))
    # 4. buckets of several labels
    marked = cut(met.select("cell", "node", "n").join(label, "node", "left").select("cell", "node", "n", F.coalesce("component", "node").alias("label")))
    print_of = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"p{k}") for k in (1, 2)]
    counted = marked.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("k"), *print_of)
    mixed = counted.groupBy("cell").agg(F.max(F.struct("k", "label")).alias("most"), F.count(F.lit(1)).alias("labels"), F.bit_xor("p1").alias("p1"), F.bit_xor("p2").alias("p2")).filter("labels > 1")
    mixed = cut(mixed.groupBy("p1", "p2").agg(F.min("cell").alias("cell"), F.first("most.label").alias("most")).select("cell", "most"))
    cells = marked.join(mixed, "cell").select("cell", "node", "n", "label", (F.col("label") != F.col("most")).alias("guest"))
    more = _confirmed(cells, sets, percent, hashes)
    # 5. components, and the class that represents each
    both = components(label.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    own = classes.select("node", "fa", "fb", F.col("rep.no_id").alias("no_id"), F.col("rep.doc_id").alias("doc_id"), "copies")
    grouped = cut(own.join(both, "node"))
    heads = cut(grouped.groupBy("component").agg(F.min(F.struct("no_id", "doc_id", "fa", "fb")).alias("head")))
    grouped = grouped.join(heads, "component").select("fa", "fb", "head")
    copied = own.filter("copies > 1").join(both, "node", "left_anti").select("fa", "fb", F.struct("no_id", "doc_id", "fa", "fb").alias("head"))
    named = cut(grouped.union(copied))
    found = sk.select("doc_id", "h", "n", "fa", "fb").join(named, ["fa", "fb"], "left")
    heading = F.col("head.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("head.fa") == F.col("fa")) & (F.col("head.fb") == F.col("fb"))
    return found.select("doc_id", "h", "n", F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("c"), F.when(F.col("head").isNull(), True).otherwise(heading).alias("kept"))


def near_duplicates(docs: DataFrame, text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, kept (it represents its component).

    Documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of `width`-word shingles.
    """
    return _labelled(docs, text, width, percent).select("doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), "kept")


def keep_one(docs: DataFrame, text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that represent their component; repeated rows (same doc_id and text) become one."""
    named = lambda ident: [F.coalesce(ident, F.lit(0)).alias("i"), ident.isNull().alias("no_id")]
    kept = cut(_labelled(docs, text, width, percent).filter("kept").select(*named(F.col("doc_id")), "h").distinct())
    rows = docs.select(packed(docs), *named(F.col("doc_id").cast("long")), F.xxhash64(text).alias("h")).join(kept, ["i", "no_id", "h"])
    copy = F.row_number().over(Window.partitionBy("i", "no_id", "h").orderBy(F.length(F.col("row")[text])))
    return rows.withColumn("copy", copy).filter("copy = 1").select(*unpacked(docs))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, width=3, percent=85)
