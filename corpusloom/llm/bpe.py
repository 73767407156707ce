"""Byte-level BPE encoding and decoding with a two-tier lookup.

Pre-tokens are found by classes of code points, for a batch of texts at once. A pre-token that is itself in the
vocabulary is resolved by a minimal perfect hash (buckets with displacements, one slot per token); the others are merged
by rank with a heap over a linked list of their bytes. Hashes only propose: every pre-token is compared, byte by byte,
with the token of its slot and with the equal pre-token that it shares a look-up with. Ids are packed as little-endian unsigned
32-bit integers, four bytes each, in a binary column; `unpack` makes an array of them. No special tokens.

Scale: one pass over the texts without a shuffle; a worker holds the tables of the vocabulary (built once on the driver
and broadcast, their size bound by the vocabulary file), one slice of about a megabyte of text (a longer text is a slice
of its own, never cut) and a bounded memory of resolved pre-tokens, which is emptied when full.

Edge cases: a null text is empty; an empty text has no ids and decodes to no bytes; other columns and repeated rows pass
through as they are, a column named `bpe` is replaced by the result; an empty table gives no rows; ids outside the
vocabulary raise on decoding.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import shingles
from corpusloom.llm.columns import named, others
from corpusloom.session import ship

U = np.uint64
OTHER, SPACE, LETTER, NUMBER = 0, 1, 2, 3
SLICE = 1 << 20
REMEMBERED = 300_000
#: The white space of Unicode, as ranges of code points.
WHITE = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))


def code_point_classes() -> np.ndarray:
    """Class of every code point: other, white space, letter or number."""
    first = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    for a, z in WHITE:
        out[a : z + 1] = SPACE
    return out


def token_starts(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Indexes at which pre-tokens start; `first` marks the first code point of each text.

    Runs of a class are tokens. One blank before a run of letters, numbers or others belongs to that run; a run of white
    space before anything else leaves its last character as a token of its own or, if it is a blank, to the next run. An
    apostrophe that starts a token takes s, t, m, d, re, ve or ll after it.
    """
    n = len(points)
    kind = classes[points]
    starts = np.ones(n, bool)
    starts[1:] = (kind[1:] != kind[:-1]) | first[1:]
    end = np.ones(n, bool)  # last of its run
    end[:-1] = starts[1:]
    text_end = np.ones(n, bool)
    text_end[:-1] = first[1:]
    lone = np.flatnonzero((kind == SPACE) & end & ~text_end)  # white space with something solid after it
    starts[lone] = True
    blank = lone[points[lone] == 32]
    starts[blank + 1] = False
    quote = np.flatnonzero((points == 39) & starts & end & ~text_end)
    quote = quote[kind[quote + 1] == LETTER]
    if len(quote):
        at = lambda i: np.where(i < n, points[np.minimum(i, n - 1)], 0)
        same = lambda i: (i < n) & (kind[np.minimum(i, n - 1)] == LETTER) & ~starts[np.minimum(i, n - 1)]
        a, b = at(quote + 1), np.where(same(quote + 2), at(quote + 2), 0)
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        for hit, long in ((quote[one], 1), (quote[two & ~one], 2)):
            starts[hit + 1] = False
            rest = hit + 1 + long
            rest = rest[rest < n]
            go = (kind[rest] == LETTER) & ~starts[rest] & ~first[rest]
            starts[rest[go]] = True
    return np.flatnonzero(starts)


class Vocabulary:
    """Tables of a rank file: bytes of each id, and a minimal perfect hash from token to id."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.size = len(ranks)
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        # The hash of a pre-token is the one that is found for whole slices of text, so tokens get it the same way. Of
        # tokens with one hash the first has the slot; the others are found by the second tier.
        ids = np.flatnonzero(self.sizes)
        prints, one = np.unique(shingles.hash_spans(self.blob, self.at[ids], self.at[ids + 1]), return_index=True)
        self.blocks = shingles.eights(self.blob)
        self._displace(prints, ids[one])
        self.ranks = ranks

    def _displace(self, prints: np.ndarray, ids: np.ndarray) -> None:
        """Hash and displace: the fullest buckets first look for a shift that sends all their keys to free slots."""
        n = max(len(prints), 1)
        buckets = max(n // 4, 1)
        bucket = (prints % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
        self.shift, self.slot_print, self.slot_id = np.zeros(buckets, U), np.zeros(n, U), np.full(n, -1, np.int64)
        taken = np.zeros(n, bool)
        for b in np.argsort(-np.diff(cuts), kind="stable").tolist():
            own = order[cuts[b] : cuts[b + 1]]
            if not len(own):
                break
            start = 0
            while True:
                tries = np.arange(start, start + 64, dtype=np.uint64)
                slots = (shingles.mix(prints[own][None, :] + tries[:, None] * U(0x9E3779B97F4A7C15)) % U(n)).astype(np.int64)
                ok = ~taken[slots].any(1)
                if len(own) > 1:
                    s = np.sort(slots, 1)
                    ok &= (s[:, 1:] != s[:, :-1]).all(1)
                if ok.any():
                    k = int(ok.argmax())
                    self.shift[b] = tries[k]
                    taken[slots[k]] = True
                    self.slot_print[slots[k]], self.slot_id[slots[k]] = prints[own], ids[own]
                    break
                start += 64

    def whole(self, prints: np.ndarray, data: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """First tier: ids of the pre-tokens [a, z) of data with these hashes, -1 for those that are not in the vocabulary."""
        shift = self.shift[(prints % U(len(self.shift))).astype(np.int64)]
        slot = (shingles.mix(prints + shift * U(0x9E3779B97F4A7C15)) % U(len(self.slot_id))).astype(np.int64)
        found = np.where(self.slot_print[slot] == prints, self.slot_id[slot], -1)
        hit = np.flatnonzero(found >= 0)
        own = found[hit]
        found[hit[~same_spans(data, shingles.eights(data), a[hit], z[hit], self.blob, self.blocks, self.at[own], self.at[own + 1])]] = -1
        return found

    def merge(self, word: bytes) -> list[int]:
        """Second tier: ids of one pre-token, merging the pair of least rank (leftmost first) again and again."""
        ranks = self.ranks
        if (known := ranks.get(word)) is not None:
            return [known]
        n = len(word)
        stop = list(range(1, n + 1))  # of the piece that starts here; 0 once it is merged into the one before
        before = list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            mid = stop[i]
            if not mid or mid >= n:
                continue
            end = stop[mid]
            if ranks.get(word[i:end]) != rank:  # one of its pieces has grown meanwhile
                continue
            stop[i], stop[mid] = end, 0
            if end < n:
                before[end] = i
                if (r := ranks.get(word[i : stop[end]])) is not None:
                    heapq.heappush(heap, (r, i))
            if (k := before[i]) >= 0 and (r := ranks.get(word[k:end])) is not None:
                heapq.heappush(heap, (r, k))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : stop[i]]])
            i = stop[i]
        return out


def same_spans(data: np.ndarray, blocks: np.ndarray, a: np.ndarray, z: np.ndarray, other: np.ndarray, theirs: np.ndarray, b: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the spans [a, z) of data equal the spans [b, y) of other, by blocks of eight bytes."""
    size = z - a
    same = size == y - b
    live, k = np.flatnonzero(same & (size <= shingles.LONG)), 0
    while len(live):
        rest = size[live] - k
        head = shingles.HEAD[np.minimum(rest, 8)]
        ok = blocks[a[live] + k] & head == theirs[b[live] + k] & head
        same[live[~ok]] = False
        live, k = live[ok & (rest > 8)], k + 8
    for i in np.flatnonzero(same & (size > shingles.LONG)).tolist():
        same[i] = np.array_equal(data[a[i] : z[i]], other[b[i] : y[i]])
    return same


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines "base64 rank"."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _ragged(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes at[0] .. at[0] + sizes[0] - 1, at[1] .. and so on."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - sizes), sizes)


class Encoder:
    def __init__(self, vocabulary: Vocabulary, classes: np.ndarray) -> None:
        self.vocabulary, self.classes = vocabulary, classes
        self.known: dict[bytes, tuple[int, ...]] = {}

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's ids end, from 0) for UTF-8 bytes and the texts' ends in them."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        raw = data.tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        byte_at = np.flatnonzero((data & 0xC0) != 0x80)  # where each code point starts
        first = np.zeros(len(points), bool)
        begun = ends[:-1][ends[1:] > ends[:-1]]
        first[np.searchsorted(byte_at, begun)] = True
        a = byte_at[token_starts(points, first, self.classes)]
        z = np.append(a[1:], len(data))
        prints, one, inverse = np.unique(shingles.hash_spans(data, a, z), return_index=True, return_inverse=True)
        blocks, first_a, first_z = shingles.eights(data), a[one][inverse], z[one][inverse]
        odd = np.flatnonzero(~same_spans(data, blocks, a, z, data, blocks, first_a, first_z))
        if len(odd):  # pre-tokens that differ from the one of their hash: look-ups of their own
            extra: dict[bytes, int] = {}
            for i in odd.tolist():
                inverse[i] = extra.setdefault(raw[a[i] : z[i]], len(extra)) + len(one)
            rest = odd[np.unique(inverse[odd], return_index=True)[1]]
            prints, one = np.append(prints, prints[np.searchsorted(prints, shingles.hash_spans(data, a[rest], z[rest]))]), np.append(one, rest)
        whole = self.vocabulary.whole(prints, data, a[one], z[one])
        sizes = np.ones(len(prints), np.int64)
        missed = np.flatnonzero(whole < 0)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        merged = []
        for i, j in zip(a[one[missed]].tolist(), z[one[missed]].tolist(), strict=True):
            ids = self.known.get(word := raw[i:j])
            if ids is None:
                ids = tuple(self.vocabulary.merge(word))
                if j - i <= shingles.LONG:
                    self.known[word] = ids
            merged.append(ids)
        sizes[missed] = [len(m) for m in merged]
        at = np.cumsum(sizes) - sizes
        table = np.empty(int(sizes.sum()), np.uint32)
        hit = np.flatnonzero(whole >= 0)
        table[at[hit]] = whole[hit]
        if merged:
            table[_ragged(at[missed], sizes[missed])] = [i for m in merged for i in m]
        per = sizes[inverse]
        upto = np.concatenate([[0], np.cumsum(per)])
        return table[_ragged(at[inverse], per)], upto[np.searchsorted(a, ends)]

    def decode(self, ids: np.ndarray) -> bytes:
        v = self.vocabulary
        if len(ids) and int(ids.max()) >= len(v.tokens):
            raise ValueError("an id is not in the vocabulary")
        return v.blob[_ragged(v.at[ids], v.sizes[ids])].tobytes()


_WORKER: dict = {}


def _encoder(shared, key: str) -> Encoder:
    """The encoder of this worker process; it outlives tasks, and there is one vocabulary at a time."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Encoder(*shared.value)
    return _WORKER[key]


def tokenize(docs: DataFrame, ranks: str | dict[bytes, int], text: str = "text", decode: bool = True, keep: list[str] | None = None) -> DataFrame:
    """docs (or their columns `keep`) with a struct column `bpe` (ids: packed, n_tokens, decoded: what the packed ids decode to)."""
    spark = docs.sparkSession
    ship(spark)
    vocabulary = Vocabulary(read_ranks(ranks) if isinstance(ranks, str) else ranks)
    shared = spark.sparkContext.broadcast((vocabulary, code_point_classes()))
    key = hashlib.sha256(repr(sorted(vocabulary.ranks.items())).encode()).hexdigest()
    # The text goes to the workers once, first; the columns kept travel beside it under names that cannot clash.
    kept = others(docs.columns if keep is None else keep, "bpe")
    names = [f"c{i}" for i in range(len(kept))]
    flat = docs.select(named(text).alias("t"), *[named(c).alias(n) for c, n in zip(kept, names, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(shared, key)
        for batch in batches:
            data, ends = shingles.string_buffers(batch.column(0))
            for i, j in shingles.chunks(ends, SLICE):
                ids, upto = coder.encode(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
                packed = [ids[p:q].astype("<u4").tobytes() for p, q in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
                back = [coder.decode(np.frombuffer(x, "<u4")) for x in packed] if decode else [None] * len(packed)
                made = [pa.array(packed, pa.binary()), pa.array(back, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(k + 1).slice(i, j - i) for k in range(len(names))] + made, names=[*names, "ids", "decoded"])

    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, flat.schema.fields[1:], strict=True))
    out = flat.mapInArrow(run, f"{kinds}, ids binary, decoded binary")
    result = F.struct("ids", F.expr("cast(length(ids) / 4 as bigint)").alias("n_tokens"), "decoded").alias("bpe")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, kept, strict=True)], result)


def unpack(ids: Column) -> Column:
    """Packed ids as an array of numbers."""
    byte = lambda i, k: F.hex(F.substring(ids, i * 4 + F.lit(k + 1), F.lit(1)))
    number = lambda i: F.conv(F.concat(byte(i, 3), byte(i, 2), byte(i, 1), byte(i, 0)), 16, 10).cast("long")
    n = F.floor(F.length(ids) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), number)).otherwise(F.array().cast("array<bigint>"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = tokenize(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep=["doc_id"])
    return out.select("doc_id", "bpe.n_tokens", F.sha2("bpe.ids", 256).alias("ids_sha256"), F.sha2("bpe.decoded", 256).alias("decoded_sha256"))
