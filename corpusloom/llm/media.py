"""Media columns: texts as FLAC streams of 8-bit samples, read back into PCM blocks with seekable sample offsets.

`store` makes a binary column of FLAC streams from payloads, `read_back` decodes such a column (checksums verified) into
PCM with the sample offset of every block, `round_trip` does both in one pass, decoding only what was stored, and
`pcm_blocks` gives a row per block, so that any sample is found by its offset without touching the others.

Scale: one pass without a shuffle, in slices of about a megabyte (a longer text is a slice of its own, never cut).

Edge cases: a null text is empty, its payload one block of padding; a null or damaged stream gives null PCM and no
blocks; other columns and repeated rows pass through; a column named `media` is replaced by the result; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import flac, shingles
from corpusloom.llm.columns import named, others
from corpusloom.session import ship

SLICE = 1 << 20
_PCM = "pcm binary, block_ends array<long>, feature string"


def payload(text: bytes) -> bytes:
    """UTF-8 bytes filled up with bytes 255 to a positive multiple of a frame."""
    return text + b"\xff" * (max(flac.BLOCK, -(-len(text) // flac.BLOCK) * flac.BLOCK) - len(text))


def feature(pcm: bytes) -> str:
    """Samples, their sum and energy around 128, zero crossings, least and greatest: all integers, colon-joined."""
    s = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    if not len(s):
        return "0:0:0:0:0:0"
    return ":".join(map(str, (len(s), int(s.sum()), int((s * s).sum()), int(((s[1:] < 0) != (s[:-1] < 0)).sum()), int(s.min()), int(s.max()))))


def _read(streams: list[bytes | None]) -> list[pa.Array]:
    read = flac.decode(streams)
    return [
        pa.array([r[0] if r else None for r in read], pa.binary()),
        pa.array([r[1][1:].tolist() if r else None for r in read], pa.list_(pa.int64())),
        pa.array([feature(r[0]) if r else None for r in read], pa.string()),
    ]


def _passed(docs: DataFrame, first: Column, keep: list[str] | None, work, made: str, out: str, struct: list[str]) -> DataFrame:
    """docs (or their columns `keep`) with a struct `out` of what `work` makes of the column `first`."""
    ship(docs.sparkSession)
    cols = others(docs.columns if keep is None else keep, out)
    names = [f"c{i}" for i in range(len(cols))]
    flat = docs.select(first.alias("t"), *[named(c).alias(n) for c, n in zip(cols, names, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, arrays in work(batch.column(0)):
                yield pa.RecordBatch.from_arrays([*(batch.column(k + 1).slice(i, j - i) for k in range(len(names))), *arrays], names=[*names, *struct])

    kinds = "".join(f"{n} {f.dataType.simpleString()}, " for n, f in zip(names, flat.schema.fields[1:], strict=True))
    return flat.mapInArrow(run, kinds + made).select(*[F.col(n).alias(c) for n, c in zip(names, cols, strict=True)], F.struct(*struct).alias(out))


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    data, ends = shingles.string_buffers(column)
    for i, j in shingles.chunks(ends, SLICE):
        raw, stops = data[ends[i] : ends[j]].tobytes(), (ends[i : j + 1] - ends[i]).tolist()
        # empty texts make payloads too: a slice holds a bounded number of them
        for k in range(i, j, 1024):
            z = min(k + 1024, j)
            yield k, z, [raw[a:b] for a, b in zip(stops[k - i : z - i], stops[k - i + 1 : z - i + 1], strict=True)]


def _streams(column: pa.Array) -> Iterator[tuple[int, int, list[bytes | None]]]:
    sizes = np.concatenate([[0], np.cumsum(pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False))])
    for i, j in shingles.chunks(sizes, SLICE):
        for k in range(i, j, 1024):
            z = min(k + 1024, j)
            yield k, z, column.slice(k, z - k).to_pylist()


def store(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with a struct `media` (flac)."""
    work = lambda c: ((i, j, [pa.array(flac.encode([payload(t) for t in texts]), pa.binary())]) for i, j, texts in _texts(c))
    return _passed(docs, named(text), keep, work, "flac binary", "media", ["flac"])


def read_back(docs: DataFrame, stream: Column, keep: list[str] | None = None) -> DataFrame:
    """docs with a struct `media` (pcm, block_ends, feature) decoded from the FLAC column `stream`."""
    work = lambda c: ((i, j, _read(streams)) for i, j, streams in _streams(c))
    return _passed(docs, stream, keep, work, _PCM, "media", ["pcm", "block_ends", "feature"])


def round_trip(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with a struct `media` (flac, pcm, block_ends, feature): stored, then read back from the stored bytes."""

    def work(column: pa.Array) -> Iterator[tuple]:
        for i, j, texts in _texts(column):
            streams = flac.encode([payload(t) for t in texts])
            yield i, j, [pa.array(streams, pa.binary()), *_read(streams)]

    return _passed(docs, named(text), keep, work, f"flac binary, {_PCM}", "media", ["flac", "pcm", "block_ends", "feature"])


def pcm_blocks(read: DataFrame, media: str = "media") -> DataFrame:
    """A row for each PCM block: the other columns, then a struct `block` (sample_offset, n_samples, pcm)."""
    ends = F.col(f"{media}.block_ends")
    rows = read.select(*[named(c) for c in read.columns if c != media], F.col(f"{media}.pcm").alias("_pcm"), F.explode(F.transform(ends, lambda e, i: F.struct(F.when(i > 0, F.element_at(ends, i)).otherwise(0).alias("a"), e.alias("z")))).alias("_b"))
    size = F.col("_b.z") - F.col("_b.a")
    block = F.struct(F.col("_b.a").alias("sample_offset"), size.alias("n_samples"), F.substring("_pcm", (F.col("_b.a") + 1).cast("int"), size.cast("int")).alias("pcm"))
    return rows.select(*[named(c) for c in others(read.columns, "block") if c != media], block.alias("block"))


def op7_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    m = round_trip(docs, keep=["doc_id", "n_bytes"])
    tail = F.expr("substring(media.pcm, length(media.pcm) - 31, 32)")
    return m.select(
        "doc_id",
        "n_bytes",
        F.length("media.pcm").cast("long").alias("payload_bytes"),
        F.sha2("media.pcm", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.length("media.flac").cast("long").alias("media_bytes"),
        F.sha2("media.flac", 256).alias("media_sha256"),
        F.col("media.feature").alias("feature"),
    )
