"""Byte-level BPE against its library, FLAC against itself and hand-made streams, and the odd cases of both."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from corpusloom.llm import bpe, flac, media
from tests.llm.conftest import kept

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.read_ranks(RANKS))


def encoded(coder, texts):
    raw = [t.encode() for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    ids, upto = coder.encode(np.frombuffer(b"".join(raw), np.uint8), ends)
    return [ids[a:z] for a, z in zip(upto[:-1], upto[1:], strict=True)]


def test_perfect_hash(vocabulary):
    v = vocabulary
    assert len(v.slot_id) == v.size == len(set(v.slot_id.tolist())) and (v.slot_id >= 0).all()
    ends = v.at
    keys = bpe.shingles.hash_spans(v.blob, ends[:-1], ends[1:])
    assert (v.whole(keys, v.blob, ends[:-1], ends[1:]) == np.arange(v.size)).all()
    n = 10000
    nothing = np.random.default_rng(0).integers(0, 2**63, n, dtype=np.uint64)
    assert (v.whole(nothing, v.blob, ends[:n], ends[1 : n + 1]) == -1).all()
    # a hash that is in the table does not make another word a token
    assert (v.whole(keys[1:], v.blob, ends[:-2], ends[1:-1]) == -1).all()


def test_like_the_library(library, vocabulary):
    rng = random.Random(1)
    parts = ["'", "s", "t", "re", "ll", "ve", "LL", " ", "  ", "\n", "\t", "a", "B", "1", "٣", "½", "é", "é", " ", " ", "\x1c", "!", "..", "日", "😀", "<|endoftext|>", "the", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(6000)] + ["x" * 3000, " " * 3000, "ab" * 2000, "it's I'll we've 'tis ''s"]
    coder = bpe.Encoder(vocabulary, bpe.code_point_classes())
    for text, ids in zip(texts, encoded(coder, texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()
    with pytest.raises(ValueError):
        coder.decode(np.array([60000], np.uint32))


def test_bpe_query(spark, library, small_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    for r in bpe.op3_byte_bpe(spark, small_dir).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_bpe_odd(odd_docs, no_docs, library):
    out = kept(bpe.tokenize(odd_docs, RANKS), odd_docs)
    for r in out.select("text", bpe.unpack(F.col("bpe.ids")).alias("ids"), "bpe.n_tokens", "bpe.decoded").collect():
        assert r.ids == library.encode_ordinary(r.text or "") and r.n_tokens == len(r.ids) and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.tokenize(no_docs, RANKS).count() == 0
    assert bpe.tokenize(odd_docs.withColumn("bpe", F.lit(1)), RANKS).columns.count("bpe") == 1


def thue_morse(n):
    """A word of n letters and its complement: equal under every polynomial hash modulo a power of two."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [16, 128, 1024, 8192])
def test_words_of_one_polynomial_hash(library, vocabulary, n):
    coder, texts = bpe.Encoder(vocabulary, bpe.code_point_classes()), [*thue_morse(n), " ".join(thue_morse(n))]
    for text, ids in zip(texts, encoded(coder, texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text) and coder.decode(ids) == text.encode()


def test_words_of_one_hash(library, monkeypatch):
    monkeypatch.setattr(bpe.shingles, "hash_spans", lambda data, a, z: (z - a).astype(np.uint64) % np.uint64(3))
    small = bpe.Vocabulary({t: r for t, r in bpe.read_ranks(RANKS).items() if r < 400})
    own = tiktoken.Encoding("few", pat_str=public_tokenizers.PATTERN, mergeable_ranks=small.ranks, special_tokens={})
    texts = ["the cat in the hat is in at on", "", "is it on", "inter" * 60 + " other" * 70]
    for text, ids in zip(texts, encoded(bpe.Encoder(small, bpe.code_point_classes()), texts), strict=True):
        assert ids.tolist() == own.encode_ordinary(text)


def payloads():
    rng = np.random.default_rng(0)
    text = ("The quick brown fox jumps over the lazy dog. " * 60).encode()
    return [
        media.payload(text), media.payload(b""), b"\x00" * 576, b"z" * 5760, rng.integers(0, 256, 5760).astype(np.uint8).tobytes(), bytes(range(256)) * 9 * 2,
        bytes(rng.integers(0, 2, 2880).astype(np.uint8) * 255), (np.sin(np.arange(576 * 140) / 9) * 120 + 128).astype(np.uint8).tobytes(), media.payload("é😀ñ".encode() * 500),
    ]


def test_flac_round_trip():
    streams = flac.encode(payloads())
    assert [d[0] for d in flac.decode(streams)] == payloads()
    assert sum(map(len, streams)) < sum(map(len, payloads()))
    assert flac.encode(payloads()[3:4])[0] == streams[3]  # equal payloads, equal streams


def without_seek(stream):
    return stream[:4] + b"\x80" + stream[5:42] + stream[46 + int.from_bytes(stream[43:46]) :]


def test_flac_without_seek_table_or_whole():
    streams = flac.encode(payloads())
    assert [d[0] for d in flac.decode([without_seek(s) for s in streams])] == payloads()
    for k in (-1, -20, 30):  # frame checksum, residual, MD5
        bad = bytearray(streams[0])
        bad[k] ^= 4
        got = flac.decode([bytes(bad), streams[1], None, b"", b"RIFF" * 20, streams[0][:-100]])
        assert got[0] is None and got[1][0] == payloads()[1] and got[2:] == [None] * 4


def hand_made(block, subframe_bits, samples):
    """A stream of one frame with the given subframe, built bit by bit."""
    head = bytes([0xFF, 0xF8, 0x64, 0x02, 0x00, block - 1])
    head += bytes([flac.crc8(head)])
    bits = "".join(subframe_bits)
    bits += "0" * (-len(bits) % 8)
    frame = head + int(bits, 2).to_bytes(len(bits) // 8)
    crc = int(flac.crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0])
    signed = np.array(samples, np.int8).tobytes()
    info = block.to_bytes(2) * 2 + bytes(6) + (8000 << 44 | 7 << 36 | block).to_bytes(8) + hashlib.md5(signed).digest()
    return b"fLaC\x80" + len(info).to_bytes(3) + info + frame + crc.to_bytes(2), signed


def number(x, n):
    return format(x & ((1 << n) - 1), f"0{n}b")


def rice(x, k):
    u = 2 * x if x >= 0 else -2 * x - 1
    return "0" * (u >> k) + "1" + (number(u, k) if k else "")


def test_flac_kinds_of_subframes():
    rng = np.random.default_rng(3)
    s = np.clip(np.cumsum(rng.integers(-6, 7, 32)), -60, 60).tolist()
    for order in range(5):  # fixed predictors, two partitions: a 5-bit parameter, and escaped raw bits
        r = s
        for _ in range(order):
            r = [b - a for a, b in zip(r, r[1:], strict=False)]
        first, rest = r[: 16 - order], r[16 - order :]
        wide = max(max(abs(x) for x in rest).bit_length() + 1, 2)
        bits = ["0", number(8 + order, 6), "0", *(number(x, 8) for x in s[:order]), "01", number(1, 4), number(3, 5), *(rice(x, 3) for x in first), "11111", number(wide, 5), *(number(x, wide) for x in rest)]
        stream, signed = hand_made(32, bits, s)
        assert flac.decode([stream])[0][0] == bytes(b ^ 0x80 for b in signed)
    coefs, shift = [9, -5, 2], 2  # a linear predictor of order 3
    r = [s[i] - (sum(c * s[i - 1 - k] for k, c in enumerate(coefs)) >> shift) for i in range(3, 32)]
    bits = ["0", number(32 + 2, 6), "0", *(number(x, 8) for x in s[:3]), number(5, 4), number(shift, 5), *(number(c, 6) for c in coefs), "00", number(0, 4), number(4, 4), *(rice(x, 4) for x in r)]
    stream, signed = hand_made(32, bits, s)
    assert flac.decode([stream])[0][0] == bytes(b ^ 0x80 for b in signed)


def test_frame_numbers():
    assert [flac.coded_number(n).hex() for n in (0, 127, 128, 2047, 2048, 65535, 65536)] == ["00", "7f", "c280", "dfbf", "e0a080", "efbfbf", "f0908080"]


def test_media_query(spark, small_dir):
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    for r in media.op7_flac_media(spark, small_dir).collect():
        p = media.payload(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) == (len(texts[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), media.feature(p))


def test_media_odd(spark, odd_docs, no_docs):
    out = kept(media.round_trip(odd_docs), odd_docs).cache()
    for r in out.collect():
        assert bytes(r.media.pcm) == media.payload((r.text or "").encode()) and r.media.block_ends[-1] == len(r.media.pcm)
    stored = media.store(odd_docs)
    read = media.read_back(stored, F.col("media.flac"), keep=["c0"])
    blocks = media.pcm_blocks(read).select("c0", "block.*").collect()
    whole = {r.c0: bytes(r.media.pcm) for r in out.collect()}
    for b in blocks:
        assert bytes(b.pcm) == whole[b.c0][b.sample_offset : b.sample_offset + b.n_samples]
    assert len(blocks) == sum(len(w) // 576 for w in whole.values())
    bad = spark.createDataFrame([(1, b"junk"), (2, None)], "i int, f binary")
    assert [r.media.pcm for r in media.read_back(bad, F.col("f")).collect()] == [None, None]
    assert media.round_trip(no_docs).count() == 0 and media.pcm_blocks(media.round_trip(no_docs)).count() == 0
