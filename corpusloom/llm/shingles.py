"""Word shingles of whole texts as 64-bit hashes, vectorised over an Arrow column's bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20240229)
#: A-Z as a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] = LOWER[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_TURN = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * U(2) + U(1)
#: Masks of the first 0 to 8 bytes of a little-endian block.
HEAD = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)
#: Spans over so many bytes are hashed one by one.
LONG = 128
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(29))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(32))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of data on as one number, zeros past its end."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def hash_spans(data: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [a, z) of data: the length, then block after block of eight bytes mixed in.

    All spans take a step together; the few long ones go through a cryptographic hash, one by one.
    """
    size = z - a
    out = mix(size.astype(U) * _TURN[15] + _TURN[14])
    block, live, k = eights(data), np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(live):
        rest = size[live] - k
        out[live] = mix((out[live] ^ (block[a[live] + k] & HEAD[np.minimum(rest, 8)])) * _TURN[13] + _TURN[12])
        live, k = live[rest > 8], k + 8
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[a[i] : z[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column without copying; null and empty texts have no bytes."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), ends


def chunks(ends: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `size` bytes; a longer text is a range of its own, never cut."""
    i, n = 0, len(ends) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + size, "right")) - 1)
        yield i, j
        i = j


def hash_words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z as a-z, and for each text the number of its first word (and the total at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(ends), np.int64)
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    starts = ends[:-1][(ends[1:] > ends[:-1])]
    first[starts] = solid[starts]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    stops = ends[1:][(ends[1:] > ends[:-1])] - 1
    last[stops] = solid[stops]
    a, z = np.flatnonzero(first), np.flatnonzero(last) + 1
    return hash_spans(LOWER[data], a, z), np.searchsorted(a, ends)


def shingle_sets(data: np.ndarray, ends: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of `width` words; all words if they are fewer."""
    words, at = hash_words(data, ends - ends[0])
    turn = _TURN
    if len(words) >= width:
        many = words[: len(words) - width + 1] * turn[0]
        for k in range(1, width):
            many = mix(many) + words[k : len(words) - width + 1 + k] * turn[k]
        many = mix(many)
    out = []
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if j - i >= width:
            out.append(np.unique(many[i : j - width + 1]))
        elif j > i:
            h = words[i : i + 1] * turn[8]
            for k in range(i + 1, j):
                h = mix(h) + words[k : k + 1] * turn[8 + k - i]
            out.append(mix(h + U(j - i)))
        else:
            out.append(np.zeros(0, U))
    return out
