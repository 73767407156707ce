"""Draws by hash in bulk: MD5 of numbers behind one prefix, as arrays."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np

_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(k + 1)) * 2**32) & 0xFFFFFFFF for k in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
STEP = 1 << 14


def _first_words(words: np.ndarray, bits: int) -> np.ndarray:
    """The first 8 hexadecimal digits of the MD5 of one-block messages, whose words up to the length are given by row."""
    u = np.uint32
    a, b, c, d = (np.full(words.shape[1], x, dtype=u) for x in _START)
    for k in range(61):  # what later steps make is in the other words
        turn = k // 16
        if turn == 0:
            f, m = d ^ (b & (c ^ d)), k
        elif turn == 1:
            f, m = c ^ (d & (b ^ c)), (5 * k + 1) % 16
        elif turn == 2:
            f, m = b ^ c ^ d, (3 * k + 5) % 16
        else:
            f, m = c ^ (b | ~d), 7 * k % 16
        f += a
        f += u((_SINES[k] + (bits if m == 14 else 0)) & 0xFFFFFFFF)
        if m < len(words):
            f += words[m]
        s = _TURNS[turn][k % 4]
        a, d, c, b = d, c, b, b + ((f << u(s)) | (f >> u(32 - s)))
    return (b + u(_START[0])).byteswap()


def hashed_numbers(prefix: str, n: int) -> Iterator[np.ndarray]:
    """For i from 0 to n - 1, in arrays: the number that the first 8 hexadecimal digits of md5(prefix + i) write."""
    head = np.frombuffer(prefix.encode(), dtype=np.uint8)
    for digits in range(1, len(str(max(n - 1, 0))) + 1):
        low, high = (10 ** (digits - 1) if digits > 1 else 0), min(n, 10**digits)
        size = len(head) + digits
        for at in range(low, high, STEP):
            i = np.arange(at, min(at + STEP, high), dtype=np.int64)
            if size > 55:
                yield np.array([int(hashlib.md5(f"{prefix}{k}".encode()).hexdigest()[:8], 16) for k in i], dtype=np.int64)
                continue
            block = np.zeros((len(i), -(-(size + 1) // 4) * 4), dtype=np.uint8)
            block[:, : len(head)] = head
            for k in range(digits):
                block[:, len(head) + k] = i // 10 ** (digits - 1 - k) % 10 + 48
            block[:, size] = 0x80
            yield _first_words(np.ascontiguousarray(block.view("<u4").T), size * 8).astype(np.int64)
