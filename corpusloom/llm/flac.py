"""FLAC for byte payloads: mono streams of 8-bit samples, many frames encoded and decoded side by side with numpy.

Encoder: frames of 576 samples; each is constant, verbatim, a fixed predictor of order 0 or 1, or a linear predictor of
order 4, whichever is least; residuals are Rice coded in four partitions. A stream has STREAMINFO (with the MD5 of the
samples) and a SEEKTABLE with a point for every frame. Decoder: any mono stream of 8-bit samples: all subframe kinds,
Rice parameters of 4 or 5 bits, escaped partitions, any partition order; header CRC-8, frame CRC-16 and MD5 are checked.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np

BLOCK = 576
PARTS = 4
LPC_ORDER, LPC_BITS, LPC_SHIFT = 4, 10, 7
RATE = 8000
#: Fixed values of the format: block sizes by code.
BLOCK_SIZES = {1: 192, **{k: 576 << (k - 2) for k in range(2, 6)}, **{k: 256 << (k - 8) for k in range(8, 16)}}


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.zeros(256, np.uint32)
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly if c >> (bits - 1) else 0)
            c &= (1 << bits) - 1
        out[i] = c
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc16(data: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """CRC-16 of the spans [a, z) of data, all spans a byte at a time."""
    order = np.argsort(a - z, kind="stable")
    start, size = a[order], (z - a)[order]
    crc = np.zeros(len(a), np.uint32)
    width = len(size) - np.searchsorted(size[::-1], np.arange(size.max(initial=0)), "right")
    for t, w in enumerate(width.tolist()):
        c = crc[:w]
        crc[:w] = ((c << 8) & 0xFFFF) ^ _CRC16[(c >> 8) ^ data[start[:w] + t]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(_CRC8[c ^ b])
    return c


def coded_number(n: int) -> bytes:
    """The frame number in the format's extension of UTF-8 to 36 bits."""
    if n < 0x80:
        return bytes([n])
    more = 1
    while n >= 1 << (6 * more + 6 - more):
        more += 1
    head = (0xFF << (7 - more)) & 0xFF
    return bytes([head | n >> (6 * more), *(0x80 | n >> (6 * k) & 0x3F for k in reversed(range(more)))])


_HEADERS: dict[int, bytes] = {}


def frame_header(n: int) -> bytes:
    """Header of frame n: fixed blocks of 576, 8 kHz, mono, 8 bits; frames of one number share it."""
    if (h := _HEADERS.get(n)) is None:
        h = bytes([0xFF, 0xF8, 0x24, 0x02]) + coded_number(n)
        h += bytes([crc8(h)])
        if len(_HEADERS) < 4096:
            _HEADERS[n] = h
    return h


class _Bits:
    """A field of bits to which numbers are written at any places at once."""

    def __init__(self, size: int) -> None:
        self.bits = np.zeros(size, np.uint8)

    def put(self, at: np.ndarray, value: np.ndarray, width: int) -> None:
        for k in range(width):
            self.bits[at + k] = (value >> (width - 1 - k)) & 1


def _fold(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _lpc(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, residuals) of linear prediction of order 4 for each row of samples."""
    x = s.astype(np.float64)
    lag = np.stack([(x[:, k:] * x[:, : BLOCK - k]).sum(1) for k in range(LPC_ORDER + 1)], 1)
    i = np.arange(LPC_ORDER)
    normal = lag[:, np.abs(i[:, None] - i)] + np.eye(LPC_ORDER) * (1 + 1e-3 * lag[:, :1, None])
    c = np.linalg.solve(normal, lag[:, 1:, None])[:, :, 0]
    top = (1 << (LPC_BITS - 1)) - 1
    c = np.clip(np.rint(c * (1 << LPC_SHIFT)), -top, top).astype(np.int32)
    r = s.copy()
    guess = np.zeros((len(s), BLOCK - LPC_ORDER), np.int32)
    for k in range(LPC_ORDER):
        guess += c[:, k : k + 1] * s[:, LPC_ORDER - 1 - k : BLOCK - 1 - k]
    r[:, LPC_ORDER:] -= guess >> LPC_SHIFT
    return c, r


def _rice(u: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(parameter of each partition, bits of all) for folded residuals; the warm-up samples are no codes."""
    v = u.copy()
    v[:, :order] = 0
    v = v.reshape(len(u), PARTS, -1)
    n = np.full(PARTS, v.shape[2])
    n[0] -= order
    k = np.clip(np.floor(np.log2(np.maximum(v.sum(2) / n * 0.7, 1.0))), 0, 14).astype(np.int32)
    bits = (v >> k[:, :, None]).sum(2) + n * (k + 1) + 4
    return k, bits.sum(1) + 6 + 8 * order


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, whose length is a positive multiple of 576."""
    counts = [len(p) // BLOCK for p in payloads]
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    s = raw.astype(np.int32).reshape(-1, BLOCK) - 128
    n = len(s)
    one = s.copy()
    one[:, 1:] -= s[:, :-1]
    coefs, four = _lpc(s)
    made = [(0, _fold(s)), (1, _fold(one)), (LPC_ORDER, _fold(four))]
    tried = [_rice(u, order) for order, u in made]
    cost = np.stack([bits for _, bits in tried], 1)
    cost[:, 2] += 9 + LPC_ORDER * LPC_BITS
    kind = cost.argmin(1)  # 0, 1: fixed predictors; 2: linear; 3: verbatim; 4: constant
    size = cost[np.arange(n), kind]
    kind[size > 8 * BLOCK] = 3
    flat = (s == s[:, :1]).all(1)
    kind[flat] = 4
    size = np.where(kind == 3, 8 * BLOCK, np.where(kind == 4, 8, size)) + 8
    heads = [frame_header(i) for c in counts for i in range(c)]
    head = np.array([len(h) for h in heads])
    length = head + (size + 7) // 8 + 2
    start = np.concatenate([[0], np.cumsum(length)])
    field = _Bits(8 * int(start[-1]))
    at = 8 * (start[:-1] + head)
    field.put(at, np.array([0x10, 0x12, 0x40 | (LPC_ORDER - 1) << 1, 0x02, 0x00])[kind], 8)
    at = at + 8
    for k, width in ((3, BLOCK), (4, 1)):
        rows = np.flatnonzero(kind == k)
        if len(rows):
            field.put(at[rows][:, None] + 8 * np.arange(width), s[rows, :width] & 0xFF, 8)
    for k, (order, u) in enumerate(made):
        rows = np.flatnonzero(kind == k)
        if not len(rows):
            continue
        p = at[rows]
        if order:
            field.put(p[:, None] + 8 * np.arange(order), s[rows, :order] & 0xFF, 8)
        p = p + 8 * order
        if k == 2:
            field.put(p, np.full(len(rows), (LPC_BITS - 1) << 5 | LPC_SHIFT), 9)
            field.put(p[:, None] + 9 + LPC_BITS * np.arange(order), coefs[rows] & ((1 << LPC_BITS) - 1), LPC_BITS)
            p = p + 9 + LPC_BITS * order
        field.put(p, np.full(len(rows), 2), 6)
        p = p + 6
        param = tried[k][0][rows]
        wide = BLOCK // PARTS
        for part in range(PARTS):
            value = u[rows, max(part * wide, order) : (part + 1) * wide]
            par = param[:, part : part + 1]
            field.put(p, par[:, 0], 4)
            high = value >> par
            ends = p[:, None] + 4 + np.cumsum(high + 1 + par, 1)
            field.bits[ends - par - 1] = 1
            for b in range(int(par.max(initial=0))):
                on = par > b
                spot, bit = np.broadcast_to(on, value.shape), (value >> b) & 1
                field.bits[(ends - 1 - b)[spot]] = bit[spot]
            p = ends[:, -1]
    data = np.packbits(field.bits)
    joined = np.frombuffer(b"".join(heads), np.uint8)
    data[np.arange(len(joined)) + np.repeat(start[:-1] - (np.cumsum(head) - head), head)] = joined
    check = crc16(data, start[:-1], start[1:] - 2)
    data[start[1:] - 2], data[start[1:] - 1] = check >> 8, check & 0xFF
    out, first = [], 0
    body = data.tobytes()
    for payload, c in zip(payloads, counts, strict=True):
        a, z = int(start[first]), int(start[first + c])
        frames = length[first : first + c]
        digest = hashlib.md5(bytes(payload).translate(_FLIP), usedforsecurity=False).digest()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(frames.min()).to_bytes(3) + int(frames.max()).to_bytes(3)
        info += (RATE << 44 | 7 << 36 | len(payload)).to_bytes(8) + digest
        points = np.empty(c, [("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
        points["sample"], points["offset"], points["size"] = BLOCK * np.arange(c), start[first : first + c] - a, BLOCK
        seek = points.tobytes()
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3) + info + b"\x83" + len(seek).to_bytes(3) + seek + body[a:z])
        first += c
    return out


#: Sample bytes from payload bytes and back: unsigned with an offset of 128 against two's complement.
_FLIP = bytes(i ^ 0x80 for i in range(256))


class BadStream(ValueError):
    """The stream is not one that can be decoded, or a checksum is wrong."""


def _open(stream: bytes) -> tuple[int, int, bytes, np.ndarray | None]:
    """(where the frames begin, number of samples, MD5, offsets of the frames from there if all are in the seek table)"""
    if stream[:4] != b"fLaC" or len(stream) < 42:
        raise BadStream("no FLAC stream")
    at, last, total, digest, seek = 4, False, -1, b"", None
    while not last:
        if at + 4 > len(stream):
            raise BadStream("metadata is cut off")
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4])
        block, at = stream[at + 4 : at + 4 + size], at + 4 + size
        if kind == 0:
            packed = int.from_bytes(block[10:18])
            total, digest = packed & 0xFFFFFFFFF, block[18:34]
            if (packed >> 41) & 7 or (packed >> 36) & 31 != 7:
                raise BadStream("not mono with 8 bits")
        elif kind == 3:
            points = np.frombuffer(block, [("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
            sums = np.concatenate([[0], np.cumsum(points["size"].astype(np.int64))])
            if len(points) and (points["sample"].astype(np.int64) == sums[:-1]).all():
                seek = (points["offset"].astype(np.int64), int(sums[-1]))
    if total < 0:
        raise BadStream("no stream information")
    return at, total, digest, seek[0] if seek and seek[1] == total else None


def _header(data: bytes, at: int) -> tuple[int, int]:
    """(block size, length) of the frame header at `at`."""
    if data[at : at + 2] != b"\xff\xf8" and data[at : at + 2] != b"\xff\xf9":
        raise BadStream("no frame header")
    lead = data[at + 4]
    z = at + 5 + (0 if lead < 0x80 else max(7 - (lead ^ 0xFF).bit_length(), 1))
    code, rate = data[at + 2] >> 4, data[at + 2] & 15
    if code in (6, 7):
        block = int.from_bytes(data[z : z + code - 5]) + 1
        z += code - 5
    else:
        block = BLOCK_SIZES.get(code, 0)
    z += 1 if rate == 12 else 2 if rate in (13, 14) else 0
    if not block or data[at + 3] >> 4 or (data[at + 3] >> 1) & 7 not in (0, 1):
        raise BadStream("frame kind not supported")
    if crc8(data[at:z]) != data[z]:
        raise BadStream("header checksum")
    return block, z + 1 - at


def _scan(data: bytes, at: int) -> list[int]:
    """Where frames start, found by sync codes with a valid header whose span up to the next has a valid CRC-16."""
    spots = []
    k = data.find(b"\xff\xf8", at)
    while k >= 0:
        try:
            _header(data, k)
            spots.append(k)
        except (BadStream, IndexError):
            pass
        k = data.find(b"\xff\xf8", k + 1)
    raw = np.frombuffer(data, np.uint8)
    found, i = [], 0
    while i < len(spots):
        for j in range(i + 1, len(spots) + 1):
            z = spots[j] if j < len(spots) else len(data)
            if z - spots[i] > 2 and int(crc16(raw, np.array([spots[i]]), np.array([z - 2]))[0]) == int.from_bytes(data[z - 2 : z]):
                found.append(spots[i])
                i = j
                break
        else:
            raise BadStream("frame checksum")
    return found


class _Reader:
    """Bits of a buffer, read at many places at once."""

    def __init__(self, data: np.ndarray) -> None:
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        w = padded.astype(np.uint32)
        self.words = (w[:-3] << 24) | (w[1:-2] << 16) | (w[2:-1] << 8) | w[3:]
        bits = np.unpackbits(padded)
        place = np.where(bits, np.arange(len(bits), dtype=np.int32), np.int32(len(bits)))
        self.one = np.minimum.accumulate(place[::-1])[::-1]

    def get(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Numbers of `width` bits, at most 25."""
        x = (self.words[at >> 3] << (at & 7).astype(np.uint32)).astype(np.int64)
        return (x >> (32 - width)).astype(np.int32)

    def signed(self, at: np.ndarray, width: int) -> np.ndarray:
        x = self.get(at, width)
        return x - ((x >> (width - 1)) << width)


def _residuals(bits: _Reader, at: np.ndarray, rows: np.ndarray, block: int, order: int, out: np.ndarray) -> None:
    """Rice coded residuals of the frames `rows`, whose coding begins at `at`, into out[rows, order:block]."""
    lead = bits.get(at, 6)
    for code in np.unique(lead).tolist():
        if code >> 4 > 1:
            raise BadStream("residual coding")
        own = np.flatnonzero(lead == code)
        p, wide = at[own] + 6, 5 if code >> 4 else 4
        parts = 1 << (code & 15)
        if block % parts or block // parts < order:
            raise BadStream("partition order")
        made = np.empty((len(own), block), np.int32)
        for part in range(parts):
            k = bits.get(p, wide).astype(np.int64)
            p = p + wide
            escaped = k == (1 << wide) - 1
            raw = np.where(escaped, bits.get(p, 5), 0).astype(np.int64)
            p = p + 5 * escaped
            for i in range(max(part * (block // parts), order), (part + 1) * (block // parts)):
                stop = bits.one[p].astype(np.int64)
                q = stop + 1
                u = (((stop - p) << np.minimum(k, 30)) | np.where(k > 0, bits.get(q, np.maximum(k, 1)), 0)).astype(np.int64)
                value = (u >> 1) ^ -(u & 1)
                p_next = q + k
                if escaped.any():
                    x = np.where(raw > 0, bits.get(p, np.maximum(raw, 1)), 0).astype(np.int64)
                    x = x - ((x >> np.maximum(raw - 1, 0)) << raw)
                    value, p_next = np.where(escaped, x, value), np.where(escaped, p + raw, p_next)
                made[:, i] = value
                p = np.minimum(p_next, len(bits.one) - 64)
        out[rows[own], order:block] = made[:, order:]


def _subframes(data: np.ndarray, at: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Samples (frames x largest block) of the subframes whose headers are at the bytes `at`."""
    bits = _Reader(data)
    kind = data[at].astype(np.int64)
    out = np.zeros((len(at), int(block.max(initial=0))), np.int32)
    for key in np.unique(kind * 65536 + block - 1).tolist():
        head, n = key // 65536, key % 65536 + 1
        rows = np.flatnonzero((kind == head) & (block == n))
        p = 8 * (at[rows] + 1).astype(np.int64)
        form = head >> 1
        if head & 0x81:
            raise BadStream("subframe header")
        if form == 0:
            out[rows, :n] = bits.signed(p, 8)[:, None]
        elif form == 1:
            out[rows, :n] = bits.signed(p[:, None] + 8 * np.arange(n), 8)
        elif 8 <= form <= 12 or form >= 32:
            order = form - 31 if form >= 32 else form - 8
            out[rows, :order] = bits.signed(p[:, None] + 8 * np.arange(order), 8)
            p = p + 8 * order
            if form < 32:
                _residuals(bits, p, rows, n, order, out)
                s = out[rows, :n]
                # warm-up samples become residuals too, of lower orders; then a running sum for each order
                for k in range(order):
                    s[:, k + 1 : order] = np.diff(s[:, k:order], axis=1)
                for k in reversed(range(order)):
                    s[:, k:] = np.cumsum(s[:, k:], axis=1)
                out[rows, :n] = s
            else:
                spec = bits.get(p, 9)
                if len(np.unique(spec)) > 1:
                    sets = [rows[spec == v] for v in np.unique(spec).tolist()]
                    for own in sets:
                        out[own, :n] = _subframes(data, at[own], block[own])[:, :n]
                    continue
                wide, shift = int(spec[0] >> 5) + 1, int(spec[0] & 31)
                coefs = bits.signed(p[:, None] + 9 + wide * np.arange(order), wide).astype(np.int64)
                _residuals(bits, p + 9 + wide * order, rows, n, order, out)
                s = np.ascontiguousarray(out[rows, :n].T).astype(np.int64)
                for i in range(order, n):
                    guess = coefs[:, 0] * s[i - 1]
                    for k in range(1, order):
                        guess += coefs[:, k] * s[i - 1 - k]
                    s[i] += guess >> shift
                out[rows, :n] = s.T
        else:
            raise BadStream("subframe kind")
    return out


def decode(streams: list[bytes | None]) -> list[tuple[bytes, np.ndarray] | None]:
    """(payload, sample offset of every frame and of the end) of each stream; None where there is none or it is bad."""
    a: list[int] = []
    z: list[int] = []
    where: list = []
    base = 0
    for stream in streams:
        try:
            if stream is None:
                raise BadStream("null")
            at, total, digest, seek = _open(stream)
            starts = (seek + at).tolist() if seek is not None else _scan(stream, at)
            heads = [_header(stream, k) for k in starts]
            where.append((len(a), len(starts), total, digest, heads))
            a += [base + k for k in starts]
            z += [base + k for k in [*starts[1:], len(stream)]]
        except (BadStream, IndexError):
            where.append(None)
        base += len(stream or b"")
    data = np.frombuffer(b"".join(s or b"" for s in streams), np.uint8)
    start, end = np.array(a, np.int64), np.array(z, np.int64)
    good = end - start > 8
    good[good] &= crc16(data, start[good], end[good] - 2) == data[end[good] - 2].astype(np.uint32) * 256 + data[end[good] - 1]
    size = np.array([b for w in where if w for b, _ in w[4]], np.int64)
    skip = np.array([h for w in where if w for _, h in w[4]], np.int64)
    samples = np.zeros((len(start), int(size.max(initial=0))), np.int32)
    rows = np.flatnonzero(good)
    if len(rows):
        try:
            samples[rows, : int(size[rows].max())] = _subframes(data, start[rows] + skip[rows], size[rows])
        except BadStream:
            for r in rows.tolist():
                try:
                    samples[r, : size[r]] = _subframes(data, start[r : r + 1] + skip[r], size[r : r + 1])[0, : size[r]]
                except BadStream:
                    good[r] = False
    out: list = []
    for w in where:
        if w is None or not good[w[0] : w[0] + w[1]].all():
            out.append(None)
            continue
        first, n, total, digest, _ = w
        ends = np.concatenate([[0], np.cumsum(size[first : first + n])])
        if n and (size[first : first + n] == samples.shape[1]).all():
            signed = samples[first : first + n].astype(np.int8).tobytes()
        else:
            signed = b"".join(samples[r, : size[r]].astype(np.int8).tobytes() for r in range(first, first + n))
        right = len(signed) == total and (digest == bytes(16) or hashlib.md5(signed, usedforsecurity=False).digest() == digest)
        out.append((signed.translate(_FLIP), ends) if right else None)
    return out
