"""``ph`` of many numbered or prefixed keys at once, for Arrow functions."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(np.sin(i + 1.0)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def ph_numbered(prefix: str, first: int, last: int) -> np.ndarray:
    """``ph(prefix || j)`` for every j from ``first`` up to, not including, ``last``."""
    out = [np.zeros(0, np.int64)]
    while first < last:
        width = len(str(first))
        stop = min(last, 10**width)
        out.append(_same_width(prefix.encode(), np.arange(first, stop), width))
        first = stop
    return np.concatenate(out)


def _same_width(head: bytes, j: np.ndarray, width: int) -> np.ndarray:
    """Numbers of one width give messages of one length: a single block of MD5, column by column."""
    size = len(head) + width
    if size > 55:
        return np.array([int(hashlib.md5(head + b"%d" % x).hexdigest()[:15], 16) for x in j.tolist()], np.int64)
    block = (head + b"\0" * width + b"\x80").ljust(56, b"\0") + (8 * size).to_bytes(8, "little")
    words: list = list(np.frombuffer(block, "<u4").astype(np.uint32))
    rest = j.astype(np.uint32) if j[-1] < 2**32 else j
    for at in range(size - 1, len(head) - 1, -1):
        rest, digit = np.divmod(rest, rest.dtype.type(10))
        words[at // 4] = words[at // 4] + ((digit.astype(np.uint32) + np.uint32(48)) << np.uint32(8 * (at % 4)))
    return _first_60_bits(words, len(j))


def _first_60_bits(words: list, n: int) -> np.ndarray:
    """The first 15 hex digits of the MD5 of n single blocks, given by their 16 words: arrays, or numbers all blocks share."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, spare = np.empty((2, n), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(64):
            if i < 16:
                g = i
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif i < 32:
                g = (5 * i + 1) % 16
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
            elif i < 48:
                g = (3 * i + 5) % 16
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:
                g = 7 * i % 16
                np.invert(d, out=f)
                f |= b
                f ^= c
            f += a
            if isinstance(words[g], np.ndarray):
                f += words[g]
                f += np.uint32(_SINES[i])
            else:
                f += np.uint32((int(words[g]) + _SINES[i]) % 2**32)
            s = _SHIFTS[i // 16][i % 4]
            np.left_shift(f, np.uint32(s), out=spare)
            f >>= np.uint32(32 - s)
            spare |= f
            spare += b
            a, d, c, b, spare = d, c, b, spare, a
        a += np.uint32(_START[0])
        b += np.uint32(_START[1])
    return (a.byteswap().astype(np.int64) << 28) | (b.byteswap() >> np.uint32(4))


#: Keys hashed at a time: their words stay in a core's cache.
BLOCK = 1 << 14


def ph_prefixed(prefixes: Sequence[str], keys: pa.StringArray) -> list[np.ndarray]:
    """``ph(prefix || key)`` of every key without nulls, for each prefix."""
    parts = [_prefixed([p.encode() for p in prefixes], keys.slice(i, BLOCK)) for i in range(0, len(keys), BLOCK)]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(len(prefixes))]


def _prefixed(prefixes: list[bytes], keys: pa.StringArray) -> list[np.ndarray]:
    n = len(keys)
    ends = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + n + 1]
    data = np.frombuffer(keys.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    sizes = np.diff(ends)
    most = max(len(p) for p in prefixes) + int(sizes.max())
    if most > 55:
        texts = [x.encode() for x in keys.to_pylist()]
        return [np.array([int(hashlib.md5(p + x).hexdigest()[:15], 16) for x in texts], np.int64) for p in prefixes]
    out, blocks, at = [], None, None
    for p in prefixes:
        if at != len(p):
            at, blocks = len(p), np.zeros((n, 64), np.uint8)
            if sizes.min() == sizes.max():
                blocks[:, at : at + sizes[0]] = data.reshape(n, -1)
            else:
                row = np.repeat(np.arange(n) * 64 + at - (ends[:-1] - ends[0]), sizes)
                blocks.reshape(-1)[row + np.arange(len(data))] = data
            blocks.reshape(-1)[np.arange(n) * 64 + at + sizes] = 0x80
            blocks.view("<u8")[:, 7] = 8 * (at + sizes)
        blocks[:, :at] = np.frombuffer(p, np.uint8)
        out.append(_first_60_bits(list(np.ascontiguousarray(blocks.view("<u4").T)), n))
    return out
