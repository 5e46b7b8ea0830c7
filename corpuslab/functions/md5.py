"""md5 of many short keys at once, on arrays: a call for each key takes several times as long."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

# Fixed values of RFC 1321.
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_PLACES = [*range(16)] + [(5 * i + 1) % 16 for i in range(16)] + [(3 * i + 5) % 16 for i in range(16)] + [7 * i % 16 for i in range(16)]
_MASK = 0xFFFFFFFF

#: Keys in a run have the same digits but for the last so many, at most 5.
RUN_DIGITS = 5


def _digits(n: int) -> np.ndarray:
    """The numbers of ``n`` digits, from 0...0 on, as bytes of a little-endian number."""
    j, out = np.arange(10**n, dtype=np.uint64), np.zeros(10**n, np.uint64)
    for k in range(n):
        out |= (j // np.uint64(10 ** (n - 1 - k)) % np.uint64(10) + np.uint64(ord("0"))) << np.uint64(8 * k)
    return out


def _runs(first: int, last: int) -> Iterator[tuple[int, str, int, int, int]]:
    """Numbers from ``first`` to before ``last`` as runs (number, leading digits, count of the others, their first, their end)."""
    step = 10**RUN_DIGITS
    while first < last:
        if first < step:
            n = len(str(first))
            end, head, start = min(last, 10**n), "", 0
        else:
            n, start = RUN_DIGITS, first // step * step
            end, head = min(last, start + step), str(first // step)
        yield first, head, n, first - start, end - start
        first = end


def _head(words: list[int], arrays: dict[int, np.ndarray], size: int) -> np.ndarray:
    """The first word of the md5 of one-block messages: word ``k`` is ``words[k] + arrays[k]``. Its last change is in
    step 61 of 64."""
    a, b, c, d = (np.full(size, x, np.uint32) for x in _START)
    t, u = np.empty(size, np.uint32), np.empty(size, np.uint32)
    for i in range(61):
        if i < 16:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
        elif i < 32:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=t)
            t ^= d
        else:  # c ^ (b | ~d)
            np.invert(d, out=t)
            t |= b
            t ^= c
        k = _PLACES[i]
        t += a
        t += np.uint32((_SINES[i] + words[k]) & _MASK)
        if k in arrays:
            t += arrays[k]
        np.left_shift(t, np.uint32(_SHIFTS[i]), out=u)
        t >>= np.uint32(32 - _SHIFTS[i])
        t |= u
        t += b
        a, b, c, d, t = d, t, b, c, a
    b += np.uint32(_START[0])
    return b


def md5_heads(prefix: str, first: int, last: int, tables: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """The first 8 hex digits of ``md5(prefix || j)``, as numbers, for ``j`` from ``first`` to before ``last``.
    ``tables``: kept by the caller, what further calls need too."""
    out = np.empty(max(0, last - first), np.uint32)
    tables = {} if tables is None else tables
    for j, head, n, start, end in _runs(first, last):
        lead = (prefix + head).encode()
        length = len(lead) + n
        if length > 55:
            raise ValueError(f"no key of one block: {prefix}{j}")
        block = lead + bytes(n) + b"\x80" + bytes(55 - length) + (8 * length).to_bytes(8, "little")
        words = [int.from_bytes(block[k:k + 4], "little") for k in range(0, 64, 4)]
        k, byte = divmod(len(lead), 4)
        if n not in tables:
            tables[n] = _digits(n)
        digits = tables[n][start:end] << np.uint64(8 * byte)
        arrays = {k: digits.astype(np.uint32)}
        if byte + n > 4:
            arrays[k + 1] = (digits >> np.uint64(32)).astype(np.uint32)
        out[j - first:j - first + end - start] = _head(words, arrays, end - start)
    return out.byteswap(inplace=True)
