"""Vectorised work on the UTF-8 bytes of many texts at once (runs inside Arrow tasks)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
#: Longer words are hashed whole, one by one.
LONG = 256

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of a 64-bit hash (murmur3 constants); a bijection."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * np.uint64(0x9FB21C651E98DF25) + np.uint64(0x2545F4914F6CDD1D) + b)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64 = _BASE):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            size = max(n, CHUNK_BYTES + 1)
            with np.errstate(over="ignore"):
                self.up, self.down = (np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64)))) for b in (self.base, self.inverse))


class Rolling:
    """Hashes of short substrings of ``data`` from one prefix sum: sum of byte times base to minus its place.

    A polynomial modulo 2**64 is only trusted below some 1,000 bytes, and where a false match is found
    out later by the bytes themselves or costs no more than a wrong neighbour.
    """

    def __init__(self, data: np.ndarray, powers: Powers):
        n = len(data)
        powers.grow(n + 1)
        self.powers = powers
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers.down[:n], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.powers.up[start])

    def windows(self, size: int) -> np.ndarray:
        """Hash of the ``size`` bytes from every place that has so many."""
        n = len(self.prefix) - 1
        if n < size:
            return np.zeros(0, np.uint64)
        return mix((self.prefix[size:] - self.prefix[: n + 1 - size]) * self.powers.up[: n + 1 - size])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes each, or one longer row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes and the length of each span, eight bytes at a time; spans over LONG bytes by BLAKE2.

    Every step mixes before the next one, so no sum or polynomial of bytes decides: texts built to
    defeat a polynomial modulo 2**64 are told apart.
    """
    size = end - start
    padded = np.zeros((len(data) + 23) // 8 * 8, np.uint8)
    padded[: len(data)] = data
    lanes = padded.view("<u8")
    h = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live, k = np.flatnonzero(size <= LONG), 0
    while len(live):
        at = start[live] + k
        low = ((at & 7) << 3).astype(np.uint64)
        value = lanes[at >> 3] >> low
        value |= np.where(low > 0, lanes[(at >> 3) + 1] << ((np.uint64(64) - low) & np.uint64(63)), np.uint64(0))
        h[live] = combine(h[live], value & _MASK[np.minimum(size[live] - k, 8)])
        k += 8
        live = live[size[live] > k]
    for i in np.flatnonzero(size > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return h


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) words between white space: (row, start, end, hash), in text order. Words never cross rows."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~_SPACE[data]
    first, last = solid[1:] & ~solid[:-1], ~solid[1:] & solid[:-1]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    joined = inner[solid[inner] & solid[inner + 1]]  # a row ends and the next begins without white space
    first[joined] = last[joined] = True
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    row = np.searchsorted(offsets, start, side="right") - 1
    return row, start, end, hash_spans(_LOWER[data], start, end)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Each row's sorted distinct hashes of ``width`` consecutive words; a shorter row with words has its whole sequence as one."""
    row, _, _, h = words(data, offsets)
    rows = len(offsets) - 1
    bounds = np.searchsorted(row, np.arange(rows + 1))
    seq = h
    for k in range(1, width):
        if len(seq) > 1:
            seq = combine(seq[: len(h) - k], h[k:]) if len(h) > k else seq[:0]
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(seq[a : b - width + 1]))
        elif b > a:
            one = h[a : a + 1]
            for k in range(a + 1, b):
                one = combine(one, h[k : k + 1])
            out.append(combine(one, np.array([b - a], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
