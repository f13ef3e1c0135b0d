"""Vectorised word splitting and hashing over Arrow text buffers.

A word is ``[^\\x20\\x09-\\x0D]+`` on the UTF-8 bytes.  All functions work on a whole
batch of texts at once; nothing here loops over words or rows.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

_SEED = np.random.default_rng(20240601)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_P = np.uint64(0xD6E8FEB86659FD93)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SEGMENT = 1 << 18
#: Numbers of a long array that are worked on at once where that needs several arrays as long.
SLICE = 1 << 17
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every input bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_P), -1, 2**64))
        up, down = np.full(n, _P), np.full(n, inverse)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string or binary array; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Words:
    """The words of a batch: byte spans, hashes, and where each text's words begin."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, lower: bool = False):
        self.raw, self.at = raw, at
        solid = ~_SPACE[raw]
        first = solid.copy()
        if len(raw):
            first[1:] &= ~solid[:-1]
            last = solid.copy()
            last[:-1] &= ~solid[1:]
            edge = at[:-1][at[:-1] < len(raw)]
            first[edge] = solid[edge]
            edge = edge[edge > 0] - 1
            last[edge] = solid[edge]
            self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        solid = first = last = None  # not held while words are hashed
        self.hash = self._hash(_BYTE_LOWER if lower else _BYTE)
        self.offsets = np.searchsorted(self.start, at)

    def _hash(self, table: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(out):
            a = self.start[i]
            j = max(int(np.searchsorted(self.end, a + _SEGMENT, "right")), i + 1)
            b = self.end[j - 1]
            up, down = powers(max(_SEGMENT, int(b - a)))
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum(table[self.raw[a:b]] * up[: b - a], out=total[1:])
            s, e = self.start[i:j] - a, self.end[i:j] - a
            out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _ODD)
            i = j
        return out

    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.offsets)

    def of(self) -> np.ndarray:
        """For each word, the number of its text in the batch."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words (as positions) and hashes of all k-word windows inside one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        inside = np.ones(n, bool)
        for j in range(1, k):  # the j-th word from a text's end begins none
            at = self.offsets[1:] - j
            at = at[at >= self.offsets[:-1]]
            inside[at[at < n]] = False
        h = np.empty(int(np.count_nonzero(inside)), np.uint64)
        done = 0
        for a in range(0, n, SLICE):
            b = min(a + SLICE, n)
            some = chain([self.hash[a + j : b + j] for j in range(k)])[inside[a:b]]
            h[done : done + len(some)] = some
            done += len(some)
        return np.flatnonzero(inside), h


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of sequences of hashes; parts[j] has the j-th item of every sequence."""
    h = np.full(len(parts[0]), len(parts), np.uint64) * _ODD
    for x in parts:
        h *= _Q
        h += x
    return mix(h)


def second(h: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of hashed items, for a given salt."""
    return mix(h * _ODD + np.uint64((salt * 0x2545F4914F6CDD1D + 0x5851F42D4C957F2D) % 2**64))


def splits(sorted_keys: np.ndarray) -> np.ndarray:
    """Positions where runs of equal sorted keys begin."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])


def in_order(x: np.ndarray) -> np.ndarray:
    """Places of uint64 numbers in ascending order, equal ones in the order of their places.

    The numbers' high bits are sorted with their places in the low bits, which is several times
    faster than sorting places; where that leaves different numbers unordered, places are sorted.
    """
    bits = np.uint64(max(1, (len(x) - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    fits = not len(x) or x.max() >> (np.uint64(64) - bits) == 0  # all of a number
    # one array, changed in place: callers sort what is large for a task
    both = x << bits if fits else x & ~low
    both |= np.arange(len(x), dtype=np.uint64)
    both.sort()
    for a in range(0, 0 if fits else len(x) - 1, SLICE):
        some = both[a : a + SLICE + 1]
        full = x[(some & low).view(np.int64)]
        if ((some[1:] ^ some[:-1] <= low) & (full[1:] != full[:-1])).any():
            return np.argsort(x, kind="stable")
    both &= low
    return both.view(np.int64)


def ranges(x: np.ndarray, top: int):
    """Places of numbers from 0 to top - 1 by equal ranges of them, ascending: few enough numbers to sort at once.

    Within a range, places ascend.
    """
    parts = min(64, top, 1 + len(x) // SLICE)
    if parts == 1:
        yield slice(None)
        return
    part = np.empty(len(x), np.uint8)
    for a in range(0, len(x), SLICE):
        part[a : a + SLICE] = x[a : a + SLICE].astype(np.uint64) * np.uint64(parts) // np.uint64(top)
    for p in range(parts):
        yield np.flatnonzero(part == p)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct uint64 numbers, ascending, and for each place the number of its own among them."""
    order = in_order(x)
    ranked = x[order]
    first = np.ones(len(x), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    of = np.empty(len(x), np.int32)
    of[order] = np.cumsum(first, dtype=np.int32) - 1
    return ranked[first], of


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending uint64 numbers: low bits as they are, high bits as gaps in unary (Elias and Fano).

    About two bits more than log2(span / n) for each number, whatever the numbers.
    """
    if not len(x):
        return b""
    x = x.astype(np.uint64)
    base, n = int(x[0]), len(x)
    rest = x - x[0]
    low = max(0, (int(rest[-1]) // n).bit_length() - 1)
    whole, more = divmod(low, 8)
    high = (rest >> np.uint64(low)).astype(np.int64)
    unary = np.zeros(n + int(high[-1]), bool)
    unary[high + np.arange(n)] = True
    each = rest.astype("<u8").view(np.uint8).reshape(n, 8)
    planes = [np.packbits(each[:, whole] >> j & 1) for j in range(more)]
    return struct.pack("<QIB", base, n, low) + each[:, :whole].tobytes() + b"".join(p.tobytes() for p in planes) + np.packbits(unary).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    """The inverse of pack_sorted."""
    if not data:
        return np.zeros(0, np.uint64)
    base, n, low = struct.unpack_from("<QIB", data)
    (whole, more), at, width = divmod(low, 8), 13, -(-n // 8)
    each = np.zeros((n, 8), np.uint8)
    each[:, :whole] = np.frombuffer(data, np.uint8, n * whole, at).reshape(n, whole)
    at += n * whole
    for j in range(more):
        each[:, whole] |= np.unpackbits(np.frombuffer(data, np.uint8, width, at), count=n) << j
        at += width
    high = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, -1, at)))[:n] - np.arange(n)
    return each.view("<u8").reshape(n) + (high.astype(np.uint64) << np.uint64(low)) + np.uint64(base)


def small(x: np.ndarray) -> np.ndarray:
    """Non-negative integers in the smallest type that holds them."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def pack_counts(x: np.ndarray) -> bytes:
    """Non-negative integers, most of them small: a byte each, 255 standing for one of those listed at the end."""
    big = x >= 255
    return np.where(big, 255, x).astype(np.uint8).tobytes() + x[big].astype(np.int64).tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    """The inverse of pack_counts, for n numbers."""
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, np.int64, -1, n)
    return out
