"""A count-min sketch over hashed keys, merged from the sketches of blocks and asked by them.

Each row of the sketch has CELLS counters for every bucket of the corpus; a key adds one to the
counter that the row's hash picks.  A key's smallest counter never falls short of its count,
so "all counters reach two" keeps every key that does.  A block's own sketch is sparse: the
ascending numbers of the counters it touches, a range of them to each bucket.  The bucket
merges them and answers one bit for each; nothing is broadcast and nothing comes to the
driver, so the sketch is as wide for its keys in a large corpus as in a small one.
"""

from __future__ import annotations

import struct
import sys

import numpy as np

from . import store
from .text import SLICE, in_order, pack_sorted, ranges, second, splits, unpack_sorted

#: log2 of a row's counters for each bucket (about four for each window of its text), and rows.
CELL_BITS, DEPTH = 23, 2


def routed(keys: np.ndarray, row: int, buckets: int):
    """Of a block's distinct keys, by bucket: which ones touch counters of it in a row, ascending by counter, and their hashes.

    The keys are ascending hashes already; another row's hashes are put in order, a range at a time.
    """
    if not row:
        found, cut = store.cuts(keys, buckets)
        for b, x, y in zip(found.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield b, slice(x, y), keys[x:y]
        return
    hashes = np.empty(len(keys), np.uint64)
    for a in range(0, len(keys), SLICE):
        hashes[a : a + SLICE] = second(keys[a : a + SLICE], 1000 + row)
    # by the high half of a hash, as buckets are: no bucket's keys are in two ranges that lie apart
    high = hashes.view(np.uint32)[1 if sys.byteorder == "little" else 0 :: 2]
    held_bucket, held = -1, []
    for at in ranges(high, 1 << 32):
        h = hashes[at]
        order = in_order(h)
        places = order if isinstance(at, slice) else at[order]
        found, cut = store.cuts(h[order], buckets)
        for b, x, y in zip(found.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b != held_bucket and held:
                p = np.concatenate(held)
                yield held_bucket, p, hashes[p]
                held = []
            held_bucket = b
            held.append(places[x:y])
    if held:
        p = np.concatenate(held)
        yield held_bucket, p, hashes[p]


def _cells(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32 - CELL_BITS)


def emit(keys: np.ndarray, twice: np.ndarray, buckets: int, depth: int = DEPTH):
    """(bucket, payload) of a block: its distinct keys, ascending, and whether it has each more than once."""
    for row in range(depth):
        for b, at, h in routed(keys, row, buckets):
            yield row * buckets + b, struct.pack("<I", len(h)) + np.packbits(twice[at]).tobytes() + pack_sorted(_cells(h, buckets))


def merge(members: list[tuple]):
    """Bucket side: (block, a bit for each counter it sent: whether that reached two)."""
    cells, more = [], []
    for _, data in members:
        (n,) = struct.unpack_from("<I", data)
        more.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), 4), count=n).astype(bool))
        cells.append(unpack_sorted(data[4 + -(-n // 8) :]))
    every = np.concatenate(cells)
    order = in_order(every)
    at = splits(every[order])
    count = np.add.reduceat(1 + np.concatenate(more)[order].astype(np.int64), at)
    reached = np.empty(len(every), bool)
    reached[order] = np.repeat(count >= 2, np.diff(np.r_[at, len(every)]))
    i = 0
    for (block, _), c in zip(members, cells, strict=True):
        yield block, np.packbits(reached[i : i + len(c)]).tobytes()
        i += len(c)


def repeated(keys: np.ndarray, replies: dict[int, bytes], buckets: int, depth: int = DEPTH) -> np.ndarray:
    """For each of a block's keys: False only where it surely occurs once in the corpus."""
    ok = np.ones(len(keys), bool)
    for row in range(depth):
        for b, at, h in routed(keys, row, buckets):
            ok[at] &= np.unpackbits(np.frombuffer(replies[row * buckets + b], np.uint8), count=len(h)).astype(bool)
    return ok
