"""Substring dedup with a count-min prefilter (op5).

Windows of k consecutive words are counted in a merged count-min sketch, once for each
document.  The sketch overestimates, so a window that is not estimated to be in two
documents surely is not.  Only the others go, packed, to buckets, where the smallest
document of each is found exactly; blocks of documents get the answers and remove words.
Windows are known by 64-bit hashes of their words.
"""

from __future__ import annotations

import hashlib
import struct
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch, store
from .text import SLICE, Words, in_order, pack_sorted, ranges, small, splits, unpack_sorted

#: Words of a window.
WINDOW = 13


class Windows:
    """The windows of a block: where they begin, their hashes and texts."""

    def __init__(self, words: Words, k: int):
        self.first, self.hash = words.windows(k)
        self.text = np.repeat(np.arange(len(words.offsets) - 1, dtype=np.int32), np.maximum(0, words.counts() - (k - 1)))

    def distinct(self, block: store.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the distinct windows that some row with an id has, ascending; the smallest id of each, and whether another id has it."""
        keys, lows, more = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for some in ranges(self.hash.view(np.uint32)[1 if sys.byteorder == "little" else 0 :: 2], 1 << 32):
            h = self.hash[some]
            if not len(h):
                continue
            order = in_order(h)
            h, text = h[order], self.text[some][order]
            at = splits(h)
            # windows of rows without an id remove nothing and are no reason to remove
            ids, null = block.ids[text], block.null[text]
            low = np.minimum.reduceat(np.where(null, np.iinfo(np.int64).max, ids), at)
            high = np.maximum.reduceat(np.where(null, np.iinfo(np.int64).min, ids), at)
            named = low <= high
            keys.append(h[at][named])
            lows.append(low[named])
            more.append((high > low)[named])
        return np.concatenate(keys), np.concatenate(lows), np.concatenate(more)


def _smallest(members: list[tuple]):
    """Bucket side: for each sent window (block, whether another id has it, and the smallest id)."""
    keys, lows, more = [], [], []
    for _, data in members:
        n, base, code = struct.unpack_from("<Iqc", data)
        at, kind = 13, np.dtype("u" + code.decode())
        lows.append(np.frombuffer(data, kind, n, at).astype(np.int64) + base)
        at += n * kind.itemsize
        more.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n).astype(bool))
        keys.append(unpack_sorted(data[at + -(-n // 8) :]))
    key, low = np.concatenate(keys), np.concatenate(lows)
    order = in_order(key)
    at = splits(key[order])
    least = np.minimum.reduceat(low[order], at)
    smallest = np.empty(len(key), np.int64)
    smallest[order] = np.repeat(least, np.diff(np.r_[at, len(key)]))
    useful = np.concatenate(more) | (smallest < low)
    i = 0
    for (block, _), k in zip(members, keys, strict=True):
        on, found = useful[i : i + len(k)], smallest[i : i + len(k)]
        if on.any():
            base = int(found[on].min())
            ids = small((found[on] - base).view(np.uint64))
            yield block, struct.pack("<qc", base, ids.dtype.str[2:].encode()) + np.packbits(on).tobytes() + ids.tobytes()
        i += len(k)


def _ids(reply: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of n sent windows, which got an answer, and the smallest ids of those."""
    base, code = struct.unpack_from("<qc", reply)
    on = np.unpackbits(np.frombuffer(reply, np.uint8, -(-n // 8), 9), count=n).astype(bool)
    return on, np.frombuffer(reply, np.dtype("u" + code.decode()), -1, 9 + -(-n // 8)).astype(np.int64) + base


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, depth: int = sketch.DEPTH, whole_rows: bool = False, block_bytes: int = store.BLOCK_BYTES) -> DataFrame:
    """Remove every word covered by a window that also starts in a document with a smaller id.

    Windows are judged on the input.  Returns id_col, n_words, n_removed, kept_sha256 (of the
    kept words joined by one space).  With whole_rows returns docs itself, with the text that is
    left: unchanged where nothing is removed, else the stretches of kept words, as they stood,
    joined by one space.

    Null texts have no words.  Rows with a null id lose nothing and cause no removal.  Rows
    that share an id are one document for the comparison: none causes removal in another.
    Extra columns are ignored.  An empty table gives an empty result.  A text of any length is
    one part of one block, so the longest must fit a task's memory.
    """
    spark = docs.sparkSession
    table = store.blocks(docs, id_col, text_col, block_bytes, whole_rows=whole_rows)
    _, size = store.corpus_size(table)
    buckets = 2 * store.bucket_count(size)  # windows are more than other keys

    def count(block):
        # neither words nor windows are held while their keys are packed
        key, _, more = Windows(block.words(), window).distinct(block)
        yield from sketch.emit(key, more, buckets, depth)

    def candidates(block, windows):
        """Of the distinct windows those estimated repeated: hash, smallest id, whether another id has it."""
        key, low, more = windows.distinct(block)
        windows = None
        ok = sketch.repeated(key, store.answers_of(sketched, block.block), buckets, depth)
        return key[ok], low[ok], more[ok]

    def emit(block):
        key, low, more = candidates(block, Windows(block.words(), window))
        found, cut = store.cuts(key, buckets)
        for b, x, y in zip(found.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            base = int(low[x:y].min())
            ids = small((low[x:y] - base).view(np.uint64))
            yield b, struct.pack("<Iqc", y - x, base, ids.dtype.str[2:].encode()) + ids.tobytes() + np.packbits(more[x:y]).tobytes() + pack_sorted(key[x:y])

    sketched, _ = store.ask(table, count, lambda _, m: sketch.merge(m), size, "sketch")
    path, _ = store.ask(table, emit, lambda _, m: _smallest(m), size, "repeats")

    names = docs.columns
    schema = f"{id_col} long, n_words long, n_removed long, kept_sha256 string"

    def apply(block, replies):
        words = block.words()
        gone = np.zeros(len(words.hash) + 1, np.int32)
        if replies:
            w = Windows(words, window)
            key, _, _ = candidates(block, w)
            found, cut = store.cuts(key, buckets)
            each = [(key[x:y], *_ids(replies[b], y - x)) for b, x, y in zip(found.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True) if b in replies]
            known, ids = np.concatenate([k[on] for k, on, _ in each]), np.concatenate([i for *_, i in each])
            for a in range(0, len(w.hash) if len(known) else 0, SLICE):
                h, first, text = w.hash[a : a + SLICE], w.first[a : a + SLICE], w.text[a : a + SLICE]
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = (known[at] == h) & (ids[at] < block.ids[text]) & ~block.null[text]
                gone[first[hit]] += 1  # a window begins at one word, so no place is twice in here
                gone[first[hit] + window] -= 1
            del w, key, known, ids
        np.cumsum(gone, out=gone)
        gone = gone[:-1] > 0
        words.hash = None
        n_words = words.counts()
        total = np.zeros(len(gone) + 1, np.int32)
        np.cumsum(gone, out=total[1:])
        removed = total[words.offsets[1:]] - total[words.offsets[:-1]]
        del total
        raw = memoryview(block.raw)
        if whole_rows:
            yield block.restored(names, id_col, text_col, np.arange(len(n_words)), [_left(words, gone, raw, block.at, i, removed[i]) for i in range(len(n_words))])
            return
        digests = []
        for i in range(len(n_words)):
            a, b = words.offsets[i], words.offsets[i + 1]
            if removed[i]:
                kept = np.flatnonzero(~gone[a:b]) + a
                parts = [raw[x:y] for x, y in zip(words.start[kept].tolist(), words.end[kept].tolist(), strict=True)]
            else:
                parts = bytes(raw[block.at[i] : block.at[i + 1]]).split()
            digests.append(hashlib.sha256(b" ".join(parts)).hexdigest())
        yield store.columns_batch([pa.array(block.ids, mask=block.null), n_words.astype(np.int64), removed.astype(np.int64), digests], schema)

    def run(batches):
        some = False
        for row in store.rows(batches):
            block = store.Block(row)
            some = True
            yield from apply(block, store.answers_of(path, block.block))
            del block
        store.lean()
        if not some and not whole_rows:
            yield store.to_batch([], schema)

    done = table.mapInArrow(run, store.restored_schema(docs, id_col) if whole_rows else schema)
    return done.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in docs.schema]) if whole_rows else done


def _left(words: Words, gone: np.ndarray, raw: memoryview, at: np.ndarray, i: int, removed: int) -> str:
    """What is left of text i."""
    if not removed:
        return str(raw[at[i] : at[i + 1]], "utf-8")
    kept = np.flatnonzero(~gone[words.offsets[i] : words.offsets[i + 1]]) + words.offsets[i]
    if not len(kept):
        return ""
    first = kept[np.r_[True, np.diff(kept) > 1]]
    last = kept[np.r_[np.diff(kept) > 1, True]]
    return b" ".join([raw[x:y] for x, y in zip(words.start[first].tolist(), words.end[last].tolist(), strict=True)]).decode()
