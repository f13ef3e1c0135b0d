"""Probabilistic suffix tree language model (op1).

Symbols are lower-cased words and one end of each text.  States are the empty context, and
contexts of up to ``depth`` symbols that occur often enough and pass a divergence test: the
mean log-ratio, with each occurrence left out in turn, of the state's smoothed next-symbol
distribution over that of its longest retained suffix.  Each state's distribution is its
counts with a prior of fixed weight spread as its parent's distribution; the empty context has
add-one counts, where every unknown word has the share of one new symbol.  A symbol is scored
by the longest retained suffix of what stands before it.

Counts cover all training texts.  Blocks of documents send their distinct n-grams to buckets
(by the whole n-gram, so no context is a hot key), a bucket answers with corpus-wide counts,
and each n-gram's contribution to the test is added by one block that holds it.  Single
symbols and pairs go together in one pass; longer n-grams only where their context is known
to be frequent enough, so each round is pruned exactly by the one before.  Texts are split and
hashed once, into blocks of numbers of symbols; these are passed over once for each symbol of
the depth and twice more.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import store
from .text import distinct, in_order, mix, pack_sorted, splits, unpack_counts, unpack_sorted

#: Most symbols of a context, least occurrences of one (alike at every size, so the model grows with
#: the corpus), weight of a parent's distribution, least divergence (nats per symbol).
DEPTH, LEAST, PRIOR, DIVERGENCE = 3, 2, 4.0, 0.3
#: Remainders of crc32(id) modulo FOLDS: the held-out one.
FOLDS, HELD_OUT = 7, 2
_END, _ODD = np.uint64(0x7B1D3F5A9C2E4680), np.uint64(0xC2B2AE3D27D4EB4F)


def is_held_out(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Whether the checksum of the id as text is in the held-out fold (a null id: of no text)."""
    return np.array([zlib.crc32(b"" if n else str(i).encode()) % FOLDS == HELD_OUT for i, n in zip(ids.tolist(), null, strict=True)], bool)


def add_up(members: list[tuple], totals: bool = False):
    """Bucket side of a count: (block, reply) with every key's total and whether the block speaks for it."""
    keys, counts, far = [], [], []
    for _, data in members:
        n, at = struct.unpack_from("<II", data)
        keys.append(unpack_sorted(data[8:at]))
        counts.append(data[at : at + n])
        far.append(data[at + n :])
    key = np.concatenate(keys)
    count = unpack_counts(b"".join(counts + far), len(key))
    order = in_order(key)
    at = splits(key[order])
    each = np.add.reduceat(count[order], at)
    total, speaks = np.empty(len(key), np.int64), np.zeros(len(key), bool)
    total[order] = np.repeat(each, np.diff(np.r_[at, len(key)]))
    speaks[order[at]] = True
    short, big, i, j = np.minimum(total, 255).astype(np.uint8).tobytes(), total >= 255, 0, 0
    until, far = np.cumsum(big), total[big].tobytes()
    for (block, _), k in zip(members, keys, strict=True):
        end = i + len(k)
        stop = 8 * int(until[end - 1])
        yield block, np.packbits(speaks[i:end]).tobytes() + short[i:end] + far[j:stop]
        i, j = end, stop
    if totals:
        yield None, struct.pack("<qq", each.sum(), (each > 0).sum())


def judge(members: list[tuple]):
    """Bucket side of a test: (block, a bit for each context: whether its contributions add up to 0 or more)."""
    keys, values = [], []
    for _, data in members:
        n, at = struct.unpack_from("<II", data)
        keys.append(unpack_sorted(data[8:at]))
        values.append(np.frombuffer(data, np.float64, n, at))
    key, value = np.concatenate(keys), np.concatenate(values)
    order = in_order(key)
    at = splits(key[order])
    kept = np.empty(len(key), bool)
    kept[order] = np.repeat(np.add.reduceat(value[order], at) >= 0, np.diff(np.r_[at, len(key)]))
    i = 0
    for (block, _), k in zip(members, keys, strict=True):
        yield block, np.packbits(kept[i : i + len(k)]).tobytes()
        i += len(k)


class Coded:
    """One block as symbols: ids, symbols of each text (words and the end), distinct symbols, and each place's number."""

    def __init__(self, row: dict):
        ids = np.frombuffer(row["ids"], np.int64)
        self.block, self.ids, self.null = row["block"], ids[: len(ids) // 2], ids[len(ids) // 2 :] != 0
        self.length = np.frombuffer(row["lengths"], np.int64)
        data = zstandard.ZstdDecompressor().decompress(row["data"])
        n, at = struct.unpack_from("<II", data)
        self.key = unpack_sorted(data[8:at])
        planes = np.frombuffer(data, np.uint8, -1, at).reshape(-1, n)
        self.of = sum((p.astype(np.int32) << (8 * k) for k, p in enumerate(planes)), np.zeros(n, np.int32))

    @staticmethod
    def data(key: np.ndarray, of: np.ndarray) -> bytes:
        """Keys, and the places' numbers by bytes of equal weight."""
        keys, width = pack_sorted(key), max(1, (len(key) - 1).bit_length() + 7 >> 3)
        planes = of.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T
        return zstandard.ZstdCompressor(level=1).compress(struct.pack("<II", len(of), 8 + len(keys)) + keys + planes.tobytes())


def coded(table: DataFrame) -> DataFrame:
    """Blocks of texts as blocks of symbols (rows for Coded), written."""

    def encode(batches):
        for row in store.rows(batches):
            words = store.Block(row).words(lower=True)
            length = words.counts() + 1
            symbol = np.full(int(length.sum()), _END)
            word = np.ones(len(symbol), bool)
            word[np.cumsum(length) - 1] = False
            symbol[word] = words.hash
            data = Coded.data(*distinct(symbol))
            del words, symbol, word
            yield store.to_batch([(row["block"], row["n"], row["bytes"], row["ids"], length.astype(np.int64).tobytes(), data)], store._BLOCK)
        store.lean()
        yield store.to_batch([], store._BLOCK)

    return store.written(table.mapInArrow(encode, store._BLOCK), "symbols")


class Level:
    """The n-grams of one length that a block asks for: distinct keys, ascending, and each place's key (-1: none)."""

    def __init__(self, key: np.ndarray, of: np.ndarray, places: np.ndarray):
        self.key, self.of, self.places = key, of, places
        self.count = self.answers = self.tested = self.kept = None

    def ask(self, trains: np.ndarray, buckets: int, base: int):
        """The keys with their numbers among the places that train."""
        which = self.of[trains]
        own = np.bincount(which[which >= 0], minlength=len(self.key))
        found, cut = store.cuts(self.key, buckets)
        short, big = np.minimum(own, 255).astype(np.uint8).tobytes(), own >= 255
        far, until = own[big].astype(np.int64).tobytes(), (8 * np.r_[0, np.cumsum(big)][cut]).tolist()
        for i, (b, x, y) in enumerate(zip(found.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            keys = pack_sorted(self.key[x:y])
            yield base + b, struct.pack("<II", y - x, 8 + len(keys)) + keys + short[x:y] + far[until[i] : until[i + 1]]

    def take(self, replies: dict, buckets: int, base: int) -> None:
        found, cut = store.cuts(self.key, buckets)
        data, size = [replies[base + b] for b in found.tolist()], np.diff(cut)
        bits = (-(-size // 8)).tolist()
        self.answers = data, size.tolist()
        counts = [d[k : k + n] for d, k, n in zip(data, bits, size.tolist(), strict=True)]
        far = [d[k + n :] for d, k, n in zip(data, bits, size.tolist(), strict=True)]
        self.count = unpack_counts(b"".join(counts + far), len(self.key))

    def speaks(self) -> np.ndarray:
        """For each key, whether this block adds its contribution."""
        parts = [np.unpackbits(np.frombuffer(d, np.uint8, -(-n // 8)), count=n) for d, n in zip(*self.answers, strict=True)]
        return np.concatenate([np.zeros(0, np.uint8), *parts]).astype(bool)

    def ask_test(self, part: np.ndarray, buckets: int, base: int):
        at = np.flatnonzero(self.tested)
        found, cut = store.cuts(self.key[at], buckets)
        for b, x, y in zip(found.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            keys = pack_sorted(self.key[at[x:y]])
            yield base + b, struct.pack("<II", y - x, 8 + len(keys)) + keys + part[at[x:y]].tobytes()

    def take_test(self, replies: dict, buckets: int, base: int) -> None:
        at = np.flatnonzero(self.tested)
        found, cut = store.cuts(self.key[at], buckets)
        self.kept = np.zeros(len(self.key), bool)
        for b, x, y in zip(found.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            self.kept[at[x:y]] = np.unpackbits(np.frombuffer(replies[base + b], np.uint8), count=y - x).astype(bool)


class Reading:
    """What one block knows of the model after the rounds whose answers it is given."""

    def __init__(self, block: Coded, buckets: int, least: int, prior: float, divergence: float):
        self.block, self.buckets, self.least, self.prior, self.divergence = block, buckets, least, prior, divergence
        self.length, total = block.length, len(block.of)
        self.first = np.cumsum(self.length) - self.length
        self.at = (np.arange(total) - np.repeat(self.first, self.length)).astype(np.int32)
        self.held_out = is_held_out(block.ids, block.null)
        self.symbol = self.hash = block.key[block.of]
        self.levels = [Level(block.key, block.of, np.arange(total))]
        self.longer(np.flatnonzero(self.at))

    def longer(self, places: np.ndarray) -> None:
        """The next level: n-grams that end at these places."""
        ends = mix(self.hash[places - 1] * _ODD + self.symbol[places])
        self.hash = np.zeros(len(self.symbol), np.uint64)
        self.hash[places] = ends
        key, back = distinct(ends)
        of = np.full(len(self.symbol), -1, np.int32)
        of[places] = back
        self.levels.append(Level(key, of, places))

    def trains(self) -> np.ndarray:
        """For each place, whether its text trains."""
        return np.repeat(~self.held_out, self.length)

    def take_first(self, replies: dict, tokens: int, kinds: int) -> None:
        """The answers of the first pass: the empty context's distribution, and which words are frequent."""
        one, two = self.levels
        one.take(replies, self.buckets, 0)
        two.take(replies, self.buckets, self.buckets)
        self.root = ((one.count + 1) / (tokens + kinds + 1))[one.of]
        self.known = (one.count > 0)[one.of]
        self.p = self.root
        self.depth = np.zeros(len(self.symbol), np.int8)
        self.frequent(1)

    def frequent(self, k: int) -> None:
        """With counts of n-grams of k + 1 symbols: the places after frequent contexts of k."""
        context, gram = self.levels[k - 1], self.levels[k]
        self.rows = gram.places if k > 1 else gram.places[(context.count >= self.least)[context.of[gram.places - 1]]]
        self.context = context.of[self.rows - 1]
        context.tested = np.zeros(len(context.key), bool)
        context.tested[self.context] = True

    def ask(self, k: int, last: bool):
        """The questions of pass k: the tests of contexts of k symbols, and n-grams of k + 2."""
        context, gram = self.levels[k - 1], self.levels[k]
        # each n-gram's contribution, by the block that speaks for it, is added to its context
        at = np.full(len(gram.key), -1, np.int64)
        at[gram.of[self.rows]] = np.arange(len(self.rows))
        g = np.flatnonzero((at >= 0) & gram.speaks() & (gram.count > 0))
        c, parent, count = self.context[at[g]], self.p[self.rows[at[g]]], gram.count[g]
        gain = np.log((count - 1 + self.prior * parent) / ((context.count[c] - 1 + self.prior) * parent)) - self.divergence
        yield from context.ask_test(np.bincount(c, count * gain, len(context.key)), self.buckets, 0)
        if not last:
            self.grow(k)
            yield from self.levels[k + 1].ask(self.trains(), self.buckets, self.buckets)

    def grow(self, k: int) -> None:
        gram = self.levels[k]
        here = self.rows[(gram.count >= self.least)[gram.of[self.rows]]] + 1
        here = here[here < len(self.symbol)]
        self.longer(here[self.at[here] > k])

    def take(self, k: int, replies: dict, last: bool) -> None:
        """The answers of pass k: which contexts of k symbols are states; counts for the next."""
        context, gram = self.levels[k - 1], self.levels[k]
        context.take_test(replies, self.buckets, 0)
        on = context.kept[self.context]
        i, c = self.rows[on], self.context[on]
        self.p = self.p.copy() if k == 1 else self.p
        self.p[i] = (gram.count[gram.of[i]] + self.prior * self.p[i]) / (context.count[c] + self.prior)
        self.depth[i] = k
        self.levels[k - 1] = None
        if not last:
            self.grow(k)
            self.levels[k + 1].take(replies, self.buckets, self.buckets)
            self.frequent(k + 1)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, least: int = LEAST, prior: float = PRIOR, divergence: float = DIVERGENCE, block_bytes: int = store.BLOCK_BYTES) -> DataFrame:
    """Train on the texts outside the held-out fold and score all.

    Returns id_col, held_out, n_tokens (words and the end), n_known (tokens seen in training),
    train_tokens, base_score (add-one counts of single tokens), score (the tree), both as log10
    probabilities, and n_deep (tokens scored in a state of one symbol or more).  Null and empty
    texts are one end token.  A null id is in fold crc32("") mod 7 = 0, so it trains.  Repeated
    rows count as often as they occur.  Extra columns are ignored; an empty table gives an empty
    result.  A text of any length is one part of one block, so the longest must fit a task's
    memory.
    """
    if depth < 1 or least < 1:
        raise ValueError("depth and least must be 1 or more")
    texts = store.blocks(docs, id_col, text_col, block_bytes)
    _, size = store.corpus_size(texts)
    table = coded(texts)
    store.drop(texts)
    buckets = store.bucket_count(size)
    known, asked = (0, 0), []

    def reading(block):
        r = Reading(block, buckets, least, prior, divergence)
        if asked:
            r.take_first(store.answers_of(asked[0], block.block), *known)
        for k, path in enumerate(asked[1:], 1):
            r.take(k, store.answers_of(path, block.block), k == depth)
        return r

    def first(block):
        r = Reading(block, buckets, least, prior, divergence)
        for base, level in enumerate(r.levels):
            yield from level.ask(r.trains(), buckets, base * buckets)

    path, known = store.ask(table, first, lambda b, m: add_up(m, totals=b < buckets), size, "grams", Coded)
    asked = [path]
    for k in range(1, depth + 1):
        path, _ = store.ask(table, lambda b, k=k: reading(b).ask(k, k == depth), lambda b, m: judge(m) if b < buckets else add_up(m), size, "tests", Coded)
        asked = [*asked, path]
    tokens = known[0]
    schema = f"{id_col} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_deep long"

    def run(batches):
        for row in store.rows(batches):
            r = reading(Coded(row))
            if len(r.first):
                def per_text(x, at=r.first):
                    return np.add.reduceat(x, at)

                n = np.full(len(r.first), tokens)
                yield store.columns_batch([pa.array(r.block.ids, mask=r.block.null), r.held_out, r.length, per_text(r.known.astype(np.int64)), n, per_text(np.log10(r.root)), per_text(np.log10(r.p)), per_text((r.depth > 0).astype(np.int64))], schema)
            del r
        store.lean()
        yield store.to_batch([], schema)

    return table.mapInArrow(run, schema)
