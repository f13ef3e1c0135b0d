"""Token ids of whole texts by a public tokenizer whose tokens never cross ASCII white space.

Each distinct word is encoded once per Python worker and kept, bounded, in sorted arrays; a
batch of texts is then a gather.  ``check_split`` refuses a tokenizer for which encoding word
by word could differ from encoding the text.
"""

from __future__ import annotations

import json
import os
import threading
import time

import numpy as np

from .store import lean
from .text import Words, in_order

#: Words kept by a worker before it starts again.
CACHE_WORDS = 3_000_000
#: Words encoded in one call.
TOGETHER = 4096
#: Seconds after which an idle worker forgets its encoder.
IDLE_SECONDS = 20.0
_caches: dict = {}
_asked = 0.0


def check_split(path: str) -> None:
    """Raise unless the file drops white space before its model and normalises without crossing it."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
    cut = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    if not set(steps) <= {"NFC", "Replace", "Lowercase"} or cut.get("type") != "Split" or cut.get("behavior") != "Removed" or not cut.get("invert"):
        raise ValueError(f"{path}: words of this tokenizer may depend on what is around them")


class Encoder:
    """Encodes batches of texts with a bounded cache of words, for a file that check_split() lets pass."""

    def __init__(self, path: str, most: int = CACHE_WORDS):
        # a task is one thread; a pool of them would only spread its memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        lean()
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self._clear()

    def _clear(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.begin, self.ids = np.zeros(1, np.int32), np.zeros(0, np.uint32)

    def _ids(self, words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of the words at these places has, and all their ids."""
        raw, lengths, ids = words.raw.tobytes(), [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        # an encoding takes a hundred times its ids, so few are held at a time
        for a in range(0, len(at), TOGETHER):
            some = at[a : a + TOGETHER]
            spelled = [raw[x:y].decode() for x, y in zip(words.start[some].tolist(), words.end[some].tolist(), strict=True)]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(spelled, add_special_tokens=False)]
            lengths.append(np.array([len(x) for x in found], np.int64))
            ids.append(np.fromiter((v for x in found for v in x), np.uint32, int(lengths[-1].sum())))
        return np.concatenate(lengths), np.concatenate(ids)

    def _learn(self, words: Words, h: np.ndarray, at: np.ndarray) -> None:
        if len(self.known) + len(h) > self.most:
            self._clear()
            fresh = np.arange(len(h))
        else:
            i = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
            fresh = np.flatnonzero(self.known[i] != h) if len(self.known) else np.arange(len(h))
        if not len(fresh):
            return
        lengths, flat = self._ids(words, at[fresh])
        slots = len(self.begin) - 1 + np.arange(len(fresh), dtype=np.int32)
        self.begin = np.r_[self.begin, self.begin[-1] + np.cumsum(lengths, dtype=np.int32)]
        self.ids = np.r_[self.ids, flat]
        known, slot = np.r_[self.known, h[fresh]], np.r_[self.slot, slots]
        order = in_order(known)
        self.known, self.slot = known[order], slot[order]

    def encode(self, raw: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by end_id, and where each text's begin (one more than texts)."""
        words = Words(raw, at)
        h, place, back = np.unique(words.hash, return_index=True, return_inverse=True)
        n_texts = len(at) - 1
        if not len(h):
            return np.full(n_texts, end_id, np.uint32), np.arange(n_texts + 1)
        run = max(1, self.most // 2)
        if len(h) <= run:
            self._learn(words, h, place)
            slot = self.slot[np.searchsorted(self.known, h)]
            begin, ids = self.begin, self.ids
        else:  # more distinct words than the cache is for: encoded in runs, and not kept
            found = [self._ids(words, place[a : a + run]) for a in range(0, len(h), run)]
            slot = np.arange(len(h))
            begin, ids = np.r_[0, np.cumsum(np.concatenate([n for n, _ in found]))], np.concatenate([x for _, x in found])
        length = begin[slot + 1] - begin[slot]
        n = length[back]
        # where each word's ids go: after the ids of the words before it and one end id for each earlier text
        to = np.r_[0, np.cumsum(n)][:-1] + words.of()
        total = int(n.sum()) + n_texts
        out = np.full(total, end_id, np.uint32)
        first = np.repeat(to - np.r_[0, np.cumsum(n)][:-1], n)
        source = np.repeat(begin[slot][back] - np.r_[0, np.cumsum(n)][:-1], n)
        step = np.arange(len(source))
        out[first + step] = ids[source + step]
        per_text = np.r_[0, np.cumsum(n)][words.offsets]
        return out, per_text + np.arange(n_texts + 1)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; a worker that has not asked for some seconds forgets it.

    Workers are kept for later stages, where the words would only take their memory.
    """
    global _asked
    _asked = time.monotonic()
    key = (path, os.getpid())
    if key not in _caches:
        _caches[key] = Encoder(path)
        threading.Thread(target=_forget, daemon=True).start()
    return _caches[key]


def _forget() -> None:
    while (left := _asked + IDLE_SECONDS - time.monotonic()) > 0:
        time.sleep(left)
    _caches.clear()
    lean()


#: Bytes of text encoded at a time.
SLICE_BYTES = 2 << 20


def slices(at: np.ndarray, most: int = SLICE_BYTES):
    """Ranges of texts of about so many bytes."""
    a, n = 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        yield a, b
        a = b
