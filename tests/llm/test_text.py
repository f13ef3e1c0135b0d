"""Word splitting and hashing against plain Python."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.llm import text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\n\x0b\x0c\ré z", max_size=30)), max_size=8))
def test_words_are_those_of_bytes_split(rows):
    w = text.Words(*text.buffers(pa.array(rows, pa.string())))
    raw = w.raw.tobytes()
    want = [(r or "").encode().split() for r in rows]
    got = [[raw[w.start[k] : w.end[k]] for k in range(w.offsets[i], w.offsets[i + 1])] for i in range(len(rows))]
    assert got == want
    named = {}
    for word, h in zip([x for r in want for x in r], w.hash.tolist(), strict=True):
        assert named.setdefault(word, h) == h
    assert len(set(named.values())) == len(named)


def test_long_words_and_lower_case():
    a = text.Words(*text.buffers(pa.array(["A" * 400_000 + " b", "a" * 400_000])), lower=True)
    assert a.hash[0] == a.hash[2] != a.hash[1]


def test_windows_stay_inside_texts():
    w = text.Words(*text.buffers(pa.array(["a b c", "c d", "a b c d"])))
    first, h = w.windows(3)
    assert first.tolist() == [0, 5, 6] and h[0] == h[1] != h[2]


@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 5000), max_size=50))
def test_sorted_numbers(values):
    x = np.sort(np.array(values, np.uint64))
    assert (text.unpack_sorted(text.pack_sorted(x)) == x).all()


@given(st.lists(st.integers(0, 300) | st.integers(0, 2**62), max_size=50))
def test_counts(values):
    x = np.array(values, np.int64)
    assert (text.unpack_counts(text.pack_counts(x), len(x)) == x).all()


@given(st.lists(st.tuples(st.integers(0, 40), st.booleans()), max_size=30), st.integers(1, 9))
def test_sketch_loses_no_repeated_key(items, buckets):
    """Keys of two blocks, some of them twice in one."""
    from pulsegrid.llm import sketch

    halves = [dict(items[::2]), dict(items[1::2])]
    sent, want = {}, []
    for n, half in enumerate(halves):
        key = np.sort(text.mix(np.array(list(half), np.uint64)))
        back = {int(text.mix(np.array([k], np.uint64))[0]): v for k, v in half.items()}
        want.append((key, np.array([back[int(k)] for k in key], bool)))
        for b, p in sketch.emit(key, want[n][1], buckets):
            sent.setdefault(b, []).append((n, p))
    replies = [{}, {}]
    for b, members in sent.items():
        for n, r in sketch.merge(members):
            replies[n][b] = r
    for n, (key, twice) in enumerate(want):
        ok = sketch.repeated(key, replies[n], buckets)
        really = twice | np.isin(key, want[1 - n][0])
        assert (ok | ~really).all()
        assert (ok == really).all()  # so few keys share no counter


@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 9) | st.integers(2**64 - 9, 2**64 - 1), max_size=40))
def test_order_and_distinct_numbers(values):
    x = np.array(values, np.uint64)
    assert (text.in_order(x) == np.argsort(x, kind="stable")).all()
    keys, of = text.distinct(x)
    assert (keys == np.unique(x)).all() and (keys[of] == x).all()


@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 50), max_size=60), st.integers(1, 9))
def test_ranges_hold_every_place_once_and_ascend(values, buckets):
    from pulsegrid.llm import sketch

    x = np.array(values, np.uint64)
    key = np.unique(x)
    whole = list(sketch.emit(key, key % 2 == 0, buckets))
    kept, text.SLICE = text.SLICE, 3
    try:
        assert (text.in_order(x) == np.argsort(x, kind="stable")).all()
        high = (x >> np.uint64(32)).astype(np.uint32)
        places = [np.arange(len(x))[at] for at in text.ranges(high, 1 << 32)]
        assert sorted(np.concatenate(places).tolist()) == list(range(len(x)))
        spans = [(high[p].min(), high[p].max()) for p in places if len(p)]
        assert all(a[1] < b[0] for a, b in zip(spans[:-1], spans[1:], strict=True))
        assert list(sketch.emit(key, key % 2 == 0, buckets)) == whole
        w = text.Words(*text.buffers(pa.array([" ".join(map(str, values)), None, "1 2", "1 2 3 4 5 6 7"])))
        first, h = w.windows(3)
        assert first.tolist() == [i for i in range(len(w.hash) - 2) if i + 3 <= min(e for e in w.offsets[1:] if e > i)]
        assert (h == text.chain([w.hash[first + j] for j in range(3)])).all()
    finally:
        text.SLICE = kept
