"""Operators against brute force on a small corpus, and their defined odd cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pulsegrid.llm import mixing, near, nearest, pack, quality, queries, sequences, shards, store, substring, suffix, warc

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SMALL = 1 << 12


def words(t, lower=False):
    b = (t or "").encode()
    return (b.translate(LOWER) if lower else b).split()


def rows(df, key="doc_id"):
    return {r[key]: r.asDict(recursive=True) for r in df.collect()}


@pytest.mark.parametrize("depth, least", [(1, 3), (2, 4), (4, 2)])
def test_suffix_tree(docs, texts, depth, least):
    prior, limit = 8.0, 0.02
    got = rows(suffix.score_texts(docs, depth=depth, least=least, prior=prior, divergence=limit, block_bytes=SMALL))
    seq = [words(t, True) + [None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    count = Counter()  # of n-grams of every length up to depth + 1
    for t, h in zip(seq, held, strict=True):
        if not h:
            for k in range(1, depth + 2):
                count.update(tuple(t[i : i + k]) for i in range(len(t) - k + 1))
    ones = {g: c for g, c in count.items() if len(g) == 1}
    n, v = sum(ones.values()), len(ones)
    states = set()

    def p(context, s):
        """By the longest retained suffix of the context."""
        out = (count[(s,)] + 1) / (n + v + 1)
        for k in range(1, len(context) + 1):
            c = context[len(context) - k :]
            if c in states:
                out = (count[(*c, s)] + prior * out) / (count[c] + prior)
        return out

    for k in range(1, depth + 1):
        gain = defaultdict(float)
        for g, c in count.items():
            if len(g) == k + 1 and count[g[:-1]] >= least:
                parent = p(g[1:-1], g[-1])
                gain[g[:-1]] += c * (math.log((c - 1 + prior * parent) / ((count[g[:-1]] - 1 + prior) * parent)) - limit)
        states |= {c for c, x in gain.items() if x >= 0}
    assert {len(c) for c in states} == set(range(1, depth + 1))
    for i, t in enumerate(seq):
        score = sum(math.log10(p(tuple(t[max(0, k - depth) : k]), s)) for k, s in enumerate(t))
        base = sum(math.log10((count[(s,)] + 1) / (n + v + 1)) for s in t)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"], r["n_known"]) == (held[i], len(t), n, sum(count[(s,)] > 0 for s in t))
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)


def shingles(t):
    w = words(t, True)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components_by_hand(sets):
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("parameters", [{}, {"group_docs": 2, "node": 2, "levels": 2}])
def test_near_duplicates(docs, texts, parameters):
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = components_by_hand(sets)
    got = rows(near.near_duplicates(docs, block_bytes=SMALL, **parameters))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_keep_one_keeps_rows_whole(docs, texts):
    want = components_by_hand({i: shingles(t) for i, t in enumerate(texts)})
    kept = near.keep_one(docs, block_bytes=SMALL)
    assert kept.schema == docs.schema
    by_id = lambda rows: sorted(map(tuple, rows))
    assert by_id(kept.collect()) == by_id(r for r in docs.collect() if want[r["doc_id"]] == r["doc_id"])


def test_recall_bound():
    assert near.recall(0.75) > 0.9999 and near.recall(0.95) > near.recall(0.75)


def removed_by_hand(texts, k=13):
    first = {}
    for i, t in enumerate(texts):
        w = words(t)
        for j in range(len(w) - k + 1):
            first.setdefault(tuple(w[j : j + k]), i)
    out = []
    for i, t in enumerate(texts):
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                gone[j : j + k] = [True] * k
        out.append((w, gone))
    return out


def test_substring_dedup(docs, texts):
    got = rows(substring.remove_repeats(docs, block_bytes=SMALL))
    for i, (w, gone) in enumerate(removed_by_hand(texts)):
        left = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(left).hexdigest())
    whole = rows(substring.remove_repeats(docs, whole_rows=True, block_bytes=SMALL))
    for i, (w, gone) in enumerate(removed_by_hand(texts)):
        assert words(whole[i]["text"]) == [x for x, g in zip(w, gone, strict=True) if not g] and whole[i]["block"] == i * 7
        if not any(gone):
            assert whole[i]["text"] == texts[i]


def test_warc(spark, tmp_path):
    pages = [(3, "u", "z" * 200), (1, None, "z" * 200), (2, "u", None), (4, "u\n", ""), (9, "u", "k" * 50), (8, "u", "k" * 50), (None, "u", "z" * 200), (1, "u", "z" * 200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted((r["page_id"] if r["page_id"] is not None else -1, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect())
    assert got == [(-1, 200, "response", None), (1, 200, "response", None), (1, 200, "response", None), (2, 0, "response", None), (3, 200, "revisit", 1), (4, 0, "response", None), (8, 50, "response", None), (9, 50, "response", None)]
    manifest = warc.write_archives(df, str(tmp_path / "w"))
    back = warc.read_archives(spark, manifest, str(tmp_path / "w"), with_payload=True)
    assert sorted(len(r["payload"]) for r in back.collect() if r["record_type"] == "response") == [0, 0, 50, 50, 200, 200, 200]
    found = {f.name: f.read_bytes()[:4] for f in (tmp_path / "w").glob("*.zst")}
    assert found and set(found.values()) == {b"\x5d\x2a\x4d\x18"}, found


def test_kd_shards(docs, texts, spark):
    big = docs.unionByName(docs.withColumn("doc_id", docs.doc_id + 1000))
    got = shards.shard_documents(big, shards=5).collect()
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == {(i + d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in enumerate(texts) for d in (0, 1000)}
    per = defaultdict(list)
    for r in got:
        per[r["shard"]].append(r)
    assert sorted(per) == list(range(5)) and all(sorted(r["slot"] for r in p) == list(range(len(p))) for p in per.values())
    sizes = [sum(r["size"] for r in p) for p in per.values()]
    assert max(sizes) - min(sizes) <= 4 * max(r["size"] for r in got)
    same = spark.createDataFrame([(i, "x" * 100) for i in range(240)], "doc_id long, text string")
    counts = Counter(r["shard"] for r in shards.shard_documents(same, shards=24).collect())
    assert set(counts.values()) == {10}


def test_best_fit_respects_every_capacity():
    rng = np.random.default_rng(0)
    for rule in ("norm", "dot"):
        hist = Counter(rng.integers(1, 101, 500).tolist())
        plan = pack.best_fit(hist, capacity=100, most_docs=4, most_cost=6000 if rule == "dot" else 10_000, rule=rule) if rule == "norm" else pack.best_fit(hist, 100, 4, 10_000, rule)
        bins = defaultdict(list)
        for length, _, number, first, offset in plan:
            for b in range(first, first + number):
                bins[b].append((offset, length))
        assert sum(n for _, _, n, _, _ in plan) == 500
        for items in bins.values():
            items.sort()
            at = 0
            for offset, length in items:
                assert offset == at
                at += length
            assert at <= 100 and len(items) <= 4 and sum(n * n for _, n in items) <= 10_000


def one_by_one(hist, capacity, rule, docs=None, cost=None, weights=pack.WEIGHTS):
    """Bins of best fit item by item; by default with as many documents and as much cost as the tokens allow."""
    docs, cost, bins = docs or capacity, cost or capacity * capacity, []
    for length in sorted(hist, reverse=True):
        for _ in range(hist[length]):
            best = None
            for k, (t, d, c) in enumerate(bins):
                if t + length <= capacity and d < docs and c + length**2 <= cost:
                    left = np.array([(capacity - t) / capacity, (docs - d) / docs, (cost - c) / cost])
                    item = np.array([length / capacity, 1 / docs, length**2 / cost])
                    key = (-(weights * left * item).sum() if rule == "dot" else (weights * (left - item) ** 2).sum(), capacity - t, k)
                    best = min(best or key, key)
            if best is None:
                bins.append((0, 0, 0))
            k = best[2] if best else len(bins) - 1
            bins[k] = (bins[k][0] + length, bins[k][1] + 1, bins[k][2] + length**2)
    return len(bins)


def bins_of(plan):
    return max(first + number for _, _, number, first, _ in plan)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_fills_the_bins_it_opens(rule):
    # a dominant short length beside a longer one that leaves bins open
    plan = pack.best_fit({1500: 10, 100: 100_000}, rule=rule)
    assert sum(n for length, _, n, _, _ in plan if length == 100) == 100_000
    assert bins_of(plan) == 10 + math.ceil((100_000 - 10 * 5) / 20)
    rng = np.random.default_rng(1)
    for _ in range(6):
        hist = Counter(rng.integers(1, 101, 60).tolist()) + Counter({int(rng.integers(5, 40)): 90})
        assert bins_of(pack.best_fit(hist, 100, 100, 10_000, rule)) == one_by_one(hist, 100, rule)


@pytest.mark.parametrize("docs, cost", [(4, 10_000), (100, 4_000), (3, 5_000)])
@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_where_every_capacity_binds(docs, cost, rule):
    rng = np.random.default_rng(3)
    for _ in range(8):
        hist = Counter(rng.integers(1, 60, 80).tolist())
        assert bins_of(pack.best_fit(hist, 100, docs, cost, rule)) == one_by_one(hist, 100, rule, docs, cost)


@pytest.mark.parametrize("hist, most", [({1100: 1, 1000: 10}, 6), ({2000: 1, 600: 30}, 11), ({2048: 5, 683: 1, 680: 300}, 106), ({1500: 2, 300: 100}, 19)])
def test_best_fit_puts_equal_items_together(hist, most):
    for rule in ("norm", "dot"):
        assert bins_of(pack.best_fit(hist, rule=rule)) <= most


def encoded(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer())
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs, texts):
    ids = encoded(texts, 0)
    got = pack.pack_documents(docs, queries.tokenizer(), capacity=128).collect()
    want = {(i, p // 128, p, len(x[p : p + 128]), crc(x[p : p + 128])) for i, x in enumerate(ids) for p in range(0, len(x), 128)}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        ends = np.cumsum([n for _, n in sorted(items)])
        assert [o for o, _ in sorted(items)] == [0, *ends[:-1].tolist()] and ends[-1] <= 128
    assert len(bins) <= math.ceil(sum(map(len, ids)) / 128) + 2


def test_sequences(spark, docs, texts, tmp_path):
    ids = encoded(texts, 2)
    starts = np.r_[0, np.cumsum([len(x) for x in ids])]
    got = rows(sequences.round_trip(docs, queries.tokenizer()))
    assert {i: (r["start"], r["n_tokens"], r["ids_crc32"]) for i, r in got.items()} == {i: (starts[i], len(x), crc(x)) for i, x in enumerate(ids)}
    sequences.write_sequences(docs, queries.tokenizer(), str(tmp_path / "s"), length=16, parts=1)
    f = sequences.SequenceFile(str(next((tmp_path / "s").glob("*.arrows"))))
    flat = np.concatenate(ids)
    for k in (0, len(f) // 2, len(f) - 1):
        part, mask = f[k]
        n = sum(mask.to_pylist())
        assert part[:n].tolist() == flat[k * 16 : k * 16 + n].tolist() and (n == 16 or k == len(f) - 1)


def test_quality(spark, docs, texts):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 3)] + [(1, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    got = rows(quality.score_quality(docs, labels))
    for i, t in enumerate(texts):
        w = [x.decode() for x in words(t)]
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        marked = set()
        for k in range(len(w) - 7):
            if c[tuple(w[k : k + 8])] > 1:
                marked |= set(range(k, k + 8))
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]["rules"]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(marked))
        failed = len(w) < 20 or 100 * len(marked) > 30 * len(w)
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["llr"] >= quality.THRESHOLD)
    # the scores follow from counts of hashed grams, taken here in Spark SQL word by word
    counts = docs.selectExpr("doc_id", "filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w != '') w").where("w is not null")
    one = counts.selectExpr("doc_id", "posexplode(w) as (k, a)").selectExpr("doc_id", "pmod(xxhash64(a), 8192) b")
    two = counts.selectExpr("doc_id", "w", "explode(sequence(1, greatest(size(w) - 1, 1))) k").where("size(w) > 1").selectExpr("doc_id", "pmod(xxhash64(xxhash64(w[k - 1]), xxhash64(w[k])), 8192) b")
    grams = one.union(two).toPandas()
    good = set(range(0, 60, 3))  # a missing label says nothing
    raw, trusted = Counter(grams.b), Counter(grams.b[grams.doc_id.isin(good)])
    n, m = sum(raw.values()), sum(trusted.values())
    weight = {b: math.log((trusted[b] + 1) / (m + 8192)) - math.log((raw[b] + 1) / (n + 8192)) for b in raw}
    for i, part in grams.groupby("doc_id"):
        assert math.isclose(got[i]["rules"]["llr"], np.mean([weight[b] for b in part.b]), abs_tol=1e-5)
    assert {"block", "rate"} <= set(got[0])


def test_quality_separates_labelled_documents(spark):
    rng = np.random.default_rng(4)
    clean = [f"c{i}" for i in range(30)]
    texts = [rng.choice(clean, 300).tolist() for _ in range(260)]
    for i in range(0, 260, 10):  # a few junk words dilute over a clean text
        for k in rng.choice(300, 25, replace=False):
            texts[i][k] = f"{rng.choice(clean)}%%%"
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(230)], "doc_id long, quality int, toxic int")
    got = rows(quality.score_quality(docs, labels))
    assert not any(r["rules"]["base_failed"] for r in got.values())
    low = [r["rules"]["llr"] for i, r in got.items() if i % 10 == 0]
    assert min(low) > -0.25  # an older threshold kept them all
    assert {i for i, r in got.items() if not r["rules"]["kept"]} == set(range(0, 260, 10))


def test_mixing_fits_its_targets(spark):
    rng = np.random.default_rng(3)
    good, low = [f"g{i}" for i in range(40)], [f"l{i}" for i in range(40)]
    texts = [" ".join(rng.choice(good if i % 2 else low, 60)) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = mixing.mix(docs, labels, targets={"good": 0.6, "low": 0.4, "toxic": 0.0}, epochs=1.0).collect()
    p = np.array([r["p"] for r in got])
    rate, tokens = np.array([r["rate"] for r in got]), np.array([r["tokens"] for r in got])
    held = [(r["_doc"]["doc_id"], r["p"]) for r in got if r["_doc"]["doc_id"] is not None and r["_doc"]["doc_id"] >= 60]
    assert np.mean([(q[0] > q[1]) == (i % 2 == 1) for i, q in held]) > 0.95  # held-out accuracy
    total = (tokens[:, None] * p * rate[:, None]).sum(0)
    assert abs(total[0] / tokens.sum() - 0.6) < 0.02 and abs(total[1] / tokens.sum() - 0.4) < 0.02
    assert (rate >= 0).all() and all(abs(r["copies"] - r["rate"]) <= 1 for r in got)


def test_mixing_drops_toxic_documents(spark):
    rng = np.random.default_rng(6)
    plain, insults = [f"g{i}" for i in range(400)], [f"t{i}" for i in range(8)]
    texts = []
    for i in range(400):  # short and long texts; a toxic one has a few insults in it
        w = rng.choice(plain, 1500 if i % 3 == 0 else 60).tolist()
        for k in rng.choice(60, 4, replace=False) if i % 8 == 0 else []:
            w[k] = str(rng.choice(insults))
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r["_doc"]["doc_id"]: r for r in mixing.mix(docs, labels).collect()}
    assert all(got[i]["rate"] == 0 and got[i]["copies"] == 0 for i in range(0, 400, 8))
    assert all(r["rate"] >= 1 and r["copies"] >= 1 for i, r in got.items() if i % 8)


def test_mixing_reaches_or_reports_its_targets(spark, caplog):
    rng = np.random.default_rng(3)
    words_of = {1: [f"g{i}" for i in range(40)], 0: [f"l{i}" for i in range(40)]}
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words_of[int(i % 12 == 0)], 60))) for i in range(240)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 12 == 0), 0) for i in range(240)], "doc_id long, quality int, toxic int")
    wanted = {"good": 0.6, "low": 0.4, "toxic": 0.0}  # good is a twelfth: its documents are needed over four times
    with caplog.at_level("INFO", mixing.__name__):
        got = mixing.mix(docs, labels, targets=wanted, epochs=1.0, steps=100).collect()
        reached = sum(r["tokens"] * r["p"][0] * r["rate"] for r in got) / sum(r["tokens"] for r in got)
        assert abs(reached - 0.6) < 0.02 and max(r["rate"] for r in got) > 4
        assert "goal" in caplog.text and "missed" not in caplog.text
        mixing.mix(docs, labels, targets=wanted, epochs=1.0, steps=1)
        assert "missed" in caplog.text


@pytest.mark.parametrize("parameters", [{}, {"shard_rows": 300, "query_bytes": 300}])
def test_permutation_index(spark, parameters):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    bad = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0] * 15 + [None]), (904, []), (None, [1.0] * 16), (905, [1.0] * 15), (300, [9.0] * 16)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + bad, "vec_id long, embedding array<float>")
    for c in ("id", "v", "shard", "rank", "score", "query_id"):  # columns named like the operator's own
        df = df.selectExpr("*", f"'x' as {c}")
    got = nearest.search(df, df.where("vec_id % 100 = 0"), **parameters).collect()
    found = defaultdict(dict)
    for r in got:
        found[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(found) == list(range(0, 700, 100))
    for q, near_ in found.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = set(np.argsort(d)[:10].tolist())
        assert sorted(near_) == list(range(1, 11)) and all(math.isclose(s, d[v], rel_tol=1e-12) for v, s in near_.values())
        assert [s for _, s in sorted(near_.values(), key=lambda p: (p[1], p[0]))] == [near_[k][1] for k in range(1, 11)]
        assert len(best & {v for v, _ in near_.values()}) >= 8


@pytest.mark.parametrize("clustered", [True, False])
def test_permutation_index_finds_by_its_cut(spark, clustered):
    """Recall at production parameters, where 4 % of each shard are reranked, also on vectors without any structure."""
    rng = np.random.default_rng(9)
    n = 9000
    x = rng.normal(size=(n, 64))
    if clustered:
        x = rng.normal(size=(40, 64))[rng.integers(0, 40, n)] + x / 2
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = nearest.search(df, df.where("vec_id % 100 = 0")).collect()
    hit = 0
    for q in range(0, n, 100):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        d[q] = np.inf
        hit += len(set(np.argsort(d)[:10].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert nearest.RERANK <= 0.04 and hit / (n / 10) >= 0.93, hit


def test_permutation_index_of_few_vectors(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in (0, 3, 5)], "vec_id long, embedding array<double>")
    got = nearest.search(df, df.where("vec_id = 0")).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 3, 3.0), (2, 5, 5.0)]


def test_one_id_on_two_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    made = [(1, a), (1, b), (8, a + " x"), (9, b + " y"), (7, "alone " * 9)]
    got = near.near_duplicates(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (7, 7), (8, 1), (9, 1)]


def test_encoder_of_more_words_than_it_keeps():
    from pulsegrid.llm import text, tokens

    texts = [" ".join(f"v{i}" for i in range(100)), "", "v3 v3 other"]
    raw, at = text.buffers(pa.array(texts))
    ids, begin = tokens.Encoder(queries.tokenizer(), most=20).encode(raw, at, 2)
    assert [ids[x:y].tolist() for x, y in zip(begin[:-1], begin[1:], strict=True)] == encoded(texts, 2)


def test_odd_rows(spark, odd):
    assert odd.count() == suffix.score_texts(odd).count() == pack.pack_documents(odd, queries.tokenizer()).count() == shards.shard_documents(odd, 3).count()
    got = near.near_duplicates(odd).collect()
    assert len(got) == 8 and {r["component_id"] for r in got if r["doc_id"] in (3, 5)} == {3} and all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    assert len(near.keep_one(odd).collect()) == 5
    cut = substring.remove_repeats(odd).collect()
    assert {(r["doc_id"], r["n_removed"]) for r in cut if r["n_words"] == 40} == {(5, 40), (None, 0)}
    back = sequences.round_trip(odd, queries.tokenizer()).collect()
    assert len(back) == 8 and sorted(r["start"] for r in back)[0] == 0


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    made = [suffix.score_texts(empty), near.near_duplicates(empty), near.keep_one(empty), substring.remove_repeats(empty), substring.remove_repeats(empty, whole_rows=True), warc.round_trip(pages), shards.shard_documents(empty), pack.pack_documents(empty, queries.tokenizer()), sequences.round_trip(empty, queries.tokenizer()), quality.score_quality(empty, labels), mixing.mix(empty, labels), nearest.search(vectors, vectors)]
    assert [d.count() for d in made] == [0] * len(made)


def test_substring_dedup_of_a_block_takes_a_bounded_multiple_of_its_text(monkeypatch):
    """8 MB of words: what is held at once, of numbers and bytes, while a block's windows are sent."""
    import tracemalloc

    import zstandard

    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(10_000, 99_999, 500))).encode() for _ in range(2800)]
    size, n = sum(map(len, texts)), len(texts)
    row = {"block": 0, "ids": np.r_[np.arange(n), np.zeros(n, np.int64)].tobytes(), "lengths": np.array([len(x) for x in texts], np.int64).tobytes(), "data": zstandard.ZstdCompressor(level=1).compress(b"".join(texts))}
    asked = {}

    class Table:
        sparkSession, columns, schema = None, ["doc_id", "text"], None

        def mapInArrow(self, *_):
            return self

    monkeypatch.setattr(store, "blocks", lambda *_, **__: Table())
    monkeypatch.setattr(store, "corpus_size", lambda _: (n, size * 40))
    monkeypatch.setattr(store, "ask", lambda _, emit, reduce, size, name: (asked.setdefault(name, emit) and name, (0, 0)))
    substring.remove_repeats(Table())

    def peak(emit):
        tracemalloc.start()
        try:
            sent = list(emit(store.Block(row)))
            return sent, tracemalloc.get_traced_memory()[1] / size
        finally:
            tracemalloc.stop()

    peak(asked["sketch"])
    sent, most = peak(asked["sketch"])
    assert most < 14
    ones = {b: np.packbits(np.ones(int.from_bytes(p[:4], "little"), bool)).tobytes() for b, p in sent}
    monkeypatch.setattr(store, "answers_of", lambda *_: ones)
    assert peak(asked["repeats"])[1] < 16
