"""Cases that every operator must stand, and whole results against plain Python."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import components_by_hand, encoded, one_by_one, removed_by_hand, rows, shingles, words

import corpus_pipeline
from pulsegrid.llm import mixing, near, pack, quality, queries, sequences, shards, store, substring, suffix, warc


# ---- k-d tree


def kd_by_hand(items, leaves, dims, spread, order):
    """Recursive weighted medians along the widest dimension, item by item: {row: leaf}."""
    if leaves == 1:
        return [items]
    wide = [(max(r[d] for r in items) - min(r[d] for r in items)) / spread[d] for d in dims]
    first = dims[int(np.argmax(wide))]
    items = sorted(items, key=lambda r: [r[first], *[r[c] for c in order if c != first]])
    goal, acc, cut = sum(r["size"] for r in items) * (leaves // 2) / leaves, 0, 0
    while acc + items[cut]["size"] < goal:
        acc, cut = acc + items[cut]["size"], cut + 1
    if not goal - acc < acc + items[cut]["size"] - goal:
        cut += 1
    return kd_by_hand(items[:cut], leaves // 2, dims, spread, order) + kd_by_hand(items[cut:], leaves - leaves // 2, dims, spread, order)


@pytest.mark.parametrize("leaves", [2, 5, 8])
def test_kd_tree_by_hand(spark, leaves):
    r = random.Random(leaves)
    texts = [r.choice("abé") * r.choice([3, 5, 40, 41, 300]) for _ in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    items = [{"id": i, "size": len(t.encode()) + 8, "chars": len(t), "crc": zlib.crc32(t.encode()), "number": i} for i, t in enumerate(texts)]
    dims = ["size", "chars", "crc"]
    spread = {d: max(1, max(x[d] for x in items) - min(x[d] for x in items)) for d in dims}
    want = kd_by_hand(items, leaves, dims, spread, ["crc", "size", "number"])
    got = defaultdict(set)
    for row in shards.shard_documents(docs, leaves, together=0.0).collect():
        got[row["shard"]].add(row["doc_id"])
    assert {frozenset(v) for v in got.values()} == {frozenset(x["id"] for x in leaf) for leaf in want}


# ---- mixing


def test_rates_are_the_optimum(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet((2, 1, 0.3), 400)
    tokens = rng.integers(5, 400, 400)
    table = spark.createDataFrame([(int(t), [float(v) for v in q]) for t, q in zip(tokens, p, strict=True)], "tokens long, p array<double>").coalesce(1).cache()
    history, momentum, totals = mixing.fit_rates(table, mixing.TARGETS, steps=80)  # goals that such soft posteriors are far from
    r = np.array([x["r"] for x in table.select(mixing.state(F.col("p"), history, momentum)["r"].alias("r")).collect()])
    goal = np.array([totals["goal"][d] for d in mixing.DOMAINS])
    now = (tokens[:, None] * p).sum(0)
    scale = np.maximum(np.maximum(now, goal), mixing.LEAST_SHARE * now.sum())

    def loss(r):
        return ((((tokens * r) @ p) - goal) ** 2 / scale).sum()

    best, a = np.ones(400), tokens[:, None] * p
    step = 1 / np.linalg.norm((a / np.sqrt(scale)).T @ (a / np.sqrt(scale)), 2)
    for _ in range(20_000):
        best = np.maximum(0, best - step * (a @ (((tokens * best) @ p - goal) / scale)))
    assert np.allclose([totals["after"][d] for d in mixing.DOMAINS], (tokens * r) @ p, rtol=1e-9)
    assert (r >= 0).all() and loss(r) <= loss(best) + 0.01 * loss(np.ones(400))


def test_posteriors_by_hand(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choice(vocabulary[: 25 + 5 * (i % 3)]) for _ in range(r.randint(0, 30))) for i in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 2)) for i in range(60)] + [(1, 1, 1), (None, 1, 1), (70, None, 0)], "doc_id long, quality int, toxic int")
    bucket = {x["w"]: x["b"] for x in spark.createDataFrame([(w,) for w in vocabulary], "w string").selectExpr("w", f"pmod(xxhash64(w), {mixing.BUCKETS}) b").collect()}
    domain = {i: "toxic" if i % 3 == 2 or i == 1 else "good" if i % 3 else "low" for i in range(60)}
    count = Counter((bucket[w], domain[i]) for i in domain for w in set(texts[i].split()))
    seen = {b: sum(count[b, d] for d in mixing.DOMAINS) for b in bucket.values()}
    total = {d: sum(n for (_, e), n in count.items() if e == d) for d in mixing.DOMAINS}
    size = Counter(domain.values())
    everything = sum(total.values())
    got = rows(mixing.mix(docs, labels).select("_doc.doc_id", "tokens", "p", "residual"))
    for i, t in enumerate(texts):
        logs = []
        for d in mixing.DOMAINS:
            share = (total[d] + mixing.SMOOTHING) / (everything + mixing.SMOOTHING * 3)
            x = np.log((size[d] + 1) / (60 + 3))
            for b in {bucket[w] for w in t.split()}:
                v = np.log((count[b, d] + share * mixing.PRIOR) / ((seen[b] + mixing.PRIOR) * share))
                x += np.sign(v) * max(0, abs(v) - mixing.SHRINK) if seen[b] >= mixing.LEAST_SEEN else 0
            logs.append(x)
        e = np.exp(np.array(logs) - max(logs))
        assert got[i]["tokens"] == len(t.split()) and np.allclose(got[i]["p"], e / e.sum(), atol=1e-5)


# ---- near-duplicates


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_repeated_ids_at_any_partitioning(spark, partitions):
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    bases = [[r.choice(vocabulary) for _ in range(40)] for _ in range(8)]
    made = []
    for _ in range(60):
        t = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            t[r.randrange(len(t))] = r.choice(vocabulary)
        made.append((r.choice([None, *range(25)]), " ".join(t)))
    # rows are vertices, joined by links and by a shared id
    sets = {k: shingles(t) for k, (i, t) in enumerate(made) if i is not None}
    up = components_by_hand(sets)
    while True:
        of_id = {}
        for k, root in up.items():
            of_id[made[k][0]] = min(of_id.get(made[k][0], root), root)
        onto = {}
        for k, root in up.items():
            onto[root] = min(onto.get(root, root), of_id[made[k][0]])
        if all(a == b for a, b in onto.items()):
            break
        up = {k: onto[root] for k, root in up.items()}
    name = {root: min(made[k][0] for k in up if up[k] == root) for root in set(up.values())}
    want = sorted((i, name[up[k]] if i is not None else None) for k, (i, _) in enumerate(made) if i is not None)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = near.near_duplicates(spark.createDataFrame(made, "doc_id long, text string").repartition(partitions), block_bytes=2000).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((x["doc_id"], x["component_id"]) for x in got if x["doc_id"] is not None) == want


# ---- odd input


def test_blocks_of_many_small_batches(spark):
    """Batches of two rows in one block, with other columns."""
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 4), f"s{i}", [i, None]) for i in range(23)], "doc_id long, text string, source string, l array<int>").coalesce(1)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 2)
    try:
        table = store.blocks(docs, whole_rows=True)
        assert table.count() == 1
        assert sorted(map(str, substring.remove_repeats(docs, whole_rows=True).collect())) == sorted(map(str, docs.collect()))
    finally:
        spark.conf.set(name, before)


def test_pages_with_columns_named_like_the_operators_own(spark):
    pages = spark.createDataFrame([(2, "u", "z" * 150), (1, "v", "z" * 150), (3, "w", "é" * 60)], "page_id long, url string, html string")
    for c in ("id", "payload", "digest", "block", "place", "first", "other"):
        pages = pages.selectExpr("*", f"'x' as {c}")
    got = rows(warc.round_trip(pages.select("block", "html", "digest", "url", "page_id", "id", "payload", "place", "first", "other")), "page_id")
    assert {k: (r["record_type"], r["refers_to"], r["payload_bytes"]) for k, r in got.items()} == {1: ("response", None, 150), 2: ("revisit", 1, 150), 3: ("response", None, 120)}


def test_a_popular_payload(spark):
    pages = spark.range(400).selectExpr("399 - id as page_id", "'u' as url", "if(id % 2 = 0, repeat('p', 300), concat(repeat('q', 200), id)) as html")
    got = rows(warc.round_trip(pages), "page_id")
    assert len(got) == 400 and {r["refers_to"] for k, r in got.items() if r["record_type"] == "revisit"} == {1} and sum(r["record_type"] == "revisit" for r in got.values()) == 199


@pytest.fixture(scope="module")
def long_texts(spark):
    """A text far longer than a block, of many distinct words, among short ones, one of them a near copy of its beginning."""
    r = random.Random(1)
    long = " ".join(f"w{r.randrange(40_000)}" for _ in range(60_000))
    texts = [long, "short text", long + " tail", " ".join(long.split()[100:140]), None]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)


def test_very_long_texts(spark, long_texts):
    texts, docs = long_texts
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    small = 1 << 14
    got = rows(near.near_duplicates(docs, block_bytes=small))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), c) for i, c in components_by_hand(sets).items()}
    cut = rows(substring.remove_repeats(docs, block_bytes=small))
    assert {i: r["n_removed"] for i, r in cut.items()} == {i: sum(g) for i, (_, g) in enumerate(removed_by_hand(texts))}
    scored = rows(suffix.score_texts(docs, block_bytes=small))
    assert [scored[i]["n_tokens"] for i in range(5)] == [len(words(t)) + 1 for t in texts]
    ids = encoded(texts, 2)
    back = rows(sequences.round_trip(docs, queries.tokenizer()))
    assert [back[i]["n_tokens"] for i in range(5)] == [len(x) for x in ids]
    packed = pack.pack_documents(docs, queries.tokenizer()).collect()
    assert Counter(r["doc_id"] for r in packed) == {i: -(-len(x) // 2048) for i, x in enumerate(ids)}
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.score_quality(docs, labels).count() == mixing.mix(docs, labels).count() == shards.shard_documents(docs, 3).count() == 5
    pages = docs.selectExpr("doc_id as page_id", "'u' as url", "text as html")
    assert {r["payload_bytes"] for r in warc.round_trip(pages).collect()} == {len((t or "").encode()) for t in texts}


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, *_):
            return None

    spark = type("S", (), {"conf": Conf(), "sparkContext": type("C", (), {"master": "spark://host:7077"})()})()
    with pytest.raises(ValueError, match="checkpoint.dir"):
        store.shared_dir(spark)


# ---- the pipeline


def test_pipeline_by_hand(spark, tmp_path):
    r = random.Random(11)
    plain, bad, junk = [f"p{i}" for i in range(200)], [f"t{i}" for i in range(6)], [f"%{i}" for i in range(30)]
    passage = [r.choice(plain) for _ in range(60)]
    texts = []
    for i in range(240):
        w = [r.choice(plain) for _ in range(120)]
        if i % 12 == 3:  # junk all over
            w = [r.choice(junk) if k % 3 else x for k, x in enumerate(w)]
        if i % 12 == 5:
            for k in range(0, 120, 9):
                w[k] = r.choice(bad)
        if i % 12 == 7:
            w = texts[-5].split()
            w[60] = "changed"
        if i % 40 == 10:
            w[20:80] = passage
        texts.append(" ".join(w))
    texts[100], texts[101] = None, "too short"
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    label = [(i, int(i % 12 != 3), int(i % 12 == 5)) for i in range(0, 240)]
    spark.createDataFrame(label, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept, stages = queries.table(spark, str(tmp_path), "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = store.written(stage(spark, kept, str(tmp_path)), name.replace(" ", "-"))
        stages[name] = before, kept
        if name != "best-fit packing":
            assert kept.schema == docs.schema
    texts_of = lambda df: {x["doc_id"]: x["text"] for x in df.collect()}
    before, after = map(texts_of, stages["quality rules"])
    gone = set(before) - set(after)
    assert {100, 101} <= gone and {i for i in before if i % 12 == 3} <= gone and not {i for i in gone if i % 12 not in (3, 5)} - {100, 101}
    before, after = map(texts_of, stages["near-dedup"])
    root = components_by_hand({i: shingles(t) for i, t in before.items()})
    assert after == {i: t for i, t in before.items() if root[i] == i} and len(after) < len(before)
    before, after = map(texts_of, stages["substring dedup"])
    order = sorted(before)
    left = {i: [x.decode() for x, g in zip(w, gone, strict=True) if not g] for i, (w, gone) in zip(order, removed_by_hand([before[i] for i in order]), strict=True)}
    assert {i: t.split() for i, t in after.items()} == left and sum(map(len, left.values())) < sum(len(t.split()) for t in before.values())
    assert all(x["n_chars"] == len(x["text"]) for x in stages["substring dedup"][1].collect())
    before, after = stages["mixing"]
    copies = Counter(x["doc_id"] for x in after.collect())
    clean = {x["doc_id"] for x in before.collect() if x["doc_id"] % 12 not in (3, 5)}
    assert all(copies[i] >= 1 for i in clean) and not any(copies[i] for i in texts_of(before) if i % 12 == 5)
    assert {x["doc_id"]: x["text"] for x in after.collect()}.items() <= texts_of(before).items()
    before, after = stages["best-fit packing"]
    tokens = {i: len(x) for i, x in zip(texts_of(before), encoded(list(texts_of(before).values()), 0), strict=True)}
    packed = after.collect()
    assert Counter((x["doc_id"], x["length"]) for x in packed) == Counter((i, tokens[i]) for i, n in copies.items() for _ in range(n))
    bins = defaultdict(int)
    for x in packed:
        bins[x["sequence_id"]] += x["length"]
    assert max(bins.values()) <= 2048 and len(bins) == one_by_one(Counter(x["length"] for x in packed), 2048, "norm")
    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda rows: sorted((x["doc_id"], x["piece"], x["length"], x["ids_crc32"]) for x in rows)
    assert key(whole.collect()) == key(packed)
