"""MinHash near-dedup by a chosen-path set similarity join (op2).

Documents with equal shingle sets form classes; the join is over class representatives.
Independent trees branch documents recursively: a node picks one or two of the minhash
positions (4/3 on average, one over the threshold) and sends each document to the children
that its values there name.  Nodes of few documents are compared exhaustively by signature;
what similar signatures connect is a candidate group, and only inside candidate groups are
full sets compared, so links are exact.  See ``recall`` for the chance that a pair is met.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import store
from .components import components
from .text import SLICE, Words, chain, mix, second

#: Words of a shingle, percent of similarity that links, minhash values, trees, levels, documents
#: of a small node, estimated similarity from which two documents are candidates, and documents
#: and shingle bytes compared in one task.
SHINGLE, PERCENT, VALUES, TREES, LEVELS, NODE, LOOSE_AT, GROUP_DOCS, GROUP_BYTES = 5, 75, 96, 11, 3, 64, 0.5, 512, 24 << 20
_MULTIPLY = np.random.default_rng(91).integers(1, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def recall(similarity: float, trees: int = TREES, levels: int = LEVELS, percent: int = PERCENT) -> float:
    """Least chance that a pair of this similarity shares a node of the last level in some tree."""
    q, two = 1.0, 100 / percent - 1
    for _ in range(levels):
        x = similarity * q
        q = two * (1 - (1 - x) ** 2) + (1 - two) * x
    return 1 - (1 - q) ** trees


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, sorted within each, and where each text's begin."""
    _, h = words.windows(k)
    n = words.counts()
    full = np.maximum(0, n - (k - 1))
    begin = np.r_[0, np.cumsum(full)]
    lone = np.zeros(len(n), np.uint64)
    for short in range(1, k):
        rows = np.flatnonzero(n == short)
        lone[rows] = chain([words.hash[words.offsets[rows] + j] for j in range(short)])
    sets, size, a = [np.zeros(0, np.uint64)], np.zeros(len(n), np.int64), 0
    while a < len(n):  # some texts at a time, as sorting takes several arrays
        b = max(a + 1, int(np.searchsorted(begin, begin[a] + SLICE, "right")) - 1)
        rows = np.flatnonzero((n[a:b] > 0) & (n[a:b] < k)) + a
        x = np.concatenate([h[begin[a] : begin[b]], lone[rows]])
        text = np.concatenate([np.repeat(np.arange(a, b), full[a:b]), rows])
        order = np.lexsort((x, text))
        x, text = x[order], text[order]
        keep = np.r_[np.ones(min(1, len(x)), bool), (x[1:] != x[:-1]) | (text[1:] != text[:-1])]
        sets.append(x[keep])
        size[a:b] = np.bincount(text[keep] - a, minlength=b - a)
        a = b
    return np.concatenate(sets), np.r_[0, np.cumsum(size)]


def signatures(h: np.ndarray, at: np.ndarray, values: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the non-empty sets: minhash values (rows x values, uint32) and two 64-bit digests."""
    starts = at[:-1][np.diff(at) > 0]
    if not len(starts):
        return np.zeros((0, values), np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    out = np.empty((len(starts), values), np.uint32)
    for i in range(values):
        x = h * _MULTIPLY[i]
        x >>= np.uint64(32)
        out[:, i] = np.minimum.reduceat(x, starts)
    return out, np.add.reduceat(second(h, 1), starts).view(np.int64), np.add.reduceat(second(h, 2), starts).view(np.int64)


def branches(node: np.ndarray, sig: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Children of (node, document) rows: row numbers and child nodes."""
    two = np.uint64(round((100 / percent - 1) * 2**32))
    first = second(node, 11)
    i = (first % np.uint64(sig.shape[1])).astype(np.int64)
    j = (i + 1 + (second(node, 12) % np.uint64(sig.shape[1] - 1)).astype(np.int64)) % sig.shape[1]
    rows, places = np.arange(len(node)), i
    extra = np.flatnonzero(second(node, 13) >> np.uint64(32) < two)
    rows, places = np.concatenate([rows, extra]), np.concatenate([places, j[extra]])
    child = chain([node[rows], places.astype(np.uint64), mix(sig[rows, places].astype(np.uint64))])
    return rows, child


def same_group(sig: np.ndarray, least: float) -> np.ndarray:
    """For nodes of equal size (nodes x members x values, uint8): the first member each is connected with."""
    n, m, v = sig.shape
    near = np.ones((n, m, m), bool)
    floor = v * (least + (1 - least) / 256)
    for d in range(1, m):
        equal = (sig[:, d:] == sig[:, :-d]).sum(2) >= floor
        at = np.arange(m - d)
        near[:, at, at + d] = near[:, at + d, at] = equal
    label = np.tile(np.arange(m), (n, 1))
    while True:
        low = np.where(near, label[:, None, :], m).min(2)
        if (low == label).all():
            return label
        label = low


def node_edges(batches, least: float):
    """From rows (node, rep, sig8) sorted by node: edges that connect similar members."""
    rest = None
    for batch in [*([batches] if isinstance(batches, pa.RecordBatch) else batches), None]:
        table = pa.Table.from_batches([x for x in (rest, batch) if x is not None]) if rest is not None or batch is not None else None
        if table is None:
            return
        table = table.combine_chunks().to_batches()[0] if table.num_rows else None
        if table is None:
            continue
        node = table.column(0).to_numpy()
        cut = np.flatnonzero(np.r_[True, node[1:] != node[:-1], True])
        if batch is not None:
            rest, cut = table.slice(cut[-2]), cut[:-1]
        sizes = np.diff(cut)
        rep, flat = table.column(1).to_numpy(), np.frombuffer(b"".join(table.column(2).to_pylist()), np.uint8)
        flat = flat.reshape(len(node), -1)
        for m in np.unique(sizes[sizes > 1]):
            starts = cut[:-1][sizes == m]
            step = max(1, (4 << 20) // int(m * m * 8 + m * flat.shape[1]))
            for a in range(0, len(starts), step):
                at = starts[a : a + step, None] + np.arange(m)
                label = same_group(flat[at], least)
                to = np.take_along_axis(rep[at], label, 1)
                use = label != np.arange(m)
                yield store.columns_batch([rep[at][use], to[use]], "a long, b long")


class Groups:
    """Union-find over a few items."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.root(i)] = self.root(j)


def exact_links(ids: list, fragments: list, sets: list, sigs: np.ndarray, asking: np.ndarray, percent: int, least: float):
    """Edges among the items, at least one end asking, that connect whatever links connect.

    Pairs already connected (by fragment or an earlier edge) are skipped; all other pairs
    whose signatures agree enough are decided on full sets.
    """
    n = len(ids)
    groups, seen = Groups(n), {}
    for i, f in enumerate(fragments):
        if seen.setdefault(f, i) != i:
            groups.join(i, seen[f])
    size = np.array([len(s) for s in sets])
    floor = sigs.shape[1] * (least + (1 - least) / 256)
    found = []
    for i in np.flatnonzero(asking):
        other = np.arange(n) if not asking.all() else np.arange(i + 1, n)
        agree = (sigs[other] == sigs[i]).sum(1)
        fits = (agree >= floor) & (100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i])) & (other != i)
        found.append(np.stack([np.full(fits.sum(), i), other[fits], agree[fits]]))
    pairs = np.concatenate(found, 1) if found else np.zeros((3, 0), np.int64)
    for i, j in pairs[:2, np.argsort(-pairs[2], kind="stable")].T.tolist():
        if groups.root(i) == groups.root(j):
            continue
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 100 * both >= percent * (size[i] + size[j] - both):
            groups.join(i, j)
            yield ids[i], ids[j]


def _linked(rows: DataFrame, keys: list[str], percent: int, least: float, parts: int) -> DataFrame:
    """Edges inside each group of rows (keys, id, fragment, asking, sig8, shingles)."""

    def run(batches):
        held: dict = {}
        some = False

        def done():
            cols = list(zip(*held["rows"], strict=True))
            sigs = np.frombuffer(b"".join(cols[3]), np.uint8).reshape(len(cols[0]), -1)
            return list(exact_links(cols[0], cols[1], [np.frombuffer(x, np.uint64) for x in cols[4]], sigs, np.array(cols[2], bool), percent, least))

        for row in store.rows(batches):
            key = tuple(row[k] for k in keys)
            if held.get("key") != key:
                if held:
                    some = True
                    yield store.to_batch(done(), "a long, b long")
                held = {"key": key, "rows": []}
            held["rows"].append((row["id"], row["fragment"], row["asking"], row["sig8"], row["shingles"]))
        if held:
            yield store.to_batch(done(), "a long, b long")
        elif not some:
            yield store.to_batch([], "a long, b long")
        held.clear()
        store.lean()

    return rows.select(*keys, "id", "fragment", "asking", "sig8", "shingles").repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """Components of documents under the links 100 * intersection >= percent * union of shingle sets.

    Returns id_col, n_shingles, component_id (the smallest id reachable), kept (the id is its
    component's).  Words are lower-cased in A-Z; a text of fewer words than a shingle has one
    shingle, the whole of it; a text without words, or null, has none and links with nothing.
    Rows with a null id come back with a null component and kept true.  Rows that share an id
    are one vertex, linked by whichever text links.  Extra columns are ignored.  An empty table
    gives an empty result.
    """
    table = store.blocks(docs, id_col, text_col, parameters.pop("block_bytes", store.BLOCK_BYTES))
    found = _vertices(table, **parameters)
    store.drop(table)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest id stays.

    Cases are as in near_duplicates(); of rows that share the smallest id, one stays; rows with
    a null id all stay.  All columns are kept.
    """
    table = store.blocks(docs, id_col, text_col, parameters.pop("block_bytes", store.BLOCK_BYTES), whole_rows=True)
    found = _vertices(table, **parameters)
    first = found.where("id = component").groupBy("component").agg(F.min(F.struct("block", "place")).alias("r")).select("r.block", "r.place")
    stay = first.unionByName(found.where("id is null").select("block", "place"))
    path = store.deliver(stay, "stay")
    names = docs.columns

    def run(batches):
        for row in store.rows(batches):
            places = store.delivered(path, row["block"])
            if places is not None:
                yield store.Block(row).restored(names, id_col, text_col, np.sort(places["place"].to_numpy().astype(np.int64)))
            store.lean()

    kept = table.mapInArrow(run, store.restored_schema(docs, id_col))
    return kept.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in docs.schema])


def _vertices(table: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, trees: int = TREES, levels: int = LEVELS, node: int = NODE, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Every row of a table of blocks with its component: block, place, id, n (shingles), component."""
    spark = table.sparkSession
    made: list[str] = []  # what only this function reads

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = store.written(df, name)
        made.append(out._pulsegrid_path)
        return out

    def grouped(edges: DataFrame) -> DataFrame:
        out = components(edges)
        made.append(out._pulsegrid_path)
        return out

    _, size = store.corpus_size(table)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def describe(block):
        words = block.words(lower=True)
        h, at = shingle_sets(words, shingle)
        n = np.diff(at)
        sig, one, two = signatures(h, at, VALUES)
        full = np.flatnonzero(n)
        d1, d2 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        d1[full], d2[full] = one, two
        empty = np.ones(len(n), bool)
        empty[full] = False
        values: list = [None] * len(n)
        for k, i in enumerate(full.tolist()):
            values[i] = sig[k].tobytes()
        where = np.full(len(n), block.block)
        yield from zip([None if x else i for i, x in zip(block.ids.tolist(), block.null, strict=True)], n.tolist(), d1.tolist(), d2.tolist(), values, where.tolist(), range(len(n)), strict=True)

    info = keep(store.per_block(table, describe, "id long, n long, d1 long, d2 long, sig binary, block long, place int"), "signatures")
    key = ["n", "d1", "d2"]
    full = info.where("n > 0 and id is not null")
    # a block is a partition and a number in it, so block and place fit one number (see store.blocks)
    number = F.shiftleft(F.shiftright("r.block", 32), 40) + F.shiftleft(F.col("r.block").bitwiseAND(0xFFFFFFFF), 18) + F.col("r.place")
    classes = full.groupBy(*key).agg(F.min(F.struct("id", "block", "place")).alias("r")).select(*key, F.col("r.id").alias("first"), number.alias("rep"), F.col("r.block").alias("block"), F.col("r.place").alias("place"))
    # a class is known by its place: texts that share an id are several classes, one vertex only at the end
    reps = keep(classes.join(info.select("block", "place", "sig"), ["block", "place"]), "representatives")

    def narrow(sig: DataFrame) -> DataFrame:
        """The low byte of every value, for estimates."""

        def run(batches):
            for b in batches:
                x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, VALUES), np.uint32)
                low = (x & 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in low], pa.binary())], names=["key", "sig8"])

        return sig.mapInArrow(run, "key long, sig8 binary")

    def grow(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(b.num_rows, -1)
            rep, start = b.column("rep").to_numpy(), b.column("node").to_numpy().view(np.uint64)
            for t in range(trees) if b.schema.get_field_index("tree") >= 0 else [0]:
                at = second(start, 100 + t) if b.schema.get_field_index("tree") >= 0 else start
                rows, child = branches(at, sig, percent)
                yield store.columns_batch([child.view(np.int64), rep[rows]], "node long, rep long")

    entries = reps.select("rep", "sig", F.lit(0).cast("long").alias("node"), F.lit(0).alias("tree")).mapInArrow(grow, "node long, rep long")
    members, edges = [], []
    for level in range(1, levels + 1):
        entries = keep(entries.distinct(), "entries")
        sizes = keep(entries.groupBy("node").agg(F.count("*").alias("size"), F.min("rep").alias("low")).where("size > 1"), "nodes")
        members.append(entries.join(sizes.where(F.col("size") <= node).select("node"), "node").select(F.xxhash64("node", F.lit(level)).alias("node"), "rep"))
        large = sizes.where(F.col("size") > node)
        if large.isEmpty():
            break
        beyond = entries.join(large, "node")
        if level == levels:  # members agree in so many values that they may be one candidate group
            edges.append(beyond.select(F.col("rep").alias("a"), F.col("low").alias("b")))
        else:
            entries = beyond.select("node", "rep").join(reps.select("rep", "sig"), "rep").mapInArrow(grow, "node long, rep long")
    compact = keep(narrow(reps.select("rep", "sig")), "compact").withColumnRenamed("key", "rep")
    small = members[0]
    for m in members[1:]:
        small = small.unionByName(m)
    compare = small.join(compact, "rep").select("node", "rep", "sig8").repartition(parts, "node").sortWithinPartitions("node")
    edges.append(compare.mapInArrow(lambda it: node_edges(it, LOOSE_AT), "a long, b long"))
    candidate = edges[0]
    for e in edges[1:]:
        candidate = candidate.unionByName(e)
    groups = grouped(candidate).select(F.col("id").alias("rep"), F.col("component").alias("comp"))
    groups = keep(groups.join(reps.select("rep", "n", "block", "place"), "rep").join(compact, "rep"), "candidates")
    load = groups.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / group_docs), F.ceil(F.sum(F.col("n") * 8) / GROUP_BYTES)).cast("int").alias("chunks"))
    load = keep(load, "load")

    def sets(which: DataFrame) -> DataFrame:
        """Full sets of the chosen representatives, out of their blocks."""
        wanted = groups.join(which, "comp").withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("chunks")).cast("int"))
        path = store.deliver(wanted.select("block", "place", "comp", "chunk", "rep", "sig8"), "asked")
        made.append(path)

        def run(batches):
            schema = "comp long, chunk int, id long, sig8 binary, shingles binary"
            some = False
            for row in store.rows(batches):
                asked = store.delivered(path, row["block"])
                if asked is None:
                    continue
                h, at = shingle_sets(store.Block(row).words(lower=True), shingle)
                for out in store.chunks(((r["comp"], r["chunk"], r["rep"], r["sig8"], h[at[r["place"]] : at[r["place"] + 1]].tobytes()) for r in asked.to_pylist()), 512):
                    some = True
                    yield store.to_batch(out, schema)
                del h, at, asked
            store.lean()
            if not some:
                yield store.to_batch([], schema)

        return table.mapInArrow(run, "comp long, chunk int, id long, sig8 binary, shingles binary")

    wide = max(parts, store.bucket_count(size))
    alone = F.col("id").alias("fragment"), F.lit(True).alias("asking")
    links = keep(_linked(sets(load.where("chunks = 1")).select("*", *alone), ["comp", "chunk"], percent, LOOSE_AT, wide), "links")
    big = load.where("chunks > 1")
    if not big.isEmpty():
        links = links.unionByName(_large(keep(sets(big), "sets"), percent, wide, keep, grouped))
    found = grouped(links)
    named = classes.select(*key, "rep", "first").join(found.select(F.col("id").alias("rep"), F.col("component").alias("linked")), "rep", "left")
    lowest = named.where("linked is not null").groupBy("linked").agg(F.min("first").alias("low"))
    where = named.join(lowest, "linked", "left").select(*key, F.coalesce("low", "first").alias("component"))
    joined = info.select("id", "block", "place", *key).join(where, key, "left")
    # rows that share an id are one vertex: a second pass only if there are any
    if not full.groupBy("id").agg(F.countDistinct(*key).alias("k")).where("k > 1").isEmpty():
        again = grouped(joined.select(F.col("id").alias("a"), F.col("component").alias("b")))
        joined = joined.join(again.select(F.col("id"), F.col("component").alias("whole")), "id", "left").withColumn("component", F.coalesce("whole", "component"))
    out = store.written(joined.select("block", "place", "id", "n", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component")), "vertices")
    for path in made:
        store.remove(spark, path)
    return out


def _large(sets: DataFrame, percent: int, parts: int, keep, grouped) -> DataFrame:
    """Links of candidate groups too large for one task.

    Chunks are linked inside; then the first members of the largest fragments are held against
    every chunk; what still isn't with the largest fragment (its loose members) is held, in
    blocks, against every chunk.  A link that could still be missing would have both ends with
    the largest fragment, where it adds nothing.
    """

    def labelled(edges):
        found = grouped(edges).withColumnRenamed("component", "fragment")
        return sets.join(found, "id", "left").withColumn("fragment", F.coalesce("fragment", "id"))

    def against(asking, now):
        chunks = now.select("comp", "chunk").distinct()
        ask = asking.drop("chunk").join(chunks, "comp").select("comp", "chunk", "part", "id", "fragment", F.lit(True).alias("asking"), "sig8", "shingles")
        parts_of = ask.select("comp", "chunk", "part").distinct()
        answer = now.join(parts_of, ["comp", "chunk"]).select("comp", "chunk", "part", "id", "fragment", F.lit(False).alias("asking"), "sig8", "shingles")
        return keep(_linked(ask.unionByName(answer), ["comp", "chunk", "part"], percent, LOOSE_AT, parts), "links")

    links = keep(_linked(sets.select("*", F.col("id").alias("fragment"), F.lit(True).alias("asking")), ["comp", "chunk"], percent, LOOSE_AT, parts), "links")
    order = W.partitionBy("comp").orderBy(F.desc("size"), "fragment")
    now = keep(labelled(links), "fragments")
    first = now.groupBy("comp", "fragment").agg(F.count("*").alias("size")).withColumn("k", F.row_number().over(order)).where("k <= 8").select("comp", F.col("fragment").alias("id"))
    links = links.unionByName(against(now.join(first, ["comp", "id"]).withColumn("part", F.lit(0)), now))
    now = keep(labelled(links), "fragments")
    largest = now.groupBy("comp", "fragment").agg(F.count("*").alias("size")).withColumn("k", F.row_number().over(order)).where("k = 1").select("comp", "fragment")
    loose = now.join(largest, ["comp", "fragment"], "left_anti")
    count = loose.groupBy("comp").agg(F.ceil(F.count("*") / 256).cast("int").alias("in_parts"))
    loose = loose.join(count, "comp").withColumn("part", F.pmod(F.xxhash64("id", F.lit(6)), F.col("in_parts")).cast("int"))
    return links.unionByName(against(loose, now))
