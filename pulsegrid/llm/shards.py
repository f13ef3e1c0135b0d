"""K-d tree sharding by distributed weighted medians (op4).

Equal texts form one item, with integer metadata dimensions.  A tree node is cut along its
widest dimension (as a share of that dimension's whole range) where its weight reaches the
share of leaves on the left.  All nodes of a level are searched at once: each round, tasks sum
weights into a bounded number of bins between a node's bounds, and the driver narrows the
bounds to the bin with the median; on a tie the search goes on along the next dimension and
at last along the item's and row's own numbers, so leaves come out nearly equal however much
weight one value holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import grams, store

#: Shards; bins of a round; part of a leaf's weight up to which equal texts are kept together.
SHARDS, BINS, TOGETHER = 24, 4096, 0.002


def _cuts(table: DataFrame, nodes: dict, together: float, bins: int) -> dict:
    """Median cuts of nodes {node: (leaves, weight, columns in order, bounds, a leaf's weight)}: {node: [(column, value), ...]}.

    A row is left of a cut [(c1, v1), (c2, v2), ...] if c1 < v1, or c1 = v1 and c2 < v2, and so
    on; a cut that ends in (c, v) takes c < v only.
    """
    state = {}
    for node, (leaves, weight, order, bounds, leaf) in nodes.items():
        state[node] = {"goal": weight * (leaves // 2) / leaves, "fixed": [], "order": order, "bounds": bounds, "leaf": leaf, "below": 0.0, "k": 0, "done": None}
    while any(s["done"] is None for s in state.values()):
        live = {n: s for n, s in state.items() if s["done"] is None}
        for s in live.values():
            s.setdefault("range", s["bounds"][s["order"][s["k"]]])
        bucket = F.lit(None)
        for n, s in live.items():
            c = F.col(s["order"][s["k"]])
            lo, hi = s["range"]
            s["width"] = max(1, -(-(hi - lo + 1) // bins))
            here = (c >= F.lit(lo)) & (c <= F.lit(hi))
            for name, v in s["fixed"]:
                here &= F.col(name) == F.lit(v)
            bucket = F.when(F.col("node") == n, F.when(here, F.floor((c - F.lit(lo)) / F.lit(s["width"])).cast("int"))).otherwise(bucket)
        sums = table.select("node", "weight", bucket.alias("bin")).where("bin is not null").groupBy("node", "bin").agg(F.sum("weight").alias("w")).toArrow()
        per: dict = {}
        for node, b, w in zip(*(sums[c].to_pylist() for c in ("node", "bin", "w")), strict=True):
            per.setdefault(node, []).append((b, float(w)))
        for n, s in live.items():
            lo, hi = s["range"]
            acc = s["below"]
            for b, w in sorted(per.get(n, [])):
                if acc + w >= s["goal"]:
                    break
                acc += w
            else:
                s["done"] = s["fixed"] + [(s["order"][s["k"]], hi + 1)]
                continue
            a = lo + b * s["width"]
            z = min(hi, a + s["width"] - 1)
            column = s["order"][s["k"]]
            small = w <= together * s["leaf"]
            if small or (a == z and s["k"] + 1 == len(s["order"])):
                s["done"] = s["fixed"] + [(column, a if s["goal"] - acc < acc + w - s["goal"] else z + 1)]
            elif a == z:
                s["fixed"] = s["fixed"] + [(column, a)]
                s["below"], s["k"] = acc, s["k"] + 1
                s.pop("range")
            else:
                s["below"], s["range"] = acc, (a, z)
    return {n: s["done"] for n, s in state.items()}


def _left(cut: list[tuple]):
    """The condition that a row is left of a cut."""
    out = F.lit(False)
    for i, (c, v) in enumerate(cut):
        here = F.col(c) < F.lit(v)
        for name, same in cut[:i]:
            here &= F.col(name) == F.lit(same)
        out |= here
    return out


def kd_shards(items: DataFrame, dims: list[str], leaves: int, ties: list[str], together: float = TOGETHER, bins: int = BINS) -> DataFrame:
    """Add ``shard`` (0 to leaves - 1) to a written table with long columns weight, dims and ties.

    ties are columns that tell apart what dims don't.  Only bounds and at most ``bins`` sums for
    each node come to the driver, a few times for each level.
    """
    table = items.withColumn("node", F.lit(0))
    every = list(dict.fromkeys(dims + ties))
    stats = table.agg(F.sum("weight").alias("w"), *[f(c).alias(f"{k}_{c}") for c in every for k, f in (("lo", F.min), ("hi", F.max))]).first()
    if stats["w"] is None:
        return table.withColumn("shard", F.lit(0)).drop("node")
    spread = {c: max(1, stats[f"hi_{c}"] - stats[f"lo_{c}"]) for c in every}
    leaf = float(stats["w"]) / leaves
    open_nodes, final = ({0: leaves}, {}) if leaves > 1 else ({}, {0: 0})
    nodes_seen = 1
    while open_nodes:
        rows = table.where(F.col("node").isin(list(open_nodes))).groupBy("node").agg(F.sum("weight").alias("w"), *[f(c).alias(f"{k}_{c}") for c in every for k, f in (("lo", F.min), ("hi", F.max))]).collect()
        nodes = {}
        for r in rows:
            bounds = {c: (r[f"lo_{c}"], r[f"hi_{c}"]) for c in every}
            widest = sorted(dims, key=lambda c: (-(bounds[c][1] - bounds[c][0]) / spread[c], dims.index(c)))
            order = list(dict.fromkeys([widest[0], *[c for c in ties if c != widest[0]]]))
            nodes[r["node"]] = (open_nodes[r["node"]], float(r["w"]), order, bounds, leaf)
        cuts = _cuts(table, nodes, together, bins)
        child, following = F.col("node"), {}
        for n, leaves_here in open_nodes.items():
            left, right = nodes_seen, nodes_seen + 1
            nodes_seen += 2
            if n in cuts:
                child = F.when(F.col("node") == n, F.when(_left(cuts[n]), F.lit(left)).otherwise(F.lit(right))).otherwise(child)
            for name, size in ((left, leaves_here // 2), (right, leaves_here - leaves_here // 2)):
                if size > 1:
                    following[name] = size
                else:
                    final[name] = len(final)
        # nothing is written: each pass works the few cuts above out again, over narrow rows
        table = grams.once(table, *[c for c in table.columns if c != "node"], child.cast("int").alias("node"))
        open_nodes = following
    shard = F.lit(0)
    for name, number in final.items():
        shard = F.when(F.col("node") == name, F.lit(number)).otherwise(shard)
    return table.withColumn("shard", shard.cast("int")).drop("node")


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", together: float = TOGETHER) -> DataFrame:
    """Put all documents into shards of nearly equal bytes.

    Returns id_col, size (UTF-8 bytes of the text, none for null, plus 8), text_crc32, law
    ("bytes"), shard, slot (gapless from 0 in each shard), grown_shard (null: the law is not by
    key).  Dimensions: bytes, characters and checksum of the text.  Equal texts fall on one side
    of a cut unless they are heavier than ``together`` of a shard; heavier groups are split by
    id.  Null ids sort first; repeated rows are rows of their own.  Extra columns are ignored; an
    empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.length(text).cast("long").alias("chars"), F.crc32(text.cast("binary")).cast("long").alias("crc"))
    # a row's own number: its id, and where ids repeat or are null the row's place in the written table
    rows = rows.withColumn("number", F.coalesce("id", F.lit(-(2**62)))).withColumn("row", F.monotonically_increasing_id()).withColumn("weight", F.col("size"))
    items = store.written(rows, "items")
    placed = kd_shards(items, ["size", "chars", "crc"], shards, ["crc", "size", "number", "row"], together)
    made = placed.withColumn("lot", F.pmod(F.xxhash64("number"), F.lit(max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))))
    per = made.groupBy("shard", "lot").agg(F.count("*").alias("n"))
    begin = F.sum("n").over(W.partitionBy("shard").orderBy("lot").rowsBetween(W.unboundedPreceding, -1))
    starts = per.withColumn("begin", F.coalesce(begin, F.lit(0))).drop("n")
    slot = F.row_number().over(W.partitionBy("shard", "lot").orderBy("number", "row")) - 1
    out = made.withColumn("k", slot).join(starts, ["shard", "lot"])
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("begin") + F.col("k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
