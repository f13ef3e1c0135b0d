"""Vector best-fit packing (op6).

Items are pieces of at most ``capacity`` tokens; a bin holds tokens, documents and attention
cost (the sum of squared lengths).  Items of equal length are interchangeable, so the packing
is worked out on the histogram of lengths (at most ``capacity`` entries whatever the corpus):
longest first, each item goes to the kind of open bin that fits under every capacity and fits
best by weighted dot-product of item and residual or by the norm of what stays free; equal
bins are handled together, with their number.  Distributed ranks within a length then send
every piece to its place.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, tokens
from .text import buffers

CAPACITY, MOST_DOCS, END_ID = 2048, 2048, 0
WEIGHTS = (1.0, 0.05, 0.05)


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY, most_docs: int = MOST_DOCS, most_cost: int | None = None, rule: str = "norm", weights: tuple = WEIGHTS) -> list[tuple[int, int, int, int, int]]:
    """Place a histogram of lengths. Segments (length, first rank, number, first bin, offset in the bin).

    ``number`` items of that length, from that rank on, go to as many consecutive bins, one
    each.  rule "norm" picks the open bin that leaves the least weighted norm of free shares,
    "dot" the one with the largest weighted dot-product of item and residual shares; ties go
    to the fuller, then the older bin.
    """
    most_cost = capacity * capacity if most_cost is None else most_cost
    w_tokens, w_docs, w_cost = weights
    #: open bins by free tokens: {free: {(docs, cost): [(first bin, number)]}}
    open_bins: dict[int, dict] = defaultdict(dict)
    frees: list[int] = []
    out, bins = [], 0

    def put(free, docs, cost, first, number):
        if free not in open_bins or not open_bins[free]:
            if free not in open_bins:
                open_bins[free] = {}
            i = bisect.bisect_left(frees, free)
            if i == len(frees) or frees[i] != free:
                frees.insert(i, free)
        open_bins[free].setdefault((docs, cost), []).append((first, number))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        square = length * length
        if square > most_cost or length > capacity or most_docs < 1:
            raise ValueError(f"an item of {length} tokens fits no bin")
        while left:
            best = None
            i = bisect.bisect_left(frees, length)
            for free in frees[i:]:
                for (docs, cost), runs in open_bins[free].items():
                    if docs + 1 > most_docs or cost + square > most_cost:
                        continue
                    a, b, c = free / capacity, (most_docs - docs) / most_docs, (most_cost - cost) / most_cost
                    if rule == "dot":
                        score = -(w_tokens * a * length / capacity + w_docs * b / most_docs + w_cost * c * square / most_cost)
                    else:
                        score = w_tokens * (a - length / capacity) ** 2 + w_docs * (b - 1 / most_docs) ** 2 + w_cost * (c - square / most_cost) ** 2
                    key = (score, free, runs[0][0])
                    if best is None or key < best[0]:
                        best = (key, free, docs, cost)
                # more free tokens can only be worse once tokens alone exceed the best score
                if best and rule == "norm" and w_tokens * ((free + 1 - length) / capacity) ** 2 > best[0][0]:
                    break
            if best is None:  # new bins are all that takes the items left of this length
                free, docs, cost, first, number = capacity, 0, 0, bins, left
            else:
                _, free, docs, cost = best
                first, number = open_bins[free][(docs, cost)][0]
            # the norm of a bin that took an item falls further, so it takes the next one too; the dot
            # product falls, so an equal bin goes first, but a new bin alone is filled like that as well
            deep = min(free // length, most_docs - docs, (most_cost - cost) // square) if rule == "norm" or best is None else 1
            deep = min(deep, left)
            used = min(number, left // deep)
            if best is None:
                bins += used
            else:
                runs = open_bins[free][(docs, cost)]
                runs.pop(0)
                if used < number:
                    runs.insert(0, (first + used, number - used))
                if not runs:
                    del open_bins[free][(docs, cost)]
                    if not open_bins[free]:
                        frees.pop(bisect.bisect_left(frees, free))
            for k in range(deep):
                out.append((length, rank, used, first, capacity - free + k * length))
                rank += used
            left -= used * deep
            if free > deep * length:
                put(free - deep * length, docs + deep, cost + deep * square, first, used)
    return out


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Token pieces of every document: id, piece, start, length, ids_crc32 (and ids, with keep_ids)."""
    schema = f"{id_col} long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    tokens.check_split(tokenizer)

    def run(batches):
        for batch in batches:
            raw, at = buffers(batch.column(1))
            for a, b in tokens.slices(at):
                ids, begin = tokens.encoder(tokenizer).encode(raw[at[a] : at[b]], at[a : b + 1] - at[a], end_id)
                count = np.diff(begin)
                n = -(-count // capacity)
                row = np.repeat(np.arange(b - a), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, count[row] - start)
                data = ids.astype("<u4").tobytes()
                lo = (begin[row] + start) * 4
                spans = [data[x:y] for x, y in zip(lo.tolist(), (lo + length * 4).tolist(), strict=True)]
                out = [batch.column(0).slice(a, b - a).take(pa.array(row)), piece.astype(np.int32), start, length, np.array([zlib.crc32(x) for x in spans], np.int64)]
                yield store.columns_batch(out + [pa.array(spans, pa.binary())] * keep_ids, schema)
        store.lean()

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, most_docs: int = MOST_DOCS, most_cost: int | None = None, rule: str = "norm", end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns id_col, piece, start, length, ids_crc32, sequence_id, offset (and ids with
    keep_ids).  A document is its ids and then end_id, so a null or empty text is one token;
    only longer ones are cut.  Pieces longer than the cost capacity allows raise.  Rows with a
    null id and repeated rows are packed like any other.  Extra columns are ignored.  An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    made = store.written(pieces(docs, tokenizer, id_col, text_col, capacity, end_id, keep_ids).withColumn("lot", F.spark_partition_id()), "pieces")
    # ranks within a length: lots give each length a consecutive range, the driver keeps one number per length
    counts = made.groupBy("length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.toLocalIterator()}
    plan = best_fit(histogram, capacity, most_docs, most_cost, rule)
    ranks = ranked(made, "length", [id_col, "piece", "ids_crc32"])
    table = np.array(plan or np.zeros((0, 5)), np.int64)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    shared = spark.sparkContext.broadcast((table[:, 0], table[:, 1], table[:, 3], table[:, 4]))
    schema = f"{id_col} long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def place(batches):
        length, first, bins, offset = shared.value
        key = length * (1 << 44) + first
        for b in batches:
            n, r = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(key, n * (1 << 44) + r, "right") - 1
            yield store.columns_batch([b.column(c) for c in names] + [bins[i] + r - first[i], offset[i]], schema + ", sequence_id long, offset long")

    return ranks.mapInArrow(place, schema + ", sequence_id long, offset long")


def ranked(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rank from 0 of every row among the rows of its key: no key's rows meet in one task.

    df must be a written table with a column ``lot`` that splits each key's rows; within a
    (key, lot) rows are numbered in the given order, and lots begin where the ones before them
    end.  Rows equal in ``order`` must be interchangeable, so that a task run again after a
    loss gives the same rows.
    """
    from pyspark.sql import Window as W

    per = df.groupBy(key, "lot").agg(F.count("*").alias("n"))
    starts = per.withColumn("begin", F.sum("n").over(W.partitionBy(key).orderBy("lot").rowsBetween(W.unboundedPreceding, -1))).select(key, "lot", F.coalesce("begin", F.lit(0)).alias("begin"))
    within = df.withColumn("k", F.row_number().over(W.partitionBy(key, "lot").orderBy(*order)) - 1)
    return within.join(starts, [key, "lot"]).withColumn("rank", F.col("begin") + F.col("k")).drop("begin", "k", "lot")
