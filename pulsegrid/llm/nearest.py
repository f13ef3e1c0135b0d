"""Approximate nearest neighbours by a permutation index (op10).

Every vector is represented by the order of the pivots, nearest first.  A shard of the index
posts its vectors in one inverted file per pivot, with the pivot's place in each vector's
order.  A query visits the files of its own nearest pivots, ranks the shard's vectors by the
footrule distance over those pivots, and a small share of them, the best, are ranked again by
their true distance.

The index is a written table, a row for each shard; queries go to all shards in broadcast
blocks of a fixed size, so no query is copied through a shuffle, and only the k best of each
query and shard are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import store

#: Pivots, those whose files a query visits, share of a shard's vectors that are reranked and the
#: least number for each neighbour wanted, vectors of a shard, bytes of queries broadcast at a time
#: and of them held against a shard at a time; pivots are fitted on a sample this large.
PIVOTS, VISITED, RERANK, RERANK_LEAST, SHARD_ROWS, QUERY_BYTES, SAMPLE = 512, 256, 0.04, 10, 8192, 32 << 20, 4096


def usable(df: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector is not null, empty or zero and has only finite components."""
    v = F.col(vec_col)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(v.isNotNull() & (F.size(v) > 0)).where(F.coalesce(good, F.lit(False))).where(F.exists(v, lambda x: x != 0))


def fit_pivots(vectors: DataFrame, id_col: str, vec_col: str, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Pivots spread by farthest-first choice over a sample bounded by ``sample`` rows (those with the smallest hashes)."""
    rows = vectors.orderBy(F.xxhash64(F.col(id_col), F.lit(17)), id_col).limit(sample).select(vec_col).collect()
    if not rows:
        return np.zeros((0, 0))
    x = np.array([r[0] for r in rows], np.float64)
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(x)) and far.max() > 0:
        # half of the pivots are the farthest ones, half are taken as they come
        i = int(far.argmax()) if len(chosen) % 2 else int(np.flatnonzero(far > 0)[0])
        chosen.append(i)
        far = np.minimum(far, ((x - x[i]) ** 2).sum(1))
    return x[chosen]


def orders(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivots of each vector, nearest first, ties to the smaller pivot number."""
    d = (x**2).sum(1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(1)
    return np.argsort(d, axis=1, kind="stable")


class Shard:
    """Inverted files of pivots over one shard's vectors: files[p] has pivot p's place in each vector's order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, files: np.ndarray):
        self.ids, self.x, self.files = ids, x, files

    @classmethod
    def of(cls, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray) -> Shard:
        files = np.empty((len(ids), len(pivots)), np.int16)
        np.put_along_axis(files, orders(x, pivots), np.arange(len(pivots), dtype=np.int16)[None], 1)
        return cls(ids, x, np.ascontiguousarray(files.T))

    def row(self) -> tuple[bytes, bytes, bytes]:
        """ids, vectors (of four bytes a value where that loses nothing) and files."""
        short = self.x.astype(np.float32)
        exact = short.astype(np.float64)
        return store.pack(self.ids), store.pack(short if (exact == self.x).all() else self.x), store.pack(self.files.ravel())

    @classmethod
    def from_row(cls, ids: bytes, x: bytes, files: bytes) -> Shard:
        (ids,), (x,), (files,) = (store.unpack(v) for v in (ids, x, files))
        return cls(ids, x.astype(np.float64).reshape(len(ids), -1), files.reshape(-1, len(ids)))

    def footrules(self, order: np.ndarray) -> np.ndarray:
        """Footrule distance of all vectors of the shard over the pivots visited, in the query's order."""
        out = np.zeros(len(self.ids), np.int32)
        for a in range(0, len(order), 64):
            near = self.files[order[a : a + 64]]
            near -= np.arange(a, a + len(near), dtype=np.int16)[:, None]
            out += np.abs(near, out=near).sum(0, dtype=np.int32)
        return out

    def search(self, ids: np.ndarray, q: np.ndarray, order: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, vector ids and distances of the k best of each query in this shard."""
        found: list[tuple] = []
        for i in range(len(ids)):
            rule = self.footrules(order[i])
            most = min(len(rule), rerank + 1)  # one may be the query itself
            near = np.argpartition(rule, most - 1)[:most]
            near = near[self.ids[near] != ids[i]]
            d = np.sqrt(((self.x[near] - q[i]) ** 2).sum(1))
            best = np.lexsort((self.ids[near], d))[:k]
            found.append((np.full(len(best), ids[i]), self.ids[near][best], d[best]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def clean(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows that take part: usable vectors with an id, of rows with one id the smallest vector."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col(id_col).isNotNull())
    return usable(rows, "v").groupBy("id").agg(F.min("v").alias("v"))


def vectors_of(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("id").to_numpy(), np.asarray(batch.column("v").flatten()).reshape(-1, width)


def build(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, np.ndarray]:
    """The index of all vectors that take part, a written table, and its pivots (none for an empty table)."""
    every = store.written(clean(vectors, id_col, vec_col), "vectors")
    # the length that most vectors have, and how many those are: one row for each length
    usual = every.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    width, n = usual or (0, 0)
    data = every.where(F.size("v") == width)
    centre = fit_pivots(data, "id", "v", pivots)
    shards = max(1, -(-n // shard_rows))
    schema = "ids binary, x binary, files binary"

    def run(batches):
        number, held = None, []

        def made():
            return store.to_batch([Shard.of(*(np.concatenate(c) for c in zip(*held, strict=True)), centre).row()], schema)

        for batch in batches:
            shard = batch.column("shard").to_numpy()
            cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(shard) else [0]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if shard[a] != number:
                    if held:
                        yield made()
                    number, held = shard[a], []
                held.append(tuple(np.array(v) for v in vectors_of(batch.slice(a, b - a), width)))
        yield made() if held else store.to_batch([], schema)

    if not len(centre):
        return data.select(*[F.lit(b"").alias(c) for c in ("ids", "x", "files")]).where(F.lit(False)), centre
    dealt = data.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "v").repartition(max(shards, int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "shard").sortWithinPartitions("shard", "id")
    index = store.written(dealt.mapInArrow(run, schema), "index")
    store.drop(every)
    return index, centre


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, pivots: int = PIVOTS, visited: int = VISITED, rerank: float = RERANK, rerank_least: int = RERANK_LEAST, shard_rows: int = SHARD_ROWS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The k nearest vectors of each query by Euclidean distance, as the index finds them.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id; a query is no
    candidate of its own (rows that share its id neither).  Vectors that are null, empty, zero
    or hold null or non-finite components take no part, nor do rows with a null id or with
    another length than most.  Rows repeated with one id count once (the smallest
    vector).  Fewer than k candidates: all of them.  Extra columns, whatever their names, are
    ignored.  Empty tables give an empty result.

    Every vector is indexed.  In each shard ``rerank`` of its vectors, and at least
    ``rerank_least`` for each neighbour wanted, get their true distance.
    """
    index, centre = build(vectors, id_col, vec_col, pivots, shard_rows)
    spark, out_schema = vectors.sparkSession, "query_id long, vec_id long, score double"
    width = centre.shape[1]
    found = None
    if len(centre):
        ask = store.written(clean(queries, id_col, vec_col).where(F.size("v") == width), "queries")
        blocks = max(1, -(-ask.count() * (width + 1) * 8 // query_bytes))
        for n in range(blocks):
            # one bounded block of queries at a time comes to the driver and goes out to all shards
            block = ask.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)) == n).orderBy("id").toArrow()
            ids = block["id"].to_numpy()
            q = np.array([v.as_py() for v in block["v"]], np.float64).reshape(len(ids), width)
            shared = spark.sparkContext.broadcast((ids, q, orders(q, centre)[:, :visited].astype(np.int16)))

            def run(batches, shared=shared):
                ids, q, order = shared.value
                for row in store.rows(batches):
                    shard = Shard.from_row(*row.values())
                    n = max(rerank_least * k, int(np.ceil(rerank * len(shard.ids))))
                    for a in range(0, len(ids), 512):
                        yield store.columns_batch(list(shard.search(ids[a : a + 512], q[a : a + 512], order[a : a + 512], k, n)), out_schema)
                yield store.to_batch([], out_schema)

            part = index.mapInArrow(run, out_schema)
            if blocks > 1:
                part = store.written(part, "found")
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], out_schema)
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
