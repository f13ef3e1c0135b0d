"""Connected components of a distributed edge list, by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every end of an edge; the component is its smallest id.

    Each round hooks every vertex to its smallest neighbour, jumps pointers twice, and
    contracts the edges; only counts come to the driver.  Rows with a null end, loops and
    repeated edges are ignored.  Each round's tables and labels are written, so lineage stays
    short, and the ones before are deleted.  A hub's edges are combined before they are
    shuffled, and a join of vertex names has one row for each vertex on one side.  The result is a
    written table.
    """
    live = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b"))).distinct()
    live = store.written(live, "edges")
    labels = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = store.written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), "parents")
        up = hooked
        for _ in range(2):
            up = up.join(up.select(F.col("a").alias("p"), F.col("p").alias("pp")), "p").select("a", F.col("pp").alias("p"))
        up = store.written(up, "jumped")
        left = up.select("a", F.col("p").alias("pa"))
        right = up.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        following = store.written(live.join(left, "a").join(right, "b").where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        if labels is None:  # every end is a vertex of the first round
            named = up.select(F.col("a").alias("id"), F.col("p").alias("component"))
        else:
            named = labels.join(up.select(F.col("a").alias("component"), F.col("p").alias("root")), "component", "left").select("id", F.coalesce("root", "component").alias("component"))
        before, labels = labels, store.written(named, "labels")
        for old in (live, hooked, up, before):
            if old is not None:
                store.drop(old)
        live = following
    if labels is None:
        return store.written(live.select(F.col("a").alias("id"), F.col("b").alias("component")), "labels")
    store.drop(live)
    return labels
