"""Masks as sparse relations (y, x): geometry, set operations, dilation, decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    """All pixels of an image, from one range."""
    return spark.range(rows * columns).select(F.floor(F.col("id") / columns).cast("int").alias("y"), (F.col("id") % columns).cast("int").alias("x"))


def disk(rows: int, columns: int, r1: float, center: tuple[float | Column, float | Column] = (0.5, 0.5), r2: float | None = None) -> Column:
    """Predicate on (y, x): within r1 of the center on the grid scaled to [0, 1], or in (r1, r2].

    The center's first part goes with rows; both may be columns.
    """
    if r2 is not None and r1 > r2:
        raise ValueError("r1 must not exceed r2")
    dy = F.col("y") / F.lit(float(max(1, rows - 1))) - center[0]
    dx = F.col("x") / F.lit(float(max(1, columns - 1))) - center[1]
    d = dy * dy + dx * dx
    return d <= r1**2 if r2 is None else (d > r1**2) & (d <= r2**2)


def ellipse(rows: int, columns: int, share: float, center: tuple[float, float] | None = None) -> Column:
    """Predicate on (y, x): inside the ellipse with half-axes share * size / 2, share cut to [0, 1]; none for 0."""
    share = max(0.0, min(1.0, float(share)))
    cy, cx = center or (rows / 2, columns / 2)
    if share == 0:
        return F.lit(False)
    a, b = columns / 2 * share, rows / 2 * share
    return ((F.col("x") - cx) / a) ** 2 + ((F.col("y") - cy) / b) ** 2 <= 1.0


def section(rows: int, columns: int, inner: float = 0.2, outer: float = 0.5) -> Column:
    """The ring between two ellipses."""
    return ellipse(rows, columns, outer) & ~ellipse(rows, columns, inner)


def over(score: Column, least: float = 0.5) -> Column:
    """Predicate: a score above the threshold."""
    return score > F.lit(least)


def intersect(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b, on, "left_semi")


def subtract(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b, on, "left_anti")


def union(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.select(*on).union(b.select(*on)).distinct()


def dilate(mask: DataFrame, radius: int, rows: int, columns: int, keys: list[str] | None = None) -> DataFrame:
    """All pixels within ``radius`` of a mask pixel: a fixed number of offsets for each, then distinct."""
    offsets = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]
    near = F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in offsets])
    out = mask.select(*(keys or []), F.explode(near).alias("p")).select(*(keys or []), "p.y", "p.x")
    return out.where((F.col("y") >= 0) & (F.col("y") < rows) & (F.col("x") >= 0) & (F.col("x") < columns)).distinct()


def artery_vein(klass: Column) -> tuple[Column, Column]:
    """Artery: class 1 or 3; vein: class 2 or 3."""
    return klass.isin(1, 3), klass.isin(2, 3)


def select_box(detections: DataFrame, keys: list[str]) -> DataFrame:
    """The detection of highest confidence for each key; ties to the lowest box_id."""
    best = F.max(F.struct(F.col("conf"), (-F.col("box_id")).alias("order"), F.col("x"), F.col("y"), F.col("dx"), F.col("dy"))).alias("b")
    return detections.groupBy(*keys).agg(best).select(*keys, F.struct("b.x", "b.y").alias("center"), F.struct("b.dx", "b.dy").alias("axes"), (-F.col("b.order")).alias("box_id"))
