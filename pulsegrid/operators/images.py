"""Per-pixel and per-frame operators on the long form (acq_id, t, y, x, v) and its images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Added to a denominator so that constant images stay finite.
EPSILON = 1e-8


def canonical(v: Column) -> Column:
    """NaN becomes NULL, so that Spark's aggregates skip it."""
    return F.when(~F.isnan(v), v)


def with_global(df: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Attach aggregates over each key group (or all rows).

    The aggregate has one row for each key group, combined map-side first.  Groups are whole
    images or acquisitions, so there are few; Spark broadcasts them while their size, known
    when the plan runs, is under its threshold, and beyond it splits a key's rows (skew join).
    """
    if keys:
        return df.join(df.groupBy(*keys).agg(*aggregates), keys)
    # all rows: the other side is exactly one row, a nested loop of one
    one = df.agg(*aggregates).withColumn("_one", F.lit(0))
    return df.withColumn("_one", F.lit(0)).join(F.broadcast(one), "_one").drop("_one")


def crop_frames(df: DataFrame, first: int, end: int, time: str = "t") -> DataFrame:
    """Frames first to end - 1, with their own numbers."""
    return df.where((F.col(time) >= first) & (F.col(time) < end))


def argmax_center(image: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """The brightest pixel of each image (keys, y, x, value) as center: struct<x, y>; the first in raster order of equals."""
    best = F.max(F.struct(F.col(value), (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))).alias("b")
    return image.where(F.col(value).isNotNull()).groupBy(*keys).agg(best).select(*keys, F.struct((-F.col("b.x")).cast("double").alias("x"), (-F.col("b.y")).cast("double").alias("y")).alias("center"))


def minmax(df: DataFrame, value: str = "v", keys: list[str] | None = None, out: str | None = None) -> DataFrame:
    """(v - min) / (max - min + 1e-8) over each image."""
    both = with_global(df, keys or [], [F.min(value).alias("_lo"), F.max(value).alias("_hi")])
    return both.withColumn(out or value, (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + EPSILON)).drop("_lo", "_hi")


def to_uint8(df: DataFrame, value: str = "v", keys: list[str] | None = None) -> DataFrame:
    """Min-max times 255, cut to whole numbers, as SMALLINT."""
    return minmax(df, value, keys).withColumn(value, F.floor(F.col(value) * 255).cast("smallint"))


def video_to_unit(df: DataFrame, value: str = "v", keys: list[str] | None = None) -> DataFrame:
    """Rescale to [0, 1] only where a value lies outside; a constant video outside becomes zeros.

    Adds _lo, _hi and _rescaled, for video_from_unit().
    """
    both = with_global(df, keys or [], [F.min(value).alias("_lo"), F.max(value).alias("_hi")])
    both = both.withColumn("_rescaled", (F.col("_lo") < 0) | (F.col("_hi") > 1))
    scaled = F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return both.withColumn(value, F.when(F.col("_rescaled"), scaled).otherwise(F.col(value)))


def video_from_unit(df: DataFrame, value: str = "v") -> DataFrame:
    """The inverse of video_to_unit()."""
    back = F.col(value) * (F.col("_hi") - F.col("_lo")) + F.col("_lo")
    return df.withColumn(value, F.when(F.col("_rescaled"), back).otherwise(F.col(value))).drop("_lo", "_hi", "_rescaled")


def flat_divide(df: DataFrame, value: str = "v", blur: str = "blur", out: str | None = None) -> DataFrame:
    """Value over blur."""
    return df.withColumn(out or value, F.col(value) / (F.col(blur) + EPSILON))


def in_border(h: int, w: int, border: float = 0.15) -> Column:
    """Rows within [ceil(border*H), floor((1-border)*H)) and columns alike."""
    import math

    y0, y1 = math.ceil(border * h), math.floor((1 - border) * h)
    x0, x1 = math.ceil(border * w), math.floor((1 - border) * w)
    return (F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1)


def energy_restore(df: DataFrame, before: str, after: str, h: int, w: int, border: float = 0.15, keys: list[str] | None = None) -> DataFrame:
    """Scale ``after`` so that its sum inside the border equals that of ``before``."""
    inside = in_border(h, w, border)
    sums = [F.sum(F.when(inside, F.col(before))).alias("_a"), F.sum(F.when(inside, F.col(after))).alias("_b")]
    return with_global(df, keys or [], sums).withColumn(after, F.col(after) * F.try_divide("_a", "_b")).drop("_a", "_b")


def temporal_mean(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def mask_pulse(df: DataFrame, mask: DataFrame, on: list[str], time: list[str], value: str = "v") -> DataFrame:
    """Sum of non-missing values over the mask divided by the mask's pixels (missing ones too)."""
    count = mask.agg(F.count("*").alias("_n")).withColumn("_one", F.lit(0))
    sums = df.join(mask, on, "left_semi").groupBy(*time).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(value))
    return sums.withColumn("_one", F.lit(0)).join(F.broadcast(count), "_one").withColumn(value, F.try_divide(F.col(value), F.col("_n"))).drop("_one", "_n")


def correlation(df: DataFrame, signal: DataFrame, pixel: list[str], time: str = "t", value: str = "v") -> DataFrame:
    """Zero-lag correlation of every pixel with a signal (time, s): the covariance over the global spreads.

    Equal to the mean of centred products when every pixel has all frames.
    """
    spread = df.agg(F.stddev_pop(value).alias("_sv"), F.avg(value).alias("_mv")).withColumn("_one", F.lit(0))
    own = signal.agg(F.stddev_pop("s").alias("_ss"), F.avg("s").alias("_ms")).withColumn("_one", F.lit(0))
    joined = df.join(F.broadcast(signal), time)
    sums = joined.groupBy(*pixel).agg(F.covar_pop(value, "s").alias("_c")).withColumn("_one", F.lit(0))
    return sums.join(F.broadcast(spread.join(own, "_one")), "_one").select(*pixel, F.try_divide(F.col("_c"), F.col("_sv") * F.col("_ss")).alias("r"))


def frms(m0: DataFrame, m2: DataFrame, keys: list[str], frame: list[str]) -> DataFrame:
    """sqrt(M2 / mean of M0 over the frame)."""
    means = m0.groupBy(*frame).agg(F.avg("v").alias("_m"))
    return m2.join(means, frame).withColumn("v", F.sqrt(F.try_divide(F.col("v"), F.col("_m")))).select(*keys, "v")


def signed_sqrt(a: Column) -> Column:
    return F.signum(a) * F.sqrt(F.abs(a))


def velocity(f: Column, background: Column, wavelength: float = 852e-9, angle: float = 0.25) -> Column:
    """Velocity in mm/s from a pixel's and its background's frequency spread."""
    import math

    return 2 * wavelength / math.sin(angle) * signed_sqrt(f * f - background * background) * 1e6


def interpolate_flagged(df: DataFrame, keys: list[str], time: str = "t", value: str = "v", flag: str = "flag") -> DataFrame:
    """Flagged samples by linear interpolation between the nearest good ones; ends hold the nearest."""
    order = W.partitionBy(*keys).orderBy(time)
    good_t, good_v = F.when(~F.col(flag), F.col(time)), F.when(~F.col(flag), F.col(value))
    before, after = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(0, W.unboundedFollowing)
    marks = df.withColumns({"_t0": F.last(good_t, True).over(before), "_v0": F.last(good_v, True).over(before), "_t1": F.first(good_t, True).over(after), "_v1": F.first(good_v, True).over(after)})
    share = F.try_divide(F.col(time) - F.col("_t0"), F.col("_t1") - F.col("_t0"))
    filled = F.when(~F.col(flag), F.col(value)).otherwise(F.coalesce(F.col("_v0") + share * (F.col("_v1") - F.col("_v0")), F.col("_v0"), F.col("_v1"), F.col(value)))
    return marks.withColumn(value, filled).drop("_t0", "_v0", "_t1", "_v1")


def av_overlay(artery: Column, vein: Column, grey: Column) -> Column:
    """RGB of a pixel: vein blue over artery red over grey."""
    def rgb(r, g, b):
        return F.array(*[x if isinstance(x, Column) else F.lit(x) for x in (r, g, b)])

    return F.when(vein, rgb(0, 0, 255)).when(artery, rgb(255, 0, 0)).otherwise(rgb(grey, grey, grey))
