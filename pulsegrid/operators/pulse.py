"""Heartbeat operators: dominant period, periodicity, systole, systole and diastole frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from . import images as I

#: The band of heart rates in Hz, the half-width about the strongest frequency, the
#: weights of concentration and order, and the least purity.
BAND, NEAR, WEIGHTS, PURITY = (0.5, 2.0), 0.2, (0.7, 0.3), 0.3


def effective_rate(sampling_freq: float, stride: float) -> float:
    return sampling_freq / stride


def _band(length: int, rate: float, closed: bool) -> list[int]:
    f = rate * np.arange(length // 2 + 1) / length
    return np.flatnonzero((f >= BAND[0]) & (f <= BAND[1]) if closed else (f > BAND[0]) & (f < BAND[1])).tolist()


def period(x: Column, length: int, rate: float) -> Column:
    """Samples of the strongest heart-rate period, rounded half to even; raises if no bin lies in the open band."""
    bins = _band(length, rate, closed=False)
    if not bins:
        raise ValueError("no frequency of this signal lies between 0.5 and 2 Hz")
    best = A.let(A.spectrum(x, length, bins), lambda s: F.array_position(s, F.array_max(s)) - 1 + bins[0])
    return F.rint(F.lit(float(rate)) / (F.lit(float(rate)) * best / length)).cast("int")


def is_periodic(x: Column, length: int, rate: float) -> Column:
    """Whether the power in the closed band is concentrated and ordered enough.

    Fewer than 4 samples, no bin in the band, or no power: false.  A single bin has no entropy
    to divide by; it counts as periodic.
    """
    bins = _band(length, rate, closed=True)
    if length < 4 or not bins:
        return F.lit(False)
    freq = [rate * k / length for k in bins]

    def purity(p):
        def score(q):
            top = F.array_position(q, F.array_max(q)) - 1
            f0 = F.get(F.array(*[F.lit(v) for v in freq]), top.cast("int"))
            near = F.aggregate(F.filter(F.transform(q, lambda v, i: F.when(F.abs(F.get(F.array(*[F.lit(v) for v in freq]), i) - f0) < NEAR, v)), lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v)
            entropy = -A.total(F.transform(q, lambda v: v * F.log(v + float(np.finfo(float).eps)))) / float(np.log(len(bins)))
            return WEIGHTS[0] * near + WEIGHTS[1] * (1 - entropy) > PURITY

        total = A.total(p)
        if len(bins) == 1:
            return total > 0
        return A.let(total, lambda t: F.when(t > 0, A.let(F.transform(p, lambda v: v / t), score)).otherwise(F.lit(False)))

    centred = A.let(A.mean(x), lambda m: F.transform(x, lambda v: v - m))
    return A.let(A.let(centred, lambda c: A.spectrum(c, length, bins, power=True)), purity)


def systole(x: Column, rate: float, height: float = 95, gap: int = 10) -> Column:
    """Systole samples: gradient peaks over a percentile, half a second apart, at least ``gap`` apart."""
    distance = max(1, int(np.floor(0.5 * rate)))
    return A.let(A.gradient(x), lambda g: A.minimum_gap(A.find_peaks(g, A.percentile(g, height), distance), gap))


def beat_marks(x: Column, rate: float, height: float = 95, gap: int = 10) -> Column:
    """Systoles with the largest and the smallest sample of each beat: struct<systole, maximum, minimum>.

    The maximum is looked for in the first half of the beat that begins at a systole (after the
    last one, to the end), the minimum in the second half of the beat that ends there (before
    the first one, from the start); the first of equals.  Empty arrays where there is no systole.
    """
    def first_of(lo, hi, largest):
        part = F.slice(x, lo + 1, hi - lo)
        return lo + F.array_position(part, F.array_max(part) if largest else F.array_min(part)).cast("int") - 1

    def marks(s):
        def half(i):
            return F.rint((F.get(s, i + 1) - F.get(s, i)) / 2).cast("int")

        top = F.transform(s, lambda p, i: F.when(i == F.size(s) - 1, first_of(p, F.size(x), True)).otherwise(first_of(p, p + half(i) + 1, True)))
        low = F.transform(s, lambda p, i: F.when(i == 0, first_of(F.lit(0), p + 1, False)).otherwise(first_of(F.get(s, i - 1) + half(i - 1), p, False)))
        return F.struct(s.alias("systole"), top.alias("maximum"), low.alias("minimum"))

    return A.let(systole(x, rate, height, gap), marks)


def waveform_systole(x: Column, height: float = 95, distance: int = 40, gap: int = 10) -> Column:
    """Systole samples of a velocity waveform, after the order-1 low-pass."""
    return A.let(A.binomial(x), lambda s: A.let(A.gradient(s), lambda g: A.minimum_gap(A.find_peaks(g, A.percentile(g, height), distance), gap)))


def _best(x: Column, lo: Column, hi: Column, largest: bool) -> Column:
    """First sample of the extreme within [lo, hi], kept inside the signal."""
    last = F.size(x) - 1
    a, b = F.least(lo, last), F.least(hi, last)
    part = F.slice(x, a + 1, F.greatest(b - a + 1, F.lit(1)))
    return a + F.array_position(part, F.array_max(part) if largest else F.array_min(part)).cast("int") - 1


def diasys_frames(x: Column, rate: float) -> Column:
    """Distinct systole and diastole frames: struct<systole, diastole>; [0] where there are none.

    With fp = round(T / number of systoles): systole from each s to the maximum within
    round(.35 fp); diastole from s + round(.6 fp) to the minimum up to s + round(.95 fp).
    """
    def frames(s):
        fp = F.rint(F.size(x) / F.greatest(F.size(s), F.lit(1)))

        def step(share):
            return F.rint(fp * share).cast("int")

        def ranges(lo, hi, largest):
            spans = F.transform(s, lambda i: F.when(i + lo <= F.size(x) - 1, F.sequence(i + lo, F.greatest(i + lo, _best(x, i + lo, i + hi, largest)))).otherwise(F.array(F.size(x) - 1)))
            every = F.sort_array(F.array_distinct(F.flatten(spans)))
            return F.when(F.size(every) > 0, every).otherwise(F.array(F.lit(0)))

        return F.struct(ranges(F.lit(0), step(0.35), True).alias("systole"), ranges(step(0.6), step(0.95), False).alias("diastole"))

    return A.let(systole(x, rate), frames)


def diasys_image(video: DataFrame, pulse: DataFrame, pixel: list[str], rate: float) -> DataFrame:
    """minmax(minmax(systole mean) - minmax(diastole mean)) of a video (pixel, t, v); pulse has one row x."""
    frames = pulse.select(diasys_frames(F.col("x"), rate).alias("f"))
    marks = frames.select(F.explode("f.systole").alias("t"), F.lit("s").alias("phase")).unionByName(frames.select(F.explode("f.diastole").alias("t"), F.lit("d").alias("phase")))
    means = video.join(F.broadcast(marks), "t").groupBy(*pixel, "phase").agg(F.avg("v").alias("v"))
    scaled = I.minmax(means, "v", ["phase"])
    diff = scaled.groupBy(*pixel).agg((F.sum(F.when(F.col("phase") == "s", F.col("v"))) - F.sum(F.when(F.col("phase") == "d", F.col("v")))).alias("v"))
    return I.minmax(diff, "v")


def branch_signals(video: DataFrame, labels: DataFrame, length: int, rate: float) -> DataFrame:
    """Filtered mean signal of every branch: acq_id, branch, x (array over time).

    Mean over the branch's pixels, zero-phase low-pass, moving mean of round(0.1 * rate) samples.
    """
    means = video.join(labels, ["acq_id", "y", "x"]).groupBy("acq_id", "branch", "t").agg(F.avg("v").alias("v"))
    rows = means.groupBy("acq_id", "branch").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "v"))), lambda p: p["v"]).alias("x"))
    rows = rows.where((F.size("x") == length) & ~F.exists("x", lambda v: v.isNull()))
    smooth = A.lowpass(F.col("x"), rate)
    window = round(0.1 * rate)
    return rows.withColumn("x", A.let(smooth, lambda s: A.moving_mean(s, window)) if window > 1 else smooth)


def pre_masks(branches: DataFrame, labels: DataFrame, length: int, rate: float, soft: float = 10.0) -> DataFrame:
    """Branches with their artery vote and validity: acq_id, branch, artery, valid, x (z-scored), corrected.

    The dominant period is that of the mean z-scored branch.  Constant branches are left out.
    If no branch of an acquisition is periodic, all count as valid.
    """
    z = A.once(branches, "acq_id", "branch", A.zscore(F.col("x")).alias("x")).where(~F.exists("x", lambda v: v.isNull()))
    mean = z.select("acq_id", F.posexplode("x").alias("t", "v")).groupBy("acq_id", "t").agg(F.avg("v").alias("v")).groupBy("acq_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "v"))), lambda p: p["v"]).alias("m"))
    periods = mean.select("acq_id", period(F.col("m"), length, rate).alias("period"))
    # one value computed once: a lambda's argument isn't copied into the expressions that use it
    fixed = A.let(A.heartbeat_correction(F.col("x"), F.col("period"), length, soft), lambda c: F.struct(c.alias("corrected"), A.artery_vote(c, F.col("period")).alias("artery"), is_periodic(c, length, rate).alias("valid")))
    judged = A.once(z.join(periods, "acq_id"), "acq_id", "branch", "x", "period", fixed.alias("f")).select("acq_id", "branch", "x", "period", "f.*")
    some = judged.groupBy("acq_id").agg(F.bool_or("valid").alias("some"))
    return judged.join(some, "acq_id").withColumn("valid", F.col("valid") | ~F.col("some")).drop("some")
