"""Signal functions as Column expressions over ARRAY<DOUBLE>: no shuffle, no Python.

A signal is one array per row, in time order.  Where a function needs a value several times it
is bound once by ``let``, as a lambda's argument.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, *columns) -> DataFrame:
    """Select columns whose values later steps use as they are.

    Catalyst would otherwise copy a dear expression into every filter and lambda above it; it
    copies nothing out of a projection that also numbers its rows.
    """
    return df.select(*columns, F.monotonically_increasing_id().alias("_once")).where("_once >= 0").drop("_once")


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    """Mean; NULL for an empty signal."""
    return F.when(F.size(x) > 0, total(x) / F.size(x))


def std(x: Column) -> Column:
    """Population standard deviation."""
    return let(mean(x), lambda m: F.sqrt(mean(F.transform(x, lambda v: (v - m) * (v - m)))))


def zscore(x: Column) -> Column:
    """(x - mean) / std; NULL entries for a constant signal."""
    return let(F.struct(mean(x).alias("m"), std(x).alias("s")), lambda p: F.transform(x, lambda v: F.try_divide(v - p["m"], p["s"])))


def percentile(x: Column, q: float) -> Column:
    """Linear-interpolated percentile, q in [0, 100]."""
    def at(s):
        pos = (F.size(s) - 1) * F.lit(q / 100.0)
        low = F.floor(pos).cast("int")
        return F.get(s, low) + (pos - low) * (F.get(s, F.least(low + 1, F.size(s) - 1)) - F.get(s, low))

    return F.when(F.size(x) > 0, let(F.sort_array(x), at))


def median(x: Column) -> Column:
    return percentile(x, 50)


def gradient(x: Column) -> Column:
    """Central differences, one-sided at both ends; a single sample has no gradient (NULL)."""
    last = F.size(x) - 1
    return F.transform(x, lambda v, i: F.when(last == 0, F.lit(None)).when(i == 0, F.get(x, F.lit(1)) - v).when(i == last, v - F.get(x, i - 1)).otherwise((F.get(x, i + 1) - F.get(x, i - 1)) / 2))


def difference(x: Column) -> Column:
    """x[i] - x[i-1], 0 first."""
    return F.transform(x, lambda v, i: F.when(i == 0, F.lit(0.0)).otherwise(v - F.get(x, i - 1)))


def moving_mean(x: Column, k: int) -> Column:
    """Mean over [i - k//2, i + k//2], cut at the ends (an even k acts as k + 1)."""
    h = k // 2
    return F.transform(x, lambda v, i: mean(F.slice(x, F.greatest(i - h, F.lit(0)) + 1, F.least(i + h, F.size(x) - 1) - F.greatest(i - h, F.lit(0)) + 1)))


def edge_window(x: Column, i: Column, half: int) -> Column:
    """The 2*half + 1 samples about i, the ends repeated."""
    return F.transform(F.sequence(i - half, i + half), lambda j: F.get(x, F.least(F.greatest(j, F.lit(0)), F.size(x) - 1)))


def moving_outliers(x: Column, window: int = 5, factor: float = 2.0) -> Column:
    """Flags: distance from the edge-replicated moving mean over factor times its median (none if that is 0)."""
    dev = F.transform(x, lambda v, i: F.abs(v - mean(edge_window(x, i, window // 2))))
    return let(dev, lambda d: let(median(d), lambda m: F.transform(d, lambda e: (m != 0) & (e > factor * m))))


def hampel(x: Column, window: int = 11, sigmas: float = 3.0) -> Column:
    """Flags: distance from the moving median over ``sigmas`` times 1.2 times the moving median distance."""
    half = window // 2
    dev = F.transform(x, lambda v, i: F.abs(v - median(edge_window(x, i, half))))

    def flags(d):
        scale = F.transform(d, lambda e, i: 1.2 * median(edge_window(d, i, half)))

        def fill(s):
            positive = F.filter(s, lambda v: v > 0)
            return let(F.coalesce(median(positive), F.lit(1.0)), lambda m: F.zip_with(d, s, lambda e, v: e > sigmas * F.when(v == 0, m).otherwise(v)))

        return let(scale, fill)

    return let(dev, flags)


def local_percentile_outliers(x: Column, window: int = 31, lower: float = 5, upper: float = 95, ratio: float = 1.5) -> Column:
    """Flags: under the window's low percentile / ratio or over its high percentile * ratio."""
    h = window // 2

    def flag(v, i):
        start = F.greatest(i - h, F.lit(0))
        near = F.slice(x, start + 1, F.least(i + h, F.size(x) - 1) - start + 1)
        pair = F.struct(percentile(near, lower).alias("a"), percentile(near, upper).alias("b"))
        return let(pair, lambda p: (p["a"] != p["b"]) & ((v < p["a"] / ratio) | (v > p["b"] * ratio)))

    return F.transform(x, flag)


def robust_flags(residual: Column, threshold: float) -> Column:
    """Flags: over threshold times 1.4826 MAD (the standard deviation where that is 0)."""
    def flags(r):
        sizes = F.transform(r, lambda v: F.abs(v))
        return let(median(sizes), lambda m: let(F.when(m > 0, 1.4826 * m).otherwise(std(r)), lambda s: F.transform(r, lambda v: F.abs(v) > threshold * s)))

    return let(residual, flags)


def derivative_outliers(x: Column, threshold: float = 3.0) -> Column:
    return robust_flags(difference(x), threshold)


def global_drop(x: Column, drop: float = 0.1) -> Column:
    """Flags: under (1 - drop) times the median of the first half."""
    return let(median(F.slice(x, F.lit(1), F.floor(F.size(x) / 2).cast("int"))), lambda b: F.transform(x, lambda v: v < (1 - drop) * b))


def linear(x: Column, matrix) -> Column:
    """Rows of a fixed matrix (list of lists) times the signal."""
    rows = F.from_json(F.lit(str([[float(v) for v in r] for r in matrix])), "array<array<double>>")
    return F.transform(rows, lambda r: total(F.zip_with(r, x, lambda a, b: a * b)))


def recursion(x: Column, b, a) -> Column:
    """One pass of the filter with numerator b and denominator a, from the state of a constant x[0]."""
    order, first = len(a) - 1, F.get(x, F.lit(0))
    steady, held = [], 0.0
    for k in range(order, 0, -1):  # the delays of an input and output of 1
        held += float(b[k]) - float(a[k])
        steady.insert(0, held)

    def step(s, v):
        y = v * float(b[0]) + s["z0"]
        def delays(y):
            later = [s[f"z{k + 1}"] if k + 1 < order else F.lit(0.0) for k in range(order)]
            return F.struct(*[(v * float(b[k + 1]) + later[k] - y * float(a[k + 1])).alias(f"z{k}") for k in range(order)], F.concat(s["out"], F.array(y)).alias("out"))
        return let(y, delays)

    zero = F.struct(*[(first * z).alias(f"z{k}") for k, z in enumerate(steady)], F.array().cast("array<double>").alias("out"))
    return F.aggregate(x, zero, step, lambda s: s["out"])


def zero_phase(x: Column, b, a) -> Column:
    """Forward and backward filtering with odd extension by three filter lengths; NULL for a signal not longer than that.

    Two passes over the signal, whatever its length: nothing here is quadratic in it.
    """
    n = 3 * max(len(a), len(b))
    last = F.size(x) - 1

    def extended(e):
        head = F.transform(F.sequence(F.lit(n), F.lit(1), F.lit(-1)), lambda i: 2 * F.get(x, F.lit(0)) - F.get(x, i))
        tail = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: 2 * F.get(x, last) - F.get(x, last - i))
        return F.concat(head, e, tail)

    both = let(extended(x), lambda e: let(F.reverse(recursion(e, b, a)), lambda r: F.reverse(recursion(r, b, a))))
    return F.when(F.size(x) > n, F.slice(both, F.lit(n + 1), F.size(x)))


def lowpass(x: Column, rate: float, cutoff: float = 15.0, order: int = 4) -> Column:
    """Zero-phase Butterworth low-pass; rate / 2 must exceed the cutoff."""
    from . import coefficients

    return zero_phase(x, *coefficients.butterworth(order, cutoff / (rate / 2)))


def savitzky_golay(x: Column, window: int, degree: int) -> Column:
    """Least-squares smoothing; the ends follow the fit of the first and last full window; NULL for a shorter signal.

    The window's weights are the only constants, so a sample costs a window.
    """
    from . import coefficients

    hat, half = coefficients.window_fit(window, degree), window // 2
    rows = F.from_json(F.lit(str([[float(v) for v in r] for r in hat])), "array<array<double>>")

    def at(r, v, i):
        first = F.least(F.greatest(i - half, F.lit(0)), F.size(x) - window)
        return total(F.zip_with(F.get(r, i - first), F.slice(x, first + 1, F.lit(window)), lambda p, q: p * q))

    return F.when(F.size(x) >= window, let(rows, lambda r: F.transform(x, lambda v, i: at(r, v, i))))


def model_outliers(x: Column, window: int = 31, degree: int = 3, threshold: float = 3.0) -> Column:
    """Flags: distance from the smoothed signal over threshold times its robust spread."""
    return let(savitzky_golay(x, window, degree), lambda s: robust_flags(F.zip_with(x, s, lambda a, b: a - b), threshold))


def binomial(x: Column) -> Column:
    """The order-1, half-band zero-phase low-pass: 1/4, 1/2, 1/4 with both ends unchanged."""
    return F.transform(x, lambda v, i: F.when((i == 0) | (i == F.size(x) - 1), v).otherwise(F.get(x, i - 1) / 4 + v / 2 + F.get(x, i + 1) / 4))


def local_maxima(x: Column) -> Column:
    """Indices of strict local maxima; of a plateau its middle, rounded down; never an end.

    One pass: the last value, where the rise to it ended (-1: none since the last fall), and what was found.
    """
    none = F.lit(-1)

    def step(a, p):
        top = F.array(F.floor((a["up"] + p["i"] - 1) / 2).cast("int"))
        fell = p["v"] < a["v"]
        up = F.when(p["v"] > a["v"], p["i"]).when(p["v"] == a["v"], a["up"]).otherwise(none)
        return F.struct(p["v"].alias("v"), up.alias("up"), F.when(fell & (a["up"] >= 0), F.concat(a["out"], top)).otherwise(a["out"]).alias("out"))

    zero = F.struct(F.lit(None).cast("double").alias("v"), none.alias("up"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(F.transform(x, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), zero, step, lambda a: a["out"])


def find_peaks(x: Column, height: Column | None = None, distance: Column | int = 1, prominence: float | None = None) -> Column:
    """Indices of peaks: local maxima, height, highest-first suppression within ``distance``, prominence.

    Of equal heights the later one is handled first.
    """
    distance = F.lit(distance) if isinstance(distance, int) else distance
    found = local_maxima(x)
    if height is not None:
        found = let(F.struct(found.alias("f"), height.alias("h")), lambda p: F.filter(p["f"], lambda i: F.get(x, i) >= p["h"]))

    def suppress(all_):
        ranked = F.transform(F.sort_array(F.transform(all_, lambda i: F.struct(F.get(x, i).alias("h"), i.alias("i"))), asc=False), lambda p: p["i"])
        kept = F.aggregate(ranked, F.array().cast("array<int>"), lambda a, i: F.when(F.exists(a, lambda j: F.abs(j - i) < distance), a).otherwise(F.concat(a, F.array(i))))
        return F.sort_array(kept)

    found = let(found, suppress)
    if prominence is None:
        return found
    return let(found, lambda p: F.filter(p, lambda i: prominence_of(x, i) >= prominence))


def prominence_of(x: Column, i: Column) -> Column:
    """Height over the higher of the two lowest points between the peak and the next higher sample on each side."""
    def base(side):
        # samples outwards from the peak, up to a higher one
        stop = F.array_position(F.transform(side, lambda v: v > F.get(x, i)), F.lit(True))
        return F.array_min(F.concat(F.array(F.get(x, i)), F.when(stop > 0, F.slice(side, F.lit(1), F.greatest(stop.cast("int") - 1, F.lit(0)))).otherwise(side)))

    left = F.reverse(F.slice(x, F.lit(1), i))
    right = F.slice(x, i + 2, F.size(x))
    return F.get(x, i) - F.greatest(base(left), base(right))


def minimum_gap(indices: Column, gap: int) -> Column:
    """Keep the first; drop each that is nearer than ``gap`` to the last one kept."""
    return F.aggregate(indices, F.array().cast("array<int>"), lambda a, i: F.when((F.size(a) > 0) & (i - F.element_at(a, F.when(F.size(a) > 0, -1).otherwise(1)) < gap), a).otherwise(F.concat(a, F.array(i))))


def resample(x: Column, n: int) -> Column:
    """n points by linear interpolation between the ends; NULL under two samples."""
    def at(k):
        pos = k * (F.size(x) - 1) / F.lit(float(max(1, n - 1)))
        low = F.floor(pos).cast("int")
        return F.get(x, low) + (pos - low) * (F.get(x, F.least(low + 1, F.size(x) - 1)) - F.get(x, low))

    return F.when(F.size(x) >= 2, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at))


def resample_to(x: Column, n: Column) -> Column:
    """resample() to a length that is a column."""
    def at(k):
        pos = F.when(n > 1, k * (F.size(x) - 1) / (n - 1)).otherwise(F.lit(0.0))
        low = F.floor(pos).cast("int")
        return F.get(x, low) + (pos - low) * (F.get(x, F.least(low + 1, F.size(x) - 1)) - F.get(x, low))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), at)).otherwise(F.array().cast("array<double>"))


def beats(x: Column, peaks: Column, n: int) -> Column:
    """The signal between successive peaks, each resampled to n points (NULL under two samples)."""
    count = F.greatest(F.size(peaks) - 1, F.lit(0))
    return F.transform(F.slice(peaks, F.lit(1), count), lambda p, i: resample(F.slice(x, p + 1, F.get(peaks, i + 1) - p), n))


def mean_beat(all_beats: Column, n: int) -> Column:
    """Mean over beats of each point, missing beats left out."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: mean(F.transform(F.filter(all_beats, lambda b: b.isNotNull()), lambda b: F.get(b, k))))


def pseudo_signal(template: Column, peaks: Column, length: Column) -> Column:
    """The template between peaks, its tail before the first one and its head after the last one."""
    size = F.size(template)

    def between(a):
        return F.flatten(F.transform(F.slice(a, F.lit(1), F.size(a) - 1), lambda p, i: resample_to(template, F.get(a, i + 1) - p)))

    first, last = F.get(peaks, F.lit(0)), length - F.element_at(peaks, -1)
    head = F.transform(F.when(first > 0, F.sequence(F.lit(0), first - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.get(template, F.pmod(i - first, size)))
    tail = F.transform(F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.get(template, F.pmod(i, size)))
    return F.concat(head, between(peaks), tail)


def soft_rejection(x: Column, pseudo: Column, k: float = 2.0) -> Column:
    """pseudo + weight * residual, with weight 1 - |residual| / (k * 1.4826 MAD) cut to [0, 1]; x where the MAD is 0."""
    residual = F.zip_with(x, pseudo, lambda a, b: a - b)

    def blend(r):
        sigma = 1.4826 * median(F.transform(r, lambda v: F.abs(v)))
        return let(sigma, lambda s: F.zip_with(pseudo, r, lambda p, v: F.when(s == 0, p + v).otherwise(p + v * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(v) / (k * F.when(s == 0, F.lit(1.0)).otherwise(s)))))))

    return let(residual, blend)


def heartbeat_peaks(x: Column, period: Column, height: float = 80, tolerance: float = 0.6) -> Column:
    """Peaks of the gradient over a percentile, at least int(period * tolerance) apart."""
    return let(gradient(x), lambda g: find_peaks(g, percentile(g, height), F.greatest(F.floor(period * tolerance).cast("int"), F.lit(1))))


def heartbeat_correction(x: Column, period: Column, length: int, k: float = 2.0) -> Column:
    """Soft rejection against the mean beat; the signal itself with fewer than two peaks."""
    def correct(p):
        template = let(beats(x, p, length), lambda b: mean_beat(b, length))
        fixed = let(template, lambda m: let(pseudo_signal(m, p, F.lit(length)), lambda s: soft_rejection(x, s, k)))
        return F.when(F.size(p) < 2, x).otherwise(fixed)

    return let(heartbeat_peaks(x, period), correct)


def artery_vote(x: Column, period: Column) -> Column:
    """True (artery) if most peaks of |gradient| stand on a rise."""
    def vote(g):
        strength = F.transform(g, lambda v: F.abs(v))
        at = let(strength, lambda s: find_peaks(s, None, F.greatest(F.floor(period * 0.8).cast("int"), F.lit(1)), 1e-6))
        return let(at, lambda p: F.size(F.filter(p, lambda i: F.get(g, i) > 0)) > F.size(p) / 2)

    return let(gradient(x), vote)


def spectrum(x: Column, length: int, bins: list[int] | None = None, power: bool = False) -> Column:
    """One-sided spectrum |FFT / T| (squared, with power) at the given bins (all, 0 to T // 2), all but the first and last doubled.

    The only constants are one turn of cosines and sines, as long as the signal; a bin costs one pass.
    """
    turn = [2 * math.pi * j / length for j in range(length)]
    bins = list(range(length // 2 + 1)) if bins is None else bins
    table = F.struct(F.from_json(F.lit(str([math.cos(a) for a in turn])), "array<double>").alias("c"), F.from_json(F.lit(str([math.sin(a) for a in turn])), "array<double>").alias("s"))

    def at(p, k):
        both = F.struct(*[total(F.transform(x, lambda v, t: v * F.get(p[c], (k * t) % length))).alias(c) for c in "cs"])

        def value(z):
            v = (z["c"] * z["c"] + z["s"] * z["s"]) / float(length * length)
            v = v if power else F.sqrt(v)
            return F.when((k == 0) | (k == length // 2), v).otherwise(2 * v)

        return let(both, value)

    return let(table, lambda p: F.transform(F.array(*[F.lit(k) for k in bins]), lambda k: at(p, k)))
