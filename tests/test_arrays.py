"""Array functions against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.functions import coefficients as C


def apply(spark, x, f):
    df = spark.createDataFrame([([float(v) for v in x],)], "x array<double>")
    return df.select(f(F.col("x")).alias("y")).first()["y"]


def peaks_by_hand(x, height, distance):
    found = []
    i = 1
    while i < len(x) - 1:
        if x[i - 1] < x[i]:
            j = i
            while j + 1 < len(x) and x[j + 1] == x[i]:
                j += 1
            if j + 1 < len(x) and x[j + 1] < x[i] and x[i] >= height:
                found.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    kept = []
    for p in sorted(found, key=lambda p: (-x[p], -p)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    return sorted(kept)


def test_statistics(spark):
    x = np.random.default_rng(1).normal(size=37)
    assert np.allclose(apply(spark, x, A.gradient), np.gradient(x))
    assert np.isclose(apply(spark, x, lambda c: A.percentile(c, 95)), np.percentile(x, 95))
    assert np.isclose(apply(spark, x, A.median), np.median(x))
    assert np.allclose(apply(spark, x, A.zscore), (x - x.mean()) / x.std())
    want = [x[max(0, i - 3) : i + 4].mean() for i in range(37)]
    assert np.allclose(apply(spark, x, lambda c: A.moving_mean(c, 6)), want)
    assert apply(spark, [2.0, 2.0], A.zscore) == [None, None]
    assert apply(spark, [], A.mean) is None


def test_peaks_with_plateaus_and_ties(spark):
    rng = np.random.default_rng(2)
    for _ in range(6):
        x = rng.integers(0, 5, 40).astype(float)
        assert apply(spark, x, lambda c: A.find_peaks(c, F.lit(2.0), 3)) == peaks_by_hand(x, 2, 3)
    assert apply(spark, [0, 2, 2, 2, 0], lambda c: A.find_peaks(c)) == [2]
    assert apply(spark, [1, 1, 1], lambda c: A.find_peaks(c)) == []
    assert apply(spark, [0, 5, 3, 4, 0], lambda c: A.find_peaks(c, None, 1, 2.0)) == [1]


def test_minimum_gap(spark):
    df = spark.createDataFrame([([3, 8, 14, 40],), ([],)], "p array<int>")
    assert [r[0] for r in df.select(A.minimum_gap(F.col("p"), 10)).collect()] == [[3, 14, 40], []]


def test_resample_and_beats(spark):
    x = np.random.default_rng(3).normal(size=20)
    want = np.interp(np.linspace(0, 1, 9), np.linspace(0, 1, 20), x)
    assert np.allclose(apply(spark, x, lambda c: A.resample(c, 9)), want)
    beats = apply(spark, x, lambda c: A.beats(c, F.array(F.lit(2), F.lit(7), F.lit(8), F.lit(15)), 5))
    assert np.allclose(beats[0], np.interp(np.linspace(0, 1, 5), np.linspace(0, 1, 5), x[2:7]))
    assert beats[1] is None and len(beats) == 3


def test_heartbeat_correction_keeps_length_and_short_signals(spark):
    t = np.arange(64)
    x = np.sin(2 * np.pi * t / 12) + 0.01 * np.random.default_rng(4).normal(size=64)
    y = apply(spark, x, lambda c: A.heartbeat_correction(c, F.lit(12), 64))
    # before the first peak and after the last one the template (as long as the signal) fills in
    assert len(y) == 64 and np.abs(np.array(y) - x)[16:48].max() < 0.5
    flat = [1.0] * 64
    assert apply(spark, flat, lambda c: A.heartbeat_correction(c, F.lit(12), 64)) == flat


def test_filters():
    b, a = C.butterworth(4, 0.4)
    assert np.allclose(b, 0.04658291 * np.array([1, 4, 6, 4, 1]), atol=1e-8)
    assert np.allclose(a, [1, -0.7820952, 0.67997853, -0.1826757, 0.03011888], atol=1e-7)
    m = C.lowpass(64, 40.0)
    assert np.allclose(m @ np.ones(64), 1)
    x = np.random.default_rng(5).normal(size=64)
    assert np.allclose(m @ x, C.zero_phase(*C.butterworth(4, 0.75), x))
    assert np.allclose(C.savitzky_golay(50, 21, 3) @ np.arange(50.0) ** 3, np.arange(50.0) ** 3)
    assert np.allclose(C.gaussian(30, 3.0).sum(1), 1)
    small = C.zero_phase(*C.butterworth(1, 0.5), np.eye(16))
    assert np.allclose(small[5, 4:7], [0.25, 0.5, 0.25]) and np.allclose(small[0], np.eye(16)[0])


def test_binomial_is_the_waveform_filter(spark):
    x = np.random.default_rng(6).normal(size=30)
    assert np.allclose(apply(spark, x, A.binomial), C.zero_phase(*C.butterworth(1, 0.5), x))


@pytest.mark.parametrize("n", [16, 17, 40])
def test_the_low_pass_is_the_matrix(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    assert np.allclose(apply(spark, x, lambda c: A.lowpass(c, 40.0)), C.lowpass(n, 40.0) @ x)


def test_signals_too_short_for_a_filter_are_null(spark):
    assert apply(spark, [1.0] * 15, lambda c: A.lowpass(c, 40.0)) is None
    assert apply(spark, [1.0] * 8, lambda c: A.savitzky_golay(c, 9, 3)) is None
    with pytest.raises(ValueError):
        A.lowpass(F.col("x"), 30.0)


@pytest.mark.parametrize("n", [9, 10])
def test_spectrum_is_the_transform(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    want = np.abs(np.fft.fft(x) / n)[: n // 2 + 1]
    want[1:-1] *= 2
    assert np.allclose(apply(spark, x, lambda c: A.spectrum(c, n)), want)
    assert np.allclose(apply(spark, x, lambda c: A.spectrum(c, n, [1, 2], power=True)), 2 * np.abs(np.fft.fft(x) / n)[1:3] ** 2)


def test_plateaus_and_ends(spark):
    x = [3.0, 1.0, 2.0, 2.0, 2.0, 2.0, 1.0, 4.0, 4.0, 5.0, 0.0, 1.0, 1.0]
    assert apply(spark, x, A.local_maxima) == [3, 9]
    assert apply(spark, [1.0, 1.0], A.local_maxima) == [] and apply(spark, [], A.local_maxima) == []


def test_beat_marks(spark):
    from pulsegrid.operators import pulse

    x = np.tile([0, 0, 0, 5, 9, 8, 6, 4, 3, 2, 1, 1, 0.5, 0.2, 0.1, 0], 4).astype(float)
    m = apply(spark, x, lambda c: pulse.beat_marks(c, 16.0))
    assert m["systole"] == [3, 19, 35, 51] and m["maximum"] == [4, 20, 36, 52] and m["minimum"] == [0, 15, 31, 47]
    none = apply(spark, [1.0] * 64, lambda c: pulse.beat_marks(c, 16.0))
    assert none["systole"] == none["maximum"] == none["minimum"] == []
    assert pulse.effective_rate(300.0, 4.0) == 75.0
