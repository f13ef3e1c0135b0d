"""Cleaning of one-dimensional pulse signals that needs a solve for each signal: Arrow batches of rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import coefficients

#: Jumps over this many deviations, samples flagged before and after one, Hampel window
#: and deviations, smoothing window and degree.
JUMP, BEFORE, AFTER, WINDOW, SIGMAS, SMOOTH, DEGREE = 3.0, 3, 10, 11, 3.0, 9, 3


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline through the points, of one cubic over the first two and the last two pieces; beyond the ends it goes on.

    Two points give a line, three a parabola.
    """
    n = len(x)
    if n < 4:
        return np.polyval(np.polyfit(x, y, n - 1), at) if n else np.full(len(at), np.nan)
    h = np.diff(x).astype(float)
    d = np.diff(y) / h
    # second derivatives m[1..n-2]; the end conditions give m[0] and m[n-1] in terms of their neighbours
    low, mid, up, rhs = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), 6 * np.diff(d)
    mid[0] += h[0] * (h[0] + h[1]) / h[1]
    up[0] -= h[0] * h[0] / h[1]
    mid[-1] += h[-1] * (h[-1] + h[-2]) / h[-2]
    low[-1] -= h[-1] * h[-1] / h[-2]
    for k in range(1, n - 2):
        f = low[k] / mid[k - 1]
        mid[k] -= f * up[k - 1]
        rhs[k] -= f * rhs[k - 1]
    m = np.zeros(n)
    for k in range(n - 3, -1, -1):
        m[k + 1] = (rhs[k] - (up[k] * m[k + 2] if k < n - 3 else 0.0)) / mid[k]
    m[0] = ((h[0] + h[1]) * m[1] - h[0] * m[2]) / h[1]
    m[-1] = ((h[-1] + h[-2]) * m[-2] - h[-1] * m[-3]) / h[-2]
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    t = at - x[i]
    return y[i] + t * (d[i] - h[i] * (2 * m[i] + m[i + 1]) / 6 + t * (m[i] / 2 + t * (m[i + 1] - m[i]) / (6 * h[i])))


def flags(x: np.ndarray) -> np.ndarray:
    """Samples about a sudden jump, and isolated spikes away from the ends."""
    n, out = len(x), np.zeros(len(x), bool)
    steps = np.abs(np.diff(x))
    for i in np.flatnonzero(steps > JUMP * steps.std()) + 1 if n > 1 else []:
        out[max(0, i - BEFORE) : i + AFTER] = True
    half = WINDOW // 2
    if n >= WINDOW:
        near = np.lib.stride_tricks.sliding_window_view(x, WINDOW)
        middle = np.median(near, 1)
        spread = np.median(np.abs(near - middle[:, None]), 1)
        out[half : n - half] |= np.abs(x[half : n - half] - middle) > SIGMAS * 1.4826 * spread
    return out


def clean(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signal with flagged samples replaced by a spline through the others, then smoothed; and the flags.

    A signal without enough good samples, or shorter than the smoothing window, is only as far cleaned as it can be.
    """
    x = np.asarray(x, float).copy()
    bad = flags(x)
    good = np.flatnonzero(~bad)
    if len(good) >= 2 and bad.any():
        x[bad] = spline(good, x[good], np.flatnonzero(bad))
    if len(x) >= SMOOTH:
        hat, half = coefficients.window_fit(SMOOTH, DEGREE), SMOOTH // 2
        near = np.lib.stride_tricks.sliding_window_view(x, SMOOTH)
        x = np.concatenate([hat[:half] @ near[0], near @ hat[half], hat[half + 1 :] @ near[-1]])
    return x, bad


def clean_signals(signals: DataFrame, column: str = "x") -> DataFrame:
    """Rows with one signal each (no nulls in it): the signal cleaned, and ``flags``; a null signal stays null."""
    schema = T.StructType([*[f for f in signals.schema if f.name != "flags"], T.StructField("flags", T.ArrayType(T.BooleanType()))])
    names = [f.name for f in schema]

    def run(frames):
        for frame in frames:
            made = [(None, None) if v is None else clean(v) for v in frame[column]]
            frame[column], frame["flags"] = [m[0] for m in made], [m[1] for m in made]
            yield frame[names]

    return signals.mapInPandas(run, schema)
