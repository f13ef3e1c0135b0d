"""Matrices of linear signal operators, built on the driver with NumPy.

Every function returns a dense (outputs x inputs) array for a fixed length; see
operators.linear for how a matrix becomes a relation or an array expression.
"""

from __future__ import annotations

import numpy as np


def butterworth(order: int, wn: float) -> tuple[np.ndarray, np.ndarray]:
    """Low-pass numerator and denominator; wn is a share of the Nyquist frequency, in (0, 1)."""
    if not 0 < wn < 1:
        raise ValueError(f"the cutoff must lie between 0 and the Nyquist frequency; got {wn} of it")
    w = 4 * np.tan(np.pi * wn / 2)
    m = np.arange(-order + 1, order, 2)
    poles = -w * np.exp(1j * np.pi * m / (2 * order))
    a = np.real(np.poly((4 + poles) / (4 - poles)))
    gain = w**order * np.real(1 / np.prod(4 - poles))
    return gain * np.real(np.poly(-np.ones(order))), a


def recursion(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Direct-form II transposed filter along the first axis."""
    z, out = state.copy(), np.empty_like(x)
    for t in range(len(x)):
        out[t] = b[0] * x[t] + z[0]
        for k in range(len(z) - 1):
            z[k] = b[k + 1] * x[t] + z[k + 1] - a[k + 1] * out[t]
        z[-1] = b[-1] * x[t] - a[-1] * out[t]
    return out


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward filtering with odd extension, along the first axis."""
    n = 3 * max(len(a), len(b))
    if len(x) <= n:
        raise ValueError(f"a signal of {len(x)} samples is too short; more than {n} are needed")
    order = len(a) - 1
    companion = np.zeros((order, order))
    companion[0] = -a[1:]
    companion[1:, :-1] += np.eye(order - 1)
    start = np.linalg.solve(np.eye(order) - companion.T, b[1:] - a[1:] * b[0])
    start = start.reshape(-1, *[1] * (x.ndim - 1))
    long = np.concatenate([2 * x[:1] - x[n:0:-1], x, 2 * x[-1:] - x[-2 : -n - 2 : -1]])
    y = recursion(b, a, long, start * long[:1])
    y = recursion(b, a, y[::-1], start * y[-1:])[::-1]
    return y[n:-n]


def lowpass(length: int, rate: float, cutoff: float = 15.0, order: int = 4) -> np.ndarray:
    """Zero-phase Butterworth low-pass; rate / 2 must exceed the cutoff."""
    b, a = butterworth(order, cutoff / (rate / 2))
    return zero_phase(b, a, np.eye(length))


def window_fit(window: int, degree: int) -> np.ndarray:
    """Row k: the weights of a window's samples in the value at its k-th sample of their least-squares polynomial."""
    if window % 2 == 0 or degree >= window:
        raise ValueError("the window must be odd and larger than the degree")
    basis = np.vander(np.arange(-(window // 2), window // 2 + 1), degree + 1, increasing=True).astype(float)
    return basis @ np.linalg.pinv(basis)


def savitzky_golay(length: int, window: int, degree: int) -> np.ndarray:
    """Least-squares smoothing; the ends follow the fit of the first and last full window."""
    if window > length:
        raise ValueError("the window must be within the signal")
    half, out = window // 2, np.zeros((length, length))
    hat = window_fit(window, degree)
    for t in range(half, length - half):
        out[t, t - half : t + half + 1] = hat[half]
    out[:half, :window] = hat[:half]
    out[length - half :, length - window :] = hat[half + 1 :]
    return out


def gaussian(length: int, sigma: float, truncate: float = 2.0) -> np.ndarray:
    """Normalised Gaussian blur with half-sample reflection at both ends."""
    radius = int(truncate * sigma + 0.5)
    weights = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma * sigma)) if sigma > 0 else np.ones(1)
    weights /= weights.sum()
    out = np.zeros((length, length))
    for t in range(length):
        for j, w in zip(range(-radius, radius + 1), weights, strict=True):
            m = (t + j) % (2 * length)
            out[t, m if m < length else 2 * length - 1 - m] += w
    return out
