"""Image operators that walk neighbourhoods: one Arrow group for each image (a few hundred KB)."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
_FOUR = [(-1, 0), (0, -1), (0, 1), (1, 0)]


def label(mask: np.ndarray, eight: bool = True) -> np.ndarray:
    """Connected components, numbered in raster order from 1."""
    out, n = np.zeros(mask.shape, int), 0
    steps = _EIGHT if eight else _FOUR
    h, w = mask.shape
    for y, x in zip(*np.nonzero(mask), strict=True):
        if out[y, x]:
            continue
        n += 1
        out[y, x] = n
        queue = deque([(y, x)])
        while queue:
            a, b = queue.popleft()
            for dy, dx in steps:
                c, d = a + dy, b + dx
                if 0 <= c < h and 0 <= d < w and mask[c, d] and not out[c, d]:
                    out[c, d] = n
                    queue.append((c, d))
    return out


def largest(mask: np.ndarray) -> np.ndarray:
    """The largest 8-connected component; the first of equals; none of an empty mask."""
    found = label(mask)
    if not found.max():
        return np.zeros_like(mask)
    counts = np.bincount(found.ravel())
    counts[0] = 0
    return found == counts.argmax()


def skeleton(mask: np.ndarray) -> np.ndarray:
    """Thinning to one-pixel lines by alternating border passes (Zhang and Suen)."""
    m = np.pad(mask, 1).astype(np.uint8)
    while True:
        gone = 0
        for first in (True, False):
            ring = [np.roll(m, s, (0, 1)) for s in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]
            p2, p3, p4, p5, p6, p7, p8, p9 = ring
            near = sum(r.astype(int) for r in ring)
            turns = sum(((a == 0) & (b == 1)).astype(int) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))
            a, b = (p2 * p4 * p6, p4 * p6 * p8) if first else (p2 * p4 * p8, p2 * p6 * p8)
            out = (m == 1) & (near >= 2) & (near <= 6) & (turns == 1) & (a == 0) & (b == 0)
            out[[0, -1]] = False
            out[:, [0, -1]] = False
            m[out] = 0
            gone += out.sum()
        if not gone:
            return m[1:-1, 1:-1].astype(bool)


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    """Binary dilation by a disk."""
    out, (h, w) = mask.copy(), mask.shape
    padded = np.pad(mask, radius)
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            if dy * dy + dx * dx <= radius * radius:
                out |= padded[radius + dy : radius + dy + h, radius + dx : radius + dx + w]
    return out


def watershed(high: np.ndarray) -> np.ndarray:
    """Flood a boolean image from its 4-connected flat low regions, nearest first."""
    out = label(~high, eight=False)
    queue = deque(zip(*np.nonzero(out), strict=True))
    h, w = high.shape
    while queue:
        y, x = queue.popleft()
        for dy, dx in _FOUR:
            a, b = y + dy, x + dx
            if 0 <= a < h and 0 <= b < w and not out[a, b]:
                out[a, b] = out[y, x]
                queue.append((a, b))
    return out


def disk_of(rows: int, columns: int, radius: float, center: tuple[float, float]) -> np.ndarray:
    y, x = np.linspace(0, 1, rows)[:, None], np.linspace(0, 1, columns)[None]
    return (y - center[0]) ** 2 + (x - center[1]) ** 2 <= radius**2


#: Fixed values of branch labelling: the weight of a pixel itself and the sum from which it is a crossing,
#: the disk cut out around crossings, and the one by which pieces grow into seeds.
SELF, CROSSING, CUT, SEED = 10, 13, 2, 1


def branches(mask: np.ndarray, center: tuple[float, float], r1: float = 0.1) -> np.ndarray:
    """Vessel branches of a mask: skeleton cut at crossings and around the disc, grown back over the mask.

    center is in pixels (x, y); basins are numbered as the skeleton's pieces, as the basins that
    grow from them are found in the same raster order.
    """
    h, w = mask.shape
    around = disk_of(h, w, r1, (center[1] / w, center[0] / h))
    lines = skeleton(mask) & ~around
    padded = np.pad(lines.astype(int), 1)
    near = sum(padded[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in _EIGHT) + SELF * lines
    pieces = lines & ~dilate(near >= CROSSING, CUT)
    count = label(pieces).max()
    basins = watershed(~dilate(pieces, SEED)) if count else np.zeros(mask.shape, int)
    edge = np.zeros(mask.shape, bool)
    for axis in (0, 1):
        a = np.diff(basins, axis=axis) != 0
        edge |= np.pad(a, [(0, 1), (0, 0)] if axis == 0 else [(0, 0), (0, 1)]) | np.pad(a, [(1, 0), (0, 0)] if axis == 0 else [(0, 0), (1, 0)])
    out = np.where(edge | ~mask | around, 0, basins)
    return np.where(out <= count, out, 0)


def frangi(image: np.ndarray, sigmas=range(1, 10, 2), beta: float = 0.5) -> np.ndarray:
    """Ridge strength: the largest over scales, 0 where the stronger curvature has the wrong sign (dark ridges)."""
    best = np.zeros(image.shape)
    for s in sigmas:
        radius = int(4 * s + 0.5)
        j = np.arange(-radius, radius + 1)
        weights = np.exp(-(j**2) / (2 * s * s))
        weights /= weights.sum()
        blur = image.astype(float)
        for axis in (0, 1):
            blur = np.apply_along_axis(lambda v: np.convolve(np.pad(v, radius, mode="symmetric") if radius <= len(v) else np.pad(v, radius, mode="edge"), weights, "valid"), axis, blur)
        gy, gx = np.gradient(blur)
        yy, yx = np.gradient(gy)
        _, xx = np.gradient(gx)
        yy, yx, xx = yy * s * s, yx * s * s, xx * s * s
        root = np.sqrt(((yy - xx) / 2) ** 2 + yx**2)
        e1, e2 = (yy + xx) / 2 + root, (yy + xx) / 2 - root
        small = np.where(np.abs(e1) < np.abs(e2), e1, e2)
        large = np.where(np.abs(e1) < np.abs(e2), e2, e1)
        strength = np.sqrt(small**2 + large**2)
        gamma = strength.max() / 2 or 1.0
        blob = np.divide(small, large, out=np.zeros_like(small), where=large != 0)
        value = np.exp(-(blob**2) / (2 * beta**2)) * (1 - np.exp(-(strength**2) / (2 * gamma**2)))
        value[large <= 0] = 0
        best = np.maximum(best, value)
    return best


def laplacian(v: np.ndarray, degree: np.ndarray) -> np.ndarray:
    """Each pixel times its number of neighbours, less them."""
    out = degree * v
    out[1:] -= v[:-1]
    out[:-1] -= v[1:]
    out[:, 1:] -= v[:, :-1]
    out[:, :-1] -= v[:, 1:]
    return out


def biharmonic_fill(image: np.ndarray, mask: np.ndarray, tolerance: float = 1e-11, most: int = 20_000) -> np.ndarray:
    """The image with masked pixels such that the Laplacian of the Laplacian is 0 at each; values stay in the known range.

    Conjugate gradients on the stencil, in the rectangle that the masked pixels touch: no matrix
    is made, so the memory is a few images.  Without known pixels the fill is 0.
    """
    if not mask.any():
        return image.astype(float)
    if mask.all():
        return np.zeros(image.shape)
    y, x = np.nonzero(mask)
    box = tuple(slice(max(0, k.min() - 3), k.max() + 4) for k in (y, x))
    full, known = image.astype(float).copy(), image[~mask]
    h, w = mask.shape
    degree = np.full((h, w), 4.0)
    for edge in (np.s_[0], np.s_[-1], np.s_[:, 0], np.s_[:, -1]):
        degree[edge] -= 1
    full[mask] = known.mean()
    m, d = mask[box], degree[box]

    def twice(v):
        # the rectangle's own edge is three pixels off every masked pixel, or the image's
        return laplacian(laplacian(v, d), d)

    part = full[box]
    scale = np.where(m, 1 / (d * d + d), 0.0)  # the stencil's diagonal
    u = np.zeros(part.shape)
    r = np.where(m, -twice(part), 0.0)
    z = scale * r
    p, rz, goal = z, (r * z).sum(), tolerance**2 * max((r * r).sum(), np.finfo(float).tiny)
    for _ in range(most):
        if (r * r).sum() <= goal:
            break
        q = np.where(m, twice(p), 0.0)
        step = rz / (p * q).sum()
        u += step * p
        r -= step * q
        z = scale * r
        rz, before = (r * z).sum(), rz
        p = z + (rz / before) * p
    full[mask] = np.clip((part + u)[m], known.min(), known.max())
    return full


def shift_of(reference: np.ndarray, target: np.ndarray) -> tuple[int, int]:
    """The whole-pixel shift that lays target over reference, by phase correlation; the second half of an axis is negative."""
    cross = np.fft.fft2(reference) * np.conj(np.fft.fft2(target))
    peak = np.unravel_index(np.argmax(np.fft.ifft2(cross / (np.abs(cross) + 1e-8)).real), reference.shape)
    return tuple(int(p if p < n // 2 else p - n) for p, n in zip(peak, reference.shape, strict=True))


def moved(frame: np.ndarray, shift: tuple[int, int]) -> np.ndarray:
    """A frame moved by whole pixels; what comes in repeats the edge."""
    y = np.clip(np.arange(frame.shape[0]) - shift[0], 0, frame.shape[0] - 1)
    x = np.clip(np.arange(frame.shape[1]) - shift[1], 0, frame.shape[1] - 1)
    return frame[y][:, x]


def register(frames: np.ndarray, reference: int = 0) -> np.ndarray:
    """Frames moved onto the reference frame."""
    return np.stack([moved(f, shift_of(frames[reference], f)) for f in frames])


_MASKS = {"largest": largest, "skeleton": skeleton}


def _as_mask(frame: pd.DataFrame, rows: int, columns: int) -> np.ndarray:
    m = np.zeros((rows, columns), bool)
    m[frame["y"].to_numpy(), frame["x"].to_numpy()] = True
    return m


def per_image(mask: DataFrame, rows: int, columns: int, kind: str) -> DataFrame:
    """Apply a mask operator ("largest" or "skeleton") to every acquisition's sparse mask (acq_id, y, x)."""
    f = _MASKS[kind]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        y, x = np.nonzero(f(_as_mask(frame, rows, columns)))
        return pd.DataFrame({"acq_id": frame["acq_id"].iloc[0], "y": y, "x": x})

    return mask.groupBy("acq_id").applyInPandas(run, "acq_id string, y int, x int")


def label_branches(mask: DataFrame, rows: int, columns: int, disc: DataFrame, r1: float = 0.1) -> DataFrame:
    """(acq_id, y, x, branch) of every acquisition's vessel mask, cut around its optic disc (acq_id, center)."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = branches(_as_mask(frame, rows, columns), (frame["_cx"].iloc[0], frame["_cy"].iloc[0]), r1)
        y, x = np.nonzero(out)
        return pd.DataFrame({"acq_id": frame["acq_id"].iloc[0], "y": y, "x": x, "branch": out[y, x]})

    centers = disc.select("acq_id", F.col("center.x").cast("double").alias("_cx"), F.col("center.y").cast("double").alias("_cy"))
    return mask.select("acq_id", "y", "x").join(centers, "acq_id").groupBy("acq_id").applyInPandas(run, "acq_id string, y int, x int, branch int")


def frangi_mask(image: DataFrame, rows: int, columns: int) -> DataFrame:
    """Pixels whose ridge strength is exactly 0, of images (acq_id, y, x, v)."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        y, x = np.nonzero(frangi(_as_image(frame, rows, columns)) == 0)
        return pd.DataFrame({"acq_id": frame["acq_id"].iloc[0], "y": y, "x": x})

    return image.groupBy("acq_id").applyInPandas(run, "acq_id string, y int, x int")


def _as_image(frame: pd.DataFrame, rows: int, columns: int, value: str = "v") -> np.ndarray:
    v = np.zeros((rows, columns))
    v[frame["y"].to_numpy(), frame["x"].to_numpy()] = frame[value].to_numpy()
    return v


def _as_rows(frame: pd.DataFrame, image: np.ndarray) -> pd.DataFrame:
    rows, columns = image.shape
    place = np.arange(rows * columns)
    return pd.DataFrame({"acq_id": frame["acq_id"].iloc[0], "t": frame["t"].iloc[0], "y": place // columns, "x": place % columns, "v": image.ravel()})


_FRAME = "acq_id string, t int, y int, x int, v double"


def blur(video: DataFrame, rows: int, columns: int, sigma: float) -> DataFrame:
    """Gaussian blur of every frame (acq_id, t, y, x, v): a frame is one group, each axis one matrix product.

    Missing pixels count as 0.
    """
    from ..functions import coefficients

    down, across = coefficients.gaussian(rows, sigma), coefficients.gaussian(columns, sigma)
    return video.groupBy("acq_id", "t").applyInPandas(lambda f: _as_rows(f, down @ _as_image(f, rows, columns) @ across.T), _FRAME)


def inpaint(video: DataFrame, mask: DataFrame, rows: int, columns: int) -> DataFrame:
    """Fill the masked pixels (acq_id, y, x) of every frame (acq_id, t, y, x, v); values stay in the known range.

    Each frame is one group with its acquisition's mask joined on, and is solved there; nothing
    comes to the driver.
    """
    marked = video.join(mask.select("acq_id", "y", "x", F.lit(True).alias("hidden")), ["acq_id", "y", "x"], "left")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        hidden = _as_mask(frame[frame["hidden"].notna()], rows, columns)
        return _as_rows(frame, biharmonic_fill(_as_image(frame, rows, columns), hidden))

    return marked.groupBy("acq_id", "t").applyInPandas(run, _FRAME)


def register_video(video: DataFrame, rows: int, columns: int, reference: int = 0) -> DataFrame:
    """Every frame (acq_id, t, y, x, v) moved onto its acquisition's reference frame, by phase correlation."""
    fixed = video.where(F.col("t") == reference).select("acq_id", "y", "x", F.col("v").alias("fixed"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        image = _as_image(frame, rows, columns)
        return _as_rows(frame, moved(image, shift_of(_as_image(frame, rows, columns, "fixed"), image)))

    return video.join(fixed, ["acq_id", "y", "x"]).groupBy("acq_id", "t").applyInPandas(run, _FRAME)
