"""Image operators on planted shapes."""

import numpy as np
import pytest

from pulsegrid.operators import morphology as M


def test_components():
    m = np.zeros((6, 8), bool)
    m[0, 0] = m[1, 1] = m[2, 2] = True
    m[4, 5:8] = m[5, 5:8] = True
    assert M.label(m).max() == 2 and M.label(m, eight=False).max() == 4
    assert M.largest(m).sum() == 6 and M.largest(m)[4, 5]
    assert not M.largest(np.zeros((3, 3), bool)).any()


def test_skeleton_is_thin_and_connected():
    m = np.zeros((20, 20), bool)
    m[8:12, 2:18] = True
    s = M.skeleton(m)
    assert s.any() and (s <= m).all() and s.sum(0).max() <= 2 and M.label(s).max() == 1


def test_branches_of_a_cross():
    m = np.zeros((41, 41), bool)
    m[19:22, 1:40] = m[1:40, 19:22] = True
    out = M.branches(m, (20, 20), 0.1)
    assert len(np.unique(out)) - 1 == 4 and not out[~m].any() and not out[20, 20]


def solved(image, mask):
    """The fill by a dense solve."""
    degree = np.full(mask.shape, 4.0)
    for edge in (np.s_[0], np.s_[-1], np.s_[:, 0], np.s_[:, -1]):
        degree[edge] -= 1
    one = np.stack([M.laplacian(e.reshape(mask.shape), degree).ravel() for e in np.eye(mask.size)], 1)
    both, u, x = one @ one, mask.ravel(), image.ravel().copy()
    x[u] = np.clip(np.linalg.solve(both[np.ix_(u, u)], -both[np.ix_(u, ~u)] @ x[~u]), x[~u].min(), x[~u].max())
    return x.reshape(mask.shape)


def test_inpainting():
    y, x = np.mgrid[:12, :12]
    plane = 2.0 * y + 3 * x
    mask = np.zeros((12, 12), bool)
    mask[5:7, 5:8] = True
    assert np.allclose(M.biharmonic_fill(np.where(mask, -50, plane), mask), plane)
    r = np.random.default_rng(0)
    image = r.normal(size=(18, 22)).cumsum(0).cumsum(1)
    for mask in (r.random((18, 22)) < 0.3, np.pad(np.ones((6, 9), bool), ((0, 12), (13, 0)))):
        assert np.allclose(M.biharmonic_fill(image, mask), solved(image, mask), atol=1e-8)
    assert (M.biharmonic_fill(image, np.zeros_like(mask)) == image).all() and not M.biharmonic_fill(image, np.ones_like(mask)).any()


def test_inpainting_each_acquisition_by_its_own_mask(spark):
    rows = [(a, t, y, x, float(t + y * k)) for a, k in (("a", 1), ("b", 3)) for t in range(2) for y in range(8) for x in range(8)]
    video = spark.createDataFrame(rows, "acq_id string, t int, y int, x int, v double")
    mask = spark.createDataFrame([("a", 3, 3), ("b", 4, 5), ("b", 5, 5)], "acq_id string, y int, x int")
    spoiled = video.join(mask.selectExpr("acq_id", "y", "x", "true as bad"), ["acq_id", "y", "x"], "left").selectExpr("acq_id", "t", "y", "x", "if(bad, -9D, v) as v")
    got = {(r["acq_id"], r["t"], r["y"], r["x"]): r["v"] for r in M.inpaint(spoiled, mask, 8, 8).collect()}
    assert len(got) == len(rows) and all(abs(got[a, t, y, x] - v) < 1e-6 for a, t, y, x, v in rows)


def test_registered_video(spark):
    f = np.random.default_rng(1).normal(size=(10, 10))
    rows = [("a", t, y, x, float(v)) for t, g in enumerate((f, np.roll(f, (2, 1), (0, 1)))) for (y, x), v in np.ndenumerate(g)]
    video = spark.createDataFrame(rows, "acq_id string, t int, y int, x int, v double")
    out = np.zeros((2, 10, 10))
    for r in M.register_video(video, 10, 10).collect():
        out[r["t"], r["y"], r["x"]] = r["v"]
    assert np.allclose(out[0], f) and np.allclose(out[1][:-2, :-1], f[:-2, :-1])


def test_spline_and_cardiac_cleaning():
    from pulsegrid.operators import cardiac

    x = np.arange(20.0)
    cube = x**3 - 4 * x
    kept = np.delete(np.arange(20), [0, 3, 4, 9, 19])
    assert np.allclose(cardiac.spline(x[kept], cube[kept], x), cube)
    assert np.allclose(cardiac.spline(x[:2], cube[:2], x[:3]), [0, -3, -6]) and np.allclose(cardiac.spline(x[:3], (x**2)[:3], x[:5]), x[:5] ** 2)
    wave = np.sin(np.arange(100) / 6)
    spoiled = wave.copy()
    spoiled[50] = 9
    clean, flags = cardiac.clean(spoiled)
    assert flags[50] and abs(clean - wave).max() < 0.2
    assert cardiac.clean(np.ones(4))[0].tolist() == [1.0] * 4 and len(cardiac.clean(np.zeros(0))[0]) == 0


def test_registration():
    f = np.random.default_rng(0).normal(size=(16, 16))
    assert M.shift_of(f, np.roll(f, (2, -3), (0, 1))) == (-2, 3)
    moved = M.register(np.stack([f, np.roll(f, (1, 0), (0, 1))]))
    assert np.allclose(moved[1][:-1], f[:-1])


def test_frangi_marks_dark_lines():
    image = np.ones((30, 30))
    image[:, 15] = 0
    f = M.frangi(image)
    assert f[15, 15] > 0 and f[15, 2] < f[15, 15]


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_dilation(spark, radius):
    from pulsegrid.operators import masks

    df = spark.createDataFrame([("a", 0, 0), ("a", 5, 5)], "acq_id string, y int, x int")
    m = np.zeros((8, 8), bool)
    m[0, 0] = m[5, 5] = True
    got = np.zeros((8, 8), bool)
    for r in masks.dilate(df, radius, 8, 8, ["acq_id"]).collect():
        got[r["y"], r["x"]] = True
    assert (got == M.dilate(m, radius)).all()
