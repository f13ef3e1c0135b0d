"""Graph semantics, artifacts, sources, and the whole chain on a synthetic acquisition."""

import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from pulsegrid.plans.artifacts import Artifacts, frame_fingerprint
from pulsegrid.plans.dag import Engine, Graph, Step, nested
from pulsegrid.plans.steps import graph
from pulsegrid.sources import folders, models, moments


# the stubs of models go to Python workers, which don't have this file
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def step(name, needs, makes, log=None):
    def run(have, config):
        if log is not None:
            log.append(name)
        return {k: name for k in makes}

    return Step(name, tuple(needs), tuple(makes), run, ("p",))


def test_graph_order_and_errors():
    g = Graph([step("c", ["b"], ["x"]), step("a", ["in"], ["a"]), step("b", ["a"], ["b"])])
    assert g.order == ["a", "b", "c"] and g.external == ["in"]
    assert g.upstream(["b"]) == ["a", "b"] and g.downstream("a") == ["b", "c"]
    with pytest.raises(ValueError):
        Graph([step("a", [], ["x"]), step("b", [], ["x"])])
    with pytest.raises(ValueError):
        Graph([step("a", [], ["x"]), step("a", [], ["y"])])
    with pytest.raises(RuntimeError):
        Graph([step("a", ["y"], ["x"]), step("b", ["x"], ["y"])])
    with pytest.raises(ValueError):
        g.upstream(["nothing"])


@pytest.mark.parametrize("folder", [False, True])
def test_reuse_and_invalidation(spark, tmp_path, folder):
    log = []
    g = Graph([step("a", ["in"], ["a"], log), step("b", ["a"], ["b"], log), step("c", ["b"], ["c"], log)])
    e = Engine(g, Artifacts(spark, str(tmp_path) if folder else None), {"p": 1})
    with pytest.raises(RuntimeError):
        e.run()
    e.store.put("in", 1)
    e.run()
    assert log == ["a", "b", "c"]
    log.clear()
    e.run()
    assert log == ["c"]  # the last selected step always runs
    assert e.decide() == e.decide()
    log.clear()
    e.config["p"] = 2
    e.run()
    assert log == ["a", "b", "c"]
    log.clear()
    e.store.put("in", 2)
    e.run(["b"])
    assert log == ["a", "b"]
    if folder:  # another process
        log.clear()
        e = Engine(g, Artifacts(spark, str(tmp_path)), {"p": 2})
        assert e.cached("a") and e.cached("c") and not Engine(g, Artifacts(spark, str(tmp_path)), {"p": 3}).cached("c")
        e.run()
        assert log == ["c"]
        log.clear()
        e = Engine(g, Artifacts(spark, str(tmp_path)), {"p": 3}, debug=True)
        e.run(["b"])
        assert log == ["b"]  # in debug mode only the target, whatever has changed


def test_a_store_finds_what_another_made(spark, tmp_path):
    a = Artifacts(spark, str(tmp_path), {"x": "g/h"})
    a.put("x", spark.range(3))
    a.put("n", [1, 2])
    a.put("x", a.get("x").selectExpr("id + 1 as id"))
    b = Artifacts(spark, str(tmp_path))
    assert sorted(r[0] for r in b.get("x").collect()) == [1, 2, 3] and b.get("n") == [1, 2]
    assert len(list((tmp_path / "g" / "h").iterdir())) == 1


def test_nested_needs_only_what_it_does_not_make():
    n = nested("n", [step("a", ["in"], ["x"]), step("b", ["x", "other"], ["y"])])
    assert n.requires == ("in", "other") and n.produces == ("x", "y")
    assert n.run({"in": 1, "other": 2}, {}) == {"x": "a", "y": "b"}


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(2, None), (1, "a")], "k int, v string")
    assert frame_fingerprint(a) == frame_fingerprint(b) != frame_fingerprint(a.limit(1))
    assert frame_fingerprint(a) != frame_fingerprint(a.withColumnRenamed("v", "w"))


def test_folders(tmp_path):
    home = tmp_path / "m" / "m_HD"
    (home / "json").mkdir(parents=True)
    (home / "h5").mkdir()
    with pytest.raises(FileNotFoundError):
        folders.acquisition(tmp_path / "m")
    (home / "json" / "z.json").write_text(json.dumps({"sampling freq": 3}))
    for n in ("a.h5", "x_raw.h5", "y_output.h5"):
        (home / "h5" / n).touch()
    found = folders.acquisition(tmp_path / "m.holo")
    assert found.moments.name == "y_output.h5" and folders.load_json(found.settings) == {"samplingfreq": 3}
    assert folders.next_output(["output_2", "output_10", "x"]) == "output_11"
    results = folders.Results(tmp_path / "m", {"a": 1})
    assert not list((results.home / "output").iterdir()) and results.settings_file.exists()
    assert results.output().name == "output_0" and results.output().name == "output_0" and json.loads((results.output() / "settings.json").read_text()) == {"a": 1}
    assert folders.Results(tmp_path / "m").output().name == "output_1"
    assert folders.ordered({"b": [2, 1], "a": 0}) == folders.ordered({"a": 0, "b": [1, 2]})
    (tmp_path / "list.txt").write_text("x\n\n y \n")
    assert folders.batch(tmp_path / "list.txt") == ["x", "y"] and folders.batch(tmp_path / "m") == [str(tmp_path / "m" / d) for d in ("m_DV", "m_HD")]
    assert folders.flatten_layout({"g": {"h": {"n": "key"}}, "k": "l"}) == {"key": "g/h/n", "l": "k"}
    assert [folders.workers(x, 8) for x in (-1, -2, 0.5, 3)] == [8, 7, 4, 3]
    with pytest.raises(NotADirectoryError):
        folders.resolve_path(tmp_path / "none")


def test_models():
    r = models.Registry({"a": {"task": "t", "hf_repo": "r", "filename": "f", "format": "onnx", "input_norm": "none", "output_activation": "none"}, "b": {"task": "u", "hf_repo": "r", "filename": "f", "format": "pt", "input_norm": "none", "output_activation": "none"}})
    asked = []
    m = models.Manager(r, lambda s, again: asked.append(again) or f"/x/{s.name}")
    assert m.resolve("t")[1] == m.resolve("t")[1] == "/x/a" and m.resolve("t", refresh=True)[1] == "/x/a" and asked == [False, True]
    assert m.choices("t") == ["a"] and str(m) == "t=a@main; u=b@main"
    for bad in (("z", "a"), ("t", "z"), ("t", "b")):
        with pytest.raises(ValueError):
            m.change(*bad)


class Stub:
    """Stands for a model: two classes, the image and its negative."""

    def __init__(self, path):
        self.path = path

    def predict(self, image):
        return np.stack([image[0], -image[0]])[None]


@pytest.mark.parametrize("activation, shape", [("argmax", [1, 2, 2]), ("softmax", [1, 2, 2, 2]), ("none", [1, 2, 2, 2])])
def test_inference_with_a_stub(spark, activation, shape):
    from pulsegrid.operators import inference as N

    spec = models.ModelSpec("s", "t", "r", "f", "stub", "minmax", activation)
    images = {"m": spark.createDataFrame([("a", 0, 0, 0.0), ("a", 0, 1, 1.0), ("a", 1, 0, 2.0), ("a", 1, 1, 4.0)], "acq_id string, y int, x int, v double")}
    df = N.channels(images, ["m"], 2, 2)
    out = N.infer(df, spec, "stub-path", Stub)
    r = out.first()
    assert r["shape"] == shape
    if activation == "argmax":
        assert [p["v"] for p in N.pixels(out, 2, 2).orderBy("y", "x").collect()] == [0.0] * 4
    if activation == "none":
        assert np.allclose(r["data"], [0, 0.25, 0.5, 1, 0, -0.25, -0.5, -1])


def test_model_inputs_as_columns_and_arrays_agree(spark):
    from pyspark.sql import functions as F

    from pulsegrid.operators import inference as N

    x = [0.0, 10.0, 30.0, 255.0]
    df = spark.createDataFrame([(x,)], "x array<double>")
    for kind, f in N.NORMS.items():
        assert np.allclose(df.select(N.channel_norm(F.col("x"), kind)).first()[0], f(np.array(x)))
    assert N.NORMS["none"](np.array(x)).tolist() == [0, 9, 29, 254]


def test_whole_size_prediction(spark):
    """A random image of 512 x 512 through a model of the registry."""
    from pulsegrid.operators import inference as N

    entry = {"task": "t", "hf_repo": "r", "filename": "f", "format": "stub", "input_norm": "minmax", "output_activation": "sigmoid", "input_channels": ["m"]}
    manager = models.Manager(models.Registry({"a": entry}), lambda spec, again: "somewhere", {"stub": Stub})
    spec, path = manager.resolve("t")
    image = np.random.default_rng(0).random((512, 512))
    y, x = np.mgrid[:512, :512].reshape(2, -1)
    import pandas as pd

    rows = spark.createDataFrame(pd.DataFrame({"acq_id": "a", "y": y, "x": x, "v": image.ravel()}))
    out = N.infer(N.channels({"m": rows}, spec.input_channels, 512, 512), spec, path, manager.backend(spec)).first()
    assert out["shape"] == [1, 2, 512, 512] and np.allclose(out["data"][:3], 1 / (1 + np.exp(-image.ravel()[:3])), atol=0.01)


def test_onnx_sizes_must_match():
    from pulsegrid.operators import inference as N

    b = N.OnnxBackend.__new__(N.OnnxBackend)
    b.input = type("I", (), {"shape": ["n", 3, 8, 8], "name": "x"})
    b.session = type("S", (), {"run": lambda self, _, feed: [feed["x"]]})()
    assert b.predict(np.zeros((8, 8))).shape == (1, 3, 8, 8)
    for bad in ((3, 8, 9), (2, 8, 8)):
        with pytest.raises(ValueError):
            b.predict(np.zeros(bad))


def test_pictures(tmp_path):
    from pulsegrid.sources import render

    r = np.random.default_rng(0)
    for image in (r.integers(0, 256, (7, 5)).astype(np.uint8), r.integers(0, 256, (4, 6, 3)).astype(np.uint8)):
        render.save_png(image, tmp_path / "a.png")
        assert (render.load_png(tmp_path / "a.png") == image).all()
    assert set(np.unique(render.uint8(np.array([[True, False]])))) == {0, 255}
    p = render.plot([np.sin(np.arange(50) / 5), [None, 1.0, 2.0]], ["a", "b"])
    assert (p == render.COLOURS[0]).all(2).sum() > 100 and (p == render.COLOURS[1]).all(2).any()
    b = render.boxed(np.zeros((40, 60)), (30, 20), (20, 10))
    assert (b[15, 30] == (255, 0, 0)).all() and (b[15, 21] == (0, 255, 0)).all() and (b == (255, 0, 0)).all(2).any()
    labels = np.zeros((30, 30), int)
    labels[2:14, 2:14], labels[20:29, 15:29] = 1, 2
    assert (render.labelled(labels)[2, 2] == render.COLOURS[1]).all()
    frames = [np.full((3, 5), 40 * k, np.uint8) for k in range(4)]
    render.avi(frames, 4, 3, 5, tmp_path / "v.avi")
    data = (tmp_path / "v.avi").read_bytes()
    assert data[:4] == b"RIFF" and int.from_bytes(data[4:8], "little") == len(data) - 8 and data.count(b"00db") == 8
    assert data[data.index(b"movi") + 4 + 8 :][:15] == b"\0" * 15


def test_settings(tmp_path, monkeypatch):
    from pulsegrid.sources import settings

    path = settings.ensure_file(tmp_path, "settings.json", versioned=True)
    path.write_text(json.dumps({"Version": 0.5}))
    settings.ensure_file(tmp_path, "settings.json")
    assert json.loads(path.read_text()) == {"Version": 0.5}
    settings.ensure_file(tmp_path, "settings.json", versioned=True)
    assert json.loads(path.read_text())["Version"] == 1.0
    path.write_text(json.dumps({"Mask": {"DiaphragmRadius": 0.3}, "Version": 1}))
    (tmp_path / "mine.json").write_text(json.dumps({"VelocityEstimation": {"Phi": 0.5}}))
    got = settings.load_settings(str(tmp_path / "mine.json"), path)
    assert got["Mask"]["DiaphragmRadius"] == 0.3 and got["VelocityEstimation"] == {"LocalBackgroundDist": 2, "Lambda": 8.52e-7, "Phi": 0.5}
    assert settings.load_settings(None, path, "default") == settings.DEFAULTS
    with pytest.raises(ValueError):
        settings.load_settings(None, None, "other")
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "home"))
    assert settings.user_folder().is_dir()


def test_log_file(tmp_path, handlers):
    import logging

    from pulsegrid.sources import settings

    for text in ("one", "two"):
        path = settings.start_logging(tmp_path)
        logging.getLogger("x").info(text)
    assert "two" in path.read_text() and "one" not in path.read_text()


class FakeFile(dict):
    """Stands for an HDF5 file: datasets that note what is read of them."""

    def __init__(self, data):
        super().__init__(data)
        self.read = []

    def __call__(self, path, mode):
        return self

    def __enter__(self):
        return {k: type("D", (), {"shape": v.shape, "__getitem__": lambda s, w, v=v: self.read.append(w) or v[w]})() for k, v in self.items()}

    def __exit__(self, *_):
        pass


@pytest.mark.parametrize("shape", [(5, 3, 4), (1, 5, 3, 4, 1), (1, 1, 3, 4), (3, 4)])
def test_moment_files(monkeypatch, shape):
    import sys

    video = np.arange(np.prod(shape), dtype=float).reshape(shape)
    fake = FakeFile({"moment0": video, "moment2": video * 2})
    monkeypatch.setitem(sys.modules, "h5py", type("M", (), {"File": fake}))
    reader = moments.MomentsReader({"path": "p", "acq_id": "a", "frames": "2"})
    parts = reader.partitions()
    assert not fake.read and {p.moment for p in parts} == {0, 2}
    rows = [r for p in parts for r in reader.read(p)]
    flat = video.reshape(-1, 3, 4)
    assert len(rows) == 2 * len(flat)
    for _, m, t, h, w, data in rows:
        assert (h, w) == (4, 3) and (np.array(data).reshape(4, 3) == flat[t].T * (1 + m / 2)).all()
    if shape == (5, 3, 4):
        assert {w[0] for w in fake.read} == {slice(0, 2), slice(2, 4), slice(4, 5)}


def test_streaming_equals_batch(spark, tmp_path):
    from pulsegrid.streaming.pulse import tumbling

    rows = spark.createDataFrame([(1, "2024-01-01 00:10:00", 2.0), (1, "2024-01-01 05:00:00", 4.0), (2, "2024-01-02 00:00:00", 1.0)], "user_id long, ts string, value double").selectExpr("user_id", "cast(ts as timestamp) ts", "value")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = tumbling(stream).writeStream.format("memory").queryName("pulses").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("select * from pulses").collect())) == sorted(map(tuple, tumbling(rows).collect()))


def synthetic(n=80, size=20, rate=40.0, beats_hz=1.25):
    """An artery tube with a steep rise and a vein tube with a steep fall over a smooth background."""
    t = np.arange(n) / rate
    phase = (t * beats_hz) % 1
    artery = np.where(phase < 0.15, phase / 0.15, np.exp(-(phase - 0.15) * 4))
    y, x = np.mgrid[:size, :size]
    m0 = np.full((n, size, size), 10.0) + 0.02 * x + 0.01 * y
    m0[:, 2:18, 5:8] += 2 + artery[:, None, None]
    m0[:, 2:18, 12:15] += 2 - 0.8 * artery[:, None, None]
    m0 += 0.01 * np.random.default_rng(0).normal(size=m0.shape)
    m2 = m0 * 4
    m2[:, 2:18, 5:8] *= (1.5 + 0.5 * artery)[:, None, None]
    return {0: m0, 1: m0 * 0.1, 2: m2}


@pytest.fixture(scope="module")
def scene(spark):
    """Cached videos, masks and settings of the synthetic acquisition."""
    n, size = 80, 20
    rows = moments.pixels(moments.from_arrays(spark, "a", synthetic(n, size))).cache()
    videos = {m: rows.where(f"moment = {m}").select("acq_id", "t", "y", "x", "v") for m in (0, 2)}
    place = [("a", y, x) for y in range(2, 18) for x in [*range(5, 8), *range(12, 15)]]
    mask = lambda keep: spark.createDataFrame([p for p in place if keep(p[2])], "acq_id string, y int, x int").coalesce(1).cache()
    config = {"shape": [n, size, size], "sampling_freq": 40.0, "batch_stride": 1.0, "acquisitions": ["a"], "Waveform": {"Distance": 20}}
    return rows, videos, mask, config


def test_the_graph_of_the_shipped_steps():
    g = graph()
    assert g.external == ["frames"] and len(g.order) == 9 and g.order[0] == "read_moments" and g.order[-1] == "arterial_waveform_analysis"
    assert g.upstream(["optic_disc_detection"]) == g.order[:3]


def test_flat_field_keeps_the_energy_inside_the_border(scene):
    from pulsegrid.plans import steps

    _, videos, _, _ = scene
    some = videos[0].where("t < 4").withColumn("v", videos[0].v / 20)
    flat = steps.flat_field(some, 20, 20, 1.4)
    border = lambda d: d.where("y >= 3 and y < 17 and x >= 3 and x < 17").groupBy().sum("v").first()[0]
    assert np.isclose(border(flat), border(some), rtol=1e-9) and flat.count() == some.count()


def test_branches_and_votes(spark, scene, tmp_path):
    from pulsegrid.plans import steps

    _, videos, mask, config = scene
    store = Artifacts(spark, str(tmp_path))
    disc = spark.sql("select 'a' acq_id, struct(10.0D as x, 10.0D as y) center, struct(4.0D as dx, 4.0D as dy) axes")
    out = steps.pre_artery({"M0_ff_video": videos[0], "retinal_vessel_mask": mask(lambda x: True), "optic_disc": disc}, config | {"keep": store.keep})
    assert out["branch_signals"].select("branch").distinct().count() >= 2
    artery = {(r["y"], r["x"]) for r in out["pre_artery_mask"].collect()}
    assert artery and all(x < 10 for _, x in artery)


def test_waveform(spark):
    from pulsegrid.plans import steps

    x = synthetic(80, 20)[0][:, 10, 6].tolist()
    signal = spark.createDataFrame([("a", x)], "acq_id string, x array<double>").coalesce(1)
    made = steps.arterial_waveform({"retinal_artery_velocity_signal": signal}, {"sampling_freq": 40.0, "batch_stride": 1.0, "Waveform": {"Distance": 20}})
    beats = [r["t"] for r in made["beat_indices"].orderBy("t").collect()]
    assert len(beats) >= 2 and all(abs(b - a - 32) <= 2 for a, b in zip(beats, beats[1:], strict=False))
    rows = made["retinal_artery_velocity_signal_filtered_perbeat"].orderBy("beat").collect()
    assert len(rows) == len(beats) and set(rows[-1]["x"]) == {0.0} and all(len(r["x"]) == 128 for r in rows)


def test_the_disc_moves_branches_and_diaphragm(spark):
    from pulsegrid.operators import morphology
    from pulsegrid.plans import steps

    place = [("a", y, 20) for y in range(2, 39)] + [("b", y, 20) for y in range(2, 39)]
    mask = spark.createDataFrame(place, "acq_id string, y int, x int")
    disc = spark.sql("select * from values ('a', struct(20.0D as x, 20.0D as y), struct(4.0D as dx, 4.0D as dy)), ('b', struct(20.0D as x, 5.0D as y), struct(4.0D as dx, 4.0D as dy)) as t(acq_id, center, axes)")
    found = morphology.label_branches(mask, 41, 41, disc).collect()
    gone = {a: {y for _, y, _ in place if (a, y) not in {(r["acq_id"], r["y"]) for r in found}} for a in "ab"}
    assert 20 in gone["a"] and 20 not in gone["b"] and 5 in gone["b"] and 30 not in gone["a"] | gone["b"]
    image = spark.range(41 * 41).selectExpr("explode(array('a', 'b')) acq_id", "cast(id div 41 as int) y", "cast(id % 41 as int) x", "1.0D v")
    none = mask.limit(0)
    out = steps.choroidal_vessels({"M0_ff_image": image, "retinal_vessel_mask": none, "optic_disc": disc}, {"shape": [1, 41, 41], "Mask": {"DiaphragmRadius": 0.1}})["choroidal_vessel_mask"]
    middle = {r["acq_id"]: (r["avg(y)"], r["avg(x)"]) for r in out.groupBy("acq_id").avg("y", "x").collect()}
    assert abs(middle["a"][0] - 20) < 1 and abs(middle["b"][0] - 20) < 1 and abs(middle["b"][1] - 5) < 1


def test_methods_without_their_model_say_so(spark):
    from pulsegrid.plans import steps

    image = spark.createDataFrame([("a", 0, 0, 1.0)], "acq_id string, y int, x int, v double")
    have = {"M0_ff_image": image, "M1_ff_image": image, "pre_artery_mask": image, "pre_vein_mask": image}
    for f in (steps.optic_disc, steps.retinal_vessels, steps.artery_vein):
        with pytest.raises(ValueError, match="model"):
            f(have, {"shape": [1, 1, 1]})
    with pytest.raises(ValueError, match="frangi"):
        steps.retinal_vessels(have, {"shape": [1, 1, 1], "Mask": {"VesselSegmentationMethod": "other"}})
    brightest = steps.optic_disc(have, {"shape": [1, 1, 1], "Mask": {"OpticDiskDetectorMethod": "moment1"}})["optic_disc"].first()
    assert tuple(brightest["center"]) == (0.0, 0.0) and tuple(brightest["axes"]) == (100.0, 100.0)


class Vessels:
    """Stands for the three shipped models on the synthetic scene."""

    def __init__(self, path):
        self.kind = path

    def predict(self, image):
        h, w = image.shape[-2:]
        x = np.arange(w) * np.ones((h, 1))
        artery, vein = (x >= 5) & (x < 8), (x >= 12) & (x < 15)
        if self.kind == "disc":
            return np.array([[[9.0, 1.0], [10.0, 1.0], [4.0, 1.0], [5.0, 1.0], [0.9, 0.1]]])
        if self.kind == "vessels":
            return np.where(artery | vein, 4.0, -4.0)[None, None]
        return np.stack([~(artery | vein), artery, vein]).astype(float)[None]


def test_all_nine_steps(spark, tmp_path, monkeypatch):
    """From an acquisition folder's contents to the beats, with pictures, then reused by another run."""
    from pulsegrid.plans.runs import Run, run_batch

    n, size = 160, 20
    frames = moments.from_arrays(spark, "a", synthetic(n, size))
    frames.coalesce(2).write.parquet(str(tmp_path / "frames"))
    entry = lambda task, f, act, *names: {"task": task, "hf_repo": "r", "filename": f, "format": "stub", "input_norm": "minmax", "output_activation": act, "input_channels": list(names)}
    registry = models.Registry({"d": entry("optic_disc_detection", "disc", "none", "M0_ff_image"), "v": entry("retinal_vessel_segmentation", "vessels", "sigmoid", "M0_ff_image"), "a": entry("retinal_artery_vein_segmentation", "av", "argmax", "M0_ff_image", "correlation", "diasys_image")})
    manager = lambda: models.Manager(registry, lambda spec, again: spec.filename, {"stub": Vessels})
    (tmp_path / "c.json").write_text(json.dumps({"Waveform": {"Distance": 20}}))
    make = lambda **o: Run(spark, str(tmp_path / "frames"), str(tmp_path / "out"), str(tmp_path / "c.json"), models=manager(), **o)
    run = make()
    made = run()
    assert tuple(made["optic_disc"].first()["center"]) == (9.0, 10.0)
    assert made["retinal_artery_mask"].count() == made["retinal_vein_mask"].count() == 3 * size
    beats = [r["t"] for r in made["beat_indices"].orderBy("t").collect()]
    assert len(beats) >= 2 and made["retinal_artery_velocity_signal_filtered_perbeat"].count() == len(beats)
    assert made["velocity_map_avg"].count() == size * size
    told = []
    again = make()  # its last step runs again and replaces what the first run made
    made = again(callback=lambda *e: told.append(e))
    assert [e[1] for e in told if e[0] == "step_skipped"] == run.engine.graph.order[:-1]
    from pulsegrid.sources.render import Renderer

    (tmp_path / "p").mkdir()
    r = Renderer(lambda: tmp_path / "p", {"M0_ff_image": "image", "retinal_artery_mask": "mask", "pre_arterial_pulse": "signal", "optic_disc": "optic_disc", "labeled_vessels": "labeled_mask"}, (n, size, size), ["a"], again.engine.store.all)
    r.step("all", made)
    assert len(r.made) == 5 and all(p.stat().st_size > 60 for p in r.made)
    import h5py_stub

    monkeypatch.setitem(sys.modules, "h5py", h5py_stub)
    h5py_stub.FILES.clear()
    again.export_h5("folder")
    data = h5py_stub.FILES["folder/a.h5"]
    assert data["analysis/retinal_velocity_array"].shape == (n, size, size) and data["segmentation/Retina/artery_mask"].sum() == 3 * size
    assert data["analysis/beat_indices"].tolist() == beats and data["segmentation/OpticDisc/disc_center"].tolist() == [9.0, 10.0]
    assert data["analysis/velocitysignal_per_beat"].shape == (len(beats), 128) and data["analysis/retinal_artery_velocity_signal"].shape == (n,)
    bad = run_batch(spark, [str(tmp_path / "none"), str(tmp_path / "frames")], ["read_moments"], str(tmp_path / "batch"))
    assert [(row["ok"], bool(row["error"])) for row in bad.collect()] == [(False, True), (True, False)]


@pytest.fixture
def handlers():
    """The root logger as it was."""
    import logging

    root = logging.getLogger()
    before, level = list(root.handlers), root.level
    yield
    for h in list(root.handlers):
        root.removeHandler(h)
    for h in before:
        root.addHandler(h)
    root.setLevel(level)


def test_command_line(spark, tmp_path, capsys, handlers):
    from pulsegrid import cli

    logs = ["--logs", str(tmp_path)]
    assert cli.main([str(tmp_path / "none"), *logs]) == 1 and "there is no" in capsys.readouterr().err
    frames = str(tmp_path / "frames")
    moments.from_arrays(spark, "a", {m: np.arange(48.0).reshape(3, 4, 4) for m in range(3)}).write.parquet(frames)
    assert cli.main([frames, "-o", str(tmp_path / "out"), "-t", "read_moments", *logs]) == 0
    found = Artifacts(spark, str(tmp_path / "out"))
    assert found.get("moment1").count() == 48 and found.get("size") == [3, 4, 4] and "step_done read_moments" in (tmp_path / "last_run.log").read_text()
    (tmp_path / "list.txt").write_text(f"{frames}\n{tmp_path}/none\n")
    assert cli.main([str(tmp_path / "list.txt"), "-b", "-o", str(tmp_path / "many"), "-t", "read_moments", *logs]) == 1
    assert "none:" in capsys.readouterr().err and Artifacts(spark, str(tmp_path / "many" / "frames")).has("moment2")
