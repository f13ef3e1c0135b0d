"""Whole runs: an acquisition folder, a Parquet table of frames, or a batch of either."""

from __future__ import annotations

import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import folders, moments, settings
from ..sources.render import Renderer
from .artifacts import Artifacts
from .dag import Engine
from .steps import graph

logger = logging.getLogger(__name__)


class Run:
    """One input with its store, settings and engine.

    The input is an acquisition folder (or its .holo file), whose results go beside it, or a
    Parquet table of frames (columns of moments.SCHEMA; many acquisitions of one size), whose
    results go to ``out``.  Settings given explicitly win over the input's own, those over the
    defaults.  Artifacts that lie there from a run before are reused where nothing changed.
    """

    def __init__(self, spark: SparkSession, path: str, out: str | None = None, config: str | None = None, mode: str = "local", debug: bool = False, models=None, layout: str | None = None, rendered: str | None = None, extra: dict | None = None):
        self.spark, self.path = spark, path
        here = Path(path)
        results = None
        if here.suffix == ".holo" or (here.is_dir() and (here / f"{here.name}_HD").is_dir()):
            found = folders.acquisition(path)
            results = folders.Results(path)
            own = {k: v for k, v in folders.load_json(found.settings).items() if k in ("sampling_freq", "batch_stride")}
            self.config = settings.load_settings(config, results.settings_file, mode) | own
            place = out or results.artifacts.as_uri()
            spark.dataSource.register(moments.MomentsSource)
            frames = spark.read.format(moments.MomentsSource.name()).option("path", str(found.moments)).option("acq_id", found.acq_id).load()
        else:
            if out is None:
                raise ValueError(f"{path} is no acquisition folder; for a table of frames give the folder of its results")
            self.config = {"sampling_freq": 40.0, "batch_stride": 1.0} | settings.load_settings(config, None, mode)
            place, frames = out, spark.read.schema(moments.SCHEMA).parquet(path)
        self.config |= (extra or {}) | ({"models": models} if models is not None else {})
        store = Artifacts(spark, place, folders.flatten_layout(settings.load_or_default(layout, "layout.json")))
        if not (debug and store.has("frames")):
            seen = frames.agg(F.max("t"), F.max("h"), F.max("w")).first()
            if seen[0] is None:
                raise ValueError(f"{path} has no frames")
            store.put("size", [seen[0] + 1, seen[1], seen[2]])
            store.put("frames", moments.pixels(frames))
        self.ids = [r[0] for r in store.get("frames").select("acq_id").distinct().orderBy("acq_id").collect()]
        self.config |= {"shape": store.get("size"), "acquisitions": self.ids}
        self.engine = Engine(graph(), store, self.config, debug)
        self.layout = store.layout
        if results is not None:
            results.settings = self.config
            wanted = settings.load_or_default(rendered, "rendered.json")
            self.renderer = Renderer(results.output, wanted, tuple(self.config["shape"]), self.ids, store.all)
            self.engine.export = self.renderer.step

    def __call__(self, targets=None, callback=None) -> dict:
        return self.engine.run(targets, callback)

    def export_h5(self, folder: str) -> list[str]:
        """The artifacts of each acquisition as <folder>/<acquisition>.h5; returns the files."""
        from ..sources.sinks import export_h5

        files = [str(Path(folder) / f"{a}.h5") for a in self.ids]
        for a, file in zip(self.ids, files, strict=True):
            export_h5(self.engine.store.all(), self.layout, file, tuple(self.config["shape"]), a)
        return files


def run_batch(spark: SparkSession, paths: list[str], targets=None, out: str | None = None, **options) -> DataFrame:
    """Run every input; what fails is logged and the others go on.  Returns (path, error, ok), a row for each input."""
    rows = []
    for path in paths:
        try:
            logger.info("%s: begins", path)
            Run(spark, path, f"{out}/{Path(path).name}" if out else None, **options)(targets)
            rows.append((str(path), None, True))
        except Exception as e:  # whatever one input's failure is, it must not end the batch
            logger.exception("%s: failed", path)
            rows.append((str(path), f"{type(e).__name__}: {e}"[:2000], False))
    return spark.createDataFrame(rows, "path string, error string, ok boolean")
