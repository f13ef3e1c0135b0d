"""Readers of moment videos as rows (acq_id, moment, t, y, x, v)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "acq_id string, moment int, t int, h int, w int, data array<double>"


def oriented(data: np.ndarray) -> np.ndarray:
    """(T, a, b) with size-one axes dropped and the last two swapped; a single frame stays a video."""
    data = np.asarray(data)
    while data.ndim > 3:
        axis = next((i for i, n in enumerate(data.shape) if n == 1), None)
        if axis is None:
            raise ValueError(f"a moment has {data.ndim} axes")
        data = data.squeeze(axis)
    if data.ndim == 2:
        data = data[None]
    return data.transpose(0, 2, 1)


class Frames(InputPartition):
    def __init__(self, path: str, acq_id: str, moment: int, first: int, last: int):
        self.path, self.acq_id, self.moment, self.first, self.last = path, acq_id, moment, first, last


def video_axes(shape: tuple[int, ...]) -> list[int]:
    """Which axes of a stored moment are (T, a, b): axes of size one are dropped as long as there are more than three."""
    axes = list(range(len(shape)))
    while len(axes) > 3:
        one = next((a for a in axes if shape[a] == 1), None)
        if one is None:
            raise ValueError(f"a moment has {len(shape)} axes: {shape}")
        axes.remove(one)
    return axes


class MomentsReader(DataSourceReader):
    """Frame ranges of the datasets moment0 to moment2; a missing dataset gives no rows.

    Only a dataset's shape is looked at to plan, and only its own frames are read by a task.
    """

    def __init__(self, options):
        self.path, self.acq_id, self.step = options["path"], options.get("acq_id", ""), int(options.get("frames", 64))

    def partitions(self):
        import h5py  # optional

        out = []
        with h5py.File(self.path, "r") as f:
            for m in range(3):
                if f"moment{m}" in f:
                    shape = f[f"moment{m}"].shape
                    n = shape[video_axes(shape)[0]] if len(shape) > 2 else 1
                    out += [Frames(self.path, self.acq_id, m, a, min(n, a + self.step)) for a in range(0, n, self.step)]
        return out

    def read(self, part: Frames) -> Iterator[tuple]:
        import h5py

        with h5py.File(part.path, "r") as f:
            data = f[f"moment{part.moment}"]
            if len(data.shape) > 2:
                time = video_axes(data.shape)[0]
                wanted = tuple(slice(part.first, part.last) if a == time else slice(None) for a in range(len(data.shape)))
            else:
                wanted = (slice(None),) * len(data.shape)
            video = np.asarray(data[wanted])
            if video.ndim > 3:  # a range of one frame keeps its axis
                video = video.reshape([video.shape[a] for a in video_axes(data.shape)])
        video = oriented(video)
        for k, frame in enumerate(video):
            yield part.acq_id, part.moment, part.first + k, frame.shape[0], frame.shape[1], frame.astype(float).ravel().tolist()


class MomentsSource(DataSource):
    """format("moments_h5"): needs h5py where it runs."""

    @classmethod
    def name(cls) -> str:
        return "moments_h5"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return MomentsReader(self.options)


def pixels(frames: DataFrame) -> DataFrame:
    """Rows per pixel from rows per frame (row-major data)."""
    rows = frames.select("acq_id", "moment", "t", "w", F.posexplode("data").alias("k", "v"))
    return rows.select("acq_id", "moment", "t", F.floor(F.col("k") / F.col("w")).cast("int").alias("y"), (F.col("k") % F.col("w")).cast("int").alias("x"), "v")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """The native form: a Parquet table of frames, partitioned by acquisition and moment."""
    return pixels(spark.read.schema(SCHEMA).parquet(path))


def write_frames(frames: DataFrame, path: str) -> None:
    frames.write.mode("overwrite").partitionBy("acq_id", "moment").parquet(path)


def from_arrays(spark: SparkSession, acq_id: str, videos: dict[int, np.ndarray]) -> DataFrame:
    """Frames of in-memory (T, H, W) videos, for tests and small imports."""
    rows = [(acq_id, m, t, f.shape[0], f.shape[1], f.astype(float).ravel().tolist()) for m, v in videos.items() for t, f in enumerate(v)]
    return spark.createDataFrame(rows, SCHEMA)
