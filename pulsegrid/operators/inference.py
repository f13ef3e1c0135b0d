"""Model inputs, activations and inference over images (one row each)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays

EPSILON = 1e-8


def uint8(x: Column) -> Column:
    """Min-max times 255, cut to whole numbers (as doubles)."""
    return arrays.let(F.struct(F.array_min(x).alias("a"), F.array_max(x).alias("b")), lambda p: F.transform(x, lambda v: F.floor((v - p["a"]) / (p["b"] - p["a"] + EPSILON) * 255).cast("double")))


def channel_norm(x: Column, kind: str) -> Column:
    """zscore, minmax, rescale (/255) or none (only made uint8) of one channel's pixels."""
    if kind == "zscore":
        return arrays.let(F.struct(arrays.mean(x).alias("m"), arrays.std(x).alias("s")), lambda p: F.transform(x, lambda v: (v - p["m"]) / (p["s"] + EPSILON)))
    if kind == "minmax":
        return arrays.let(F.struct(F.array_min(x).alias("a"), F.array_max(x).alias("b")), lambda p: F.transform(x, lambda v: (v - p["a"]) / (p["b"] - p["a"] + EPSILON)))
    if kind == "rescale":
        return F.transform(x, lambda v: v / 255.0)
    if kind == "none":
        return uint8(x)
    raise ValueError(f"unknown normalisation {kind!r}")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(x: Column) -> Column:
    """Of an array of class scores, shifted by its largest."""
    return arrays.let(F.transform(x, lambda v: F.exp(v - F.array_max(x))), lambda e: arrays.let(arrays.total(e), lambda s: F.transform(e, lambda v: v / s)))


def argmax(x: Column) -> Column:
    """The class of the largest score; the lowest of equals."""
    return F.array_position(x, F.array_max(x)).cast("int") - 1


class Backend:
    """Loads a model file once in each Python worker; predict takes (C, H, W) arrays."""

    def __init__(self, path: str):
        self.path = path

    def predict(self, image: np.ndarray) -> np.ndarray:
        raise NotImplementedError


class OnnxBackend(Backend):
    """On a GPU where the runtime has one; a single (H, W) image stands for every channel."""

    def __init__(self, path: str):
        import onnxruntime

        super().__init__(path)
        wanted = [p for p in ("CUDAExecutionProvider", "CPUExecutionProvider") if p in onnxruntime.get_available_providers()]
        self.session = onnxruntime.InferenceSession(path, providers=wanted)
        self.input = self.session.get_inputs()[0]

    def predict(self, image: np.ndarray) -> np.ndarray:
        if image.ndim == 2:
            channels = self.input.shape[1]
            image = np.repeat(image[None], channels if isinstance(channels, int) else 1, 0)
        # sizes that the model leaves open are names, not numbers
        if any(isinstance(want, int) and want != got for want, got in zip(self.input.shape[1:], image.shape, strict=True)):
            raise ValueError(f"the model takes (C, H, W) = {tuple(self.input.shape[1:])}, not {image.shape}")
        return self.session.run(None, {self.input.name: image[None].astype(np.float32)})[0]


class TorchBackend(Backend):
    def __init__(self, path: str):
        import torch  # optional

        super().__init__(path)
        self.torch = torch
        self.device = "cuda" if torch.cuda.is_available() else "cpu"
        self.model = torch.jit.load(path, map_location=self.device).eval()

    def predict(self, image: np.ndarray) -> np.ndarray:
        with self.torch.no_grad():
            return self.model(self.torch.from_numpy(image[None].astype(np.float32)).to(self.device)).cpu().numpy()


BACKENDS: dict[str, type[Backend]] = {"onnx": OnnxBackend, "pt": TorchBackend}
_loaded: dict = {}


#: What is done to a model's output (axis 1: classes) and to each of its input channels, by the names in model files.
ACTIVATIONS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "argmax": lambda y: y.argmax(1),
    "none": lambda y: y,
    "sigmoid": lambda y: 1 / (1 + np.exp(-y)),
    "softmax": lambda y: (lambda e: e / e.sum(1, keepdims=True))(np.exp(y - y.max(1, keepdims=True))),
}
NORMS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "minmax": lambda c: (c - c.min()) / (np.ptp(c) + EPSILON),
    "none": lambda c: np.floor((c - c.min()) / (np.ptp(c) + EPSILON) * 255),
    "rescale": lambda c: c / 255.0,
    "zscore": lambda c: (c - c.mean()) / (c.std() + EPSILON),
}


def infer(images: DataFrame, spec, path: str, make: Callable[[str], Backend] | None = None) -> DataFrame:
    """Run a model over rows (acq_id, h, w, channels ARRAY<ARRAY<DOUBLE>>): acq_id, shape, data.

    Rows go through in Arrow batches; each worker loads the model once.
    """
    make = make or BACKENDS[spec.format]
    norm, activation = NORMS[spec.input_norm], ACTIVATIONS[spec.output_activation]

    def run(batches):
        import pandas as pd

        model = _loaded.get(path) or _loaded.setdefault(path, make(path))
        for frame in batches:
            out = []
            for r in frame.itertuples():
                x = np.stack([norm(np.asarray(c, float).reshape(r.h, r.w)) for c in r.channels])
                y = activation(np.asarray(model.predict(x)))
                out.append((r.acq_id, list(y.shape), y.ravel().astype(float)))
            yield pd.DataFrame(out, columns=["acq_id", "shape", "data"])

    return images.select("acq_id", "h", "w", "channels").mapInPandas(run, "acq_id string, shape array<int>, data array<double>")


def channels(images: dict[str, DataFrame], names: list[str], rows: int, columns: int) -> DataFrame:
    """(acq_id, h, w, channels) from images (acq_id, y, x, v): an array for each named one, missing pixels 0."""
    every = [images[n].select("acq_id", F.lit(i).alias("c"), "y", "x", F.col("v").cast("double").alias("v")) for i, n in enumerate(names)]
    long = every[0]
    for e in every[1:]:
        long = long.unionByName(e)

    def run(frame):
        import pandas as pd

        # the few images of one acquisition are one bounded group
        out = np.zeros((len(names), rows, columns))
        out[frame["c"], frame["y"], frame["x"]] = frame["v"].fillna(0.0)
        return pd.DataFrame({"acq_id": frame["acq_id"].iloc[:1], "h": rows, "w": columns, "channels": [list(out.reshape(len(names), -1))]})

    return long.groupBy("acq_id").applyInPandas(run, "acq_id string, h int, w int, channels array<array<double>>")


def boxes(output: DataFrame) -> DataFrame:
    """Detections (acq_id, box_id, x, y, dx, dy, conf) of outputs with shape (1, 5 or more, N): rows are x, y, dx, dy, confidence."""
    n = F.element_at("shape", -1)
    every = output.select("acq_id", "data", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("box_id"))
    return every.select("acq_id", "box_id", *[F.get("data", F.col("n") * k + F.col("box_id")).alias(c) for k, c in enumerate(("x", "y", "dx", "dy", "conf"))])


def pixels(output: DataFrame, rows: int, columns: int, channel: int = 0) -> DataFrame:
    """(acq_id, y, x, v) of one channel of outputs whose last two axes are an image."""
    part = F.slice("data", F.lit(channel * rows * columns + 1), F.lit(rows * columns))
    flat = output.select("acq_id", F.posexplode(part).alias("k", "v"))
    return flat.select("acq_id", F.floor(F.col("k") / columns).cast("int").alias("y"), (F.col("k") % columns).cast("int").alias("x"), "v")
