"""Artifact stores: named DataFrames (written as Parquet) and plain values, with fingerprints."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def frame_fingerprint(df: DataFrame) -> str:
    """Of a DataFrame's schema and rows, whatever their order: one aggregate of a few numbers."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]) if df.columns else F.lit(0)
    again = F.xxhash64(row, F.lit(1))
    r = df.select(row.alias("a"), again.alias("b")).agg(F.count("*"), F.bit_xor("a"), F.bit_xor("b"), F.sum(F.pmod(F.col("b"), F.lit(1 << 31)))).first()
    return hashlib.sha256(json.dumps([df.schema.jsonValue(), [str(x) for x in r]]).encode()).hexdigest()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file of any storage Spark knows; None if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small text file: written beside it, then moved."""
    jvm = spark._jvm
    p, own = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:8]}")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(own, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not fs.rename(own, p):
        fs.delete(p, False)
        fs.rename(own, p)


class Artifacts:
    """Artifacts in a folder of the cluster's storage; a DataFrame that is put is written and read back.

    Names map to folders through ``layout`` ({name: "group/path"}); others go under "other".
    Each put replaces only its own artifact.  The folder's catalogue (catalogue.json: where each
    artifact lies, its schema and fingerprint, and the fingerprints of steps) makes a store
    opened by another process find what this one made.  Without a folder all is held in memory.
    """

    CATALOGUE = "catalogue.json"

    def __init__(self, spark: SparkSession, path: str | None = None, layout: dict[str, str] | None = None):
        self.spark, self.path, self.layout = spark, path, layout or {}
        self.held: dict[str, Any] = {}
        self.prints: dict[str, str] = {}
        self.places: dict[str, dict] = {}
        self.steps: dict[str, str] = {}
        found = read_text(spark, f"{path}/{self.CATALOGUE}") if path else None
        if found:
            made = json.loads(found)
            self.steps = made["steps"]
            for name, a in made["artifacts"].items():
                self.places[name] = a
                if "path" in a:
                    self.held[name] = spark.read.schema(T.StructType.fromJson(a["schema"])).parquet(a["path"])
                else:
                    self.held[name] = a["value"]
                if a.get("print"):
                    self.prints[name] = a["print"]

    def has(self, name: str) -> bool:
        return name in self.held

    def get(self, name: str) -> Any:
        if name not in self.held:
            raise RuntimeError(f"{name} has not been made")
        return self.held[name]

    def put(self, name: str, value: Any) -> None:
        before = self.places.pop(name, {}).get("path")
        if isinstance(value, DataFrame) and self.path:
            # a new folder each time: the value may read the one before
            where = f"{self.path}/{self.layout.get(name, f'other/{name}')}/{uuid.uuid4().hex[:12]}"
            value.write.parquet(where)
            self.places[name] = {"path": where, "schema": value.schema.jsonValue()}
            value = self.spark.read.schema(value.schema).parquet(where)
        elif self.path:
            try:
                json.dumps(value)
                self.places[name] = {"value": value}
            except TypeError:  # no value for a catalogue: this process has it, another makes it again
                pass
        self.held[name] = value
        self.prints.pop(name, None)
        self.save()
        if before:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(before)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def save(self) -> None:
        """Write the catalogue."""
        if self.path:
            made = {n: {**a, "print": self.prints.get(n)} for n, a in self.places.items()}
            write_text(self.spark, f"{self.path}/{self.CATALOGUE}", json.dumps({"artifacts": made, "steps": self.steps}))

    def done(self, step: str, fingerprint: str) -> None:
        """Remember a step's fingerprint."""
        self.steps[step] = fingerprint
        self.save()

    def keep(self, df: DataFrame) -> DataFrame:
        """A step's intermediate table, written where the store has a folder: later plans start from it."""
        if not self.path:
            return df
        where = f"{self.path}/scratch/{uuid.uuid4().hex}"
        df.write.parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def tidy(self) -> None:
        """Delete intermediate tables; artifacts stay."""
        if self.path:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/scratch")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def print_of(self, name: str) -> str:
        if name not in self.prints:
            v = self.held.get(name)
            self.prints[name] = frame_fingerprint(v) if isinstance(v, DataFrame) else hashlib.sha256(json.dumps(v, sort_keys=True, default=str).encode()).hexdigest()
        return self.prints[name]

    def fingerprint(self, settings: dict[str, Any], names: Iterable[str]) -> str:
        """Of a step's settings and inputs."""
        parts = {"config": settings, "inputs": {n: self.print_of(n) for n in names}}
        return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()

    def clear(self) -> None:
        """Forget everything, the catalogue too; files stay until their artifact is put again."""
        for d in (self.held, self.prints, self.places, self.steps):
            d.clear()
        self.save()

    def all(self) -> dict[str, Any]:
        return dict(self.held)
