"""Linear operators as relations (long form) or arrays (one row per signal)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays

#: Coefficients smaller than this are dropped; a relation of more entries than this isn't broadcast.
TINY, MOST_BROADCAST = 1e-17, 4_000_000


def relation(spark, matrix: np.ndarray) -> DataFrame:
    """The non-zero coefficients (o, i, w) of a matrix; raises beyond the broadcast bound."""
    o, i = np.nonzero(np.abs(matrix) > TINY)
    if len(o) > MOST_BROADCAST:
        raise ValueError(f"{len(o)} coefficients are too many for a relation; use apply_arrays")
    return spark.createDataFrame([(int(a), int(b), float(matrix[a, b])) for a, b in zip(o, i, strict=True)], "o int, i int, w double")


def apply_relation(df: DataFrame, matrix: np.ndarray, keys: list[str], index: str = "t", value: str = "v") -> DataFrame:
    """sum_i w(o, i) * v(i) for each key and o, from long form: a broadcast join and one aggregate."""
    coefficients = F.broadcast(relation(df.sparkSession, matrix))
    joined = df.join(coefficients, df[index] == coefficients["i"])
    return joined.groupBy(*keys, F.col("o").alias(index)).agg(F.sum(F.col(value) * F.col("w")).alias(value))


def apply_arrays(df: DataFrame, matrix: np.ndarray, column: str) -> DataFrame:
    """The same on one array per row: no shuffle."""
    return df.withColumn(column, arrays.linear(F.col(column), matrix))
