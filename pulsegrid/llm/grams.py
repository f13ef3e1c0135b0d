"""Word and hashed n-gram columns from DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what separates words.
SPACES = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: a lambda's argument isn't copied into its body."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of a text; none for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    # a trimmed text has empty parts only if it is empty itself
    return F.array_remove(F.split(inner, SPACES, -1), "")


def buckets_of(ws: Column, buckets: int) -> Column:
    """The bucket of each word."""
    return F.transform(ws, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


def hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def unigrams(wh: Column, buckets: int) -> Column:
    return F.transform(wh, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def bigrams(wh: Column, buckets: int) -> Column:
    """Buckets of pairs of adjacent words."""
    return F.when(F.size(wh) > 1, F.transform(F.slice(wh, F.lit(2), F.greatest(F.size(wh) - 1, F.lit(0))), lambda h, i: F.pmod(F.xxhash64(F.get(wh, i), h), F.lit(buckets)).cast("int"))).otherwise(F.array().cast("array<int>"))


def total(buckets: Column, weights: Column) -> Column:
    """Sum of the weights of buckets."""
    return F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.get(weights, b))


def as_row(weights: DataFrame, bucket: str, columns: list[str], buckets: int, missing: dict) -> DataFrame:
    """One row with an array (by bucket) for each weight column: its size is fixed by ``buckets``."""
    spark = weights.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias(bucket)).join(weights, bucket, "left")
    picked = F.sort_array(F.collect_list(F.struct(F.col(bucket), *[F.coalesce(F.col(c), missing[c]).cast("float").alias(c) for c in columns])))
    # a field of an array of structs is the array of that field
    return every.agg(picked.alias("all")).select(F.lit(0).alias("one"), *[F.col("all")[c].alias(c) for c in columns])


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Attach the single row to every row: a broadcast equi-join on a constant key."""
    return df.withColumn("one", F.lit(0)).join(F.broadcast(row), "one").drop("one")


def once(df: DataFrame, *columns) -> DataFrame:
    """Select columns so that later filters and projections use their values.

    Catalyst copies an expression into every filter or lambda that refers to it, however dear;
    it copies nothing out of a projection that also numbers its rows.
    """
    return df.select(*columns, F.monotonically_increasing_id().alias("_once")).where("_once >= 0").drop("_once")


def exploded(df: DataFrame, array: Column, name: str, *others) -> DataFrame:
    """A row for each item; explode() itself would compute the array once more, to filter by its size."""
    return df.select(*others, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())
