"""Train and test splits."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import hash_uniform
from ..session import one_row

_PREFIX = 5  # hex digits; about a million even buckets


def _digest(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def split_counts(df: DataFrame, key: str, train: int, test: int, seed: int = 42) -> DataFrame:
    """First ``train`` rows of a seeded shuffle and the ``test`` rows after them, tagged in ``part``.

    The shuffle order is that of a hash; keys must be unique. One pass counts rows per hash prefix,
    which tells the buckets that the two cuts fall in. Rows of all other buckets are tagged by their
    prefix alone; only the two cut buckets are sorted.
    """
    marked = df.withColumn("_d", _digest(F.col(key), seed)).withColumn("_b", F.substring("_d", 1, _PREFIX))
    sizes = marked.groupBy("_b").agg(F.count("*").alias("_n"))
    # A million rows at most, whatever the size of the table.
    before = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    spans = sizes.withColumn("_lo", F.coalesce(before, F.lit(0)))
    span = F.struct("_b", "_lo")
    cuts = one_row(spans, *[
        F.min(F.when(F.col("_lo") + F.col("_n") > at, span)).alias(name)
        for name, at in (("train", train), ("test", train + test))
    ])
    bucket, one, two = F.col("_b"), cuts["train"], cuts["test"]
    at_cut = F.coalesce((bucket == one["_b"]) | (bucket == two["_b"]), bucket == one["_b"], F.lit(False))
    tag = F.when(one.isNull() | (bucket < one["_b"]), "train").when(
        two.isNull() | (bucket < two["_b"]), "test"
    )
    inside = marked.where(~at_cut).withColumn("part", tag).where("part is not null")
    start = F.when(bucket == one["_b"], one["_lo"]).otherwise(two["_lo"])
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_d", key))
    edge = marked.where(at_cut).withColumn("_p", place).withColumn("_p", F.col("_p") + start)
    edge = edge.where(F.col("_p") <= train + test).withColumn(
        "part", F.when(F.col("_p") <= train, "train").otherwise("test")
    )
    kept = [*df.columns, "part"]
    return inside.select(*kept).unionByName(edge.select(*kept))


def shuffled_take(df: DataFrame, key: str, n: int, skip: int = 0, seed: int = 42) -> DataFrame:
    """Rows ``skip`` to ``skip + n`` of the same shuffle."""
    return split_counts(df, key, skip, n, seed).where("part = 'test'").select(*df.columns)


def split_share(df: DataFrame, key: str, test_share: float, seed: int = 42) -> DataFrame:
    """Every row tagged train or test by a hash of its key."""
    draw = hash_uniform(F.col(key), F.lit(seed))
    return df.withColumn("part", F.when(draw < test_share, "test").otherwise("train"))


def split_time(df: DataFrame, time: str, at: str | datetime) -> DataFrame:
    """Rows before ``at`` train, the others test."""
    edge = F.lit(at).cast("timestamp_ntz")
    return df.withColumn("part", F.when(F.col(time) < edge, "train").otherwise("test"))
