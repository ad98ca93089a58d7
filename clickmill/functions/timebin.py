"""Hour bins of one observed day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The binned day.
DAY_START = "2019-11-15 00:00:00"
DAY_END = "2019-11-16 00:00:00"
HOURS_PER_DAY = 24
RAW_TIME_FORMAT = "M/d/yyyy h:mm:ss a"


def _edge(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def bin_end(ts: Column, lo: str = DAY_START, hi: str = DAY_END) -> Column:
    """End of the right-closed hour bin that holds ``ts``; the first bin also holds its start.

    Null outside the day.
    """
    hour = F.expr("INTERVAL '1' HOUR")
    tick = F.expr("INTERVAL '0.000001' SECOND")
    end = F.when(ts == _edge(lo), ts + hour).otherwise(
        F.date_trunc("hour", ts - tick).cast("timestamp_ntz") + hour
    )
    return F.when(ts.between(_edge(lo), _edge(hi)), end)


def end_hour(ts: Column, lo: str = DAY_START, hi: str = DAY_END) -> Column:
    """Two-digit label of the bin's end hour (``00`` closes the day)."""
    return F.date_format(bin_end(ts, lo, hi), "HH")


def parse_time(col: Column | str) -> Column:
    """Raw log time, e.g. ``11/15/2019 9:05:58 AM``; null when malformed."""
    form = F.lit(RAW_TIME_FORMAT)
    return F.when(F.try_to_timestamp(col, form).isNotNull(), F.to_timestamp_ntz(col, form))


def hour_spine(spark: SparkSession, lo: str = DAY_START, hi: str = DAY_END) -> DataFrame:
    """Every hour edge from ``lo`` to ``hi``, both included."""
    edges = F.sequence(_edge(lo), _edge(hi), F.expr("INTERVAL '1' HOUR"))
    return spark.range(1).select(F.explode(edges).alias("edge"))


def hour_labels(spark: SparkSession) -> DataFrame:
    """The 24 labels, one row each."""
    return spark.range(HOURS_PER_DAY).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("hour"))
