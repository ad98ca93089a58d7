"""Popularity over the hours of the day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timebin import end_hour, hour_labels
from .interactions import clicks, first_row, history_items


def with_hour(df: DataFrame, time: str = "time") -> DataFrame:
    return df.withColumn("hour", end_hour(F.col(time)))


def hourly_counts(items: DataFrame, news: DataFrame) -> DataFrame:
    """Articles seen per hour and category, from (time, news_id) rows."""
    per_article = with_hour(items).groupBy("hour", "news_id").agg(F.count("*").alias("n"))
    joined = per_article.join(news.select("news_id", "category"), "news_id")
    return joined.groupBy("hour", "category").agg(F.sum("n").alias("n"))


def on_all_hours(counts: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Every hour with every category; 0 where nothing happened."""
    names = F.explode(F.array(*[F.lit(c) for c in categories])).alias("category")
    spine = hour_labels(counts.sparkSession).select("hour", names)
    return spine.join(counts, ["hour", "category"], "left").na.fill(0, ["n"])


def hourly_shares(counts: DataFrame) -> DataFrame:
    """Share of each category in its hour; null for an hour without any."""
    whole = F.sum("n").over(Window.partitionBy("hour"))
    return counts.withColumn("share", F.try_divide("n", whole))


def hourly_long(
    behaviors: DataFrame, news: DataFrame, categories: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Hourly category shares of clicks and of histories (first log row of each user)."""
    clicked = clicks(behaviors, ["time"])
    past = history_items(first_row(behaviors, "user_id", "impression_id"), ["time"]).drop("pos")
    return tuple(
        hourly_shares(on_all_hours(hourly_counts(items, news), categories))
        for items in (clicked, past)
    )


def hourly_wide(shares: DataFrame, categories: Sequence[str], suffix: str) -> DataFrame:
    """One row per hour, one share column per category."""
    wide = shares.groupBy("hour").pivot("category", list(categories)).agg(F.max("share"))
    return wide.withColumnsRenamed({c: f"{c}{suffix}" for c in categories})


def chart_rows(wide: DataFrame, suffix: str) -> DataFrame:
    """(hour, variable, type, value) rows of a wide hourly table."""
    cols = [c for c in wide.columns if c.endswith(suffix)]
    long = wide.unpivot("hour", cols, "name", "value")
    return long.select(
        "hour",
        F.split_part("name", F.lit("_"), F.lit(1)).alias("variable"),
        F.split_part("name", F.lit("_"), F.lit(2)).alias("type"),
        "value",
    )
