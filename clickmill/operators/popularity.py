"""Article and category popularity from clicks and histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clicked_articles, split_tokens
from .interactions import clicks, first_history, history_items

KINDS = ("history", "impressions")


def count_per_article(items: DataFrame, name: str) -> DataFrame:
    return items.groupBy("news_id").agg(F.count("*").alias(name))


def zero_filled(spine: DataFrame, counts: DataFrame, key: str, name: str) -> DataFrame:
    """Every row of the spine, with 0 where nothing was counted."""
    joined = spine.select(key).join(counts, key, "left")
    return joined.withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))


def article_clicks(behaviors: DataFrame, news: DataFrame) -> DataFrame:
    """Clicks per catalogue article."""
    counts = count_per_article(clicks(behaviors), "popularity_impression")
    return zero_filled(news, counts, "news_id", "popularity_impression")


def article_history(behaviors: DataFrame, news: DataFrame) -> DataFrame:
    """History occurrences per catalogue article, each user's history counted once."""
    items = history_items(first_history(behaviors))
    counts = count_per_article(items, "popularity_history")
    return zero_filled(news, counts, "news_id", "popularity_history")


def article_popularity(behaviors: DataFrame, news: DataFrame) -> DataFrame:
    """Catalogue with both counts.

    Tokens of both kinds are counted in one aggregate before they meet the catalogue, so a hot
    article reaches the join as a single row.
    """
    kinds = clicks(behaviors).withColumn("kind", F.lit("impressions")).unionByName(
        history_items(first_history(behaviors)).select("news_id", F.lit("history").alias("kind"))
    )
    counts = kinds.groupBy("news_id").agg(
        F.count_if(F.col("kind") == "impressions").alias("popularity_impression"),
        F.count_if(F.col("kind") == "history").alias("popularity_history"),
    )
    names = ["popularity_impression", "popularity_history"]
    return news.join(counts, "news_id", "left").na.fill(0, names)


def merged_popularity(clicked: DataFrame, past: DataFrame, news: DataFrame) -> DataFrame:
    """Two per-article tables joined with each other and onto the catalogue."""
    return news.join(clicked.join(past, "news_id"), "news_id")


def category_popularity(popular: DataFrame, by: str = "category") -> DataFrame:
    """Both counts per category, from the per-article counts."""
    return popular.groupBy(by).agg(
        F.sum("popularity_impression").alias("popularity_impression"),
        F.sum("popularity_history").alias("popularity_history"),
    )


def category_long(popular: DataFrame) -> DataFrame:
    """(popularity_type, category, popularity), one row per kind and category."""
    totals = category_popularity(popular)
    return totals.select(
        "category",
        F.explode(
            F.array(
                F.struct(F.lit("impressions").alias("k"), F.col("popularity_impression").alias("n")),
                F.struct(F.lit("history").alias("k"), F.col("popularity_history").alias("n")),
            )
        ).alias("p"),
    ).select(F.col("p.k").alias("popularity_type"), "category", F.col("p.n").alias("popularity"))


def category_wide(popular: DataFrame, categories: Sequence[str]) -> DataFrame:
    """One row per kind, one column per category."""
    wide = category_long(popular).groupBy("popularity_type").pivot("category", list(categories))
    return wide.agg(F.sum("popularity")).na.fill(0)


def category_wide_by_union(popular: DataFrame, categories: Sequence[str]) -> DataFrame:
    """The same table as a union of two tagged one-row tables."""

    def tagged(kind: str, value: str) -> DataFrame:
        return popular.agg(
            *[F.coalesce(F.sum(F.when(F.col("category") == c, F.col(value))), F.lit(0)).alias(c)
              for c in categories]
        ).select(F.lit(kind).alias("popularity_type"), *categories)

    return tagged("impressions", "popularity_impression").unionByName(
        tagged("history", "popularity_history")
    )


def _tagged_tokens() -> Column:
    def tag(kind: str, ids: Column) -> Column:
        return F.transform(ids, lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("news_id")))

    empty = F.array().cast("array<struct<kind:string,news_id:string>>")
    return F.concat(
        F.coalesce(tag("history", split_tokens("history")), empty),
        F.coalesce(tag("impression", clicked_articles("impressions")), empty),
    )


def interaction_counts_long(
    behaviors: DataFrame, news: DataFrame, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per token of either kind with its category: (kept columns, kind, category)."""
    tokens = behaviors.select(*keep, F.explode(_tagged_tokens()).alias("t")).select(
        *keep, "t.kind", "t.news_id"
    )
    return tokens.join(news.select("news_id", "category"), "news_id").drop("news_id")


def interaction_counts(
    behaviors: DataFrame, news: DataFrame, categories: Sequence[str]
) -> DataFrame:
    """Log rows with one history and one click counter per category."""
    tokens = interaction_counts_long(behaviors, news, ["impression_id"])
    names = [f"{c}_{kind}" for kind in ("history", "impression") for c in categories]
    # Counted per row and name first; only those counts become columns.
    named = tokens.select("impression_id", F.concat_ws("_", "category", "kind").alias("name"))
    counts = named.groupBy("impression_id").pivot("name", names).agg(F.count(F.lit(1)))
    return behaviors.join(counts, "impression_id", "left").na.fill(0, names)
