"""Rating lists and sparse rating matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import group_row_number


def rating_rows(interactions: DataFrame, order_by: Sequence[Column | str]) -> DataFrame:
    """Each user's articles and scores in order, in long form: (user_id, position, news_id, score).

    The shape is the same whatever a user's number of rows, and one user's rows may span many tasks.
    """
    placed = group_row_number(interactions, ["user_id"], order_by, "_pos")
    return placed.select("user_id", (F.col("_pos") - 1).alias("position"), "news_id", "score")


def rating_lists(rows: DataFrame) -> DataFrame:
    """Aligned lists (user_id, news_id, scores) of ``rating_rows``, for users that fit a row."""
    entry = F.struct("position", "news_id", "score")
    lists = rows.groupBy("user_id").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return lists.select(
        "user_id",
        F.transform("e", lambda x: x["news_id"]).alias("news_id"),
        F.transform("e", lambda x: x["score"]).alias("scores"),
    )


def _positive_pairs(interactions: DataFrame) -> DataFrame:
    """Non-zero ratings counted per user and article, before any join."""
    return (
        interactions.where(F.col("score") != 0)
        .groupBy("user_id", "news_id")
        .agg(F.count("*").alias("n"))
    )


def user_by_item_cluster(interactions: DataFrame, item_clusters: DataFrame) -> DataFrame:
    """(row_id = user, col_id = item cluster, rating); an absent cell is unobserved."""
    pairs = _positive_pairs(interactions).join(item_clusters, "news_id")
    return pairs.groupBy(F.col("user_id").alias("row_id"), F.col("cluster").alias("col_id")).agg(
        F.sum("n").alias("rating")
    )


def user_cluster_by_item(interactions: DataFrame, user_clusters: DataFrame) -> DataFrame:
    """(row_id = user cluster, col_id = article, rating)."""
    pairs = _positive_pairs(interactions).join(user_clusters, "user_id")
    return pairs.groupBy(F.col("cluster").alias("row_id"), F.col("news_id").alias("col_id")).agg(
        F.sum("n").alias("rating")
    )


def index_sets(coo: DataFrame, key: str, member: str) -> DataFrame:
    """The members observed with each key, in order: (key, position, member), in long form."""
    pairs = coo.select(key, member).distinct()
    placed = group_row_number(pairs, [key], [member], "_pos")
    return placed.select(key, (F.col("_pos") - 1).alias("position"), member)


def seen_pairs(coo: DataFrame) -> DataFrame:
    """Observed (user, item) cells."""
    return coo.select(F.col("row_id").alias("user_id"), F.col("col_id").alias("item"))


def matrix_ids(coo: DataFrame, col: str) -> DataFrame:
    return coo.select(col).distinct()

