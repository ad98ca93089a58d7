"""User and item feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timebin import HOURS_PER_DAY

CAT, SUB = "cat__", "sub__"


def prefixed(prefix: str, values: Sequence[str]) -> list[str]:
    return [prefix + v for v in values]


def positive_counts(interactions: DataFrame, col: str, values: Sequence[str], prefix: str = "") -> DataFrame:
    """Positive interactions per user and value, wide; only users that have one."""
    liked = interactions.where(F.col("score") == 1)
    wide = liked.groupBy("user_id").pivot(col, list(values)).agg(F.count(F.lit(1))).na.fill(0)
    return wide.withColumnsRenamed({v: prefix + v for v in values})


def users_without_positive(interactions: DataFrame) -> DataFrame:
    totals = interactions.groupBy("user_id").agg(F.sum("score").alias("score"))
    return totals.where(F.col("score") == 0)


def taste_counts(interactions: DataFrame) -> DataFrame:
    """(user_id, name, n): positive counts per user and prefixed value, in long form.

    Only positive interactions carry values; the others keep their user by one row without a name, so that
    what is shuffled follows the positive ones. There is no limit on the number of values.
    """
    names = F.array(
        F.concat(F.lit(CAT), F.col("category")), F.concat(F.lit(SUB), F.col("sub_category"))
    )
    liked = F.coalesce(F.col("score") == 1, F.lit(False))
    held = F.explode_outer(F.filter(names, lambda _: liked))
    return interactions.select("user_id", held.alias("name"), liked.cast("int").alias("n"))


def taste_profile(
    interactions: DataFrame, categories: Sequence[str], sub_categories: Sequence[str]
) -> DataFrame:
    """Positive counts per user for categories and sub-categories; zero rows for the others.

    Counts are made per user and value, and only they are turned into columns.
    """
    names = [*prefixed(CAT, categories), *prefixed(SUB, sub_categories)]
    wide = taste_counts(interactions).groupBy("user_id").pivot("name", names).agg(F.sum("n"))
    return wide.na.fill(0, names)


def row_shares(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns divided by their row sum; 0 where the sum is 0."""
    whole = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    return df.withColumns({c: F.coalesce(F.try_divide(F.col(c), whole), F.lit(0.0)) for c in cols})


def median_hours(interactions: DataFrame) -> DataFrame:
    """Exact median hour per user, and the same over 24.

    The buffer holds one counter per distinct hour, so a hot user stays small.
    """
    median = F.median(F.col("time").cast("int"))
    return interactions.groupBy("user_id").agg(median.alias("median_hour")).withColumn(
        "median_time", F.col("median_hour") / HOURS_PER_DAY
    )


def user_features(
    interactions: DataFrame, categories: Sequence[str], sub_categories: Sequence[str]
) -> DataFrame:
    """Category shares, sub-category shares and scaled median hour per user."""
    hours = median_hours(interactions).select("user_id", "median_time")
    raw = taste_profile(interactions, categories, sub_categories).join(hours, "user_id")
    shares = row_shares(raw, prefixed(CAT, categories))
    return row_shares(shares, prefixed(SUB, sub_categories))


def one_hot(df: DataFrame, col: str, values: Sequence[str], prefix: str) -> DataFrame:
    flags = {prefix + v: F.when(F.col(col) == v, 1.0).otherwise(0.0) for v in values}
    return df.withColumns(flags)


def item_features(
    popular: DataFrame, categories: Sequence[str], sub_categories: Sequence[str]
) -> DataFrame:
    """Article text, total popularity and one-hot categories."""
    base = popular.select(
        "news_id", "title", "abstract", "category", "sub_category",
        (F.col("popularity_history") + F.col("popularity_impression")).alias("popularity"),
    )
    flags = one_hot(one_hot(base, "category", categories, CAT), "sub_category", sub_categories, SUB)
    return flags.drop("category", "sub_category")


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """Sorted feature columns that both wide tables have."""
    return sorted(
        c for c in set(left.columns) & set(right.columns) if c.startswith((CAT, SUB))
    )


def aligned(df: DataFrame, keys: Sequence[str], cols: Sequence[str], out: str = "features") -> DataFrame:
    """Key columns and one array of the feature columns in the given order."""
    return df.select(*keys, F.array(*[F.col(c).cast("double") for c in cols]).alias(out))


def cluster_sums(df: DataFrame, cols: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Sum of every feature column per cluster."""
    return df.groupBy(cluster).agg(*[F.sum(c).alias(c) for c in cols])


def with_embedding_columns(df: DataFrame, vectors: DataFrame, key: str, dim: int) -> DataFrame:
    """Embedding components as numbered columns."""
    parts = [
        F.element_at("embedding", i + 1).cast("double").alias(f"reduced_embeddings_{i + 1}")
        for i in range(dim)
    ]
    return df.join(vectors.select(key, *parts), key)


def category_map(interactions: DataFrame, col: str = "category") -> DataFrame:
    """Map of value to positive count per user; as many entries as there are values."""
    counts = (
        interactions.where(F.col("score") == 1).groupBy("user_id", col).agg(F.count("*").alias("n"))
    )
    entries = F.array_sort(F.collect_list(F.struct(F.col(col), F.col("n"))))
    return counts.groupBy("user_id").agg(F.map_from_entries(entries).alias("counts"))


def null_profile(df: DataFrame) -> DataFrame:
    """Missing values per column, one row per column."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return wide.unpivot([], df.columns, "column_name", "missing")
