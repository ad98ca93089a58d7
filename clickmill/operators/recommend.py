"""Hybrid recommendations for all users in one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..session import materialize
from .factorize import predicted
from .knn import nearest
from .ranking import top_n_per_group

# Neighbours looked up (the query itself included), items taken from each similar
# user, the floor added to user preferences, the boost added to a weighted user column, and the
# number of members shown of a cluster.
NEIGHBORS = 5
ITEMS_PER_SIMILAR_USER = 5
PREFERENCE_FLOOR = 0.0001
USER_BOOST = 0.5
CLUSTER_SAMPLE = 4


def similar(vectors: DataFrame, key: str, k: int = NEIGHBORS) -> DataFrame:
    """The k - 1 nearest others of every row of (key, features): (key, other)."""
    pairs = vectors.select(F.col(key).alias("id"), F.col("features").alias("vector"))
    found = nearest(pairs, pairs, k - 1, "euclidean", exclude_self=True)
    return found.select(F.col("id").alias(key), F.col("neighbor").alias("other"), "score", "rank")


def best_seen(seen: DataFrame, rows: DataFrame, cols: DataFrame, n: int = ITEMS_PER_SIMILAR_USER) -> DataFrame:
    """Each user's n seen items with the highest predicted rating."""
    rated = predicted(seen, rows, cols)
    rated = rated.withColumn("predicted", F.round("predicted", 9))
    return top_n_per_group(rated, ["user_id"], [F.desc("predicted"), F.col("item")], n)


def collaborative_candidates(
    similar_users: DataFrame, seen: DataFrame, rows: DataFrame, cols: DataFrame
) -> DataFrame:
    """Best seen items of similar users: distinct (user_id, item)."""
    best = best_seen(seen, rows, cols).select(F.col("user_id").alias("other"), "item")
    return similar_users.select("user_id", "other").join(best, "other").select(
        "user_id", "item"
    ).distinct()


def content_candidates(seen: DataFrame, similar_items: DataFrame) -> DataFrame:
    """Items similar to a seen one: distinct (user_id, item)."""
    near = similar_items.select("item", F.col("other").alias("near"))
    return seen.join(near, "item").select("user_id", F.col("near").alias("item")).distinct()


def all_candidates(collaborative: DataFrame, content: DataFrame) -> DataFrame:
    return collaborative.unionByName(content).distinct()


def without_seen(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Plain anti join."""
    return candidates.join(seen, ["user_id", "item"], "left_anti")


def recommendable(
    candidates: DataFrame, seen: DataFrame, users: DataFrame, fallback: Sequence | None = None
) -> DataFrame:
    """Candidates without the seen ones.

    A user who has seen all candidates keeps them all; a user with neither candidates nor seen
    items gets the fallback list.
    """
    marked = candidates.join(seen.withColumn("was_seen", F.lit(True)), ["user_id", "item"], "left")
    fresh = marked.groupBy("user_id").agg(
        F.max(F.col("was_seen").isNull()).alias("any_fresh")
    )
    kept = marked.join(fresh, "user_id").where(F.col("was_seen").isNull() | ~F.col("any_fresh"))
    kept = kept.select("user_id", "item")
    if not fallback:
        return kept
    idle = users.select("user_id").join(candidates, "user_id", "left_anti").join(
        seen, "user_id", "left_anti"
    )
    items = F.array(*[F.lit(i) for i in fallback]).cast(f"array<{kept.schema['item'].dataType.simpleString()}>")
    return kept.unionByName(idle.select("user_id", F.explode(items).alias("item")))


def most_popular(coo: DataFrame, n: int) -> list:
    """The n items with the highest total rating; the default list for users without any signal."""
    totals = coo.groupBy("col_id").agg(F.sum("rating").alias("r"))
    return [r["col_id"] for r in totals.orderBy(F.desc("r"), "col_id").limit(n).collect()]


def _adjusted(features: Column, cols: Sequence[str], change: Mapping[str, float], op) -> Column:
    if not change:
        return features
    cells = [
        op(F.element_at(features, i + 1), change[c]) if c in change else F.element_at(features, i + 1)
        for i, c in enumerate(cols)
    ]
    return F.array(*cells)


def boosted_items(items: DataFrame, cols: Sequence[str], scales: Mapping[str, float]) -> DataFrame:
    """Item columns of the weighted categories times their scale."""
    return items.withColumn("features", _adjusted(F.col("features"), cols, scales, lambda x, s: x * s))


def boosted_users(users: DataFrame, cols: Sequence[str], scales: Mapping[str, float]) -> DataFrame:
    """User columns of the weighted categories plus a constant."""
    return users.withColumn(
        "features", _adjusted(F.col("features"), cols, scales, lambda x, _: x + USER_BOOST)
    )


def preference_weights(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Product of (user features + floor) with the item features, per (user_id, item)."""
    u = users.select("user_id", F.transform("features", lambda x: x + PREFERENCE_FLOOR).alias("_fu"))
    v = items.select("item", F.col("features").alias("_fi"))
    joined = pairs.join(v, "item").join(u, "user_id")
    return joined.withColumn("weight", dot(F.col("_fu"), F.col("_fi"))).drop("_fu", "_fi")


def hybrid_candidates(
    users: DataFrame,
    items: DataFrame,
    seen: DataFrame,
    row_factors: DataFrame,
    col_factors: DataFrame,
    fallback: Sequence | None = None,
) -> DataFrame:
    """Recommendable (user_id, item) pairs from similar users and similar items; stored."""
    collaborative = collaborative_candidates(
        similar(users, "user_id"), seen, row_factors, col_factors
    )
    content = content_candidates(seen, similar(items, "item"))
    found = materialize(all_candidates(collaborative, content), "candidates")
    return materialize(recommendable(found, seen, users, fallback), "recommendable")


def ranked(
    allowed: DataFrame,
    users: DataFrame,
    items: DataFrame,
    cols: Sequence[str],
    row_factors: DataFrame,
    col_factors: DataFrame,
    n: int = 5,
    scales: Mapping[str, float] | None = None,
) -> DataFrame:
    """Top n allowed items per user by preference weight times predicted rating.

    ``scales`` boosts item columns and their user columns; it does not change the candidates, so
    several rankings can share them.
    """
    scales = scales or {}
    weighted = preference_weights(
        allowed, boosted_users(users, cols, scales), boosted_items(items, cols, scales)
    )
    scored = predicted(weighted, row_factors, col_factors).select(
        "user_id", "item", F.round(F.col("weight") * F.col("predicted"), 9).alias("score")
    )
    best = top_n_per_group(scored, ["user_id"], [F.desc("score"), F.col("item")], n, "rank")
    return best.withColumn("rank", F.col("rank").cast("bigint"))


def recommend(
    users: DataFrame,
    items: DataFrame,
    cols: Sequence[str],
    seen: DataFrame,
    row_factors: DataFrame,
    col_factors: DataFrame,
    n: int = 5,
    scales: Mapping[str, float] | None = None,
    fallback: Sequence | None = None,
) -> DataFrame:
    """Candidates and ranking in one: (user_id, item, score, rank).

    ``users`` is (user_id, features), ``items`` is (item, features), both over ``cols``.
    """
    allowed = hybrid_candidates(users, items, seen, row_factors, col_factors, fallback)
    return ranked(allowed, users, items, cols, row_factors, col_factors, n, scales)


def top_predicted(row_factors: DataFrame, col_factors: DataFrame, n: int) -> DataFrame:
    """Simple recommender: the n highest predicted ratings of every row."""
    queries = row_factors.select(F.col("row_id").alias("id"), F.col("factors").alias("vector"))
    items = col_factors.select(F.col("col_id").alias("id"), F.col("factors").alias("vector"))
    return nearest(queries, items, n, "dot").select(
        F.col("id").alias("user_id"), F.col("neighbor").alias("item"),
        F.col("score").alias("predicted"), "rank",
    )


def cluster_members(labels: DataFrame, n: int = CLUSTER_SAMPLE) -> DataFrame:
    """First n articles of every cluster by id."""
    return top_n_per_group(labels, ["cluster"], [F.col("news_id")], n)


def recommended_categories(
    recommendations: Mapping[str, DataFrame], members: DataFrame, news: DataFrame
) -> DataFrame:
    """How often each category is recommended per mode: (mode, category, value).

    Every recommended cluster stands for its sample members.
    """
    # Recommendations are counted per cluster before the members come in.
    per_cluster = None
    for mode, recs in recommendations.items():
        part = recs.groupBy(F.col("item").alias("cluster")).agg(F.count("*").alias("n")).select(
            F.lit(mode).alias("mode"), "cluster", "n"
        )
        per_cluster = part if per_cluster is None else per_cluster.unionByName(part)
    shown = members.select("news_id", "cluster").join(news.select("news_id", "category"), "news_id")
    return per_cluster.join(shown, "cluster").groupBy("mode", "category").agg(
        F.sum("n").alias("value")
    )
