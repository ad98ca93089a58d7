"""Neighbours, hybrid recommendations and retrieval.

Most queries rank with the hash-seeded start factors, so that the ranking logic can be checked in SQL
without an iterative fit; ``rec_5_fitted_top_n`` fits first.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import knn, ratings, retrieval
from ..operators import recommend as rc
from ..operators.factorize import factorize, predicted, start_factors
from ..session import materialize
from . import profiles
from .factors import K, fitted_sql, item_side, start, start_sql
from .fixtures import Tables, sql
from .registry import query

SIMILAR_SQL = {
    "sim_users": """SELECT a.user_id, b.user_id AS other, round(list_distance(a.features, b.features), 9) AS score
      FROM user_vecs a JOIN user_vecs b ON a.user_id <> b.user_id
      QUALIFY row_number() OVER (PARTITION BY a.user_id ORDER BY score, other) <= 4""",
    "sim_items": """SELECT a.item, b.item AS other, round(list_distance(a.features, b.features), 9) AS score
      FROM cluster_vecs a JOIN cluster_vecs b ON a.item <> b.item
      QUALIFY row_number() OVER (PARTITION BY a.item ORDER BY score, other) <= 4""",
}
ALL_IDS = {
    "row_view": "SELECT user_id AS row_id FROM user_vecs", "col_view": "SELECT item AS col_id FROM cluster_vecs",
}
CANDIDATE_SQL = {
    **start_sql(**ALL_IDS),  # start factors of all users and all clusters, rated or not
    **SIMILAR_SQL,
    "seen": "SELECT row_id AS user_id, col_id AS item FROM coo_item",
    "best": """SELECT user_id, item, round(list_dot_product(u0.f, v0.f), 9) AS p FROM seen
      JOIN u0 ON user_id = row_id JOIN v0 ON item = col_id
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY p DESC, item) <= 5""",
    "collab": """SELECT DISTINCT s.user_id, b.item FROM sim_users s JOIN best b ON s.other = b.user_id""",
    "content": """SELECT DISTINCT s.user_id, i.other AS item FROM seen s JOIN sim_items i USING (item)""",
    "cands": "SELECT user_id, item FROM collab UNION SELECT user_id, item FROM content",
    "marked": """SELECT c.user_id, c.item, s.item IS NULL AS fresh,
        bool_or(s.item IS NULL) OVER (PARTITION BY c.user_id) AS any_fresh
      FROM cands c LEFT JOIN seen s ON s.user_id = c.user_id AND s.item = c.item""",
    "popular_items": """SELECT col_id AS item FROM coo_item GROUP BY col_id
      ORDER BY sum(rating) DESC, col_id LIMIT 4""",
    "allowed": """SELECT user_id, item FROM marked WHERE fresh OR NOT any_fresh
      UNION ALL SELECT u.user_id, p.item FROM user_vecs u, popular_items p
      WHERE u.user_id NOT IN (SELECT user_id FROM cands) AND u.user_id NOT IN (SELECT user_id FROM seen)""",
}
BOOST = "cat__ECONOMY"


def _scored(user_vec: str, item_vec: str) -> str:
    return f"""SELECT a.user_id, a.item, list_dot_product([x + 0.0001 for x in {user_vec}], {item_vec}) AS weight,
        list_dot_product(u0.f, v0.f) AS predicted
      FROM allowed a JOIN user_vecs u ON u.user_id = a.user_id JOIN cluster_vecs i ON i.item = a.item
      JOIN u0 ON u0.row_id = a.user_id JOIN v0 ON v0.col_id = a.item"""


_SPOT = f"(SELECT count(*) FROM feature_names WHERE name < '{BOOST}') + 1"
BOOSTED_USER = f"list_concat(list_concat(u.features[:{_SPOT} - 1], [u.features[{_SPOT}] + 0.5]), u.features[{_SPOT} + 1:])"
BOOSTED_ITEM = f"list_concat(list_concat(i.features[:{_SPOT} - 1], [i.features[{_SPOT}] * 2.0]), i.features[{_SPOT} + 1:])"


def _ranked(scored: str) -> str:
    return f"""SELECT user_id, item, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item) AS rank
      FROM (SELECT user_id, item, round(weight * predicted, 9) AS score FROM {scored}) QUALIFY rank <= 5"""


REC_SQL = {
    **CANDIDATE_SQL,
    "scored": _scored("u.features", "i.features"),
    "scored2": _scored(BOOSTED_USER, BOOSTED_ITEM),
    "recs": _ranked("scored"),
    "recs2": _ranked("scored2"),
}


FIT_LAM, FIT_ROUNDS = 5.0, 2
FITTED_SQL = {
    **fitted_sql("coo_item", FIT_LAM, FIT_ROUNDS, **ALL_IDS),
    **{name: text for name, text in REC_SQL.items() if name not in ("u0", "v0")},
}


def rec_sql(body: str, **extra: str) -> str:
    return sql(body, "coo_item", "user_vecs", "cluster_vecs", "news", "item_clusters", **REC_SQL, **extra)


class Inputs:
    """Feature vectors, seen pairs and factors of the item-cluster side.

    Factors are the start factors, or with ``fitted`` those of a few least-squares rounds from them.
    """

    def __init__(self, t: Tables, fitted: bool = False):
        self.t, self.fitted = t, fitted

    @cached_property
    def cols(self) -> list[str]:
        cats, subs = profiles.values(self.t)
        return sorted(fe.prefixed(fe.CAT, cats) + fe.prefixed(fe.SUB, subs))

    @cached_property
    def users(self) -> DataFrame:
        users = fe.user_features(self.t.interactions, *profiles.values(self.t))
        return materialize(fe.aligned(users, ["user_id"], self.cols), "users")

    @cached_property
    def items(self) -> DataFrame:
        items = fe.item_features(profiles.popular(self.t), *profiles.values(self.t))
        sums = fe.cluster_sums(items.join(self.t.item_clusters, "news_id"), self.cols)
        return materialize(fe.aligned(sums.withColumnRenamed("cluster", "item"), ["item"], self.cols), "items")

    @cached_property
    def coo(self) -> DataFrame:
        return item_side(self.t)

    @property
    def seen(self) -> DataFrame:
        return ratings.seen_pairs(self.coo)

    @cached_property
    def _factors(self) -> tuple[DataFrame, DataFrame]:
        row_ids = self.users.select(F.col("user_id").alias("row_id"))
        col_ids = self.items.select(F.col("item").alias("col_id"))
        if self.fitted:
            fit = factorize(self.coo, row_ids, col_ids, "als", 2, FIT_LAM, max_iterations=FIT_ROUNDS)
            return fit.rows, fit.cols
        return start_factors(row_ids, "row_id", K), start_factors(col_ids, "col_id", K)

    @property
    def rows(self) -> DataFrame:
        return self._factors[0]

    @property
    def col_factors(self) -> DataFrame:
        return self._factors[1]

    def candidates(self) -> DataFrame:
        return rc.all_candidates(
            rc.collaborative_candidates(rc.similar(self.users, "user_id"), self.seen, self.rows, self.col_factors),
            rc.content_candidates(self.seen, rc.similar(self.items, "item")))

    def allowed(self) -> DataFrame:
        return rc.hybrid_candidates(
            self.users, self.items, self.seen, self.rows, self.col_factors, rc.most_popular(self.coo, 4))

    def ranked(self, allowed: DataFrame, **options) -> DataFrame:
        return rc.ranked(
            allowed, self.users, self.items, self.cols, self.rows, self.col_factors, 5, **options)

    def recommend(self, **options) -> DataFrame:
        return rc.recommend(
            self.users, self.items, self.cols, self.seen, self.rows, self.col_factors, n=5,
            fallback=rc.most_popular(self.coo, 4), **options)


def pairs_out(df: DataFrame) -> DataFrame:
    return df.select("user_id", F.col("item").cast("bigint"))


# ---- neighbours


def stored_vectors(t: Tables) -> DataFrame:
    return t.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


VECS_SQL = "SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings"


def nearest_sql(score: str, order: str, k: int, self_pairs: bool = False) -> str:
    cond = "true" if self_pairs else "a.id <> b.id"
    return sql(f"""SELECT a.id, b.id AS neighbor, {score} AS score,
          row_number() OVER (PARTITION BY a.id ORDER BY {order}, b.id) AS rank
        FROM vecs a JOIN vecs b ON {cond} QUALIFY rank <= {k}""", vecs=VECS_SQL)


DISTANCE = "round(list_distance(a.v, b.v), 9)"


def rounded_score(df: DataFrame) -> DataFrame:
    """Scores at the digits they are compared at, shown with six."""
    return df.withColumn("score", F.round(F.round("score", knn.DIGITS), 6))


@query("join_8_nearest_vectors", nearest_sql(f"round({DISTANCE}, 6)", DISTANCE, 3, self_pairs=True))
def _(t):
    return rounded_score(knn.nearest(stored_vectors(t), stored_vectors(t), 3))


@query("win_5_nearest_by_cosine", nearest_sql(
    "round(1 - list_cosine_similarity(a.v, b.v), 6)",
    "round(sqrt(greatest(2 - 2 * list_cosine_similarity(a.v, b.v), 0)), 9)", 5))
def _(t):
    found = knn.nearest(stored_vectors(t), stored_vectors(t), 5, "cosine", exclude_self=True)
    return found.withColumn("score", F.round("score", 6))


@query("knn_1_similar_users", sql(
    "SELECT user_id, other, round(score, 6) AS score FROM sim_users", "user_vecs", "cluster_vecs", **SIMILAR_SQL))
def _(t):
    cats, subs = profiles.values(t)
    users = fe.user_features(t.interactions, cats, subs)
    cols = sorted(fe.prefixed(fe.CAT, cats) + fe.prefixed(fe.SUB, subs))
    found = rc.similar(materialize(fe.aligned(users, ["user_id"], cols), "users"), "user_id")
    return rounded_score(found.drop("rank"))


@query("knn_2_similar_items", sql(
    "SELECT item::BIGINT AS item, other::BIGINT AS other, round(score, 6) AS score FROM sim_items",
    "user_vecs", "cluster_vecs", **SIMILAR_SQL))
def _(t):
    cats, subs = profiles.values(t)
    items = fe.item_features(profiles.popular(t), cats, subs).join(t.item_clusters, "news_id")
    cols = sorted(fe.prefixed(fe.CAT, cats) + fe.prefixed(fe.SUB, subs))
    sums = fe.cluster_sums(items, cols).withColumnRenamed("cluster", "item")
    found = rc.similar(fe.aligned(sums, ["item"], cols), "item")
    return rounded_score(found.drop("rank")).withColumns(
        {c: F.col(c).cast("bigint") for c in ("item", "other")})


@query("knn_3_both_sides_large", nearest_sql(f"round({DISTANCE}, 6)", DISTANCE, 5))
def _(t):
    """The path for two large sides, whatever the size of the table."""
    found = knn.nearest(
        stored_vectors(t), stored_vectors(t), 5, exclude_self=True, small_side=0, pivot_count=16, block_rows=128)
    return rounded_score(found)


# ---- candidates and ranking


@query("rec_7_aligned_cluster_features", rec_sql(
    """SELECT item::BIGINT AS item, array_to_string([x::BIGINT for x in features], ' ') AS features
       FROM cluster_vecs"""))
def _(t):
    text = F.array_join(F.transform("features", lambda x: x.cast("bigint").cast("string")), " ")
    return Inputs(t).items.select(F.col("item").cast("bigint"), text.alias("features"))


@query("rec_7_aligned_user_features", rec_sql(
    "SELECT user_id, round(list_sum(features), 6) AS total, "
    "round(list_dot_product(features, [i::DOUBLE for i in range(len(features))]), 6) AS weighted FROM user_vecs"))
def _(t):
    from ..functions.vectors import total

    data = Inputs(t)
    places = F.transform("features", lambda x, i: x * i)
    return data.users.select(
        "user_id", F.round(total(F.col("features")), 6).alias("total"), F.round(total(places), 6).alias("weighted"))


@query("win_4_best_seen_items", rec_sql(
    "SELECT user_id, item::BIGINT AS item, round(p, 6) AS predicted FROM best"))
def _(t):
    coo = item_side(t)  # seen pairs have rated users and clusters only
    best = rc.best_seen(ratings.seen_pairs(coo), *start(coo))
    return best.select("user_id", F.col("item").cast("bigint"), F.round("predicted", 6).alias("predicted"))


@query("rec_1_collaborative_candidates", rec_sql("SELECT user_id, item::BIGINT AS item FROM collab"))
def _(t):
    data = Inputs(t)
    similar = rc.similar(data.users, "user_id")
    return pairs_out(rc.collaborative_candidates(similar, data.seen, data.rows, data.col_factors))


@query("rec_2_content_candidates", rec_sql("SELECT user_id, item::BIGINT AS item FROM content"))
def _(t):
    data = Inputs(t)
    return pairs_out(rc.content_candidates(data.seen, rc.similar(data.items, "item")))


@query("set_3_all_candidates", rec_sql("SELECT user_id, item::BIGINT AS item FROM cands"))
def _(t):
    return pairs_out(Inputs(t).candidates())


@query("join_6_unseen_candidates", rec_sql(
    """SELECT user_id, item::BIGINT AS item FROM content c WHERE NOT EXISTS (
         SELECT 1 FROM seen s WHERE s.user_id = c.user_id AND s.item = c.item)"""))
def _(t):
    data = Inputs(t)
    content = rc.content_candidates(data.seen, rc.similar(data.items, "item"))
    return pairs_out(rc.without_seen(content, data.seen))


@query("rec_4_recommendable", rec_sql("SELECT user_id, item::BIGINT AS item FROM allowed"))
def _(t):
    return pairs_out(Inputs(t).allowed())


@query("rec_3_preference_weights", rec_sql(
    "SELECT user_id, item::BIGINT AS item, round(weight, 6) AS weight FROM scored"))
def _(t):
    data = Inputs(t)
    weighted = rc.preference_weights(data.allowed(), data.users, data.items)
    return weighted.select("user_id", F.col("item").cast("bigint"), F.round("weight", 6).alias("weight"))


def recs_out(df: DataFrame) -> DataFrame:
    return df.select("user_id", F.col("item").cast("bigint"), F.round("score", 6).alias("score"), "rank")


@query("rec_5_hybrid_top_n", rec_sql(
    "SELECT user_id, item::BIGINT AS item, round(score, 6) AS score, rank FROM recs"))
def _(t):
    return recs_out(Inputs(t).recommend())


@query("rec_6_category_boost", rec_sql(
    "SELECT user_id, item::BIGINT AS item, round(score, 6) AS score, rank FROM recs2"))
def _(t):
    return recs_out(Inputs(t).recommend(scales={BOOST: 2.0}))


@query("rec_5_fitted_top_n", sql(
    "SELECT user_id, item::BIGINT AS item, round(score, 6) AS score, rank FROM recs",
    "coo_item", "user_vecs", "cluster_vecs", **FITTED_SQL))
def _(t):
    """Fit, then recommend."""
    return recs_out(Inputs(t, fitted=True).recommend())


STUDY_SQL = {
    "members": """SELECT news_id, cluster FROM item_clusters
      QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY news_id) <= 4""",
    "study": """SELECT mode, category, count(*) AS value FROM (
        SELECT 'plain' AS mode, item FROM recs UNION ALL SELECT 'weighted', item FROM recs2) r
      JOIN members m ON r.item = m.cluster JOIN news USING (news_id) GROUP BY mode, category""",
}


def study(t: Tables) -> DataFrame:
    data = Inputs(t)
    allowed = data.allowed()
    modes = {"plain": data.ranked(allowed), "weighted": data.ranked(allowed, scales={BOOST: 2.0})}
    return rc.recommended_categories(modes, rc.cluster_members(t.item_clusters), t.news)


@query("rec_8_category_study", rec_sql("SELECT mode, category, value FROM study", **STUDY_SQL))
def _(t):
    return study(t)


@query("agg_19_recommended_categories", rec_sql(
    "SELECT category, sum(value)::BIGINT AS value FROM study WHERE mode = 'plain' GROUP BY category", **STUDY_SQL))
def _(t):
    data = Inputs(t)
    counted = rc.recommended_categories(
        {"plain": data.recommend()}, rc.cluster_members(t.item_clusters), t.news)
    return counted.groupBy("category").agg(F.sum("value").alias("value"))


@query("rpt_4_weighted_counts", rec_sql(
    "SELECT category, value, mode = 'weighted' AS weighted FROM study", **STUDY_SQL))
def _(t):
    from ..operators.report import mode_counts

    counted = materialize(study(t), "study")
    parts = {m: counted.where(F.col("mode") == m).drop("mode") for m in ("plain", "weighted")}
    return mode_counts(parts["plain"], parts["weighted"])


@query("rec_9_top_predicted", rec_sql(
    """SELECT u0.row_id AS user_id, v0.col_id::BIGINT AS item,
         round(list_dot_product(u0.f, v0.f), 6) AS predicted,
         row_number() OVER (PARTITION BY u0.row_id ORDER BY round(list_dot_product(u0.f, v0.f), 9) DESC,
           v0.col_id) AS rank FROM u0 CROSS JOIN v0 QUALIFY rank <= 5"""))
def _(t):
    users = t.interactions.select(F.col("user_id").alias("row_id")).distinct()
    clusters = t.item_clusters.select(F.col("cluster").alias("col_id")).distinct()
    best = rc.top_predicted(
        start_factors(users, "row_id", K), start_factors(clusters, "col_id", K), 5)
    return best.select(
        "user_id", F.col("item").cast("bigint"), F.round("predicted", 6).alias("predicted"), "rank")


# ---- retrieval


@query("ret_1_top_k_by_product", nearest_sql(
    "round(list_dot_product(a.v, b.v), 6)", "round(list_dot_product(a.v, b.v), 9) DESC", 10, self_pairs=True))
def _(t):
    best = retrieval.retrieve(stored_vectors(t), stored_vectors(t), 10)
    return best.withColumn("score", F.round("score", 6))


@query("ret_2_top_k_accuracy", sql(
    " UNION ALL ".join(
        f"SELECT 'top_{k}' AS metric, round(avg((rank <= {k})::INTEGER), 6) AS accuracy FROM ranked"
        for k in (1, 5, 10)), "coo_item", "interactions", "item_clusters", **start_sql(),
    scores="""SELECT row_id, col_id, round(list_dot_product(u0.f, v0.f), 9) AS s,
        rank() OVER (PARTITION BY row_id ORDER BY round(list_dot_product(u0.f, v0.f), 9) DESC) AS rank
      FROM u0 CROSS JOIN v0""",
    ranked="""SELECT rank FROM interactions i JOIN item_clusters c USING (news_id)
      JOIN scores s ON s.row_id = i.user_id AND s.col_id = c.cluster WHERE score = 1"""))
def _(t):
    return accuracy(t)


def accuracy(t: Tables) -> DataFrame:
    coo = item_side(t)
    rows, cols = start(coo)
    liked = t.interactions.where(F.col("score") == 1).groupBy("user_id", "news_id").agg(F.count("*").alias("times"))
    positives = liked.join(t.item_clusters, "news_id").select(
        F.col("user_id").alias("query_id"), F.col("cluster").alias("candidate_id"), "times")
    measured = retrieval.top_k_accuracy(
        positives, rows.select(F.col("row_id").alias("id"), F.col("factors").alias("vector")),
        cols.select(F.col("col_id").alias("id"), F.col("factors").alias("vector")), [1, 5, 10], "times")
    return measured.withColumn("accuracy", F.round("accuracy", 6))


@query("evl_2_combined_loss", sql(
    """SELECT round(0.7 * mse + 0.3 * miss, 6) AS loss FROM
         (SELECT avg((rating - list_dot_product(u0.f, v0.f)) ** 2) AS mse FROM coo_item
          JOIN u0 USING (row_id) JOIN v0 USING (col_id)),
         (SELECT 1 - avg((rank <= 5)::INTEGER) AS miss FROM ranked)""",
    "coo_item", "interactions", "item_clusters", **start_sql(),
    scores="""SELECT row_id, col_id, rank() OVER (PARTITION BY row_id
        ORDER BY round(list_dot_product(u0.f, v0.f), 9) DESC) AS rank FROM u0 CROSS JOIN v0""",
    ranked="""SELECT rank FROM interactions i JOIN item_clusters c USING (news_id)
      JOIN scores s ON s.row_id = i.user_id AND s.col_id = c.cluster WHERE score = 1"""))
def _(t):
    coo = item_side(t)
    pairs = coo.select(F.col("row_id").alias("user_id"), F.col("col_id").alias("item"), "rating")
    mse = retrieval.squared_errors(predicted(pairs, *start(coo)), "rating", "predicted")
    hit = accuracy(t).where(F.col("metric") == "top_5").select("accuracy").scalar()
    loss = retrieval.combined_loss(F.col("mse"), F.lit(1.0) - hit, 0.7, 0.3)
    return mse.select(F.round(loss, 6).alias("loss"))
