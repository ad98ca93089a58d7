"""Projections, feature tables, sorting, sets, splits, scaling and chart data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..functions.text import parse_number_list
from ..operators import features as fe
from ..operators import popularity as pop
from ..operators import ranking, ratings, reduce, report, splits, vocab
from ..session import distinct_values, materialize, scratch_path
from ..sources import readers, sinks
from .fixtures import Tables, sql, sql_hash_uniform
from .logs import CATEGORIES, CATEGORY_WIDE_SQL, popular_sql
from .registry import query

# The sub-categories of the given part table.
SUB_CATEGORIES = sorted(f"Brand#{i}" for i in range(1, 26))
CAT_COLS = fe.prefixed(fe.CAT, CATEGORIES)
SUB_COLS = fe.prefixed(fe.SUB, SUB_CATEGORIES)


def values(t: Tables) -> tuple[list[str], list[str]]:
    return distinct_values(t.news, "category"), distinct_values(t.news, "sub_category")


def rounded(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def popular(t: Tables) -> DataFrame:
    return pop.article_popularity(t.behaviors, t.news)


# ---- projections


@query("prj_1_drop_rename_reorder", sql(
    "SELECT title AS headline, news_id AS id, category FROM news", "news"))
def _(t):
    slim = t.news.drop("url", "title_entities", "abstract_entities", "abstract", "sub_category")
    return slim.withColumnsRenamed({"title": "headline", "news_id": "id"}).select("headline", "id", "category")


@query("prj_2_summed_column", popular_sql(
    "SELECT news_id, popularity_history + popularity_impression AS popularity FROM popular"))
def _(t):
    total = F.col("popularity_history") + F.col("popularity_impression")
    return popular(t).select("news_id", total.alias("popularity"))


@query("prj_3_constant_tag", sql("SELECT news_id, 'impressions' AS popularity_type FROM news", "news"))
def _(t):
    return t.news.select("news_id", F.lit("impressions").alias("popularity_type"))


@query("prj_4_cast", sql(
    "SELECT impression_id, interaction_type, pos::BIGINT AS pos, score::FLOAT AS score FROM interactions",
    "interactions"))
def _(t):
    return t.interactions.select(
        "impression_id", "interaction_type", F.col("pos").cast("bigint"), F.col("score").cast("float"))


@query("prj_5_aligned_columns", sql(
    """SELECT a.news_id, array_to_string(list((b.name IS NOT NULL)::INTEGER ORDER BY f.name), ' ') AS features
       FROM news a CROSS JOIN feature_names f
       LEFT JOIN article_names b ON b.news_id = a.news_id AND b.name = f.name GROUP BY a.news_id""",
    "feature_names", "article_names"))
def _(t):
    cats, subs = values(t)
    items = fe.item_features(popular(t), cats, subs)
    cols = fe.common_columns(fe.user_features(t.interactions, cats, subs), items)
    joined = F.array_join(F.transform("features", lambda x: x.cast("int").cast("string")), " ")
    return fe.aligned(items, ["news_id"], cols).select("news_id", joined.alias("features"))


@query("flt_6_missing_values", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing FROM behaviors"
    for c in ("impression_id", "user_id", "time", "history", "impressions")), "behaviors"))
def _(t):
    return fe.null_profile(t.behaviors)


# ---- aggregates per user and item


def counts_sql(prefix: str = "", having: str = "", source: str = "interactions", cond: str = "score = 1") -> str:
    cats = [f"count(*) FILTER ({cond} AND category = '{c}') AS \"{prefix}{c}\"" for c in CATEGORIES]
    return f"SELECT user_id, {', '.join(cats)} FROM {source} {having} GROUP BY user_id"


@query("agg_7_positive_counts", sql(counts_sql(having="WHERE score = 1"), "interactions"))
def _(t):
    return fe.positive_counts(t.interactions, "category", values(t)[0])


LISTS_SQL = """SELECT user_id, row_number() OVER (
    PARTITION BY user_id ORDER BY impression_id, interaction_type, pos) - 1 AS position, news_id,
  score::BIGINT AS score FROM interactions"""
EVENT_ORDER = ["impression_id", "interaction_type", "pos"]


@query("agg_8_rating_lists", sql(LISTS_SQL, "interactions"))
def _(t):
    rows = ratings.rating_rows(t.interactions, EVENT_ORDER)
    return rows.withColumn("score", F.col("score").cast("bigint"))


@query("agg_9_users_without_positive", sql(
    "SELECT user_id, sum(score)::BIGINT AS score FROM interactions GROUP BY user_id HAVING sum(score) = 0",
    "interactions"))
def _(t):
    return fe.users_without_positive(t.interactions)


@query("agg_10_median_hour", sql(
    """SELECT user_id, median(time::INTEGER) AS median_hour, round(median(time::INTEGER) / 24, 6) AS median_time
       FROM interactions GROUP BY user_id""", "interactions"))
def _(t):
    return rounded(fe.median_hours(t.interactions), ["median_time"])


@query("agg_11_cluster_sums", popular_sql(
    """SELECT cluster::BIGINT AS cluster, sum(popularity_impression + popularity_history)::BIGINT AS popularity, """
    + ", ".join(f"sum((category = '{c}')::INTEGER)::DOUBLE AS \"cat__{c}\"" for c in CATEGORIES)
    + " FROM popular JOIN item_clusters USING (news_id) GROUP BY cluster", "item_clusters"))
def _(t):
    cats, subs = values(t)
    items = fe.item_features(popular(t), cats, subs).join(t.item_clusters, "news_id")
    sums = fe.cluster_sums(items, ["popularity", *fe.prefixed(fe.CAT, cats)])
    return sums.withColumn("cluster", F.col("cluster").cast("bigint"))


@query("agg_12_user_by_item_cluster", sql(
    "SELECT row_id, col_id::BIGINT AS col_id, rating FROM coo_item", "coo_item"))
def _(t):
    coo = ratings.user_by_item_cluster(t.interactions, t.item_clusters)
    return coo.withColumn("col_id", F.col("col_id").cast("bigint"))


@query("agg_13_user_cluster_by_item", sql(
    "SELECT row_id::BIGINT AS row_id, col_id, rating FROM coo_user", "coo_user"))
def _(t):
    coo = ratings.user_cluster_by_item(t.interactions, t.user_clusters)
    return coo.withColumn("row_id", F.col("row_id").cast("bigint"))


@query("agg_14_index_sets", sql(
    """SELECT 'user' AS side, row_id AS key, col_id::VARCHAR AS member,
         row_number() OVER (PARTITION BY row_id ORDER BY col_id) - 1 AS position FROM coo_item
       UNION ALL SELECT 'cluster', col_id::VARCHAR, row_id,
         row_number() OVER (PARTITION BY col_id ORDER BY row_id) - 1 FROM coo_item""", "coo_item"))
def _(t):
    coo = materialize(ratings.user_by_item_cluster(t.interactions, t.item_clusters), "coo")

    def sets(side: str, key: str, member: str) -> DataFrame:
        return ratings.index_sets(coo, key, member).select(
            F.lit(side).alias("side"), F.col(key).cast("string").alias("key"),
            F.col(member).cast("string").alias("member"), "position")

    return sets("user", "row_id", "col_id").unionByName(sets("cluster", "col_id", "row_id"))


@query("agg_15_articles_per_category", sql(
    "SELECT category, count(*) AS articles FROM news GROUP BY category", "news"))
def _(t):
    return report.articles_per_category(t.news)


TREE_SQL = """SELECT category, sub_category, count(news_id) AS number_of_articles FROM news
  GROUP BY ROLLUP (category, sub_category)"""


@query("agg_16_category_tree", sql(TREE_SQL, "news"))
def _(t):
    return report.category_tree(t.news)


@query("agg_17_distinct_values", sql(
    """SELECT DISTINCT 'user_id' AS name, user_id AS value FROM interactions
       UNION ALL SELECT DISTINCT 'title', title FROM interactions""", "interactions"))
def _(t):
    def one(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.lit(name).alias("name"), F.col(name).alias("value")).distinct()

    return one(t.interactions, "user_id").unionByName(one(t.described, "title"))


@query("agg_18_min_max", "SELECT min(value) AS min_value, max(value) AS max_value FROM events")
def _(t):
    return vocab.min_max(t.raw("events"), "value")


@query("map_1_counter_per_user", sql(
    """SELECT user_id, string_agg(category || '=' || n, ',' ORDER BY category) AS counts FROM (
         SELECT user_id, category, count(*) AS n FROM interactions WHERE score = 1 GROUP BY ALL)
       GROUP BY user_id""", "interactions"))
def _(t):
    maps = fe.category_map(t.interactions)
    entry = F.transform(
        F.array_sort(F.map_entries("counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return maps.select("user_id", F.array_join(entry, ",").alias("counts"))


# ---- ranks, sorts, limits


@query("win_3_first_members", sql(
    """SELECT cluster::BIGINT AS cluster, news_id FROM item_clusters
       QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY news_id) <= 4""", "item_clusters"))
def _(t):
    first = ranking.top_n_per_group(t.item_clusters, ["cluster"], [F.col("news_id")], 4)
    return first.select(F.col("cluster").cast("bigint"), "news_id")


TAIL_SQL = """SELECT news_id, popularity_impression + popularity_history AS total,
  row_number() OVER (ORDER BY popularity_impression + popularity_history DESC, news_id) AS position
  FROM popular"""


@query("win_6_long_tail", popular_sql(TAIL_SQL))
def _(t):
    return report.long_tail(popular(t))


@query("srt_1_by_time", sql(
    """SELECT impression_id, row_number() OVER (ORDER BY time, impression_id) AS row_num FROM behaviors""",
    "behaviors"))
def _(t):
    return ranking.global_row_number(t.behaviors.select("time", "impression_id"), ["time", "impression_id"]).drop("time")


CHART_SQL = f"""SELECT popularity_type, variable, popularity FROM ({CATEGORY_WIDE_SQL}) w
  UNPIVOT (popularity FOR variable IN ({', '.join(CATEGORIES)}))"""


@query("srt_2_mixed_directions", popular_sql(CHART_SQL + " ORDER BY popularity_type, popularity DESC, variable"))
def _(t):
    return report.category_popularity_chart(pop.category_wide(popular(t), values(t)[0]))


@query("srt_3_by_total", popular_sql(
    """SELECT news_id, popularity_impression + popularity_history AS total FROM popular
       ORDER BY total DESC, news_id"""))
def _(t):
    total = F.col("popularity_impression") + F.col("popularity_history")
    return popular(t).select("news_id", total.alias("total")).orderBy(F.desc("total"), "news_id")


@query("srt_4_sorted_sets", sql(
    """SELECT category, string_agg(DISTINCT sub_category, ' ' ORDER BY sub_category) AS sub_categories
       FROM news GROUP BY category ORDER BY count(*) DESC, category""", "news"))
def _(t):
    sets = t.news.groupBy("category").agg(
        F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("sub_category")), " ").alias("sub_categories"))
    return sets.orderBy(F.desc("n"), "category").drop("n")


@query("lim_1_take_and_skip", sql(
    "SELECT news_id, title FROM news ORDER BY news_id LIMIT 10 OFFSET 5", "news"))
def _(t):
    return t.news.select("news_id", "title").orderBy("news_id").offset(5).limit(10)


@query("topk_1_best_per_user", sql(
    """SELECT row_id AS user_id, col_id::BIGINT AS item, rating FROM coo_item
       QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY rating DESC, col_id) <= 5""", "coo_item"))
def _(t):
    coo = ratings.user_by_item_cluster(t.interactions, t.item_clusters)
    best = ranking.top_n_per_group(coo, ["row_id"], [F.desc("rating"), F.col("col_id")], 5)
    return best.select(F.col("row_id").alias("user_id"), F.col("col_id").cast("bigint").alias("item"), "rating")


# ---- sets


@query("set_1_tagged_union", popular_sql(CATEGORY_WIDE_SQL))
def _(t):
    return pop.category_wide_by_union(popular(t), values(t)[0])


@query("set_2_default_rows", sql(counts_sql(fe.CAT), "interactions"))
def _(t):
    cats = values(t)[0]
    liked = fe.positive_counts(t.interactions, "category", cats, fe.CAT)
    users = t.interactions.select("user_id").distinct()
    return users.join(liked, "user_id", "left").na.fill(0)


# ---- feature tables


PROFILE_SQL = "SELECT user_id, " + ", ".join(
    [f"count(*) FILTER (score = 1 AND category = '{c}') AS \"cat__{c}\"" for c in CATEGORIES]
    + [f"count(*) FILTER (score = 1 AND sub_category = '{c}') AS \"sub__{c}\"" for c in SUB_CATEGORIES]
) + " FROM interactions GROUP BY user_id"


@query("fea_1_taste_profile", sql(PROFILE_SQL, "interactions"))
def _(t):
    return fe.taste_profile(t.interactions, *values(t))


def _shares_sql(cols: list[str]) -> str:
    whole = " + ".join(f'"{c}"' for c in cols)
    return ", ".join(f'round(coalesce("{c}" / nullif({whole}, 0), 0), 6)::DOUBLE AS "{c}"' for c in cols)


@query("fea_2_user_features", sql(
    f"""SELECT user_id, {_shares_sql(CAT_COLS)}, {_shares_sql(SUB_COLS)},
          round(median_hour / 24, 6) AS median_time
        FROM profile JOIN (SELECT user_id, median(time::INTEGER) AS median_hour FROM interactions
          GROUP BY user_id) USING (user_id)""", "interactions", profile=PROFILE_SQL))
def _(t):
    df = fe.user_features(t.interactions, *values(t))
    return rounded(df, [c for c in df.columns if c != "user_id"])


@query("fea_3_item_features", popular_sql(
    "SELECT news_id, title, abstract, popularity_history + popularity_impression AS popularity, "
    + ", ".join([f"(category = '{c}')::INTEGER::DOUBLE AS \"cat__{c}\"" for c in CATEGORIES]
                + [f"(sub_category = '{c}')::INTEGER::DOUBLE AS \"sub__{c}\"" for c in SUB_CATEGORIES])
    + " FROM popular"))
def _(t):
    return fe.item_features(popular(t), *values(t))


@query("fea_4_embedding_columns",
       """SELECT vec_id, label::BIGINT AS label, """ + ", ".join(
           f"round(embedding[{i}]::DOUBLE, 6) AS reduced_embeddings_{i}" for i in range(1, 5)) + " FROM embeddings")
def _(t):
    base = t.raw("embeddings")
    df = fe.with_embedding_columns(
        base.select("vec_id", F.col("label").cast("bigint")), base.select("vec_id", "embedding"), "vec_id", 4)
    return rounded(df, [f"reduced_embeddings_{i}" for i in range(1, 5)])


@query("mth_1_row_shares", sql(
    f"SELECT user_id, {_shares_sql(CAT_COLS)} FROM profile", "interactions", profile=PROFILE_SQL))
def _(t):
    cats = values(t)[0]
    cols = fe.prefixed(fe.CAT, cats)
    users = fe.taste_profile(t.interactions, cats, [])
    return rounded(fe.row_shares(users, cols), cols)


@query("src_5_matrix_inputs", sql(
    """SELECT x.user_id, x.n, x.score, c.cluster::BIGINT AS cluster, p.items FROM (
         SELECT user_id, count(*) AS n, sum(score)::BIGINT AS score FROM interactions GROUP BY user_id) x
       JOIN user_clusters c USING (user_id)
       JOIN (SELECT user_id, count(DISTINCT news_id) AS items FROM interactions JOIN item_clusters
         USING (news_id) GROUP BY user_id) p USING (user_id)""",
    "interactions", "user_clusters", "item_clusters"))
def _(t):
    folder = scratch_path(t.spark, "matrix")
    for name, df in (("interactions", t.described), ("items", t.item_clusters), ("users", t.user_clusters)):
        sinks.write_table(df, f"{folder}/{name}")
    rows, items, users = readers.matrix_inputs(
        t.spark, f"{folder}/interactions", f"{folder}/items", f"{folder}/users")
    placed = ratings.rating_rows(rows, EVENT_ORDER)
    sums = placed.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    known = rows.select("user_id", "news_id").distinct().join(items, "news_id")
    known = known.groupBy("user_id").agg(F.count("*").alias("items"))
    return sums.join(users.withColumn("cluster", F.col("cluster").cast("bigint")), "user_id").join(known, "user_id")


@query("join_4_attached_labels", sql(
    """SELECT user_id, round(median(time::INTEGER) / 24, 6) AS median_time, any_value(cluster)::BIGINT AS cluster
       FROM interactions JOIN user_clusters USING (user_id) GROUP BY user_id""",
    "interactions", "user_clusters"))
def _(t):
    from ..operators.cluster import attach_labels

    labelled = attach_labels(fe.median_hours(t.interactions), t.user_clusters, "user_id")
    return rounded(labelled, ["median_time"]).select("user_id", "median_time", F.col("cluster").cast("bigint"))


# ---- vocabularies and scaling


@query("voc_1_sorted_vocabulary", sql(
    """SELECT n.news_id, coalesce(v.idx, 0) AS idx FROM news n LEFT JOIN vocab v ON n.title = v.token""",
    "news", vocab="""SELECT title AS token, row_number() OVER (ORDER BY title) AS idx
      FROM (SELECT DISTINCT title FROM news WHERE abstract IS NULL)"""))
def _(t):
    known = vocab.sorted_vocabulary(t.news.where(F.col("abstract").isNull()), "title")
    return vocab.lookup(t.news.select("news_id", "title"), "title", known).select("news_id", "idx")


@query("voc_2_frequency_vocabulary", sql(
    """SELECT r.rating_id, coalesce(v.idx, 0) AS idx FROM movie_ratings r LEFT JOIN vocab v
       ON r.movie_title = v.token""", "movie_ratings",
    vocab="""SELECT movie_title AS token, row_number() OVER (ORDER BY count(*) DESC, movie_title) AS idx
      FROM movie_ratings GROUP BY movie_title"""))
def _(t):
    known = vocab.frequency_vocabulary(t.movie_ratings, "movie_title")
    rows = t.movie_ratings.select("rating_id", "movie_title")
    return vocab.lookup(rows, "movie_title", known).select("rating_id", "idx")


@query("nrm_1_standardised",
       """SELECT event_id, round((value - (SELECT avg(value) FROM events)) /
            (SELECT stddev_pop(value) FROM events), 6) AS z FROM events""")
def _(t):
    rows = t.raw("events").select("event_id", "value")
    return rounded(vocab.standardised(rows, "value", "z").drop("value"), ["z"])


@query("nrm_2_equal_width_buckets",
       """SELECT event_id, (floor((value - (SELECT min(value) FROM events)) /
            ((SELECT max(value) FROM events) - (SELECT min(value) FROM events)) * 999) + 1)::BIGINT AS bucket
          FROM events""")
def _(t):
    rows = t.raw("events").select("event_id", "value")
    return vocab.equal_width_bucket(rows, "value", 999, "bucket").drop("value")


@query("imp_1_mean_imputed", sql(
    """SELECT vec_id, round(coalesce(x1, (SELECT avg(x1) FROM holes)), 6) AS x1,
         round(coalesce(x2, (SELECT avg(x2) FROM holes)), 6) AS x2 FROM holes""",
    holes="""SELECT vec_id, CASE WHEN label <> 3 THEN embedding[1]::DOUBLE END AS x1,
      CASE WHEN label <> 5 THEN embedding[2]::DOUBLE END AS x2 FROM embeddings"""))
def _(t):
    nan = F.lit(float("nan"))
    holes = t.raw("embeddings").select("vec_id", F.array(
        F.when(F.col("label") == 3, nan).otherwise(F.element_at("embedding", 1).cast("double")),
        F.when(F.col("label") != 5, F.element_at("embedding", 2).cast("double")),
    ).alias("embedding"))
    fixed = reduce.mean_imputed(holes, "embedding", 2)
    return fixed.select(
        "vec_id", F.round(F.element_at("embedding", 1), 6).alias("x1"),
        F.round(F.element_at("embedding", 2), 6).alias("x2"))


# ---- arithmetic


@query("mth_2_rmse_nonzero", sql(
    """SELECT round(sqrt(avg(CASE WHEN e <> 0 THEN e * e END)), 6) AS rmse FROM (
         SELECT user_rating - (SELECT round(avg(user_rating)) FROM movie_ratings) AS e FROM movie_ratings)""",
    "movie_ratings"))
def _(t):
    from ..operators.factorize import rmse_nonzero
    from ..session import one_row

    mean = one_row(t.movie_ratings, F.round(F.avg("user_rating")).alias("m"))["m"]
    errors = t.movie_ratings.select((F.col("user_rating") - mean).alias("e"))
    return rounded(rmse_nonzero(errors, "e"), ["rmse"])


HALVES = "SELECT vec_id, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b FROM embeddings"


def _halves(t: Tables) -> DataFrame:
    whole = F.col("embedding").cast("array<double>")
    return t.raw("embeddings").select(
        "vec_id", F.slice(whole, 1, 32).alias("a"), F.slice(whole, 33, 32).alias("b"))


@query("mth_4_dot_product", f"SELECT vec_id, round(list_dot_product(a, b), 6) AS dot FROM ({HALVES})")
def _(t):
    return _halves(t).select("vec_id", F.round(vec.dot(F.col("a"), F.col("b")), 6).alias("dot"))


@query("mth_5_distances",
       f"""SELECT vec_id, round(list_distance(a, b), 6) AS euclidean,
             round(1 - list_cosine_similarity(a, b), 6) AS cosine,
             round(list_distance(ha, hb) / sqrt(2), 6) AS hellinger FROM (SELECT vec_id, a, b,
               list_transform(a, lambda x: sqrt(abs(x) / list_sum([abs(y) for y in a]))) AS ha,
               list_transform(b, lambda x: sqrt(abs(x) / list_sum([abs(y) for y in b]))) AS hb
             FROM ({HALVES}))""")
def _(t):
    a, b = F.col("a"), F.col("b")
    return _halves(t).select(
        "vec_id", F.round(vec.euclidean(a, b), 6).alias("euclidean"),
        F.round(vec.cosine_distance(a, b), 6).alias("cosine"),
        F.round(vec.hellinger(a, b), 6).alias("hellinger"))


@query("mth_6_seeded_uniform", sql(
    f"SELECT news_id, round({sql_hash_uniform('news_id', '0', '42')}, 9) AS u FROM news", "news"))
def _(t):
    u = vec.hash_uniform(F.col("news_id"), F.lit(0), F.lit(42))
    return t.news.select("news_id", F.round(u, 9).alias("u"))


@query("arr_1_list_positions",
       """SELECT vec_id, len(embedding)::BIGINT AS n, round(embedding[1]::DOUBLE, 6) AS first,
            array_to_string(list_transform(list_slice(list_reverse_sort(list_zip(embedding, range(64))), 1, 5),
              lambda z: z[2]::VARCHAR), ' ') AS best FROM embeddings""")
def _(t):
    e = F.col("embedding")
    pairs = F.transform(e, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    best = F.transform(F.slice(F.reverse(F.array_sort(pairs)), 1, 5), lambda p: p["i"].cast("string"))
    return t.raw("embeddings").select(
        "vec_id", F.size(e).cast("bigint").alias("n"),
        F.round(F.element_at(e, 1).cast("double"), 6).alias("first"), F.array_join(best, " ").alias("best"))


# ---- traces stored as text


def results(t: Tables) -> DataFrame:
    """Result rows whose metric trace is a list written as text, one per stored vector."""
    e = F.transform("embedding", lambda x: F.floor(F.abs(x) * 10000).cast("string"))
    text = F.concat(F.lit("["), F.array_join(e, ", "), F.lit("]"))
    label = F.col("label")
    return t.raw("embeddings").select(
        (F.col("vec_id") % 6 + 42).alias("seed"),
        F.when(label % 2 == 0, "item").otherwise("user").alias("clustering_type"),
        F.lit("SGD").alias("alg"),
        F.element_at(F.array(F.lit(5), F.lit(25), F.lit(50)), (label % 3 + 1).cast("int")).cast("bigint").alias("k"),
        text.alias("RMSE"),
        F.concat(F.lit("['user_id', 'news_id', 'label_"), label.cast("string"), F.lit("']")).alias("features"),
    )


RESULTS_SQL = """SELECT vec_id % 6 + 42 AS seed, CASE WHEN label % 2 = 0 THEN 'item' ELSE 'user' END
    AS clustering_type, 'SGD' AS alg, [5, 25, 50][label % 3 + 1]::BIGINT AS k,
  [floor(abs(x::DOUBLE) * 10000) for x in embedding] AS trace,
  'user_id, news_id, label_' || label AS features FROM embeddings"""
TRACE_SQL = """SELECT seed, clustering_type, alg, k, features,
    generate_subscripts(trace, 1)::BIGINT - 1 AS iteration, unnest(trace)::DOUBLE AS value FROM results"""


@query("json_1_parsed_lists", sql(
    """SELECT seed, features, len(trace)::BIGINT AS n, list_sum(trace)::DOUBLE AS total FROM results""",
    results=RESULTS_SQL))
def _(t):
    trace = parse_number_list(F.col("RMSE"))
    return report.feature_label(results(t)).select(
        "seed", "features", F.size(trace).cast("bigint").alias("n"), vec.total(trace).alias("total"))


@query("rsh_6_trace_rows", sql(
    "SELECT seed, clustering_type, alg, k, iteration, value FROM traces", results=RESULTS_SQL, traces=TRACE_SQL))
def _(t):
    rows = report.trace_rows(results(t), ["seed", "clustering_type", "alg", "k"])
    return rows.withColumn("iteration", F.col("iteration").cast("bigint"))


@query("rpt_5_trace_curves", sql(
    """SELECT features, clustering_type, k, iteration, round(avg(value), 6) AS value, count(*) AS runs
       FROM traces GROUP BY ALL""", results=RESULTS_SQL, traces=TRACE_SQL))
def _(t):
    curve = report.trace_curve(report.feature_label(results(t)), ["features", "clustering_type", "k"])
    return rounded(curve, ["value"]).withColumn("iteration", F.col("iteration").cast("bigint"))


# ---- splits


SHUFFLE = "row_number() OVER (ORDER BY md5(rating_id || '|42'), rating_id)"


@query("spl_1_exact_counts", sql(
    f"""SELECT rating_id, CASE WHEN rn <= 700 * n // 1000 THEN 'train' ELSE 'test' END AS part FROM (
          SELECT rating_id, {SHUFFLE} AS rn, count(*) OVER () AS n
          FROM (SELECT DISTINCT rating_id FROM movie_ratings))""", "movie_ratings"))
def _(t):
    rows = materialize(t.movie_ratings.select("rating_id").distinct(), "ratings")
    n = rows.count()
    train = 700 * n // 1000
    return splits.split_counts(rows, "rating_id", train, n - train)


@query("spl_2_share", sql(
    f"""SELECT impression_id, CASE WHEN {sql_hash_uniform('impression_id', '42')} < 0.4 THEN 'test'
          ELSE 'train' END AS part FROM behaviors""", "behaviors"))
def _(t):
    return splits.split_share(t.behaviors.select("impression_id"), "impression_id", 0.4)


@query("spl_3_by_time", sql(
    """SELECT impression_id, CASE WHEN time < TIMESTAMP '2019-11-15 18:00:00' THEN 'train' ELSE 'test' END AS part
       FROM behaviors""", "behaviors"))
def _(t):
    return splits.split_time(t.behaviors, "time", "2019-11-15 18:00:00").select("impression_id", "part")


# ---- chart data


@query("rpt_1_category_popularity", popular_sql(CHART_SQL))
def _(t):
    return report.category_popularity_chart(pop.category_wide(popular(t), values(t)[0]))


@query("rpt_2_long_tail", popular_sql(TAIL_SQL))
def _(t):
    return report.long_tail(popular(t))


@query("rpt_6_category_distribution", sql(TREE_SQL, "news"))
def _(t):
    return report.category_tree(t.news)
