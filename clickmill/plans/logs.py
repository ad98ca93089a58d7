"""Log parsing, joins, popularity and hours of the day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import timebin
from ..functions.text import impression_token, split_tokens
from ..functions.vectors import hash_bin
from ..operators import interactions as ia
from ..operators import popularity as pop
from ..operators import ranking, sequences, temporal
from ..session import distinct_values, scratch_path
from ..sources import readers, sinks
from .fixtures import ITEM_CLUSTERS, Tables, sql
from .registry import query

# The categories of the given part table, for the column lists of the SQL twins.
CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
EVENT = ["impression_id", "user_id", "news_id", "pos", "interaction_type", "score"]
EVENT_ORDER = ["impression_id", "interaction_type", "pos"]
EVENT_SQL = (
    "impression_id, user_id, news_id, pos::BIGINT AS pos, interaction_type, score::BIGINT AS score"
)


def event_columns(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.col(c).cast("bigint") if c in ("pos", "score") else F.col(c) for c in EVENT]
    )


def time_text(col: str = "time"):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias("time")


TIME_SQL = "strftime(time, '%Y-%m-%d %H:%M:%S') AS time"
LOG_SQL = f"impression_id, user_id, {TIME_SQL}, history, impressions"


def log_columns(df: DataFrame) -> DataFrame:
    return df.select("impression_id", "user_id", time_text(), "history", "impressions")


# ---- sources and sinks


@query("src_1_log_tsv", sql(f"SELECT {LOG_SQL} FROM behaviors", "behaviors"))
def _(t: Tables):
    path = scratch_path(t.spark, "log")
    stamp = F.date_format("time", timebin.RAW_TIME_FORMAT).alias("time")
    raw = t.behaviors.select("impression_id", "user_id", stamp, "history", "impressions")
    sinks.write_table(raw, path, "log")
    return log_columns(readers.behaviors_tsv(t.spark, path))


@query("src_2_catalogue_tsv", sql(
    "SELECT news_id, category, sub_category, title, abstract FROM news", "news"))
def _(t):
    path = scratch_path(t.spark, "catalogue")
    sinks.write_table(t.news, path, "tsv")
    return readers.news_tsv(t.spark, path).select(
        "news_id", "category", "sub_category", "title", "abstract")


@query("src_3_csv_with_index_column", sql(
    "SELECT news_id, category, sub_category, title, abstract FROM news", "news"))
def _(t):
    path = scratch_path(t.spark, "csv")
    cols = ["news_id", "category", "sub_category", "title", "abstract"]
    indexed = t.news.select(F.monotonically_increasing_id().alias("Unnamed: 0"), *cols)
    sinks.write_table(indexed, path, "csv")
    return readers.table_csv(t.spark, path, ", ".join(f"{c} STRING" for c in cols))


@query("src_4_chunked_table", sql(f"SELECT {EVENT_SQL} FROM interactions", "interactions"))
def _(t):
    path = scratch_path(t.spark, "chunks")
    sinks.write_chunks(t.described, path, 4, EVENT_ORDER)
    return event_columns(readers.chunks(t.spark, path))


@query("src_7_sequences_with_defaults", sql(
    """SELECT impression_id, array_to_string(list_transform(range(1, 11),
         lambda i: coalesce(string_split(regexp_replace(impressions, '-[01]', '', 'g'), ' ')[i], '0')),
         ' ') AS context_movie_id FROM behaviors""", "behaviors"))
def _(t):
    path = scratch_path(t.spark, "sequences")
    ids = F.transform(split_tokens("impressions"), lambda x: impression_token(x)["news_id"])
    sinks.write_table(t.behaviors.select("impression_id", ids.alias("context_movie_id")), path)
    full = sequences.with_defaults(t.spark.read.parquet(path), {"context_movie_id": F.lit("0")})
    return full.select("impression_id", F.array_join("context_movie_id", " ").alias("context_movie_id"))


@query("src_8_ratings_features", sql(
    "SELECT rating_id, movie_title AS title, user_id, user_rating AS rating FROM movie_ratings",
    "movie_ratings"))
def _(t):
    return readers.named_features(t.movie_ratings, {
        "rating_id": "rating_id", "movie_title": "title", "user_id": "user_id", "user_rating": "rating"})


@query("snk_1_csv_and_parquet", sql(
    """SELECT 'csv' AS format, news_id, title, abstract FROM news
       UNION ALL SELECT 'parquet', news_id, title, abstract FROM news""", "news"))
def _(t):
    kept = t.news.select("news_id", "title", "abstract")
    out = []
    for fmt in ("csv", "parquet"):
        path = scratch_path(t.spark, fmt)
        sinks.write_table(kept, path, fmt)
        reader = t.spark.read.schema(kept.schema)
        back = reader.parquet(path) if fmt == "parquet" else reader.csv(path, header=True, escape='"')
        out.append(back.select(F.lit(fmt).alias("format"), "*"))
    return out[0].unionByName(out[1])


@query("snk_2_row_range_chunks", sql(
    """SELECT impression_id, interaction_type, pos::BIGINT AS pos,
         (ntile(4) OVER (ORDER BY impression_id, interaction_type, pos) - 1)::BIGINT AS chunk
       FROM interactions""", "interactions"))
def _(t):
    keys = t.interactions.select("impression_id", "interaction_type", F.col("pos").cast("bigint"))
    return ranking.row_chunks(keys, EVENT_ORDER, 4)


# ---- filters


@query("flt_1_positive_rows", sql(
    f"SELECT {EVENT_SQL} FROM interactions WHERE score = 1", "interactions"))
def _(t):
    return event_columns(t.interactions.where(F.col("score") == 1))


@query("flt_2_first_rows", sql(
    f"""SELECT {EVENT_SQL} FROM interactions QUALIFY row_number() OVER (
          ORDER BY impression_id, interaction_type, pos) <= 10000""", "interactions"))
def _(t):
    return event_columns(t.interactions.orderBy(*EVENT_ORDER).limit(10_000))


@query("flt_3_rows_with_history", sql(
    f"SELECT {LOG_SQL} FROM behaviors WHERE history IS NOT NULL", "behaviors"))
def _(t):
    return log_columns(t.behaviors.where(F.col("history").isNotNull()))


@query("flt_4_complete_rows", sql(
    "SELECT news_id, title, abstract FROM news WHERE abstract IS NOT NULL AND title IS NOT NULL", "news"))
def _(t):
    return t.news.select("news_id", "title", "abstract").na.drop("any")


@query("flt_5_filled_text", sql(
    "SELECT news_id, coalesce(abstract, ' . ') AS abstract FROM news", "news"))
def _(t):
    return t.news.select("news_id", "abstract").na.fill({"abstract": " . "})


# ---- joins


@query("join_1_article_lookup", sql(
    f"SELECT {EVENT_SQL}, category, sub_category, title, abstract FROM interactions", "interactions"))
def _(t):
    joined = ia.with_article(ia.interaction_events(t.behaviors), t.news)
    return joined.select(
        "impression_id", "user_id", "news_id", F.col("pos").cast("bigint"), "interaction_type",
        F.col("score").cast("bigint"), "category", "sub_category", "title", "abstract")


@query("join_1_unknown_articles", sql(
    """SELECT news_id, count(*) AS events FROM events_long e
       WHERE NOT EXISTS (SELECT 1 FROM liked l WHERE l.news_id = e.news_id) GROUP BY news_id""",
    "events_long", "news", liked="SELECT * FROM news WHERE abstract IS NOT NULL"))
def _(t):
    catalogue = t.news.where(F.col("abstract").isNotNull())
    return ia.unknown_articles(ia.interaction_events(t.behaviors), catalogue)


POPULAR_SQL = {
    "clicked": """SELECT news_id, count(*) AS n FROM impression_items WHERE label = '1'
      GROUP BY news_id""",
    "past": "SELECT news_id, count(*) AS n FROM history_items GROUP BY news_id",
    "popular": """SELECT news.*, coalesce(clicked.n, 0) AS popularity_impression,
      coalesce(past.n, 0) AS popularity_history FROM news LEFT JOIN clicked USING (news_id)
      LEFT JOIN past USING (news_id)""",
}


def popular_sql(body: str, *views: str, **extra: str) -> str:
    return sql(body, "news", "impression_items", "history_items", *views, **POPULAR_SQL, **extra)


@query("join_2_merged_popularity", popular_sql(
    "SELECT news_id, category, popularity_impression, popularity_history FROM popular"))
def _(t):
    merged = pop.merged_popularity(
        pop.article_clicks(t.behaviors, t.news), pop.article_history(t.behaviors, t.news), t.news)
    return merged.select("news_id", "category", "popularity_impression", "popularity_history")


@query("join_3_zero_filled_categories", popular_sql(
    """SELECT n.category, coalesce(x.clicks, 0) AS clicks FROM (SELECT DISTINCT category FROM news) n
       LEFT JOIN (SELECT category, sum(popularity_impression)::BIGINT AS clicks FROM popular
         WHERE abstract IS NULL GROUP BY category) x ON n.category = x.category"""))
def _(t):
    bare = t.news.where(F.col("abstract").isNull())
    per_article = pop.count_per_article(ia.clicks(t.behaviors), "n")
    counts = per_article.join(bare, "news_id").groupBy("category").agg(F.sum("n").alias("clicks"))
    return pop.zero_filled(t.news.select("category").distinct(), counts, "category", "clicks")


@query("join_7_clicked_articles", sql(
    """SELECT news_id, title FROM news
       WHERE news_id IN (SELECT news_id FROM impression_items WHERE label = '1')""",
    "news", "impression_items"))
def _(t):
    return t.news.select("news_id", "title").join(ia.clicks(t.behaviors), "news_id", "left_semi")


# ---- popularity


@query("agg_1_article_clicks", popular_sql("SELECT news_id, popularity_impression FROM popular"))
def _(t):
    return pop.article_clicks(t.behaviors, t.news)


@query("agg_2_article_history", popular_sql("SELECT news_id, popularity_history FROM popular"))
def _(t):
    return pop.article_history(t.behaviors, t.news)


@query("agg_3_category_popularity", popular_sql(
    """SELECT category, sum(popularity_impression)::BIGINT AS popularity_impression,
         sum(popularity_history)::BIGINT AS popularity_history FROM popular GROUP BY category"""))
def _(t):
    return pop.category_popularity(pop.article_popularity(t.behaviors, t.news))


def wide_sql(source: str, value: str, cast: str = "::BIGINT") -> str:
    return ", ".join(
        f"coalesce(sum(CASE WHEN category = '{c}' THEN {value} END), 0){cast} AS \"{c}\"" for c in CATEGORIES
    ) + f" FROM {source}"


CATEGORY_WIDE_SQL = (
    f"SELECT 'impressions' AS popularity_type, {wide_sql('popular', 'popularity_impression')} "
    f"UNION ALL SELECT 'history', {wide_sql('popular', 'popularity_history')}"
)


@query("agg_4_article_table", popular_sql(
    """SELECT news_id, category, sub_category, title, abstract, popularity_impression,
         popularity_history FROM popular"""))
def _(t):
    return pop.article_popularity(t.behaviors, t.news).drop("url", "title_entities", "abstract_entities")


@query("agg_4_category_table", popular_sql(CATEGORY_WIDE_SQL))
def _(t):
    popular = pop.article_popularity(t.behaviors, t.news)
    return pop.category_wide(popular, distinct_values(t.news, "category"))


COUNT_CELLS = ", ".join(
    f"count(*) FILTER (kind = '{k}' AND category = '{c}') AS \"{c}_{k}\""
    for k in ("history", "impression") for c in CATEGORIES
)
TAGGED_SQL = {
    "tagged": """SELECT impression_id, 'history' AS kind, unnest(string_split(history, ' ')) AS news_id
        FROM behaviors WHERE history IS NOT NULL
      UNION ALL SELECT impression_id, 'impression', news_id FROM impression_items WHERE label = '1'""",
}


@query("agg_5_counts_per_impression", sql(
    f"""SELECT b.impression_id, {COUNT_CELLS} FROM behaviors b LEFT JOIN (
          SELECT impression_id, kind, category FROM tagged JOIN news USING (news_id)) x
        ON b.impression_id = x.impression_id GROUP BY b.impression_id""",
    "behaviors", "impression_items", "news", **TAGGED_SQL))
def _(t):
    counts = pop.interaction_counts(t.behaviors, t.news, distinct_values(t.news, "category"))
    return counts.drop("user_id", "time", "history", "impressions")


HOUR_SQL = {
    "spine": """SELECT lpad(h::VARCHAR, 2, '0') AS hour, category FROM range(24) r(h),
      (SELECT DISTINCT category FROM news) c""",
    "click_events": """SELECT time AS hour, category FROM interactions
      WHERE interaction_type = 'impression' AND score = 1""",
    "first_rows": """SELECT * FROM behaviors QUALIFY row_number() OVER (
      PARTITION BY user_id ORDER BY impression_id) = 1""",
    "past_events": """SELECT strftime(date_trunc('hour', time - INTERVAL 1 MICROSECOND) +
        INTERVAL 1 HOUR, '%H') AS hour, category FROM (
          SELECT time, unnest(string_split(history, ' ')) AS news_id FROM first_rows
          WHERE history IS NOT NULL) x JOIN news USING (news_id)
      WHERE time > TIMESTAMP '2019-11-15 00:00:00' AND time <= TIMESTAMP '2019-11-16 00:00:00'
      UNION ALL SELECT '01', category FROM (
          SELECT time, unnest(string_split(history, ' ')) AS news_id FROM first_rows
          WHERE history IS NOT NULL) x JOIN news USING (news_id)
      WHERE time = TIMESTAMP '2019-11-15 00:00:00'""",
    "click_hours": """SELECT s.hour, s.category, count(e.hour) AS n FROM spine s LEFT JOIN click_events e
      ON s.hour = e.hour AND s.category = e.category GROUP BY s.hour, s.category""",
    "past_hours": """SELECT s.hour, s.category, count(e.hour) AS n FROM spine s LEFT JOIN past_events e
      ON s.hour = e.hour AND s.category = e.category GROUP BY s.hour, s.category""",
}


def hours_sql(body: str) -> str:
    return sql(body, "behaviors", "interactions", "news", **HOUR_SQL)


@query("agg_6_hourly_totals", hours_sql("SELECT hour, category, n FROM click_hours"))
def _(t):
    counts = temporal.hourly_counts(ia.clicks(t.behaviors, ["time"]), t.news)
    return temporal.on_all_hours(counts, distinct_values(t.news, "category"))


@query("agg_20_without_repeats", sql(
    """SELECT user_id, news_id, interaction_type, score::BIGINT AS score, min(time) AS time
       FROM interactions GROUP BY ALL""", "interactions"))
def _(t):
    rows = t.interactions.select(
        "user_id", "news_id", "interaction_type", F.col("score").cast("bigint"), "time")
    return ia.without_repeats(rows)


@query("agg_20_repeats_removed", sql(
    """SELECT sum(n)::BIGINT AS rows_in, count(*) AS rows_kept, sum(n - 1)::BIGINT AS rows_removed
       FROM (SELECT count(*) AS n FROM interactions GROUP BY user_id, news_id, interaction_type, score)""",
    "interactions"))
def _(t):
    return ia.repeats_removed(
        t.interactions.select("user_id", "news_id", "interaction_type", "score", "time"))


# ---- first rows


@query("win_1_first_history", sql(f"SELECT {LOG_SQL} FROM first_history", "first_history"))
def _(t):
    return log_columns(ia.first_history(t.behaviors))


@query("win_2_first_row", sql(
    f"""SELECT {LOG_SQL} FROM behaviors QUALIFY row_number() OVER (
          PARTITION BY user_id ORDER BY impression_id) = 1""", "behaviors"))
def _(t):
    return log_columns(ia.first_row(t.behaviors, "user_id", "impression_id"))


SHARE = "round(CASE WHEN sum(n) OVER (PARTITION BY hour) > 0 THEN n / sum(n) OVER (PARTITION BY hour) END, 6)"


@query("win_7_hourly_shares", hours_sql(f"SELECT hour, category, n, {SHARE} AS share FROM click_hours"))
def _(t):
    counts = temporal.hourly_counts(ia.clicks(t.behaviors, ["time"]), t.news)
    shares = temporal.hourly_shares(temporal.on_all_hours(counts, distinct_values(t.news, "category")))
    return shares.withColumn("share", F.round("share", 6))


def _context_sql(col: str, fill: str) -> str:
    return f"""array_to_string(list_transform(range(1, 11), lambda i: coalesce({col}s[i], {fill})), ' ')
      AS context_{col}"""


@query("win_8_next_item_examples", sql(
    f"""SELECT user_id, position, {_context_sql('movie_id', "'0'")}, {_context_sql('user_rating', '0')},
          {_context_sql('movie_year', '1980')}, {_context_sql('movie_genre', "'Drama'")},
          movie_id::VARCHAR AS label_movie_id
        FROM (SELECT user_id, movie_id,
            row_number() OVER (PARTITION BY user_id ORDER BY timestamp, rating_id) AS position,
            count(*) OVER (PARTITION BY user_id) AS n,
            array_agg(movie_id::VARCHAR) OVER w AS movie_ids, array_agg(user_rating::INTEGER) OVER w AS user_ratings,
            array_agg(movie_year) OVER w AS movie_years, array_agg(movie_genre) OVER w AS movie_genres
          FROM movie_ratings WHERE user_rating >= 2 WINDOW w AS (PARTITION BY user_id
            ORDER BY timestamp, rating_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
        WHERE n >= 3 AND position > 1""", "movie_ratings"))
def _(t):
    liked = t.movie_ratings.where(F.col("user_rating") >= sequences.MIN_RATING)
    liked = readers.ids_as_text(liked, ["movie_id"])
    types = dict(liked.dtypes)
    fillers = {c: F.lit(v).cast(types[c]) for c, v in sequences.CONTEXT_DEFAULTS.items()}
    examples = sequences.next_item_examples(
        liked, "user_id", ["timestamp", "rating_id"], "movie_id", fillers)
    whole = examples.withColumn("context_user_rating", F.col("context_user_rating").cast("array<int>"))
    return whole.withColumns({
        f"context_{c}": F.array_join(F.col(f"context_{c}").cast("array<string>"), " ") for c in fillers})


# ---- reshaping


@query("rsh_1_interactions", sql(
    f"""SELECT {EVENT_SQL}, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, time, category, sub_category,
          title, abstract FROM interactions""", "interactions"))
def _(t):
    rows = ia.decompose_interactions(t.behaviors, t.news)
    return rows.withColumns({
        "pos": F.col("pos").cast("bigint"), "score": F.col("score").cast("bigint"),
        "ts": F.date_format("ts", "yyyy-MM-dd HH:mm:ss")})


@query("rsh_1_literal_scores", sql(
    """SELECT interaction_type, CASE interaction_type WHEN 'history' THEN 1 ELSE 0 END::BIGINT AS score,
         count(*) AS n FROM interactions GROUP BY ALL""", "interactions"))
def _(t):
    rows = ia.decompose_interactions(t.behaviors, t.news, label_mode="zero")
    return rows.groupBy("interaction_type", F.col("score").cast("bigint")).agg(F.count("*").alias("n"))


@query("rsh_2_exploded_lists", sql(
    "SELECT impression_id, pos::BIGINT AS pos, news_id, label FROM impression_items", "impression_items"))
def _(t):
    rows = ia.impression_items(t.behaviors, ["impression_id"])
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@query("rsh_3_wide_to_long", popular_sql(
    """SELECT news_id, 'popularity_impression' AS variable, popularity_impression AS value FROM popular
       UNION ALL SELECT news_id, 'popularity_history', popularity_history FROM popular"""))
def _(t):
    popular = pop.article_popularity(t.behaviors, t.news)
    return popular.unpivot(
        "news_id", ["popularity_impression", "popularity_history"], "variable", "value")


@query("rsh_4_long_to_wide", sql(
    f"SELECT sub_category, {wide_sql('news GROUP BY sub_category', '1')}", "news"))
def _(t):
    cats = distinct_values(t.news, "category")
    return t.news.groupBy("sub_category").pivot("category", cats).agg(F.count(F.lit(1))).na.fill(0)


@query("rsh_5_one_hot", sql(
    "SELECT news_id, " + ", ".join(
        f"(category = '{c}')::INTEGER::DOUBLE AS \"category={c}\"" for c in CATEGORIES) + " FROM news",
    "news"))
def _(t):
    from ..operators.features import one_hot

    cats = distinct_values(t.news, "category")
    return one_hot(t.news.select("news_id", "category"), "category", cats, "category=").drop("category")


@query("rsh_7_hourly_chart_rows", hours_sql(
    f"""SELECT hour, category AS variable, 'impression' AS type, {SHARE} AS value FROM click_hours
        UNION ALL SELECT hour, category, 'history', {SHARE} FROM past_hours"""))
def _(t):
    return _hourly_chart(t)


def _hourly_chart(t: Tables) -> DataFrame:
    cats = distinct_values(t.news, "category")
    clicked, past = temporal.hourly_long(t.behaviors, t.news, cats)
    parts = [
        temporal.chart_rows(temporal.hourly_wide(shares, cats, suffix), suffix)
        for shares, suffix in ((clicked, "_impression"), (past, "_history"))
    ]
    return parts[0].unionByName(parts[1]).withColumn("value", F.round("value", 6))


# ---- scalar functions


@query("str_1_impression_token", sql(
    "SELECT impression_id, pos::BIGINT AS pos, news_id || '/' || label AS parts FROM impression_items",
    "impression_items"))
def _(t):
    rows = ia.impression_items(t.behaviors, ["impression_id"])
    return rows.select(
        "impression_id", F.col("pos").cast("bigint"), F.concat_ws("/", "news_id", "label").alias("parts"))


@query("str_2_tokens", """SELECT doc_id,
    len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::BIGINT AS tokens,
    list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[-1] AS last_token
    FROM documents""")
def _(t):
    toks = split_tokens("text")
    return t.raw("documents").select(
        "doc_id", F.size(toks).cast("bigint").alias("tokens"),
        F.try_element_at(toks, F.lit(-1)).alias("last_token"))


@query("str_3_split_parts", """SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS rank,
    split_part(o_orderpriority, '-', 2) AS label,
    left(split_part(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), ' ', 2), 2) AS hour FROM orders""")
def _(t):
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return t.raw("orders").select(
        "o_orderkey",
        F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("rank"),
        F.split_part("o_orderpriority", F.lit("-"), F.lit(2)).alias("label"),
        F.substring(F.split_part(stamp, F.lit(" "), F.lit(2)), 1, 2).alias("hour"))


@query("str_4_joined_text", sql(
    "SELECT news_id, coalesce(abstract, ' . ') || title AS text FROM news", "news"))
def _(t):
    from ..functions.text import joined_text

    return t.news.select("news_id", joined_text(["abstract", "title"]).alias("text"))


@query("str_5_formatted_labels", sql(
    """SELECT news_id, category || '_history' AS col, category || ', ' || sub_category AS names,
         '(' || category || ', ' || sub_category || ']' AS bin FROM news""", "news"))
def _(t):
    return t.news.select(
        "news_id", F.concat("category", F.lit("_history")).alias("col"),
        F.array_join(F.array("category", "sub_category"), ", ").alias("names"),
        F.format_string("(%s, %s]", "category", "sub_category").alias("bin"))


@query("str_6_ids_as_text", sql(
    "SELECT rating_id, movie_id::VARCHAR AS movie_id FROM movie_ratings", "movie_ratings"))
def _(t):
    return readers.ids_as_text(t.movie_ratings, ["movie_id"]).select("rating_id", "movie_id")


@query("dt_1_parsed_time", sql(f"SELECT impression_id, {TIME_SQL} FROM behaviors", "behaviors"))
def _(t):
    raw = t.behaviors.select(
        "impression_id", F.date_format("time", timebin.RAW_TIME_FORMAT).alias("raw"))
    return raw.withColumn("time", timebin.parse_time("raw")).select("impression_id", time_text())


HOUR_CASE = """CASE WHEN time = TIMESTAMP '2019-11-15 00:00:00' THEN '01'
  WHEN time > TIMESTAMP '2019-11-15 00:00:00' AND time <= TIMESTAMP '2019-11-16 00:00:00'
  THEN strftime(date_trunc('hour', time - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR, '%H') END"""


@query("dt_2_end_hour", sql(f"SELECT impression_id, {HOUR_CASE} AS hour FROM behaviors", "behaviors"))
def _(t):
    return temporal.with_hour(t.behaviors).select("impression_id", "hour")


@query("dt_3_rows_per_hour_edge", sql(
    """SELECT strftime(e, '%Y-%m-%d %H:%M') AS edge, count(b.impression_id) AS rows FROM
         generate_series(TIMESTAMP '2019-11-15', TIMESTAMP '2019-11-16', INTERVAL 1 HOUR) g(e)
       LEFT JOIN behaviors b ON e > TIMESTAMP '2019-11-15' AND b.time <= e
         AND (b.time > e - INTERVAL 1 HOUR
           OR b.time = TIMESTAMP '2019-11-15' AND e = TIMESTAMP '2019-11-15 01:00:00') GROUP BY e""", "behaviors"))
def _(t):
    """The first bin holds the start of the day as well."""
    start = F.lit(timebin.DAY_START).cast("timestamp_ntz")
    hour = F.make_dt_interval(F.lit(0), F.lit(1), F.lit(0), F.lit(0))
    end = F.when(F.col("time") == start, start + hour).otherwise(timebin.bin_end(F.col("time")))
    ends = t.behaviors.groupBy(end.alias("edge")).agg(F.count("*").alias("rows"))
    joined = timebin.hour_spine(t.spark).join(ends, "edge", "left").na.fill(0, ["rows"])
    return joined.withColumn("edge", F.date_format("edge", "yyyy-MM-dd HH:mm"))


def _wide_hours(view: str, suffix: str) -> str:
    cells = ", ".join(f"max(CASE WHEN category = '{c}' THEN share END) AS \"{c}{suffix}\"" for c in CATEGORIES)
    return f"SELECT hour, {cells} FROM (SELECT hour, category, {SHARE} AS share FROM {view}) GROUP BY hour"


@query("dt_4_hourly_clicks", hours_sql(_wide_hours("click_hours", "_impression")))
def _(t):
    return _hourly_table(t, 0, "_impression")


@query("dt_4_hourly_histories", hours_sql(_wide_hours("past_hours", "_history")))
def _(t):
    return _hourly_table(t, 1, "_history")


def _hourly_table(t: Tables, which: int, suffix: str) -> DataFrame:
    cats = distinct_values(t.news, "category")
    shares = temporal.hourly_long(t.behaviors, t.news, cats)[which]
    return temporal.hourly_wide(shares.withColumn("share", F.round("share", 6)), cats, suffix)


@query("rpt_3_hour_by_category", hours_sql(
    f"""SELECT hour, category AS variable, 'impression' AS type, {SHARE} AS value FROM click_hours
        UNION ALL SELECT hour, category, 'history', {SHARE} FROM past_hours"""))
def _(t):
    return _hourly_chart(t)


@query("join_5_cluster_pairs", sql(
    """SELECT u.cluster::BIGINT AS user_cluster, i.cluster::BIGINT AS item_cluster, count(*) AS n
       FROM interactions JOIN item_clusters i USING (news_id) JOIN user_clusters u USING (user_id)
       GROUP BY ALL""", "interactions", "item_clusters", "user_clusters"))
def _(t):
    per_user = t.interactions.groupBy("user_id", "news_id").agg(F.count("*").alias("n"))
    by_item = per_user.join(t.item_clusters.withColumnRenamed("cluster", "item_cluster"), "news_id")
    by_item = by_item.groupBy("user_id", "item_cluster").agg(F.sum("n").alias("n"))
    both = by_item.join(t.user_clusters.withColumnRenamed("cluster", "user_cluster"), "user_id")
    return both.groupBy(
        F.col("user_cluster").cast("bigint"), F.col("item_cluster").cast("bigint")
    ).agg(F.sum("n").alias("n"))


@query("voc_3_hash_bins", sql(
    "SELECT news_id, cluster::BIGINT AS bin FROM item_clusters", "item_clusters"))
def _(t):
    return t.news.select("news_id", hash_bin(F.col("news_id"), ITEM_CLUSTERS).cast("bigint").alias("bin"))
