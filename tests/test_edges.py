"""Hand-written rows for the corners of the log format."""

import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from clickmill.functions import text, timebin, vectors
from clickmill.operators import features, interactions, popularity, report, temporal, vocab
from clickmill.session import distinct_values, materialize, scratch_root
from clickmill.sources import readers

DAY = dt.datetime(2019, 11, 15)
LOG = "impression_id bigint, user_id string, time timestamp_ntz, history string, impressions string"


@pytest.fixture(scope="module")
def news(spark):
    rows = [("N1", "a", "a1", "one", None), ("N2", "b", "b1", "two", "text"), ("N3", "b", "b2", "three", "text")]
    return spark.createDataFrame(rows, "news_id string, category string, sub_category string, title string, abstract string")


@pytest.fixture(scope="module")
def behaviors(spark):
    h = dt.timedelta(hours=1)
    rows = [
        (1, "U1", DAY + 2 * h, None, "N1-0 N2-1"),
        (2, "U1", DAY + 3 * h, "N1 N1", "N2-1"),
        (3, "U1", DAY + 4 * h, "N1 N1", None),
        (4, "U2", DAY + 5 * h, None, ""),
        (5, "U3", DAY + 6 * h, "N3", "N1 N999-1 N3-0"),
    ]
    return spark.createDataFrame(rows, LOG)


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_first_history_counts_once(behaviors, news):
    assert as_dict(popularity.article_history(behaviors, news), "news_id", "popularity_history") == {
        "N1": 2, "N2": 0, "N3": 1}


def test_clicks_skip_malformed_and_empty(behaviors, news):
    assert as_dict(popularity.article_clicks(behaviors, news), "news_id", "popularity_impression") == {
        "N1": 0, "N2": 2, "N3": 0}


def test_both_counts_in_one_pass(behaviors, news):
    rows = popularity.article_popularity(behaviors, news).collect()
    assert {r["news_id"]: (r["popularity_impression"], r["popularity_history"]) for r in rows} == {
        "N1": (0, 2), "N2": (2, 0), "N3": (0, 1)}


def test_unknown_articles_are_dropped_and_reported(behaviors, news):
    events = interactions.interaction_events(behaviors)
    assert as_dict(interactions.unknown_articles(events, news), "news_id", "events") == {"N999": 1}
    assert "N999" not in {r["news_id"] for r in interactions.with_article(events, news).collect()}


def test_literal_scores(behaviors, news):
    rows = interactions.decompose_interactions(behaviors, news, label_mode="zero").collect()
    assert {(r["interaction_type"], r["score"]) for r in rows} == {("history", 1), ("impression", 0)}
    with pytest.raises(ValueError):
        interactions.interaction_events(behaviors, "other")


def test_wide_and_union_tables_agree(behaviors, news):
    popular = popularity.article_popularity(behaviors, news)
    wide = {tuple(r) for r in popularity.category_wide(popular, ["a", "b"]).collect()}
    union = {tuple(r) for r in popularity.category_wide_by_union(popular, ["a", "b"]).collect()}
    assert wide == union == {("impressions", 0, 2), ("history", 2, 1)}


def test_counts_per_impression_keep_empty_rows(behaviors, news):
    rows = {r["impression_id"]: r for r in popularity.interaction_counts(behaviors, news, ["a", "b"]).collect()}
    assert len(rows) == 5
    assert (rows[2]["a_history"], rows[2]["b_impression"]) == (2, 1)
    assert (rows[4]["a_history"], rows[4]["b_impression"]) == (0, 0)


HOURS = [
    (DAY, "01"),
    (DAY + dt.timedelta(microseconds=1), "01"),
    (DAY + dt.timedelta(hours=1), "01"),
    (DAY + dt.timedelta(hours=1, seconds=1), "02"),
    (DAY + dt.timedelta(hours=23, minutes=30), "00"),
    (DAY + dt.timedelta(days=1), "00"),
    (DAY - dt.timedelta(seconds=1), None),
    (DAY + dt.timedelta(days=1, microseconds=1), None),
]


def test_right_closed_hours(spark):
    df = spark.createDataFrame(HOURS, "ts timestamp_ntz, want string")
    rows = df.withColumn("got", timebin.end_hour(F.col("ts"))).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    assert timebin.hour_spine(spark).count() == 25
    assert timebin.hour_labels(spark).count() == 24


def test_raw_time_format(spark):
    df = spark.createDataFrame([("11/15/2019 9:05:58 PM",), ("junk",)], "t string")
    got = [r[0] for r in df.select(timebin.parse_time("t")).collect()]
    assert got == [dt.datetime(2019, 11, 15, 21, 5, 58), None]


def test_empty_hours_have_null_shares(behaviors, news):
    counts = temporal.hourly_counts(interactions.clicks(behaviors, ["time"]), news)
    rows = temporal.hourly_shares(temporal.on_all_hours(counts, ["a", "b"])).collect()
    assert len(rows) == 48
    assert {r["share"] for r in rows if r["hour"] == "07"} == {None}
    assert {r["category"]: r["share"] for r in rows if r["hour"] == "02"} == {"a": 0.0, "b": 1.0}


def test_even_median_and_zero_user(spark):
    rows = [("U1", t, "a", "x", s) for t, s in (("01", 1), ("02", 0), ("03", 1), ("10", 0))]
    rows += [("U2", None, "a", "x", 0)]
    df = spark.createDataFrame(rows, "user_id string, time string, category string, sub_category string, score int")
    assert as_dict(features.median_hours(df), "user_id", "median_hour") == {"U1": 2.5, "U2": None}
    users = {r["user_id"]: r for r in features.user_features(df, ["a", "b"], ["x"]).collect()}
    assert (users["U1"]["cat__a"], users["U1"]["cat__b"], users["U1"]["sub__x"]) == (1.0, 0.0, 1.0)
    assert (users["U2"]["cat__a"], users["U2"]["sub__x"]) == (0.0, 0.0)
    assert [r["user_id"] for r in features.users_without_positive(df).collect()] == ["U2"]


def test_update_ratio(spark):
    df = spark.createDataFrame(
        [([0.0, 1.0], [0.0, 2.0]), ([1.0], [0.0]), ([3.0, -1.0], [2.0, -4.0])], "x array<double>, y array<double>")
    got = [r[0] for r in df.select(vectors.largest_update(F.col("x"), F.col("y"))).collect()]
    assert got == [0.5, vectors.MAX_DOUBLE, 0.75]
    got = [r[0] for r in df.select(vectors.largest_update(F.col("x"), F.col("y"), relative=False)).collect()]
    assert got == [1.0, 1.0, 3.0]


def test_repeats(spark):
    df = spark.createDataFrame([("u", 1, "02"), ("u", 1, "01"), ("v", 1, "05")], "user string, n int, time string")
    assert {tuple(r) for r in interactions.without_repeats(df).collect()} == {("u", 1, "01"), ("v", 1, "05")}
    assert tuple(interactions.repeats_removed(df).first()) == (3, 2, 1)


def test_text_tokens(spark):
    df = spark.createDataFrame([("  The  cat's é_1 a\tbig ", None)], "a string, b string")
    row = df.select(
        text.split_tokens("a").alias("plain"), text.words(F.col("a")).alias("words"),
        text.plain_words(F.col("a")).alias("bare"), text.joined_text(["b", "a"]).alias("joined")).first()
    assert row["plain"] == ["The", "cat's", "é_1", "a", "big"]
    assert row["words"] == ["the", "cat", "é_1", "big"]
    assert row["bare"] == ["the", "cats", "é1", "a", "big"]
    assert row["joined"].startswith(" .   The")


def test_lists_as_text(spark):
    df = spark.createDataFrame([("[1, 2.5]", "['a', 'b']")], "n string, s string")
    assert df.select(text.parse_number_list("n")).first()[0] == [1.0, 2.5]
    assert report.feature_label(df, "s").first()["s"] == "a, b"


def test_vocabulary_limits(spark):
    df = spark.createDataFrame([(t,) for t in "bbbaac"], "w string")
    full = as_dict(vocab.frequency_vocabulary(df, "w"), "token", "idx")
    assert full == {"b": 1, "a": 2, "c": 3}
    head = vocab.frequency_vocabulary(df, "w", max_tokens=3, first_index=2)
    assert as_dict(head, "token", "idx") == {"b": 2}
    looked = vocab.lookup(spark.createDataFrame([("a",), ("z",), (None,)], "w string"), "w", vocab.sorted_vocabulary(df, "w"))
    assert sorted(r["idx"] for r in looked.collect()) == [0, 0, 1]


def test_scaling_extremes(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "x double")
    assert [r["b"] for r in vocab.equal_width_bucket(df, "x", 10, "b").orderBy("x").collect()] == [1, 6, 11]
    flat = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert {r["z"] for r in vocab.standardised(flat, "x", "z").collect()} == {None}


def test_wide_columns_are_bounded(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("v"))
    with pytest.raises(ValueError):
        distinct_values(df, "v", limit=10)


def test_scratch_folder_comes_from_the_session():
    def session(master, folder):
        context = SimpleNamespace(master=master, applicationId=f"{master}-{folder}")
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=context)

    assert scratch_root(session("yarn", "hdfs://shared/tmp/")) == "hdfs://shared/tmp"
    with pytest.raises(RuntimeError):
        scratch_root(session("yarn", None))


def test_scratch_folder(spark):
    root = scratch_root(spark)
    stored = materialize(spark.range(5), "probe")
    assert stored.count() == 5
    assert stored.inputFiles()[0].replace("file://", "").startswith(root)


def test_catalogue_fields_may_hold_line_ends(spark, tmp_path):
    path = tmp_path / "news.tsv"
    path.write_text('N1\tsports\tgolf\t"A ""long""\ntitle"\tshort\turl\t[]\t[]\nN2\tnews\tworld\tplain\t\turl\t[]\t[]\n')
    rows = {r["news_id"]: r for r in readers.news_tsv(spark, str(path)).collect()}
    assert set(rows) == {"N1", "N2"}
    assert rows["N1"]["title"] == 'A "long"\ntitle' and rows["N2"]["abstract"] is None
    assert readers.news_tsv(spark, str(path), multi_line=False).count() == 3
