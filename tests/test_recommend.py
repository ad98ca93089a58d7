"""Fallbacks and boosts of the recommender."""

import pytest

from clickmill.operators import recommend as rc


@pytest.fixture(scope="module")
def pairs(spark):
    candidates = spark.createDataFrame(
        [("fresh", 1), ("fresh", 2), ("done", 1), ("done", 2)], "user_id string, item int")
    seen = spark.createDataFrame(
        [("fresh", 1), ("done", 1), ("done", 2), ("quiet", 3)], "user_id string, item int")
    users = spark.createDataFrame([("fresh",), ("done",), ("quiet",), ("new",)], "user_id string")
    return candidates, seen, users


def as_set(df):
    return {(r["user_id"], r["item"]) for r in df.collect()}


def test_recommendable(pairs):
    candidates, seen, users = pairs
    assert as_set(rc.recommendable(candidates, seen, users)) == {("fresh", 2), ("done", 1), ("done", 2)}
    got = as_set(rc.recommendable(candidates, seen, users, fallback=[7, 8]))
    assert got == {("fresh", 2), ("done", 1), ("done", 2), ("new", 7), ("new", 8)}


def test_plain_anti_join(pairs):
    candidates, seen, _ = pairs
    assert as_set(rc.without_seen(candidates, seen)) == {("fresh", 2)}


def test_boosts(spark):
    cols = ["cat__a", "cat__b"]
    df = spark.createDataFrame([("u", [0.25, 0.75])], "user_id string, features array<double>")
    assert rc.boosted_users(df, cols, {"cat__b": 2.0}).first()["features"] == [0.25, 1.25]
    assert rc.boosted_items(df, cols, {"cat__b": 2.0}).first()["features"] == [0.25, 1.5]
    assert rc.boosted_items(df, cols, {}).first()["features"] == [0.25, 0.75]


def test_weights_have_a_floor(spark):
    pairs = spark.createDataFrame([("u", 1)], "user_id string, item int")
    users = spark.createDataFrame([("u", [0.0, 0.0])], "user_id string, features array<double>")
    items = spark.createDataFrame([(1, [2.0, 3.0])], "item int, features array<double>")
    assert rc.preference_weights(pairs, users, items).first()["weight"] == pytest.approx(5 * rc.PREFERENCE_FLOOR)


def test_counts_all_recommended_clusters_per_mode(spark):
    recs = {
        "plain": spark.createDataFrame([("u", 1), ("v", 1)], "user_id string, item int"),
        "weighted": spark.createDataFrame([("u", 1), ("u", 2)], "user_id string, item int"),
    }
    labels = spark.createDataFrame([(f"N{i}", 1 + i % 2) for i in range(12)], "news_id string, cluster int")
    news = spark.createDataFrame([(f"N{i}", "odd" if i % 2 else "even") for i in range(12)], "news_id string, category string")
    got = rc.recommended_categories(recs, rc.cluster_members(labels), news).collect()
    assert {(r["mode"], r["category"]): r["value"] for r in got} == {
        ("plain", "even"): 8, ("weighted", "even"): 4, ("weighted", "odd"): 4}
