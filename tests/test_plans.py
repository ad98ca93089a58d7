"""Shape of the physical plans."""

import pytest
from pyspark.sql import functions as F

from clickmill.operators import features, popularity, sequences
from clickmill.operators.interactions import first_history
from clickmill.operators.ranking import top_n_per_group
from clickmill.plans import registry
from clickmill.plans.fixtures import Tables
from clickmill.session import materialize

SF_DIR = "/root/testdata/sf0.001"
registry.load_all()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


QUICK = [
    "rsh_1_interactions", "agg_1_article_clicks", "agg_5_counts_per_impression", "agg_6_hourly_totals",
    "dt_4_hourly_clicks", "fea_2_user_features", "nrm_1_standardised", "voc_1_sorted_vocabulary",
    "txt_2_tf_idf", "rec_5_hybrid_top_n", "rec_9_top_predicted", "knn_3_both_sides_large",
    "spl_1_exact_counts", "agg_14_index_sets", "fm_3_scores",
]


@pytest.mark.parametrize("name", QUICK)
def test_no_cross_joins(spark, name):
    text = plan(registry.QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_rank_filter_is_applied_before_the_shuffle(spark):
    t = Tables(spark, SF_DIR)
    text = plan(first_history(t.behaviors))
    assert text.count("WindowGroupLimit") == 2
    text = plan(top_n_per_group(t.interactions, ["news_id"], [F.col("ts"), F.col("pos")], 3))
    assert text.count("WindowGroupLimit") == 2


def test_scan_reads_only_the_needed_columns(spark):
    t = Tables(spark, SF_DIR)
    text = plan(popularity.article_clicks(t.behaviors, t.news))
    assert "ReadSchema: struct<impressions:string>" in text
    text = plan(registry.QUERIES["flt_3_rows_with_history"](spark, SF_DIR))
    assert "PushedFilters: [IsNotNull(history)]" in text


def test_popularity_is_counted_before_the_join(spark):
    t = Tables(spark, SF_DIR)
    text = plan(popularity.article_popularity(t.behaviors, t.news))
    assert "partial_count" in text
    assert text.index("Join") < text.index("HashAggregate")


def test_no_predicate_per_value(spark):
    """Wide counts are pivoted from counts per key and value."""
    t = Tables(spark, SF_DIR)
    many = [f"v{n}" for n in range(50)]
    for text in (
        plan(features.taste_profile(t.interactions, many, many)),
        plan(popularity.interaction_counts(t.behaviors, t.news, many)),
    ):
        assert "count_if" not in text and "CASE WHEN" not in text and "pivotfirst" in text


def test_only_positive_interactions_carry_values(spark):
    """Others keep their user by one nameless row, so counts shuffle what is positive; all users stay."""
    events = spark.createDataFrame(
        [("u1", "a", "x", 1), ("u1", "b", "y", 0), ("u2", "a", "y", 0), ("u2", "b", "x", None), ("u3", "b", "y", 1),
         ("u3", "b", "x", 1)], "user_id string, category string, sub_category string, score int")
    named = {(r.user_id, r.name) for r in features.taste_counts(events).where("name is not null").collect()}
    assert named == {("u1", "cat__a"), ("u1", "sub__x"), ("u3", "cat__b"), ("u3", "sub__y"), ("u3", "sub__x")}
    wide = {tuple(r) for r in features.taste_profile(events, ["a", "b"], ["x", "y"]).collect()}
    assert wide == {("u1", 1, 0, 1, 0), ("u2", 0, 0, 0, 0), ("u3", 0, 2, 1, 1)}


def test_interactions_hold_no_list(spark):
    text = plan(Tables(spark, SF_DIR)._interactions())
    assert "collect_list" not in text and "split(" not in text


def test_interactions_travel_by_number(spark):
    """Rows meet orders and articles by numeric keys, once each; texts are no part of them."""
    t = Tables(spark, SF_DIR)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(t._interactions())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "p_name" not in text and text.count("hashpartitioning(l_orderkey") == 1
    assert text.count("Exchange hashpartitioning(news_id") == 2  # the events and the articles
    assert {"title", "abstract"} & set(t.interactions.columns) == set()
    assert t.described.count() == t.interactions.count()


def test_sequence_contexts_take_one_exchange(spark):
    t = Tables(spark, SF_DIR)
    ratings = materialize(t.movie_ratings, "ratings")
    found = sequences.next_item_examples(
        ratings, "user_id", ["timestamp", "rating_id"], "movie_id", {"movie_year": F.lit(0)})
    assert plan(found).count("Exchange") == 1
