"""Row numbers with a hot key, and splits that rest on them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clickmill.operators import ranking, sequences, splits
from clickmill.operators.ratings import index_sets, rating_lists, rating_rows


@pytest.fixture(scope="module")
def hot(spark):
    """Half of all rows share one key."""
    rng = np.random.default_rng(3)
    n = 4000
    key = np.where(rng.random(n) < 0.5, "hot", rng.integers(0, 200, n).astype(str))
    pdf = pd.DataFrame({"key": key, "score": rng.integers(0, 7, n), "id": rng.permutation(n)})
    return pdf, spark.createDataFrame(pdf).repartition(7)


def test_global_row_number(hot):
    pdf, df = hot
    got = ranking.global_row_number(df, [F.desc("score"), "id"]).toPandas().sort_values("row_num")
    want = pdf.sort_values(["score", "id"], ascending=[False, True])
    assert got["row_num"].tolist() == list(range(1, len(pdf) + 1))
    assert got["id"].tolist() == want["id"].tolist()


@pytest.mark.parametrize("local_rows", [0, 100, 100_000])
def test_group_row_number(hot, local_rows):
    """By windows, by ranges, and the hot key alone by ranges."""
    pdf, df = hot
    got = ranking.group_row_number(df, ["key"], ["score", "id"], local_rows=local_rows).toPandas()
    want = pdf.sort_values(["key", "score", "id"])
    want["row_num"] = want.groupby("key").cumcount() + 1
    merged = got.merge(want, on=["key", "score", "id"], suffixes=("", "_want"))
    assert len(merged) == len(pdf)
    assert (merged["row_num"] == merged["row_num_want"]).all()


def test_hot_key_spans_partitions(hot):
    _, df = hot
    session = df.sparkSession
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored = ranking._stored_in_order(df, ["key", "score", "id"])
        assert stored.where("key = 'hot'").select("_part").distinct().count() > 2
        placed = ranking.group_row_number(
            df, ["key"], ["score", "id"], size="n", local_rows=100).where("key = 'hot'")
        low, high, n, size = placed.agg(
            F.min("row_num"), F.max("row_num"), F.countDistinct("row_num"), F.max("n")).first()
        assert (low, high, n) == (1, size, size)
    finally:
        session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("n", [3, 1500])
def test_top_n_per_group(hot, n):
    pdf, df = hot
    got = ranking.top_n_per_group(df, ["key"], [F.desc("score"), F.col("id")], n).toPandas()
    want = pdf.sort_values(["score", "id"], ascending=[False, True]).groupby("key").head(n)
    assert sorted(got["id"]) == sorted(want["id"])


def test_row_chunks_like_ntile(hot):
    pdf, df = hot
    odd = df.where("id < 3999")
    sizes = ranking.row_chunks(odd, ["id"], 4).groupBy("chunk").agg(
        F.count("*").alias("n"), F.min("id").alias("lo")).orderBy("chunk").collect()
    assert [r["n"] for r in sizes] == [1000, 1000, 1000, 999]
    assert [r["lo"] for r in sizes] == [0, 1000, 2000, 3000]


def test_shuffled_take_is_exact_and_disjoint(hot):
    _, df = hot
    parts = splits.split_counts(df, "id", 1234, 766)
    sizes = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"train": 1234, "test": 766}
    assert parts.select("id").distinct().count() == 2000


@pytest.mark.parametrize("skip, n, want", [(0, 0, 0), (0, 4000, 4000), (0, 9999, 4000), (3990, 50, 10), (5000, 5, 0), (17, 1, 1)])
def test_shuffled_take_at_the_ends(hot, skip, n, want):
    _, df = hot
    assert splits.shuffled_take(df, "id", n, skip).count() == want


def test_takes_tile_the_table(hot):
    _, df = hot
    parts = [splits.shuffled_take(df, "id", 700, skip) for skip in range(0, 4000, 700)]
    ids = [r["id"] for part in parts for r in part.collect()]
    assert sorted(ids) == list(range(4000))


def test_splits_do_not_depend_on_partitions(hot):
    _, df = hot

    def ids(frame):
        return {r["id"] for r in splits.shuffled_take(frame, "id", 500, 250).collect()}

    assert ids(df.repartition(1)) == ids(df.repartition(8))

    def tests(frame):
        return {r["id"] for r in splits.split_share(frame, "id", 0.4).where("part = 'test'").collect()}

    assert tests(df.repartition(1)) == tests(df.repartition(8))


def test_rating_rows_and_lists(hot):
    pdf, df = hot
    rows = df.select(F.col("key").alias("user_id"), F.col("id").alias("news_id"), "score")
    placed = rating_rows(rows, ["news_id"])
    got = placed.toPandas()
    hot_rows = got[got["user_id"] == "hot"].sort_values("position")
    assert hot_rows["position"].tolist() == list(range(len(hot_rows)))
    assert hot_rows["news_id"].tolist() == sorted(pdf.loc[pdf["key"] == "hot", "id"])
    lists = rating_lists(placed).toPandas()
    assert all(len(a) == len(b) for a, b in zip(lists["news_id"], lists["scores"]))
    assert list(lists.loc[lists["user_id"] == "hot", "news_id"].iloc[0]) == hot_rows["news_id"].tolist()


def test_index_sets(hot):
    pdf, df = hot
    sets = index_sets(df, "key", "id").toPandas()
    for key in ("hot", "17"):
        got = sets[sets["key"] == key].sort_values("position")["id"].tolist()
        assert got == sorted(set(pdf.loc[pdf["key"] == key, "id"]))


def test_chunked_timelines_equal_whole_ones(hot):
    _, df = hot

    def examples(chunk_rows):
        rows = sequences.next_item_examples(
            df.withColumn("id", F.col("id").cast("string")), "key", ["score", "id"], "id",
            {"id": F.lit("0")}, chunk_rows=chunk_rows)
        return sorted(map(str, rows.collect()))

    assert examples(50) == examples(100_000)


def test_sequence_padding(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, None), (3, list("abcdefghijkl"))], "id int, c array<string>")
    got = {r["id"]: r["c"] for r in sequences.with_defaults(df, {"c": F.lit("x")}).collect()}
    assert got[1] == ["a", "b"] + ["x"] * 8
    assert got[2] == ["x"] * 10
    assert got[3] == list("abcdefghij")
