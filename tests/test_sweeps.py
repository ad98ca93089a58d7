"""Keyed sweeps against one set at a time, against all distances, and on odd rows."""

import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from clickmill.operators import cluster, reduce, sweeps

SETS = [("plain", 3), ("plain", 5), ("wide", 4)]


@pytest.fixture(scope="module")
def points(spark):
    """A third of the plain points are copies of one; the wide space has three components, far out."""
    rng = np.random.default_rng(3)
    plain = np.vstack([np.tile([0.5, 0.5], (20, 1)), rng.normal(size=(40, 2))])
    wide = 1e4 + rng.normal(size=(50, 3))

    def frame(x):
        return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")

    return sweeps.stacked({"plain": frame(plain), "wide": frame(wide)}, "id"), {"plain": plain, "wide": wide}


def by_set(rows):
    out = {}
    for r in rows.collect():
        out.setdefault((r["space"], r["k"]), {})[r["id"]] = r["cluster"]
    return out


def silhouette(x, labels):
    far = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    out = []
    for i, c in enumerate(labels):
        own = labels == c
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = far[i][own].sum() / (own.sum() - 1)
        b = min(far[i][labels == o].mean() for o in set(labels) - {c})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


def test_one_scan_gives_what_single_fits_give(spark, points):
    table, _ = points
    got = by_set(sweeps.sweep_labels(table, "id", SETS, sweeps.fitted_centres(table, "id", SETS, 4)))
    assert set(got) == set(SETS)
    for space, k in SETS:
        alone = cluster.lloyd_labels(table.where(F.col("space") == space), "id", "vector", k, 4)
        assert got[space, k] == {r["id"]: r["cluster"] for r in alone.collect()}


def test_scores_equal_all_distances_and_the_library(spark, points):
    table, raw = points
    centres = sweeps.fitted_centres(table, "id", SETS, 4)
    labels = by_set(sweeps.sweep_labels(table, "id", SETS, centres))
    scores = {(r["space"], r["k"]): r for r in sweeps.sweep_scores(table, SETS, centres).collect()}
    for space, k in SETS:
        mine = np.array([labels[space, k][i] for i in range(len(raw[space]))])
        row = scores[space, k]
        assert row["silhouette"] == pytest.approx(silhouette(raw[space], mine), abs=1e-9)
        sizes = np.bincount(mine)
        assert (row["clusters"], row["largest"], row["points"]) == ((sizes > 0).sum(), sizes.max(), len(mine))
    rows = spark.createDataFrame(
        [(raw["plain"][i].tolist(), c) for i, c in labels["plain", 3].items()], "v array<double>, cluster long")
    library = ClusteringEvaluator(featuresCol="x", predictionCol="cluster").evaluate(
        rows.withColumn("x", array_to_vector("v")))
    assert scores["plain", 3]["silhouette"] == pytest.approx(library, abs=1e-9)


def test_odd_rows(spark):
    rows = [("a", 1, [0.0, 0.0]), ("a", 1, [0.0, 0.0]), ("a", 2, [4.0, 0.0]), ("a", 3, None), ("a", 4, [1.0, None]),
            ("a", 5, [float("nan"), 1.0]), ("a", None, [4.0, 1.0]), ("b", 7, [2.0]), ("c", 8, None)]
    table = spark.createDataFrame(rows, "space string, id long, vector array<double>")
    sets = [("a", 2), ("a", 9), ("b", 1), ("c", 2), ("absent", 3)]
    centres = sweeps.fitted_centres(table, "id", sets, 2)
    assert [len(c) for c in centres] == [2, 4, 1, 0, 0]
    labels = sweeps.sweep_labels(table, "id", sets, centres)
    got = labels.groupBy("space", "k").agg(F.count("*").alias("n"), F.count("cluster").alias("m")).collect()
    assert {(r["space"], r["k"]): (r["n"], r["m"]) for r in got} == {
        ("a", 2): (7, 4), ("a", 9): (7, 4), ("b", 1): (1, 1), ("c", 2): (1, 0)}
    scores = {(r["space"], r["k"]): r for r in sweeps.sweep_scores(table, sets, centres).collect()}
    assert scores["b", 1]["silhouette"] is None and scores["c", 2]["clusters"] == 0
    assert scores["a", 2]["points"] == 4 and scores["absent", 3]["points"] == 0


def test_a_vector_of_another_length_gets_no_label(spark):
    rows = [("a", i, [float(i), 0.0]) for i in range(6)] + [("a", 9, [1.0])]
    table = spark.createDataFrame(rows, "space string, id long, vector array<double>")
    centres = [np.array([[0.0, 0.0], [5.0, 0.0]])]
    got = by_set(sweeps.sweep_labels(table, "id", [("a", 2)], centres))["a", 2]
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 9: None}


def test_empty_table(spark):
    table = spark.createDataFrame([], "space string, id long, vector array<double>")
    centres = sweeps.fitted_centres(table, "id", SETS, 2)
    assert sweeps.sweep_labels(table, "id", SETS, centres).count() == 0
    assert [r["points"] for r in sweeps.sweep_scores(table, SETS, centres).collect()] == [0, 0, 0]


def test_jobs_do_not_grow_with_the_sets(spark, points):
    table, _ = points
    tracker = spark.sparkContext.statusTracker()

    def jobs(sets, tag):
        spark.sparkContext.setJobGroup(tag, tag)
        sweeps.fitted_centres(table, "id", sets, 3)
        return len(tracker.getJobIdsForGroup(tag))

    few, many = jobs(SETS[:1], "few"), jobs([("plain", k) for k in range(2, 14)], "many")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < few and many <= few + 1


def test_density_of_each_space(spark, points):
    table, _ = points
    sets = [("plain", 0.4, 4, 6), ("plain", 0.2, 3, 3)]
    got = {}
    for r in sweeps.density_sweep(table, "id", 2, sets).collect():
        got.setdefault(r["eps"], {})[r["id"]] = r["cluster"]
    assert set(got) == {0.4, 0.2}
    for eps, labels in got.items():
        assert len(labels) == 60 and len({labels[i] for i in range(20)}) == 1 and labels[0] >= 0


def test_components_hold_the_whole_spread(spark):
    """Variances over all axes add up, fall, and each axis has its largest loading positive."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(120, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    axes = np.array(reduce.principal_axes(df, "v", 4))
    spread = (x @ axes.T).var(axis=0)
    assert np.isclose(spread.sum(), x.var(axis=0).sum()) and (np.diff(spread) <= 1e-12).all()
    assert all(a[np.abs(a).argmax()] > 0 for a in axes)
