"""Neighbour search against brute force, with copies and crowded cells."""

from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from clickmill.operators import knn, retrieval
from clickmill.session import scratch_root


def brute(q_ids, q, c_ids, c, k, metric, exclude_self):
    out = {}
    for i, a in zip(q_ids, q):
        scored = []
        for j, b in zip(c_ids, c):
            if exclude_self and i == j:
                continue
            if metric == "dot":
                cost = -float((a * b).sum())
            elif metric == "cosine":
                a1, b1 = a / np.linalg.norm(a), b / np.linalg.norm(b)
                cost = float(np.sqrt(((a1 - b1) ** 2).sum()))
            elif metric == "hellinger":
                a1, b1 = np.sqrt(np.abs(a) / np.abs(a).sum()), np.sqrt(np.abs(b) / np.abs(b).sum())
                cost = float(np.sqrt(((a1 - b1) ** 2).sum()))
            else:
                cost = float(np.sqrt(((a - b) ** 2).sum()))
            scored.append((round(cost, knn.DIGITS), j))
        out[i] = [j for _, j in sorted(scored)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["id"], r["rank"])):
        out.setdefault(r["id"], []).append(r["neighbor"])
    return out


def frame(spark, ids, vectors):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)], "id bigint, vector array<double>")


@pytest.fixture(scope="module")
def cloud():
    """A third of the rows are copies of one vector, another third sits in one tight crowd."""
    rng = np.random.default_rng(5)
    copies = np.tile(rng.normal(size=6), (80, 1))
    crowd = rng.normal(size=6) + 0.01 * rng.normal(size=(80, 6))
    rest = rng.normal(size=(80, 6))
    x = np.vstack([copies, crowd, rest])
    order = rng.permutation(len(x))
    return np.arange(len(x)), x[order]


@pytest.mark.parametrize("metric", ["euclidean", "dot", "cosine", "hellinger"])
@pytest.mark.parametrize("small_side", [None, 0])
def test_equals_brute_force(spark, cloud, metric, small_side):
    ids, x = cloud
    df = frame(spark, ids, x)
    got = found(knn.nearest(
        df, df, 4, metric, exclude_self=True, small_side=small_side, pivot_count=8, block_rows=32))
    assert got == brute(ids, x, ids, x, 4, metric, True)


@pytest.mark.parametrize("small_side", [None, 0])
def test_two_tables(spark, cloud, small_side):
    ids, x = cloud
    rng = np.random.default_rng(8)
    q_ids, q = np.arange(1000, 1030), rng.normal(size=(30, 6))
    got = found(knn.nearest(
        frame(spark, q_ids, q), frame(spark, ids, x), 7, small_side=small_side, pivot_count=5, block_rows=50))
    assert got == brute(q_ids, q, ids, x, 7, "euclidean", False)


@pytest.mark.parametrize("small_side", [None, 0])
def test_fewer_candidates_than_k(spark, small_side):
    df = frame(spark, [1, 2, 3], [[0.0], [1.0], [5.0]])
    got = found(knn.nearest(df, df, 10, exclude_self=True, small_side=small_side))
    assert got == {1: [2, 3], 2: [1, 3], 3: [2, 1]}


def test_string_ids(spark):
    df = spark.createDataFrame([("a", [0.0]), ("b", [1.0]), ("c", [1.5])], "id string, vector array<double>")
    for small in (None, 0):
        got = found(knn.nearest(df, df, 1, exclude_self=True, small_side=small))
        assert got == {"a": ["b"], "b": ["c"], "c": ["b"]}


def test_top_k_accuracy(spark):
    queries = frame(spark, [1, 2], [[1.0, 0.0], [0.0, 1.0]])
    candidates = frame(spark, [10, 11, 12], [[3.0, 1.0], [2.0, 2.0], [1.0, 3.0]])
    positives = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 12)], "query_id bigint, candidate_id bigint")
    rows = retrieval.top_k_accuracy(positives, queries, candidates, [1, 2, 5]).collect()
    assert {r["metric"]: r["accuracy"] for r in rows} == {"top_1": 0.5, "top_2": 0.75, "top_5": 1.0}


def test_pairs_grow_like_the_root_of_all_pairs(spark):
    """Ten times the rows: less than forty times the scored pairs, and still the brute-force result."""
    rng = np.random.default_rng(2)
    counts = []
    for n in (300, 3000):
        x = rng.normal(size=(n, 3))
        meter = spark.sparkContext.accumulator(0)
        got = found(knn.nearest(
            frame(spark, range(n), x), frame(spark, range(n), x), 3, exclude_self=True, small_side=0, block_rows=64,
            meter=meter))
        counts.append(meter.value)
        asked = range(0, n, 50)
        assert {i: got[i] for i in asked} == brute(asked, x[::50], range(n), x, 3, "euclidean", True)
    assert 0 < counts[1] < 40 * counts[0] and counts[1] < 3000 * 3000 / 4


@pytest.mark.parametrize("metric", ["euclidean", "dot"])
def test_cells_by_the_root_of_the_rows(spark, cloud, metric):
    ids, x = cloud
    df = frame(spark, ids, x)
    got = found(knn.nearest(df, df, 6, metric, exclude_self=True, small_side=0, block_rows=16))
    assert got == brute(ids, x, ids, x, 6, metric, True)


@pytest.mark.parametrize("metric", ["euclidean", "dot", "cosine", "hellinger"])
def test_several_shelves(spark, cloud, metric):
    """Cells on shelves of 20 rows, crowded cells over several of them."""
    ids, x = cloud
    df = frame(spark, ids, x)
    got = found(knn.nearest(
        df, df, 4, metric, exclude_self=True, small_side=0, pivot_count=6, block_rows=16, shelf_rows=20))
    assert got == brute(ids, x, ids, x, 4, metric, True)


def test_what_is_stored_grows_with_the_rows_not_with_the_cells(spark):
    """In many dimensions hardly a cell is ruled out; no vector is stored once per cell for that."""
    rng = np.random.default_rng(4)
    n, dim = 900, 64
    x = rng.normal(size=(n, dim))
    folder = Path(scratch_root(spark))

    def vectors_held():
        files = [pq.ParquetFile(f) for f in folder.rglob("*.parquet")]
        return sum(f.metadata.num_rows for f in files if "vector" in f.schema_arrow.names)

    before = vectors_held()
    got = found(knn.nearest(frame(spark, range(n), x), frame(spark, range(n), x), 3, exclude_self=True, small_side=0))
    assert vectors_held() - before < 10 * n
    asked = range(0, n, 50)
    assert {i: got[i] for i in asked} == brute(asked, x[::50], range(n), x, 3, "euclidean", True)


def test_what_travels_grows_with_the_root_of_the_tasks(spark, monkeypatch):
    """Shelves times packs are the tasks; each vector goes to as many of them as there are of the other kind."""
    monkeypatch.setattr(knn, "SMALL_SHELF_BYTES", 1)
    rng = np.random.default_rng(5)
    rows = frame(spark, range(600), rng.normal(size=(600, 8))).select(F.col("id").alias("cid"), "vector")
    cells = knn._Cells(rows, "euclidean", None, None)
    assert 4 <= cells.shelves <= 8 and cells.shelf_rows == 100


@pytest.mark.parametrize("metric", ["euclidean", "dot"])
@pytest.mark.parametrize("shift, scale", [(0.0, 1.0), (1e6, 1.0), (0.0, 1e-9), (0.0, 1e20), (3.0, 1e-3)])
def test_single_precision_shortlist_loses_nothing(metric, shift, scale):
    """Far from the origin, tiny, beyond single precision, and in ties the k best are those of all pairs."""
    rng = np.random.default_rng(5)
    c = (rng.integers(0, 4, (3000, 6)) / 3 + rng.random((3000, 6)) * 1e-7 * (rng.random((3000, 1)) < 0.5)) * scale + shift
    q, ids = c[rng.permutation(3000)[:300]] + 0.01 * scale, rng.permutation(3000)
    rows, at, cost = knn._best(q, c, ids, 4, metric)
    full = -(q @ c.T) if metric == "dot" else None
    for n in range(len(q)):
        own = np.sqrt(((q[n] - c) ** 2).sum(axis=1)) if full is None else -(q[n] * c).sum(axis=1)
        want = np.lexsort((ids, np.round(own, knn.DIGITS)))[:4]
        assert at[rows == n].tolist() == want.tolist()


def test_products_are_of_single_precision():
    x = np.random.default_rng(6).random((50, 8))
    best = knn._Best(x, x, np.arange(50), np.full(50, knn.NO_BOUND), 3, "euclidean")
    assert best.left.dtype == best.right.dtype == np.float32
