"""Properties of the fitted models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickmill.operators import cluster, factorize, fm, reduce, textvec


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(1)
    u, v = rng.uniform(0.5, 1.5, (20, 2)), rng.uniform(0.5, 1.5, (10, 2))
    dense = u @ v.T
    mask = rng.random(dense.shape) < 0.8
    cells = [(f"r{i}", f"c{j}", float(dense[i, j])) for i, j in zip(*np.nonzero(mask))]
    coo = spark.createDataFrame(cells, "row_id string, col_id string, rating double")
    rows = spark.createDataFrame([(f"r{i}",) for i in range(20)], "row_id string")
    cols = spark.createDataFrame([(f"c{j}",) for j in range(10)], "col_id string")
    return dense, mask, coo, rows, cols


def arrays(df, col, prefix, n):
    got = {r[col]: np.array(r["factors"]) for r in df.collect()}
    return np.stack([got[f"{prefix}{i}"] for i in range(n)])


def test_gradient_descent_like_numpy(planted):
    dense, mask, coo, rows, cols = planted
    rows, cols = factorize.start_factors(rows, "row_id", 3), factorize.start_factors(cols, "col_id", 3)
    u, v = arrays(rows, "row_id", "r", 20), arrays(cols, "col_id", "c", 10)
    fit = factorize.gradient_descent(coo, rows, cols, 3, rate=0.01, max_iterations=4, lam=0.1, threshold=1e-9)
    errors = []
    for _ in range(4):
        u = u + 0.01 * (((dense - u @ v.T) * mask) @ v - 0.1 * u)
        e = (dense - u @ v.T) * mask
        v = v + 0.01 * (e.T @ u - 0.1 * v)
        errors.append(np.sqrt((e[mask] ** 2).mean()))
    assert np.allclose(arrays(fit.rows, "row_id", "r", 20), u)
    assert np.allclose(arrays(fit.cols, "col_id", "c", 10), v)
    assert np.allclose(fit.rmse, errors)
    assert all(a >= b for a, b in zip(fit.rmse, fit.rmse[1:]))


def test_descent_stops_with_the_previous_factors(planted):
    _, _, coo, rows, cols = planted
    rows, cols = factorize.start_factors(rows, "row_id", 2), factorize.start_factors(cols, "col_id", 2)
    one = factorize.gradient_descent(coo, rows, cols, 2, rate=1e-7, max_iterations=1, lam=1.0)
    fit = factorize.gradient_descent(coo, rows, cols, 2, rate=1e-7, max_iterations=9, lam=1.0, threshold=1e-2)
    assert (len(fit.rmse), len(fit.updates)) == (1, 2)
    assert np.allclose(arrays(fit.rows, "row_id", "r", 20), arrays(one.rows, "row_id", "r", 20))


@pytest.mark.parametrize("summed, share_rows", [(10, 65_536), (0, 65_536), (0, 3)])
def test_least_squares_like_numpy(planted, spark, monkeypatch, summed, share_rows):
    monkeypatch.setattr(factorize, "SUMMED_FACTORS", summed)
    monkeypatch.setattr(factorize, "SHARE_ROWS", share_rows)
    dense, mask, coo, rows, cols = planted
    extra = rows.unionByName(spark.createDataFrame([("r20",)], "row_id string"))
    v0 = factorize.start_factors(cols, "col_id", 3)
    u0 = factorize.start_factors(extra, "row_id", 3)
    fit = factorize.alternating_least_squares(coo, u0, v0, 3, max_iterations=2, lam=0.5, threshold=1e-9)
    v = arrays(v0, "col_id", "c", 10)
    for _ in range(2):
        u = np.stack([
            np.linalg.solve(v[m].T @ v[m] + 0.5 * np.eye(3), v[m].T @ dense[i, m]) for i, m in enumerate(mask)])
        v = np.stack([
            np.linalg.solve(u[m].T @ u[m] + 0.5 * np.eye(3), u[m].T @ dense[m, j]) for j, m in enumerate(mask.T)])
    got = arrays(fit.rows, "row_id", "r", 21)
    assert np.allclose(got[:20], u)
    assert np.allclose(got[20], 0)
    assert np.allclose(arrays(fit.cols, "col_id", "c", 10), v)
    full = np.where(mask, dense, 0) - u @ v.T
    assert np.isclose(fit.rmse[-1], np.sqrt(((full**2).sum()) / (21 * 10)))


def test_alternation_lowers_the_penalised_error(planted):
    dense, mask, coo, rows, cols = planted
    losses = []
    for rounds in (1, 2, 4):
        start = factorize.start_factors(rows, "row_id", 2), factorize.start_factors(cols, "col_id", 2)
        fit = factorize.alternating_least_squares(coo, *start, 2, rounds, 0.1, threshold=0.0)
        u, v = arrays(fit.rows, "row_id", "r", 20), arrays(fit.cols, "col_id", "c", 10)
        losses.append((((dense - u @ v.T) * mask) ** 2).sum() + 0.1 * ((u**2).sum() + (v**2).sum()))
    assert losses[0] > losses[1] > losses[2]


def test_unknown_method(planted):
    _, _, coo, rows, cols = planted
    with pytest.raises(ValueError):
        factorize.factorize(coo, rows, cols, "other", 2, 1.0)


def test_machine_score_like_the_double_sum(spark):
    rng = np.random.default_rng(2)
    w, v = rng.normal(size=5), rng.normal(size=(5, 3))
    x = rng.normal(size=(7, 5)) * (rng.random((7, 5)) < 0.7)
    x[:, 0] = 1.0
    y = rng.normal(size=7)
    rows = spark.createDataFrame(
        [(i, str(j), float(x[i, j])) for i in range(7) for j in range(5) if x[i, j]], "id int, feature string, x double")
    params = spark.createDataFrame(
        [(str(j), float(w[j]), v[j].tolist()) for j in range(5)], "feature string, w double, v array<double>")
    got = {r["id"]: r["score"] for r in fm.fm_scores(rows, params, 0.3, "id", 3).collect()}

    def score(w0, w, v):
        pairs = [(a, b) for a in range(5) for b in range(a)]
        return w0 + x @ w + sum(x[:, a] * x[:, b] * (v[a] @ v[b]) for a, b in pairs)

    assert np.allclose([got[i] for i in range(7)], score(0.3, w, v))

    target = spark.createDataFrame([(i, float(y[i])) for i in range(7)], "id int, y double")
    moved, w0 = fm.fm_gradient_step(rows, target, params, 0.3, "id", "y", 3, 0.01)
    got = {r["feature"]: r for r in moved.collect()}

    def loss(w0, w, v):
        return ((y - score(w0, w, v)) ** 2).mean()

    h = 1e-6
    for j in range(5):
        dw = np.eye(5)[j] * h
        slope = (loss(0.3, w + dw, v) - loss(0.3, w - dw, v)) / (2 * h)
        assert np.isclose(got[str(j)]["w"], w[j] - 0.01 * slope, atol=1e-6)
        for f in range(3):
            dv = np.zeros((5, 3))
            dv[j, f] = h
            slope = (loss(0.3, w, v + dv) - loss(0.3, w, v - dv)) / (2 * h)
            assert np.isclose(got[str(j)]["v"][f], v[j, f] - 0.01 * slope, atol=1e-6)
    slope = (loss(0.3 + h, w, v) - loss(0.3 - h, w, v)) / (2 * h)
    assert np.isclose(w0.first()["w0"], 0.3 - 0.01 * slope, atol=1e-6)


def blobs(spark, sizes, spread=0.05, noise=0):
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for c, n in enumerate(sizes):
        for p in rng.normal([3.0 * c, -2.0 * c], spread, (n, 2)):
            rows.append((i, p.tolist(), c))
            i += 1
    for _ in range(noise):
        rows.append((i, [float(50 + 9 * i), 80.0], -1))
        i += 1
    return spark.createDataFrame(rows, "id int, embedding array<double>, blob int")


def test_density_labels_recover_blobs(spark):
    df = blobs(spark, [300, 100, 60, 20], noise=5)
    labels = cluster.density_labels(df, "id", 2, 0.2, min_samples=5, min_cluster_size=50).join(df, "id").toPandas()
    assert len(labels) == 485
    for blob in (0, 1, 2):
        inside = labels[labels["blob"] == blob]["cluster"].value_counts()
        assert inside.index[0] >= 0
        assert inside.iloc[0] >= 0.97 * inside.sum()
    assert labels[labels["blob"].isin([0, 1, 2])].groupby("blob")["cluster"].agg(lambda s: s.mode()[0]).nunique() == 3
    assert set(labels[labels["blob"].isin([3, -1])]["cluster"]) == {-1}


def test_density_follows_long_chains(spark):
    rows = [(i * 3 + j, [0.1 * i, 0.0]) for i in range(300) for j in range(3)]
    df = spark.createDataFrame(rows, "id int, embedding array<double>")
    labels = cluster.density_labels(df, "id", 2, 0.2, min_samples=3, min_cluster_size=50)
    assert {r["cluster"] for r in labels.select("cluster").distinct().collect()} == {0}


def test_kmeans_takes_the_nearest_centre(spark):
    df = blobs(spark, [50, 50, 50])
    labels = cluster.kmeans_labels(df, "id", 3).join(df.select("id", "blob"), "id").toPandas()
    assert labels.groupby("blob")["cluster"].nunique().tolist() == [1, 1, 1]
    x = np.stack(labels["embedding"])
    centres = np.stack([x[labels["cluster"] == c].mean(axis=0) for c in range(3)])
    nearest = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (nearest == labels["cluster"]).all()


def test_components_keep_the_main_direction(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 1)) @ np.array([[1.0, 2.0, 3.0]]) + 0.01 * rng.normal(size=(200, 3))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, f array<double>")
    flat = reduce.reduced(df, "id", "f", 1, "euclidean").toPandas().sort_values("id")
    got = np.stack(flat["embedding"])[:, 0]
    assert abs(np.corrcoef(got, x[:, 2])[0, 1]) > 0.999


def test_stored_embeddings_depend_on_their_parameters(spark, tmp_path):
    calls = []

    def compute(n):
        calls.append(n)
        return spark.range(n)

    folder = str(tmp_path)
    assert reduce.stored_or_computed(spark, folder, {"k": 1}, lambda: compute(3)).count() == 3
    assert reduce.stored_or_computed(spark, folder, {"k": 1}, lambda: compute(9)).count() == 3
    assert reduce.stored_or_computed(spark, folder, {"k": 2}, lambda: compute(4)).count() == 4
    assert calls == [3, 4]


def test_tf_idf_by_hand(spark):
    df = spark.createDataFrame([(1, "red red ball"), (2, "blue ball"), (3, "?!")], "id int, t string")
    bow = textvec.bag_of_words(df, "id", F.col("t"))
    got = {(r["id"], r["token"]): r["weight"] for r in textvec.tf_idf(bow, "id", df).collect()}
    rare, common = np.log(4 / 2) + 1, np.log(4 / 3) + 1
    size = np.hypot(2 * rare, common)
    assert np.isclose(got[1, "red"], 2 * rare / size)
    assert np.isclose(got[1, "ball"], common / size)
    assert set(got) == {(1, "red"), (1, "ball"), (2, "blue"), (2, "ball")}


def test_token_ids_keep_whole_texts(spark):
    df = spark.createDataFrame([(1, "b a, b c"), (2, "")], "id int, t string")
    whole = {r["id"]: r["ids"] for r in textvec.token_ids(df, "id", F.col("t"), 4).collect()}
    assert whole == {1: [2, 3, 2, 1], 2: []}
    fixed = {r["id"]: r["ids"] for r in textvec.token_ids(df, "id", F.col("t"), 4, length=5).collect()}
    assert fixed == {1: [2, 3, 2, 1, 0], 2: [0] * 5}


def test_token_ids_by_dictionary_and_by_join(spark):
    """The same ids either way; a dictionary moves no rows."""
    rows = [(k, None if k == 3 else " ".join(f"w{(k * j) % 11}" for j in range(k % 17))) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(4)
    for length in (None, 6):
        small, large = (
            textvec.token_ids(df, "id", F.col("t"), 7, length, size) for size in (1 << 20, 0))
        assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    plan = textvec.token_ids(spark.range(5).select("id", F.lit("a b").alias("t")), "id", F.col("t"), 7)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "explode" not in text
