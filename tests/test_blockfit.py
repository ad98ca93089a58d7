"""Fits over stored blocks: many models at once, hot ids, no exchange of cells."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickmill.operators import factorize as fa
from clickmill.operators.blockfit import Cells, Model, gradients, normal_equations

MODELS = [Model(2, 1.0, 42), Model(5, 0.1, 43), Model(12, 1.0, 42)]


@pytest.fixture(scope="module")
def matrix(spark):
    """One row holds a third of the cells; some ids have none."""
    rng = np.random.default_rng(8)
    cells = [(0, f"c{j}", float(rng.integers(1, 6))) for j in range(60)]
    cells += [(int(i), f"c{j}", float(rng.integers(1, 6))) for i, j in zip(rng.integers(1, 15, 120), rng.integers(0, 60, 120))]
    coo = spark.createDataFrame(cells, "row_id int, col_id string, rating double")
    rows = spark.createDataFrame([(i,) for i in range(17)], "row_id int")
    cols = spark.createDataFrame([(f"c{j}",) for j in range(62)], "col_id string")
    return coo, rows, cols


def factors(side, col):
    return {r[col]: np.array(r["factors"]) for r in side.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    assert all(np.allclose(a[k], b[k]) for k in a)


def test_all_models_at_once_equal_single_fits(matrix, monkeypatch):
    """The large row is dealt over several blocks for the models together, not for the single fits."""
    monkeypatch.setattr(fa, "SHARE_ROWS", 7)
    coo, rows, cols = matrix
    start = fa.random_start(rows, "row_id", MODELS), fa.random_start(cols, "col_id", MODELS)
    wide = {
        "gd": fa.descend_all(coo, *start, MODELS, 0.01, 2, 1e-9),
        "als": fa.alternate_all(coo, *start, MODELS, 1, 1e-9),
    }
    monkeypatch.setattr(fa, "SHARE_ROWS", 65_536)
    for m, model in enumerate(MODELS[1:], 1):
        for method, fits in wide.items():
            one = fa.factorize(coo, rows, cols, method, model.k, model.lam, model.seed,
                               max_iterations=2 if method == "gd" else 1, rate=0.01)
            assert np.allclose(fits[m].rmse, one.rmse[:len(fits[m].rmse)])
            assert np.allclose(fits[m].updates, one.updates[:len(fits[m].updates)])
            same(factors(fa.model_factors(fits[m].rows, "row_id", MODELS, m), "row_id"), factors(one.rows, "row_id"))
            same(factors(fa.model_factors(fits[m].cols, "col_id", MODELS, m), "col_id"), factors(one.cols, "col_id"))


def test_a_model_that_stops_keeps_its_previous_factors(matrix):
    coo, rows, cols = matrix
    models = [Model(2, 1.0), Model(2, 60.0)]
    start = fa.random_start(rows, "row_id", models), fa.random_start(cols, "col_id", models)
    fits = fa.descend_all(coo, *start, models, 1e-4, 3, 0.05)
    assert len(fits[0].updates) > len(fits[0].rmse) or len(fits[1].updates) > len(fits[1].rmse)
    for m, model in enumerate(models):
        u = fa.start_factors(rows, "row_id", 2), fa.start_factors(cols, "col_id", 2)
        one = fa.gradient_descent(coo, *u, 2, 1e-4, 3, model.lam, 0.05)
        assert np.allclose(fits[m].rmse, one.rmse) and np.allclose(fits[m].updates, one.updates)
        same(factors(fa.model_factors(fits[m].rows, "row_id", models, m), "row_id"), factors(one.rows, "row_id"))


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    run()
    found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found


def test_jobs_do_not_grow_with_the_grid(spark, matrix):
    coo, rows, cols = matrix
    counts = []
    for n in (1, 8):
        models = [Model(3, 1.0, seed) for seed in range(n)]
        start = fa.random_start(rows, "row_id", models), fa.random_start(cols, "col_id", models)
        counts.append(jobs(spark, f"grid-{n}", lambda: fa.descend_all(coo, *start, models, 1e-3, 2, 0.0)))
    assert counts[0] == counts[1] > 0


def ancestors(plan: str, mark: str) -> list[str]:
    """The operators above the line that holds ``mark``, in the tree of a plan."""
    lines = plan.splitlines()
    at = next(n for n, line in enumerate(lines) if mark in line)
    depth = lambda line: len(re.match(r"[\s:+|-]*", line).group())
    out, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            out.append(line.strip(" :+-"))
    return out


@pytest.mark.parametrize("work", [gradients, lambda models: normal_equations(models, 10)])
def test_cells_are_not_exchanged_in_a_round(spark, matrix, work):
    coo, rows, cols = matrix
    cells = Cells(coo, "row_id", "col_id", MODELS, 65_536, 10)
    start = fa.random_start(rows, "row_id", MODELS), fa.random_start(cols, "col_id", MODELS)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sums = cells.by_row.sums({"own": start[0], "other": start[1]}, cells.width, work(MODELS))
        plan = sums._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    above = ancestors(plan, "own_at:binary")
    assert any("FlatMapCoGroupsInArrow" in a for a in above)
    assert not any("Exchange" in a for a in above)
    # Nor are the routes: only factors and messages are.
    assert plan.count("Exchange") == 3


def test_no_cells_no_updates(spark, matrix):
    coo, rows, cols = matrix
    fit = fa.factorize(coo.where("false"), rows, cols, "als", 2, 1.0, max_iterations=1)
    assert all(np.allclose(f, 0) for f in factors(fit.rows, "row_id").values())
    fit = fa.factorize(coo.where("false"), rows.where("false"), cols.where("false"), "gd", 2, 1.0)
    assert fit.rmse == [] and fit.rows.count() == 0
