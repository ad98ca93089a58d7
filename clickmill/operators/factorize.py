"""Matrix factorisation over sparse (row_id, col_id, rating) cells."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, hash_uniform, largest_update, random_factors
from ..session import materialize
from .blockfit import FIGURES, Cells, Model, figures, spans
from .replay import descent_traces

ROW, COL = "row_id", "col_id"
# Up to this many factors a normal equation is summed cell by cell, beyond by products per id.
SUMMED_FACTORS = 10
# Cells of one id that one block sums up; the cells of a larger id are dealt over several.
SHARE_ROWS = 65_536


@dataclass
class Fit:
    """Factors (id, factors) of both sides and the traces over the iterations."""

    rows: DataFrame | None
    cols: DataFrame | None
    rmse: list[float] = field(default_factory=list)
    updates: list[float] = field(default_factory=list)


def start_factors(ids: DataFrame, id_col: str, k: int, seed: int = 42) -> DataFrame:
    """Uniform start factors that depend on the id alone."""
    return ids.select(
        id_col, random_factors(F.concat_ws(":", F.lit(id_col), F.col(id_col)), k, seed).alias("factors")
    )


def random_start(ids: DataFrame, id_col: str, models: Sequence[Model]) -> DataFrame:
    """Start factors of all models end to end; models of one seed share the draws of an id."""
    key = F.concat_ws(":", F.lit(id_col), F.col(id_col))
    width = {m.seed: max(x.k for x in models if x.seed == m.seed) for m in models}

    def drawn(seed: int, k: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: hash_uniform(key, f, F.lit(seed)))

    draws = {f"_s{seed}": drawn(seed, k) for seed, k in width.items()}
    parts = [F.slice(f"_s{m.seed}", 1, m.k) for m in models]
    return ids.select(id_col).withColumns(draws).select(id_col, F.concat(*parts).alias("factors"))


def _cells(coo: DataFrame, models: Sequence[Model]) -> Cells:
    coo = materialize(coo.select(ROW, COL, "rating"), "coo")
    return Cells(coo, ROW, COL, models, SHARE_ROWS, SUMMED_FACTORS)


def gradient_step(
    coo: DataFrame, rows: DataFrame, cols: DataFrame, k: int, rate: float, lam: float
) -> tuple[DataFrame, DataFrame]:
    """Rows move first; columns move on the residuals of the moved rows."""
    cells = _cells(coo, [Model(k, lam)])
    rates = np.array([rate])
    new_rows, _ = cells.descend(cells.by_row, rows, cols, rates, False)
    new_cols, _ = cells.descend(cells.by_col, cols, new_rows, rates, False)
    return new_rows, new_cols


def _with_old(table: DataFrame, id_col: str, models: Sequence[Model], kept: Sequence[bool]) -> DataFrame:
    """Factors after a step, those of the ``kept`` models as before it."""
    if not any(kept):
        return table.select(id_col, "factors")
    parts = [
        F.slice("old" if k else "factors", s.start + 1, s.stop - s.start)
        for s, k in zip(spans(models), kept)
    ]
    return table.select(id_col, F.concat(*parts).alias("factors"))


def _updates(found: dict[str, list[float]], n: int) -> list[float]:
    """Largest change per model over both sides; a side without ids has none."""
    row, col = (found[side] or [0.0] * n for side in ("row", "col"))
    return [max(x, y) for x, y in zip(row, col)]


def descend_all(
    coo: DataFrame, rows: DataFrame, cols: DataFrame, models: Sequence[Model], rate: float,
    max_iterations: int, threshold: float,
) -> list[Fit]:
    """Full-batch descent of all models in one pass over the cells per half round.

    ``rows`` and ``cols`` hold the models' factors end to end, and so do the fits returned. A model
    stops with its previous factors once its largest relative update is below ``threshold``; the
    rounds end when all have stopped.
    """
    cells = _cells(coo, models)
    n = len(models)
    fits = [Fit(rows, cols) for _ in models]
    rows, cols = materialize(rows.select(ROW, "factors"), "u"), materialize(cols.select(COL, "factors"), "v")
    active = [True] * n
    for step in range(max_iterations):
        rates = np.where(active, rate, 0.0)
        new_rows, _ = cells.descend(cells.by_row, rows, cols, rates, step == 0)
        new_cols, sums = cells.descend(cells.by_col, cols, new_rows, rates, step == 0)
        found = figures([
            ("row", new_rows, "change", "max"), ("col", new_cols, "change", "max"),
            ("errors", sums.where(F.col("kind") == FIGURES), "packed", "sum"),
        ])
        updates, errors = _updates(found, n), found["errors"] or [0.0] * 2 * n
        for m, fit in enumerate(fits):
            if not active[m]:
                continue
            fit.updates.append(updates[m])
            active[m] = updates[m] >= threshold
            if active[m]:
                squares, count = errors[m], errors[n + m]
                fit.rmse.append(float(np.sqrt(squares / count)) if count else float("nan"))
        stopped = [not a for a in active]
        rows, cols = (_with_old(t, c, models, stopped) for t, c in ((new_rows, ROW), (new_cols, COL)))
        if not any(active):
            break
    return _shared(fits, rows, cols)


def _shared(fits: list[Fit], rows: DataFrame, cols: DataFrame) -> list[Fit]:
    for fit in fits:
        fit.rows, fit.cols = rows, cols
    return fits


def gradient_descent(
    coo: DataFrame,
    rows: DataFrame,
    cols: DataFrame,
    k: int,
    rate: float = 1e-5,
    max_iterations: int = 10,
    lam: float = 5.0,
    threshold: float = 1e-3,
) -> Fit:
    """Full-batch descent on the observed cells.

    Stops with the previous factors once the largest relative update is below ``threshold``.
    """
    return descend_all(coo, rows, cols, [Model(k, lam)], rate, max_iterations, threshold)[0]


def alternate_all(
    coo: DataFrame, rows: DataFrame, cols: DataFrame, models: Sequence[Model], max_iterations: int,
    threshold: float,
) -> list[Fit]:
    """Alternating ridge solutions of all models in one pass over the cells per half round.

    The error is over every cell, unobserved ones counting as 0: its unobserved part follows from
    the Gram matrices, and its cross part from the right sides of the columns' equations. A model
    stops on a small change of the error after the third round, or on a small update.
    """
    cells = _cells(coo, models)
    n = len(models)
    rating = F.col("rating").cast("double")
    square = coo.agg(F.sum(rating * rating)).first()[0] or 0.0
    rows, cols = materialize(rows.select(ROW, "factors"), "u"), materialize(cols.select(COL, "factors"), "v")
    every = rows.count() * cols.count()

    def changed(side: DataFrame) -> DataFrame:
        zeros = F.transform("factors", lambda _: F.lit(0.0))
        parts = [
            largest_update(F.slice("factors", s.start + 1, m.k), F.slice(zeros, s.start + 1, m.k))
            for s, m in zip(spans(models), models)
        ]
        return side.select(F.array(*parts).alias("change"))

    def errors(found: dict[str, list[float]]) -> list[float]:
        at, out = 0, []
        for m, model in enumerate(models):
            size = model.k * (model.k + 1) // 2
            u, v = (np.array(found[g][at:at + size] or np.zeros(size)) for g in ("row_gram", "col_gram"))
            # An entry off the diagonal stands for two.
            twice = np.where(np.equal(*np.triu_indices(model.k)), 1.0, 2.0)
            cross = found["cross"][m] if found["cross"] else 0.0
            sse = square - 2 * cross + float((twice * u * v).sum())
            out.append(float(np.sqrt(max(sse, 0.0) / every)) if every else float("nan"))
            at += size
        return out

    def measured(a: DataFrame, b: DataFrame, changes: list, cross: tuple) -> tuple[list[float], list[float]]:
        found = figures([
            ("row", changes[0], "change", "max"), ("col", changes[1], "change", "max"), cross,
            ("row_gram", cells.grams(a), "packed", "sum"), ("col_gram", cells.grams(b), "packed", "sum"),
        ])
        return errors(found), _updates(found, n)

    fits = [Fit(rows, cols) for _ in models]
    rmse, updates = measured(
        rows, cols, [changed(rows), changed(cols)],
        ("cross", cells.start_cross(rows, cols), "packed", "sum"))
    for m, fit in enumerate(fits):
        fit.rmse.append(rmse[m])
        fit.updates.append(updates[m])
    active = [True] * n
    for step in range(1, max_iterations + 1):
        new_rows = cells.least_squares(cells.by_row, rows, cols)
        new_cols = cells.least_squares(cells.by_col, cols, new_rows)
        rmse, updates = measured(
            new_rows, new_cols, [new_rows, new_cols], ("cross", new_cols, "cross", "sum"))
        stopped = [not a for a in active]
        rows, cols = (_with_old(t, c, models, stopped) for t, c in ((new_rows, ROW), (new_cols, COL)))
        for m, fit in enumerate(fits):
            if active[m]:
                fit.rmse.append(rmse[m])
                fit.updates.append(updates[m])
                settled = step > 3 and abs(fit.rmse[-1] - fit.rmse[-2]) < threshold
                active[m] = not settled and updates[m] >= threshold
        if not any(active):
            break
    return _shared(fits, rows, cols)


def alternating_least_squares(
    coo: DataFrame,
    rows: DataFrame,
    cols: DataFrame,
    k: int,
    max_iterations: int = 10,
    lam: float = 0.01,
    threshold: float = 1e-3,
) -> Fit:
    """Alternating ridge solutions with a plain penalty (not scaled by the number of ratings).

    Stops on a small change of the error after the third round, or on a small update.
    """
    return alternate_all(coo, rows, cols, [Model(k, lam)], max_iterations, threshold)[0]


def model_factors(side: DataFrame, id_col: str, models: Sequence[Model], m: int) -> DataFrame:
    """(id, factors) of model ``m`` out of the factors of all models."""
    s = spans(models)[m]
    return side.select(id_col, F.slice("factors", s.start + 1, s.stop - s.start).alias("factors"))


def factorize(
    coo: DataFrame,
    row_ids: DataFrame,
    col_ids: DataFrame,
    method: str,
    k: int,
    lam: float,
    seed: int = 42,
    max_iterations: int = 10,
    rate: float = 1e-6,
) -> Fit:
    """Start factors for all ids of both sides, then the chosen algorithm."""
    rows, cols = start_factors(row_ids, ROW, k, seed), start_factors(col_ids, COL, k, seed)
    if method == "gd":
        return gradient_descent(coo, rows, cols, k, rate, max_iterations, lam)
    if method == "als":
        return alternating_least_squares(coo, rows, cols, k, max_iterations, lam)
    raise ValueError(f"unknown method {method!r}")


def trace_table(spark, fits: Sequence[tuple[dict, Fit]]) -> DataFrame:
    """(parameters, iteration, rmse, max_update) rows of finished fits."""
    rows = []
    for params, fit in fits:
        for i in range(max(len(fit.rmse), len(fit.updates))):
            rmse = fit.rmse[i] if i < len(fit.rmse) else None
            update = fit.updates[i] if i < len(fit.updates) else None
            rows.append((*params.values(), i, rmse, update))
    names = list(fits[0][0])
    types = {str: "string", int: "bigint", float: "double"}
    schema = [f"{n} {types[type(v)]}" for n, v in fits[0][0].items()]
    assert all(list(p) == names for p, _ in fits)
    return spark.createDataFrame(
        rows, ", ".join([*schema, "iteration bigint", "rmse double", "max_update double"])
    )


def parameter_grid(
    sides: dict[str, tuple[DataFrame, DataFrame, DataFrame]],
    methods: Sequence[str],
    seeds: Sequence[int],
    ks: Sequence[int],
    lams: Sequence[float],
    max_iterations: int,
    rate: float = 1e-7,
) -> DataFrame:
    """Traces of every combination; ``sides`` maps a name to (cells, row ids, column ids).

    All combinations of a side and method are fitted together: a round reads the cells once per
    half and runs the same number of jobs whatever the size of the grid. Descent on a matrix of which one
    side has few ids, as clusters are, neither shuffles nor, for a few rounds, stores the factors of the other.
    """
    models = [Model(k, float(lam), seed) for seed in seeds for k in ks for lam in lams]
    fits = []
    for side, (coo, row_ids, col_ids) in sides.items():
        rows, cols = random_start(row_ids, ROW, models), random_start(col_ids, COL, models)
        for method in methods:
            traces = None
            if method == "gd":
                traces = descent_traces(
                    coo, row_ids, col_ids, ROW, COL, models, random_start, rate, max_iterations, 1e-3)
            if traces is not None:
                found = [Fit(None, None, rmse, updates) for rmse, updates in traces]
            elif method == "gd":
                found = descend_all(coo, rows, cols, models, rate, max_iterations, 1e-3)
            else:
                found = alternate_all(coo, rows, cols, models, max_iterations, 1e-3)
            for model, fit in zip(models, found):
                params = {"seed": model.seed, "clustering_type": side, "alg": method, "k": model.k,
                          "lambda_reg": model.lam}
                fits.append((params, fit))
    return trace_table(coo.sparkSession, fits)


def predicted(pairs: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Predicted rating of the given (user_id, item) pairs only."""
    u = rows.select(F.col(ROW).alias("user_id"), F.col("factors").alias("_u"))
    v = cols.select(F.col(COL).alias("item"), F.col("factors").alias("_v"))
    joined = pairs.join(v, "item").join(u, "user_id")
    return joined.withColumn("predicted", dot(F.col("_u"), F.col("_v"))).drop("_u", "_v")


def rmse_nonzero(df: DataFrame, residual: str) -> DataFrame:
    """Root mean square of the residuals that are not exactly 0."""
    e = F.col(residual)
    return df.agg(F.sqrt(F.avg(F.when(e != 0, e * e))).alias("rmse"))


def max_update(new: DataFrame, old: DataFrame, id_col: str, relative: bool = True) -> DataFrame:
    joined = new.select(id_col, F.col("factors").alias("a")).join(
        old.select(id_col, F.col("factors").alias("b")), id_col
    )
    return joined.agg(F.max(largest_update(F.col("a"), F.col("b"), relative)).alias("max_update"))
