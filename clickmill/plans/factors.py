"""Factorisation, design matrix and factorisation machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import factorize as fa
from ..operators import features as fe
from ..operators import fm, fmblocks, ratings
from ..operators.reduce import reduced
from ..functions.vectors import hash_uniform
from ..session import materialize, scratch_path
from ..sources import sinks
from .fixtures import Tables, sql, sql_hash_uniform
from .profiles import popular, values
from .registry import query

K, RATE, LAM = 3, 0.001, 5.0


def item_side(t: Tables) -> DataFrame:
    """User by item-cluster cells."""
    return materialize(ratings.user_by_item_cluster(t.interactions, t.item_clusters), "coo")


def user_side(t: Tables) -> DataFrame:
    """User-cluster by article cells."""
    return materialize(ratings.user_cluster_by_item(t.interactions, t.user_clusters), "coo")


def start(coo: DataFrame, k: int = K) -> tuple[DataFrame, DataFrame]:
    rows = fa.start_factors(ratings.matrix_ids(coo, "row_id"), "row_id", k)
    cols = fa.start_factors(ratings.matrix_ids(coo, "col_id"), "col_id", k)
    return rows, cols


def start_sql(
    coo: str = "coo_item", k: int = K, seed: int = 42, tag: str = "", row_view: str = "", col_view: str = ""
) -> dict[str, str]:
    """SQL twin of ``start``: views u0 and v0, of the ids in ``coo`` or in the given views."""
    def side(col: str, ids: str) -> str:
        cells = ", ".join(sql_hash_uniform(f"'{col}:' || {col}", str(f), str(seed)) for f in range(k))
        return f"SELECT {col}, [{cells}] AS f FROM (SELECT DISTINCT {col} FROM ({ids or f'SELECT {col} FROM {coo}'}))"

    return {f"{tag}u0": side("row_id", row_view), f"{tag}v0": side("col_id", col_view)}


def step_sql(
    coo: str, n: int, k: int = K, rate: float = RATE, lam: float = LAM, seed: int = 42, tag: str = ""
) -> dict[str, str]:
    """Views u1..un, v1..vn and e1..en (residuals with the moved rows) of n descent steps."""
    views = start_sql(coo, k, seed, tag)

    def cells(u: str, v: str) -> str:
        return (f"SELECT c.row_id, c.col_id, u.f AS u, v.f AS v, rating - list_dot_product(u.f, v.f) AS e "
                f"FROM {coo} c JOIN {tag}{u} u USING (row_id) JOIN {tag}{v} v USING (col_id)")

    def moved(side: str, col: str, residuals: str, other: str) -> str:
        grads = ", ".join(f"sum(e * {other}[{f + 1}])" for f in range(k))
        new = ", ".join(
            f"s.f[{f + 1}] + {rate} * (coalesce(g.g[{f + 1}], 0) - {lam} * s.f[{f + 1}])" for f in range(k))
        return (f"SELECT s.{col}, [{new}] AS f FROM {tag}{side} s LEFT JOIN (SELECT {col}, [{grads}] AS g "
                f"FROM {tag}{residuals} GROUP BY {col}) g ON s.{col} = g.{col}")

    for i in range(1, n + 1):
        u, v = f"u{i - 1}", f"v{i - 1}"
        views[f"{tag}d{i}"] = cells(u, v)
        views[f"{tag}u{i}"] = moved(u, "row_id", f"d{i}", "v")
        views[f"{tag}e{i}"] = cells(f"u{i}", v)
        views[f"{tag}v{i}"] = moved(v, "col_id", f"e{i}", "u")
    return views


def factor_rows(rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Both sides as (side, id, f, value)."""
    def one(df: DataFrame, col: str) -> DataFrame:
        return df.select(
            F.lit(col).alias("side"), F.col(col).cast("string").alias("id"), F.posexplode("factors").alias("f", "value")
        ).select("side", "id", F.col("f").cast("bigint"), F.round("value", 6).alias("value"))

    return one(rows, "row_id").unionByName(one(cols, "col_id"))


def factor_rows_sql(u: str, v: str, k: int = K) -> str:
    return " UNION ALL ".join(
        f"SELECT '{col}' AS side, {col}::VARCHAR AS id, {f}::BIGINT AS f, round(f[{f + 1}], 6) AS value FROM {view}"
        for view, col in ((u, "row_id"), (v, "col_id")) for f in range(k))


@query("fac_1_gradient_step", sql(factor_rows_sql("u1", "v1"), "coo_item", **step_sql("coo_item", 1)))
def _(t):
    coo = item_side(t)
    return factor_rows(*fa.gradient_step(coo, *start(coo), K, RATE, LAM))


@query("fac_1_gradient_step_user_side", sql(
    factor_rows_sql("u1", "v1"), "coo_user", **step_sql("coo_user", 1)))
def _(t):
    coo = user_side(t)
    return factor_rows(*fa.gradient_step(coo, *start(coo), K, RATE, LAM))


MAX_SQL = "1.7976931348623157e308"


def _update_sql(i: int, tag: str = "") -> str:
    """Largest relative update of step i; against zeros in the first step."""
    def ratio(side: str, col: str) -> str:
        new, old = f"{tag}{side}{i}", f"{tag}{side}{i - 1}"
        if i == 1:
            return f"SELECT max(CASE WHEN x = 0 THEN 0 ELSE {MAX_SQL} END) AS m FROM (SELECT unnest(f) AS x FROM {new})"
        return (f"SELECT max(abs((x - y) / y)) AS m FROM (SELECT unnest(a.f) AS x, unnest(b.f) AS y "
                f"FROM {new} a JOIN {old} b USING ({col}))")

    return f"SELECT max(m) FROM ({ratio('u', 'row_id')} UNION ALL {ratio('v', 'col_id')})"


def _trace_sql(n: int, tag: str = "", params: str = "") -> str:
    return " UNION ALL ".join(
        f"""SELECT {params} {i - 1}::BIGINT AS iteration,
              round((SELECT sqrt(avg(e * e)) FROM {tag}e{i} WHERE e <> 0), 6) AS rmse,
              round(least(({_update_sql(i, tag)}), 1e12), 6) AS max_update""" for i in range(1, n + 1))


def shown_trace(trace: DataFrame, *cols: str) -> DataFrame:
    """Trace figures rounded; the unbounded first update is shown as 1e12."""
    return trace.select(
        *cols, "iteration", F.round("rmse", 6).alias("rmse"),
        F.round(F.least("max_update", F.lit(1e12)), 6).alias("max_update"))


STEPS = 3


@query("fac_1_descent_trace", sql(_trace_sql(STEPS), "coo_item", **step_sql("coo_item", STEPS)))
def _(t):
    coo = item_side(t)
    fit = fa.gradient_descent(coo, *start(coo), K, RATE, STEPS, LAM)
    return shown_trace(fa.trace_table(t.spark, [({"alg": "gd"}, fit)]))


def _ridge_sql(coo: str, side: str, fixed: str, lam: float) -> str:
    """Closed form of a two-factor ridge solution."""
    other = "col_id" if side == "row_id" else "row_id"
    return f"""SELECT {side}, [(c * p - b * q) / (a * c - b * b), (a * q - b * p) / (a * c - b * b)] AS f FROM (
      SELECT {side}, sum(f[1] * f[1]) + {lam} AS a, sum(f[1] * f[2]) AS b, sum(f[2] * f[2]) + {lam} AS c,
        sum(rating * f[1]) AS p, sum(rating * f[2]) AS q
      FROM {coo} JOIN {fixed} USING ({other}) GROUP BY {side})"""


def fitted_sql(coo: str, lam: float, rounds: int, row_view: str, col_view: str) -> dict[str, str]:
    """Views u0 and v0 after rounds of two-factor least squares over all ids; unrated ids are zero."""
    views = start_sql(coo, 2, tag="r0_", row_view=row_view, col_view=col_view)

    def solved(side: str, ids: str, fixed: str) -> str:
        return (f"SELECT i.{side}, coalesce(f, [0.0, 0.0]::DOUBLE[]) AS f FROM (SELECT DISTINCT {side} FROM ({ids})) i "
                f"LEFT JOIN ({_ridge_sql(coo, side, fixed, lam)}) s ON i.{side} = s.{side}")

    for n in range(1, rounds + 1):
        views[f"r{n}_u0"] = solved("row_id", row_view, f"r{n - 1}_v0")
        views[f"r{n}_v0"] = solved("col_id", col_view, f"r{n}_u0")
    return {**views, "u0": f"SELECT * FROM r{rounds}_u0", "v0": f"SELECT * FROM r{rounds}_v0"}


@query("fac_2_least_squares_round", sql(
    factor_rows_sql("u1", "v1", 2), "coo_item", **start_sql("coo_item", 2),
    u1=_ridge_sql("coo_item", "row_id", "v0", 5.0), v1=_ridge_sql("coo_item", "col_id", "u1", 5.0)))
def _(t):
    coo = item_side(t)
    fit = fa.alternating_least_squares(coo, *start(coo, 2), 2, max_iterations=1, lam=5.0)
    return factor_rows(fit.rows, fit.cols)


@query("fac_2_error_over_all_cells", sql(
    """SELECT round(sqrt(avg((coalesce(rating, 0) - list_dot_product(u.f, v.f)) ** 2)), 6) AS rmse
       FROM u1 u CROSS JOIN v1 v LEFT JOIN coo_item c ON c.row_id = u.row_id AND c.col_id = v.col_id""",
    "coo_item", **start_sql("coo_item", 2),
    u1=_ridge_sql("coo_item", "row_id", "v0", 5.0), v1=_ridge_sql("coo_item", "col_id", "u1", 5.0)))
def _(t):
    coo = item_side(t)
    fit = fa.alternating_least_squares(coo, *start(coo, 2), 2, max_iterations=1, lam=5.0)
    trace = fa.trace_table(t.spark, [({"alg": "als"}, fit)])
    return trace.where("iteration = 1").select(F.round("rmse", 6).alias("rmse"))


SLOW, STOP = 1e-7, 1e-2


@query("fac_3_stopped_descent", sql(
    f"SELECT * FROM ({factor_rows_sql('u1', 'v1')}) WHERE ({_update_sql(2)}) < {STOP}",
    "coo_item", **step_sql("coo_item", 2, rate=SLOW)))
def _(t):
    """The second step's update is below the threshold, so the first step's factors are returned."""
    coo = item_side(t)
    fit = fa.gradient_descent(coo, *start(coo), K, SLOW, 5, LAM, threshold=STOP)
    return factor_rows(fit.rows, fit.cols)


@query("fac_4_dispatch", sql(
    factor_rows_sql("u2", "v2", 2), "coo_user", **start_sql("coo_user", 2),
    u1=_ridge_sql("coo_user", "row_id", "v0", 1.0), v1=_ridge_sql("coo_user", "col_id", "u1", 1.0),
    u2=_ridge_sql("coo_user", "row_id", "v1", 1.0), v2=_ridge_sql("coo_user", "col_id", "u2", 1.0)))
def _(t):
    coo = user_side(t)
    ids = ratings.matrix_ids(coo, "row_id"), ratings.matrix_ids(coo, "col_id")
    fit = fa.factorize(coo, *ids, "als", 2, 1.0, max_iterations=2)
    return factor_rows(fit.rows, fit.cols)


@query("fac_4_dispatch_item_least_squares", sql(
    factor_rows_sql("u2", "v2", 2), "coo_item", **start_sql("coo_item", 2),
    u1=_ridge_sql("coo_item", "row_id", "v0", 1.0), v1=_ridge_sql("coo_item", "col_id", "u1", 1.0),
    u2=_ridge_sql("coo_item", "row_id", "v1", 1.0), v2=_ridge_sql("coo_item", "col_id", "u2", 1.0)))
def _(t):
    coo = item_side(t)
    ids = ratings.matrix_ids(coo, "row_id"), ratings.matrix_ids(coo, "col_id")
    fit = fa.factorize(coo, *ids, "als", 2, 1.0, max_iterations=2)
    return factor_rows(fit.rows, fit.cols)


@query("fac_4_dispatch_item_descent", sql(
    factor_rows_sql("u2", "v2", 2), "coo_item", **step_sql("coo_item", 2, 2)))
def _(t):
    coo = item_side(t)
    ids = ratings.matrix_ids(coo, "row_id"), ratings.matrix_ids(coo, "col_id")
    fit = fa.factorize(coo, *ids, "gd", 2, LAM, max_iterations=2, rate=RATE)
    return factor_rows(fit.rows, fit.cols)


@query("fac_4_dispatch_user_descent", sql(
    factor_rows_sql("u2", "v2", 2), "coo_user", **step_sql("coo_user", 2, 2)))
def _(t):
    coo = user_side(t)
    ids = ratings.matrix_ids(coo, "row_id"), ratings.matrix_ids(coo, "col_id")
    fit = fa.factorize(coo, *ids, "gd", 2, LAM, max_iterations=2, rate=RATE)
    return factor_rows(fit.rows, fit.cols)


@query("fac_5_predicted_ratings", sql(
    """SELECT row_id AS user_id, col_id::BIGINT AS item, round(list_dot_product(u0.f, v0.f), 6) AS predicted
       FROM coo_item JOIN u0 USING (row_id) JOIN v0 USING (col_id)""", "coo_item", **start_sql()))
def _(t):
    coo = item_side(t)
    scored = fa.predicted(ratings.seen_pairs(coo), *start(coo))
    return scored.select("user_id", F.col("item").cast("bigint"), F.round("predicted", 6).alias("predicted"))


GRID_SEEDS, GRID_KS, GRID_LAMS = range(42, 48), (5, 25, 50), (1, 5)
GRID_STEPS, GRID_RATE = 2, 1e-4


def _grid_sql() -> str:
    """Descent of all models at once: the model's number is a key of the factor views."""
    models = [(seed, k, lam) for seed in GRID_SEEDS for k in GRID_KS for lam in GRID_LAMS]
    values = ", ".join(f"({n}, {seed}, {k}, {lam}::DOUBLE)" for n, (seed, k, lam) in enumerate(models))
    views, parts = {"models": f"SELECT * FROM (VALUES {values}) t(m, seed, k, lam)"}, []
    for side in ("item", "user"):
        coo, s = f"coo_{side}", side[0]

        def start(col: str) -> str:
            cell = sql_hash_uniform(f"'{col}:' || {col}", "i", "seed")
            return (f"SELECT m, lam, {col}, list_transform(range(k), lambda i: {cell}) AS f "
                    f"FROM (SELECT DISTINCT {col} FROM {coo}) CROSS JOIN models")

        def cells(u: str, v: str) -> str:
            return (f"SELECT m, row_id, col_id, u.f AS u, v.f AS v, rating - list_dot_product(u.f, v.f) AS e "
                    f"FROM {coo} JOIN {u} u USING (row_id) JOIN {v} v USING (col_id, m)")

        def moved(old: str, col: str, residuals: str, other: str) -> str:
            return f"""SELECT m, lam, {col}, list_transform(list_zip(f, g),
                lambda t: t[1] + {GRID_RATE} * (t[2] - lam * t[1])) AS f FROM {old} JOIN (
              SELECT m, {col}, list(g ORDER BY p) AS g FROM (
                SELECT m, {col}, p, sum(e * x) AS g FROM (
                  SELECT m, {col}, e, unnest({other}) AS x, generate_subscripts({other}, 1) AS p FROM {residuals})
                GROUP BY ALL) GROUP BY m, {col}) USING (m, {col})"""

        def largest(new: str, old: str, col: str, first: bool) -> str:
            ratio = f"CASE WHEN x = 0 THEN 0 ELSE {MAX_SQL} END" if first else "abs((x - y) / y)"
            return (f"SELECT m, max({ratio}) AS c FROM (SELECT a.m, unnest(a.f) AS x, unnest(b.f) AS y "
                    f"FROM {new} a JOIN {old} b USING (m, {col})) GROUP BY m")

        views |= {f"{s}u0": start("row_id"), f"{s}v0": start("col_id")}
        for i in range(1, GRID_STEPS + 1):
            u, v = f"{s}u{i}", f"{s}v{i}"
            before = f"{s}u{i - 1}", f"{s}v{i - 1}"
            views[f"{s}d{i}"] = cells(*before)
            views[u] = moved(before[0], "row_id", f"{s}d{i}", "v")
            views[f"{s}e{i}"] = cells(u, before[1])
            views[v] = moved(before[1], "col_id", f"{s}e{i}", "u")
            parts.append(f"""SELECT seed::BIGINT AS seed, '{side}' AS clustering_type, k::BIGINT AS k,
                lam AS lambda_reg, {i - 1}::BIGINT AS iteration, round(rmse, 6) AS rmse,
                round(log10(least(greatest(a.c, b.c), 1e12)), 6) AS log_max_update
              FROM models JOIN (SELECT m, sqrt(avg(e * e) FILTER (WHERE e <> 0)) AS rmse FROM {s}e{i} GROUP BY m)
                USING (m) JOIN ({largest(u, before[0], 'row_id', i == 1)}) a USING (m)
              JOIN ({largest(v, before[1], 'col_id', i == 1)}) b USING (m)""")
    return sql(" UNION ALL ".join(parts), "coo_item", "coo_user", **views)


@query("fac_6_parameter_grid", _grid_sql())
def _(t):
    """Both sides, six seeds, three ranks and two penalties: 72 models, two rounds."""
    sides = {}
    for name, coo in (("item", item_side(t)), ("user", user_side(t))):
        sides[name] = (coo, ratings.matrix_ids(coo, "row_id"), ratings.matrix_ids(coo, "col_id"))
    grid = fa.parameter_grid(sides, ["gd"], GRID_SEEDS, GRID_KS, GRID_LAMS, GRID_STEPS, GRID_RATE)
    # Updates are relative, and huge where a factor was near zero: shown by their logarithm.
    return grid.select(
        "seed", "clustering_type", "k", "lambda_reg", "iteration", F.round("rmse", 6).alias("rmse"),
        F.round(F.log10(F.least("max_update", F.lit(1e12))), 6).alias("log_max_update"))


def _start_of_clusters(items: DataFrame, cols: list[str], width: int | None = None) -> DataFrame:
    """Start factors per cluster: two components of the clusters' summed features."""
    per_cluster = fe.aligned(fe.cluster_sums(items, cols), ["cluster"], cols)
    if width:
        per_cluster = per_cluster.withColumn("features", F.slice("features", 1, width))
    flat = reduced(materialize(per_cluster, "sums"), "cluster", "features", 2, "euclidean")
    return flat.select("cluster", F.posexplode("embedding").alias("f", "value")).withColumn("value", F.round("value", 6))


def _item_features(t: Tables) -> tuple[DataFrame, list[str]]:
    cats, subs = values(t)
    items = fe.item_features(popular(t), cats, subs).join(t.item_clusters, "news_id")
    return items, [*fe.prefixed(fe.CAT, cats), *fe.prefixed(fe.SUB, subs)]


def _user_features(t: Tables) -> tuple[DataFrame, list[str]]:
    cats, subs = values(t)
    users = fe.user_features(t.interactions, cats, subs).join(t.user_clusters, "user_id")
    return users, [*fe.prefixed(fe.CAT, cats), *fe.prefixed(fe.SUB, subs)]


def _cluster_axes_sql(body: str, *views: str) -> str:
    """Two components of the clusters' sums over the first two feature columns, in closed form."""
    from .clusters import axes_sql

    return sql(
        """SELECT cluster, f, round(v[f + 1], 6) AS value FROM turned CROSS JOIN (SELECT unnest([0, 1])::INTEGER AS f)""",
        *views, pts=body, **axes_sql("pts", "cluster"))


def _cluster_components_sql(body: str, *views: str) -> str:
    """Two components of the clusters' sums over all feature columns."""
    from .clusters import components_sql, recursive

    return recursive(sql(
        """SELECT cluster, f, round(v[f + 1], 6) AS value FROM flat CROSS JOIN (SELECT unnest([0, 1])::INTEGER AS f)""",
        *views, pts=body, **components_sql("pts", "cluster")))


# All feature columns, then the first two of each side in closed form.
@query("fac_7_feature_start", _cluster_components_sql(
    "SELECT cluster, list(n ORDER BY name) AS v FROM cluster_sums GROUP BY cluster", "cluster_sums"))
def _(t):
    return _start_of_clusters(*_item_features(t))


@query("fac_7_feature_start_of_users", _cluster_components_sql(
    """SELECT cluster, list(n ORDER BY name) AS v FROM (
         SELECT cluster, name, sum(share) AS n FROM user_shares JOIN user_clusters USING (user_id)
         GROUP BY cluster, name) GROUP BY cluster""", "user_shares", "user_clusters"))
def _(t):
    return _start_of_clusters(*_user_features(t))


@query("fac_7_item_start_two_columns", _cluster_axes_sql(
    """SELECT cluster, list(n ORDER BY name)[:2] AS v FROM cluster_sums GROUP BY cluster""", "cluster_sums"))
def _(t):
    items, cols = _item_features(t)
    return _start_of_clusters(items, sorted(cols), 2)


@query("fac_7_user_start_two_columns", _cluster_axes_sql(
    """SELECT cluster, list(n ORDER BY name)[:2] AS v FROM (
         SELECT cluster, name, sum(share) AS n FROM user_shares JOIN user_clusters USING (user_id)
         GROUP BY cluster, name) GROUP BY cluster""", "user_shares", "user_clusters"))
def _(t):
    users, cols = _user_features(t)
    return _start_of_clusters(users, sorted(cols), 2)


@query("mth_3_largest_update", sql(
    """SELECT round(max(abs((b - a) / a)), 6) AS max_update FROM (
         SELECT unnest(u0.f) AS a, unnest(u1.f) AS b FROM u0 JOIN u1 USING (row_id))""",
    "coo_item", **step_sql("coo_item", 1)))
def _(t):
    coo = item_side(t)
    rows, cols = start(coo)
    moved, _cols = fa.gradient_step(coo, rows, cols, K, RATE, LAM)
    return fa.max_update(moved, rows, "row_id").withColumn("max_update", F.round("max_update", 6))


# ---- factorisation machine

FEATURES = ["user_id", "news_id", "category", "time"]
ROW_KEY = "interaction_id"
KEYED_SQL = """SELECT impression_id || '-' || interaction_type || '-' || pos AS interaction_id, *
  FROM interactions"""
CELLS_SQL = " UNION ALL ".join(
    f"SELECT interaction_id, '{c}=' || {c} AS feature, 1.0::DOUBLE AS x FROM keyed WHERE {c} IS NOT NULL"
    for c in FEATURES) + " UNION ALL SELECT interaction_id, 'pos', pos::DOUBLE / 16 FROM keyed"


def keyed(t: Tables) -> DataFrame:
    key = F.concat_ws("-", "impression_id", "interaction_type", "pos").alias(ROW_KEY)
    return t.interactions.select(key, "*", (F.col("pos") / 16).alias("place"))


@query("fm_1_design_matrix", sql(
    f"""SELECT interaction_id, idx - 1 AS col, x FROM cells JOIN (
          SELECT feature, row_number() OVER (ORDER BY feature) AS idx FROM (SELECT DISTINCT feature FROM cells))
        USING (feature)""", "interactions", keyed=KEYED_SQL, cells=CELLS_SQL))
def _(t):
    df = keyed(t).drop("pos").withColumnRenamed("place", "pos")
    return fm.design_matrix(df, ROW_KEY, FEATURES, ["pos"])[0]


FM_K = 2
FM_VIEWS = {
    "keyed": KEYED_SQL,
    "cells": CELLS_SQL,
    "params": f"""SELECT feature, {sql_hash_uniform('feature', "'w'", '42')} AS w,
      [{', '.join(sql_hash_uniform('feature', str(f), '42') for f in range(FM_K))}] AS v
      FROM (SELECT DISTINCT feature FROM cells)""",
    "sums": """SELECT interaction_id, sum(w * x) AS lin, sum(v[1] * x) AS s1, sum(v[2] * x) AS s2,
      sum(v[1] * x * v[1] * x) AS q1, sum(v[2] * x * v[2] * x) AS q2
      FROM cells JOIN params USING (feature) GROUP BY interaction_id""",
    "scores": """SELECT interaction_id, s1, s2, 1.0 + lin + 0.5 * (s1 * s1 - q1 + s2 * s2 - q2) AS score FROM sums""",
}


def blocks(t: Tables, part=None) -> fmblocks.FeatureBlocks:
    """The interactions in stored blocks; ``part`` is a condition on the key."""
    rows = keyed(t).drop("pos").withColumnRenamed("place", "pos")
    rows = rows if part is None else rows.where(part)
    return fmblocks.FeatureBlocks(rows, ROW_KEY, "score", FEATURES, ["pos"])


@query("fm_3_scores", sql(
    "SELECT interaction_id, round(score, 6) AS score FROM scores", "interactions", **FM_VIEWS))
def _(t):
    rows = blocks(t)
    scored = fmblocks.block_scores(rows, fmblocks.start_parameters(rows.index(), FM_K), 1.0, FM_K)
    return scored.withColumn("score", F.round("score", 6))


ALPHA = 0.5


@query("fm_4_gradient_step", sql(
    f"""SELECT feature, round(w + {2 * ALPHA} * sum(e * x) / any_value(n), 6) AS w,
          round(v[1] + {2 * ALPHA} * (sum(e * x * s1) - v[1] * sum(e * x * x)) / any_value(n), 6) AS v0,
          round(v[2] + {2 * ALPHA} * (sum(e * x * s2) - v[2] * sum(e * x * x)) / any_value(n), 6) AS v1
        FROM cells JOIN errors USING (interaction_id) JOIN params USING (feature) GROUP BY feature, w, v
        UNION ALL SELECT '', round(1.0 + {2 * ALPHA} * avg(e), 6), NULL, NULL FROM errors""",
    "interactions", **FM_VIEWS,
    errors="""SELECT interaction_id, s1, s2, k.score - f.score AS e, count(*) OVER () AS n
      FROM scores f JOIN keyed k USING (interaction_id)"""))
def _(t):
    rows = blocks(t)
    start = fmblocks.start_parameters(rows.index(), FM_K)
    moved, w0 = fmblocks.block_gradient_step(rows, start, 1.0, FM_K, ALPHA)
    weights = moved.select(
        "feature", *[F.round(F.element_at("p", n), 6).alias(c) for n, c in enumerate(("w", "v0", "v1"), 1)])
    none = F.lit(None).cast("double")
    bias = t.spark.range(1).select(
        F.lit("").alias("feature"), F.round(F.lit(w0), 6).alias("w"), none.alias("v0"), none.alias("v1"))
    return weights.unionByName(bias)


FM_ROUNDS = 3


def _fm_trace_sql() -> str:
    """Rounds of descent on the train rows, the error on the others after each."""
    views = {
        "keyed": KEYED_SQL, "cells": CELLS_SQL,
        "parts": f"""SELECT interaction_id, score AS y, {sql_hash_uniform('interaction_id', '42')} < {fm.TRAIN_SHARE} AS train
          FROM keyed""",
        "p0": FM_VIEWS["params"], "b0": "SELECT 1.0::DOUBLE AS b",
    }
    parts = []

    def scored(n: int) -> str:
        return f"""SELECT interaction_id, y, train, s1, s2,
            (SELECT b FROM b{n}) + lin + 0.5 * (s1 * s1 - q1 + s2 * s2 - q2) AS p FROM (
          SELECT interaction_id, sum(w * x) AS lin, sum(v[1] * x) AS s1, sum(v[2] * x) AS s2,
            sum(v[1] * x * v[1] * x) AS q1, sum(v[2] * x * v[2] * x) AS q2
          FROM cells JOIN p{n} USING (feature) GROUP BY interaction_id) JOIN parts USING (interaction_id)"""

    for n in range(1, FM_ROUNDS + 1):
        views[f"f{n}"] = scored(n - 1)
        views[f"e{n}"] = f"SELECT interaction_id, s1, s2, y - p AS e, count(*) OVER () AS n FROM f{n} WHERE train"
        step = 2 * ALPHA
        views[f"g{n}"] = f"""SELECT feature, {step} * sum(e * x) / any_value(n) AS gw, sum(e * x * s1) AS a1,
            sum(e * x * s2) AS a2, sum(e * x * x) AS aa, {step} / any_value(n) AS r
          FROM cells JOIN e{n} USING (interaction_id) GROUP BY feature"""
        views[f"p{n}"] = f"""SELECT feature, w + coalesce(gw, 0) AS w,
            [v[1] + coalesce(r * (a1 - v[1] * aa), 0), v[2] + coalesce(r * (a2 - v[2] * aa), 0)] AS v
          FROM p{n - 1} LEFT JOIN g{n} USING (feature)"""
        views[f"b{n}"] = f"SELECT b + {step} * (SELECT avg(e) FROM e{n}) AS b FROM b{n - 1}"
        views[f"t{n}"] = scored(n)
        parts.append(f"""SELECT {n}::BIGINT AS iteration,
            round((SELECT sqrt(avg((y - p) ** 2)) FROM t{n} WHERE NOT train), 6) AS rmse,
            round((SELECT max(greatest(abs(a.w - b.w), abs(a.v[1] - b.v[1]), abs(a.v[2] - b.v[2])))
              FROM p{n} a JOIN p{n - 1} b USING (feature)), 6) AS max_update""")
    return sql(" UNION ALL ".join(parts), "interactions", **views)


def train_and_test(t: Tables) -> tuple[fmblocks.FeatureBlocks, fmblocks.FeatureBlocks, DataFrame]:
    """Blocks of both parts, and the features of either."""
    draw = hash_uniform(F.col(ROW_KEY), F.lit(42))
    train, test = blocks(t, draw < fm.TRAIN_SHARE), blocks(t, draw >= fm.TRAIN_SHARE)
    return train, test, train.index().unionByName(test.index()).distinct()


@query("fm_2_held_out_trace", _fm_trace_sql())
def _(t):
    trace = fmblocks.fm_trace(*train_and_test(t), FM_K, ALPHA, FM_ROUNDS)
    return trace.select(
        "iteration", F.round("rmse", 6).alias("rmse"), F.round("max_update", 6).alias("max_update"))


SEARCH_K, SEARCH_ROUNDS = 4, 3


def _searched_sql() -> str:
    """Rounds of the line search: scaled direction, error at every step length, the best step taken."""
    fs = range(1, SEARCH_K + 1)
    views = {
        "keyed": KEYED_SQL, "cells": CELLS_SQL,
        "parts": f"""SELECT interaction_id, score AS y, {sql_hash_uniform('interaction_id', '42')} < {fm.TRAIN_SHARE} AS train
          FROM keyed""",
        "p0": f"""SELECT feature, {sql_hash_uniform('feature', "'w'", '42')} AS w,
          [{', '.join(sql_hash_uniform('feature', str(f - 1), '42') for f in fs)}] AS v
          FROM (SELECT DISTINCT feature FROM cells)""",
        "b0": "SELECT 0.0::DOUBLE AS b",
        "lengths": "SELECT unnest([" + ", ".join(repr(a) for a in fmblocks.STEPS) + "]::DOUBLE[]) AS a",
    }
    out = []

    def scored(params: str, keys: str) -> str:
        sums = ", ".join(f"sum(v[{f}] * x) AS s{f}, sum(v[{f}] * x * v[{f}] * x) AS q{f}" for f in fs)
        pairs = " + ".join(f"s{f} * s{f} - q{f}" for f in fs)
        return f"""SELECT *, b + lin + 0.5 * ({pairs}) AS p FROM (
          SELECT {keys} interaction_id, any_value(b) AS b, sum(w * x) AS lin, {sums}
          FROM cells JOIN ({params}) USING (feature) GROUP BY {keys} interaction_id) JOIN parts USING (interaction_id)"""

    for n in range(1, SEARCH_ROUNDS + 1):
        was = f"SELECT p.*, b FROM p{n - 1} p CROSS JOIN b{n - 1}"
        views[f"f{n}"] = f"SELECT * FROM ({scored(was, '')}) WHERE train"
        d = [f"x * (s{f} - v[{f}] * x)" for f in fs]
        steps = ", ".join(f"CASE WHEN sum(({c}) * ({c})) > 1e-12 THEN sum((y - p) * ({c})) / sum(({c}) * ({c})) ELSE 0 END" for c in d)
        views[f"g{n}"] = f"""SELECT feature, sum((y - p) * x) / sum(x * x) AS dw, [{steps}] AS dv
          FROM cells JOIN f{n} USING (interaction_id) JOIN p{n - 1} USING (feature) GROUP BY feature"""
        views[f"h{n}"] = f"""SELECT p.feature, w, v, coalesce(dw, 0) AS dw, coalesce(dv, [{', '.join('0.0' for _ in fs)}]) AS dv,
            (SELECT b FROM b{n - 1}) AS b, (SELECT avg(y - p) FROM f{n}) AS db
          FROM p{n - 1} p LEFT JOIN g{n} USING (feature)"""
        moved = (f"SELECT feature, {{a}} AS a, w + {{a}} * dw AS w, "
                 f"[{', '.join(f'v[{f}] + {{a}} * dv[{f}]' for f in fs)}] AS v, b + {{a}} * db AS b")
        views[f"l{n}"] = f"""SELECT a, sum((y - p) * (y - p)) AS sse, count(*) AS n FROM (
          {scored(moved.format(a='a') + f' FROM h{n} CROSS JOIN lengths', 'a,')}) WHERE train GROUP BY a"""
        views[f"best{n}"] = f"SELECT a, sse, n FROM l{n} ORDER BY sse, a DESC LIMIT 1"
        views[f"m{n}"] = moved.format(a="best.a") + f" FROM h{n} CROSS JOIN best{n} best"
        views[f"p{n}"], views[f"b{n}"] = f"SELECT feature, w, v FROM m{n}", f"SELECT any_value(b) AS b FROM m{n}"
        views[f"t{n}"] = scored(f"SELECT * FROM m{n}", "")
        out.append(f"""SELECT {n}::BIGINT AS iteration, a AS step, round(sqrt(sse / n), 6) AS train_rmse,
            round((SELECT sqrt(avg((y - p) ** 2)) FROM t{n} WHERE NOT train), 6) AS rmse,
            round(a * (SELECT max(greatest(abs(dw), {', '.join(f'abs(dv[{f}])' for f in fs)})) FROM h{n}), 6) AS max_update
          FROM best{n}""")
    return sql(" UNION ALL ".join(out), "interactions", **views)


def searched_trace(t: Tables, rounds: int) -> DataFrame:
    trace, _params, _w0 = fmblocks.searched_descent(*train_and_test(t), SEARCH_K, rounds)
    return trace.select(
        "iteration", "step", *[F.round(c, 6).alias(c) for c in ("train_rmse", "rmse", "max_update")])


@query("fm_2_line_search_trace", _searched_sql())
def _(t):
    """Rank 4: the first rounds, against SQL."""
    return searched_trace(t, SEARCH_ROUNDS)


# Fifty rounds in SQL are too deep a nest of views; the first ones are checked above.
@query("fm_2_fifty_rounds")
def _(t):
    return searched_trace(t, 50)


@query("rnk_1_rating_predictions", sql(
    f"""SELECT rating_id, user_rating, round(b + a * movie_year, 6) AS prediction FROM parts,
          (SELECT regr_slope(user_rating, movie_year) AS a, regr_intercept(user_rating, movie_year) AS b
           FROM parts WHERE train) WHERE NOT train""", "movie_ratings",
    parts=f"""SELECT *, {sql_hash_uniform('rating_id', '42')} < {fm.TRAIN_SHARE} AS train FROM movie_ratings"""))
def _(t):
    found = fm.rating_predictions(t.movie_ratings, "rating_id", "user_rating", ["movie_year"])
    return found.withColumn("prediction", F.round("prediction", 6))


RATING_WORDS, RATING_NUMBERS = ["user_id", "movie_title", "movie_genre"], ["one", "movie_year", "timestamp"]


def rating_blocks(t: Tables, part) -> fmblocks.FeatureBlocks:
    rows = t.movie_ratings.withColumns({
        "one": F.lit(1.0), "movie_year": (F.col("movie_year") - 2000) / 10, "timestamp": F.col("timestamp") / 3e7 - 27})
    return fmblocks.FeatureBlocks(rows.where(part), "rating_id", "user_rating", RATING_WORDS, RATING_NUMBERS)


# A regression over all users and titles has no closed form; the single feature above has, and the
# test holds the solver against a dense one.
@query("rnk_1_all_features")
def _(t):
    """Ratings of the held-out rows from user, title, genre, year and time."""
    draw = hash_uniform(F.col("rating_id"), F.lit(42))
    train, test = rating_blocks(t, draw < fm.TRAIN_SHARE), rating_blocks(t, draw >= fm.TRAIN_SHARE)
    params, _residuals = fmblocks.conjugate_gradient(train)
    found = fmblocks.linear_scores(test, params).withColumnRenamed("score", "prediction")
    return found.join(t.movie_ratings.select("rating_id", "user_rating"), "rating_id")


def _matrix_sql(name: str, cols: list[str]) -> str:
    cells = " UNION ALL ".join(
        f"SELECT interaction_id, score, '{c}=' || {c} AS feature FROM keyed WHERE {c} IS NOT NULL" for c in cols)
    return f"""SELECT '{name}' AS features, interaction_id, score::BIGINT AS score,
        dense_rank() OVER (ORDER BY feature) - 1 AS col, 1.0::DOUBLE AS x FROM ({cells})"""


@query("snk_3_design_matrices", sql(
    " UNION ALL ".join(_matrix_sql(n, c) for n, c in fm.FEATURE_SETS.items()), "interactions", keyed=KEYED_SQL))
def _(t):
    """The stored rows read back, cell by cell."""
    paths = sinks.write_design_matrices(keyed(t), ROW_KEY, "score", scratch_path(t.spark, "design"))
    out = None
    for name, path in paths.items():
        pairs = F.explode(F.arrays_zip("indices", "values")).alias("c")
        part = t.spark.read.parquet(path).select(ROW_KEY, F.col("score").cast("bigint"), pairs).select(
            F.lit(name).alias("features"), ROW_KEY, "score", F.col("c.indices").alias("col"), F.col("c.values").alias("x"))
        out = part if out is None else out.unionByName(part)
    return out


@query("evl_1_errors", sql(
    """SELECT round(avg((rating - p) ** 2), 6) AS mse, round(sqrt(avg((rating - p) ** 2)), 6) AS rmse FROM (
         SELECT rating, list_dot_product(u0.f, v0.f) AS p FROM coo_item JOIN u0 USING (row_id)
         JOIN v0 USING (col_id))""", "coo_item", **start_sql()))
def _(t):
    from ..operators.retrieval import squared_errors

    coo = item_side(t)
    pairs = coo.select(F.col("row_id").alias("user_id"), F.col("col_id").alias("item"), "rating")
    errors = squared_errors(fa.predicted(pairs, *start(coo)), "rating", "predicted")
    return errors.select(F.round("mse", 6).alias("mse"), F.round("rmse", 6).alias("rmse"))


