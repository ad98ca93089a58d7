"""Cluster labels and stored embeddings; library fits and density labels of components have no SQL twin."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..operators import cluster, density, sweeps, textvec
from ..operators import features as fe
from ..operators import recommend as rc
from ..operators.reduce import reduced, stored_or_computed
from ..session import materialize, scratch_path
from . import profiles
from .fixtures import Tables, sql, sql_hash_uniform
from .registry import query
from .texts import _STOPS, tfidf

TEXT_DIM = 16


def vectors(t: Tables) -> DataFrame:
    return t.raw("embeddings").select("vec_id", F.col("embedding").cast("array<double>"))


def article_vectors(t: Tables, metric: str = "hellinger", weights: str = "tfidf") -> DataFrame:
    """Dense text vectors (news_id, embedding) of the catalogue, from counts or TF-IDF.

    The metric's transform comes first, on the sparse weights, none of which is negative; the signed
    projection keeps the distances that it sets.
    """
    from ..functions.text import joined_text

    bow = materialize(textvec.bag_of_words(t.news, "news_id", joined_text(["abstract", "title"])), "bow")
    if weights == "tfidf":
        rows = textvec.tf_idf(bow, "news_id", t.news, textvec.token_signs(TEXT_DIM))
    else:
        rows = textvec.signed(bow.withColumn("weight", F.col("tf").cast("double")), TEXT_DIM)
    rows = textvec.metric_scaled(rows.select("news_id", "token", "weight", textvec.SIGNS), "news_id", metric)
    return materialize(textvec.random_projection(rows, "news_id", TEXT_DIM), "text")


def user_vectors(t: Tables) -> DataFrame:
    cats, subs = profiles.values(t)
    users = fe.user_features(t.interactions, cats, subs).na.fill(0.0, ["median_time"])
    cols = [*fe.prefixed(fe.CAT, cats), *fe.prefixed(fe.SUB, subs), "median_time"]
    return materialize(fe.aligned(users, ["user_id"], cols), "users")


WIDTH, SKETCH = 64, 2


def _signs(d: int) -> list[float]:
    """Signs of one component of a random projection of the stored vectors."""
    return [1.0 if int(md5(f"{i}|{d}".encode()).hexdigest()[0], 16) < 8 else -1.0 for i in range(WIDTH)]


def sketched(t: Tables) -> DataFrame:
    """The stored vectors, all components, projected to two."""
    flat = F.array(*[dot(F.col("embedding"), F.lit(_signs(d))) for d in range(SKETCH)])
    return vectors(t).select("vec_id", flat.alias("embedding"))


SKETCH_SQL = "SELECT vec_id, [" + ", ".join(
    f"list_dot_product(embedding::DOUBLE[], {_signs(d)}::DOUBLE[])" for d in range(SKETCH)) + "] AS v FROM embeddings"


@query("src_6_stored_embeddings", sql(
    "SELECT vec_id, round(v[1], 6) AS e0, round(v[2], 6) AS e1 FROM sketch", sketch=SKETCH_SQL))
def _(t):
    params = {"table": "embeddings", "dim": SKETCH, "metric": "euclidean"}
    folder = scratch_path(t.spark, "embeddings")
    stored_or_computed(t.spark, folder, params, lambda: sketched(t))
    found = stored_or_computed(t.spark, folder, params, lambda: sketched(t))
    return found.select(
        "vec_id", *[F.round(F.element_at("embedding", d + 1), 6).alias(f"e{d}") for d in range(SKETCH)])


SQUARINGS = 24  # the covariance to the power of 2 ** 24 is its leading axis but for rounding


def components_sql(source: str, key: str, metric: str = "euclidean", tag: str = "") -> dict[str, str]:
    """Views of ``reduce.reduced`` to two components of ``source`` (key, v), result in {tag}flat (key, v).

    Squaring the covariance again and again, scaled to trace 1, leaves the projector on its leading
    axis; the second axis follows after that one is taken out.
    """
    moved = "v"
    if metric == "cosine":
        moved = "[coalesce(x / nullif(sqrt(list_dot_product(v, v)), 0), 0) for x in v]"
    views = {
        f"{tag}moved": f"SELECT {key}, {moved} AS v FROM {source}",
        f"{tag}cells": f"SELECT {key}, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM {tag}moved",
        f"{tag}cols": f"""SELECT p, list(x - mu ORDER BY {key}) AS c FROM {tag}cells
          JOIN (SELECT p, avg(x) AS mu FROM {tag}cells GROUP BY p) USING (p) GROUP BY p""",
        f"{tag}cov1": f"""SELECT list(r ORDER BY i) AS m FROM (
          SELECT a.p AS i, list(list_dot_product(a.c, b.c) / len(a.c) ORDER BY b.p) AS r
          FROM {tag}cols a CROSS JOIN {tag}cols b GROUP BY a.p)""",
    }
    for n in (1, 2):
        views[f"{tag}pw{n}"] = f"""SELECT 0 AS step, m FROM {tag}cov{n} UNION ALL
          SELECT step + 1, [[list_dot_product(r, c) for c in m] for r in m] FROM (
            SELECT step, [[x / t for x in r] for r in m] AS m FROM (
              SELECT step, m, list_sum([r[i] for r, i in m]) AS t FROM {tag}pw{n} WHERE step < {SQUARINGS}))"""
        views[f"{tag}raw{n}"] = f"""SELECT [x / sqrt(list_dot_product(r, r)) for x in r] AS e FROM (
            SELECT m[list_position(d, list_max(d))] AS r FROM (
              SELECT m, [r[i] for r, i in m] AS d FROM {tag}pw{n} WHERE step = {SQUARINGS}))"""
        views[f"{tag}axis{n}"] = f"""SELECT [x * CASE WHEN e[list_position(a, list_max(a))] < 0 THEN -1 ELSE 1 END
            for x in e] AS e FROM (SELECT e, [abs(round(x, 9)) for x in e] AS a FROM {tag}raw{n})"""
        if n == 1:
            views[f"{tag}cov2"] = f"""SELECT [[c - l * e[i] * e[j] for c, j in r] for r, i in m] AS m FROM (
                SELECT m, e, list_dot_product(e, [list_dot_product(r, e) for r in m]) AS l
                FROM {tag}cov1 CROSS JOIN {tag}axis1)"""
    views[f"{tag}flat"] = f"""SELECT {key}, [list_dot_product(v, a.e), list_dot_product(v, b.e)] AS v
      FROM {tag}moved CROSS JOIN {tag}axis1 a CROSS JOIN {tag}axis2 b"""
    return views


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


VECTORS_SQL = "SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings"
COMPONENT_METRICS = ("euclidean", "cosine")  # signed vectors have no Hellinger distance


def _components_sql() -> str:
    views, parts = {"vecs": VECTORS_SQL}, []
    for metric in COMPONENT_METRICS:
        views |= components_sql("vecs", "vec_id", metric, f"{metric}_")
        parts.append(f"""SELECT '{metric}' AS metric, vec_id, round(v[1], 6) AS e0, round(v[2], 6) AS e1
          FROM {metric}_flat""")
    return recursive(sql(" UNION ALL ".join(parts), **views))


@query("red_1_principal_components", _components_sql())
def _(t):
    out = None
    for metric in COMPONENT_METRICS:
        flat = reduced(vectors(t), "vec_id", "embedding", 2, metric)
        flat = flat.select(
            F.lit(metric).alias("metric"), "vec_id",
            *[F.round(F.element_at("embedding", d + 1), 6).alias(f"e{d}") for d in range(2)])
        out = flat if out is None else out.unionByName(flat)
    return out


def axes_sql(source: str, key: str) -> dict[str, str]:
    """Views of ``reduce.reduced`` to two components of two columns (key, v): closed form."""
    return {
        "spread": f"""SELECT var_pop(v[1]) AS a, covar_pop(v[1], v[2]) AS b, var_pop(v[2]) AS c FROM {source}""",
        "lead": "SELECT (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l, a, b, c FROM spread",
        # The axis of the larger variance l is (b, l - a); the other one is at a right angle to it.
        "axis": "SELECT b / sqrt(b * b + (l - a) ** 2) AS x, (l - a) / sqrt(b * b + (l - a) ** 2) AS y FROM lead",
        "axes": """SELECT CASE WHEN greatest(x, y) >= -least(x, y) THEN [x, y] ELSE [-x, -y] END AS first,
            CASE WHEN greatest(-y, x) >= -least(-y, x) THEN [-y, x] ELSE [y, -x] END AS second FROM axis""",
        "turned": f"""SELECT {key}, [list_dot_product(v, first), list_dot_product(v, second)] AS v
          FROM {source} CROSS JOIN axes""",
    }


@query("red_1_two_columns", sql(
    "SELECT vec_id, round(v[1], 6) AS e0, round(v[2], 6) AS e1 FROM turned", sketch=SKETCH_SQL,
    **axes_sql("sketch", "vec_id")))
def _(t):
    """Both components of two columns, which SQL finds in closed form."""
    flat = reduced(sketched(t), "vec_id", "embedding", 2, "euclidean")
    return flat.select("vec_id", *[F.round(F.element_at("embedding", d + 1), 6).alias(f"e{d}") for d in range(2)])


@query("red_1_documents")
def _(t):
    flat = materialize(textvec.random_projection(tfidf(t, textvec.token_signs(32)), "doc_id", 32), "projected")
    return reduced(flat, "doc_id", "embedding", 2, "cosine")


def lloyd_sql(
    source: str, key: str, k: int, rounds: int, seed: int = cluster.SEED, tag: str = ""
) -> dict[str, str]:
    """Views of ``cluster.lloyd_labels`` over ``source`` (key, v): labels are in {tag}a{rounds}."""
    views = {f"{tag}c0": f"""SELECT row_number() OVER (ORDER BY {sql_hash_uniform(key, str(seed))}, {key}) - 1 AS cluster, v
      FROM {source} QUALIFY cluster < {k}"""}
    for i in range(rounds + 1):
        views[f"{tag}a{i}"] = f"""SELECT {key}, p.v, cluster FROM {source} p CROSS JOIN {tag}c{i} c
          QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY round(list_distance(p.v, c.v), 9), cluster) = 1"""
        views[f"{tag}m{i}"] = f"""SELECT cluster, list(x ORDER BY place) AS v FROM (
            SELECT cluster, place, avg(x) AS x FROM (
              SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM {tag}a{i})
            GROUP BY cluster, place) GROUP BY cluster"""
        views[f"{tag}c{i + 1}"] = (
            f"SELECT c.cluster, coalesce(m.v, c.v) AS v FROM {tag}c{i} c LEFT JOIN {tag}m{i} m USING (cluster)")
    return views


WORDS_SQL = {
    "bow": f"""SELECT news_id, token, count(*)::DOUBLE AS tf FROM (
        SELECT news_id, unnest(regexp_extract_all(lower(coalesce(abstract, ' . ') || title),
          '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS token FROM news) WHERE token NOT IN ({_STOPS}) GROUP BY ALL""",
    "freq": "SELECT token, count(*) AS df FROM bow GROUP BY token",
    "signs": "SELECT token, [" + ", ".join(
        f"CASE WHEN {sql_hash_uniform('token', str(d), '42')} < 0.5 THEN -1.0 ELSE 1.0 END" for d in range(TEXT_DIM)
    ) + "] AS g FROM freq",
    "counts": "SELECT news_id, token, tf AS w FROM bow",
    "tfidf": """SELECT news_id, token, tf * (ln((1.0 + (SELECT count(*) FROM news)) / (1.0 + df)) + 1) AS w
      FROM bow JOIN freq USING (token)""",
}


def text_vectors_sql(weights: str, metric: str, tag: str) -> dict[str, str]:
    """View {tag}v (news_id, v) of ``article_vectors``."""
    per = "OVER (PARTITION BY news_id)"
    unit = f"w / sqrt(sum(w * w) {per})"
    scaled = {"cosine": unit, "hellinger": f"sqrt(w / sum(w) {per})"}.get(metric) or (
        unit if weights == "tfidf" else "w")
    cells = ", ".join(f"sum(x * g[{d + 1}]) * {1.0 / TEXT_DIM ** 0.5!r}" for d in range(TEXT_DIM))
    return {
        f"{tag}x": f"SELECT news_id, token, {scaled} AS x FROM {weights}",
        f"{tag}v": f"SELECT news_id, [{cells}] AS v FROM {tag}x JOIN signs USING (token) GROUP BY news_id",
    }


ROUNDS = 3


@query("clu_1_kmeans", sql(
    f"SELECT vec_id, cluster FROM a{ROUNDS}",
    pts="SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings", **lloyd_sql("pts", "vec_id", 10, ROUNDS)))
def _(t):
    return cluster.lloyd_labels(vectors(t), "vec_id", "embedding", 10, ROUNDS)


# The library's k-means, an option of the same operator, has no closed form.
@query("clu_1_kmeans_of_the_library")
def _(t):
    return cluster.kmeans_labels(vectors(t), "vec_id", 10).select("vec_id", "cluster")


EPS, MIN_SAMPLES, MIN_SIZE = 0.32, 4, 15
_NEAR = "abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 AND (a.cx, a.cy) <> (b.cx, b.cy)"
DENSITY_SQL = sql(
    """SELECT p.vec_id, coalesce(n.cluster, -1)::BIGINT AS cluster FROM points p
       LEFT JOIN placed c USING (cx, cy) LEFT JOIN numbered n USING (root)""",
    sketch=SKETCH_SQL,
    points=f"SELECT vec_id, floor(v[1] / {EPS})::BIGINT AS cx, floor(v[2] / {EPS})::BIGINT AS cy FROM sketch",
    cells="SELECT cx, cy, count(*) AS n FROM points GROUP BY cx, cy",
    dense=f"SELECT cx, cy FROM cells WHERE n >= {MIN_SAMPLES}",
    edges=f"SELECT a.cx, a.cy, b.cx AS bx, b.cy AS by FROM dense a JOIN dense b ON {_NEAR}",
    reach="""SELECT cx, cy, cx AS rx, cy AS ry FROM dense
      UNION SELECT e.bx, e.by, r.rx, r.ry FROM reach r JOIN edges e ON e.cx = r.cx AND e.cy = r.cy""",
    comps="SELECT cx, cy, min([rx, ry]) AS root FROM reach GROUP BY cx, cy",
    placed=f"""SELECT cx, cy, root FROM comps UNION ALL
      SELECT a.cx, a.cy, min(b.root) FROM cells a JOIN comps b ON {_NEAR}
      WHERE a.n < {MIN_SAMPLES} GROUP BY a.cx, a.cy""",
    numbered=f"""SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (
      SELECT root FROM placed JOIN cells USING (cx, cy) GROUP BY root HAVING sum(n) >= {MIN_SIZE})""",
).replace("WITH ", "WITH RECURSIVE ", 1)


@query("clu_2_density", DENSITY_SQL)
def _(t):
    """Density of the vectors after a projection of all their components."""
    labels = cluster.density_labels(sketched(t), "vec_id", 2, EPS, MIN_SAMPLES, MIN_SIZE)
    return labels.withColumn("cluster", F.col("cluster").cast("bigint"))


REACH, CORE_SAMPLES, CORE_SIZE = 0.12, 5, 12
POINT_SQL = {
    "near": """SELECT a.id AS x, b.id AS y FROM {t}pts a CROSS JOIN {t}pts b
      WHERE round(list_distance(a.v, b.v), 9) <= {eps}""",
    "cores": "SELECT x AS id FROM {t}near GROUP BY x HAVING count(*) >= {samples}",
    "core_edges": """SELECT x, y FROM {t}near
      WHERE x IN (SELECT id FROM {t}cores) AND y IN (SELECT id FROM {t}cores)""",
    "reach": """SELECT id, id AS root FROM {t}cores
      UNION SELECT e.y, r.root FROM {t}reach r JOIN {t}core_edges e ON e.x = r.id""",
    "comps": "SELECT id, min(root) AS root FROM {t}reach GROUP BY id",
    "placed": """SELECT id, root FROM {t}comps UNION ALL
      SELECT x, min(root) FROM {t}near JOIN {t}comps ON y = id WHERE x NOT IN (SELECT id FROM {t}cores) GROUP BY x""",
    "numbered": """SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (
      SELECT root FROM {t}placed GROUP BY root HAVING count(*) >= {size})""",
}


def point_views(eps: float, samples: int, size: int, tag: str = "") -> dict[str, str]:
    """Views of ``density.neighbourhood_labels`` over {tag}pts (id, v)."""
    return {tag + n: v.format(eps=eps, samples=samples, size=size, t=tag) for n, v in POINT_SQL.items()}


def point_density_sql(source: str, key: str, eps: float, samples: int, size: int, **views: str) -> str:
    """Twin of ``density.neighbourhood_labels`` over ``source`` (id, v), by comparing all points."""
    body = f"""SELECT p.id AS {key}, coalesce(n.cluster, -1)::INTEGER AS cluster FROM pts p
       LEFT JOIN placed USING (id) LEFT JOIN numbered n USING (root)"""
    return recursive(sql(body, **views, pts=source, **point_views(eps, samples, size)))


@query("clu_2_point_density", point_density_sql(
    "SELECT vec_id AS id, v FROM sketch", "vec_id", REACH, CORE_SAMPLES, CORE_SIZE, sketch=SKETCH_SQL))
def _(t):
    """Density around each vector, after a projection of all components."""
    return density.neighbourhood_labels(sketched(t), "vec_id", 2, REACH, CORE_SAMPLES, CORE_SIZE)


@query("clu_2_density_of_components")
def _(t):
    flat = materialize(reduced(vectors(t), "vec_id", "embedding", 2, "euclidean"), "flat")
    return density.neighbourhood_labels(flat, "vec_id", 2, 0.05, 5, 20)


TEXT_K = 10


@query("clu_3_item_clusters", sql(
    f"SELECT news_id, title, cluster FROM a{ROUNDS} JOIN news USING (news_id)", "news", **WORDS_SQL,
    **text_vectors_sql("tfidf", "hellinger", "t_"), **lloyd_sql("t_v", "news_id", TEXT_K, ROUNDS)))
def _(t):
    """Articles by text: TF-IDF, Hellinger geometry, projection, labels, attached by id."""
    labels = cluster.lloyd_labels(article_vectors(t), "news_id", "embedding", TEXT_K, ROUNDS)
    return cluster.attach_labels(t.news.select("news_id", "title"), labels, "news_id")


@query("clu_3_item_clusters_of_components")
def _(t):
    cats, subs = profiles.values(t)
    items = fe.item_features(profiles.popular(t), cats, subs)
    labelled = cluster.item_clusters(items, article_vectors(t), 30, TEXT_DIM, metric="euclidean")
    return labelled.select("news_id", "popularity", "cluster")


@query("clu_3_item_chain", recursive(sql(
    f"SELECT news_id, title, cluster FROM a{ROUNDS} JOIN news USING (news_id)", "news", **WORDS_SQL,
    **text_vectors_sql("tfidf", "hellinger", "t_"), **components_sql("t_v", "news_id"),
    **lloyd_sql("flat", "news_id", 30, ROUNDS))))
def _(t):
    """Articles by text through every step: TF-IDF, Hellinger geometry, two components, labels."""
    items = t.news.select("news_id", "title")
    return cluster.item_clusters(
        items, article_vectors(t), 30, TEXT_DIM, metric="euclidean", method="lloyd", rounds=ROUNDS)


@query("clu_3_item_clusters_by_density")
def _(t):
    items = t.news.select("news_id")
    return cluster.item_clusters(
        items, article_vectors(t), 0, TEXT_DIM, metric="euclidean", method="density", eps=0.1,
        min_cluster_size=20)


@query("clu_4_user_clusters", sql(
    f"SELECT user_id, cluster FROM a{ROUNDS}", "user_vecs",
    pts="SELECT user_id, features AS v FROM user_vecs", **lloyd_sql("pts", "user_id", 50, ROUNDS)))
def _(t):
    cats, subs = profiles.values(t)
    users = fe.user_features(t.interactions, cats, subs)
    cols = sorted(fe.prefixed(fe.CAT, cats) + fe.prefixed(fe.SUB, subs))
    shares = materialize(fe.aligned(users, ["user_id"], cols), "users")
    return cluster.lloyd_labels(shares, "user_id", "features", 50, ROUNDS)


@query("clu_4_user_clusters_of_components")
def _(t):
    return cluster.user_clusters(user_vectors(t), "features", 50).select("user_id", "cluster")


USERS_SQL = {
    "user_full": """SELECT u.user_id, list_append(features, coalesce(m, 0.0)::DOUBLE) AS v FROM user_vecs u
      LEFT JOIN (SELECT user_id, median(time::INTEGER) / 24 AS m FROM interactions GROUP BY user_id) h
      ON u.user_id = h.user_id""",
}


@query("clu_4_user_chain", recursive(sql(
    f"SELECT user_id, cluster FROM a{ROUNDS}", "user_vecs", **USERS_SQL,
    **components_sql("user_full", "user_id"), **lloyd_sql("flat", "user_id", 50, ROUNDS))))
def _(t):
    """Users by shares and median hour through every step: two components, labels."""
    found = cluster.user_clusters(user_vectors(t), "features", 50, method="lloyd", rounds=ROUNDS)
    return found.select("user_id", "cluster")


SWEEP = [(w, m, k) for w in ("counts", "tfidf") for m in ("cosine", "hellinger") for k in (5, 10)]


def _sweep_sql() -> str:
    views, parts = dict(WORDS_SQL), []
    for n, (weights, metric, k) in enumerate(SWEEP):
        views |= text_vectors_sql(weights, metric, f"t{n}_")
        views |= lloyd_sql(f"t{n}_v", "news_id", k, 1, tag=f"l{n}_")
        parts.append(f"""SELECT '{weights}' AS vectors, '{metric}' AS metric, {k}::BIGINT AS k, news_id, cluster
          FROM l{n}_a1""")
    return sql(" UNION ALL ".join(parts), "news", **views)


@query("clu_5_item_label_sweep", _sweep_sql())
def _(t):
    """Labels of every parameter set: both vectorisations, both metrics, several k."""
    out, built = None, {}
    for weights, metric, k in SWEEP:
        if (weights, metric) not in built:
            built[weights, metric] = article_vectors(t, metric, weights)
        labels = cluster.lloyd_labels(built[weights, metric], "news_id", "embedding", k, 1).select(
            F.lit(weights).alias("vectors"), F.lit(metric).alias("metric"),
            F.lit(k).cast("bigint").alias("k"), "news_id", "cluster")
        out = labels if out is None else out.unionByName(labels)
    return out


@query("clu_5_item_sweep")
def _(t):
    sets = {m: article_vectors(t, m).withColumnRenamed("news_id", "id") for m in ("cosine", "hellinger")}
    return cluster.cluster_sweep(sets, "id", ["euclidean"], [10, 30])


@query("clu_5_user_sweep")
def _(t):
    sets = {"users": user_vectors(t).select(F.col("user_id").alias("id"), F.col("features").alias("embedding"))}
    return cluster.cluster_sweep(sets, "id", ["euclidean", "cosine"], [50])


# ---- sweeps after the reduction, all sets in one scan a round

ITEM_SPACES = [(w, m) for w in ("counts", "tfidf") for m in ("euclidean", "hellinger")]
ITEM_SETS = [(f"{w} {m}", k) for w, m in ITEM_SPACES for k in (10, 30)]
USER_SETS = [(m, k) for m in ("euclidean", "cosine") for k in (25, 50)]
ITEM_DENSITY = [(f"{w} {m}", eps, 10, 50) for (w, m) in ITEM_SPACES
                for eps in ((0.05,) if (w, m) != ("counts", "euclidean") else (0.15,))]


def item_spaces(t: Tables) -> DataFrame:
    """Two components of every vectorisation and metric."""
    return sweeps.stacked({
        f"{w} {m}": reduced(article_vectors(t, m, w), "news_id", "embedding", 2, "euclidean")
        for w, m in ITEM_SPACES}, "news_id")


def user_spaces(t: Tables) -> DataFrame:
    users = user_vectors(t)
    return sweeps.stacked({m: reduced(users, "user_id", "features", 2, m) for m in ("euclidean", "cosine")}, "user_id")


def _tag(space: str) -> str:
    return space.replace(" ", "_") + "_"


def item_spaces_sql() -> dict[str, str]:
    """Views {space}_flat (news_id, v) of ``item_spaces``."""
    views = dict(WORDS_SQL)
    for w, m in ITEM_SPACES:
        tag = f"{w}_{m}_"
        views |= text_vectors_sql(w, m, tag) | components_sql(f"{tag}v", "news_id", tag=tag)
    return views


def user_spaces_sql() -> dict[str, str]:
    views = dict(USERS_SQL)
    for m in ("euclidean", "cosine"):
        views |= components_sql("user_full", "user_id", m, f"{m}_")
    return views


def sweep_sql(spaces: dict[str, str], key: str, sets: list[tuple[str, int]], *needs: str, scores: bool) -> str:
    """Twin of ``sweeps.sweep_labels`` or, with all distances taken, of ``sweeps.sweep_scores``."""
    views, parts = dict(spaces), []
    for space, k in sets:
        tag = f"{_tag(space)}{k}_"
        views |= lloyd_sql(f"{_tag(space)}flat", key, k, ROUNDS, tag=tag)
        labels = f"{tag}a{ROUNDS}"
        if not scores:
            parts.append(f"SELECT '{space}' AS space, {k}::BIGINT AS k, {key}, cluster FROM {labels}")
            continue
        views[f"{tag}size"] = f"SELECT cluster, count(*) AS n FROM {labels} GROUP BY cluster"
        views[f"{tag}far"] = f"""SELECT a.{key}, a.cluster, b.cluster AS other, any_value(s.n) AS own,
            sum((a.v[1] - b.v[1]) ** 2 + (a.v[2] - b.v[2]) ** 2)
              / CASE WHEN a.cluster = b.cluster THEN greatest(count(*) - 1, 1) ELSE count(*) END AS d
          FROM {labels} a CROSS JOIN {labels} b JOIN {tag}size s ON s.cluster = a.cluster
          GROUP BY a.{key}, a.cluster, b.cluster"""
        views[f"{tag}sil"] = f"""SELECT CASE WHEN own = 1 OR greatest(i, o) = 0 THEN 0 ELSE (o - i) / greatest(i, o) END AS s
          FROM (SELECT any_value(own) AS own, max(CASE WHEN other = cluster THEN d END) AS i,
            min(CASE WHEN other <> cluster THEN d END) AS o FROM {tag}far GROUP BY {key}, cluster)"""
        parts.append(f"""SELECT '{space}' AS space, {k}::BIGINT AS k, round(avg(s), 6) AS silhouette,
            (SELECT count(*) FROM {tag}size)::BIGINT AS clusters, (SELECT max(n) FROM {tag}size)::BIGINT AS largest,
            count(*)::BIGINT AS points FROM {tag}sil""")
    return recursive(sql(" UNION ALL ".join(parts), *needs, **views))


@query("clu_5_item_sweep_labels", sweep_sql(item_spaces_sql(), "news_id", ITEM_SETS, "news", scores=False))
def _(t):
    points = item_spaces(t)
    centres = sweeps.fitted_centres(points, "news_id", ITEM_SETS, ROUNDS)
    return sweeps.sweep_labels(points, "news_id", ITEM_SETS, centres)


@query("clu_5_item_sweep_scores", sweep_sql(item_spaces_sql(), "news_id", ITEM_SETS, "news", scores=True))
def _(t):
    points = item_spaces(t)
    centres = sweeps.fitted_centres(points, "news_id", ITEM_SETS, ROUNDS)
    return sweeps.sweep_scores(points, ITEM_SETS, centres).withColumn("silhouette", F.round("silhouette", 6))


@query("clu_5_user_sweep_labels", sweep_sql(user_spaces_sql(), "user_id", USER_SETS, "user_vecs", scores=False))
def _(t):
    points = user_spaces(t)
    centres = sweeps.fitted_centres(points, "user_id", USER_SETS, ROUNDS)
    return sweeps.sweep_labels(points, "user_id", USER_SETS, centres)


@query("clu_5_user_sweep_scores", sweep_sql(user_spaces_sql(), "user_id", USER_SETS, "user_vecs", scores=True))
def _(t):
    points = user_spaces(t)
    centres = sweeps.fitted_centres(points, "user_id", USER_SETS, ROUNDS)
    return sweeps.sweep_scores(points, USER_SETS, centres).withColumn("silhouette", F.round("silhouette", 6))


def _density_sweep_sql() -> str:
    views, parts = item_spaces_sql(), []
    for space, eps, samples, size in ITEM_DENSITY:
        tag = _tag(space)
        views[f"{tag}pts"] = f"SELECT news_id AS id, v FROM {tag}flat"
        views |= point_views(eps, samples, size, tag)
        parts.append(f"""SELECT '{space}' AS space, {eps}::DOUBLE AS eps, {samples}::BIGINT AS min_samples,
            p.id AS news_id, coalesce(n.cluster, -1)::BIGINT AS cluster
          FROM {tag}pts p LEFT JOIN {tag}placed USING (id) LEFT JOIN {tag}numbered n USING (root)""")
    return recursive(sql(" UNION ALL ".join(parts), "news", **views))


@query("clu_5_item_sweep_density", _density_sweep_sql())
def _(t):
    return sweeps.density_sweep(item_spaces(t), "news_id", 2, ITEM_DENSITY)


@query("clu_6_cluster_members", sql(
    """SELECT cluster::BIGINT AS cluster, news_id, title FROM item_clusters JOIN news USING (news_id)
       QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY news_id) <= 4""", "item_clusters", "news"))
def _(t):
    members = rc.cluster_members(t.item_clusters)
    return members.join(t.news.select("news_id", "title"), "news_id").select(
        F.col("cluster").cast("bigint"), "news_id", "title")
