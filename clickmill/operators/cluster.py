"""Cluster labels for embeddings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import hash_uniform
from ..session import materialize
from .density import neighbourhood_labels, star_components
from .ranking import global_row_number
from .reduce import mean_imputed, reduced

SEED = 42
LABEL_ROWS = 512  # rows per block of distances


def kmeans_labels(embeddings: DataFrame, key: str, k: int = 10, seed: int = SEED) -> DataFrame:
    """(key, embedding, cluster) by k-means."""
    vectors = embeddings.select(key, "embedding", array_to_vector("embedding").alias("_x"))
    model = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster").fit(vectors)
    return model.transform(vectors).drop("_x")


def lloyd_labels(
    points: DataFrame, key: str, vector: str, k: int, rounds: int, seed: int = SEED
) -> DataFrame:
    """(key, cluster) after a fixed number of Lloyd rounds.

    The first centres are the ``k`` points with the smallest seeded hash of their key, so the result
    does not depend on partitioning. Distances are compared at nine digits, ties go to the lower
    cluster, and a centre without points stays where it is. Centres are all that leaves the tasks:
    k rows per round, from sums with map-side combining.
    """
    rows = points.select(F.col(key), F.col(vector).cast("array<double>").alias("_v"))
    draw = hash_uniform(F.col(key), F.lit(seed))
    first = rows.orderBy(draw, key).limit(k).select("_v").collect()
    centres = [list(r["_v"]) for r in first]
    if not centres:
        return rows.select(key, F.lit(None).cast("bigint").alias("cluster"))
    width = len(centres[0])
    for _ in range(rounds):
        means = _labelled(rows, key, centres).groupBy("cluster").agg(
            *[F.avg(F.element_at("_v", i + 1)).alias(f"m{i}") for i in range(width)]
        )
        for row in means.collect():
            centres[row["cluster"]] = [row[f"m{i}"] for i in range(width)]
    return _labelled(rows, key, centres).select(key, "cluster")


def nearest_centres(block: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of every row, at nine digits, the lowest of equals."""
    gaps = block[:, None, :] - table[None, :, :]
    return np.round(np.sqrt((gaps * gaps).sum(axis=2)), 9).argmin(axis=1)


def _labelled(rows: DataFrame, key: str, centres: list[list[float]]) -> DataFrame:
    """(key, _v, cluster): number of the nearest centre, the lowest of equals."""
    table = np.array(centres)
    kind = rows.schema[key].dataType.simpleString()

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for k in range(0, len(batch), LABEL_ROWS):
                block = np.stack(batch["_v"].iloc[k:k + LABEL_ROWS].to_list())
                found.append(nearest_centres(block, table))
            yield batch.assign(cluster=np.concatenate([np.zeros(0, np.int64), *found]))

    return rows.mapInPandas(label, f"{key} {kind}, _v array<double>, cluster bigint")


def density_labels(
    embeddings: DataFrame,
    key: str,
    dim: int,
    eps: float,
    min_samples: int = 10,
    min_cluster_size: int = 50,
) -> DataFrame:
    """(key, cluster) by grid density; noise is -1.

    Points fall in square cells of side ``eps``. A cell with at least ``min_samples`` points is
    dense; touching dense cells form a cluster; points of other cells join the smallest touching
    cluster. Clusters below ``min_cluster_size`` points become noise. Only cell counts are joined,
    so a crowded cell costs one row.
    """
    cell = F.array(*[F.floor(F.element_at("embedding", i + 1) / eps) for i in range(dim)])
    points = embeddings.select(key, cell.alias("node"))
    counts = materialize(points.groupBy("node").agg(F.count("*").alias("n")), "cells")
    dense = counts.where(F.col("n") >= min_samples).select("node")
    steps = [s for s in product((-1, 0, 1), repeat=dim) if any(s)]
    around = F.explode(
        F.array(*[
            F.array(*[F.element_at("node", i + 1) + F.lit(s[i]).cast("bigint") for i in range(dim)])
            for s in steps
        ])
    )
    links = counts.select(F.col("node").alias("src"), around.alias("dst")).join(
        dense.select(F.col("node").alias("dst")), "dst"
    )
    links = materialize(links, "links")
    edges = links.join(dense.select(F.col("node").alias("src")), "src")
    # The components work on numbers: a cell's place in the order of cells.
    numbers = materialize(global_row_number(dense, ["node"], "number"), "numbers")
    by_number = edges.join(numbers.select(F.col("node").alias("src"), F.col("number").alias("s")), "src").join(
        numbers.select(F.col("node").alias("dst"), F.col("number").alias("d")), "dst")
    roots = star_components(
        by_number.select(F.col("s").alias("src"), F.col("d").alias("dst")), numbers.select(F.col("number").alias("node")))
    components = roots.withColumnRenamed("node", "number").join(numbers, "number").join(
        numbers.select(F.col("number").alias("root"), F.col("node").alias("root_node")), "root"
    ).select("node", F.col("root_node").alias("root"))
    components = materialize(components, "components")
    fringe = links.join(dense.select(F.col("node").alias("src")), "src", "left_anti").join(
        components.withColumnRenamed("node", "dst"), "dst"
    ).groupBy(F.col("src").alias("node")).agg(F.min("root").alias("root"))
    by_cell = components.unionByName(fringe)
    sized = by_cell.join(counts, "node").groupBy("root").agg(F.sum("n").alias("points"))
    large = sized.where(F.col("points") >= min_cluster_size).select("root")
    numbered = global_row_number(large, ["root"], "number")
    numbered = numbered.select("root", (F.col("number") - 1).alias("cluster"))
    labelled = by_cell.join(numbered, "root").select("node", "cluster")
    return points.join(labelled, "node", "left").select(
        key, F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster")
    )


def attach_labels(features: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Labels by key, never by position."""
    return features.join(labels.select(key, "cluster"), key)


def item_clusters(
    items: DataFrame, text_vectors: DataFrame, k: int, dim_in: int, metric: str = "hellinger",
    method: str = "kmeans", eps: float = 0.05, min_samples: int = 10, min_cluster_size: int = 50,
    rounds: int = 20,
) -> DataFrame:
    """Items with a cluster from their text vectors (news_id, embedding).

    ``method`` is ``kmeans`` (the library's), ``lloyd`` (``rounds`` rounds from hashed centres),
    ``density`` or ``grid``.
    """
    flat = reduced(text_vectors, "news_id", "embedding", min(2, dim_in), metric)
    flat = materialize(mean_imputed(flat, "embedding", 2), "items2d")
    if method == "kmeans":
        labels = kmeans_labels(flat, "news_id", k)
    elif method == "lloyd":
        labels = lloyd_labels(flat, "news_id", "embedding", k, rounds)
    elif method == "density":
        labels = neighbourhood_labels(flat, "news_id", 2, eps, min_samples, min_cluster_size)
    elif method == "grid":
        labels = density_labels(flat, "news_id", 2, eps, min_samples, min_cluster_size)
    else:
        raise ValueError(f"unknown method {method!r}")
    return attach_labels(items, labels, "news_id")


def user_clusters(
    users: DataFrame, features: str, k: int = 50, metric: str = "euclidean", method: str = "kmeans",
    rounds: int = 20,
) -> DataFrame:
    """Users (user_id, features) with a cluster; ``method`` is ``kmeans`` or ``lloyd``."""
    flat = materialize(reduced(users, "user_id", features, 2, metric), "users2d")
    if method == "kmeans":
        labels = kmeans_labels(flat, "user_id", k)
    elif method == "lloyd":
        labels = lloyd_labels(flat, "user_id", "embedding", k, rounds)
    else:
        raise ValueError(f"unknown method {method!r}")
    return attach_labels(users, labels, "user_id")


def cluster_sweep(
    vectors: dict[str, DataFrame], key: str, metrics: Sequence[str], ks: Sequence[int]
) -> DataFrame:
    """Silhouette and size figures of every (vectors, metric, k): one row each."""
    rows = []
    spark = None
    for name, df in vectors.items():
        spark = df.sparkSession
        for metric in metrics:
            flat = materialize(mean_imputed(reduced(df, key, "embedding", 2, metric), "embedding", 2), "sweep")
            for k in ks:
                labelled = kmeans_labels(flat, key, k).withColumn("_x", array_to_vector("embedding"))
                score = ClusteringEvaluator(featuresCol="_x", predictionCol="cluster").evaluate(labelled)
                sizes = labelled.groupBy("cluster").agg(F.count("*").alias("n"))
                n, largest = sizes.agg(F.count("*"), F.max("n")).first()
                rows.append((name, metric, k, score, n, largest))
    return spark.createDataFrame(
        rows, "vectors string, metric string, k bigint, silhouette double, clusters bigint, largest bigint"
    )
