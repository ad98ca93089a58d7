"""Dimension reduction, imputation and stored embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import dot, hellinger_scaled, l2_scaled

# Row transforms that turn the metric into plain euclidean geometry.
METRICS = {"euclidean": lambda v: v, "cosine": l2_scaled, "hellinger": hellinger_scaled}


MAX_WIDTH = 2048


def principal_axes(df: DataFrame, vector: str, dim: int) -> list[list[float]]:
    """The leading ``dim`` axes of the covariance of an array column, each with its largest loading
    positive (the first of equals).

    A task adds up its rows' products and sums; one Gram matrix per task is added entry by entry, so
    the driver gets width x width numbers, the width being at most ``MAX_WIDTH``. Rows with a null or
    non-finite component are left out.
    """
    size = df.select(F.size(vector).alias("n")).agg(F.max("n")).first()[0] or 0
    if size > MAX_WIDTH:
        raise ValueError(f"{size} components; project them to {MAX_WIDTH} or fewer first")
    if size < 1:
        return [[0.0]] * dim

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            rows = [r for r in batch.column(0).to_pylist() if r is not None and len(r) == size and None not in r]
            block = np.array(rows, float).reshape(len(rows), size)
            block = block[np.isfinite(block).all(axis=1)]
            block = np.hstack([np.ones((len(block), 1)), block])
            total += block.T @ block
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["gram"])

    grams = df.select(vector).mapInArrow(products, "gram array<double>")
    summed = grams.select(F.posexplode("gram").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x"))
    gram = np.zeros((size + 1) ** 2)
    for r in summed.collect():
        gram[r["pos"]] = r["x"]
    gram = gram.reshape(size + 1, size + 1)
    n = max(gram[0, 0], 1.0)
    mean = gram[0, 1:] / n
    _, axes = np.linalg.eigh(gram[1:, 1:] / n - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :dim].T
    largest = np.abs(np.round(axes, 9)).argmax(axis=1)
    axes *= np.where(axes[np.arange(len(axes)), largest] < 0, -1.0, 1.0)[:, None]
    return axes.tolist()


def reduced(df: DataFrame, key: str, features: str, dim: int, metric: str = "hellinger") -> DataFrame:
    """(key, embedding) with the leading ``dim`` principal components after the metric's transform."""
    moved = METRICS[metric](F.col(features).cast("array<double>"))
    vectors = df.select(key, moved.alias("_x"))
    axes = principal_axes(vectors, "_x", dim)
    cells = [dot(F.col("_x"), F.lit(axis)) for axis in axes]
    return vectors.select(key, F.array(*cells).alias("embedding"))


def mean_imputed(df: DataFrame, col: str, dim: int) -> DataFrame:
    """Missing or NaN components replaced by the mean of the present ones."""
    cells = [F.nanvl(F.element_at(col, i + 1).cast("double"), F.lit(None).cast("double")) for i in range(dim)]
    means = df.agg(F.array(*[F.avg(c) for c in cells]).alias("m")).scalar()
    fixed = [F.coalesce(c, F.element_at(means, i + 1)) for i, c in enumerate(cells)]
    return df.withColumn(col, F.array(*fixed))


def stored_or_computed(
    spark: SparkSession, folder: str, params: dict, compute: Callable[[], DataFrame]
) -> DataFrame:
    """Embeddings of exactly these parameters: read when stored, else computed and stored."""
    name = "_".join(f"{k}={params[k]}" for k in sorted(params))
    path = f"{folder.rstrip('/')}/{name}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # nothing stored under these parameters
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
