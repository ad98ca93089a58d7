"""Cluster labels and scores of many parameter sets at once.

Points of all spaces (a space is one vectorisation under one metric) lie in one long table. A round
reads it once for every parameter set: each task adds up its points per (set, cluster) and sends one
partial sum for each, so the jobs of a sweep do not grow with the sets and the driver gets
k x (width + 2) numbers a set.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import hash_uniform
from ..session import materialize
from .cluster import LABEL_ROWS, SEED, nearest_centres
from .density import neighbourhood_labels
from .ranking import top_n_per_group

Sets = Sequence[tuple[str, int]]  # (space, k)


def stacked(spaces: dict[str, DataFrame], key: str, vector: str = "embedding") -> DataFrame:
    """(space, key, vector) of several tables, stored once."""
    parts = [
        df.select(F.lit(name).alias("space"), key, F.col(vector).cast("array<double>").alias("vector"))
        for name, df in spaces.items()
    ]
    return materialize(reduce(DataFrame.unionByName, parts), "spaces")


def _usable(vector: str = "vector"):
    """Whether a vector has components, none of them null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def first_centres(points: DataFrame, key: str, sets: Sets, seed: int = SEED) -> list[np.ndarray]:
    """Per set the k points of its space with the smallest seeded hash of their key, in that order.

    A space with fewer points gives as many centres as it has. A larger k starts with the centres of
    a smaller one. Vectors of another length than the first centre's are no centres.
    """
    draw = hash_uniform(F.col(key), F.lit(seed))
    most = max((k for _, k in sets), default=0)
    rows = top_n_per_group(
        points.where(_usable()).select("space", "vector", draw.alias("draw"), key), ["space"],
        [F.col("draw"), F.col(key)], most)
    heads: dict[str, list] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["draw"], r[key])):  # at most spaces x largest k
        heads.setdefault(r["space"], []).append(r["vector"])
    out = []
    for space, k in sets:
        mine = heads.get(space, [])
        out.append(np.array([v for v in mine if len(v) == len(mine[0])][:k], float))
    return out


def _blocks(batches: Iterator[pa.RecordBatch], sets: Sets, centres: list[np.ndarray]):
    """(set number, row numbers, vectors, labels) for blocks of a batch's usable rows, batch by batch."""
    of_space: dict[str, list[int]] = {}
    for n, (space, _) in enumerate(sets):
        if len(centres[n]):
            of_space.setdefault(space, []).append(n)
    for batch in batches:
        spaces = batch.column("space").to_pylist()
        vectors = batch.column("vector").to_pylist()
        rows_of: dict[str, list[int]] = {}
        for i, space in enumerate(spaces):
            rows_of.setdefault(space, []).append(i)
        found = []
        for space, rows in rows_of.items():
            numbers = of_space.get(space, [])
            if not numbers:
                continue
            width = centres[numbers[0]].shape[1]
            fit = [i for i in rows if vectors[i] is not None and len(vectors[i]) == width and None not in vectors[i]]
            for start in range(0, len(fit), LABEL_ROWS):
                part = np.array(fit[start:start + LABEL_ROWS])
                block = np.array([vectors[i] for i in part], float)
                keep = np.isfinite(block).all(axis=1)
                part, block = part[keep], block[keep]
                if len(part):
                    found += [(n, part, block, nearest_centres(block, centres[n])) for n in numbers]
        yield batch, found


def _summed(points: DataFrame, sets: Sets, centres: list[np.ndarray]) -> list[np.ndarray]:
    """Per set a matrix, one row per cluster: points, sum of squared lengths, sum of each component.

    Vectors are taken from the set's first centre, so that a far origin costs no digits.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(c), c.shape[1] + 2)) if len(c) else None for c in centres]
        for _, found in _blocks(batches, sets, centres):
            for n, _, block, labels in found:
                moved = block - centres[n][0]
                facts = np.column_stack([np.ones(len(block)), (moved * moved).sum(axis=1), moved])
                np.add.at(sums[n], labels, facts)
        used = [(n, c, row) for n, s in enumerate(sums) if s is not None for c, row in enumerate(s) if row[0]]
        yield pa.RecordBatch.from_arrays([
            pa.array([u[0] for u in used], pa.int32()), pa.array([u[1] for u in used], pa.int32()),
            pa.array([u[2].tolist() for u in used], pa.list_(pa.float64())),
        ], ["setno", "cluster", "facts"])

    rows = points.select("space", "vector").mapInArrow(partial, "setno int, cluster int, facts array<double>")
    rows = rows.select("setno", "cluster", F.posexplode("facts").alias("place", "x"))
    out = [np.zeros((len(c), c.shape[1] + 2 if len(c) else 2)) for c in centres]
    for r in rows.groupBy("setno", "cluster", "place").agg(F.sum("x").alias("x")).collect():
        out[r["setno"]][r["cluster"], r["place"]] = r["x"]
    return out


def fitted_centres(points: DataFrame, key: str, sets: Sets, rounds: int, seed: int = SEED) -> list[np.ndarray]:
    """Centres of every set after ``rounds`` Lloyd rounds, one scan of the points a round.

    The rules are those of ``cluster.lloyd_labels``: nine digits, ties to the lower cluster, a centre
    without points stays.
    """
    centres = first_centres(points, key, sets, seed)
    for _ in range(rounds):
        for n, facts in enumerate(_summed(points, sets, centres)):
            full = facts[:, 0] > 0
            if full.any():
                origin = centres[n][0].copy()
                centres[n][full] = origin + facts[full, 2:] / facts[full, :1]
    return centres


def sweep_labels(points: DataFrame, key: str, sets: Sets, centres: list[np.ndarray]) -> DataFrame:
    """(space, k, key, cluster) for every point and set of its space, in one scan.

    A vector that is null, has a null or non-finite component or another length than its space's
    centres gets a null cluster. Repeated rows are labelled each; an empty table gives no rows.
    """
    kind = points.schema[key].dataType.simpleString()
    ids = points.schema[key].name
    of_space: dict[str, list[int]] = {}
    for n, (space, _) in enumerate(sets):
        of_space.setdefault(space, []).append(n)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _blocks(batches, sets, centres):
            labels = {n: np.full(batch.num_rows, -1, np.int64) for n in range(len(sets))}
            for n, rows, _, mine in found:
                labels[n][rows] = mine
            spaces = np.array(batch.column("space").to_pylist(), object)
            for space, numbers in of_space.items():
                at = np.flatnonzero(spaces == space)
                picked = batch.take(pa.array(at))
                for n in numbers:
                    mine = labels[n][at]
                    yield pa.RecordBatch.from_arrays([
                        picked.column("space"), pa.array(np.full(len(at), sets[n][1], np.int64)),
                        picked.column(ids), pa.array(mine, mask=mine < 0),
                    ], ["space", "k", ids, "cluster"])

    return points.select("space", key, "vector").mapInArrow(
        label, f"space string, k bigint, `{ids}` {kind}, cluster bigint")


def sweep_scores(points: DataFrame, sets: Sets, centres: list[np.ndarray]) -> DataFrame:
    """(space, k, silhouette, clusters, largest, points): one row per set, from two scans for all sets.

    The silhouette is the exact one over squared distances: a point's mean squared distance to a
    cluster follows from the cluster's count, sum and sum of squared lengths. A point alone in its
    cluster counts 0; with fewer than two clusters the silhouette is null. Unusable vectors do not count.
    """
    facts = _summed(points, sets, centres)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(len(sets))
        for _, found in _blocks(batches, sets, centres):
            for n, _, block, labels in found:
                totals[n] += _silhouettes(block - centres[n][0], labels, facts[n]).sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(sets), dtype=np.int32)), pa.array(totals)], ["setno", "s"])

    rows = points.select("space", "vector").mapInArrow(score, "setno int, s double")
    sums = {r["setno"]: r["s"] for r in rows.groupBy("setno").agg(F.sum("s").alias("s")).collect()}
    out = []
    for n, (space, k) in enumerate(sets):
        sizes = facts[n][:, 0]
        clusters, count = int((sizes > 0).sum()), int(sizes.sum())
        mean = sums[n] / count if clusters > 1 else None
        out.append((space, k, mean, clusters, int(sizes.max(initial=0)), count))
    return points.sparkSession.createDataFrame(
        out, "space string, k bigint, silhouette double, clusters bigint, largest bigint, points bigint")


def _silhouettes(block: np.ndarray, labels: np.ndarray, facts: np.ndarray) -> np.ndarray:
    """Silhouettes of a block of points under squared distances."""
    size = facts[:, 0]
    full = np.maximum(size, 1.0)
    far = (block * block).sum(axis=1)[:, None] - 2 * block @ (facts[:, 2:] / full[:, None]).T + facts[:, 1] / full
    far = np.where(size > 0, np.maximum(far, 0.0), np.inf)
    at = np.arange(len(block)), labels
    own = size[labels]
    inside = far[at] * own / np.maximum(own - 1, 1)
    far[at] = np.inf
    outside = far.min(axis=1)
    larger = np.maximum(inside, outside)
    valid = (own > 1) & np.isfinite(larger) & (larger > 0)
    return np.where(valid, (outside - inside) / np.where(valid, larger, 1.0), 0.0)


def density_sweep(
    points: DataFrame, key: str, dim: int, sets: Sequence[tuple[str, float, int, int]]
) -> DataFrame:
    """(space, eps, min_samples, key, cluster) for sets (space, eps, min_samples, min_cluster_size):
    density labels as ``density.neighbourhood_labels`` gives them, noise -1."""
    parts = []
    for space, eps, samples, least in sets:
        mine = points.where(F.col("space") == space).select(key, F.col("vector").alias("embedding"))
        labels = neighbourhood_labels(mine, key, dim, eps, samples, least)
        parts.append(labels.select(
            F.lit(space).alias("space"), F.lit(float(eps)).alias("eps"),
            F.lit(samples).cast("bigint").alias("min_samples"), key, F.col("cluster").cast("bigint")))
    return reduce(DataFrame.unionByName, parts)
