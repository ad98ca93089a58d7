"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

EDGES_PER_TASK = 1_000_000
_STAR_SQL = "u long, r long"


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as stars: (node, smallest node that the task's edges join it to)."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts))
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    half = len(a)
    for x, y in zip(index[:half].tolist(), index[half:].tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    roots = np.array([find(x) for x in range(len(nodes))], dtype=np.int64)
    moved = np.flatnonzero(roots != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays(
        [pa.array(nodes[moved]), pa.array(nodes[roots[moved]])], names=["u", "r"]
    )


def components(edges: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(u, r): for every node but the smallest of its component, that smallest node.

    ``edges`` holds pairs of longs (u, r). Each round deals the edges by their larger node to tasks
    of about ``edges_per_task``, which replace theirs by stars, and then moves every node from its
    star's centre to that centre's own centre. Stars only shrink, so the number of edges never grows;
    the rounds end when every node has one centre that is no node of another star. Each round is
    written to the shared folder.
    """
    ordered = edges.where("u <> r").select(
        F.greatest("u", "r").alias("u"), F.least("u", "r").alias("r")
    )
    current = materialize(ordered, "edges")
    while True:
        tasks = -(-current.count() // edges_per_task)
        if tasks <= 1:  # one task has every edge that is left, so its stars are the components
            return materialize(current.coalesce(1).mapInArrow(_contract, _STAR_SQL), "stars")
        stars = current.repartition(tasks, "u").mapInArrow(_contract, _STAR_SQL)
        stars = materialize(stars.distinct(), "stars")
        up = stars.groupBy("u").agg(F.min("r").alias("above"))
        joined = stars.join(up.withColumnRenamed("u", "r"), "r", "left")
        state = joined.agg(
            F.count("above").alias("inner"), F.count(F.lit(1)).alias("edges"),
        ).first()
        if state["inner"] == 0 and up.count() == state["edges"]:
            return stars
        moved = joined.select("u", F.coalesce("above", "r").alias("r"))
        centres = joined.where("above is not null").select(
            F.col("r").alias("u"), F.col("above").alias("r")
        )
        several = stars.join(up, "u").where("r <> above").select(
            F.col("r").alias("u"), F.col("above").alias("r")
        ).where("u <> r").select(
            F.greatest("u", "r").alias("u"), F.least("u", "r").alias("r")
        )
        current = materialize(
            moved.unionByName(centres).unionByName(several).where("u <> r").distinct(), "edges"
        )
