"""Density labels against plain comparisons of all points; components of long chains."""

from __future__ import annotations

import math

import numpy as np
import pytest

from clickmill.operators import density
from clickmill.operators.density import neighbourhood_labels, star_components


def labels_of_all_pairs(points, eps, samples, size):
    """{key: cluster} by comparing all points."""
    keys = sorted(points)
    v = np.array([points[k] for k in keys], float).reshape(len(keys), -1)
    near = [[m for m in range(len(keys)) if round(math.dist(v[n], v[m]), 9) <= eps] for n in range(len(keys))]
    core = [len(n) >= samples for n in near]
    root = {}
    for n in range(len(keys)):
        if core[n] and n not in root:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = n
                    todo += [y for y in near[x] if core[y]]
    for n in range(len(keys)):
        if not core[n] and any(core[y] for y in near[n]):
            root[n] = min(root[y] for y in near[n] if core[y])
    sizes = np.bincount(list(root.values()), minlength=1)
    large = [r for r in sorted(set(root.values())) if sizes[r] >= size]
    return {k: large.index(root[n]) if root.get(n) in large else -1 for n, k in enumerate(keys)}


def spark_labels(spark, points, dim, eps, samples, size):
    rows = [(k, [float(x) for x in v], 1, 2) for k, v in points.items()]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, n int, cell int")
    got = {r.id: r.cluster for r in neighbourhood_labels(df, "id", dim, eps, samples, size).collect()}
    assert len(got) == len(points)
    return got


@pytest.mark.parametrize("compared", [1, 1 << 14])
def test_equal_to_all_pairs(spark, monkeypatch, compared):
    """Blobs, a line, copies of one point and noise; with and without cutting blocks."""
    monkeypatch.setattr(density, "COMPARED_PAIRS", compared)
    monkeypatch.setattr(density, "SHARE_ROWS", 7)
    rng = np.random.default_rng(compared)
    v = np.concatenate([
        rng.normal(0, 0.08, (60, 2)), rng.normal((0.9, 0.2), 0.1, (60, 2)), rng.uniform(-1, 2, (40, 2)),
        np.stack([np.linspace(-1, 1, 40), np.full(40, -0.7)], axis=1), np.full((30, 2), 1.5),
        np.stack([np.full(20, 1.5), 1.5 + rng.choice([0.2, 0.2 + 1e-7], 20)], axis=1),
    ])
    points = {int(k): p for k, p in zip(rng.permutation(len(v)), v)}
    assert spark_labels(spark, points, 2, 0.2, 5, 8) == labels_of_all_pairs(points, 0.2, 5, 8)


def test_more_dimensions_than_listed_axes(spark):
    rng = np.random.default_rng(9)
    points = dict(enumerate(np.concatenate([rng.normal(0, 0.3, (50, 4)), rng.normal(1, 0.3, (50, 4))])))
    got = spark_labels(spark, points, 4, 0.5, 4, 5)
    assert got == labels_of_all_pairs(points, 0.5, 4, 5) and len(set(got.values())) > 2


def test_a_group_on_a_border_of_cells_is_one(spark):
    """Each of the four cells around a corner has too few points by itself."""
    side = 0.2 / math.sqrt(2)
    points = {k: (side * 3 + dx, side * 5 + dy) for k, (dx, dy) in enumerate(
        [(-0.01, -0.01), (0.01, -0.01), (-0.01, 0.01), (0.01, 0.01), (0.02, 0.0), (-0.02, 0.0)])}
    assert set(spark_labels(spark, points, 2, 0.2, 6, 6).values()) == {0}


def test_rows_without_a_place_are_noise(spark):
    rows = [(k, [0.0, 0.1]) for k in range(6)] + [
        (10, None), (11, [None, 0.0]), (12, [float("nan"), 0.0]), (13, [0.0]), (14, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = {r.id: r.cluster for r in neighbourhood_labels(df, "id", 2, 0.2, 3, 3).collect()}
    assert got == {**{k: 0 for k in range(6)}, **{k: -1 for k in range(10, 15)}}
    assert neighbourhood_labels(df.where("false"), "id", 2, 0.2, 3, 3).count() == 0


def test_a_crowded_cell_is_linear(spark, monkeypatch):
    """Points of crowded cells meet no other point of theirs: comparisons grow with their number."""
    compared = []
    original = density._close_points

    def counted(points, asked, answering, eps):
        every = original(points, asked, answering, float("inf"))
        compared.append(every.count())
        return original(points, asked, answering, eps)

    monkeypatch.setattr(density, "_close_points", counted)
    rng = np.random.default_rng(1)
    edge = {100_000 + k: (0.15 + 0.01 * k, 0.05) for k in range(3)}
    totals = []
    for n in (1000, 10_000):
        compared.clear()
        points = {k: tuple(rng.uniform(0, 0.14, 2)) for k in range(n)} | edge
        assert set(spark_labels(spark, points, 2, 0.2, 5, 5).values()) == {0}
        totals.append(sum(compared))
    assert totals[1] <= 10.5 * totals[0] and totals[1] <= 5 * 10_000


def test_components_of_a_long_chain(spark):
    chain = [(k, k + 1) for k in range(0, 2000)] + [(5000, 5001), (5001, 5000), (5002, 5002)]
    edges = spark.createDataFrame(chain, "src long, dst long")
    nodes = spark.createDataFrame([(n,) for n in [*range(2001), 5000, 5001, 5002, 7000]], "node long")
    got = {r.node: r.root for r in star_components(edges, nodes).collect()}
    assert got == {**{k: 0 for k in range(2001)}, 5000: 5000, 5001: 5000, 5002: 5002, 7000: 7000}
