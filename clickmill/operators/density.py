"""Density labels from the neighbourhood of every point, over grid cells."""

from __future__ import annotations

from itertools import product
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import euclidean, total
from ..session import materialize
from .ranking import global_row_number

SHARE_ROWS = 4096  # points of a crowded cell that one task compares with its neighbours
COMPARED_PAIRS = 1 << 14  # two blocks with at most so many pairs of points are compared outright
OFFSET_AXES = 3  # axes over which neighbouring cells are listed; the others are filtered


def star_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root): smallest node of every connected component, by star contraction.

    ``edges`` is (src, dst) over long ids, in any direction, repeated or not. A round hangs the
    larger neighbours of a node under its smallest one, then the smaller ones; it ends when a round
    changes nothing, which takes a number of rounds that grows with the logarithm of the nodes.
    """
    high, low = F.greatest("src", "dst"), F.least("src", "dst")
    tied = materialize(
        edges.where("src <> dst").select(high.alias("u"), low.alias("v")).distinct(), "stars"
    )
    state = None
    while True:
        signature = tied.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if signature == state:
            break
        state = signature
        both = tied.unionByName(tied.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        tied = materialize(
            moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars"
        )
    roots = tied.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.join(roots, F.col("node") == F.col("u"), "left").select(
        "node", F.coalesce("root", "node").alias("root")
    )


def _gap(a: Column, b: Column) -> Column:
    """Distance at nine digits, as all comparisons see it."""
    return F.round(euclidean(a, b), 9)


def _length(parts: list[Column]) -> Column:
    return F.round(F.sqrt(total(F.array(*[p * p for p in parts]))), 9)


def _axis(name: str, i: int) -> Column:
    return F.element_at(name, i + 1)


def _neighbours(cells: DataFrame, dim: int) -> DataFrame:
    """(cid, other): occupied cells that may hold points within reach, a cell itself included."""
    reach = ceil(sqrt(dim))
    axes = min(dim, OFFSET_AXES)
    steps = [
        s for s in product(range(-reach, reach + 1), repeat=axes)
        if sum(max(abs(x) - 1, 0) ** 2 for x in s) <= dim
    ]
    moved = F.array(*[
        F.array(*[_axis("cell", i) + F.lit(s[i]).cast("bigint") for i in range(axes)]) for s in steps
    ])
    asked = cells.select("cid", F.col("cell").alias("from"), F.explode(moved).alias("at"))
    found = cells.select(
        F.col("cid").alias("other"), F.col("cell").alias("to"), F.slice("cell", 1, axes).alias("at")
    )
    apart = [F.greatest(F.abs(_axis("from", i) - _axis("to", i)) - 1, F.lit(0)) for i in range(dim)]
    return asked.join(found, "at").where(sum((g * g for g in apart), F.lit(0)) <= dim).select("cid", "other")


def _blocks(points: DataFrame, dim: int, level: int, side: float) -> DataFrame:
    """(cid, sub, n, lo, hi): crowded cells cut into blocks of side / 2^level, with tight boxes."""
    return points.withColumn("sub", _sub(dim, level, side)).groupBy("cid", "sub").agg(
        F.count("*").alias("n"),
        F.array(*[F.min(_axis("v", i)) for i in range(dim)]).alias("lo"),
        F.array(*[F.max(_axis("v", i)) for i in range(dim)]).alias("hi"),
    )


def _sub(dim: int, level: int, side: float) -> Column:
    return F.array(*[F.floor(_axis("v", i) * float(2**level) / side) for i in range(dim)])


def _ends(blocks: DataFrame, end: str) -> DataFrame:
    return blocks.select(*[F.col(c).alias(f"{c}_{end}") for c in blocks.columns])


def _joined_crowded(points: DataFrame, pairs: DataFrame, dim: int, eps: float, side: float) -> DataFrame:
    """(src, dst): neighbouring crowded cells that hold two points within ``eps``.

    Pairs of blocks start as the cells themselves. Boxes that lie wholly within reach join their
    cells, boxes out of reach are dropped, small blocks are compared point by point, and what
    remains is cut into blocks of half the side. A cell pair leaves as soon as it is joined, so only
    blocks along the rim of two cells that stay apart are ever cut far.
    """
    found = None
    level = 0
    pair = ["cid_a", "cid_b"]
    blocks = materialize(_blocks(points, dim, level, side), "blocks")
    open_pairs = pairs.select(F.col("cid").alias("cid_a"), F.col("other").alias("cid_b")).join(
        _ends(blocks, "a"), "cid_a").join(_ends(blocks, "b"), "cid_b")
    while True:
        far = _length([
            F.greatest(_axis("hi_a", i) - _axis("lo_b", i), _axis("hi_b", i) - _axis("lo_a", i))
            for i in range(dim)
        ])
        near = _length([
            F.greatest(_axis("lo_b", i) - _axis("hi_a", i), _axis("lo_a", i) - _axis("hi_b", i), F.lit(0.0))
            for i in range(dim)
        ])
        judged = materialize(
            open_pairs.withColumn("within", far <= eps).where(F.col("within") | (near <= eps)), "pairs"
        )
        sure = judged.where("within").select(*pair).distinct()
        rest = judged.where("not within").join(sure, pair, "left_anti")
        small = rest.where(F.col("n_a") * F.col("n_b") <= COMPARED_PAIRS)
        inside = points.withColumn("sub", _sub(dim, level, side)).select("cid", "sub", "v")
        close = small.select(*pair, "sub_a", "sub_b").join(
            _ends(inside, "a"), ["cid_a", "sub_a"]).join(
            _ends(inside, "b"), ["cid_b", "sub_b"]).where(_gap(F.col("v_a"), F.col("v_b")) <= eps)
        fresh = materialize(sure.unionByName(close.select(*pair)).distinct(), "joined")
        found = fresh if found is None else found.unionByName(fresh)
        large = materialize(
            rest.where(F.col("n_a") * F.col("n_b") > COMPARED_PAIRS)
            .join(fresh, pair, "left_anti").select(*pair, "sub_a", "sub_b"), "open")
        if not large.limit(1).count():
            return found.select(F.col("cid_a").alias("src"), F.col("cid_b").alias("dst"))
        level += 1
        held = large.select(F.explode(F.array("cid_a", "cid_b")).alias("cid")).distinct()
        blocks = materialize(
            _blocks(points.join(held, "cid", "left_semi"), dim, level, side), "blocks")
        parent = F.transform("sub", lambda x: F.floor(x / 2))
        children = blocks.withColumn("parent", parent)
        a = _ends(children, "a").withColumn("sub_of_a", F.col("parent_a"))
        b = _ends(children, "b").withColumn("sub_of_b", F.col("parent_b"))
        cut = large.withColumnsRenamed({"sub_a": "sub_of_a", "sub_b": "sub_of_b"})
        open_pairs = cut.join(a, ["cid_a", "sub_of_a"]).join(b, ["cid_b", "sub_of_b"]).drop(
            "sub_of_a", "sub_of_b", "parent_a", "parent_b")


def _close_points(points: DataFrame, asked: DataFrame, answering: DataFrame, eps: float) -> DataFrame:
    """(key, cid, other, near): points within ``eps`` of the asking ones, cell by cell.

    A cell with many points answers in shares, each of which gets its own copy of the few questions.
    """
    shares = answering.select(
        F.col("cid").alias("other"), F.ceil(F.col("n") / SHARE_ROWS).cast("bigint").alias("shares")
    )
    questions = asked.join(shares, "other").select(
        "key", "cid", "other", "v", "shares",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)).alias("share"),
    )
    answers = points.select(
        F.col("cid").alias("other"), F.col("key").alias("near"), F.col("v").alias("w")
    ).join(shares, "other").withColumn("share", F.pmod(F.xxhash64("near"), F.col("shares"))).drop("shares")
    return questions.drop("shares").join(answers, ["other", "share"]).where(
        _gap(F.col("v"), F.col("w")) <= eps).select("key", "cid", "other", "near")


def neighbourhood_labels(
    points: DataFrame,
    key: str,
    dim: int,
    eps: float,
    min_samples: int = 10,
    min_cluster_size: int = 50,
    vector: str = "embedding",
) -> DataFrame:
    """(key, cluster) by the density around each point; noise is -1.

    A point with at least ``min_samples`` points within ``eps``, itself included, is a core point.
    Core points within ``eps`` of each other share a cluster; another point joins the clusters'
    smallest (by its core point with the smallest key) of which a core point is within ``eps``.
    Clusters under ``min_cluster_size`` points become noise, the others are numbered in that order.
    Distances are taken over the first ``dim`` components and compared at nine digits.

    Cells have the side eps / sqrt(dim), so that the points of one cell are neighbours. A crowded
    cell (``min_samples`` points or more) is all core points, without a comparison; only points of
    other cells are compared, at most ``min_samples`` - 1 per cell, and a crowded cell answers them
    in shares. Crowded cells are joined by blocks (``_joined_crowded``). So work grows with the
    number of points, whatever the share of one cell.

    Defined cases: rows with a missing, NaN or infinite component are noise; keys must be unique and
    not null; an empty table gives no rows; other columns are ignored.
    """
    side = eps / sqrt(dim)
    rows = points.select(
        F.col(key).alias("key"), F.slice(F.col(vector).cast("array<double>"), 1, dim).alias("v"))
    finite = F.size("v") == dim
    for i in range(dim):
        finite &= F.coalesce(F.abs(F.get("v", F.lit(i))) < float("inf"), F.lit(False))
    cell = F.array(*[F.floor(_axis("v", i) / side) for i in range(dim)])
    placed = materialize(
        rows.where(F.col("v").isNotNull() & finite).select("key", "v", cell.alias("cell")), "points")
    cells = materialize(
        placed.groupBy("cell").agg(F.count("*").alias("n"))
        .withColumn("cid", F.monotonically_increasing_id()), "cells")
    placed = materialize(placed.join(cells.select("cell", "cid", "n"), "cell").drop("cell"), "points")
    crowded, sparse = (F.col("n") >= min_samples), (F.col("n") < min_samples)
    around = materialize(_neighbours(cells, dim), "around")
    full = cells.where(crowded)
    loose = placed.where(sparse).select("key", "cid", "v")
    asked = loose.join(around, "cid")
    by_crowd = materialize(
        _close_points(placed.where(crowded), asked, full, eps)
        .groupBy("key", "cid", "other").agg(F.count("*").alias("near_n")), "close")
    by_loose = materialize(
        _close_points(placed.where(sparse), asked, cells.where(sparse), eps), "close")
    counted = by_crowd.select("key", "cid", "near_n").unionByName(
        by_loose.select("key", "cid", F.lit(1).cast("bigint").alias("near_n")))
    core = materialize(
        counted.groupBy("key", "cid").agg(F.sum("near_n").alias("near_n"))
        .where(F.col("near_n") >= min_samples).select("key", "cid"), "core")
    core_near = by_loose.join(core.select(F.col("key").alias("near")), "near", "left_semi")
    close = by_crowd.select("key", "cid", "other").unionByName(core_near.select("key", "cid", "other"))
    both = around.where("cid < other").join(full.select("cid"), "cid", "left_semi").join(
        full.select(F.col("cid").alias("other")), "other", "left_semi")
    edges = close.join(core.select("key"), "key", "left_semi").select(
        F.col("cid").alias("src"), F.col("other").alias("dst")
    ).unionByName(_joined_crowded(placed.where(crowded).select("cid", "v"), both, dim, eps, side))
    nodes = full.select(F.col("cid").alias("node")).unionByName(core.select(F.col("cid").alias("node")))
    roots = materialize(star_components(edges, nodes.distinct()), "roots")
    cores = placed.where(crowded).select("key", F.col("cid").alias("node")).unionByName(
        core.select("key", F.col("cid").alias("node"))).join(roots, "node").select("key", "root")
    first = materialize(cores.groupBy("root").agg(F.min("key").alias("first")), "first")
    rim = close.join(core.select("key"), "key", "left_anti").select(
        "key", F.col("other").alias("node")).join(roots, "node").join(first, "root")
    labelled = cores.join(first, "root").select("key", "first").unionByName(
        rim.groupBy("key").agg(F.min("first").alias("first")))
    labelled = materialize(labelled, "labelled")
    large = labelled.groupBy("first").agg(F.count("*").alias("size")).where(
        F.col("size") >= min_cluster_size).select("first")
    numbered = global_row_number(large, ["first"], "number").select(
        "first", (F.col("number") - 1).alias("cluster"))
    found = labelled.join(numbered, "first").select("key", "cluster")
    return rows.select("key").join(found, "key", "left").select(
        F.col("key").alias(key), F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))
