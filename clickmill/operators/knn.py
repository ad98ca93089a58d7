"""Exact k nearest vectors without forming all pairs.

Equal vectors are merged first, so a crowd of copies counts once. A candidate side that is small by
checked size goes to the tasks as one matrix. A large one is cut into cells around pivots, about as many
as the root of its rows and kept in groups, and neighbouring cells lie on shelves. Each query first
searches the shelf of its nearest cell for a bound and then only the shelves with a cell that the triangle
inequality cannot rule out; on a shelf it skips the cells that are ruled out. Queries and candidates travel
once per shelf and pack of queries, so a search whose bounds rule out nothing is still a join of some dozen
bounded blocks with each other, and a task keeps k hits per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from math import ceil, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import hellinger_scaled, l2_scaled
from ..session import materialize
from .ranking import top_n_per_group

SMALL_SIDE_BYTES = 32 * 2**20
PIVOT_BYTES = 16 * 2**20  # pivots go to every task
BLOCK_ROWS = 2048
DIGITS = 9  # costs are compared at this many digits, ties go to the smaller id
NO_BOUND = 1e150
_SLACK = 1e-7
_ROUNDING = 1e-12
_WORK = 4_000_000  # matrix cells scored at a time
SHELVES = 6  # and as many packs of queries: their product is the tasks, their sum what travels
SHELF_BYTES = 64 * 2**20  # of vectors that come to a task on each side
SMALL_SHELF_BYTES = 4 * 2**20
_QUERIES = 4096  # of a task searched together
_COLUMNS = 1024
_TILE = 2**20  # products at a time
_SINGLE = 1e30  # squares up to which single precision shortlists
_EPSILON = 2.0**-23
_PAIRS = 2**18  # scored exactly at a time

_SCALED = {"cosine": l2_scaled, "hellinger": hellinger_scaled}


def _digest(vector: Column) -> Column:
    """SHA-256 of a vector, with one zero and one NaN: short keys, where Spark would compare whole arrays."""

    @F.pandas_udf("binary")
    def digest(vectors: pd.Series) -> pd.Series:
        rows = (np.asarray(v, np.float64) + 0.0 for v in vectors)
        return pd.Series([sha256(np.where(np.isnan(x), np.nan, x).tobytes()).digest() for x in rows], dtype=object)

    return digest(vector)


def _best(q, c, c_ids, k: int, metric: str):
    """Row numbers, candidate positions and costs of the k cheapest candidates per query.

    Costs are euclidean distances or negated products.
    """
    rank = np.empty(len(c), np.int64)
    rank[np.argsort(c_ids, kind="stable")] = np.arange(len(c))
    out = []
    for start in range(0, len(q), _QUERIES):
        part = q[start : start + _QUERIES]
        best = _Best(part, c, rank, np.full(len(part), NO_BOUND), k, metric)
        for a in range(0, len(c), _COLUMNS):
            cut = slice(a, min(a + _COLUMNS, len(c)))
            step = max(1, _TILE // (cut.stop - cut.start))
            for b in range(0, len(part), step):
                best.take(np.arange(b, min(b + step, len(part))), cut)
        rows, j = np.nonzero(best.at >= 0)
        out.append((rows + start, best.at[rows, j], best.cost[rows, j]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _cheapest(hits: DataFrame, candidate: str, k: int) -> DataFrame:
    return top_n_per_group(hits, ["qid"], [F.round("cost", DIGITS), F.col(candidate)], k)


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def _small_matrix(candidates: DataFrame, rows: int | None):
    """(ids, matrix) of a side with at most ``rows`` rows, by default of at most 32 MiB; else None."""
    head = candidates.select(F.size("vector")).first()
    if head is None:
        return np.array([]), np.empty((0, 0))
    dim = head[0]
    limit = SMALL_SIDE_BYTES // (8 * max(1, dim)) if rows is None else rows
    if limit == 0:
        return None
    table = candidates.select("cid", "vector").limit(limit + 1).toArrow()
    if table.num_rows > limit:
        return None
    vectors = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return table.column("cid").to_pandas().to_numpy(), vectors.reshape(-1, dim)


def _against_matrix(queries: DataFrame, small, k: int, metric: str, schema: str) -> DataFrame:
    """All queries against a side whose size was checked."""
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(small)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c_ids, c = shared.value
        for batch in batches:
            if len(batch) and len(c_ids):
                rows, cols, cost = _best(_matrix(batch["vector"]), c, c_ids, k, metric)
                yield pd.DataFrame(
                    {"qid": batch["qid"].to_numpy()[rows], "cid": c_ids[cols], "cost": cost})

    # Few bytes but much arithmetic: spread over all cores instead of by size.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return queries.repartition(tasks).mapInPandas(score, schema)


class _Cells:
    """Candidates in cells around pivots, the pivots in groups around the first few of them, the cells
    on shelves.

    With as many pivots as the root of the candidates, a cell holds about as many rows as there are
    cells. A vector goes to the nearest group and to the nearest pivot of that group. So what lies in
    a cell is within its radius and, for distances, on its side of the planes halfway to the other
    groups and to the other pivots of its group: the farther of these bounds counts. A shelf holds
    neighbouring cells, or a part of a crowded one, and is what travels: ``SHELF_BYTES`` at most.
    """

    def __init__(self, candidates: DataFrame, metric: str, pivot_count: int | None, shelf_rows: int | None):
        head = candidates.select(F.size("vector")).first()
        width = 8 * max(1, head[0] if head else 1)
        rows = candidates.count()
        if pivot_count is None:
            pivot_count = min(max(1, PIVOT_BYTES // width), max(1, isqrt(rows)))
        if shelf_rows is None:
            shelf_rows = max(1, min(SHELF_BYTES // width, max(ceil(rows / SHELVES), SMALL_SHELF_BYTES // width)))
        # A bounded sample by hash.
        heads = candidates.orderBy(F.xxhash64("cid"), "cid").limit(pivot_count).collect()
        pivots = _matrix([r["vector"] for r in heads])
        centres = pivots[: ceil(len(pivots) ** 0.5)]
        group = _pivot_distances(pivots, centres).argmin(axis=1)
        members = [np.flatnonzero(group == g) for g in range(len(centres))]
        self.pivots, self.metric, self.shelf_rows = pivots, metric, shelf_rows
        self.centres, self.members = centres, members

        @F.pandas_udf("cell int, away double")
        def home(vectors: pd.Series) -> pd.DataFrame:
            cell, away = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
            if len(vectors):
                x = _matrix(vectors)
                near = _pivot_distances(x, centres).argmin(axis=1)
                for g in np.unique(near):
                    rows = np.flatnonzero(near == g)
                    d = _pivot_distances(x[rows], pivots[members[g]])
                    cell[rows], away[rows] = members[g][d.argmin(axis=1)], d.min(axis=1)
            return pd.DataFrame({"cell": cell, "away": away})

        placed = candidates.withColumn("home", home("vector"))
        self.placed = materialize(placed.select("cid", "vector", "home.cell", "home.away"), "cells")
        self.count, self.radius = np.zeros(len(pivots)), np.zeros(len(pivots))
        stats = self.placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r"))
        for s in stats.collect():  # at most one row per pivot
            self.count[s["cell"]], self.radius[s["cell"]] = s["n"], s["r"]
        self.parts = np.maximum(1, np.ceil(self.count / shelf_rows)).astype(np.int32)
        self.shelf = np.zeros(len(pivots), np.int32)  # of a cell's first part
        shelf, held = 0, 0.0
        for cell in np.concatenate(members):  # neighbours side by side
            if held and held + self.count[cell] > shelf_rows:
                shelf, held = shelf + 1, 0.0
            self.shelf[cell] = shelf
            if self.parts[cell] > 1:
                shelf += int(self.parts[cell])
            else:
                held += self.count[cell]
        self.shelves = shelf + 1

    def shelved(self) -> DataFrame:
        """The candidates with their shelf: (cid, vector, cell, shelf)."""
        shelf, parts = self.shelf, self.parts

        @F.pandas_udf("int")
        def place(cell: pd.Series, spread: pd.Series) -> pd.Series:
            at = cell.to_numpy()
            return pd.Series((shelf[at] + spread.to_numpy() % parts[at]).astype(np.int32))

        spread = F.pmod(F.xxhash64("cid"), F.lit(2**31 - 1))
        return self.placed.select("cid", "vector", "cell", place("cell", spread).alias("shelf"))

    def bounds(self):
        """(lowest cost of anything in each group, and middles and lowest costs of a group's cells), as
        functions of query rows."""
        pivots, radius, count, metric = self.pivots, self.radius, self.count, self.metric
        centres, members = self.centres, self.members
        centre_gaps, member_gaps = _gaps(centres), [_gaps(pivots[m]) for m in members]
        from_centre = [_pivot_distances(pivots[m], centres[g : g + 1])[:, 0] for g, m in enumerate(members)]
        reach = np.array([
            np.where(count[m] > 0, d + radius[m], 0.0).max(initial=0.0) for m, d in zip(members, from_centre)])

        def middle(q: np.ndarray, places: np.ndarray) -> np.ndarray:
            return _pivot_distances(q, places) if metric == "euclidean" else -(q @ places.T)

        def width(q: np.ndarray) -> np.ndarray:
            """How much the cost can change within one unit of distance."""
            return np.ones(len(q)) if metric == "euclidean" else np.sqrt((q * q).sum(axis=1))

        def lowest(mid: np.ndarray, spread: np.ndarray, gaps: np.ndarray) -> np.ndarray:
            """Lower bound of the cost of anything around each place."""
            return np.maximum(mid - spread, _beyond_planes(mid, gaps)) if metric == "euclidean" else mid - spread

        def of_groups(q: np.ndarray) -> np.ndarray:
            return lowest(middle(q, centres), width(q)[:, None] * reach, centre_gaps)

        def of_cells(q: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray]:
            mid = middle(q, pivots[members[g]])
            return mid, lowest(mid, width(q)[:, None] * radius[members[g]], member_gaps[g])

        return of_groups, of_cells, middle

    def choosers(self):
        """UDFs that name a query's first shelf, and the further shelves that its bound leaves open."""
        centres, members, pivots, count = self.centres, self.members, self.pivots, self.count
        shelf, parts = self.shelf, self.parts
        held = np.array([count[m].sum() for m in members])
        of_groups, of_cells, middle = self.bounds()
        step = max(1, _WORK // max(1, len(pivots)))

        def first_of(q: np.ndarray) -> np.ndarray:
            near = np.where(held > 0, middle(q, centres), np.inf).argmin(axis=1)
            cell = np.zeros(len(q), np.int64)
            for g in np.unique(near):
                rows = np.flatnonzero(near == g)
                mid = np.where(count[members[g]] > 0, middle(q[rows], pivots[members[g]]), np.inf)
                cell[rows] = members[g][mid.argmin(axis=1)]
            return (shelf[cell] + np.arange(len(q)) % parts[cell]).astype(np.int32)

        def further_of(q: np.ndarray, bound: np.ndarray, done: np.ndarray) -> list:
            limit = _reached(bound)
            open_groups = (held > 0) & (of_groups(q) <= limit[:, None])
            none = np.zeros(0, np.int64)
            at, cells = [none], [none]
            for g in np.flatnonzero(open_groups.any(axis=0)):
                rows = np.flatnonzero(open_groups[:, g])
                low = of_cells(q[rows], g)[1]
                r, c = np.nonzero((low <= limit[rows, None]) & (count[members[g]] > 0))
                # A row and a shelf once, however many cells of it are open; a crowded cell has several.
                at.append(rows[r])
                cells.append(members[g][c])
            at, cells = np.concatenate(at), np.concatenate(cells)
            times = parts[cells]
            shelves = np.repeat(shelf[cells], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            pairs = np.unique(np.repeat(at, times) * (2**31) + shelves)
            rows, shelves = pairs >> 31, (pairs & (2**31 - 1)).astype(np.int32)
            keep = shelves != done[rows]
            rows, shelves = rows[keep], shelves[keep]
            return np.split(shelves, np.searchsorted(rows, np.arange(1, len(q))))

        @F.pandas_udf("int")
        def first(vectors: pd.Series) -> pd.Series:
            out = [np.zeros(0, np.int32)]
            for i in range(0, len(vectors), step):
                out.append(first_of(_matrix(vectors.iloc[i : i + step])))
            return pd.Series(np.concatenate(out))

        @F.pandas_udf("array<int>")
        def further(vectors: pd.Series, bound: pd.Series, done: pd.Series) -> pd.Series:
            out = []
            for i in range(0, len(vectors), step):
                part = slice(i, i + step)
                out += further_of(_matrix(vectors.iloc[part]), bound.to_numpy()[part], done.to_numpy()[part])
            return pd.Series(out, dtype=object)

        return first, further


def _reached(bound: np.ndarray) -> np.ndarray:
    return bound + _SLACK * (1 + np.abs(bound))


class _Best:
    """The k cheapest candidates of each row so far, and the cost that a further one must not exceed.

    A matrix product in single precision shortlists with as much slack as its rounding can make; the
    shortlist is then scored exactly.
    """

    def __init__(self, q: np.ndarray, c: np.ndarray, c_rank: np.ndarray, bound: np.ndarray, k: int, metric: str):
        self.q, self.c, self.c_rank, self.k, self.metric = q, c, c_rank, k, metric
        self.limit = bound.copy()
        self.cost = np.full((len(q), k), np.inf)
        self.at = np.full((len(q), k), -1, np.int64)
        # One matrix product gives the squared distance less the row's own square.
        middle = c.mean(axis=0) if metric == "euclidean" else np.zeros(c.shape[1])
        q, c = q - middle, c - middle
        self.q_sq, self.c_sq = (q * q).sum(axis=1), (c * c).sum(axis=1)
        if metric == "euclidean":
            self.left = np.hstack([-2 * q, np.ones((len(q), 1))])
            self.right = np.hstack([c, self.c_sq[:, None]])
        else:
            self.left, self.right = -q, c
        self.rounding = _SLACK
        if (np.sqrt(self.q_sq.max(initial=0.0)) + np.sqrt(self.c_sq.max(initial=0.0))) ** 2 < _SINGLE:
            self.left, self.right = self.left.astype(np.float32), self.right.astype(np.float32)
            # Twice the rounding of a sum of so many products, as a share of the largest they can be.
            self.rounding = max(_SLACK, (self.left.shape[1] + 8) * _EPSILON)

    def take(self, rows: np.ndarray, cols: slice) -> None:
        """Score ``rows`` against the candidates ``cols``, all of them."""
        far = (np.sqrt(self.q_sq[rows].max()) + np.sqrt(self.c_sq[cols].max())) ** 2
        slack, limit = _SLACK + self.rounding * far, self.limit[rows]
        rough = self.left[rows] @ self.right[cols].T
        top = limit + slack * (1 + np.abs(limit))
        if self.metric == "euclidean":
            top = limit * limit + slack * (1 + limit * limit) - self.q_sq[rows]
        free = np.flatnonzero(limit >= NO_BOUND)
        if len(free) and rough.shape[1] > self.k:
            top[free] = np.partition(rough[free], self.k - 1, axis=1)[:, self.k - 1] + slack
        # Compared in the precision of the products, the limit rounded up.
        with np.errstate(over="ignore"):
            top = np.nextafter(top.astype(rough.dtype), np.array(np.inf, rough.dtype))
        hit, col = np.divmod(np.flatnonzero(rough <= top[:, None]), rough.shape[1])
        for i in range(0, len(hit), _PAIRS):
            self._add(rows[hit[i : i + _PAIRS]], col[i : i + _PAIRS] + cols.start)

    def _add(self, rows: np.ndarray, at: np.ndarray) -> None:
        if self.metric == "euclidean":
            cost = np.sqrt(((self.q[rows] - self.c[at]) ** 2).sum(axis=1))
        else:
            cost = -(self.q[rows] * self.c[at]).sum(axis=1)
        changed = np.unique(rows)
        r, j = np.nonzero(self.at[changed] >= 0)
        rows = np.concatenate([changed[r], rows])
        cost = np.concatenate([self.cost[changed[r], j], cost])
        at = np.concatenate([self.at[changed[r], j], at])
        order = np.lexsort((self.c_rank[at], np.round(cost, DIGITS), rows))
        rows, cost, at = rows[order], cost[order], at[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        keep = place < self.k
        self.cost[rows[keep], place[keep]], self.at[rows[keep], place[keep]] = cost[keep], at[keep]
        full = changed[self.at[changed, -1] >= 0]
        self.limit[full] = np.minimum(self.limit[full], self.cost[full].max(axis=1))


def _pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    step = max(1, _WORK // max(1, pivots.size))
    return np.concatenate([
        np.sqrt(((x[i : i + step, None, :] - pivots[None]) ** 2).sum(axis=2)) for i in range(0, len(x), step)
    ])


def _gaps(places: np.ndarray) -> np.ndarray:
    """Distances between places, infinite from a place to itself or its copies."""
    d = _pivot_distances(places, places)
    return np.where(d > 0, d, np.inf)


def _beyond_planes(distance: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """How far each row lies beyond the planes halfway between a place and the others, at least 0.

    ``distance`` is rows x places. Rounding of the squares is allowed for, also between close places.
    """
    square, out = distance * distance, np.zeros(distance.shape)
    for j, gap in enumerate(gaps):
        np.maximum(out, (square * (1 - _ROUNDING) - square[:, j : j + 1] * (1 + _ROUNDING)) / (2 * gap), out)
    return out


def _scan(
    wanted: DataFrame, cells: _Cells, k: int, schema: str, block_rows: int, meter: Accumulator | None
) -> DataFrame:
    """Score (qid, vector, bound, shelf) rows against their shelves: k best per query and shelf.

    A shelf meets its queries in packs of as many rows, so no more than two shelves' size comes to a
    task, and candidates and queries travel as often as there are packs and shelves, not cells.
    """
    metric, shelf_rows, shelf_of, parts_of = cells.metric, cells.shelf_rows, cells.shelf, cells.parts
    of_groups, of_cells, _ = cells.bounds()
    members = cells.members
    group_of = np.zeros(len(cells.pivots), np.int64)
    place_of = np.zeros(len(cells.pivots), np.int64)
    for g, m in enumerate(members):
        group_of[m], place_of[m] = g, np.arange(len(m))
    packs = np.zeros(cells.shelves, np.int64)
    for r in wanted.groupBy("shelf").agg(F.count("*").alias("n")).collect():  # at most one row per shelf
        packs[r["shelf"]] = ceil(r["n"] / shelf_rows)
    spark = wanted.sparkSession
    crowd = F.broadcast(spark.createDataFrame(
        [(i, int(n)) for i, n in enumerate(packs) if n], "shelf int, packs bigint"))
    asked = wanted.join(crowd, "shelf").select(
        "shelf", F.pmod(F.xxhash64("qid"), F.col("packs")).alias("pack"), "qid", "vector", "bound")
    met = cells.shelved().join(crowd, "shelf").select(
        "shelf", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("packs") - 1)).alias("pack"),
        "cid", "vector", "cell")

    def matrix(side: pa.Table) -> np.ndarray:
        flat = side["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(side.num_rows, -1)

    def score(key: tuple, q: pa.Table, c: pa.Table) -> pa.Table:
        found, cost, cols = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        if q.num_rows and c.num_rows:
            c = c.take(pa.array(np.argsort(c["cell"].to_numpy(), kind="stable")))
            held, starts = np.unique(c["cell"].to_numpy(), return_index=True)
            ends = np.r_[starts[1:], c.num_rows]
            rank = np.empty(c.num_rows, np.int64)
            rank[pc.array_sort_indices(c["cid"].combine_chunks()).to_numpy()] = np.arange(c.num_rows)
            c_mat, q_mat, bound = matrix(c), matrix(q), q["bound"].to_numpy()
            pairs = 0
            for i in range(0, len(q_mat), _QUERIES):
                best = _Best(q_mat[i : i + _QUERIES], c_mat, rank, bound[i : i + _QUERIES], k, metric)
                mid = np.empty((len(best.q), len(held)))
                low = np.empty_like(mid)
                lowest_group = of_groups(best.q)
                for g in np.unique(group_of[held]):
                    mine = np.flatnonzero(group_of[held] == g)
                    m, w = of_cells(best.q, g)
                    mid[:, mine] = m[:, place_of[held[mine]]]
                    low[:, mine] = np.maximum(w[:, place_of[held[mine]]], lowest_group[:, g : g + 1])
                nearest_cell = mid.argmin(axis=1)
                # First each row's nearest cell, for a tight bound, then the cells that this leaves open.
                for first in (True, False):
                    for j in range(len(held)):
                        rows = np.flatnonzero((nearest_cell == j) == first)
                        rows = rows[low[rows, j] <= _reached(best.limit[rows])]
                        for a in range(int(starts[j]), int(ends[j]), _COLUMNS):
                            cut = slice(a, min(a + _COLUMNS, int(ends[j])))
                            step = max(1, min(block_rows, _TILE // (cut.stop - cut.start)))
                            for b in range(0, len(rows), step):
                                best.take(rows[b : b + step], cut)
                        pairs += len(rows) * int(ends[j] - starts[j])
                r, j = np.nonzero(best.at >= 0)
                found.append(r + i)
                cost.append(best.cost[r, j])
                cols.append(best.at[r, j])
            if meter is not None:
                meter.add(pairs)
        return pa.table({
            "qid": q["qid"].take(pa.array(np.concatenate(found))), "cid": c["cid"].take(pa.array(np.concatenate(cols))),
            "cost": np.concatenate(cost)})

    keys = ["shelf", "pack"]
    return asked.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(score, schema)


def _against_cells(
    queries: DataFrame, candidates: DataFrame, k: int, metric: str, schema: str,
    pivot_count: int | None, block_rows: int, shelf_rows: int | None, meter: Accumulator | None,
) -> DataFrame:
    cells = _Cells(candidates, metric, pivot_count, shelf_rows)
    first, further = cells.choosers()
    # The first shelves are stored, so that the second search leaves out exactly these.
    queries = materialize(queries.select("qid", "vector", first("vector").alias("shelf")), "queries")
    wanted = queries.select("qid", "vector", F.lit(NO_BOUND).alias("bound"), "shelf")
    near = materialize(_scan(wanted, cells, k, schema, block_rows, meter), "near")
    found = near.groupBy("qid").agg(F.count("*").alias("n"), F.max("cost").alias("worst"))
    bound = F.when(F.col("n") < k, F.lit(NO_BOUND)).otherwise(F.col("worst")).alias("bound")
    bounded = queries.join(found, "qid").select("qid", "vector", bound, "shelf")
    left = materialize(bounded.select(
        "qid", "vector", "bound", further("vector", "bound", "shelf").alias("shelves")), "open")
    wanted = left.select("qid", "vector", "bound", F.explode("shelves").alias("shelf"))
    return _cheapest(near.unionByName(_scan(wanted, cells, k, schema, block_rows, meter)), "cid", k)


def nearest(
    queries: DataFrame,
    candidates: DataFrame,
    k: int,
    metric: str = "euclidean",
    exclude_self: bool = False,
    small_side: int | None = None,
    pivot_count: int | None = None,
    block_rows: int = BLOCK_ROWS,
    shelf_rows: int | None = None,
    meter: Accumulator | None = None,
) -> DataFrame:
    """The k best candidates of every query: (id, neighbor, score, rank).

    Both sides are (id, vector). ``euclidean``, ``cosine`` and ``hellinger`` rank by distance,
    ``dot`` by product; equal scores rank by id. ``exclude_self`` drops the candidate with the
    query's own id. ``small_side`` overrides the largest row count that is sent as one matrix,
    ``pivot_count`` the number of cells (by default the root of the candidates, as far as the pivots fit
    ``PIVOT_BYTES``), ``block_rows`` the queries scored at a time, ``shelf_rows`` the candidates that go to
    a task (by default a sixth, between 4 and 64 MiB). ``meter`` adds up the pairs that the cell search scores.
    """
    core = "dot" if metric == "dot" else "euclidean"
    scale = _SCALED.get(metric, lambda v: v)

    def prepared(df: DataFrame) -> DataFrame:
        scaled = df.select("id", scale(F.col("vector").cast("array<double>")).alias("vector"))
        return materialize(scaled.withColumn("same", _digest(F.col("vector"))), "vectors")

    alike = queries.sameSemantics(candidates)
    candidates = prepared(candidates)
    queries = candidates if alike else prepared(queries)
    keep = k + 1 if exclude_self else k
    # Copies of a vector are one candidate; of its ids only the smallest can be among the k best.
    copies = top_n_per_group(candidates, ["same"], [F.col("id")], keep)
    unique = materialize(
        copies.groupBy("same").agg(
            F.min("id").alias("cid"), F.collect_list("id").alias("ids"), F.first("vector").alias("vector")),
        "unique",
    )
    asked = queries.groupBy("same").agg(F.min("id").alias("qid"), F.first("vector").alias("vector"))
    id_type = candidates.schema["id"].dataType.simpleString()
    q_type = queries.schema["id"].dataType.simpleString()
    schema = f"qid {q_type}, cid {id_type}, cost double"
    sole = unique.select("cid", "vector")
    small = _small_matrix(sole, small_side)
    if small is not None:
        hits = _against_matrix(asked.drop("same"), small, keep, core, schema)
    else:
        hits = _against_cells(asked, sole, keep, core, schema, pivot_count, block_rows, shelf_rows, meter)
    hits = materialize(hits, "hits")  # the search runs once, however often the result is read
    members = hits.join(unique.select("cid", "ids"), "cid").select(
        "qid", "cost", F.explode("ids").alias("neighbor")
    )
    best = _cheapest(members, "neighbor", keep)
    entry = F.struct(F.round("cost", DIGITS).alias("place"), "neighbor", "cost")
    listed = best.groupBy("qid").agg(F.array_sort(F.collect_list(entry)).alias("found"))
    mine = queries.select("id", "same").join(asked.select("same", "qid"), "same").join(listed, "qid")
    found = F.col("found")
    if exclude_self:
        found = F.filter(found, lambda x: x["neighbor"] != F.col("id"))
    rows = mine.select("id", F.posexplode(F.slice(found, 1, k)).alias("pos", "x"))
    cost = F.col("x.cost")
    score = {
        "dot": -cost, "cosine": cost * cost / 2.0, "hellinger": cost / F.sqrt(F.lit(2.0)),
    }.get(metric, cost)
    return rows.select(
        "id", F.col("x.neighbor").alias("neighbor"), score.alias("score"),
        (F.col("pos") + 1).cast("bigint").alias("rank"),
    )
