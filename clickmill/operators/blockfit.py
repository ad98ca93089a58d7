"""Passes over rating cells in stored blocks: many factor models at once, without moving the cells.

The cells are stored twice, in blocks by row and in blocks by column. A block lists the ids that it
needs, so a pass sends each factor array only to the blocks that use it (``routes``); blocks and
routes are bucketed, and only factors, sums and solutions are shuffled. The factor array of an id
holds all models end to end, so the number of jobs does not depend on how many there are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import MAX_DOUBLE
from ..session import materialize, scratch_path

BLOCK_CELLS = 1 << 20
BLOCK_BYTES = 64 << 20  # factors of a block's cells, if no two cells shared an id
STEP_CELLS = 4096
WHOLE, SHARE, FIGURES = 1, 2, 3  # kinds of sums: of an id, of one share of a large id, of a block


@dataclass(frozen=True)
class Model:
    """One parameter set of a factorisation."""

    k: int
    lam: float
    seed: int = 42


def spans(models: Sequence[Model]) -> list[slice]:
    """Place of each model in the joined factor array."""
    ends = np.cumsum([m.k for m in models]).tolist()
    return [slice(end - m.k, end) for m, end in zip(models, ends)]


def packed_size(k: int) -> int:
    return k * (k + 1) // 2 + k


def solve(packed: np.ndarray, k: int, lam: float) -> np.ndarray:
    """Ridge solutions of packed systems: upper triangle of the Gram matrix, then the right side."""
    upper = np.triu_indices(k)
    size = len(upper[0])
    a = np.zeros((len(packed), k, k))
    a[:, upper[0], upper[1]] = packed[:, :size]
    a[:, upper[1], upper[0]] = packed[:, :size]
    a += lam * np.eye(k)
    return np.linalg.solve(a, packed[:, size:, None])[:, :, 0]


# --- layout -------------------------------------------------------------------------------------


# Rows that hold whole blocks are megabytes long. Parquet looks at its buffer only every hundred rows,
# and a reader takes a whole row group at once, so a task would hold hundreds of blocks.
LONG_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "2", "parquet.page.size.row.check.max": "8"}


def _bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """A stored copy bucketed by ``key`` like a shuffle, so that joins on it need none."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{label}_{uuid.uuid4().hex}"
    (
        df.repartition(n, key).write.options(**LONG_ROWS if "binary" in dict(df.dtypes).values() else {})
        .bucketBy(n, key).sortBy(key).option("path", scratch_path(spark, label)).saveAsTable(name)
    )
    return spark.table(name)


def _pack(key: tuple, cells: pa.Table) -> pa.Table:
    """One block as one row: its ids, and its cells as positions among them, ordered by own id."""
    cells = cells.sort_by([("own", "ascending"), ("other", "ascending")]).combine_chunks()
    own, other = (cells[c].combine_chunks().dictionary_encode() for c in ("own", "other"))
    first = np.unique(own.indices.to_numpy(), return_index=True)[1]
    values = {
        "block": key[0].as_py(),
        "own": own.dictionary,
        "whole": cells["whole"].combine_chunks().take(pa.array(first)),
        "other": other.dictionary,
        "own_at": own.indices.to_numpy().astype("<i4").tobytes(),
        "other_at": other.indices.to_numpy().astype("<i4").tobytes(),
        "rating": cells["rating"].to_numpy().astype("<f8").tobytes(),
    }
    return pa.table({
        k: pa.array([v]) if not isinstance(v, pa.Array) else pa.ListArray.from_arrays([0, len(v)], v)
        for k, v in values.items()
    })


class Layout:
    """The cells of a matrix in stored blocks of ``own`` ids.

    A block gets about ``BLOCK_CELLS`` cells, fewer if their factors would pass ``BLOCK_BYTES``. An
    id with more than ``share_rows`` cells is dealt over several blocks, which only add up their
    share of its sums.
    """

    def __init__(self, coo: DataFrame, own: str, other: str, width: int, share_rows: int):
        self.own, self.other = own, other
        cells = coo.select(
            F.col(own).alias("own"), F.col(other).alias("other"),
            F.col("rating").cast("double").alias("rating"),
        ).dropna()
        self.types = [cells.schema[c].dataType.simpleString() for c in ("own", "other")]
        per_block = max(STEP_CELLS, min(BLOCK_CELLS, BLOCK_BYTES // (8 * width)))
        sizes = materialize(cells.groupBy("own").agg(F.count("*").alias("n")), "sizes")
        n_cells = sizes.agg(F.sum("n")).first()[0] or 0
        n_blocks = max(-(-n_cells // per_block), 1)
        large = sizes.where(F.col("n") > share_rows).select(
            "own", F.ceil(F.col("n") / share_rows).cast("bigint").alias("shares"))
        dealt = cells.join(large, "own", "left").select(
            "own", "other", "rating", F.col("shares").isNull().alias("whole"),
            F.pmod(
                F.xxhash64("own", F.pmod(F.xxhash64("other"), F.coalesce("shares", F.lit(1).cast("bigint")))),
                F.lit(n_blocks).cast("bigint"),
            ).alias("block"),
        )
        schema = (
            f"block long, own array<{self.types[0]}>, whole array<boolean>, "
            f"other array<{self.types[1]}>, own_at binary, other_at binary, rating binary"
        )
        self.blocks = _bucketed(dealt.groupBy("block").applyInArrow(_pack, schema), "block", "blocks")
        self.routes = {c: _bucketed(
            self.blocks.select("block", F.posexplode(c).alias("pos", "id")), "id", "routes"
        ) for c in ("own", "other")}

    def _messages(self, factors: dict[str, DataFrame]) -> DataFrame:
        """(to, mine, pos, factors): every factor array once per block that needs it."""
        out = None
        for end, table in factors.items():
            sent = self.routes[end].join(table.select(
                F.col(self.own if end == "own" else self.other).alias("id"), "factors"), "id")
            sent = sent.select(
                F.col("block").alias("to"), F.lit(end == "own").alias("mine"), "pos", "factors")
            out = sent if out is None else out.unionByName(sent)
        return out

    def sums(self, factors: dict[str, DataFrame], width: int, work: Callable) -> DataFrame:
        """(kind, id, packed): what ``work`` makes of every block and the factors sent to it.

        Only messages are shuffled; blocks are read from their buckets.
        """
        id_type = self.types[0]

        def run(key: tuple, block: pa.Table, messages: pa.Table) -> pa.Table:
            return work(Block(block, messages, width))

        return self.blocks.select(
            "block", "own", "whole", F.size("other").alias("n_other"), "own_at", "other_at", "rating"
        ).groupBy("block").cogroup(self._messages(factors).groupBy("to")).applyInArrow(
            run, f"kind int, id {id_type}, packed array<double>")


def _matrix(lists: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return flat.flatten().to_numpy().reshape(len(flat), width)


class Block:
    """Cells of one block with the factors of both sides, in positions."""

    def __init__(self, row: pa.Table, messages: pa.Table, width: int):
        self.ids = row["own"].combine_chunks().flatten()
        self.whole = row["whole"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        own_at, other_at, rating = (
            np.frombuffer(row[c][0].as_py(), t)
            for c, t in (("own_at", "<i4"), ("other_at", "<i4"), ("rating", "<f8"))
        )
        mine = messages["mine"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        pos = messages["pos"].to_numpy()
        factors = _matrix(messages["factors"], width)
        self.u, self.v = np.zeros((len(self.ids), width)), np.zeros((row["n_other"][0].as_py(), width))
        self.u[pos[mine]], self.v[pos[~mine]] = factors[mine], factors[~mine]
        # Cells of ids without factors take no part.
        known = np.zeros(len(self.v), bool)
        known[pos[~mine]] = True
        keep = known[other_at]
        if mine.any():
            asked = np.zeros(len(self.u), bool)
            asked[pos[mine]] = True
            keep &= asked[own_at]
        self.own_at, self.other_at, self.rating = own_at[keep], other_at[keep], rating[keep]

    def steps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(own, other, rating, starts of equal own ids) of a few thousand cells at a time."""
        for k in range(0, len(self.own_at), STEP_CELLS):
            part = slice(k, k + STEP_CELLS)
            own = self.own_at[part]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            yield own, self.other_at[part], self.rating[part], starts

    def rows(self, whole: np.ndarray, shares: np.ndarray, figures: np.ndarray) -> pa.Table:
        """Sums per id, those of shared ids apart, and one row of figures."""
        w = self.whole
        ids = pa.concat_arrays([self.ids.filter(pa.array(w)), self.ids.filter(pa.array(~w)), pa.nulls(1, self.ids.type)])
        kinds = np.repeat([WHOLE, SHARE, FIGURES], [w.sum(), (~w).sum(), 1]).astype(np.int32)
        lens = np.repeat([whole.shape[1], shares.shape[1], len(figures)], [w.sum(), (~w).sum(), 1])
        packed = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)),
            pa.array(np.concatenate([whole.ravel(), shares.ravel(), figures])))
        return pa.table({"kind": pa.array(kinds), "id": ids, "packed": packed})


# --- work on a block ----------------------------------------------------------------------------


def gradients(models: Sequence[Model]) -> Callable[[Block], pa.Table]:
    """Per id the sums of error times factors; figures: squared errors and non-zero errors."""
    where = spans(models)

    def work(b: Block) -> pa.Table:
        grad = np.zeros_like(b.u)
        squares, counts = np.zeros(len(where)), np.zeros(len(where))
        for own, other, rating, starts in b.steps():
            u, v = b.u[own], b.v[other]
            for m, s in enumerate(where):
                e = rating - np.einsum("ij,ij->i", u[:, s], v[:, s])
                grad[own[starts], s] += np.add.reduceat(e[:, None] * v[:, s], starts, axis=0)
                squares[m] += e @ e
                counts[m] += np.count_nonzero(e)
        w = b.whole
        return b.rows(grad[w], grad[~w], np.concatenate([squares, counts]))

    return work


def _systems(b: Block, s: slice, k: int, summed: int) -> np.ndarray:
    """Packed normal equations of all own ids for one model.

    Up to ``summed`` factors they are summed cell by cell, beyond by matrix products per id.
    """
    upper = np.triu_indices(k)
    out = np.zeros((len(b.u), packed_size(k)))
    if k <= summed:
        for own, other, rating, starts in b.steps():
            x = b.v[other, s]
            cells = np.concatenate([x[:, upper[0]] * x[:, upper[1]], rating[:, None] * x], axis=1)
            out[own[starts]] += np.add.reduceat(cells, starts, axis=0)
        return out
    edges = np.flatnonzero(np.r_[True, b.own_at[1:] != b.own_at[:-1], True]) if len(b.own_at) else []
    for start, end in zip(edges[:-1], edges[1:]):
        for k0 in range(start, end, STEP_CELLS):
            part = slice(k0, min(k0 + STEP_CELLS, end))
            x = b.v[b.other_at[part], s]
            out[b.own_at[start]] += np.concatenate([(x.T @ x)[upper], b.rating[part] @ x])
    return out


def _solved(packed: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Solutions, and their products with the right sides: the sum of rating times prediction."""
    x = solve(packed, model.k, model.lam)
    return x, np.einsum("ij,ij->i", x, packed[:, -model.k:])


def normal_equations(models: Sequence[Model], summed: int) -> Callable[[Block], pa.Table]:
    """Per id the solutions of all models and their cross sums; systems for shares of large ids."""
    where = spans(models)

    def work(b: Block) -> pa.Table:
        w = b.whole
        solutions, crosses, shares = [], [], []
        for model, s in zip(models, where):
            packed = _systems(b, s, model.k, summed)
            x, cross = _solved(packed[w], model)
            solutions.append(x)
            crosses.append(cross[:, None])
            shares.append(packed[~w])
        return b.rows(np.hstack(solutions + crosses), np.hstack(shares), np.zeros(0))

    return work


def cross_sums(models: Sequence[Model]) -> Callable[[Block], pa.Table]:
    """Figures alone: the sum of rating times prediction over the cells."""
    where = spans(models)

    def work(b: Block) -> pa.Table:
        cross = np.zeros(len(where))
        for own, other, rating, _ in b.steps():
            u, v = b.u[own], b.v[other]
            cross += [rating @ np.einsum("ij,ij->i", u[:, s], v[:, s]) for s in where]
        w = b.whole
        return b.rows(np.zeros((w.sum(), 0)), np.zeros(((~w).sum(), 0)), cross)

    return work


# --- from sums to factors -----------------------------------------------------------------------


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list, np.ndarray]]:
    """Sums over runs of equal ids in batches sorted by id; a run may go on in the next batch."""
    last, held = None, None
    for b in batches:
        if not b.num_rows:
            continue
        ids, rows = b.column(0).to_pylist(), _matrix(b.column(1), width)
        starts = [0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1])]
        sums = np.add.reduceat(rows, starts, axis=0)
        names = [ids[k] for k in starts]
        if held is not None:
            if names[0] == last:
                sums[0] += held
            else:
                yield [last], held[None]
        if len(names) > 1:
            yield names[:-1], sums[:-1]
        last, held = names[-1], sums[-1].copy()
    if held is not None:
        yield [last], held[None]


def shares_added(
    sums: DataFrame, id_type: str, width: int, finish: Callable[[np.ndarray], np.ndarray]
) -> DataFrame:
    """(id, packed): ids as a whole as they are, shares of large ids added up and finished."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _runs(batches, width):
            done = finish(rows)
            lists = pa.ListArray.from_arrays(
                pa.array((np.arange(len(ids) + 1) * done.shape[1]).astype(np.int32)), pa.array(done.ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string() if id_type == "string" else pa.int64() if id_type == "bigint" else pa.int32()), lists],
                ["id", "packed"])

    shares = sums.where(F.col("kind") == SHARE).select("id", "packed")
    added = shares.repartition("id").sortWithinPartitions("id").mapInArrow(
        run, f"id {id_type}, packed array<double>")
    return sums.where(F.col("kind") == WHOLE).select("id", "packed").unionByName(added)


def moved(
    side: DataFrame, id_col: str, sums: DataFrame, width: int, models: Sequence[Model],
    move: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], first: bool,
) -> DataFrame:
    """(id, factors, old, change, cross) of all ids of a side after a step.

    ``move`` takes old factors, sums (zeros where an id has none) and whether an id has sums.
    ``change`` is the largest relative update per model, against zeros in the ``first`` step.
    """
    where = spans(models)
    joined = side.select(F.col(id_col).alias("id"), F.col("factors").alias("old")).join(sums, "id", "left")
    id_type = joined.schema["id"].dataType.simpleString()
    n_models, total_width = len(where), where[-1].stop

    def lists(rows: np.ndarray) -> pa.ListArray:
        n, m = rows.shape
        return pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * m).astype(np.int32)), pa.array(rows.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            has = np.array(b.column(2).is_valid())
            old = _matrix(b.column(1), total_width)
            given = np.zeros((b.num_rows, width))
            given[has] = _matrix(b.column(2).drop_null(), width)
            new, cross = move(old, given, has)
            base = np.zeros_like(old) if first else old
            gap = np.abs(new - base)
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(base != 0, gap / np.abs(base), np.where(gap == 0, 0.0, MAX_DOUBLE))
            change = np.stack([ratio[:, s].max(axis=1) for s in where], axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), lists(new), b.column(1), lists(change), lists(cross)],
                ["id", "factors", "old", "change", "cross"])

    return joined.mapInArrow(
        run, f"id {id_type}, factors array<double>, old array<double>, change array<double>, "
        "cross array<double>").withColumnRenamed("id", id_col)


def descent_move(models: Sequence[Model], rates: np.ndarray):
    """A gradient step with one rate per model."""
    lam = np.concatenate([np.full(m.k, float(m.lam)) for m in models])
    rate = np.concatenate([np.full(m.k, r) for m, r in zip(models, rates)])

    def move(old: np.ndarray, grad: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return old + rate * (grad - lam * old), np.zeros((len(old), len(models)))

    return move


def least_squares_move(models: Sequence[Model]):
    """Solutions come as they are; ids without cells have zeros."""
    width = sum(m.k for m in models)

    def move(old: np.ndarray, given: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return given[:, :width], given[:, width:]

    return move


class Cells:
    """Both layouts of a matrix for the given models, and the steps over them."""

    def __init__(
        self, coo: DataFrame, row: str, col: str, models: Sequence[Model], share_rows: int, summed: int
    ):
        self.models, self.row, self.col = list(models), row, col
        self.width = sum(m.k for m in models)
        self._coo, self._share_rows, self._summed = coo, share_rows, summed

    @cached_property
    def by_row(self) -> Layout:
        return Layout(self._coo, self.row, self.col, self.width, self._share_rows)

    @cached_property
    def by_col(self) -> Layout:
        return Layout(self._coo, self.col, self.row, self.width, self._share_rows)

    def descend(
        self, layout: Layout, side: DataFrame, other: DataFrame, rates: np.ndarray, first: bool
    ) -> tuple[DataFrame, DataFrame]:
        """One side after a gradient step, and the sums it came from."""
        sums = materialize(
            layout.sums({"own": side, "other": other}, self.width, gradients(self.models)), "sums")
        added = shares_added(sums, layout.types[0], self.width, lambda rows: rows)
        move = descent_move(self.models, rates)
        new = moved(side, layout.own, added, self.width, self.models, move, first)
        return materialize(new, "factors"), sums

    def least_squares(self, layout: Layout, side: DataFrame, fixed: DataFrame) -> DataFrame:
        """One side as ridge solutions given the other."""
        models = self.models
        sums = materialize(layout.sums({"other": fixed}, self.width, normal_equations(models, self._summed)), "sums")

        def finish(rows: np.ndarray) -> np.ndarray:
            at, solutions, crosses = 0, [], []
            for model in models:
                size = packed_size(model.k)
                x, cross = _solved(rows[:, at:at + size], model)
                solutions.append(x)
                crosses.append(cross[:, None])
                at += size
            return np.hstack(solutions + crosses)

        width = sum(packed_size(m.k) for m in models)
        added = shares_added(sums, layout.types[0], width, finish)
        new = moved(
            side, layout.own, added, self.width + len(models), models, least_squares_move(models), False)
        return materialize(new, "factors")

    def start_cross(self, rows: DataFrame, cols: DataFrame) -> DataFrame:
        """(kind, packed): sums of rating times prediction under the start factors, per block."""
        return self.by_col.sums({"own": cols, "other": rows}, self.width, cross_sums(self.models)).where(
            F.col("kind") == FIGURES)

    def grams(self, side: DataFrame) -> DataFrame:
        """(packed): upper triangles of all models' Gram matrices, one row per task."""
        models, where, width = self.models, spans(self.models), self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = [np.zeros((m.k, m.k)) for m in models]
            for b in batches:
                rows = _matrix(b.column(0), width)
                for total, s in zip(totals, where):
                    total += rows[:, s].T @ rows[:, s]
            flat = np.concatenate([t[np.triu_indices(m.k)] for t, m in zip(totals, models)])
            yield pa.RecordBatch.from_arrays([pa.array([flat], pa.list_(pa.float64()))], ["packed"])

        return side.select("factors").mapInArrow(run, "packed array<double>")


def figures(parts: Sequence[tuple[str, DataFrame, str, str]]) -> dict[str, list[float]]:
    """Entry-wise sums or maxima of array columns: (name, table, column, "sum" or "max"), in one job."""
    out = None
    for name, table, column, how in parts:
        rows = table.select(F.lit(name).alias("name"), F.posexplode(column).alias("pos", "x"))
        rows = rows.groupBy("name", "pos").agg(F.expr(f"{how}(x)").alias("x"))
        out = rows if out is None else out.unionByName(rows)
    found: dict[str, list] = {name: [] for name, *_ in parts}
    for r in sorted(out.collect(), key=lambda r: r["pos"]):
        found[r["name"]].append(r["x"])
    return found
