"""Row numbers and top-n that hold up when one key owns much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_SLOT, _PART = "_slot", "_part"
GROUP_LIMIT = 1000  # Spark's default for pushing a rank filter below the shuffle
LOCAL_ROWS = 100_000  # rows of one key that a task numbers by itself
SHARES = 64
_SLOT_BITS = 33  # low bits of monotonically_increasing_id: index within the partition


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _stored_in_order(df: DataFrame, order_by: Sequence[Column | str]) -> DataFrame:
    """Range-sorted copy of ``df`` with the partition number and the slot of every row.

    The range sort splits any hot key over many partitions. The copy is written
    out because the counts and the rows must agree on the partition bounds.
    """
    ordered = df.orderBy(*[_col(c) for c in order_by])
    numbered = ordered.withColumn(_SLOT, F.monotonically_increasing_id())
    numbered = numbered.withColumn(_PART, F.shiftright(_SLOT, _SLOT_BITS))
    return materialize(numbered, "ordered")


def _running_before(n: str, window) -> Column:
    before = F.sum(n).over(window.rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(before, F.lit(0))


def global_row_number(
    df: DataFrame, order_by: Sequence[Column | str], out: str = "row_num"
) -> DataFrame:
    """1-based position of every row in the total order, without a one-task window."""
    stored = _stored_in_order(df, order_by)
    sizes = stored.groupBy(_PART).agg(F.min(_SLOT).alias("_first"), F.count("*").alias("_n"))
    # One row per range partition, so this window and broadcast are bounded by the partition count.
    starts = sizes.select(
        _PART, "_first", _running_before("_n", Window.orderBy(_PART)).alias("_before")
    )
    return (
        stored.join(F.broadcast(starts), _PART)
        .withColumn(out, F.col("_before") + F.col(_SLOT) - F.col("_first") + 1)
        .drop(_PART, _SLOT, "_first", "_before")
    )


def group_row_number(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[Column | str],
    out: str = "row_num",
    size: str | None = None,
    local_rows: int = LOCAL_ROWS,
) -> DataFrame:
    """1-based position within each key; one key's rows may span many partitions.

    Keys of up to ``local_rows`` rows are numbered by a window, with one shuffle. Larger ones, found
    by a count, are sorted by range, so that their rows are dealt over many tasks. ``size`` names a
    further column with the key's number of rows. Keys must not be null; ``df`` is read twice.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > local_rows)
    large = materialize(sizes.select(*keys), "large-keys")
    if not large.limit(1).count():
        return _numbered_locally(df, keys, order_by, out, size)
    small = df.join(large, list(keys), "left_anti")
    return _numbered_locally(small, keys, order_by, out, size).unionByName(
        _numbered_by_range(df.join(large, list(keys), "left_semi"), keys, order_by, out, size))


def _numbered_locally(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[Column | str], out: str, size: str | None
) -> DataFrame:
    whole = Window.partitionBy(*keys)
    placed = df.withColumn(out, F.row_number().over(whole.orderBy(*[_col(c) for c in order_by])).cast("long"))
    return placed.withColumn(size, F.count("*").over(whole)) if size else placed


def _numbered_by_range(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[Column | str], out: str, size: str | None
) -> DataFrame:
    stored = _stored_in_order(df, [*keys, *order_by])
    runs = stored.groupBy(*keys, _PART).agg(F.min(_SLOT).alias("_first"), F.count("*").alias("_run"))
    # A key has at most one run per range partition, so these windows stay short.
    runs = runs.withColumn(
        "_before", _running_before("_run", Window.partitionBy(*keys).orderBy(_PART))
    )
    if size:
        runs = runs.withColumn(size, F.sum("_run").over(Window.partitionBy(*keys)))
    runs = runs.drop("_run")
    return (
        stored.join(runs, [*keys, _PART])
        .withColumn(out, F.col("_before") + F.col(_SLOT) - F.col("_first") + 1)
        .drop(_PART, _SLOT, "_first", "_before")
    )


def top_n_per_group(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[Column], n: int, rank: str | None = None
) -> DataFrame:
    """First ``n`` rows of each key.

    Spark pushes the rank filter below the shuffle as a per-task group limit, so a hot key sends at
    most ``n`` rows per task. It does so only up to ``GROUP_LIMIT`` rows; beyond that each key is
    first ranked within hash shares.
    """
    name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order_by)
    if n > GROUP_LIMIT:
        share = F.pmod(F.xxhash64(*df.columns), F.lit(SHARES))
        within = Window.partitionBy(*keys, "_share").orderBy(*order_by)
        df = df.withColumn("_share", share).withColumn("_place", F.row_number().over(within))
        df = df.where(F.col("_place") <= n).drop("_share", "_place")
    best = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)
    return best if rank else best.drop(name)


def first_per_group(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    return top_n_per_group(df, keys, order_by, 1)


def row_chunks(df: DataFrame, order_by: Sequence[Column | str], n: int, out: str = "chunk") -> DataFrame:
    """Number of the equal-sized row range (0-based) that each row falls in; first ranges get the rest."""
    ranked = global_row_number(df, order_by, "_rn")
    rows = ranked.agg(F.count("*").alias("n")).scalar()
    size, rest = F.floor(rows / n), rows % n
    pos = F.col("_rn") - 1
    long_part = rest * (size + 1)
    chunk = F.when(pos < long_part, F.floor(pos / (size + 1))).otherwise(
        rest + F.floor((pos - long_part) / F.greatest(size, F.lit(1)))
    )
    return ranked.withColumn(out, chunk.cast("bigint")).drop("_rn")
