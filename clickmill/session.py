"""Session-level helpers: shared scratch folder, durable intermediate tables, bounded reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SCRATCH: dict[str, str] = {}

# Columns one wide table may get out of a pivot.
MAX_PIVOT_VALUES = 10_000


def tune(spark: SparkSession) -> SparkSession:
    """Switch on the adaptive features that the plans lean on (skewed joins, coalescing)."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may go without the setting; it gets a temporary
    folder. On a cluster a missing setting is an error, since a machine-local
    folder would not be visible to the other executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if sc.applicationId not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[sc.applicationId] = tempfile.mkdtemp(prefix="clickmill-")
    return _LOCAL_SCRATCH[sc.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/clickmill/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "step", **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; ``options`` go to the writer.

    Cuts lineage, fixes the outcome of non-deterministic columns, survives lost
    executors, and gives the planner true sizes for the joins that follow.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A table scan with at least one task per core.

    For work that is heavy per row on a table stored in few pieces; a scan that already has enough
    splits, as any large table has, is left alone and not shuffled. Meant for plain scans, since it
    looks at the planned partitions.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def distinct_values(df: DataFrame, col: str, limit: int = MAX_PIVOT_VALUES) -> list:
    """Sorted distinct non-null values that will become columns; refuses to exceed ``limit``."""
    rows = (
        df.select(F.col(col).alias("v"))
        .where(F.col("v").isNotNull())
        .distinct()
        .limit(limit + 1)
        .collect()
    )
    if len(rows) > limit:
        raise ValueError(f"{col} has more than {limit} distinct values; use the long form")
    return sorted(r["v"] for r in rows)


def one_row(df: DataFrame, *aggregates: Column) -> Column:
    """Global aggregates as one struct-valued scalar subquery (no join needed)."""
    return df.agg(F.struct(*aggregates).alias("s")).scalar()
