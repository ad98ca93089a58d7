"""Reading logs, catalogues and stored stages; schemas are always explicit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.timebin import parse_time


def behaviors_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless click log; empty fields are null, time is parsed."""
    raw = spark.read.schema(schemas.BEHAVIORS).csv(path, sep="\t", quote="")
    return raw.withColumn("time", parse_time("time"))


def news_tsv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Headerless catalogue; fields may be quoted, quotes inside are doubled.

    A quoted field may hold line ends. A file is then read by one task; a catalogue of few large files
    without such fields reads faster with ``multi_line=False``.
    """
    return spark.read.schema(schemas.NEWS).csv(path, sep="\t", quote='"', escape='"', multiLine=multi_line)


def table_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; a leading unnamed index column is dropped."""
    head = spark.read.option("header", True).csv(path)
    indexed = head.columns[0] in ("", "_c0", "Unnamed: 0")
    full = f"_index STRING, {schema}" if indexed else schema
    df = spark.read.schema(full).csv(path, header=True, enforceSchema=True, escape='"')
    return df.drop("_index")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """All chunks of a stored table as one table."""
    return spark.read.parquet(folder)


def named_features(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Projection of a ratings table to the features a model uses, renamed."""
    return df.select(*[F.col(old).alias(new) for old, new in columns.items()])


def matrix_inputs(
    spark: SparkSession, interactions: str, items: str, users: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored interactions and both stored feature tables."""
    return tuple(spark.read.parquet(p) for p in (interactions, items, users))


def ids_as_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Id columns, plain or in arrays, as strings."""
    out = {}
    for c in cols:
        is_array = df.schema[c].dataType.typeName() == "array"
        out[c] = F.col(c).cast("array<string>" if is_array else "string")
    return df.withColumns(out)
