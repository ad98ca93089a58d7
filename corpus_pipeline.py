"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the shared
folder and read again as the next stage's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickmill.llm.leaks import find_leaks
from clickmill.llm.line_quality import judge_documents
from clickmill.llm.line_runs import drop_repeated_lines
from clickmill.llm.lsh_forest import near_duplicates
from clickmill.llm.packing import pack_documents
from clickmill.llm.queries import word_tokenizer
from clickmill.operators.ranking import global_row_number
from clickmill.session import materialize, tune

ROW = "_row_key"

def by_row(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of each row, in the order of ids.

    The key is the id where ids are unique and not null. Otherwise rows are numbered by id, null ids
    first, and by content; the numbered rows are stored, so that all jobs of a stage see one numbering.
    """
    n, distinct = docs.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if n == distinct:
        return docs.withColumn(ROW, F.col("doc_id").cast("long"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.xxhash64(*docs.columns)]
    return global_row_number(docs, order, ROW)


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    return docs.join(rows.select(ROW), ROW, "left_anti").drop(ROW)


def _own(found: DataFrame) -> DataFrame:
    return found.withColumnRenamed("doc_id", ROW)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted; texts stay as they are.

    Each row is judged for itself: null and repeated ids take no other row along. Null and empty
    texts have no words and go; copies share a verdict; an empty table stays empty.
    """
    docs = by_row(docs)
    rejected = _own(judge_documents(docs, doc_id=ROW).where(~F.col("kept")))
    return _without(docs, rejected).select(docs.drop(ROW).columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that five or more share; ``n_chars`` follows the text.

    A line stays in the row that comes last by id. All rows stay, also those with null or repeated
    ids, each with its own text; null texts stay null; an empty table stays empty.
    """
    docs = by_row(docs)
    kept = _own(drop_repeated_lines(docs, doc_id=ROW).where("n_dropped > 0")).select(ROW, "kept_text")
    text = F.coalesce("kept_text", "text")
    return docs.join(kept, ROW, "left").withColumns({
        "text": text,
        "n_chars": F.when(F.col("kept_text").isNull(), F.col("n_chars")).otherwise(
            F.char_length("kept_text").cast("long")
        ),
    }).select(docs.drop(ROW).columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more).

    The row that comes first by id stays, whether ids are null, repeated or neither. Null and empty
    texts are like nothing and stay; an empty table stays empty.
    """
    docs = by_row(docs)
    return _without(docs, _own(near_duplicates(docs, doc_id=ROW).where("not kept"))).select(
        docs.drop(ROW).columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Only rows that hold one go, whatever their ids; null and empty texts hold none; null items are
    not searched; an empty table stays empty.
    """
    docs = by_row(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, _own(find_leaks(docs, benchmark, doc_id=ROW)).select(ROW).distinct()).select(
        docs.drop(ROW).columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; each row is a document of its own, a null text the end id alone."""
    return pack_documents(docs, word_tokenizer()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
        "offset",
    )


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

# Near duplicates, edit distances and token ids have no SQL form; the test runs brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
