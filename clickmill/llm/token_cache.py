"""Token counts through a stored cache of content digests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .columns import BLANK_RUN, renamed, strip_blanks, whole
from .encoding import TokenizerFile, encoder

CACHE_SCHEMA = "digest binary, n_tokens long, version string"
LIMIT = 2048


class TokenCache:
    """Stored counts: a Parquet folder of (digest, n_tokens), one partition per tokenizer version."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "token-cache")

    def append(self, rows: DataFrame) -> None:
        """Add (digest, n_tokens, version); a repeated digest does no harm."""
        rows.write.mode("append").partitionBy("version").parquet(self.path)

    def counts(self, version: str) -> DataFrame:
        """(digest, n_tokens) stored for a tokenizer version, once per digest."""
        try:
            stored = self.spark.read.schema(CACHE_SCHEMA).parquet(self.path)
        except Exception as error:  # nothing was stored yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            stored = self.spark.createDataFrame([], CACHE_SCHEMA)
        return (
            stored.where(F.col("version") == version)
            .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
        )


def _normalised(text: Column, spec: TokenizerFile) -> Column:
    """Content that decides the count: white space runs are one blank where they get no ids."""
    return strip_blanks(F.regexp_replace(text, BLANK_RUN, " ")) if spec.blank_free else text


def count_tokens(
    docs: DataFrame,
    spec: TokenizerFile,
    cache: TokenCache | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    limit: int = LIMIT,
) -> DataFrame:
    """One row per document: (doc_id, n_bytes, n_tokens, over_limit).

    Each text is reduced to a digest of its normalised content. Digests that the cache lacks under
    the tokenizer's version are encoded once each, from one document that holds them, and appended;
    the counts then come from the cache by digest. With a warm cache only digests are moved.

    Special strings in a text are treated as the library does by default; nothing is truncated,
    padded or added.

    Defined cases: a null text is an empty one with no tokens. Repeated and null ids stay as rows.
    An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    cache = cache or TokenCache(spark)
    version = spec.version()
    base = renamed(docs, doc_id=doc_id, text=text).select("doc_id", whole("text").alias("text"))
    digest = F.unhex(F.sha2(_normalised(F.col("text"), spec).cast("binary"), 256))
    keyed = base.withColumn("digest", digest)
    known = materialize(
        keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"),
        "digests",
    )
    holders = known.groupBy("digest").agg(F.min("doc_id").alias("holder"))
    misses = holders.join(cache.counts(version).select("digest"), "digest", "left_anti")
    misses = materialize(misses, "misses").withColumnRenamed("digest", "wanted")
    texts = keyed.join(
        misses,
        keyed["doc_id"].eqNullSafe(F.col("holder")) & (keyed["digest"] == F.col("wanted")),
    ).select("digest", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec)
        for b in batches:
            counts = enc.counts(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"]
            )

    fresh = texts.mapInArrow(encode, "digest binary, n_tokens long")
    cache.append(fresh.withColumn("version", F.lit(version)))
    n = F.col("n_tokens")
    # Stored, so that the join can split the digest of a text with very many copies.
    counts = materialize(cache.counts(version), "counts")
    return known.join(counts, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (n > limit).alias("over_limit")
    )
