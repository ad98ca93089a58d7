"""Bag of words, TF-IDF, padded token ids and mean embeddings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, plain_words, words
from ..session import materialize, one_row
from .vocab import frequency_vocabulary

DICTIONARY_BYTES = 32 << 20
SIGNS, SIGN_BITS = "signs", 62


def word_rows(df: DataFrame, key: str, text: Column, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """One row per word that is not a stop word."""
    rows = df.select(key, F.explode(words(text)).alias("token"))
    return rows.where(~F.col("token").isin(list(stop_words)))


def bag_of_words(df: DataFrame, key: str, text: Column, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(key, token, tf) with raw counts."""
    rows = word_rows(df, key, text, stop_words)
    return rows.groupBy(key, "token").agg(F.count("*").alias("tf"))


def tf_idf(bow: DataFrame, key: str, documents: DataFrame, signs: Column | None = None) -> DataFrame:
    """(key, token, tf, df, weight): tf * (ln((1 + n) / (1 + df)) + 1), scaled to unit length per document.

    ``documents`` holds every document, also those without any word. Document frequencies are
    counted from the per-document counts, so a frequent word reaches the shuffle combined. ``signs``
    (see ``token_signs``) are drawn once per token beside its frequency and stay with the rows.
    """
    n = one_row(documents, F.count("*").alias("n"))["n"]
    df = bow.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0
    df = df.withColumn("idf", idf)
    if signs is not None:
        df = df.withColumn(SIGNS, signs)
    weighted = bow.join(df, "token").withColumn("w", F.col("tf") * F.col("idf"))
    # A document's own distinct words bound this window.
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    carried = [SIGNS] if signs is not None else []
    return weighted.select(key, "token", "tf", "df", (F.col("w") / length).alias("weight"), *carried)


def token_ids(
    df: DataFrame, key: str, text: Column, max_tokens: int, length: int | None = None,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> DataFrame:
    """Token ids per text: 0 pads, 1 unknown, then by falling frequency.

    The vocabulary has at most ``max_tokens`` entries; texts keep all their tokens unless
    ``length`` asks for fixed-size rows. A vocabulary of at most ``dictionary_bytes`` goes to the
    tasks, which code the texts where they are read; a larger one is joined to the tokens.
    """
    rows = df.select(key, F.posexplode(plain_words(text)).alias("pos", "token"))
    vocab = materialize(
        frequency_vocabulary(rows, "token", max_tokens, first_index=2).select("token", "idx"), "vocabulary")
    size = vocab.agg(F.sum(F.octet_length("token") + 8)).first()[0] or 0
    if size <= dictionary_bytes:
        ids = _coded_in_place(df.select(key, plain_words(text).alias("words")), key, vocab)
    else:
        ids = _coded_by_join(df.select(key), rows, key, vocab)
    if length is None:
        return ids
    filler = F.array_repeat(F.lit(0).cast("bigint"), length)
    return ids.withColumn("ids", F.slice(F.concat("ids", filler), 1, length))


def _coded_in_place(texts: DataFrame, key: str, vocab: DataFrame) -> DataFrame:
    """(key, ids) of word lists, by a dictionary in each task; the rows are neither split nor moved."""
    entries = sorted((r["idx"], r["token"]) for r in vocab.collect())
    tokens = pa.array([t for _, t in entries], pa.string())
    numbers = pa.array([i for i, _ in entries], pa.int64())

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            at = pc.index_in(lists.flatten(), value_set=tokens)
            ids = pc.fill_null(numbers.take(at), 1)
            # Null lists have no words; offsets count from the first word of the batch.
            lens = pc.fill_null(pc.list_value_length(lists), 0)
            ends = np.concatenate([[0], np.cumsum(lens.to_numpy(zero_copy_only=False))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(pa.array(ends), ids)], ["key", "ids"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.mapInArrow(code, f"`{key}` {kind}, ids array<bigint>")


def _coded_by_join(keys: DataFrame, rows: DataFrame, key: str, vocab: DataFrame) -> DataFrame:
    coded = rows.join(vocab, "token", "left").select(
        key, "pos", F.coalesce("idx", F.lit(1).cast("bigint")).alias("idx")
    )
    packed = coded.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("pos", "idx"))).alias("pairs")
    )
    return keys.join(packed, key, "left").select(
        key,
        F.coalesce(
            F.transform("pairs", lambda p: p["idx"]), F.array().cast("array<bigint>")
        ).alias("ids"),
    )


def mean_embedding(ids: DataFrame, key: str, vectors: DataFrame, dim: int) -> DataFrame:
    """Mean vector of a text's token ids, padding left out; ``vectors`` is (idx, vector)."""
    rows = ids.select(key, F.explode("ids").alias("idx")).where(F.col("idx") != 0)
    # Repeats of a token within a text are combined before the vectors come in.
    counts = rows.groupBy(key, "idx").agg(F.count("*").alias("n"))
    joined = counts.join(vectors, "idx")
    sums = [F.sum(F.col("n") * F.element_at("vector", i + 1)).alias(f"s{i}") for i in range(dim)]
    totals = joined.groupBy(key).agg(*sums, F.sum("n").alias("tokens"))
    mean = F.array(*[F.col(f"s{i}") / F.col("tokens") for i in range(dim)])
    return totals.select(key, mean.alias("embedding"))


def concatenated(*cols: str | Column) -> Column:
    """Feature vectors glued into one."""
    return F.concat(*cols)


def metric_scaled(weights: DataFrame, key: str, metric: str) -> DataFrame:
    """Sparse non-negative rows (key, token, weight) scaled so that Euclidean distance is the metric's:
    unit length for cosine, square roots of the shares for Hellinger (times the square root of 2)."""
    per_row = Window.partitionBy(key)  # bounded by a document's own distinct words
    w = F.col("weight")
    if metric == "cosine":
        w = F.try_divide(w, F.sqrt(F.sum(w * w).over(per_row)))
    elif metric == "hellinger":
        w = F.sqrt(F.try_divide(w, F.sum(w).over(per_row)))
    elif metric != "euclidean":
        raise ValueError(f"unknown metric {metric!r}")
    return weights.withColumn("weight", F.coalesce(w, F.lit(0.0)))


def token_signs(dim: int, seed: int = 42) -> Column:
    """The signs that a token draws for ``dim`` components: a bit is set where the sign is plus.

    A sign is plus where ``hash_uniform`` is at least 0.5, which the first digit of the hash tells.
    """
    def bit(d: int) -> Column:
        digest = F.md5(F.concat_ws("|", F.col("token"), F.lit(str(d)), F.lit(str(seed))))
        return F.when(F.substring(digest, 1, 1) >= "8", F.lit(1 << d % SIGN_BITS)).otherwise(0).cast("bigint")

    words = [
        sum((bit(d) for d in range(start, min(start + SIGN_BITS, dim))), F.lit(0).cast("bigint"))
        for start in range(0, dim, SIGN_BITS)
    ]
    return F.array(*words) if len(words) > 1 else words[0]


def signed(weights: DataFrame, dim: int, seed: int = 42) -> DataFrame:
    """Rows with the signs of their token, which are drawn once per token."""
    drawn = weights.select("token").distinct().withColumn(SIGNS, token_signs(dim, seed))
    return weights.join(drawn, "token")


def random_projection(weights: DataFrame, key: str, dim: int, seed: int = 42) -> DataFrame:
    """Sparse rows (key, token, weight) to ``dim`` dense components, signs drawn per token.

    Rows that come with a column of signs (``token_signs`` of the same ``dim`` and ``seed``) are summed where
    they lie: rows dealt by ``key`` already, as by a window over it, are not moved again. Others get
    their signs by a join.
    """
    rows = weights if SIGNS in weights.columns else signed(weights, dim, seed)

    def component(d: int) -> Column:
        word = F.col(SIGNS) if dim <= SIGN_BITS else F.element_at(SIGNS, d // SIGN_BITS + 1)
        plus = word.bitwiseAND(F.lit(1 << d % SIGN_BITS).cast("bigint")) != 0
        return F.sum(F.when(plus, F.col("weight")).otherwise(-F.col("weight"))).alias(f"p{d}")

    scale = 1.0 / dim**0.5
    packed = rows.groupBy(key).agg(*[component(d) for d in range(dim)])
    return packed.select(key, F.array(*[F.col(f"p{d}") * scale for d in range(dim)]).alias("embedding"))
