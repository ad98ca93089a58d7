"""Quality rules: figures of each text, and lines that many documents of one host share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .columns import lines, lower_ascii, renamed, strip_blanks, whole, words

SPAN = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_DOCS = 10


def _covered(rows: DataFrame) -> DataFrame:
    """``rows`` with n_repeat_words, from ``windows``, the window hashes by position.

    Only texts that repeat a window pay for the sort; a covered stretch is counted from the gaps
    between the starts of repeated windows. Every step is a column of its own, so that no lambda
    evaluates an array anew for each element.
    """
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    paired = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = rows.withColumn("marked", F.when(repeats, F.sort_array(paired)))
    twin = F.transform(
        "marked",
        lambda x, i: F.when(
            (F.get("marked", i - 1)["h"] == x["h"]) | (F.get("marked", i + 1)["h"] == x["h"]),
            x["i"],
        ),
    )
    rows = rows.withColumn("starts", F.sort_array(F.filter(twin, lambda p: p.isNotNull())))
    gap = F.aggregate(
        F.transform(
            "starts",
            lambda p, i: F.least(
                F.coalesce(F.get("starts", i + 1) - p, F.lit(SPAN)), F.lit(SPAN)
            ),
        ),
        F.lit(0).cast("long"), lambda a, g: a + g,
    )
    return rows.withColumn("n_repeat_words", F.coalesce(gap, F.lit(0)).cast("long"))


def text_figures(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """One row per document with its counts and, per line that has a word, key, words and place.

    ``content`` is the whole MD5 of the text, which tells copies from other texts.
    """
    base = renamed(docs, doc_id=doc_id, text=text, host=host).select(
        "doc_id", whole("text").alias("t"), F.coalesce("host", F.lit("")).alias("host")
    )
    split = base.select(
        "doc_id", "host", "t", words(F.col("t")).alias("w"),
        F.filter(lines(F.col("t")), lambda x: strip_blanks(x) != "").alias("l"),
        F.unhex(F.md5("t")).alias("content"),
    )
    hashed = split.withColumn("wh", F.transform("w", lambda x: F.xxhash64(x)))
    windows = hashed.withColumn(
        "windows",
        F.when(
            F.size("wh") >= SPAN,
            F.transform(
                F.sequence(F.lit(0), F.size("wh") - SPAN),
                lambda i: F.xxhash64(*(F.get("wh", i + k) for k in range(SPAN))),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    return _covered(windows).select(
        "doc_id", "host", "content",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.transform(
            "l",
            lambda x: F.struct(
                F.xxhash64("host", lower_ascii(strip_blanks(x))).alias("key"),
                F.size(words(x)).alias("n"),
            ),
        ).alias("keyed"),
    )


def judge_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    min_docs: int = MIN_DOCS,
    with_text: bool = False,
) -> DataFrame:
    """One row per document: text figures, words on lines above the limit, and the verdict.

    A line is compared after stripping white space and lower-casing A-Z. It is above the limit when
    at least ``min_docs`` distinct texts of the host hold it, however many texts the host has. Such
    a line is removed from all texts of the host but one (the text with the smallest digest, and its
    exact copies), so no line is lost from a host; ``with_text`` adds ``cleaned_text``, the text
    without those lines. A document fails the base rules with fewer than 20 words or over 30 % words in repeated 8-word
    windows, and is rejected as depleted when removal leaves fewer than 20 words.

    Texts are read once; the joins and counts move hashes and numbers only. Counts are combined
    before each shuffle, so a line that all documents share is one row per task; the join that
    marks lines is left to the adaptive skew join.

    Defined cases: a null or empty text has no words and fails. A null host is a host of its own.
    Every row is judged, also rows that share a ``doc_id`` or have a null one: their removed words
    are looked up by content, not by id. An empty table gives no rows. Other columns are ignored.
    """
    figures = materialize(text_figures(docs, doc_id, text, host), "figures")
    distinct = figures.groupBy("host", "content").agg(F.first("keyed").alias("keyed"))
    distinct = materialize(
        distinct.select("host", "content", F.explode("keyed").alias("x")).groupBy(
            "host", "content", F.col("x.key").alias("key")
        ).agg(F.sum("x.n").cast("long").alias("n")), "host-lines",
    )
    holders = distinct.groupBy("host", "key").agg(
        F.count(F.lit(1)).alias("held"), F.min("content").alias("owner")
    ).where(F.col("held") >= min_docs)
    above = materialize(holders.select("host", "key", "owner"), "above-limit")
    removed = (
        distinct.join(above, ["host", "key"]).where(F.col("content") != F.col("owner"))
        .groupBy("host", "content").agg(F.sum("n").alias("n_removed_words"))
    )
    n, out = F.col("n_words"), F.coalesce(F.col("n_removed_words"), F.lit(0))
    failed = (n < MIN_WORDS) | (F.col("n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT)
    judged = figures.drop("keyed").join(removed, ["host", "content"], "left").select(
        "doc_id", "host", "content", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (n - out >= MIN_WORDS)).alias("kept"),
        out.alias("n_removed_words"),
    )
    if not with_text:
        return judged.drop("host", "content")
    texts = _without_lines(docs, text, host, above)
    return judged.join(texts, ["host", "content"]).drop("host", "content")


def _without_lines(docs: DataFrame, text: str, host: str, above: DataFrame) -> DataFrame:
    """(host, content, cleaned_text): each distinct text of a host without its lines above the limit."""
    texts = renamed(docs, text=text, host=host).select(
        F.coalesce("host", F.lit("")).alias("host"), whole("text").alias("t")
    ).withColumn("content", F.unhex(F.md5("t"))).groupBy("host", "content").agg(F.first("t").alias("t"))
    texts = materialize(texts.withColumn("l", lines(F.col("t"))).drop("t"), "host-texts")
    bare = strip_blanks(F.col("line"))
    gone = texts.select("host", "content", F.posexplode("l").alias("pos", "line")).where(bare != "").select(
        "host", "content", "pos", F.xxhash64("host", lower_ascii(bare)).alias("key")
    ).join(above, ["host", "key"]).where(F.col("content") != F.col("owner")).groupBy(
        "host", "content").agg(F.collect_set("pos").alias("gone"))
    left = F.array_except(F.sequence(F.lit(0), F.size("l") - 1), F.col("gone"))
    return texts.join(gone, ["host", "content"], "left").select(
        "host", "content",
        F.array_join(F.when(F.col("gone").isNull(), F.col("l")).otherwise(
            F.transform(left, lambda i: F.get("l", i))), "\n").alias("cleaned_text"),
    )
