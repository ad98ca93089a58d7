"""Repeated lines by levelled, sorted runs of line hashes."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .columns import hash_pair, lines, lower_ascii, renamed, strip_blanks, whole

KEY = ["h1", "h2"]
MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4


class LineRuns:
    """Runs of (h1, h2, n_docs, owner), sorted by hash and bucketed alike, on levels.

    A run is a bucketed table in the shared folder, so runs are merged and anti-joined bucket by
    bucket without a shuffle. ``fan_out`` runs of one level are merged into one of the next, so a
    store of n batches holds O(log n) runs and every row is rewritten O(log n) times.
    """

    def __init__(self, spark: SparkSession, fan_out: int = 2, buckets: int | None = None):
        self.spark = spark
        self.fan_out = fan_out
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            rows.repartition(self.buckets, *KEY).sortWithinPartitions(*KEY)
            .write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
            .option("path", scratch_path(self.spark, "line-run")).saveAsTable(name)
        )
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """``keys`` without those that a run holds."""
        return reduce(lambda k, run: k.join(run, KEY, "left_anti"), self.runs(), keys)

    def add(self, keys: DataFrame) -> None:
        """Merge a batch's (h1, h2, n_docs, last_doc) with the runs and append it as a new run.

        A key that no run holds is owned by the batch's last document; a known key only adds to
        the number of documents, since its owner came with an earlier batch.
        """
        staged = self._write(keys)
        own = self.spark.table(staged)
        fresh = self.unseen(own).select(*KEY, F.lit(True).alias("fresh"))
        run = own.join(fresh, KEY, "left").select(
            *KEY, "n_docs", F.when(F.col("fresh"), F.col("last_doc")).alias("owner")
        )
        name = self._write(run) if self.levels else self._write(
            own.select(*KEY, "n_docs", F.col("last_doc").alias("owner"))
        )
        self.spark.sql(f"DROP TABLE {staged}")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        level = 0
        while len(self.levels[level]) >= self.fan_out:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._merge(self.levels[level]))
            self.levels[level] = []
            level += 1

    def _merge(self, names: list[str]) -> str:
        def both(a: DataFrame, b: DataFrame) -> DataFrame:
            theirs = b.select(*KEY, F.col("n_docs").alias("n2"), F.col("owner").alias("o2"))
            zero = F.lit(0)
            return a.join(theirs, KEY, "full").select(
                *KEY,
                (F.coalesce("n_docs", zero) + F.coalesce("n2", zero)).alias("n_docs"),
                F.coalesce("owner", "o2").alias("owner"),
            )

        merged = self._write(reduce(both, [self.spark.table(n) for n in names]))
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
        return merged

    def compact(self) -> DataFrame | None:
        """All runs merged into one."""
        names = [name for level in self.levels for name in level]
        if not names:
            return None
        one = names[0] if len(names) == 1 else self._merge(names)
        self.levels = [*([] for _ in self.levels[1:]), [one]]
        return self.spark.table(one)


def keyed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, pos, h1, h2) of the lines whose key has at least ``min_chars`` characters.

    The key is the line without surrounding white space, A-Z lower-cased.
    """
    rows = docs.where("doc_id is not null").select("doc_id", F.posexplode(lines(whole("text"))))
    bare = rows.select("doc_id", "pos", strip_blanks(F.col("col")).alias("line"))
    long = bare.where(F.char_length("line") >= min_chars)
    return long.select("doc_id", "pos", lower_ascii(F.col("line")).alias("key")).select(
        "doc_id", "pos", *hash_pair(F.col("key"))
    )


def line_counts(keyed: DataFrame) -> DataFrame:
    """(h1, h2, n_docs, last_doc): distinct documents of every key."""
    return keyed.groupBy(*KEY, "doc_id").agg(F.lit(1).alias("_one")).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc")
    )


def _batches(docs: DataFrame, n: int) -> list[Column]:
    """Conditions that cut the table into ``n`` ranges of ids, largest ids first."""
    cuts = docs.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.01) if n > 1 else []
    edges = [None, *sorted({int(c) for c in cuts}), None]
    out = []
    for low, high in zip(edges, edges[1:]):
        cond = F.col("doc_id").isNotNull()
        if low is not None:
            cond = cond & (F.col("doc_id") >= low)
        if high is not None:
            cond = cond & (F.col("doc_id") < high)
        out.append(cond)
    return out[::-1]


def drop_repeated_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    runs: LineRuns | None = None,
) -> DataFrame:
    """One row per document: (doc_id, n_lines, n_dropped, kept_text).

    Lines whose key (stripped, A-Z lower-cased) has at least ``min_chars`` characters and occurs in
    at least ``min_docs`` documents are dropped, but for the document with the largest id that holds
    the key. The documents enter a store of line runs in ``batches`` ranges of ids, largest ids
    first: each batch is merged against the runs, which tells new keys (owned by this batch) from
    known ones, and is added as a run of its own. At the end the runs are merged and every batch's
    lines are merge-joined with the keys above the limit.

    ``runs`` may be a store that holds earlier, larger ids; it is extended.

    Only hashes, ids and counts are shuffled until the last join, which moves each text once.
    Counts are combined before each shuffle; the skewed key of a very common line is split by the
    adaptive join. Nothing is collected per line.

    Defined cases: a null or empty text is one empty line. Rows with a null ``doc_id`` are neither
    counted nor changed. Rows that share a ``doc_id`` count as one document and keep or lose their
    lines together by position. An empty table gives no rows. Other columns are ignored.
    """
    base = renamed(docs, doc_id=doc_id, text=text)
    store = runs or LineRuns(base.sparkSession)
    parts = []
    for cond in _batches(base, batches):
        part = materialize(keyed_lines(base.where(cond), min_chars), "lines")
        store.add(line_counts(part))
        parts.append(part)
    common = materialize(
        store.compact().where(F.col("n_docs") >= min_docs).select(*KEY, "owner"), "common-lines"
    )
    keyed = reduce(DataFrame.unionByName, parts)
    dropped = keyed.join(common, KEY).where(F.col("doc_id") != F.col("owner"))
    per_doc = dropped.groupBy("doc_id").agg(F.collect_set("pos").alias("gone"))
    split = base.join(per_doc, "doc_id", "left").select(
        "doc_id", lines(whole("text")).alias("l"), "gone"
    )
    stay = F.array_except(F.sequence(F.lit(0), F.size("l") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.array_join("l", "\n")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get("l", i)), "\n")
    )
    return split.select(
        "doc_id", F.size("l").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept_text"),
    )
