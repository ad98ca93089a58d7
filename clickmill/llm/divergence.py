"""Audit of how the sources of a language differ in their words, in exact integers."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize, spread
from .columns import UPPER, renamed, whole

MIN_DOCUMENTS = 10
TOP_TERMS = 10
UNIT = 1_000_000_000
HELD_TERMS = 400_000
COLUMNS = 1024
WIDE_BLOCK = 1024  # terms of a block whose counts have few levels
NARROW_BLOCK = 64
FEW_LEVELS_BITS = 5

_PARTIAL = pa.schema([
    ("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()),
    ("docs", pa.int64()),
])
_PAIR = pa.schema([
    ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64()),
])
# Letters and all that is not ASCII make terms; A-Z is lower-cased, other ASCII separates.
_TERM_BYTES = bytes(
    ord(chr(b).lower()) if chr(b) in UPPER else b if b >= 128 or chr(b).isalpha() else 32
    for b in range(256)
)


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in order, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents per (lang, source, term), added up inside the task.

    At most ``HELD_TERMS`` entries, and those of the last slice, are held; then they go out.
    """
    seen: defaultdict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in seen.items():
            size = len(n)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()),
                pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()),
                pa.array([docs[t] for t in n], pa.int64()),
            ], schema=_PARTIAL)
        seen.clear()

    for b in batches:
        for k in range(0, b.num_rows, 64):
            part = b.slice(k, 64)
            for lang, source, text in zip(*(part.column(c).to_pylist() for c in range(3))):
                found = terms_of(text)
                n, docs = seen[lang, source]
                n.update(found)
                docs.update(set(found))
            if sum(len(n) for n, _ in seen.values()) >= HELD_TERMS:
                yield from rows()
    yield from rows()


def kept_terms(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n, total, leads): counts of the terms that a language keeps.

    ``docs`` has (lang, source, text) without nulls. ``total`` is the term's count in the language;
    ``leads`` marks one row per (lang, term). Counts are added up per source before the sources of a
    term meet, so that a frequent term is one row per source there, however many tasks saw it.
    """
    partial = spread(docs).mapInArrow(
        _partial_counts, "lang string, source string, term string, n long, docs long"
    )
    cells = partial.groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )
    term = Window.partitionBy("lang", "term")
    return cells.select(
        "lang", "source", "term", "n", F.sum("n").over(term).alias("total"),
        F.sum("docs").over(term).alias("in_docs"),
        (F.row_number().over(term.orderBy("source")) == 1).alias("leads"),
    ).where(F.col("in_docs") >= min_documents).drop("in_docs")


def price(n: Column, size: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (size + 2 * terms)) without overflow; null where there is no term."""
    below = F.when(terms > 0, (size + 2 * terms).cast("decimal(20,0)"))
    above = F.lit(UNIT).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    return F.call_function("div", above, below) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); prices stay under 2^31, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, size, lang_size, terms): every group with its sums over kept terms."""
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = kept.groupBy("lang").agg(
        F.sum("n").alias("lang_size"), F.sum(F.col("leads").cast("long")).alias("terms")
    )
    every = docs.select("lang", "source").distinct()
    return every.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(
        0, ["size", "lang_size", "terms"]
    )


def block_gaps(prices: np.ndarray) -> np.ndarray:
    """Summed gaps of all pairs of columns of (terms x groups) prices, upper half.

    A column of the one-hot matrix is a (group, count level); its product with its transpose holds
    the joint table of every two groups: how many terms have which two levels. Groups are taken in
    blocks of about ``COLUMNS`` columns. The products are exact, since a table's entries are at most
    the number of terms, and each table is priced in 64-bit integers.
    """
    n_terms, n_groups = prices.shape
    value = np.zeros((n_groups, n_groups), np.int64)
    if not n_terms:
        return value
    blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    start = 0
    while start < n_groups:
        level, owner, hot = [], [], []
        end = start
        width = 0
        while end < n_groups and (end == start or width < COLUMNS):
            values, at = np.unique(prices[:, end], return_inverse=True)
            level.append(values)
            owner.append(np.full(len(values), end))
            hot.append(at + width)
            width += len(values)
            end += 1
        one_hot = np.zeros((n_terms, width), np.float32)
        one_hot[np.arange(n_terms)[:, None], np.stack(hot, axis=1)] = 1
        blocks.append((one_hot, np.concatenate(level), np.concatenate(owner)))
        start = end
    for x, (left, p_left, s_left) in enumerate(blocks):
        for right, p_right, s_right in blocks[x:]:
            joint = left.T @ right
            a, b = np.nonzero(joint)
            upper = s_left[a] < s_right[b]
            a, b = a[upper], b[upper]
            p, q = p_left[a], p_right[b]
            terms = joint[a, b].astype(np.int64)
            np.add.at(value, (s_left[a], s_right[b]), terms * ((p - q) ** 2 // (p + q)))
    return value


def _price_block(key: tuple, cells: pa.Table, groups: pa.Table) -> pa.Table:
    names = sorted(zip(groups["source"].to_pylist(), groups["p0"].to_pylist()))
    at = {name: k for k, (name, _) in enumerate(names)}
    rows: dict[str, int] = {}
    row = [rows.setdefault(t, len(rows)) for t in cells["term"].to_pylist()]
    prices = np.empty((len(rows), len(names)), np.int64)
    if len(rows):
        prices[:] = [p0 for _, p0 in names]
        prices[row, [at[s] for s in cells["source"].to_pylist()]] = cells["p"].to_numpy()
    value = block_gaps(prices)
    s, t = np.triu_indices(len(names), 1)
    source = pa.array([n for n, _ in names], pa.string())
    return pa.Table.from_arrays([
        pa.array([key[0].as_py()] * len(s), pa.string()), source.take(pa.array(s)),
        source.take(pa.array(t)), pa.array(value[s, t]),
    ], schema=_PAIR)


def pair_gaps(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language, both ways round.

    Terms are dealt into blocks by the magnitude of their count: rare terms, whose counts have few
    levels, in wide blocks, others in narrow ones, so that a block's matrix stays small. One more
    block without terms gives each pair its row. A task adds up its blocks before they are shuffled.
    """
    bits = F.floor(F.log2("total")).cast("int")
    per_block = F.when(F.col("bits") < FEW_LEVELS_BITS, WIDE_BLOCK).otherwise(NARROW_BLOCK)
    classes = kept.where("leads").groupBy("lang", bits.alias("bits")).agg(
        F.count("*").alias("terms")
    ).select("lang", "bits", F.ceil(F.col("terms") / per_block).cast("long").alias("n_blocks"))
    p = price(F.col("n"), F.col("size"), F.col("terms"))
    cells = kept.withColumn("bits", bits).join(
        groups.select("lang", "source", "size", "terms"), ["lang", "source"]
    ).join(classes, ["lang", "bits"]).select(
        "lang", "bits", F.pmod(F.xxhash64("term"), F.col("n_blocks")).alias("block"), "source",
        "term", p.alias("p"),
    )
    blocks = classes.select(
        "lang", "bits", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block")
    ).unionByName(groups.select("lang").distinct().select(
        "lang", F.lit(-1).alias("bits"), F.lit(0).cast("long").alias("block")
    ))
    p0 = price(F.lit(0), F.col("size"), F.col("terms"))
    members = blocks.join(groups.select("lang", "source", p0.alias("p0")), "lang").select(
        F.col("lang").alias("in_lang"), F.col("bits").alias("in_bits"),
        F.col("block").alias("in_block"), "source", "p0",
    )
    sums = cells.groupBy("lang", "bits", "block").cogroup(
        members.groupBy("in_lang", "in_bits", "in_block")
    ).applyInArrow(
        _price_block, "lang string, source string, item string, value long"
    ).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ends = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    return sums.select("lang", F.explode(ends).alias("e"), "value").select("lang", "e.*", "value")


def term_gaps(kept: DataFrame, groups: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, item, value, rank): the ``top`` terms that a source has more than its language."""
    p = price(F.col("n"), F.col("size"), F.col("terms"))
    q = price(F.col("total"), F.col("lang_size"), F.col("terms"))
    return kept.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")
    ).where("p > q").select(
        "lang", "source", "item", gap(F.col("p"), F.col("q")).alias("value")
    ).withColumn("rank", F.row_number().over(_ranked())).where(F.col("rank") <= top)


def _ranked():
    return Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")


def audit_sources(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    min_documents: int = MIN_DOCUMENTS,
    top: int = TOP_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to other sources, and telling terms.

    Part ``pair`` ranks the other sources of the language by the summed gap of smoothed, integer
    term shares, part ``term`` the ``top`` terms of the source by their gap to the whole language.
    All figures are exact integers. Counts of kept terms are stored in the shared folder once.

    Defined cases: null text, language or source count as empty strings; a group without terms has
    all its pairs, and so has a language that keeps no term (value 0); a language with one source
    has no pairs. Repeated rows are documents of their own, ties go by item in byte order. An empty
    table gives no rows. Other columns are ignored.
    """
    rows = renamed(docs, text=text, lang=lang, source=source).select(
        whole("lang").alias("lang"), whole("source").alias("source"), whole("text").alias("text")
    )
    kept = materialize(kept_terms(rows, min_documents), "kept-terms")
    groups = materialize(groups_of(rows, kept), "term-groups")
    pairs = pair_gaps(kept, groups).withColumn("rank", F.row_number().over(_ranked()))
    parts = {"pair": pairs, "term": term_gaps(kept, groups, top)}
    columns = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    pair, term = (d.withColumn("part", F.lit(k)).select(columns) for k, d in parts.items())
    return pair.unionByName(term)
