"""Near-duplicate documents by an LSH forest over MinHash signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .columns import renamed, whole
from .components import components

WORDS = 5
SIMILARITY = 80
TREES = 12
DEPTH = 8
MIN_DEPTH = 4
FIRST_TREES = 4
REACH = 4
GROUP_SHINGLES = 1 << 20
HOLDERS_PER_SALT = 2_048
SIZE_STEP = 1.03
_VALUE = 4  # bytes of one signature value


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; the whole text if it is shorter."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
        out += h[k : len(h) - n + 1 + k]
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(31)
    return np.unique(out)


def _digest(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _sketch(n: int, values: int):
    """Set size, set digest and signature of each document."""
    rng = np.random.default_rng(11)
    flips = rng.integers(0, 1 << 32, values, dtype=np.uint32)
    factors = rng.integers(0, 1 << 31, values, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def signatures(sets: list[np.ndarray]) -> np.ndarray:
        lens = np.array([len(s) for s in sets])
        low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum(lens) - lens
        out = np.empty((len(sets), values), dtype=">u4")
        for k in range(values):
            out[:, k] = np.minimum.reduceat((low ^ flips[k]) * factors[k], starts)
        return out

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sets, size = [], [], 0
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(key)
                sets.append(shingle_set(text.as_buffer().to_pybytes(), n))
                size += len(sets[-1])
                if size >= GROUP_SHINGLES:
                    yield rows(ids, sets)
                    ids, sets, size = [], [], 0
            if ids:
                yield rows(ids, sets)

    def rows(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        full = [s for s in sets if len(s)]
        keys = iter(signatures(full)) if full else iter(())
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array(
                [_digest(s) if len(s) else None for s in sets], pa.int64(),
            ),
            pa.array([next(keys).tobytes() if len(s) else None for s in sets], pa.binary()),
        ], names=["doc_id", "n_shingles", "node", "signature"])

    return sketch


def _neighbours(prefix: int, reach: int, listing: bool):
    """Scan of sorted (tree, key, node, root) rows.

    Emits pairs of rows on either side of a change of root that share ``prefix`` bytes of key in
    one tree: the two rows at the change, and up to ``reach`` rows further each way against the
    nearer of the two. ``listing`` adds every row that shares its prefix with a neighbour, and the
    first and last row of the task for the seam with the next task.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        window: list[tuple] = []  # recent rows with one (tree, prefix), newest last
        group, listed_last, first, last = None, True, True, None
        out: list[tuple] = []
        for b in batches:
            trees, keys, nodes, roots = (c.to_pylist() for c in b.columns)
            for row in zip(trees, keys, nodes, roots):
                if first:
                    out.append(("first", part, row[0], row[1], row[2], row[3]))
                    first = False
                same = (row[0], row[1][:prefix])
                if same != group:
                    group, window, listed_last = same, [], False
                if listing and window:
                    if not listed_last:
                        out.append(("row", 0, *window[-1]))
                        listed_last = True
                    out.append(("row", 0, *row))
                for older in _partners(window, row, reach):
                    out.append(("pair", 0, row[0], b"", older[2], row[2]))
                window.append(row)
                if len(window) > 2 * reach + 2:
                    del window[0]
                last = row
                if len(out) >= 8192:
                    yield _pairs(out)
                    out = []
        if last is not None:
            out.append(("last", part, last[0], last[1], last[2], last[3]))
        if out:
            yield _pairs(out)

    return scan


def _partners(window: list[tuple], row: tuple, reach: int) -> list[tuple]:
    """Earlier rows to compare ``row`` with: those near the last change of root.

    Where the row begins a new root, it meets the rows of the old one within reach; within reach
    after such a change, it meets the last row of the old root.
    """
    if not window:
        return []
    root = row[3]
    if window[-1][3] != root:
        old, out = window[-1][3], []
        for older in reversed(window):
            if older[3] != old or len(out) > reach:
                break
            out.append(older)
        return out
    run = 0
    for older in reversed(window):
        if older[3] != root:
            return [older]
        run += 1
        if run > reach:
            break
    return []


_SCAN_SQL = "kind string, part int, tree int, key binary, a long, b long"


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
        names=["kind", "part", "tree", "key", "a", "b"],
    )


def _scan(rows: DataFrame, prefix: int, reach: int, listing: bool) -> tuple[DataFrame, DataFrame]:
    """(listed rows, pairs) of (tree, key, node, root) rows in sorted order."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["tree", "key", "node"]
    found = materialize(
        rows.select("tree", "key", "node", "root").repartitionByRange(tasks, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(_neighbours(prefix, reach, listing), _SCAN_SQL), "forest",
    )
    listed = found.where("kind = 'row'").select("tree", "key", F.col("a").alias("node"))
    pairs = found.where("kind = 'pair'").select("tree", "a", "b")
    # The seams between tasks: two rows per task, whatever the number of documents.
    ends = found.where("kind in ('first', 'last')").drop("kind").collect()
    ends.sort(key=lambda r: (r["part"], r["tree"], bytes(r["key"]), r["a"]))
    met = [
        (x, y) for x, y in zip(ends, ends[1:])
        if x["part"] != y["part"] and x["tree"] == y["tree"] and x["key"][:prefix] == y["key"][:prefix]
    ]
    if met:
        spark = rows.sparkSession
        across = [(x["tree"], x["a"], y["a"]) for x, y in met if x["b"] != y["b"]]
        pairs = pairs.unionByName(spark.createDataFrame(across, "tree int, a long, b long"))
        edge = [(r["tree"], bytes(r["key"]), r["a"]) for pair in met for r in pair]
        listed = listed.unionByName(spark.createDataFrame(edge, "tree int, key binary, node long"))
    return listed, pairs


def _agree(percent: int):
    """Rows of two sets' blobs to (u, r, linked) by the exact sizes of intersection and union."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(linked, pa.bool_())], names=["u", "r", "linked"]
            )

    return agree


def _set_blobs(n: int):
    """Sets of texts under the digest that is wanted; texts with another digest are left out."""

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sets = [], []
            for node, text in zip(b.column(0).to_pylist(), b.column(1)):
                found = shingle_set(text.as_buffer().to_pybytes(), n)
                if _digest(found) == node:
                    nodes.append(node)
                    sets.append(found.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "blob"]
            )

    return blobs


def _size_edges(step: float) -> np.ndarray:
    """Smallest set size of each size class; a class ends where ``step`` times its start begins."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, int(np.ceil(edges[-1] * step))))
    return np.array(edges, dtype=np.int64)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root, size, shingle): the sets in long form."""
    for b in batches:
        nodes, roots = b.column(0).to_numpy(), b.column(1).to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(2)]
        begin = 0
        while begin < len(sets):
            end, rows = begin, 0
            while end < len(sets) and (end == begin or rows + len(sets[end]) <= GROUP_SHINGLES):
                rows += len(sets[end])
                end += 1
            sizes = np.array([len(x) for x in sets[begin:end]], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(nodes[begin:end], sizes)),
                pa.array(np.repeat(roots[begin:end], sizes)),
                pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets[begin:end])),
            ], names=["node", "root", "size", "shingle"])
            begin = end


_PREFIX_SQL = (
    "shingle long, short int, long int, longer boolean, node long, root long, size long, left long, "
    "holders long"
)


def _prefixes(percent: int, step: float):
    """The prefixes under which a set meets sets of each size class, from its shared shingles.

    ``shared`` lists the shingles that sets of other components hold too, rarest first; the set's
    other shingles stand before them. Two sets of sizes a <= b within the limit have
    percent x (a + b) / (100 + percent) shingles in common, so the first one in this order has at
    least as many shingles from it on (``left``) in both.
    """
    edges = _size_edges(step)

    def class_of(size: int) -> int:
        return int(np.searchsorted(edges, size, side="right")) - 1

    def meeting(size: int) -> list[tuple[int, int, bool, int]]:
        """(class of the shorter, class of the longer, whether this is the longer, least ``left``)."""
        own, out = class_of(size), []
        least = -(-percent * size // 100)
        for other in range(own, class_of(100 * size // percent) + 1):
            partner = max(size, int(edges[other]))
            out.append((own, other, False, -(-percent * (size + partner) // (100 + percent))))
        for other in range(class_of(max(least, 1)), own + 1):
            partner = max(least, int(edges[other]))
            out.append((other, own, True, -(-percent * (size + partner) // (100 + percent))))
        return out

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: list[list] = [[] for _ in range(9)]
            rows = 0
            for node, root, size, shared in zip(*(c.to_pylist() for c in b.columns[:3]), b.column(3)):
                holders, shingles = (f.to_numpy() for f in shared.values.flatten())
                left = np.arange(len(shingles), 0, -1, dtype=np.int64)
                for short, long, longer, least in meeting(size):
                    n = max(0, len(shingles) - least + 1)
                    columns = (
                        shingles[:n], short, long, longer, node, root, size, left[:n], holders[:n]
                    )
                    for part, column in zip(parts, columns):
                        part.append(column if isinstance(column, np.ndarray) else np.full(n, column))
                    rows += n
                if rows >= GROUP_SHINGLES:
                    yield batch(parts)
                    parts, rows = [[] for _ in range(9)], 0
            if rows:
                yield batch(parts)

    def batch(parts: list[list]) -> pa.RecordBatch:
        kinds = (
            pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(),
            pa.int64(), pa.int64(),
        )
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x), t) for x, t in zip(parts, kinds)],
            names=[c.split()[0] for c in _PREFIX_SQL.split(", ")],
        )

    return prefixes


def _open_pairs(
    active: DataFrame, sets: DataFrame, stars: DataFrame, prefix: int, percent: int
) -> DataFrame:
    """(u, r): every pair of open sets of different components that can be within the limit.

    Open are the sets that share ``prefix`` bytes of key in some tree with one of another component.
    Exact: a join of size-aware prefixes in the order of rarity, with the length and position bounds
    of a set similarity join. Shingles that only one component holds come first in every set and are
    not joined, so a finished component costs no pairs; frequent shingles are salted.
    """
    roots = stars.select(F.col("u").alias("node"), F.col("r").alias("root"))
    rooted = active.select("tree", F.col("key").substr(1, prefix).alias("prefix"), "node").join(
        roots, "node", "left"
    ).withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("tree", "prefix").agg(
        F.min("root").alias("low"), F.max("root").alias("high")
    ).where("low < high")
    nodes = rooted.join(mixed, ["tree", "prefix"], "left_semi").select("node", "root").distinct()
    opened = materialize(sets.join(nodes, "node").select("node", "root", "blob"), "open")
    members = opened.mapInArrow(_members, "node long, root long, size long, shingle long")
    common = materialize(
        members.groupBy("shingle").agg(
            F.count(F.lit(1)).alias("holders"), F.min("root").alias("low"), F.max("root").alias("high")
        ).where("low < high").select("shingle", "holders"), "common",
    )
    shared = members.join(common, "shingle").groupBy("node", "root", "size").agg(
        F.sort_array(F.collect_set(F.struct("holders", "shingle"))).alias("shared")
    )
    prefixes = materialize(
        shared.mapInArrow(_prefixes(percent, SIZE_STEP), _PREFIX_SQL), "prefixes"
    )
    salts = F.ceil(F.col("holders") / HOLDERS_PER_SALT)
    key = ["shingle", "short", "long", "salt"]

    def side(longer: bool, salt, names: tuple[str, str, str, str]) -> DataFrame:
        own = [F.col(c).alias(n) for c, n in zip(("node", "root", "size", "left"), names)]
        return prefixes.where(F.col("longer") == longer).withColumn("salt", salt).select(*key, *own)

    a = side(False, F.pmod(F.xxhash64("node"), salts), ("a", "a_root", "a_size", "a_left"))
    b = side(True, F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)), ("b", "b_root", "b_size", "b_left"))
    met = a.join(b, key).where(
        "a_root <> b_root and (a_size < b_size or (a_size = b_size and a < b)) "
        f"and 100 * a_size >= {percent} * b_size "
        f"and {100 + percent} * least(a_left, b_left) >= {percent} * (a_size + b_size)"
    )
    return met.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("r")).distinct()


def _judge(wanted: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(u, r, linked) of the pairs (u, r), by their full sets."""
    return materialize(
        wanted.join(sets.select(F.col("node").alias("u"), F.col("blob").alias("x")), "u")
        .join(sets.select(F.col("node").alias("r"), F.col("blob").alias("y")), "r")
        .select("u", "r", "x", "y")
        .mapInArrow(_agree(similarity), "u long, r long, linked boolean"), "links",
    )


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    similarity: int = SIMILARITY,
    trees: int = TREES,
    depth: int = DEPTH,
    min_depth: int = MIN_DEPTH,
    first_trees: int = FIRST_TREES,
    reach: int = REACH,
) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id, kept).

    Two documents are linked when 100 x intersection >= ``similarity`` x union of their sets of
    ``words``-word shingles (A-Z lower-cased; a shorter text is one shingle). ``component_id`` is the
    smallest id reachable over links; ``kept`` marks the documents that bear it.

    Documents with equal sets are one class from the start, so copies cost one row. Each of
    ``trees`` orders sorts the classes by ``depth`` signature values of its own. Neighbours in an
    order that share at least ``min_depth`` values are candidates: in a sparse region that is the
    shallow end of the prefix, in a dense one the sort brings together those that share most of it.
    Candidates are confirmed on the full sets. Then the orders are scanned again with the components
    found so far, comparing across component borders only (``reach`` rows each way), until a scan
    over all orders finds no new link. So a group of thousands is held together by its neighbours
    and never compared pair by pair, and each scan's work is linear in the rows.

    What the scans leave apart is settled exactly: all documents that share a prefix with one of
    another component go through a set similarity join across component borders, on prefixes of their rarest shingles. So of two
    documents within the limit that share a prefix in some order, none is lost, whatever lies between
    them. The join's work grows with the pairs of components that hold the same rare shingles.

    A pair at the limit shares a prefix in at least one of the orders with probability
    1 - (1 - s^min_depth)^trees: 0.9998 for s = 0.85 with the defaults (0.998 for 0.8).

    Sorting is by range, so a dense region spreads over tasks; joins on very frequent values are
    left to the adaptive skew join. Texts move once, and only those with a candidate are read again.

    Defined cases: null, empty and blank texts have no shingles and form a component each. Rows
    that share an id keep their own sets; a row with a null id has a null component unless a linked
    document has an id, and is not kept. An empty table gives no rows. Other columns are ignored.
    """
    base = renamed(docs, doc_id=doc_id, text=text).select(
        F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text")
    )
    sketches = materialize(
        base.mapInArrow(
            _sketch(words, trees * depth),
            "doc_id long, n_shingles long, node long, signature binary",
        ), "sketches",
    )
    classes = materialize(
        sketches.where("node is not null").groupBy("node").agg(
            F.min("doc_id").alias("low"), F.first("signature").alias("signature")
        ), "classes",
    )
    width, prefix = depth * _VALUE, min_depth * _VALUE
    rows = classes.select(
        F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "signature", "node"
    ).select(
        "tree",
        F.col("signature").substr(F.col("tree") * width + 1, F.lit(width)).alias("key"),
        "node", F.col("node").alias("root"),
    )
    active, pairs = _scan(rows, prefix, 0, True)
    sets = _candidate_sets(base, classes, active, words)
    pairs = pairs.where(F.col("tree") < first_trees)
    tried = stars = None
    while True:
        wanted = pairs.select(
            F.greatest("a", "b").alias("u"), F.least("a", "b").alias("r"), F.lit(0).alias("seen")
        )
        if tried is not None:
            wanted = wanted.unionByName(tried.withColumn("seen", F.lit(1)))
        wanted = wanted.groupBy("u", "r").agg(F.max("seen").alias("seen")).where("seen = 0")
        judged = _judge(wanted, sets, similarity)
        links = judged.where("linked").select("u", "r")
        new = links.count()
        if tried is not None and not new:
            break
        first_round = tried is None
        failed = judged.where("not linked").select("u", "r")
        tried = failed if first_round else tried.unionByName(failed)
        stars = components(links if stars is None else stars.unionByName(links))
        roots = stars.select(F.col("u").alias("node"), F.col("r").alias("root"))
        rooted = active.join(roots, "node", "left").withColumn(
            "root", F.coalesce("root", "node")
        )
        _, pairs = _scan(rooted, prefix, reach, False)
    untried = _open_pairs(active, sets, stars, prefix, similarity).join(tried, ["u", "r"], "left_anti")
    links = _judge(untried, sets, similarity).where("linked").select("u", "r")
    if not links.isEmpty():
        stars = components(stars.unionByName(links))
    return _labelled(sketches, classes, stars)


def _candidate_sets(
    base: DataFrame, classes: DataFrame, active: DataFrame, words: int
) -> DataFrame:
    """(node, blob): the full sets of the classes that have a candidate, from one text each."""
    needed = classes.join(active, "node", "left_semi").select("node", F.col("low").alias("holder"))
    texts = base.join(needed, F.col("doc_id").eqNullSafe(F.col("holder"))).select("node", "text")
    # Rows that share an id and a set give a node twice, which only repeats its pairs.
    return materialize(texts.mapInArrow(_set_blobs(words), "node long, blob binary"), "sets")


def _labelled(sketches: DataFrame, classes: DataFrame, stars: DataFrame) -> DataFrame:
    roots = stars.select(F.col("u").alias("node"), F.col("r").alias("root"))
    rooted = classes.select("node", "low").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node")
    )
    # Stored, so that the join below can split the root of a very large component.
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    lowest = materialize(lowest, "components")
    labels = rooted.join(lowest, "root").select("node", "component_id")
    named = sketches.select("doc_id", "n_shingles", "node").join(labels, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )
    same = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return named.withColumn("kept", same)
