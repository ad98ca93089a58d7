"""Benchmark items inside documents: CGK embedding, bit-sampling LSH, exact edit distance."""

from __future__ import annotations

import math
import string
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .columns import renamed, whole

MAX_EDIT_SHARE = 0.1
MIN_ITEM_WORDS = 5
RECALL = 0.99
SAMPLED = 3
AGREEMENT = 0.6
PIECE_WORDS = 40
BLOCK_WORDS = 200_000
GROUP_WORDS = 1 << 20
PADDING = -1
_PUNCTUATION = string.punctuation.encode()


def normal_words(text: bytes) -> list[bytes]:
    """A-Z lower-cased words without ASCII punctuation."""
    return text.lower().translate(None, _PUNCTUATION).split()


def repetitions(recall: float, sampled: int, agreement: float) -> int:
    """Hash tables needed so that an item within the edit limit is missed with 1 - ``recall``.

    ``agreement`` is the share of embedded symbols that an edited window keeps in common with its
    item at the limit: each of ``sampled`` symbols of a table agrees with that probability.
    """
    return math.ceil(math.log(1 - recall) / math.log(1 - agreement**sampled))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def embed_keys(windows: np.ndarray, tables: int, sampled: int) -> np.ndarray:
    """(tables, windows) keys of equally long windows of word ids.

    CGK: a walk over 3 x length steps copies the word under it, and a random bit of (table, step,
    word) says whether it moves on; edits shift the walk, and the walks meet again at random. Bit
    sampling: each table keeps ``sampled`` symbols of its own walk.
    """
    count, length = windows.shape
    steps = 3 * length
    rng = np.random.default_rng(5)
    kept = np.sort(rng.random((tables, sampled)) * 2 / 3, axis=1)
    kept = (kept * steps).astype(np.int64)
    padded = np.concatenate([windows, np.full((count, 1), PADDING, windows.dtype)], axis=1)
    symbols = padded.astype(np.int64).view(np.uint64).ravel()
    row = (np.arange(count) * (length + 1))[None, :]
    at = np.zeros((tables, count), dtype=np.int64)
    keys = np.full((tables, count), length, dtype=np.uint64)
    salt = np.arange(1, tables + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    samplers = defaultdict(list)  # tables that keep the symbol of a step
    for table, of_table in enumerate(kept.tolist()):
        for step in of_table:
            samplers[step].append(table)
    for step in range(max(samplers) + 1):
        symbol = symbols[row + at]
        for table in samplers.get(step, ()):
            keys[table] = _mix(keys[table] * np.uint64(0x94D049BB133111EB) + symbol[table])
        bits = _mix(symbol * np.uint64(0xD6E8FEB86659FD93) + (salt + np.uint64(step * 0x632BE5AB)))
        at = np.minimum(at + (bits >> np.uint64(63)).astype(np.int64), length)
    return keys


def edit_distance_within(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """(distance, end): the least word edits between ``item`` and any stretch of ``region``."""
    across = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, dtype=np.int64)
    for n, word in enumerate(item.tolist(), 1):
        best = np.empty_like(row)
        best[0] = n
        best[1:] = np.minimum(row[:-1] + (region != word), row[1:] + 1)
        row = np.minimum.accumulate(best - across) + across
    end = int(np.argmin(row))
    return int(row[end]), end


def piece_edges(length: int, longest: int) -> list[int]:
    """Edges of the fewest even pieces of at most ``longest`` words that make up an item."""
    count = -(-length // longest)
    return [k * length // count for k in range(count + 1)]


@dataclass
class ItemBlock:
    """A bounded number of items with everything a task needs to find them.

    Walks of long items that are edited all along do not meet again, so longer items are cut into
    pieces. If an item is within its edit share, at least one of its pieces is within the same share
    of its own words; so pieces propose items, and whole items are checked.
    """

    ids: list
    words: list[list[bytes]]
    edit_share: float
    tables: int
    sampled: int

    def __post_init__(self):
        vocab = sorted({w for item in self.words for w in item})
        self.vocab = {w: k for k, w in enumerate(vocab, 1)}
        self.size = len(vocab) + 1
        self.items = [np.array([self.vocab[w] for w in item]) for item in self.words]
        self.pieces = [
            (k, low, item[low:high]) for k, item in enumerate(self.items)
            for edges in [piece_edges(len(item), PIECE_WORDS)] for low, high in zip(edges, edges[1:])
        ]
        by_length = defaultdict(list)
        for n, (_, _, piece) in enumerate(self.pieces):
            by_length[len(piece)].append(n)
        self.lengths = sorted(by_length)
        # The pairs of adjacent words of the pieces of each length, all in one sorted table.
        codes = [
            np.unique(np.concatenate([
                self.pieces[k][2][:-1] * self.size + self.pieces[k][2][1:] for k in by_length[n]
            ])) for n in self.lengths
        ]
        code = np.concatenate([np.zeros(0, np.int64), *codes])
        place = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        order = np.argsort(code, kind="stable")
        self.pairs, first = np.unique(code[order], return_index=True)
        self.pair_places = place[order]
        self.pair_edges = np.append(first, len(code))
        self.index: dict[int, list[dict[int, list[int]]]] = {}
        for length, members in by_length.items():
            keys = embed_keys(np.stack([self.pieces[k][2] for k in members]), self.tables, self.sampled)
            tables = [defaultdict(list) for _ in range(self.tables)]
            for t in range(self.tables):
                for key, k in zip(keys[t].tolist(), members):
                    tables[t][key].append(k)
            self.index[length] = [dict(t) for t in tables]

    def edits(self, length: int) -> int:
        # The share of a length may be a whole number that the float falls short of.
        return int(length * self.edit_share + 1e-9)

    def find(self, ids: list, texts: list[list[bytes]]) -> list[tuple]:
        """(doc_id, item_id, start, n_words, distance) in a group of documents."""
        gap = self.edits(max(map(len, self.items), default=0)) + 1
        flat: list = []
        starts = []
        for words in texts:
            starts.append(len(flat))
            flat += words
            flat += [None] * gap
        stream = np.fromiter(map(self.vocab.get, flat, repeat(0)), np.int64, len(flat))
        where = np.flatnonzero((stream[:-1] > 0) & (stream[1:] > 0))
        codes = stream[where] * self.size + stream[where + 1]
        at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
        hit = self.pairs[at] == codes
        where, at = where[hit], at[hit]
        # One entry for each length that has a piece with the pair, by length and position.
        sizes = self.pair_edges[at + 1] - self.pair_edges[at]
        begin = np.repeat(self.pair_edges[at] - (np.cumsum(sizes) - sizes), sizes)
        place = self.pair_places[begin + np.arange(len(begin))]
        position = np.repeat(where, sizes)
        order = np.argsort(place, kind="stable")
        edges = np.searchsorted(place[order], np.arange(len(self.lengths) + 1))
        candidates: set[tuple[int, int]] = set()
        for k, length in enumerate(self.lengths):
            own = position[order[edges[k]:edges[k + 1]]]
            candidates |= self._of_length(length, stream, own)
        return self._checked(candidates, stream, ids, np.array(starts))

    def _of_length(self, length, stream, hits) -> set[tuple[int, int]]:
        """(item, its start) proposed by the pieces of one length, around their pairs ``hits``."""
        edits = self.edits(length)
        # An edit takes at most two of the piece's pairs of adjacent words.
        need = max(1, length - 1 - 2 * edits)
        span = length - 1 + edits
        if len(hits) < need:
            return set()
        first, last = hits[: len(hits) - need + 1], hits[need - 1:]
        close = last - first < span
        low = np.maximum(last[close] - span + 1, 0)
        high = np.minimum(first[close], len(stream) - length)
        if not len(low):
            return set()
        sizes = np.maximum(high - low + 1, 0)
        begin = np.unique(np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum()))
        if not len(begin):
            return set()
        windows = stream[begin[:, None] + np.arange(length)[None, :]]
        keys = embed_keys(windows, self.tables, self.sampled)
        candidates = set()
        for table, own in zip(self.index[length], keys.tolist()):
            for pos, key in zip(begin.tolist(), own):
                for piece in table.get(key, ()):
                    item, offset, _ = self.pieces[piece]
                    candidates.add((item, pos - offset))
        return candidates

    def _checked(self, candidates, stream, ids, origin) -> list[tuple]:
        """Finds by exact edit distance around the proposed starts of items."""
        # Starts of one item within an alignment of each other are checked as one region.
        regions: list[list[int]] = []
        for item, pos in sorted(candidates):
            reach = 2 * self.edits(len(self.items[item])) + 1
            if regions and regions[-1][0] == item and pos - regions[-1][2] <= reach:
                regions[-1][2] = pos
            else:
                regions.append([item, pos, pos])
        ends = np.append(origin[1:], len(stream))
        out = []
        for item, low, high in regions:
            length = len(self.items[item])
            edits = self.edits(length)
            # A piece may lie shifted by the edits before it, and its window by those within it.
            low, high = max(0, low - 2 * edits), min(len(stream), high + length + 2 * edits)
            first = int(np.searchsorted(origin, low, side="right")) - 1
            for doc in range(first, int(np.searchsorted(origin, high, side="left"))):
                begin = max(low, int(origin[doc]))
                region = stream[begin:min(high, int(ends[doc]))]
                distance, stop = edit_distance_within(self.items[item], region)
                if distance <= edits:
                    # Read backwards from its end, the nearest stretch ends where it starts.
                    _, size = edit_distance_within(self.items[item][::-1], region[:stop][::-1])
                    out.append((
                        ids[doc], self.ids[item], begin + stop - size - int(origin[doc]), size, distance
                    ))
        return out


_FOUND_SQL = "doc_id long, item_id long, start long, n_words long, distance long"


def _search(block: ItemBlock):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            ids, texts, size = [], [], 0
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(key)
                texts.append(normal_words(text.as_buffer().to_pybytes()))
                size += len(texts[-1])
                if size >= GROUP_WORDS:
                    rows += block.find(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                rows += block.find(ids, texts)
            columns = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                names=["doc_id", "item_id", "start", "n_words", "distance"],
            )

    return search


def item_blocks(
    benchmark: DataFrame,
    block_words: int,
    edit_share: float,
    min_words: int,
    recall: float,
) -> Iterator[ItemBlock]:
    """The items in blocks of about ``block_words`` words, read one block at a time."""
    size = benchmark.agg(F.sum(F.size(F.split("text", "\\s+"))).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_words))
    dealt = benchmark.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    tables = repetitions(recall, SAMPLED, AGREEMENT)
    for k in range(blocks):
        rows = dealt.where(F.col("block") == k).select("item_id", "text").distinct().collect()
        pairs = sorted((r["item_id"], normal_words(r["text"].encode())) for r in rows)
        pairs = [(i, w) for i, w in pairs if len(w) >= min_words]
        if pairs:
            yield ItemBlock(
                [i for i, _ in pairs], [w for _, w in pairs], edit_share, tables, SAMPLED
            )


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    edit_share: float = MAX_EDIT_SHARE,
    min_item_words: int = MIN_ITEM_WORDS,
    recall: float = RECALL,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document and item found in it: (doc_id, item_id, start, n_words, distance).

    An item of m words is in a document when some stretch of it is within floor(``edit_share`` x m)
    word edits; words are compared without ASCII punctuation and with A-Z lower-cased. ``start`` and
    ``n_words`` give the nearest stretch, the first of equals.

    Every position of every text is the start of a window as long as each item. A window that
    holds enough pairs of adjacent words of the items of its length (an edit takes two at most, so
    none is lost) is embedded by the CGK walk; tables of sampled symbols propose items, enough of them for the
    target ``recall``, and the exact edit distance decides. Items of more than ``PIECE_WORDS`` words are
    proposed by even pieces of at most that length: one piece at least is within the edit share.

    Items travel to the tasks in blocks of at most about ``block_words`` words, one pass over the
    documents each, whose finds are stored before the next block is read; so the memory of driver and
    tasks is bounded whatever the size of the benchmark. Texts are not shuffled;
    only finds are.

    Defined cases: null or empty texts hold nothing. Items with fewer than ``min_item_words`` words
    or a null id are not searched. Rows that share an id are one document; finds in rows with a null
    id are reported under null. Empty tables give no rows. Other columns are ignored.
    """
    base = renamed(docs, doc_id=doc_id, text=text).select(
        F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text")
    )
    items = renamed(benchmark, item_id=item_id, text=item_text).select(
        F.col("item_id").cast("long").alias("item_id"), "text"
    ).where("item_id is not null and text is not null")
    found = base.sparkSession.createDataFrame([], _FOUND_SQL)
    for block in item_blocks(items, block_words, edit_share, min_item_words, recall):
        # Stored before the next block is read, so that one block at a time is in the driver.
        found = found.unionByName(materialize(base.mapInArrow(_search(block), _FOUND_SQL), "leaks"))
    best = F.min(F.struct("distance", "start", "n_words")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "b.start", "b.n_words", "b.distance"
    )
