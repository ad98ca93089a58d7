"""Packing of token sequences into fixed windows with a bounded number of open ones."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .columns import renamed, whole
from .encoding import TokenizerFile, encoder

WINDOW = 2048
OPEN_WINDOWS = 32
MIN_CUT = 16
MERGE_PARTITIONS = 64
END_ID = 1
ROWS_PER_BATCH = 2048
TEXTS_PER_SLICE = 1024

_PIECE = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ("open_in", pa.int64()),
])
_PIECE_SQL = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, "
    "offset long, open_in long"
)


class _Packer:
    """Open windows of one partition, kept by free room, and the rows of closed ones."""

    def __init__(self, window: int, open_windows: int, min_cut: int, first_sequence: int):
        self.window, self.open_windows, self.min_cut = window, open_windows, min_cut
        self.next_sequence = first_sequence
        self.room: list[tuple[int, int]] = []  # (free room, sequence)
        self.held: dict[int, list] = {}
        self.rows: list[tuple] = []

    def _open(self) -> int:
        sequence = self.next_sequence
        self.next_sequence += 1
        return sequence

    def _close(self, sequence: int) -> None:
        self.rows.extend(self.held.pop(sequence))

    def _put(self, sequence: int, free: int, piece: tuple) -> None:
        doc_id, start, ids, total = piece
        row = (doc_id, start, len(ids), ids.tobytes(), total, sequence, self.window - free, None)
        self.held.setdefault(sequence, []).append(row)
        free -= len(ids)
        if free:
            insort(self.room, (free, sequence))
        else:
            self._close(sequence)

    def add(self, doc_id, ids: np.ndarray) -> None:
        """Whole windows go out at once; the rest is placed where it fits best."""
        total, start = len(ids), 0
        while total - start >= self.window:
            self._put(self._open(), self.window, (doc_id, start, ids[start:start + self.window], total))
            start += self.window
        while start < total:
            rest = ids[start:]
            best = bisect_left(self.room, (len(rest), -1))
            if best < len(self.room):
                free, sequence = self.room.pop(best)
                self._put(sequence, free, (doc_id, start, rest, total))
                return
            if len(self.room) < self.open_windows:
                self._put(self._open(), self.window, (doc_id, start, rest, total))
                return
            # None fits: the fullest goes out, filled with a cut unless its gap is tiny.
            free, sequence = self.room.pop(0)
            if free >= self.min_cut:
                self._put(sequence, free, (doc_id, start, ids[start:start + free], total))
                start += free
            else:
                self._close(sequence)

    def finish(self) -> None:
        """Windows still open are leftovers, marked by their own number."""
        for _, sequence in self.room:
            self.rows.extend((*r[:7], sequence) for r in self.held.pop(sequence))
        self.room = []

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [()] * len(_PIECE)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, _PIECE)]
        self.rows = []
        return pa.RecordBatch.from_arrays(arrays, schema=_PIECE)


def _merge_leftovers(window: int):
    """Group function: the leftovers of some partitions, end to end, cut into whole windows.

    What remains after the last whole window goes into sequences of a power of two, which need no
    padding.
    """

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        rows = sorted(
            table.to_pylist(), key=lambda r: (r["open_in"], r["offset"])
        )
        left = sum(r["length"] for r in rows)
        sequence = (1 << 62) + (group << 32)
        size, at, out = 0, 0, []
        for r in rows:
            ids, start = np.frombuffer(r["ids"], "<u4"), r["start"]
            while len(ids):
                if at == size:
                    sequence += 1
                    size = window if left >= window else 1 << (left.bit_length() - 1)
                    left -= size
                    at = 0
                part, ids = ids[: size - at], ids[size - at:]
                out.append((
                    r["doc_id"], start, len(part), part.tobytes(), r["doc_tokens"], sequence, at,
                    None,
                ))
                at += len(part)
                start += len(part)
        columns = zip(*out) if out else [()] * len(_PIECE)
        return pa.Table.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, _PIECE)], schema=_PIECE
        )

    return merge


def pack_documents(
    docs: DataFrame,
    spec: TokenizerFile,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    min_cut: int = MIN_CUT,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    Each partition keeps at most ``open_windows`` windows open. A document's whole windows go out
    at once and the rest goes to the open window with the least room that holds it. When none does,
    the fullest is emitted: a gap of at least ``min_cut`` ids is filled by cutting the document, a
    smaller one is left to padding. The windows open at a partition's end are merged over groups of
    64 partitions: laid end to end and cut anew, the last of it in powers of two.

    ``ids`` are little-endian 32-bit ids; a document ends with ``end_id``. A task holds its open
    windows and one batch of texts; a merge holds at most 64 x ``open_windows`` windows. The placed
    pieces are stored in the shared folder before the merge, so a lost executor cannot leave a
    sequence half from one attempt and half from another.

    Defined cases: a null or empty text is the end id alone. Repeated and null ids are documents of
    their own. An empty table gives no rows. Other columns are ignored.
    """
    base = renamed(docs, doc_id=doc_id, text=text).select(
        F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec)
        packer = _Packer(window, open_windows, min_cut, TaskContext.get().partitionId() << 32)
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1)
            for k in range(0, len(keys), TEXTS_PER_SLICE):
                part = enc.ids(texts.slice(k, TEXTS_PER_SLICE).to_pylist(), end_id)
                for key, ids in zip(keys[k:k + TEXTS_PER_SLICE], part):
                    packer.add(key, ids.astype("<u4", copy=False))
                if len(packer.rows) >= ROWS_PER_BATCH:
                    yield packer.batch()
        packer.finish()
        yield packer.batch()

    path = scratch_path(base.sparkSession, "packed")
    placed = base.mapInArrow(place, _PIECE_SQL)
    placed.write.option("compression", "zstd").parquet(path)
    placed = base.sparkSession.read.schema(_PIECE_SQL).parquet(path)
    group = F.floor(F.shiftright("open_in", 32) / MERGE_PARTITIONS).cast("long")
    merged = (
        placed.where("open_in is not null").withColumn("grp", group)
        .groupBy("grp").applyInArrow(_merge_leftovers(window), _PIECE_SQL)
    )
    return placed.where("open_in is null").unionByName(merged).drop("open_in")
