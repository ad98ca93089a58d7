"""Word passages that occur more than once, found by rolling hashes and removed everywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .columns import renamed, whole

SPAN = 35
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 12 << 20
# Odd multiplier of the rolling hash, modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)

_CHUNK_SQL = "chunk long, ids array<long>, sizes array<long>, payload binary, n_bytes long"
_CHUNK = pa.schema([
    ("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
    ("payload", pa.binary()), ("n_bytes", pa.int64()),
])


def chunk_texts(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, ids, sizes, payload, n_bytes): documents in stored chunks of about ``chunk_bytes``.

    A chunk holds the compressed UTF-8 texts of consecutive rows of one scan task; a text longer
    than ``chunk_bytes`` is a chunk of its own. ``docs`` is (doc_id, text) without null texts. The
    table is written, so a chunk has the same rows whenever it is read again.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, ids, texts, size
            row = [[number], [ids], [[len(t) for t in texts]], [press.compress(b"".join(texts))],
                   [size]]
            number, ids, texts, size = number + 1, [], [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(row, _CHUNK)], schema=_CHUNK
            )

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                raw = text.as_buffer().to_pybytes()
                ids.append(key)
                texts.append(raw)
                size += len(raw)
                if size >= chunk_bytes:
                    yield flush()
        if ids:
            yield flush()

    path = scratch_path(docs.sparkSession, "chunks")
    docs.mapInArrow(gather, _CHUNK_SQL).write.option("compression", "none").parquet(path)
    return docs.sparkSession.read.schema(_CHUNK_SQL).parquet(path)


def chunk_documents(payload: bytes, sizes: list[int]) -> list[bytes]:
    """The texts of a chunk."""
    raw = zstandard.ZstdDecompressor().decompress(payload, max_output_size=max(1, sum(sizes)))
    ends = np.cumsum(sizes).tolist()
    return [raw[e - s : e] for s, e in zip(sizes, ends)]


def window_hashes(texts: list[bytes], span: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """(words per text, hashes of all windows, first word of each window in the chunk's words).

    Rabin-Karp with prefix sums: the hash of the words i..i+span-1 is the difference of two sums of
    word hash times power, brought to the same power; all windows of a chunk come from one pass.
    Windows across two texts are left out.
    """
    words = [t.split() for t in texts]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    n = int(counts.sum())
    flat = np.fromiter(
        (h for w in words for h in map(xxhash.xxh3_64_intdigest, w)), np.uint64, n
    )
    up = np.full(n, BASE, dtype=np.uint64)
    down = np.full(n, BASE_INVERSE, dtype=np.uint64)
    up[:1], down[:1] = 1, 1
    np.cumprod(up, out=up)
    np.cumprod(down, out=down)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat * down, dtype=np.uint64)])
    ends = np.cumsum(counts)
    starts = ends - counts
    per_doc = np.maximum(counts - span + 1, 0)
    first = np.repeat(starts - (np.cumsum(per_doc) - per_doc), per_doc) + np.arange(per_doc.sum())
    hashes = (sums[first + span] - sums[first]) * up[first]
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(32)
    return words, hashes, first


def _bucket_edges(sorted_hashes: np.ndarray, bits: int) -> np.ndarray:
    """Positions at which the buckets, the top ``bits`` of the hashes, begin and end."""
    cuts = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else []
    inner = np.searchsorted(sorted_hashes, np.array(cuts, dtype=np.uint64), side="left")
    return np.concatenate([[0], inner, [len(sorted_hashes)]]).astype(np.int64)


def _send(span: int, bits: int):
    """Per chunk and bucket: the chunk's distinct hashes in order, and which occur twice in it."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, sizes, payload in zip(*(b.column(k).to_pylist() for k in range(3))):
                _, hashes, _ = window_hashes(chunk_documents(payload, sizes), span)
                values, counts = np.unique(hashes, return_counts=True)
                edges = _bucket_edges(values, bits)
                full = np.flatnonzero(np.diff(edges)).tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array([chunk] * len(full), pa.int64()),
                    pa.array(full, pa.int32()),
                    pa.array([values[edges[k]:edges[k + 1]].tobytes() for k in full], pa.binary()),
                    pa.array(
                        [np.packbits(counts[edges[k]:edges[k + 1]] > 1).tobytes() for k in full],
                        pa.binary(),
                    ),
                ], names=["chunk", "bucket", "hashes", "twice"])

    return send


def _reply(key: tuple, table: pa.Table) -> pa.Table:
    """For a bucket: which of each chunk's hashes occur twice or more in all chunks together."""
    chunks = table.column("chunk").to_pylist()
    parts = [np.frombuffer(h, np.uint64) for h in table.column("hashes").to_pylist()]
    twice = [
        np.unpackbits(np.frombuffer(t, np.uint8), count=len(p)).astype(bool)
        for t, p in zip(table.column("twice").to_pylist(), parts)
    ]
    values, repeated = np.concatenate(parts), np.concatenate(twice)
    order = np.argsort(values, kind="stable")
    ranked, flags = values[order], repeated[order]
    same = np.zeros(len(ranked) + 1, dtype=bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    group = np.cumsum(~same[:-1]) - 1
    hit = same[:-1] | same[1:] | np.bincount(group, weights=flags)[group].astype(bool)
    found = np.empty(len(values), dtype=bool)
    found[order] = hit
    out, at = ([], []), 0
    for chunk, part in zip(chunks, parts):
        mask = found[at:at + len(part)]
        at += len(part)
        if mask.any():
            out[0].append(chunk)
            out[1].append(np.packbits(mask).tobytes())
    return pa.table({
        "chunk": pa.array(out[0], pa.int64()),
        "bucket": pa.array([key[0].as_py()] * len(out[0]), pa.int32()),
        "mask": pa.array(out[1], pa.binary()),
    })


_RESULT_SQL = (
    "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, "
    "kept_text string"
)
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _remove(span: int, bits: int):
    """Per chunk with its replies: the documents without the words of repeated windows."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, sizes, payload, replies in zip(*(b.column(k).to_pylist() for k in range(4))):
                words, hashes, first = window_hashes(chunk_documents(payload, sizes), span)
                counts = np.array([len(w) for w in words], dtype=np.int64)
                gone = np.zeros(int(counts.sum()), dtype=bool)
                if replies:
                    values, where = np.unique(hashes, return_inverse=True)
                    edges = _bucket_edges(values, bits)
                    repeated = np.zeros(len(values), dtype=bool)
                    for r in replies:
                        lo, hi = edges[r["bucket"]], edges[r["bucket"] + 1]
                        bytes_ = np.frombuffer(r["mask"], np.uint8)
                        repeated[lo:hi] = np.unpackbits(bytes_, count=hi - lo).astype(bool)
                    hits = first[repeated[where]]
                    change = np.zeros(len(gone) + 1, dtype=np.int64)
                    np.add.at(change, hits, 1)
                    np.add.at(change, hits + span, -1)
                    gone = np.cumsum(change[:-1]) > 0
                yield _documents(ids, words, counts, gone)

    return remove


def _documents(ids: list, words: list, counts: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    rows: tuple[list, ...] = ([], [], [], [])
    at = 0
    for text, n in zip(words, counts.tolist()):
        out = gone[at:at + n]
        at += n
        edges = np.flatnonzero(np.diff(np.concatenate([[0], out.view(np.int8), [0]]))).tolist()
        kept, last = [], 0
        for start, end in zip(edges[::2], edges[1::2]):
            kept += text[last:start]
            last = end
        kept = kept + text[last:] if last else text
        rows[0].append(n)
        rows[1].append(int(out.sum()))
        rows[2].append([{"start": s, "end": e} for s, e in zip(edges[::2], edges[1::2])])
        rows[3].append(b" ".join(kept))
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()),
        pa.array(rows[2], _SPAN), pa.array(rows[3], pa.binary()).cast(pa.string()),
    ], names=["doc_id", "n_words", "n_removed", "spans", "kept_text"])


def drop_repeated_passages(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    span: int = SPAN,
    chunk_bytes: int = CHUNK_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """One row per document: (doc_id, n_words, n_removed, spans, kept_text).

    A word goes when a window of ``span`` consecutive words around it starts anywhere else as well,
    in this or another document, judged on the input. Overlapping repeated windows form the maximal
    intervals ``spans`` (first word, word after the last); ``kept_text`` is the other words, joined
    by a blank.

    Every window is hashed (64 bits). Documents are stored in chunks; each chunk sends its distinct
    hashes to buckets of the hash space, with a bit for those it holds twice. A bucket answers with
    one bit per hash, and the chunk marks its windows. So a passage in any number of documents is
    one value per chunk, a bucket holds about ``bucket_bytes`` of text's windows however frequent
    one of them is, and texts move once, compressed. Two different windows of n share a hash with a
    probability of about n squared over 2 to the 65.

    Defined cases: a null or empty text has no words. Repeated and null ids are documents of their
    own, so a repeated row repeats all its windows. An empty table gives no rows. Other columns are
    ignored.
    """
    base = renamed(docs, doc_id=doc_id, text=text).select(
        F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text")
    )
    chunks = chunk_texts(base, chunk_bytes)
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, total / bucket_bytes)))))
    sent = chunks.select("chunk", "sizes", "payload").mapInArrow(
        _send(span, bits), "chunk long, bucket int, hashes binary, twice binary"
    )
    replies = materialize(
        sent.groupBy("bucket").applyInArrow(_reply, "chunk long, bucket int, mask binary"),
        "repeated-windows",
    )
    replies = replies.groupBy("chunk").agg(
        F.collect_list(F.struct("bucket", "mask")).alias("replies")
    )
    marked = chunks.join(replies, "chunk", "left").select("ids", "sizes", "payload", "replies")
    return marked.mapInArrow(_remove(span, bits), _RESULT_SQL)
