"""Alignment of two tokenizers over the same texts: shared ends, groups, links and their counts."""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize, spread
from .columns import renamed
from .encoding import WORD_PATTERN, TokenizerFile

PIECE_STEPS = 1 << 18
SLICE_BYTES = 1 << 20
CHUNK_BYTES = 16 << 20
SIDE_BITS = 32
_KEEPER = "_kept_vocabularies"

_CHUNK = pa.schema([
    ("chunk", pa.int64()), ("pairs", pa.list_(pa.int64())), ("pair_docs", pa.list_(pa.int32())),
    ("steps", pa.binary()), ("times", pa.binary()), ("n_distinct", pa.list_(pa.int32())),
    ("doc_id", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())),
    ("n_groups", pa.list_(pa.int64())), ("n_links", pa.list_(pa.int64())),
    ("groups_sha256", pa.list_(pa.string())),
])
_CHUNK_SQL = (
    "chunk long, pairs array<long>, pair_docs array<int>, steps binary, times binary, "
    "n_distinct array<int>, doc_id array<long>, n_a array<long>, n_b array<long>, "
    "n_groups array<long>, n_links array<long>, groups_sha256 array<string>"
)
_DOC = pa.schema([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()),
    ("groups_sha256", pa.string()),
])
_DOC_SQL = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
    "groups_sha256 string"
)


# --- merge path ---------------------------------------------------------------------------------


def cut_diagonals(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of ``a`` precede each diagonal of the merge of ``a`` and ``b`` (ties: ``a`` first).

    All diagonals are searched at once, by bisection along each.
    """
    low = np.maximum(diagonals - len(b), 0)
    high = np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        safe = np.minimum(mid, len(a) - 1)
        # a[mid] comes before b[diagonal - mid - 1], so more of a belongs before the diagonal.
        early = open_ & (a[safe] <= b[np.clip(diagonals - mid - 1, 0, len(b) - 1)])
        low = np.where(early, mid + 1, low)
        high = np.where(open_ & ~early, mid, high)
    return low


def merge_piece(
    a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps and common ends of one piece of the merge, from its own steps alone.

    Each step is the end of one stretch of bytes, which lies in one token of either side: its own,
    and the first of the other side that does not end earlier. The end of a ``b`` token that an
    ``a`` token shares adds no stretch but closes a group; the ``a`` token may be the last one
    before the piece. Returns (links' a, links' b, closed groups' a, closed groups' b).
    """
    own_a = np.arange(i0, i1)
    other_b = j0 + np.searchsorted(b[j0:j1], a[i0:i1], "left")
    own_b = np.arange(j0, j1)
    other_a = i0 + np.searchsorted(a[i0:i1], b[j0:j1], "right")
    common = (other_a > 0) & (a[other_a - 1] == b[j0:j1])
    return (
        np.concatenate([own_a, other_a[~common]]), np.concatenate([other_b, own_b[~common]]),
        other_a[common] - 1, own_b[common],
    )


def overlaps(
    a: np.ndarray, b: np.ndarray, piece_steps: int = PIECE_STEPS
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All overlaps and common ends of two rising arrays of ends with the same last end.

    The merge is cut by diagonals into independent pieces of ``piece_steps`` steps, wherever texts
    begin and end; a group that a cut splits is closed by the piece that holds its common end.
    """
    steps = len(a) + len(b)
    diagonals = np.append(np.arange(0, steps, piece_steps), steps)
    i = cut_diagonals(a, b, diagonals) if steps else np.zeros(1, np.int64)
    j = diagonals - i
    pieces = [
        merge_piece(a, b, *edges)
        for edges in zip(i[:-1].tolist(), i[1:].tolist(), j[:-1].tolist(), j[1:].tolist())
    ]
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *part]) for part in zip(*pieces)) if pieces else (none,) * 4


# --- vocabularies -------------------------------------------------------------------------------


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: Latin-1 letters, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Ids of texts, each with a blank before it, and the bytes of each id."""

    def __init__(self, spec: TokenizerFile, inner: str, last: str):
        if spec.library == "sentencepiece":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=spec.path)
            self.bytes = [self._piece(model, i) for i in range(model.get_piece_size())]
            # The model puts the blank there itself.
            self._ids = lambda texts: model.encode(texts, num_threads=1)
        else:
            import os

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(spec.path)
            tok.no_truncation()
            tok.no_padding()
            tok.encode_special_tokens = True  # their strings inside texts are plain text
            letters = _byte_letters()
            special = {i: t.content for i, t in tok.get_added_tokens_decoder().items()}
            vocab = {i: bytes(letters[c] for c in t) for t, i in tok.get_vocab().items() if i not in special}
            self.bytes = [vocab.get(i, b"") for i in range(max([*vocab, *special]) + 1)]
            if spec.byte_ranks:
                import tiktoken

                ranked = tiktoken.Encoding(
                    spec.path, pat_str=WORD_PATTERN, special_tokens={},
                    mergeable_ranks={b: i for i, b in vocab.items()},
                )
                self._ids = lambda texts: [
                    ranked.encode_to_numpy(" " + t, disallowed_special=()) for t in texts
                ]
            else:
                self._ids = lambda texts: [
                    e.ids
                    for e in tok.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
                ]
        self.lens = np.array([len(b) for b in self.bytes], np.int64)
        self._starts = np.cumsum(self.lens) - self.lens
        self._flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        # An id's decimals with the mark that follows it: inside a group, or as its last one.
        self.marked = [f"{i}{m}".encode() for i in range(len(self.bytes)) for m in (inner, last)]

    @staticmethod
    def _piece(model, i: int) -> bytes:
        if model.is_byte(i):
            return bytes([int(model.id_to_piece(i)[3:-1], 16)])
        return b"" if model.is_control(i) else model.id_to_piece(i).replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(ids, np.int64) for ids in self._ids(texts)]

    def joined(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each text's tokens."""
        tokens = np.concatenate([np.zeros(0, np.int64), *ids])
        lens = self.lens[tokens]
        ends = np.cumsum(lens)
        shift = np.repeat(self._starts[tokens] - (ends - lens), lens)
        flat = self._flat[shift + np.arange(len(shift))].tobytes()
        edges = np.concatenate([[0], ends])[np.cumsum([0, *map(len, ids)])].tolist()
        return [flat[i:j] for i, j in zip(edges[:-1], edges[1:])]


def _vocabularies(a: TokenizerFile, b: TokenizerFile) -> tuple[Vocabulary, Vocabulary]:
    """The vocabularies of this worker process, kept between tasks."""
    kept = sys.modules.setdefault(_KEEPER, types.ModuleType(_KEEPER)).__dict__
    key = f"{a}|{b}"
    if key not in kept:
        kept[key] = (Vocabulary(a, ",", "|"), Vocabulary(b, ",", ";"))
    return kept[key]


# --- texts of a slice ---------------------------------------------------------------------------


@dataclass
class _Slice:
    """What the texts of a slice give: figures per text, links as (text, a id, b id), groups."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    link_text: np.ndarray
    pair: np.ndarray
    groups: list[bytes]


def _align(texts: list[str | None], va: Vocabulary, vb: Vocabulary) -> _Slice:
    size = len(texts)
    some = [k for k, t in enumerate(texts) if t]
    wanted = [texts[k] for k in some]
    ids_a, ids_b = va.encode(wanted), vb.encode(wanted)
    found = [
        k for k, (text, x, y) in enumerate(zip(wanted, va.joined(ids_a), vb.joined(ids_b)))
        if x == y and x == (" " + text).encode()
    ]
    used, ids_a, ids_b = ([part[k] for k in found] for part in (some, ids_a, ids_b))
    n_a, n_b, n_groups = (np.zeros(size, np.int64) for _ in range(3))
    n_a[used] = [len(x) for x in ids_a]
    n_b[used] = [len(y) for y in ids_b]
    a, b = (np.concatenate([np.zeros(0, np.int64), *ids]) for ids in (ids_a, ids_b))
    link_a, link_b, close_a, close_b = overlaps(np.cumsum(va.lens[a]), np.cumsum(vb.lens[b]))
    text_of_a = np.repeat(np.arange(size), n_a)
    n_groups += np.bincount(text_of_a[close_a], minlength=size)
    # A group's a ids stand before its b ids: each id moves on by the other side's ids before it.
    group_a = np.searchsorted(close_a, np.arange(len(a)), "left")
    group_b = np.searchsorted(close_b, np.arange(len(b)), "left")
    b_before = np.concatenate([[0], close_b + 1])
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[close_a] = last_b[close_b] = 1
    tokens = np.empty(len(a) + len(b), np.int64)
    tokens[np.arange(len(a)) + b_before[group_a]] = 2 * a + last_a
    tokens[np.arange(len(b)) + close_a[group_b] + 1] = 2 * (b + len(va.bytes)) + last_b
    marked = va.marked + vb.marked
    ends = np.cumsum(n_a + n_b)
    groups = []
    for k in range(size):
        part = tokens[ends[k] - n_a[k] - n_b[k] : ends[k]].tolist()
        groups.append(b"".join(map(marked.__getitem__, part))[:-1])
    return _Slice(
        n_a, n_b, n_groups, text_of_a[link_a], (a[link_a] << SIDE_BITS) | b[link_b], groups
    )


def _slices(
    batches: Iterator[pa.RecordBatch], slice_bytes: int = SLICE_BYTES
) -> Iterator[tuple[list, list]]:
    """(ids, texts) of about ``slice_bytes`` characters; a longer text is a slice of its own."""
    ids, texts, size = [], [], 0
    for b in batches:
        for k in range(0, b.num_rows, 64):
            part = b.slice(k, 64)
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if ids and size + len(t or "") > slice_bytes:
                    yield ids, texts
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t or "")
    if ids:
        yield ids, texts


class _Chunk:
    """Distinct links of the texts of some slices, with figures per text."""

    def __init__(self) -> None:
        self.size = 0
        self.docs: list[list] = [[] for _ in range(6)]
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, ids: list, texts: list, found: _Slice) -> None:
        n = len(ids)
        pairs, code = np.unique(found.pair, return_inverse=True)
        key, times = np.unique(found.link_text * len(pairs) + code, return_counts=True)
        text, code = np.divmod(key, max(len(pairs), 1))
        self.parts.append((pairs, code, times, np.bincount(text, minlength=n)))
        digests = [hashlib.sha256(g).hexdigest() if g else "" for g in found.groups]
        links = np.bincount(found.link_text, minlength=n)
        figures = (ids, found.n_a, found.n_b, found.n_groups, links, digests)
        for column, values in zip(self.docs, figures):
            column.extend(values if isinstance(values, list) else values.tolist())
        self.size += sum(len(t or "") for t in texts)

    def batch(self, number: int) -> pa.RecordBatch:
        pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *(p for p, *_ in self.parts)]))
        docs = np.zeros(len(pairs), np.int64)
        steps, times, distinct = [], [], []
        for own, code, n, per_text in self.parts:
            code = np.searchsorted(pairs, own)[code]
            docs += np.bincount(code, minlength=len(pairs))
            # Codes rise within a text, so their steps are small; they are stored compressed.
            step = np.diff(code, prepend=0)
            starts = (np.cumsum(per_text) - per_text)[per_text > 0]
            step[starts] = code[starts]
            steps.append(step)
            times.append(n)
            distinct.extend(per_text.tolist())
        values = [
            number, pairs, docs, _squeezed(steps), _squeezed(times), distinct, *self.docs
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], f.type) for v, f in zip(values, _CHUNK)], schema=_CHUNK
        )


def _squeezed(parts: list[np.ndarray]) -> bytes:
    import zstandard

    flat = np.concatenate([np.zeros(0, np.int64), *parts]).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(flat.tobytes())


def _restored(packed: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "<u4").astype(np.int64)


def _answer(key: tuple, chunk: pa.Table, replies: pa.Table) -> pa.Table:
    """Figures per text of one chunk, from the corpus counts of its pairs."""
    row = {name: chunk[name][0].values for name in chunk.column_names if pa.types.is_list(chunk[name].type)}
    at = replies["pos"].to_numpy()
    count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    count[at] = replies["count"].to_numpy()
    best[at] = replies["best"].to_numpy()
    times = _restored(chunk["times"][0].as_py())
    steps = _restored(chunk["steps"][0].as_py())
    per_text = row["n_distinct"].to_numpy()
    text = np.repeat(np.arange(len(per_text)), per_text)
    total = np.concatenate([[0], np.cumsum(steps)])
    first = (np.cumsum(per_text) - per_text)[text]
    code = total[1:] - total[first]
    sums, bests = np.zeros(len(per_text), np.int64), np.zeros(len(per_text), np.int64)
    np.add.at(sums, text, times * count[code])
    np.add.at(bests, text, times * best[code])
    columns = {**row, "n_best": pa.array(bests), "count_sum": pa.array(sums)}
    return pa.Table.from_arrays([columns[f.name] for f in _DOC], schema=_DOC)


@dataclass
class Alignment:
    """Stored chunks of aligned texts; counts over them are Spark jobs."""

    chunks: DataFrame

    def pair_counts(self) -> DataFrame:
        """(pair, a_id, b_id, count, best): documents that hold the pair linked, and whether no
        other pair of its ``a_id`` has more. Chunks send one row per pair, however many texts."""
        linked = self.chunks.select(F.explode(F.arrays_zip("pairs", "pair_docs")).alias("p"))
        counts = linked.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.pair_docs").alias("count"))
        counts = counts.withColumn("a_id", F.shiftright("pair", SIDE_BITS))
        most = F.max("count").over(Window.partitionBy("a_id"))
        return counts.select(
            "pair", "a_id", F.col("pair").bitwiseAND((1 << SIDE_BITS) - 1).alias("b_id"), "count",
            (F.col("count") == most).alias("best"),
        )

    def documents(self) -> DataFrame:
        """Figures per document: each chunk gets the counts of its own pairs, and adds them up."""
        asked = self.chunks.select(
            F.col("chunk").alias("asked_by"), F.posexplode("pairs").alias("pos", "pair")
        )
        replies = asked.join(self.pair_counts(), "pair").select("asked_by", "pos", "count", "best")
        return self.chunks.drop("pairs", "pair_docs").groupBy("chunk").cogroup(
            replies.groupBy("asked_by")
        ).applyInArrow(_answer, _DOC_SQL)


def align_tokenizers(
    docs: DataFrame,
    a: TokenizerFile,
    b: TokenizerFile,
    doc_id: str = "doc_id",
    text: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
) -> Alignment:
    """Aligns the tokens of ``a`` (given a blank and the text) and ``b`` (which adds the blank).

    Each text is encoded once and its token ends are merged in the task that read it. Per chunk of
    about ``chunk_bytes`` the distinct linked pairs, the texts' shares in them and the texts'
    figures are stored in the shared folder. Corpus counts then travel by chunk and pair, never by
    document, so the most frequent pair is one row per chunk. A task holds a slice of about a
    million characters in tokens and one chunk's distinct pairs.

    Defined cases: null and empty texts, and texts that a tokenizer does not give back byte for byte,
    have no tokens: zeros and an empty digest. Repeated rows and ids, null ids too, are documents of
    their own. An empty table gives no rows. Other columns are ignored.
    """
    base = spread(renamed(docs, doc_id=doc_id, text=text)).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb = _vocabularies(a, b)
        number = TaskContext.get().partitionId() << 32
        chunk = _Chunk()
        for ids, texts in _slices(batches):
            chunk.add(ids, texts, _align(texts, va, vb))
            if chunk.size >= chunk_bytes:
                yield chunk.batch(number)
                number += 1
                chunk = _Chunk()
        if chunk.parts:
            yield chunk.batch(number)

    return Alignment(materialize(base.mapInArrow(run, _CHUNK_SQL), "aligned"))


def token_groups(
    docs: DataFrame, a: TokenizerFile, b: TokenizerFile, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, groups): the groups as ``a1,a2|b1;a3|b2,b3`` in ids; empty without tokens."""
    base = spread(renamed(docs, doc_id=doc_id, text=text)).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb = _vocabularies(a, b)
        for ids, texts in _slices(batches):
            groups = [g.decode() for g in _align(texts, va, vb).groups]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(groups, pa.string())], ["doc_id", "groups"]
            )

    return base.mapInArrow(run, "doc_id long, groups string")
