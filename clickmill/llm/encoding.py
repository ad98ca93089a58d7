"""Token ids of texts from public tokenizer files, inside tasks."""

from __future__ import annotations

import hashlib
import sys
import types
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 4 << 20
REMEMBERED_WORDS = 800_000
JOINED_WORDS = 200
_KEEPER = "_kept_encoders"
# Fixed value: how byte-level vocabularies cut words.
WORD_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


@dataclass(frozen=True)
class TokenizerFile:
    """A vocabulary file: ``library`` is "tokenizers" or "sentencepiece".

    ``blank_free`` states that the tokenizer only ends words at white space and gives it no ids, so
    that a text's ids are those of its words in order; the encoder then remembers words.
    ``byte_ranks`` states that a byte-level vocabulary has its ids in the order of its merges, each
    merge being the last one that its token goes through, and cuts words by ``WORD_PATTERN``; then
    pairs may be merged by the id they give, which a faster library does.
    """

    path: str
    library: str = "tokenizers"
    blank_free: bool = False
    byte_ranks: bool = False

    def version(self) -> str:
        """Digest of the file's bytes."""
        with open(self.path, "rb") as f:
            return hashlib.sha256(f.read()).hexdigest()


def encoder(spec: TokenizerFile):
    """The encoder of this worker process.

    It is kept between tasks in a module of its own, since the functions of this package travel with
    each task and bring their own globals.
    """
    kept = sys.modules.setdefault(_KEEPER, types.ModuleType(_KEEPER)).__dict__
    key = f"{spec.library}:{spec.blank_free}:{spec.path}"
    if key not in kept:
        kept[key] = WordEncoder(spec) if spec.blank_free else WholeEncoder(spec)
    return kept[key]


class WholeEncoder:
    """Ids of whole texts, straight from the library."""

    def __init__(self, spec: TokenizerFile):
        if spec.library == "sentencepiece":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=spec.path)
            self._ids = lambda texts: model.encode(texts, num_threads=1)
        else:
            tok = _load(spec.path)
            self._ids = lambda texts: [
                e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)
            ]

    def ids(self, texts: list[str], end_id: int | None = None) -> list[np.ndarray]:
        """The ids of each text, with ``end_id`` behind them if there is one."""
        end = [] if end_id is None else [end_id]
        return [np.array([*i, *end], dtype=np.uint32) for i in self._ids(texts)]

    def counts(self, texts: list[str]) -> list[int]:
        return [len(i) for i in self._ids(texts)]


def _load(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


class WordEncoder:
    """Ids of texts put together from the ids of their words, each encoded by the library once.

    Words are cut at ASCII white space only and passed on unchanged. A bounded number of them is
    remembered; when there are too many, those that few batches used are forgotten. A word of
    letters, perhaps with one full stop or comma at its end, is encoded together with others, since
    its letters are one unit of the tokenizer.
    """

    def __init__(self, spec: TokenizerFile):
        self._tok = _load(spec.path)
        vocab = self._tok.get_vocab()
        self._is_end = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self._is_end[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._marks = {m: self._encode([m])[0] for m in ".,"}
        self._memo: dict[str, int] = {}
        self._cores: dict[str, int] = {}
        # Entry n has the ids flat[starts[n] : starts[n] + lens[n]].
        self._flat = np.zeros(1 << 16, dtype=np.uint32)
        self._starts, self._lens = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self._uses = np.zeros(1 << 14, np.int32)
        self._used = self._n = 0

    def _encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tok.encode_batch_fast(words, add_special_tokens=False)]

    def _store(self, flat: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Numbers of new entries, whose ids lie end to end in ``flat``."""
        n, used = self._n + len(lens), self._used + len(flat)
        while used > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        while n > len(self._starts):
            for name in ("_starts", "_lens", "_uses"):
                column = getattr(self, name)
                setattr(self, name, np.concatenate([column, np.zeros_like(column)]))
        self._flat[self._used : used] = flat
        self._starts[self._n : n] = self._used + np.cumsum(lens) - lens
        self._lens[self._n : n] = lens
        self._uses[self._n : n] = 0
        numbers = np.arange(self._n, n)
        self._used, self._n = used, n
        return numbers

    def _gather(self, entries: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The ids of the entries, end to end."""
        ends = np.cumsum(lens)
        shift = np.repeat(self._starts[entries] - (ends - lens), lens)
        return self._flat[shift + np.arange(len(shift))]

    def _store_lists(self, ids: list[list[int]]) -> np.ndarray:
        return self._store(
            np.array([i for part in ids for i in part], np.uint32),
            np.array([len(part) for part in ids], np.int64),
        )

    def _forget(self) -> None:
        """Keep the words that most batches used, half of the limit at most."""
        entries = np.fromiter(self._memo.values(), np.int64, len(self._memo))
        least = 2
        while (self._uses[entries] >= least).sum() > REMEMBERED_WORDS // 2:
            least *= 2
        kept = [w for w, n in self._memo.items() if self._uses[n] >= least]
        entries = np.array([self._memo[w] for w in kept], np.int64)
        lens = self._lens[entries]
        flat = self._gather(entries, lens)
        self._used = self._n = 0
        self._cores = {}
        self._memo = dict(zip(kept, self._store(flat, lens).tolist()))

    def _learn(self, missing: list[str]) -> None:
        marked: list[tuple[str, str, str]] = []
        odd: list[str] = []
        fresh: dict[str, None] = {}
        for word in missing:
            mark = word[-1:] if word[-1:] in self._marks else ""
            core = word[:-1] if mark else word
            # Some letters are no longer letters alone once they are lower-cased.
            if core.isalpha() and (core.isascii() or core.lower().isalpha()):
                core = core.lower() if core.isascii() else core
                marked.append((word, core, mark))
                if core not in self._cores:
                    fresh[core] = None
            else:
                odd.append(word)
        cores = list(fresh)
        groups = [cores[k : k + JOINED_WORDS] for k in range(0, len(cores), JOINED_WORDS)]
        for group, ids in zip(groups, self._encode([" ".join(g) for g in groups])):
            array = np.array(ids, dtype=np.uint32)
            ends = np.flatnonzero(self._is_end[array]) + 1
            if len(ends) == len(group):
                numbers = self._store(array, np.diff(ends, prepend=0))
            else:  # some word is not one unit for the tokenizer
                numbers = self._store_lists(self._encode(group))
            self._cores.update(zip(group, numbers.tolist()))
        self._memo.update((w, self._cores[c]) for w, c, mark in marked if not mark)
        for mark, mark_ids in self._marks.items():
            ending = [(w, self._cores[c]) for w, c, m in marked if m == mark]
            if ending:
                entries = np.array([n for _, n in ending])
                lens = self._lens[entries]
                flat = self._gather(entries, lens)
                numbers = self._store(
                    np.insert(flat, np.repeat(np.cumsum(lens), len(mark_ids)), mark_ids * len(ending)),
                    lens + len(mark_ids),
                )
                self._memo.update(zip((w for w, _ in ending), numbers.tolist()))
        if odd:
            self._memo.update(zip(odd, self._store_lists(self._encode(odd)).tolist()))

    def _entries(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Entries of all words of the texts in order, and the bounds of each text among them."""
        if len(self._memo) > REMEMBERED_WORDS:
            self._forget()
        words = pc.ascii_split_whitespace(texts)
        bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self._memo.get, distinct, repeat(-1)), np.int64, len(distinct))
        gaps = np.flatnonzero(at < 0).tolist()
        if gaps:
            self._learn([distinct[i] for i in gaps])
            at[gaps] = [self._memo[distinct[i]] for i in gaps]
        self._uses[at] += 1
        return at[coded.indices.to_numpy()], bounds

    def _batches(self, texts: list[str]):
        """(number, piece, whether it is the last of its text) in batches of bounded size."""
        batch, size = [], 0
        for n, text in enumerate(texts):
            pieces = _pieces(text)
            for k, piece in enumerate(pieces, 1):
                batch.append((n, piece, k == len(pieces)))
                size += len(piece)
                if size >= PIECE_BYTES:
                    yield batch
                    batch, size = [], 0
        if batch:
            yield batch

    def _figures(self, batch: list[tuple[int, str, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries, their lengths, and the ids before each bound of the batch's pieces."""
        entries, bounds = self._entries(pa.array([p for _, p, _ in batch], pa.string()))
        lens = self._lens[entries]
        return entries, lens, np.concatenate([[0], np.cumsum(lens)])[bounds]

    def ids(self, texts: list[str], end_id: int | None = None) -> list[np.ndarray]:
        """The ids of each text, with ``end_id`` behind them if there is one."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        end = [] if end_id is None else [end_id]
        for batch in self._batches(texts):
            entries, lens, edges = self._figures(batch)
            flat = self._gather(entries, lens)
            if end:
                last = [is_last for *_, is_last in batch]
                flat = np.insert(flat, edges[1:][last], end * sum(last))
                edges = edges + np.concatenate([[0], np.cumsum(last)])
            for (n, *_), start, stop in zip(batch, edges[:-1].tolist(), edges[1:].tolist()):
                parts[n].append(flat[start:stop])
        return [p[0] if len(p) == 1 else np.concatenate(p) for p in parts]

    def counts(self, texts: list[str]) -> list[int]:
        total = [0] * len(texts)
        for batch in self._batches(texts):
            _, _, edges = self._figures(batch)
            for (n, *_), size in zip(batch, np.diff(edges).tolist()):
                total[n] += size
        return total


def _pieces(text: str) -> list[str]:
    """The text cut at white space into pieces of about ``PIECE_BYTES`` characters."""
    if len(text) <= PIECE_BYTES:
        return [text]
    out, start = [], 0
    while len(text) - start > PIECE_BYTES:
        end = start + PIECE_BYTES
        while end < len(text) and text[end] not in " \t\n\x0b\f\r":
            end += 1
        out.append(text[start:end])
        start = end
    return [*out, text[start:]]
