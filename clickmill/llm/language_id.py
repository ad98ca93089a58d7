"""Language identification by compression: the dictionary that shortens a text most names it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import distinct_values, spread
from .columns import renamed

UNDETERMINED = "und"
DICTIONARY_BYTES = 64 << 10
SAMPLE_TEXTS = 256
SHARES = 64
MAX_LANGUAGES = 256
PIECE_BYTES = 4096
LEVEL = 6
MIN_MARGIN = 0.02
HELD_OUT_FOLDS = 5
TEXTS_PER_SLICE = 256

_LABELS = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()),
    ("score", pa.float64()), ("margin", pa.float64()), ("accepted", pa.bool_()),
])
_LABELS_SQL = (
    "doc_id long, held_out boolean, lang_pred string, score double, margin double, accepted boolean"
)
# ASCII other than letters becomes a blank, letters are lower-cased before.
_LETTERS_ONLY = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def letters(text: str) -> bytes:
    """The text in lower case with one blank for each run of ASCII characters that are no letters."""
    lowered = text.lower().encode("utf-8", "surrogatepass")
    return b" ".join(lowered.translate(_LETTERS_ONLY).split())


def held_out(doc_id: str, folds: int = HELD_OUT_FOLDS) -> Column:
    """Whether the id's CRC-32 is divisible by ``folds``; a null id counts as the empty string."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % folds == 0


def learn_dictionaries(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    dictionary_bytes: int = DICTIONARY_BYTES,
    sample_texts: int = SAMPLE_TEXTS,
    max_languages: int = MAX_LANGUAGES,
) -> dict[str, bytes]:
    """Raw-content dictionaries by language, at most ``dictionary_bytes`` each.

    The classifier is fitted on a bounded sample: the ``sample_texts`` distinct texts of a language
    with the smallest hash, of which each gives an even share of the dictionary, cut out at a place
    that the hash chooses. The driver so gets at most ``max_languages`` x ``dictionary_bytes`` x 4
    bytes, whatever the size of the table; more languages raise an error.

    Defined cases: rows with a null label and texts without a letter teach nothing; repeated rows
    count once; an empty table gives no dictionary.
    """
    rows = renamed(labelled, text=text, lang=lang).where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    distinct_values(rows, "lang", max_languages)
    hashed = rows.select("lang", "text", F.xxhash64("text").alias("h"))
    # First within shares: however many tasks send their smallest hashes, no task ranks them all.
    drawn = hashed.select("lang", "h").distinct().withColumn("part", F.pmod("h", F.lit(SHARES)))
    for group in (["lang", "part"], ["lang"]):
        order = Window.partitionBy(*group).orderBy("h")
        drawn = drawn.withColumn("rank", F.row_number().over(order)).where(
            F.col("rank") <= sample_texts)
    drawn = drawn.drop("part")
    share = F.ceil(dictionary_bytes / F.max("rank").over(Window.partitionBy("lang"))).cast("int")
    drawn = drawn.withColumn("share", share)
    room = F.greatest(F.char_length("text") - F.col("share"), F.lit(0))
    excerpt = F.substring(F.col("text"), (F.pmod("h", room + 1) + 1).cast("int"), F.col("share"))
    # Copies of a drawn text shrink to one excerpt before they are shuffled.
    found = (
        hashed.join(F.broadcast(drawn), ["lang", "h"])
        .groupBy("lang", "h").agg(F.min(excerpt).alias("excerpt")).collect()
    )
    parts: dict[str, list[bytes]] = {}
    for row in sorted(found, key=lambda r: (r["lang"], r["h"])):
        parts.setdefault(row["lang"], []).append(letters(row["excerpt"]))
    return {k: b" ".join(v)[:dictionary_bytes] for k, v in parts.items()}


def classify(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    doc_id: str = "doc_id",
    text: str = "text",
    piece_bytes: int = PIECE_BYTES,
    level: int = LEVEL,
    min_margin: float = MIN_MARGIN,
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, margin, accepted) per row.

    A text is cut into pieces of ``piece_bytes``, each is compressed against every dictionary, and
    the language with the smallest sum is predicted (ties: the first in order). ``margin`` is the
    share by which the second smallest sum is longer, ``accepted`` is false where it is under
    ``min_margin``, and ``score`` is margin / (margin + min_margin), so 0.5 at that limit.

    Defined cases: a null text, a text without a letter, and every text where no language was
    learned is ``und`` with score 0; with a single language the margin is 1. Each row is judged on
    its own, so nulls and repeats in the id change nothing. Long texts take memory for one piece.
    """
    base = spread(renamed(docs, doc_id=doc_id, text=text)).select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), "text"
    )
    names = sorted(dictionaries)

    def compressors() -> list:
        import zstandard

        out = []
        for name in names:
            content = zstandard.ZstdCompressionDict(
                dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT
            )
            content.precompute_compress(level=level)
            out.append(zstandard.ZstdCompressor(
                level=level, dict_data=content, write_content_size=False, write_checksum=False,
                write_dict_id=False,
            ).compress)
        return out

    def judge(text: str | None, compress: list) -> tuple[str, float, float, bool]:
        if not names or text is None or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, 0.0, False
        body = letters(text)
        pieces = [body[k : k + piece_bytes] for k in range(0, len(body), piece_bytes)]
        sizes = sorted((sum(len(c(p)) for p in pieces), name) for c, name in zip(compress, names))
        margin = 1.0 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0
        return sizes[0][1], margin / (margin + min_margin), margin, margin >= min_margin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = compressors()
        for b in batches:
            for k in range(0, b.num_rows, TEXTS_PER_SLICE):
                part = b.slice(k, TEXTS_PER_SLICE)
                judged = [judge(t, compress) for t in part.column(2).to_pylist()]
                columns = [pa.array(c, f.type) for c, f in zip(zip(*judged), list(_LABELS)[2:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *columns], schema=_LABELS
                )

    return base.mapInArrow(run, _LABELS_SQL)


def identify_languages(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """Predictions for all rows, learned from the labelled rows whose id is not held out.

    Label, source and id never enter a prediction. See ``learn_dictionaries`` and ``classify`` for
    what nulls, empty texts, repeated rows and empty tables give; other columns are ignored.
    """
    rows = renamed(docs, doc_id=doc_id, text=text, lang=lang)
    dictionaries = learn_dictionaries(rows.where(~held_out("doc_id")))
    return classify(rows, dictionaries)
