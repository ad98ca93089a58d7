"""Small tables and plain-Python twins for the operator tests."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

BLANKS = " \t\n\x0b\f\r"
# Names that operators use inside; an input may carry them as further columns.
CLASHES = (
    "h1", "h2", "pos", "key", "node", "root", "chunk", "bucket", "tokens", "block", "digest", "n_words",
    "kept", "block_id", "grp", "ids", "u", "r", "owner", "count", "w",
)


def lower_ascii(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def split_words(text: str | None) -> list[str]:
    return [w.decode() for w in (text or "").encode().split()]


def documents(spark: SparkSession, rows: list[tuple], clashes: bool = True) -> DataFrame:
    """(doc_id, text, lang, source, n_chars) with further columns whose names operators use."""
    data = [
        (i, t, None, s, None if t is None else len(t), *([7] * len(CLASHES) if clashes else []))
        for i, t, s in rows
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    if clashes:
        schema += "".join(f", `{c}` int" for c in CLASHES)
    return spark.createDataFrame(data, schema)


def prose(seed: int, n: int) -> str:
    """Words of two syllables, a line end now and then."""
    rng = random.Random(seed)
    parts = "ka lo mi nu re sa ti vo xe zu be da".split()
    out = []
    for _ in range(n):
        out.append(rng.choice(parts) + rng.choice(parts) + rng.choice(parts))
    return "".join(w + ("\n" if rng.random() < 0.08 else " ") for w in out).strip()


def edge_rows() -> list[tuple]:
    """Nulls, blanks, a very long text, ties, repeated rows and ids."""
    base = prose(1, 120)
    return [
        (1, base, "a"), (2, None, "a"), (None, prose(2, 60), "b"), (3, "", None), (4, " \t\n ", "b"),
        (5, prose(3, 30_000), "b"), (6, base, "a"), (7, base, None), (7, base, None),
        (8, base.replace("ka", "KA", 1), "a"), (9, "x", "a"), (10, "Ünïcode Ä\nÜnïcode Ä\n\n", "c"),
        (None, None, None), (11, prose(4, 90) + " <|endoftext|> a..b ,. don't 'S", "c"),
    ]
