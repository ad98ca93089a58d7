"""Text columns shared by the operators: words, lines and ASCII lower case, as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space that separates words, as characters and as a pattern.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def whole(text: str | Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def strip_blanks(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else unchanged; the built-in ``lower`` serves pure ASCII strings."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, UPPER, UPPER.lower())
    )


def words(text: Column) -> Column:
    """Maximal runs without white space; an empty array where there are none."""
    bare = strip_blanks(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def lines(text: Column) -> Column:
    """The text split at line ends; the empty text is one empty line."""
    return F.split(text, "\n", -1)


def hash_pair(c: Column) -> list[Column]:
    """128 bits of hash as two longs, ``h1`` and ``h2``."""
    return [F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(7), c).alias("h2")]


def renamed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under new names, so that further columns cannot clash."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))
