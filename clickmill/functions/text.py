"""Strings, encoded sequences and text tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats of the encoded click log.
CLICK_LABEL = "1"
TOKEN_SEPARATOR = "-"
MISSING_TEXT = " . "
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"
PUNCTUATION = r"""[!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~']"""

# A short list of English function words; callers may pass any other list.
STOP_WORDS = (
    "a about after all also an and any are as at be because been before but by can could did do "
    "does for from had has have he her here him his how i if in into is it its just like me more "
    "most my no not now of on one only or other our out over said she should so some such than "
    "that the their them then there these they this those to too under up very was we were what "
    "when where which while who will with would you your"
).split()


def split_tokens(col: Column | str) -> Column:
    """Whitespace tokens of a string; no empty tokens, null stays null."""
    return F.filter(F.split(col, r"\s+"), lambda t: t != "")


def impression_token(token: Column) -> Column:
    """``article-label`` as a struct; the label of a malformed token is null."""
    parts = F.split(token, TOKEN_SEPARATOR)
    return F.struct(
        F.try_element_at(parts, F.lit(1)).alias("news_id"),
        F.try_element_at(parts, F.lit(2)).alias("label"),
    )


def impression_tokens(col: Column | str) -> Column:
    """Array of (news_id, label) structs of an encoded impression string."""
    return F.transform(split_tokens(col), impression_token)


def clicked_articles(col: Column | str) -> Column:
    """Article ids of the clicked tokens of an encoded impression string."""
    clicked = F.filter(impression_tokens(col), lambda t: t["label"] == CLICK_LABEL)
    return F.transform(clicked, lambda t: t["news_id"])


def words(col: Column) -> Column:
    """Lower-cased runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(col), F.lit(WORD_PATTERN), F.lit(0))


def plain_words(col: Column) -> Column:
    """Lower-case, strip ASCII punctuation, split on white space."""
    return split_tokens(F.regexp_replace(F.lower(col), PUNCTUATION, ""))


def joined_text(cols: Sequence[str], sep: str = "", missing: str = MISSING_TEXT) -> Column:
    """Text columns glued in order; a null becomes the placeholder."""
    parts = [F.coalesce(F.col(c), F.lit(missing)) for c in cols]
    glued = [parts[0]]
    for part in parts[1:]:
        glued += [F.lit(sep), part]
    return F.concat(*glued)


def parse_number_list(col: Column | str) -> Column:
    """A list literal stored as text, e.g. ``[0.5, 0.25]``, as an array of doubles."""
    return F.from_json(col, "array<double>")


def parse_name_list(col: Column | str) -> Column:
    """A list of quoted names stored as text, single or double quotes, as an array."""
    return F.from_json(F.translate(col, "'", '"'), "array<string>")
