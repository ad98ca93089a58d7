"""Next-item examples with a short look-back."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import padded
from .ranking import group_row_number

# Length of the context, fewest rated items of a user, lowest rating that counts, and
# the filler of each context column.
CONTEXT_LENGTH, MIN_TIMELINE, MIN_RATING = 10, 3, 2.0
CONTEXT_DEFAULTS = {"movie_id": "0", "user_rating": 0.0, "movie_year": 1980, "movie_genre": "Drama"}
CHUNK_ROWS = 100_000


def next_item_examples(
    ratings: DataFrame,
    user: str,
    order_by: list[str],
    item: str,
    context: Mapping[str, Column],
    length: int = CONTEXT_LENGTH,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """For every item but a user's first: up to ``length`` items before it, and the item as label.

    ``context`` maps each context column to its filler. A long timeline is cut into chunks of
    positions, each preceded by the last ``length`` rows of the one before, so that one user's rows
    need not fit one task.
    """
    placed = group_row_number(ratings, [user], order_by, "_pos", size="_n")
    placed = placed.where(F.col("_n") >= MIN_TIMELINE)
    chunk = F.floor((F.col("_pos") - 1) / chunk_rows)
    leads_in = (F.col("_pos") - 1) % chunk_rows >= chunk_rows - length
    homes = F.when(leads_in, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    spread = placed.withColumn("_home", chunk).withColumn("_chunk", F.explode(homes))
    window = Window.partitionBy(user, "_chunk").orderBy("_pos").rowsBetween(-length, -1)
    looked_back = spread.withColumns(
        {f"_c_{c}": F.collect_list(F.col(c)).over(window) for c in context}
    )
    examples = looked_back.where((F.col("_home") == F.col("_chunk")) & (F.col("_pos") > 1))
    return examples.select(
        user,
        F.col("_pos").alias("position"),
        *[padded(F.col(f"_c_{c}"), length, fill).alias(f"context_{c}") for c, fill in context.items()],
        F.col(item).alias(f"label_{item}"),
    )


def with_defaults(df: DataFrame, context: Mapping[str, Column], length: int = CONTEXT_LENGTH) -> DataFrame:
    """Stored sequence columns cut or filled to a fixed length; missing ones become all filler."""
    return df.withColumns({c: padded(F.col(c), length, fill) for c, fill in context.items()})
