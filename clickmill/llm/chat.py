"""Multi-party dialogues rendered from the perspective of each participant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .columns import renamed, whole

BLOCK_TURNS = 1024


def _header(is_self: Column, speaker: Column) -> Column:
    named = F.concat(F.lit("<|user name="), speaker, F.lit("|>\n"))
    return F.when(is_self, F.lit("<|assistant|>\n")).otherwise(named)


def rotate_perspectives(
    turns: DataFrame,
    conversation: str = "conv_id",
    order: str = "turn",
    speaker: str = "role",
    text: str = "text",
    narrator: str | None = "system",
) -> DataFrame:
    """One row per conversation, participant and turn: that participant's rendering of the turn.

    Returns (conv_id, assistant, position, speaker, role, segment, start, mask_start, mask_end).
    In the rendering of ``assistant``, its own turns get the assistant header and all others are
    users named in their headers; ``narrator`` turns get a system header in every rendering and the
    narrator is no participant. The segments of (conv_id, assistant), concatenated by ``position``,
    are the rendered dialogue. ``start`` is the segment's first character in it; the characters
    from ``mask_start`` up to ``mask_end`` (the text and the closing mark of own turns) are to be
    learned, an empty range elsewhere.

    The segments stay in rows, so that no task holds a whole dialogue. Positions and offsets come
    from sums per block of turn numbers, carried from block to block, so one conversation of any
    length spreads over many tasks.

    Defined cases: a null text is an empty one. A null speaker is the participant "unknown". Rows
    with a null conversation form one conversation. Turns with equal or null numbers are ordered by
    speaker and text (nulls first); repeated rows stay repeated turns. A dialogue of the narrator
    alone has no participant and no rows. An empty table gives no rows. Other columns are ignored.
    """
    rows = renamed(turns, conv_id=conversation, turn=order, speaker=speaker, body=text).select(
        "conv_id", "turn", F.coalesce("speaker", F.lit("unknown")).alias("speaker"),
        whole("body").alias("body"),
    )
    rows = rows.withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(0)) / BLOCK_TURNS))
    narrates = F.col("speaker").eqNullSafe(narrator)
    # Lengths of the two possible segments: as one of the others, and as the assistant.
    tail = F.lit("<|end|>\n")
    as_system = F.concat(F.lit("<|system|>\n"), F.col("body"), tail)
    other = F.when(narrates, as_system).otherwise(
        F.concat(_header(F.lit(False), F.col("speaker")), F.col("body"), tail)
    )
    own = F.concat(_header(F.lit(True), F.col("speaker")), F.col("body"), tail)
    rows = rows.withColumns({
        "other_len": F.char_length(other).cast("long"),
        "gain": F.when(narrates, F.lit(0)).otherwise(
            F.char_length(own) - F.char_length(other)
        ).cast("long"),
    })
    rows = materialize(rows, "turns")
    within = (
        Window.partitionBy("conv_id", "block")
        .orderBy("turn", "speaker", "body")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = rows.withColumns({
        "pos_in": F.count(F.lit(1)).over(within),
        "len_in": F.coalesce(F.sum("other_len").over(within), F.lit(0)),
    })
    earlier = (
        Window.partitionBy("conv_id").orderBy("block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    blocks = rows.groupBy("conv_id", "block").agg(
        F.count(F.lit(1)).alias("n"), F.sum("other_len").alias("chars")
    ).select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("pos_before"),
        F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("len_before"),
    )
    placed = placed.join(
        blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))
    ).select(
        "conv_id", "block", "turn", "speaker", "body", "gain",
        (F.col("pos_in") + F.col("pos_before")).alias("position"),
        (F.col("len_in") + F.col("len_before")).alias("plain_start"),
    )
    # What the assistant's own turns add to or take from the plain lengths, up to each turn.
    cast = rows.where(~narrates).groupBy("conv_id", "speaker").agg(F.lit(1).alias("_one")).select(
        F.col("conv_id").alias("c"), F.col("speaker").alias("assistant")
    )
    seen = placed.join(cast, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    is_own = F.col("speaker") == F.col("assistant")
    mine = F.when(is_own, F.col("gain")).otherwise(F.lit(0))
    own_within = (
        Window.partitionBy("conv_id", "assistant", "block").orderBy("position")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    own_blocks = (
        rows.where(~narrates).groupBy("conv_id", "speaker", "block").agg(F.sum("gain").alias("g"))
    )
    # A block in which the assistant is silent still needs the carry, so blocks meet all the cast.
    every_block = blocks.join(
        cast.withColumnRenamed("c", "cc"), F.col("c").eqNullSafe(F.col("cc"))
    ).select(F.col("c"), F.col("b"), "assistant")
    carried = every_block.join(
        own_blocks,
        F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("b") == F.col("block"))
        & (F.col("assistant") == F.col("speaker")),
        "left",
    ).select(
        "c", "b", F.col("assistant").alias("a"),
        F.coalesce(
            F.sum("g").over(
                Window.partitionBy("c", "assistant").orderBy("b")
                .rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("gain_before"),
    )
    full = seen.withColumn(
        "gain_in", F.coalesce(F.sum(mine).over(own_within), F.lit(0))
    ).join(
        carried,
        F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))
        & (F.col("assistant") == F.col("a")),
    )
    segment = F.when(is_own, own).otherwise(other)
    start = F.col("plain_start") + F.col("gain_in") + F.col("gain_before")
    header_len = F.char_length("segment") - F.char_length("body") - 8
    return full.select(
        "conv_id", "assistant", "position", "speaker",
        F.when(is_own, "assistant").when(narrates, "system").otherwise("user").alias("role"),
        segment.alias("segment"), start.alias("start"), "body", is_own.alias("own"),
    ).select(
        "conv_id", "assistant", "position", "speaker", "role", "segment", "start",
        F.when(F.col("own"), F.col("start") + header_len).otherwise(F.col("start"))
        .alias("mask_start"),
        F.when(F.col("own"), F.col("start") + F.char_length("segment"))
        .otherwise(F.col("start")).alias("mask_end"),
    )


def assemble(segments: DataFrame) -> DataFrame:
    """(conv_id, assistant, rendered, masks): dialogues as single strings, for dialogues that fit a
    row; ``masks`` are the non-empty (start, end) ranges in order."""
    parts = F.array_sort(F.collect_list(F.struct("position", "segment", "mask_start", "mask_end")))
    return segments.groupBy("conv_id", "assistant").agg(parts.alias("p")).select(
        "conv_id", "assistant",
        F.array_join(F.transform("p", lambda x: x["segment"]), "").alias("rendered"),
        F.transform(
            F.filter("p", lambda x: x["mask_end"] > x["mask_start"]),
            lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end")),
        ).alias("masks"),
    )
