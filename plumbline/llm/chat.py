"""Chat formatting by perspective rotation.

For every participant of a conversation (each role but the system's) the dialogue
is rendered with that speaker as ``assistant`` and the others as named users; a
mask gives the spans, in code points, that are the speaker's own: contents with
their end marker. Only built-in functions are used.

A dialogue is one part, in order of turn, role and text. Conversations of more than
``part_rows`` rows are divided into parts of so many turns: part k holds the turns
from number ``k * part_rows`` on, so the parts joined in order are the dialogue;
spans count from the start of their part. Such a conversation is ranked by a range
partition of its rows and joined with its speakers in several shares, so it is
never sorted, held or written by one task.

Defined results: exact repeats of a row (conversation, turn, role, text) are one
turn; other rows with equal turn numbers are ordered by role, then text; a null
turn comes first; a null role is ``unknown``; a null text is empty; a null
conversation is one of its own. Markers within texts and roles are taken apart by a
space, and white space within roles is one space, so neither can begin a turn.
A conversation that only the system speaks in has no perspective. Texts of any
length are rendered whole. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm._shared import shared_dir, written

START, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
PART_ROWS = 512
#: Shares in which a divided conversation's parts meet its speakers.
SHARES = 64
#: Tables of divided conversations up to so many rows are broadcast.
BROADCAST_ROWS = 10_000


def _clean(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|im_", "< |im_")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _divided(rows: DataFrame, part_rows: int, root: str) -> DataFrame:
    """(conv, part, perspective, turns) of conversations of any size."""
    order = ["conv", "turn", "role", "text"]
    placed = rows.distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = written(placed.withColumn("slot", F.shiftright("at", 33)), root, "placed")
    slots = placed.groupBy("conv", "slot").agg(F.count("*").alias("n"), F.min("at").alias("low"))
    before = Window.partitionBy("conv").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    slots = written(slots.select(F.col("conv").alias("c"), F.col("slot").alias("s"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift")), root, "slots")
    ranked = placed.join(_small(slots), F.col("conv").eqNullSafe(F.col("c")) & (F.col("slot") == F.col("s")))
    ranked = ranked.withColumn("part", F.floor((F.col("at") + F.col("shift")) / part_rows))
    parts = ranked.groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    speakers = written(placed.where(F.col("role") != SYSTEM).select(F.col("conv").alias("c"), F.col("role").alias("perspective")).distinct(), root, "speakers")
    speakers = speakers.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    both = parts.join(speakers, F.col("conv").eqNullSafe(F.col("c")) & (F.pmod("part", F.lit(SHARES)) == F.col("s")))
    return both.select("conv", "part", "perspective", "turns")


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """(conv_col, perspective, part, n_turns, text, spans), one row for each participant and part.

    part: 0, 1, .. in order; spans: ``start:end`` joined by commas.
    """
    role = F.regexp_replace(_clean(F.coalesce(F.col(role_col), F.lit("unknown"))), r"\s+", " ")
    turn = F.coalesce(F.col(turn_col).cast("long"), F.lit(-(1 << 62)))
    rows = turns.select(F.col(conv_col).alias("conv"), turn.alias("turn"), role.alias("role"), _clean(F.col(text_col)).alias("text"))
    root = shared_dir(turns.sparkSession)
    large = written(rows.groupBy("conv").agg(F.count("*").alias("n")).where(F.col("n") > part_rows).select(F.col("conv").alias("c")), root, "large")
    some = large.limit(1).count() > 0
    is_large = F.col("conv").eqNullSafe(F.col("c"))
    whole = rows.join(_small(large), is_large, "left_anti") if some else rows
    whole = whole.groupBy("conv").agg(F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    speakers = F.array_distinct(F.filter(F.transform("turns", lambda t: t["role"]), lambda r: r != SYSTEM))
    parts = whole.select("conv", F.lit(0).cast("long").alias("part"), F.explode(speakers).alias("perspective"), "turns")
    if some:
        parts = parts.union(_divided(rows.join(_small(large), is_large, "left_semi"), part_rows, root))

    def own(t: Column) -> Column:
        return t["role"] == F.col("perspective")

    def head(t: Column) -> Column:
        return F.when(own(t), F.lit(f"{START}assistant\n")).when(t["role"] == SYSTEM, F.lit(f"{START}system\n")).otherwise(F.concat(F.lit(f"{START}user name="), t["role"], F.lit("\n")))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(head(t))
        end = begin + F.length(t["text"]) + len(END)
        span = F.array(F.concat_ws(":", begin.cast("string"), end.cast("string")))
        return F.struct((end + 1).alias("at"), F.when(own(t), F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))
    return parts.select(
        F.col("conv").alias(conv_col),
        "perspective",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["text"], F.lit(f"{END}\n"))), "").alias("text"),
        F.array_join(F.aggregate("turns", none, step, lambda s: s["spans"]), ",").alias("spans"),
    )
