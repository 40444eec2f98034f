"""Chat formatting with perspective rotation: every participant's view of a multi-party dialogue.

For each participant of a conversation the dialogue is rendered with that speaker as the assistant and all others
as named users; system turns stay system turns and have no view of their own.  The mask holds the character spans
to train on: the speaker's contents with their end markers.

Built-in functions only.  A conversation is dealt in parts of ``PART_TURNS`` consecutive turn numbers, each
rendered on its own, so no group grows with the length of a conversation; the views of a part are made by joining
the parts with the conversation's participants.  The conversation's first system turn (the rules) is repeated at the
head of every other part, unmasked, so a part stands alone.  Where many rows share turn numbers, so that a part would
have more than ``MOST`` times ``PART_TURNS`` rows, each of its turns is dealt to pieces of about ``PART_TURNS`` rows by
a hash of speaker and text (rows of one turn have no order of their own); ``piece`` is 0 elsewhere.

Defined results: rows that repeat conversation, turn, speaker and text count once; several texts of one turn are
ordered by speaker, then text; a null text is an empty message and a null speaker the speaker ``""`` (named
``unknown``); rows without a turn form the part null, in pieces as above; the first system turn is the least by turn (those
without one last), then text; a null conversation id is a conversation; a conversation of system turns alone has no
views; marker strings inside texts are defused by a blank; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import prepare
from loglens.operators.sizes import broadcast_if_small

START, END, SYSTEM = "<|im_start|>", "<|im_end|>", "system"
PART_TURNS, MOST = 128, 4


def _head(who: Column, perspective: Column) -> Column:
    name = F.regexp_replace(F.when(who == "", F.lit("unknown")).otherwise(who), r"[^A-Za-z0-9_.-]", "_")
    tag = F.when(who == perspective, F.lit("assistant")).when(who == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), name))
    return F.concat(F.lit(START), tag, F.lit("\n"))


def _dealt(rows: DataFrame, part_turns: int) -> DataFrame:
    """Adds (part, piece) to rows of (conv, m)."""
    rows = rows.withColumn("part", F.floor(F.col("m.turn") / part_turns).cast("long"))
    each = rows.groupBy("conv", "part", F.col("m.turn").alias("turn")).agg(F.count(F.lit(1)).alias("n"))  # reads no texts
    crowded = each.groupBy("conv", "part").agg(F.sum("n").alias("all"), F.collect_list(F.struct("turn", "n")).alias("turns")).filter(F.col("all") > MOST * part_turns)
    # a part has at most part_turns turn numbers; crowded ones are few, as each has many rows
    turns = crowded.select("conv", "part", F.inline("turns")).select(
        F.col("conv").alias("t_conv"), F.col("part").alias("t_part"), F.col("turn").alias("t_turn"), F.ceil(F.col("n") / F.lit(part_turns)).alias("pieces"),
        F.coalesce(F.col("turn") - F.col("part") * part_turns, F.lit(0)).cast("long").alias("place")).checkpoint()
    same = F.col("conv").eqNullSafe(F.col("t_conv")) & F.col("part").eqNullSafe(F.col("t_part")) & F.col("m.turn").eqNullSafe(F.col("t_turn"))
    rows = rows.join(broadcast_if_small(turns), same, "left")
    drawn = F.conv(F.substring(F.md5(F.concat("m.who", F.lit(":"), "m.text")), 1, 8), 16, 10).cast("long") % F.col("pieces")
    piece = F.when(F.col("pieces").isNotNull(), F.col("place") * F.lit(1 << 32) + drawn).otherwise(F.lit(0)).cast("long")
    return rows.select("conv", "part", piece.alias("piece"), "m")


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text",
                 part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_col, part, piece, perspective, n_turns, rendered, mask), mask an array of (start, end) in characters;
    ``n_turns`` does not count a repeated system turn."""
    prepare(turns)
    who, text = F.coalesce(F.col(speaker_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    text = F.regexp_replace(text, r"<\|(im_start|im_end)\|>", "< |$1| >")
    rows = turns.select(F.col(conv_col).alias("conv"), F.struct(F.col(turn_col).alias("turn"), who.alias("who"), text.alias("text")).alias("m"))
    dealt = _dealt(rows, part_turns)
    # equal rows merge before the shuffle
    parts = dealt.groupBy("conv", "part", "piece").agg(F.array_sort(F.collect_set("m")).alias("ms"))
    order = F.struct(F.col("m.turn").isNull(), "m.turn", "m.text")
    rules = dealt.filter(F.col("m.who") == SYSTEM).groupBy("conv").agg(F.min_by(F.struct("part", "piece", "m.text"), order).alias("r"))
    speakers = rows.select("conv", F.col("m.who").alias("perspective")).filter(F.col("perspective") != SYSTEM).distinct()
    # one row per conversation and speaker
    speakers = speakers.join(rules.select(F.col("conv").alias("r_conv"), "r"), F.col("conv").eqNullSafe(F.col("r_conv")), "left").select(F.col("conv").alias("s_conv"), "perspective", "r")
    views = parts.join(speakers, F.col("conv").eqNullSafe(F.col("s_conv"))).drop("s_conv")
    me = F.col("perspective")
    elsewhere = F.col("r").isNotNull() & ~(F.col("r.part").eqNullSafe(F.col("part")) & (F.col("r.piece") == F.col("piece")))
    opening = F.when(elsewhere, F.concat(F.lit(f"{START}{SYSTEM}\n"), F.col("r.text"), F.lit(END + "\n"))).otherwise(F.lit(""))
    views = views.withColumn("opening", F.coalesce(opening, F.lit("")))
    views = views.withColumn("heads", F.transform("ms", lambda m: _head(m["who"], me)))
    views = views.withColumn("pieces", F.zip_with("heads", "ms", lambda h, m: F.concat(h, m["text"], F.lit(END + "\n"))))
    views = views.withColumn("sizes", F.transform("pieces", F.length))
    # a part has a bounded number of rows
    before = F.transform("sizes", lambda _, i: F.aggregate(F.slice(F.col("sizes"), F.lit(1), i), F.length("opening").cast("long"), lambda a, x: a + x))
    spans = F.zip_with(F.zip_with(before, "heads", lambda b, h: b + F.length(h)), "ms",
                       lambda s, m: F.struct(s.alias("start"), (s + F.length(m["text"]) + len(END)).alias("end"), (m["who"] == me).alias("mine")))
    mask = F.transform(F.filter(spans, lambda s: s["mine"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return views.select(F.col("conv").alias(conv_col), "part", "piece", "perspective", F.size("ms").cast("long").alias("n_turns"),
                        F.concat("opening", F.array_join("pieces", "")).alias("rendered"), mask.alias("mask"))
