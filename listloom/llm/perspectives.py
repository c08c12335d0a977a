"""Operator 9: multi-party perspective rotation of chat dialogues, with DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered with that speaker as ``assistant`` and the others
as named users; a mask marks the characters to learn from (the speaker's own words and end mark). The result has one row
for each conversation, perspective and turn, with the place of the turn's segment in the rendered dialogue, so that even a
conversation with a great many turns is never gathered in one task; ``joined`` makes one row a dialogue where those are
known to be short.

Participants are the distinct roles of a conversation except ``system``, whose turns keep their role, are masked out and
get no perspective of their own. Places come from prefix sums over blocks of ``BLOCK`` turns and then within a block.

Defined results: a null or blank role is the participant ``unknown``; a null text is empty; repeated turn numbers are
ordered by role and text, a null turn comes first; conversations with only system turns have no perspective and give no
rows; a null conv_id is a conversation of its own; an empty table gives an empty result. Role names cannot forge markers:
``<|`` in names and texts is written ``<\\|``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

BLOCK = 256
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, perspective, turn, seq (place among turns), role_as, segment, start, mask_start, mask_end (characters
    from the beginning of the dialogue; mask_start = mask_end where nothing is learnt)."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("<\\|"))
    t = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.nullif(F.trim(F.col(role)), F.lit("")), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text), F.lit("")).alias("body"),
    )
    # each block of turns is numbered on its own; blocks are few, so a long conversation is never one group
    t = t.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1)).cast("long"))
    people = t.filter(F.col("speaker") != "system").select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    # a row for each participant of the same conversation: the result asked for
    seen = t.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    mine = F.col("speaker") == F.col("perspective")
    role_as = F.when(F.col("speaker") == "system", F.lit("system")).when(mine, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), safe(F.col("speaker"))))
    head = F.concat(F.lit(OPEN), role_as, F.lit(CLOSE))
    seen = seen.select(
        "conv_id", "perspective", "turn", "block", "speaker", role_as.alias("role_as"),
        F.concat(head, safe(F.col("body")), F.lit(END)).alias("segment"), F.length(head).cast("long").alias("_head"), mine.alias("learn"),
    ).withColumn("_len", F.length("segment").cast("long"))
    block = Window.partitionBy("conv_id", "perspective", "block").orderBy(F.col("turn").asc_nulls_first(), "speaker", "segment").rowsBetween(Window.unboundedPreceding, 0)
    sums = seen.groupBy("conv_id", "perspective", "block").agg(F.sum("_len").alias("_sum"), F.count("*").alias("_count"))
    over = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select(
        F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("block").alias("_b"),
        (F.sum("_sum").over(over) - F.col("_sum")).alias("_chars"), (F.sum("_count").over(over) - F.col("_count")).alias("_turns"),
    )
    placed = seen.withColumn("_in", F.sum("_len").over(block) - F.col("_len")).withColumn("_nth", F.count("*").over(block) - 1)
    placed = placed.join(sums, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("perspective") == F.col("_p")) & (F.col("block") == F.col("_b")))
    start = F.col("_chars") + F.col("_in")
    return placed.select(
        "conv_id", "perspective", "turn", (F.col("_turns") + F.col("_nth")).alias("seq"), "role_as", "segment", start.alias("start"),
        (start + F.when(F.col("learn"), F.col("_head")).otherwise(F.col("_len"))).alias("mask_start"), (start + F.col("_len")).alias("mask_end"),
    )


def joined(rotated: DataFrame) -> DataFrame:
    """One row a dialogue and perspective: the rendered text and its mask spans. Only where conversations are short."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "segment", "mask_start", "mask_end")))
    return rotated.groupBy("conv_id", "perspective").agg(parts.alias("p")).select(
        "conv_id", "perspective", F.array_join(F.transform("p", lambda x: x["segment"]), "").alias("rendered"),
        F.transform(F.filter("p", lambda x: x["mask_start"] < x["mask_end"]), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end"))).alias("mask"),
    )


def op9_perspectives(spark, sf_dir):
    return rotate(table(spark, sf_dir, "conversations"))


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(nullif(trim(role), ''), 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '<\|') AS body FROM conversations
), people AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'
), s AS (
  SELECT t.conv_id, perspective, turn, speaker,
         CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || replace(speaker, '<|', '<\|') END AS role_as, body,
         speaker = perspective AS learn
  FROM t JOIN people ON t.conv_id IS NOT DISTINCT FROM people.conv_id
), g AS (
  SELECT *, '<|' || role_as || '|>' || chr(10) AS head, '<|' || role_as || '|>' || chr(10) || body || '<|end|>' || chr(10) AS segment FROM s
), o AS (
  SELECT *, length(segment) AS n,
         sum(length(segment)) OVER w - length(segment) AS start, count(*) OVER w - 1 AS seq
  FROM g WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, segment ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, turn, seq::BIGINT AS seq, role_as, segment, start::BIGINT AS start,
       (start + CASE WHEN learn THEN length(head) ELSE n END)::BIGINT AS mask_start, (start + n)::BIGINT AS mask_end
FROM o
"""
