"""Chat formatting by multi-party perspective rotation, with DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant
and the others as named users; only the assistant's words, with their end mark, carry the loss. A
dialogue comes as its pieces, one row for each turn and perspective, so no conversation has to fit one
row or task: pieces strung together by turn (null last), role (null last) and text are the dialogue, and
pieces that tie in all three are equal. ``dialogues`` does so where conversations are known to fit.

System turns stay system turns and are no participant. Speakers are told apart by their roles as given;
a null or empty role is a speaker without a name, shown as `unknown`. Null text is empty text. Marks
inside shown names and texts are broken up. Repeated rows are turns of their own. A row without a
conv_id belongs to no known conversation: it is one of its own, with its speaker's perspective.
Conversations of system turns only have no perspective. An empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, narrow, table

SYSTEM, UNKNOWN, END = "system", "unknown", "<|end|>\n"


def rotate(df: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, perspective, turn, speaker, trained (0 or 1), piece, mask_start, mask_end (code points of
    ``piece``, end exclusive, equal if not trained). perspective and speaker are roles as given, '' for none."""
    plain = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))
    turns = narrow(df, conv_id=conv_id, turn=turn, role=role, text=text)
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("speaker"), plain(F.col("text")).alias("text"))
    known, alone = turns.where("conv_id is not null"), turns.where(F.col("conv_id").isNull() & (F.col("speaker") != SYSTEM))
    seats = cut(known.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct())
    views = known.join(seats, "conv_id").unionByName(alone.withColumn("perspective", F.col("speaker")))
    trained = F.col("speaker") == F.col("perspective")
    shown = F.regexp_replace(plain(F.col("speaker")), r"[\n|>]", "_")
    name = F.when(shown == "", UNKNOWN).otherwise(shown)
    head = F.when(trained, "<|assistant|>\n").when(F.col("speaker") == SYSTEM, "<|system|>\n").otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))
    start, size = F.char_length(head), F.char_length("text") + len(END) - 1
    return views.select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        F.when(trained, 1).otherwise(0).alias("trained"),
        F.concat(head, "text", F.lit(END)).alias("piece"),
        start.alias("mask_start"),
        F.when(trained, start + size).otherwise(start).alias("mask_end"),
    )


def dialogues(pieces: DataFrame) -> DataFrame:
    """conv_id, perspective, dialogue and masks (array of struct(start, end), code points) from ``rotate``'s
    rows, for conversations that fit a row each."""
    order = F.struct(F.col("turn").isNull().alias("none"), "turn", "speaker", "piece", "mask_start", "mask_end")
    rows = pieces.groupBy("conv_id", "perspective").agg(F.array_sort(F.collect_list(order)).alias("rows"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("masks"))

    def step(acc: Column, x: Column) -> Column:
        span = F.struct((acc["at"] + x["mask_start"]).alias("start"), (acc["at"] + x["mask_end"]).alias("end"))
        masks = F.when(x["mask_start"] < x["mask_end"], F.concat(acc["masks"], F.array(span))).otherwise(acc["masks"])
        return F.struct((acc["at"] + F.char_length(x["piece"])).alias("at"), masks.alias("masks"))

    return rows.select("conv_id", "perspective", F.array_join(F.transform("rows", lambda x: x["piece"]), "").alias("dialogue"), F.aggregate("rows", begin, step, lambda acc: acc["masks"]).alias("masks"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every perspective of all ``conversations``."""
    return rotate(table(spark, sf_dir, "conversations"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body,
         coalesce(nullif(regexp_replace(replace(coalesce(role, ''), '<|', '< |'), '[\n|>]', '_', 'g'), ''), 'unknown') AS shown
  FROM conversations
), s AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'
), seen AS (
  SELECT t.*, s.perspective FROM t JOIN s ON t.conv_id = s.conv_id
  UNION ALL
  SELECT t.*, speaker AS perspective FROM t WHERE conv_id IS NULL AND speaker <> 'system'
), v AS (
  SELECT *, CAST(speaker = perspective AS INTEGER) AS trained,
         CASE WHEN speaker = perspective THEN '<|assistant|>' WHEN speaker = 'system' THEN '<|system|>'
              ELSE '<|user name=' || shown || '|>' END || chr(10) AS head
  FROM seen
)
SELECT conv_id, perspective, turn, speaker, trained, head || body || '<|end|>' || chr(10) AS piece,
       CAST(length(head) AS INTEGER) AS mask_start,
       CAST(length(head) + trained * (length(body) + 7) AS INTEGER) AS mask_end
FROM v
"""
