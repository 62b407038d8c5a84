"""Operator 4: multi-party perspective rotation of dialogues.

For every participant of a dialogue (each distinct speaker but ``SYSTEM``) the
dialogue is rendered with that speaker as the assistant, all others as users
with their names, and system turns as system. The mask lists the character spans
to train on: what the assistant says. Turns are ordered by (turn, speaker, text),
nulls first.

A dialogue of any length is rendered in blocks of ``BLOCK_TURNS`` turn numbers,
one row each, so that no task gathers an unbounded dialogue; a dialogue's blocks
joined in order of ``block`` are its whole rendering, and spans count from the
start of their block. Dialogues of more than ``HOT_TURNS`` turns meet their
participants in as many salted partitions as they need.

Nulls: a null text is rendered as empty; a null speaker is the participant
``unknown``; a null turn number belongs to block -1; rows with a null dialogue
id belong to no dialogue and each is a dialogue of its own (id null, block by
turn, told apart by speaker and text). Repeated rows are repeated turns. An
empty table gives no rows. Other columns are not read. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mlode.llm.common import table, written

SYSTEM = "system"
UNKNOWN = "unknown"
BLOCK_TURNS = 256
HOT_TURNS = 100_000
#: Long dialogues (an id and a number each) that are sent to every task; more are joined.
MOST_SENT = 100_000


def _head(speaker: Column, perspective: Column) -> Column:
    return (
        F.when(speaker == perspective, F.lit("<|im_start|>assistant\n"))
        .when(speaker == SYSTEM, F.lit("<|im_start|>system\n"))
        .otherwise(F.concat(F.lit("<|im_start|>user name="), F.regexp_replace(speaker, "\\s+", "_"), F.lit("\n")))
    )


TAIL = "<|im_end|>\n"


def rotate(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """A row for each turn and perspective: conv_id, perspective, block, turn, speaker, text, head, is_target."""
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(speaker).cast("string"), F.lit(UNKNOWN)).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col(turn) / BLOCK_TURNS), F.lit(-1)).cast("long").alias("block"),
    )
    turns_of = rows.filter(F.col("conv_id").isNotNull()).groupBy("conv_id", "speaker").agg(F.count(F.lit(1)).alias("_n"))
    talk = turns_of.filter(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective"))
    hot = written(turns_of.groupBy("conv_id").agg(F.ceil(F.sum("_n") / HOT_TURNS).cast("int").alias("_salts")).filter("_salts > 1"), "long-dialogues")
    many = hot.count()
    if many:
        if many <= MOST_SENT:
            hot = F.broadcast(hot)
        talk = talk.join(hot, "conv_id", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
        salted = rows.join(hot, "conv_id", "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("turn", "speaker", "text"), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")
        known = salted.join(talk, ["conv_id", "_salt"]).drop("_salt")
    else:
        known = rows.join(talk, "conv_id")
    alone = rows.filter(F.col("conv_id").isNull() & (F.col("speaker") != SYSTEM)).withColumn("perspective", F.col("speaker"))
    both = known.unionByName(alone)
    return both.withColumn("head", _head(F.col("speaker"), F.col("perspective"))).withColumn("is_target", F.col("speaker") == F.col("perspective"))


def assemble(rotated: DataFrame) -> DataFrame:
    """conv_id, perspective, block, n_turns, n_target_turns, rendered, mask ("start:end,..." in characters of the block)."""
    turn = F.struct("turn", "speaker", "text", "head", "is_target")
    # a null dialogue id gathers nothing: its rows stay apart by what they say
    apart = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "speaker", "text"))
    grouped = rotated.groupBy("conv_id", "perspective", "block", apart.alias("_apart")).agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    size = lambda t: F.length(t["head"]) + F.length(t["text"]) + len(TAIL)

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(t["head"])
        span = F.concat(begin.cast("string"), F.lit(":"), (begin + F.length(t["text"])).cast("string"))
        spans = F.when(t["is_target"], F.concat(state["spans"], F.when(state["spans"] == "", "").otherwise(","), span)).otherwise(state["spans"])
        return F.struct((state["at"] + size(t)).alias("at"), spans.alias("spans"))

    mask = F.aggregate("_turns", F.struct(F.lit(0).alias("at"), F.lit("").alias("spans")), step, lambda s: s["spans"])
    rendered = F.array_join(F.transform("_turns", lambda t: F.concat(t["head"], t["text"], F.lit(TAIL))), "")
    return grouped.select(
        "conv_id", "perspective", "block", F.size("_turns").alias("n_turns"), F.size(F.filter("_turns", lambda t: t["is_target"])).alias("n_target_turns"), rendered.alias("rendered"), mask.alias("mask"),
    )


def op4_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble(rotate(table(spark, sf_dir, "conversations")))


SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '{UNKNOWN}') AS speaker, coalesce(text, '') AS text, CAST(coalesce(floor(turn / {BLOCK_TURNS}), -1) AS BIGINT) AS block FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> '{SYSTEM}'),
r AS (SELECT t.*, perspective, speaker = perspective AS target, CASE WHEN speaker = perspective THEN '<|im_start|>assistant' || chr(10)
  WHEN speaker = '{SYSTEM}' THEN '<|im_start|>system' || chr(10) ELSE '<|im_start|>user name=' || regexp_replace(speaker, '\\s+', '_', 'g') || chr(10) END AS head FROM t JOIN p USING (conv_id)),
o AS (SELECT *, coalesce(sum(length(head) + length(text) + {len(TAIL)}) OVER (PARTITION BY conv_id, perspective, block ORDER BY turn, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM r)
SELECT conv_id, perspective, block, CAST(count(*) AS INTEGER) AS n_turns, CAST(count(*) FILTER (WHERE target) AS INTEGER) AS n_target_turns,
  string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY turn, speaker, text) AS rendered,
  coalesce(string_agg(CAST(base + length(head) AS BIGINT) || ':' || CAST(base + length(head) + length(text) AS BIGINT), ',' ORDER BY turn, speaker, text) FILTER (WHERE target), '') AS mask
FROM o GROUP BY conv_id, perspective, block
"""
