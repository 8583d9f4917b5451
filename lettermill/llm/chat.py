"""Chat formatting by perspective rotation of dialogues of several parties.

For each participant the dialogue is rendered with that speaker as assistant, the others as named users
and system turns as system. Rows are turns of a rendered dialogue with their place in it, so that a
dialogue of any length needs no row or task of its own size: places are sums within blocks of turns plus
sums of whole blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lettermill.session import count, materialize

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turn numbers to a block.
BLOCK = 256
#: Pairs of dialogue and participant that are broadcast, about 100 bytes each; more are joined by a shuffle.
BROADCAST_PARTIES = 500_000


def _safe(text: Column) -> Column:
    """Text that can't be taken for a mark."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _name(role: Column) -> Column:
    """A speaker's name without white space and marks."""
    return F.regexp_replace(role, r"[\s<>|]+", "_")


def rotate(turns: DataFrame, system: str = "system") -> DataFrame:
    """One row for each turn and perspective: the dialogue as each participant's training example.

    turns: conv_id, turn, role, text. Turns go by number, null last, then role and text; repeated rows
    stay. A null role speaks as "unknown", a null text is empty. Participants are the roles but system; a
    dialogue of system turns alone has none and gives no rows. A null conv_id is a dialogue too. The result
    has a row for each turn and participant, as it must; turns of equal or null number are one block, which one
    task sorts (on disk if need be) for each participant. An empty table gives none; other columns are ignored.

    Returns conv_id, perspective, seq (from 0), role (system, assistant, user), name (of users), rendered
    (the turn's part of the dialogue), start and stop (its place there in characters), mask_start and
    mask_stop (the part to learn: content and end mark of the assistant's turns; else null).
    """
    base = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("speaker"), _safe(F.coalesce("text", F.lit(""))).alias("text")
    )
    parties = materialize(base.where(F.col("speaker") != system).select(F.col("conv_id").alias("__c"), F.col("speaker").alias("perspective")).distinct(), "parties")
    # Both sides of a shuffled join come straight from tables, so that a hot dialogue's turns can be split.
    known = F.broadcast(parties) if count(parties) <= BROADCAST_PARTIES else parties
    rows = base.join(known, F.col("conv_id").eqNullSafe(F.col("__c"))).drop("__c")
    role = F.when(F.col("speaker") == system, "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    name = F.when(F.col("role") == "user", _name(F.col("speaker")))
    head = F.concat(F.lit(OPEN), "role", F.coalesce(F.concat(F.lit(" name="), "name"), F.lit("")), F.lit("\n"))
    rows = rows.withColumn("role", role).withColumn("name", name).withColumn("head", head).withColumn("rendered", F.concat("head", "text", F.lit(CLOSE + "\n")))
    rows = rows.withColumn("long", F.length("rendered").cast("long")).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit((1 << 62))).cast("long"))
    key = ["conv_id", "perspective", "block"]
    sums = rows.groupBy(*key).agg(F.sum("long").alias("chars"), F.count(F.lit(1)).alias("turns"))
    before = W.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*(F.col(k).alias(f"__{k}") for k in key), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in ("chars", "turns")))
    within = W.partitionBy(*key).orderBy(F.col("turn").asc_nulls_last(), "speaker", "text")
    upto = F.sum("long").over(within.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).withColumn("nth", F.row_number().over(within) - 1)
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    rows = rows.join(sums, same).withColumn("stop", F.col("__chars") + F.col("upto"))
    rows = rows.withColumn("start", F.col("stop") - F.col("long")).withColumn("learn", F.col("role") == "assistant")
    return rows.select(
        "conv_id", "perspective", (F.col("__turns") + F.col("nth")).alias("seq"), "role", "name", "rendered", "start", "stop",
        F.when(F.col("learn"), F.col("start") + F.length("head")).alias("mask_start"), F.when(F.col("learn"), F.col("stop") - 1).alias("mask_stop"),
    )


ROTATE_SQL = """
WITH base AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations
), parties AS (SELECT DISTINCT conv_id, speaker AS perspective FROM base WHERE speaker <> 'system'
), shown AS (
  SELECT b.*, perspective,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM base b JOIN parties p ON b.conv_id IS NOT DISTINCT FROM p.conv_id
), named AS (
  SELECT *, CASE WHEN role = 'user' THEN regexp_replace(speaker, '[\\s<>|]+', '_', 'g') END AS name FROM shown
), headed AS (SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM named
), rendered AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS rendered FROM headed
), placed AS (
  SELECT *, row_number() OVER w - 1 AS seq, sum(length(rendered)) OVER (w ROWS UNBOUNDED PRECEDING) AS stop
  FROM rendered WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, text)
)
SELECT conv_id, perspective, seq, role, name, rendered, CAST(stop - length(rendered) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop,
  CASE WHEN role = 'assistant' THEN CAST(stop - length(rendered) + length(head) AS BIGINT) END AS mask_start,
  CASE WHEN role = 'assistant' THEN CAST(stop - 1 AS BIGINT) END AS mask_stop
FROM placed
"""
