"""Exact duplicates, label conflicts and quotas: from parsed messages to a balanced candidate pool.

The rules depend on the order of sources and, within each, of messages. They are expressed by where contents first
stand and, per source, by what earlier sources kept, which is bounded by their quotas.
"""

from __future__ import annotations

from dataclasses import dataclass
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lettermill.session import count, materialize

#: Rows that are broadcast to what they are looked up for, about 100 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if count(rows) <= BROADCAST_ROWS else rows


@dataclass(frozen=True)
class Pool:
    """accepted: rows kept, with conflicted. reasons: every scanned row with what became of it."""

    accepted: DataFrame
    reasons: DataFrame


def rejection(body_missing: Column, english: Column, failed: Column) -> Column:
    """The first rule that a message fails, null if none."""
    return F.when(failed, "processing_failure").when(body_missing, "missing_body").when(~english, "not_english_main")


def candidates(messages: DataFrame, sources: list[str], desired: int) -> Pool:
    """Keep messages source by source until each has desired.

    messages: source, label (one per source), content (digest), ord (place within its source), rejected
    (reason or null); all columns stay. A content that nothing kept has is kept once; one that only rows of
    the same label have is skipped; one that a row of another label has is kept in every copy, and all its
    rows are conflicted. The row that fills a quota is the last one scanned of its source.

    Where contents first stand in each source is one aggregate for all. Only what was kept of a content, at most desired rows a
    source, then follows the order of sources.
    """
    usable = messages.where(F.col("rejected").isNull())
    firsts = usable.groupBy("source", "content").agg(F.min(F.struct("ord", "label")).alias("first")).select("source", "content", "first.ord", "first.label")
    firsts = materialize(firsts, "firsts")
    kept: DataFrame | None = None
    ends: list[tuple[str, str | None]] = []
    for source in sources:
        own = F.col("source") == source
        taking = firsts.where(own)
        if kept is not None:
            prior = kept.groupBy(F.col("content").alias("__c")).agg(F.min("label").alias("low"), F.max("label").alias("high"))
            prior = _few(materialize(prior, "prior"))
            others = (F.col("low") != F.col("label")) | (F.col("high") != F.col("label"))
            copies = usable.where(own).join(prior, F.col("content") == F.col("__c")).where(others).select(*taking.columns)
            taking = taking.join(prior, F.col("content") == F.col("__c"), "left_anti").union(copies)
        taken = materialize(taking.orderBy("ord").limit(desired).select("source", "content", "ord", "label"), "taken")
        last = taken.agg(F.count(F.lit(1)).alias("n"), F.max("ord").alias("last")).first()
        ends.append((source, last["last"] if last.n >= desired else None))
        kept = taken if kept is None else kept.unionByName(taken)
    labels = _few(materialize(kept.groupBy(F.col("content").alias("__c")).agg((F.min("label") != F.max("label")).alias("conflicted")), "labels"))
    accepted = messages.join(_few(kept.select(F.col("source").alias("__s"), F.col("ord").alias("__o"))), (F.col("source") == F.col("__s")) & (F.col("ord") == F.col("__o")), "left_semi")
    accepted = accepted.where(F.col("rejected").isNull()).join(labels, F.col("content") == F.col("__c")).drop("__c")
    # What became of each row scanned, told by the labels kept of its content in sources before.
    nth = {s: i for i, s in enumerate(sources)}
    order = F.lit(None).cast("int")
    last = F.lit(None).cast("string")
    for s, end in ends:
        order, last = F.when(F.col("source") == s, nth[s]).otherwise(order), F.when(F.col("source") == s, F.lit(end)).otherwise(last)
    by = kept.withColumn("nth", order).groupBy(F.col("content").alias("__c")).agg(F.collect_set(F.struct("nth", "label")).alias("had"))
    rows = messages.withColumn("nth", order).where(F.col("nth").isNotNull() & (last.isNull() | (F.col("ord") <= last)))
    rows = rows.join(_few(materialize(by, "by")), F.col("content") == F.col("__c"), "left").drop("__c")
    rows = rows.join(_few(kept.select(F.col("source").alias("__s"), F.col("ord").alias("__o"), F.lit(True).alias("taken"))), (F.col("source") == F.col("__s")) & (F.col("ord") == F.col("__o")), "left").drop("__s", "__o")
    others = F.exists("had", lambda h: (h["nth"] < F.col("nth")) & (h["label"] != F.col("label")))
    what = F.when(F.col("rejected").isNotNull(), F.col("rejected")).when(F.coalesce(others, F.lit(False)), "label_conflict").when(F.col("taken"), "kept").otherwise("exact_duplicate")
    return Pool(accepted, rows.select("source", "ord", what.alias("reason")))


def balanced(pool: DataFrame, sources: list[str], cap: int) -> DataFrame:
    """Ranks within sources, of rows without conflicts, and primary or reserve.

    Each source has as many primary rows as the smallest, at most cap.
    """
    usable = pool.where(~F.col("conflicted"))
    counts = {r.source: r.n for r in usable.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = min(cap, *(counts.get(s, 0) for s in sources))
    rank = F.row_number().over(W.partitionBy("source").orderBy("ord"))
    return usable.withColumn("candidate_rank_within_source", rank).withColumn("pool_status", F.when(rank <= most, "primary").otherwise("reserve"))
