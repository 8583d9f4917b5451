"""Mixing sources to target weights by hash-threshold histograms; Spark expressions only.

Each document has a fixed hash. A source takes every document as often as its target holds its whole
size, and once more those whose hash is below a threshold. The threshold comes from a histogram of sizes
by source and hash bucket: the bucket in which the budget ends is refined by the next bits of the hash,
and only that one, until it is fine enough. Nothing is sorted but the buckets of a source. Rows that repeat are one
group with a number of copies, of which the threshold can take some.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lettermill.llm.words import SPACE_GAP, word_array
from lettermill.session import count, materialize

WEIGHTS = (5, 2, 1)
MOST = 3
#: Bits of the hash that each histogram resolves; the hash has as many as all of them.
LEVEL_BITS, LEVELS = 12, 3
#: The first pass ends at a document that is too large for what is left; the next fills that up with
#: smaller ones, behind it.
PASSES = 2
#: What sums of doubles may be off by.
TINY = 1e-6
#: Sources whose thresholds are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Rounds in which caps are found at most; each caps one more source at least.
ROUNDS = 1000


def hashed(doc_id: Column, text: Column) -> Column:
    """A document's hash: the first hexadecimal digits of an MD5 of id and text (nulls as empty) as a number."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("/"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, LEVEL_BITS * LEVELS // 4), 16, 10).cast("long")


def ranked(sizes: DataFrame) -> DataFrame:
    """sizes with rank, from 0, of their sources by code point, null last.

    Sources are dealt to tasks by ranges and numbered within them, so that no task holds all.
    """
    order = F.col("source").asc_nulls_last()
    dealt = materialize(sizes.repartitionByRange(order).withColumn("__part", F.spark_partition_id()), "ranges")
    before, at = F.lit(0), 0
    for r in dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect():  # a row a task
        before = F.when(F.col("__part") == r["__part"], F.lit(at)).otherwise(before)
        at += r.n
    return dealt.withColumn("rank", F.row_number().over(W.partitionBy("__part").orderBy(order)) - 1 + before).drop("__part")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target): by weight, none above most times its size.

    Weights repeat over the sources in code point order, null last. What caps cut off is shared among the
    others by weight, in rounds, until none is above: each round is one sum over the sources.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = ranked(sizes).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    rows = materialize(rows.select("source", "source_size", "weight", "cap"), "weighed")
    level, capped = float("-inf"), -1
    for _ in range(ROUNDS):
        over = F.col("cap") < F.col("weight") * F.lit(level)
        got = rows.agg(
            F.sum("source_size").alias("all"), F.count_if(over).alias("n"), F.sum(F.when(over, F.col("cap"))).alias("caps"), F.sum(F.when(~over, F.col("weight"))).alias("weights")
        ).first()
        if got.n == capped or not got.weights:
            break
        level, capped = (got["all"] * share - (got.caps or 0.0)) / got.weights, got.n
    return rows.select("source", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def _with_source(rows: DataFrame, per_source: DataFrame, hint: bool) -> DataFrame:
    per_source = per_source.withColumnRenamed("source", "__s")
    return rows.join(F.broadcast(per_source) if hint else per_source, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")


def _bits(level: int) -> Column:
    """The bits of the hash that tell the buckets of a level, and of those above, apart."""
    return F.shiftrightunsigned("h", LEVEL_BITS * (LEVELS - 1 - level))


def _threshold(base: DataFrame, state: DataFrame, p: int, hint: bool) -> DataFrame:
    """Find how far each source's hashes, from lo on, are taken in pass p: columns from, to and most (size), and part.

    part is how many copies of the group at the end are taken besides. Leaves what the budget still holds, and
    as lo the hash behind the group that didn't fit.
    """
    # The bucket in which the budget ends, by more and more bits; null where all documents fit.
    edge = state.select("source", "lo", "budget", F.floor(F.col("budget") + TINY).alias("most"), F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        inside = _with_source(base, edge, hint).where((F.col("h") >= F.col("lo")) & (F.col("size") <= F.col("most")))
        inside = inside.where(_bits(level - 1) == F.col("prefix")) if level else inside
        one = F.min(F.struct("size", "copies")) if level == LEVELS - 1 else F.lit(None).cast("struct<size:bigint,copies:bigint>")
        hist = inside.groupBy("source", _bits(level).alias("bucket"), "budget").agg(F.sum(F.col("size") * F.col("copies")).alias("n"), one.alias("one"))
        hist = hist.withColumn("upto", F.sum("n").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)))
        ends = F.min(F.when(F.col("upto") > F.col("budget") + TINY, F.struct("bucket", (F.col("budget") - F.col("upto") + F.col("n")).alias("left"), "one")))
        ends = hist.groupBy("source").agg(ends.alias("end"), F.max("upto").alias("all")).select(F.col("source").alias("__e"), "end", "all")
        nxt = edge.join(F.broadcast(ends) if hint else ends, F.col("source").eqNullSafe(F.col("__e")), "left")
        left = F.coalesce("end.left", F.col("budget") - F.coalesce("all", F.lit(0))) if not level else F.coalesce("end.left", "budget")
        edge = materialize(nxt.select("source", "lo", "most", left.alias("budget"), F.col("end.bucket").alias("prefix"), F.col("end.one").alias("one")), f"threshold{level}")
    end = F.coalesce("prefix", F.lit(1 << LEVEL_BITS * LEVELS))
    # Groups that share all bits at the end are left to the next pass; of one with copies, those that fit are taken.
    part = F.when(F.col("one.copies") > 1, F.least(F.col("one.copies"), F.floor((F.col("budget") + TINY) / F.nullif("one.size", F.lit(0)))))
    edge = edge.withColumn("part", F.coalesce(part, F.lit(0)).cast("long"))
    edge = edge.select(
        F.col("source").alias("__e"), F.col("lo").alias(f"from{p}"), end.alias(f"to{p}"), F.col("most").alias(f"most{p}"), F.col("part").alias(f"part{p}"), F.col("one.size").alias(f"one{p}"),
        (F.col("budget") - F.col("part") * F.coalesce("one.size", F.lit(0))).alias("left"), (end + 1).alias("next"),
    )
    both = state.join(F.broadcast(edge) if hint else edge, F.col("source").eqNullSafe(F.col("__e")))
    return both.withColumn("budget", F.col("left")).withColumn("lo", F.col("next")).drop("__e", "left", "next")


def _extra() -> Column:
    """How many copies of a group the thresholds take once more."""
    inside, some = F.lit(False), F.lit(0).cast("long")
    for p in range(PASSES):
        fits = F.col("size") <= F.col(f"most{p}")
        inside = inside | ((F.col("h") >= F.col(f"from{p}")) & (F.col("h") < F.col(f"to{p}")) & fits)
        ending = (F.col("h") == F.col(f"to{p}")) & (F.col("size") == F.col(f"one{p}")) & (F.col("copies") > 1)
        some = F.when(F.coalesce(ending, F.lit(False)), F.greatest(some, F.col(f"part{p}"))).otherwise(some)
    return F.when(inside, F.col("copies")).otherwise(F.least("copies", some))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """How many words of each document the mix takes.

    docs: doc_id, text, source. A size is a text's number of words between ASCII white space (null: 0).
    Returns, one row a document: doc_id, size, source_size, target (its source's), taken (words, repeats
    counted; a document is taken whole, up to most times). The null source is a source of its own. The
    hash is of doc_id and text, so reruns agree; of rows that repeat both, as many as fit are taken once more than
    the others. At last the document, of those left, whose size is nearest to what the budget still holds is taken if
    that brings the source nearer to its target. Empty tables give none.
    """
    if most < 1 or most != int(most) or not weights or min(weights) <= 0 or not 0 <= share <= most:
        raise ValueError("most must be whole and positive, weights positive, share from 0 to most")
    size = F.size(word_array(F.col("text"), SPACE_GAP)).cast("long")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), hashed(F.col("doc_id"), F.col("text")).alias("h"))
    base = materialize(rows.groupBy("doc_id", "source", "size", "h").agg(F.count(F.lit(1)).alias("copies")), "sizes")
    sizes = base.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    plan = materialize(targets(sizes, weights, most, share), "targets")
    hint = count(plan) <= BROADCAST_SOURCES
    whole = F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0)) + 1e-9), F.lit(0)).cast("long")
    state = plan.withColumn("whole", whole).withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - whole * F.col("source_size"))).withColumn("lo", F.lit(0).cast("long"))
    for p in range(PASSES):
        state = materialize(_threshold(base, state, p, hint), f"pass{p}")
    taken = _with_source(base, state, hint).withColumn("extra", _extra())
    nearest = F.min(F.when((F.col("extra") < F.col("copies")) & (F.col("size") < 2 * F.col("budget")), F.struct(F.abs(F.col("size") - F.col("budget")).alias("off"), "h", "doc_id")))
    last = taken.groupBy("source").agg(nearest.alias("last")).where("last is not null").select("source", F.col("last.h").alias("last_h"), F.col("last.doc_id").alias("last_id"))
    state = materialize(state.join(last.withColumnRenamed("source", "__l"), F.col("source").eqNullSafe(F.col("__l")), "left").drop("__l"), "last")
    taken = _with_source(base, state, hint).withColumn("extra", _extra())
    more = F.coalesce((F.col("h") == F.col("last_h")) & F.col("doc_id").eqNullSafe(F.col("last_id")) & (F.col("extra") < F.col("copies")), F.lit(False))
    taken = taken.withColumn("extra", F.col("extra") + more.cast("long"))
    each = taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    times = F.col("whole") + (F.col("copy") <= F.col("extra")).cast("long")
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"))
