"""Near duplicates by 64-bit fingerprints of word pairs, banded into bytes.

Any two fingerprints that differ in at most 6 bits agree in two of 8 bytes at least, so the equi-join on
(band, byte) finds every pair unless a bucket overflows its cap. exact_edges() joins on two bands at once
and has no cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lettermill.functions.text import pairs, tokens
from lettermill.operators.graph import connected_components

BANDS, BUCKET_CAP = 8, 250
#: Bits from one counter to the next in a number, and (as a power of 2) votes counted there at most.
LANE, RUN_BITS = 16, 14
LEAST_TOKENS, MOST_DISTANCE, LEAST_RATIO = 20, 6, 0.75


def fingerprints(messages: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, token_count, fingerprint) of every message with a token.

    Each pair of words votes on each bit, by the first 8 bytes of its SHA-256; a bit is set at 0 votes or
    more. Votes are summed before the shuffle: four bits share a number, 16 bits apart, for runs of pairs
    short enough not to overflow.
    """
    words = messages.select(F.col(key), tokens(text).alias("w"))
    feature = words.select(key, F.size("w").alias("n"), F.posexplode(pairs(F.col("w"))).alias("at", "f"))
    hashed = feature.select(key, "n", F.shiftright("at", RUN_BITS).alias("run"), F.conv(F.substring(F.sha2("f", 256), 1, 16), 16, -10).cast("long").alias("h"))
    lanes = F.lit(sum(1 << LANE * i for i in range(64 // LANE)))
    packed = [F.sum(F.shiftrightunsigned("h", b).bitwiseAND(lanes)).alias(f"p{b}") for b in range(LANE)]
    runs = hashed.groupBy(key, "n", "run").agg(F.count(F.lit(1)).alias("all"), *packed)
    ones = [F.sum(F.shiftrightunsigned(f"p{b % LANE}", b // LANE * LANE).bitwiseAND(F.lit((1 << LANE) - 1))).alias(f"b{b}") for b in range(64)]
    votes = runs.groupBy(key, "n").agg(F.sum("all").alias("all"), *ones)
    bits = F.lit(0).cast("long")
    for b in range(64):
        bits = bits.bitwiseOR(F.when(F.col(f"b{b}") * 2 >= F.col("all"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return votes.select(key, F.col("n").cast("long").alias("token_count"), bits.alias("fingerprint"))


def _bytes(prints: DataFrame) -> DataFrame:
    """One row for each band of each message that is long enough: band and byte."""
    byte = lambda b: F.shiftrightunsigned("fingerprint", 8 * b).bitwiseAND(F.lit(255)).cast("int")
    rows = prints.where(F.col("token_count") >= LEAST_TOKENS).withColumn("byte", F.array(*(byte(b) for b in range(BANDS))))
    return rows.select("*", F.posexplode("byte").alias("band", "bucket")).drop("byte").withColumnRenamed("bucket", "byte")


def bands(prints: DataFrame, key: str, order: Column, cap: int = BUCKET_CAP) -> DataFrame:
    """The rows that find room in their buckets, the first cap of each in order: band, byte and nth.

    The limit on nth lets each task drop what it has beyond it before rows are dealt by bucket.
    """
    nth = F.row_number().over(W.partitionBy("band", "byte").orderBy(order, key))
    return _bytes(prints).withColumn("nth", nth).where(F.col("nth") <= cap)


def edges(banded: DataFrame, key: str, group: str) -> DataFrame:
    """Pairs within MOST_DISTANCE bits and LEAST_RATIO of length, of different exact-duplicate groups.

    Of the rows in a bucket only those that found room take part, in the numbering order.
    """
    rows = banded.select("band", "byte", "nth", key, group, "token_count", "fingerprint")
    a, b = (rows.select("band", "byte", *(F.col(c).alias(f"{c}_{s}") for c in ("nth", key, group, "token_count", "fingerprint"))) for s in "ab")
    both = a.join(b, ["band", "byte"]).where(F.col("nth_a") < F.col("nth_b"))
    distance = F.bit_count(F.col("fingerprint_a").bitwiseXOR(F.col("fingerprint_b")))
    ratio = F.least("token_count_a", "token_count_b") / F.greatest("token_count_a", "token_count_b")
    near = both.where((distance <= MOST_DISTANCE) & (ratio >= LEAST_RATIO) & ~F.col(f"{group}_a").eqNullSafe(F.col(f"{group}_b")))
    return near.select(
        F.least(f"{key}_a", f"{key}_b").alias("left_sample_id"), F.greatest(f"{key}_a", f"{key}_b").alias("right_sample_id"),
        distance.cast("tinyint").alias("hamming_distance"), ratio.alias("token_count_ratio"),
    ).distinct()


def exact_edges(prints: DataFrame, key: str, group: str) -> DataFrame:
    """Pairs as in edges(), all of them: no bucket has a cap.

    Pairs within MOST_DISTANCE bits agree in two bands at least, so rows meet by two bands and their bytes
    (65,536 values for each two bands), and only where these are the first two that agree. The join is one
    that adaptive execution can split where a value is hot. Equal fingerprints meet within one value.
    """
    byte = lambda b, s="": F.shiftrightunsigned(f"fingerprint{s}", 8 * b).bitwiseAND(F.lit(255)).cast("int")
    two = [F.struct(F.lit(i * BANDS + j).alias("bands"), (byte(i) * 256 + byte(j)).alias("bytes")) for i in range(BANDS) for j in range(i + 1, BANDS)]
    rows = prints.where(F.col("token_count") >= LEAST_TOKENS).select(key, group, "token_count", "fingerprint", F.explode(F.array(*two)).alias("two"))
    a, b = (rows.select("two.bands", "two.bytes", *(F.col(c).alias(f"{c}_{s}") for c in (key, group, "token_count", "fingerprint"))) for s in "ab")
    both = a.join(b, ["bands", "bytes"]).where(F.col(f"{key}_a") < F.col(f"{key}_b"))
    distance = F.bit_count(F.col("fingerprint_a").bitwiseXOR(F.col("fingerprint_b")))
    ratio = F.least("token_count_a", "token_count_b") / F.greatest("token_count_a", "token_count_b")
    alike = F.filter(F.array(*(F.when(byte(i, "_a") == byte(i, "_b"), F.lit(i)) for i in range(BANDS))), lambda x: x.isNotNull())
    near = both.where((distance <= MOST_DISTANCE) & (ratio >= LEAST_RATIO) & ~F.col(f"{group}_a").eqNullSafe(F.col(f"{group}_b")))
    near = near.where(F.col("bands") == F.get(alike, F.lit(0)) * BANDS + F.get(alike, F.lit(1)))
    return near.select(
        F.col(f"{key}_a").alias("left_sample_id"), F.col(f"{key}_b").alias("right_sample_id"), distance.cast("tinyint").alias("hamming_distance"), ratio.alias("token_count_ratio")
    )


def overflow(prints: DataFrame, cap: int = BUCKET_CAP) -> DataFrame:
    """One row: how many rows find their bucket full, and whether every near pair is a candidate."""
    over = _bytes(prints).groupBy("band", "byte").agg(F.greatest(F.count(F.lit(1)) - cap, F.lit(0)).alias("over"))
    return over.agg(F.coalesce(F.sum("over"), F.lit(0)).alias("bucket_overflow_events")).select("bucket_overflow_events", (F.col("bucket_overflow_events") == 0).alias("candidate_recall_is_exhaustive"))


def group_ids(members: DataFrame, key: str, similar: DataFrame) -> DataFrame:
    """(key, root, similarity_group_id): the component of each member, named by a digest of its sorted ids.

    A component's ids are gathered in a row, as its name requires; components of near copies that need
    more than a row's size can't be named this way.
    """
    roots = connected_components(similar, "left_sample_id", "right_sample_id").withColumnRenamed("node", key)
    named = members.select(key).join(roots, key, "left").withColumn("root", F.coalesce("root", key))
    name = F.sha2(F.array_join(F.array_sort(F.collect_list(key)), "\n"), 256)
    gid = named.groupBy("root").agg(F.concat(F.lit("similarity_"), F.substring(name, 1, 24)).alias("similarity_group_id"))
    return named.join(gid, "root").select(key, "root", "similarity_group_id")


def crossing(groups: DataFrame, *fields: str) -> DataFrame:
    """Groups whose members differ in one of the fields: similarity_group_id, and the number of values of each field."""
    spread = groups.groupBy("similarity_group_id").agg(*(F.countDistinct(f).alias(f) for f in fields))
    return spread.where(F.greatest(*fields, F.lit(0)) > 1)
