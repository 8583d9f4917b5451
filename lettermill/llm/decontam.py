"""Benchmark decontamination by a broadcast hash set of normalised n-grams; Spark expressions only.

Every window of consecutive item words is kept once, with its hash; which items have it is a table of its own. Documents'
windows are hashed in place, exploded as bare hashes and looked up in the broadcast set of hashes; what matched nothing goes at
once. Hits are verified word by word against the windows, and only they and one row a document reach the shuffle. A set
beyond the broadcast's bound is looked up in several broadcasts, one after the other in the same tasks, or by a
shuffle of the hashes beyond a few of them; documents are read and hashed once in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.words import ALNUM_GAP, lowered, word_array
from lettermill.session import count, materialize

WINDOW = 10
#: Window hashes in one broadcast, about 40 bytes each, and such broadcasts at most.
BROADCAST_HASHES, BROADCASTS = 4_000_000, 4
#: Windows, or windows of items, that are broadcast to the hits, about 200 bytes each; more are joined by a shuffle.
BROADCAST_WINDOWS = 500_000
#: Documents' keys in one broadcast, 16 bytes each.
BROADCAST_KEYS = 1_000_000


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of each item's words: item (its id as a string), win, k (its words), h (its hash)."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), word_array(lowered(F.col("text")), ALNUM_GAP).alias("w"))
    k = F.least(F.lit(window), F.size("w"))
    starts = words.where(F.size("w") > 0).select("item", "w", k.alias("k"), F.explode(F.sequence(F.lit(1), F.size("w") - k + 1)).alias("at"))
    cut = starts.select("item", "k", F.slice("w", F.col("at"), F.col("k")).alias("win")).distinct()
    return cut.withColumn("h", F.xxhash64("win"))


def _covered(spans: Column) -> Column:
    """How many positions lie in any of the spans (start, stop)."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))

    def step(acc: Column, s: Column) -> Column:
        more = F.greatest(F.lit(0), s["stop"] - F.greatest(acc["upto"], s["start"]))
        return F.struct((acc["n"] + more).alias("n"), F.greatest(acc["upto"], s["stop"]).alias("upto"))

    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"])


def _few(rows: DataFrame, most: int) -> DataFrame:
    """rows, broadcast if their number is bounded."""
    return F.broadcast(rows) if count(rows) <= most else rows


def _looked_up(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """rows (__lm_win, a window's hash) with __lm_hit: whether the hash is in the set."""
    n = count(hashes)
    parts = max(1, -(-n // BROADCAST_HASHES))
    if parts > BROADCASTS:
        found = hashes.select(F.col("h").alias("__lm_set"))
        return rows.join(found, F.col("__lm_win") == F.col("__lm_set"), "left").withColumn("__lm_hit", F.col("__lm_set").isNotNull()).drop("__lm_set")
    hit = F.lit(False)
    for part in range(parts):
        own = hashes if parts == 1 else hashes.where(F.pmod("h", F.lit(parts)) == part)
        rows = rows.join(F.broadcast(own.select(F.col("h").alias(f"__lm_set{part}"))), F.col("__lm_win") == F.col(f"__lm_set{part}"), "left")
        hit = hit | F.col(f"__lm_set{part}").isNotNull()
    return rows.withColumn("__lm_hit", hit).drop(*(f"__lm_set{part}" for part in range(parts)))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of docs: its keys, n_words, spans (start, stop in words, of occurring windows), items.

    A null or empty text has no words. Repeated rows stay rows of their own. With an empty benchmark
    nothing is hit. Other columns of either table are ignored. docs should be a stored table, as rows are numbered by
    where they lie.
    """
    items = materialize(item_windows(benchmark, window), "windows")
    wins = materialize(items.select("h", "k", "win").distinct(), "distinct")
    lengths = sorted((r.k for r in wins.select("k").distinct().collect()), reverse=True)  # window rows at most
    words = docs.select(*keys, F.monotonically_increasing_id().alias("__lm_uid"), word_array(lowered(F.col("text")), ALNUM_GAP).alias("__lm_w"))
    n = F.size("__lm_w")
    none = F.array().cast("array<bigint>")
    # One run of window hashes after the other, by length; a window's start is its place less its run's offset.
    run = lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.xxhash64(F.slice("__lm_w", i, k)))
    runs = [F.when(n >= k, run(k)).otherwise(none) for k in lengths]
    hashed = words.withColumn("__lm_h", F.concat(*runs) if runs else none)
    offset, size, before = F.lit(0), F.lit(0), F.lit(0)
    for k in lengths:
        inside = F.col("__lm_at") >= before
        offset, size = F.when(inside, before).otherwise(offset), F.when(inside, F.lit(k)).otherwise(size)
        before = before + F.greatest(F.lit(0), n - k + 1)
    rows = hashed.select(*keys, "__lm_uid", "__lm_w", F.posexplode_outer("__lm_h").alias("__lm_at", "__lm_win"))
    rows = _looked_up(rows, wins.select("h").distinct()).where(F.coalesce(F.col("__lm_at") == 0, F.lit(True)) | F.col("__lm_hit"))
    start = F.when(F.col("__lm_hit"), F.col("__lm_at") - offset)
    rows = rows.select(
        *keys, "__lm_uid", n.cast("long").alias("n_words"), start.alias("start"), (start + size).alias("stop"), F.when(F.col("__lm_hit"), F.slice("__lm_w", start + 1, size)).alias("said"),
        F.when(F.col("__lm_hit"), F.col("__lm_win")).alias("__lm_win"),
    )
    # Verified word by word; windows of which there are few enough bring their items along.
    packed = items.groupBy("h", "win").agg(F.array_sort(F.collect_set("item")).alias("items"))
    few = count(items) <= BROADCAST_WINDOWS
    known = F.broadcast(packed) if few else wins.select("h", "win", F.lit(None).cast("array<string>").alias("items"))
    hits = rows.join(known, (F.col("__lm_win") == F.col("h")) & (F.col("said") == F.col("win")), "left")
    span = F.when(F.col("win").isNotNull(), F.struct("start", "stop"))
    listed = F.col("items") if few else F.when(F.col("win").isNotNull(), F.array(F.col("h")))
    found = hits.select(*keys, "__lm_uid", "n_words", span.alias("span"), listed.alias("items")).groupBy("__lm_uid").agg(
        *(F.first(k).alias(k) for k in keys), F.max("n_words").alias("n_words"), F.collect_set("span").alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    if few:
        return found.withColumn("items", F.array_sort("items")).drop("__lm_uid")
    # Else the items of a document's windows (told by their hashes, which verified windows have) meet it by a shuffle.
    found = materialize(found, "found")
    each = found.select("__lm_uid", F.explode("items").alias("h")).join(items.select("h", "item"), "h").where("item is not null").groupBy("__lm_uid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return found.drop("items").join(each, "__lm_uid", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>"))).drop("__lm_uid")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit (words inside an occurrence of an item's window), n_items
    (items with one), items_sha256 (of their ids, comma-joined; of '' if none), contaminated (n_hit > 0).

    Items of the same id count once, those without an id hit words but aren't counted or listed.
    """
    found = scan(docs, benchmark, window)
    hit = _covered(F.col("spans"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def _kept_text(text: Column, spans: Column) -> Column:
    """The text without the words in spans and the gaps after them."""
    words, gaps = F.array_remove(F.split(text, ALNUM_GAP), ""), F.split(text, ALNUM_GAP.replace("[", "[^", 1))
    inside = lambda i: F.exists(spans, lambda s: (s["start"] <= i) & (i < s["stop"]))
    kept = F.transform(words, lambda w, i: F.when(inside(i), F.lit("")).otherwise(F.concat(w, F.get(gaps, i + 1))))
    return F.concat(F.get(gaps, F.lit(0)), F.array_join(kept, ""))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, mode: str = "documents") -> DataFrame:
    """docs without the contaminated documents, or (mode "spans") with the hit words taken out of their texts.

    All columns stay. Documents are told apart by doc_id and the hash of the text, so repeated rows share
    their verdict and rows that repeat an id with another text don't.
    """
    keyed = docs.withColumn("__lm_text", F.xxhash64("text"))
    found = scan(keyed, benchmark, window, ("doc_id", "__lm_text")).where(F.size("spans") > 0)
    found = materialize(found.dropDuplicates(["doc_id", "__lm_text"]).select(F.col("doc_id").alias("__lm_id"), F.col("__lm_text").alias("__lm_key"), F.col("spans").alias("__lm_spans")), "hits")
    if mode == "documents":
        found = found.drop("__lm_spans")
    sought = _few(found, BROADCAST_KEYS)
    same = keyed["doc_id"].eqNullSafe(sought["__lm_id"]) & (F.col("__lm_text") == F.col("__lm_key"))
    if mode == "documents":
        return keyed.join(sought, same, "left_anti").select(*docs.columns)
    text = F.when(F.col("__lm_spans").isNull(), F.col("text")).otherwise(_kept_text(F.col("text"), F.col("__lm_spans"))).alias("text")
    return keyed.join(sought, same, "left").select(*(text if c == "text" else F.col(f"`{c}`") for c in docs.columns))
