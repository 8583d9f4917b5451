"""What the learned operators share: which rows may teach, and bounded samples of rows and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.session import count, materialize

#: A sample passes this multiple of the rows wanted on to the sort that ends it, plus some.
MARGIN, SOME = 1.25, 64


def held_out(doc_id: Column) -> Column:
    """Rows kept for testing: crc32 of the id as text is a multiple of 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learning_rows(labels: DataFrame, label: str, docs: DataFrame) -> DataFrame:
    """(doc_id, y): labels that aren't null, of documents that are there and aren't held out; equal ones once.

    Written to the scratch folder, as samples and shares are taken of them.
    """
    y = F.col(label).cast("int")
    rows = labels.where(F.col("doc_id").isNotNull() & y.isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", y.alias("y")).distinct()
    return materialize(rows.join(docs.select("doc_id"), "doc_id", "left_semi"), "learning")


def drawn(rows: DataFrame, most: int, *key: str) -> DataFrame:
    """At most so many rows, by a hash of key columns: the same ones for the same table. Rows of equal keys count once.

    The hash's threshold comes from a count of all rows, so that no more than about most of them are
    brought together and sorted, whatever the table's size. Where many rows repeat, fewer than most may come.
    """
    h = F.xxhash64(*key)
    n = count(rows)
    wanted = MARGIN * most + SOME
    if n > wanted:
        share = int(wanted / n * (1 << 62))
        rows = rows.where(F.shiftrightunsigned(F.xxhash64(F.lit("drawn"), *key), 2) < share)
    return rows.dropDuplicates(list(key)).orderBy(h, *key).limit(most)


def texts_of(rows: DataFrame, docs: DataFrame, most: int, made) -> DataFrame:
    """rows (of drawn, so of bounded number) with x, which made gives for the text's bytes of their documents.

    Of documents that repeat an id equal texts count once; at most so many rows stay if ids repeat.
    """
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("__lm_text")).join(F.broadcast(rows), "doc_id")
    texts = texts.select(*rows.columns, F.xxhash64("__lm_text").alias("__lm_h"), made(F.col("__lm_text")).alias("x"))
    return texts.dropDuplicates([*rows.columns, "__lm_h"]).orderBy(F.xxhash64("doc_id"), "doc_id", "__lm_h").limit(most).drop("__lm_h")
