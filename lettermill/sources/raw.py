"""Raw mail corpora: file trees, single-message files, and mbox containers.

Files are read by Spark's own sources, so that any store it knows will do. A row is a message with
its source, path below the root, and place in its container.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lettermill.config import LABEL_NAMES, SOURCES
from lettermill.functions.text import seeded
from lettermill.session import count, materialize

#: Splits of containers that are broadcast to their messages, about 200 bytes each.
BROADCAST_BLOCKS = 500_000

#: File names of single messages, subsets, and files that are no mail.
SPAM_NAME = r"^\d{5}\.[0-9a-f]{32}$"
SPAM_SUBSETS = ("easy_ham", "easy_ham_2", "hard_ham")
METADATA = ("LICENSE.txt", "README.txt")
ORIGINAL_LABELS = {"enron": "enron", "spamassassin": "ham", "nazario": "phishing", "phishingpot": "phishing"}
#: Notes on how a source's label was mapped.
LABEL_NOTES = {
    "enron": "Enron mapped to the experimental legitimate class", "spamassassin": "SpamAssassin ham mapped to the experimental legitimate class",
    "nazario": "Nazario mapped to the experimental phishing class", "phishingpot": "PhishingPot mapped to the experimental phishing class",
}


def _files(spark: SparkSession, root: str, *below: str, recursive: bool = False, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.load([f"{root}/{b}" for b in below])
    return rows.select(_below(F.col("path"), below[0]).alias("source_path"), "length", "content")


def _below(path: Column, folder: str) -> Column:
    """Paths come as URIs; what follows the root's last part is the path below it."""
    mark = "/" + folder.split("/", 1)[0] + "/"
    return F.concat(F.lit(mark[1:]), F.substring_index(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), mark, -1))


def files(spark: SparkSession, root: str, source: str) -> DataFrame:
    """(source_path, length, content) of the files of a source that hold mail."""
    if source == "enron":
        return _files(spark, root, "Enron/maildir", recursive=True)
    name = F.element_at(F.split("source_path", "/"), -1)
    if source == "spamassassin":
        rows = _files(spark, root, *(f"SpamAssassin/{s}" for s in SPAM_SUBSETS))
        return rows.where(F.regexp_like(name, F.lit(SPAM_NAME)))
    if source == "phishingpot":
        return _files(spark, root, "PhishingPot/PhishingPot", glob="*.eml")
    if source == "nazario":
        return _files(spark, root, "Nazario").where(~name.isin(*METADATA))
    raise ValueError(f"unknown source: {source}")


def mbox_messages(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(source_path, message_index, raw_email) of the messages of the mbox containers in a folder, below which paths begin with its name.

    A message follows a line that begins with "From "; the blank line before the next one isn't part of it. Containers are
    read by a line separator, so that a large one is split among tasks; a message's index is its place in its
    split plus the messages of the splits before, and only these numbers are brought together.
    """
    text = spark.read.option("lineSep", "\nFrom ").text(folder)
    rows = text.select(
        F.col("value").cast("binary").alias("record"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"),
    )
    # The first record of a file has its own mark, or none if there is no message before the second.
    blocks = rows.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.min_by(F.col("record").startswith(F.lit(b"From ")), "id").alias("marked"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy("file")
    headed = F.first("marked").over(every.orderBy("block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("all", F.sum("n").over(every)).withColumn("headed", headed)
    blocks = materialize(blocks.select("file", "block", "first", "before", "all", "headed"), "blocks")
    placed = rows.join(F.broadcast(blocks) if count(blocks) <= BROADCAST_BLOCKS else blocks, ["file", "block"])
    nth = F.col("before") + F.col("id") - F.col("first")
    placed = placed.withColumn("nth", nth).where((F.col("nth") > 0) | F.col("headed"))
    line = F.locate("\n", F.col("record").cast("string"))
    body = F.when(line > 0, F.substring("record", F.octet_length(F.substring_index(F.col("record").cast("string"), "\n", 1)) + 2, F.octet_length("record"))).otherwise(F.lit(b""))
    ends = lambda t: F.endswith(F.col("body"), F.lit(t))
    # Between messages the separator took a line end: that of a blank line, which goes, or of the last line, which stays.
    whole = F.when((F.col("nth") == F.col("all") - 1) | (line == 0), F.col("body")).when(ends(b"\n\r"), F.substring("body", F.lit(1), F.octet_length("body") - 1)).when(ends(b"\n"), F.col("body"))
    whole = whole.otherwise(F.concat("body", F.lit(b"\n")))
    index = F.col("nth") - F.when(F.col("headed"), 0).otherwise(1)
    return placed.withColumn("body", body).select(_below(F.col("file"), name).alias("source_path"), index.cast("long").alias("message_index"), whole.alias("raw_email"))


def messages(spark: SparkSession, root: str, source: str, seed: int) -> DataFrame:
    """The messages of a source, with labels and ord, their place in the seeded order."""
    if source == "nazario":
        rows = mbox_messages(spark, f"{root}/Nazario", "Nazario").where(~F.element_at(F.split("source_path", "/"), -1).isin(*METADATA))
        order = seeded(seed, F.col("source_path"), F.col("message_index").cast("string"))
    else:
        rows = files(spark, root, source).select("source_path", F.lit(None).cast("long").alias("message_index"), F.col("content").alias("raw_email"))
        order = seeded(seed, F.col("source_path"))
    subset = {"spamassassin": F.element_at(F.split("source_path", "/"), -2), "nazario": F.element_at(F.split("source_path", "/"), -1)}.get(source, F.lit(None).cast("string"))
    label = SOURCES[source]
    return rows.select(
        F.lit(source).alias("source"), "source_path", F.col("message_index").alias("source_message_index"), subset.alias("source_subset"), F.lit(ORIGINAL_LABELS[source]).alias("original_label"),
        F.lit(label).alias("corpus_label"), F.lit(LABEL_NAMES[label]).alias("corpus_label_name"), F.lit(LABEL_NOTES[source]).alias("label_mapping_note"),
        order.alias("ord"), "raw_email",
    )


def audit(rows: DataFrame) -> DataFrame:
    """Files and bytes by source, of rows (source, length)."""
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("length").cast("long").alias("bytes"))


def _folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hash each source's sorted rows as they come by; a source lies in one partition."""
    source, digest = None, None
    for pdf in frames:
        for own, path, sha in zip(pdf["source"], pdf["source_path"], pdf["sha"], strict=True):
            if own != source:
                if digest:
                    yield pd.DataFrame({"source": [source], "manifest_sha256": [digest.hexdigest()]})
                source, digest = own, hashlib.sha256()
            digest.update(path.encode())
            digest.update(bytes.fromhex(sha))
    if digest:
        yield pd.DataFrame({"source": [source], "manifest_sha256": [digest.hexdigest()]})


def manifest_digest(rows: DataFrame) -> DataFrame:
    """A digest of all paths and contents of a source, in the order of the paths' parts.

    rows: source, source_path, sha (of the content, hexadecimal). The digest is sequential by definition; it
    streams over sorted rows of 100 bytes and holds none.
    """
    sorted_rows = rows.select("source", "source_path", "sha").repartition("source").sortWithinPartitions("source", F.split("source_path", "/"))
    return sorted_rows.mapInPandas(_folded, "source string, manifest_sha256 string")
