"""A corpus from raw documents, by five of the training-data operators in order.

Each stage takes the documents that its predecessor kept. The first four return them with the columns they
came with; the last returns the mix: doc_id, size, source_size, target, taken. An empty table passes all stages as one;
what each does with null, empty and repeated texts stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lettermill.llm import decontam, minhash, mixing, quality, toxicity
from lettermill.session import materialize, release, scratch_mark
from lettermill.sources.tables import read_table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality. Null and empty texts have the score of no statistics, repeated rows the same one."""
    return quality.accept(docs, read_table(spark, sf_dir, "labels"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic. Null and empty texts have the score of no words, repeated rows the same one."""
    return toxicity.accept(docs, read_table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more.

    Null and empty texts have no copies and stay. Of rows that repeat a text one stays, that of the smallest doc_id (null
    is largest).
    """
    return minhash.distinct(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. Null and empty texts have none and stay; repeated rows go or stay together."""
    return decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document. Null and empty texts have none; a null source is one of its own."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("toxicity", toxicity_filter),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_to_target_weights),
]

#: Learned scores and connected components over sampled trees can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder.

    What a stage keeps is written before the next one, and what was written on the way to it is deleted then.
    """
    docs = read_table(spark, sf_dir, "documents")
    begun = scratch_mark(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage{k}")
            release(spark, since=begun, keep=[docs])
    return docs
