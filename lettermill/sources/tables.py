"""Tables of a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table. Where its files make fewer tasks than there are cores, its rows are dealt to all of them.

    That is so for small tables only, whose rows cost little to move; a table of many files or row groups is
    read where it lies.
    """
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < min(cores, 32) else rows
