"""Comparison of runs: only runs that cover the same samples with the same metadata are compared."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.operators.metrics import classification_metrics

IDENTITY = ("sample_id", "source", "label", "similarity_group_id")


def identity(expected: DataFrame, runs: Mapping[str, DataFrame]) -> DataFrame:
    """(method, missing, unexpected, repeated): differences of each run's identities from the expected ones."""
    want = expected.select(*IDENTITY).groupBy(*IDENTITY).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("m"))
    out = []
    for name, rows in runs.items():
        have = rows.select(*IDENTITY).groupBy(*IDENTITY).agg(F.lit(0).cast("long").alias("n"), F.count(F.lit(1)).alias("m"))
        both = want.unionByName(have).groupBy(*IDENTITY).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
        out.append(both.agg(F.count_if(F.col("n") > F.col("m")).alias("missing"), F.count_if((F.col("m") > 0) & (F.col("n") == 0)).alias("unexpected"), F.count_if((F.col("m") > F.col("n")) & (F.col("n") > 0)).alias("repeated")).select(F.lit(name).alias("method"), "*"))
    return reduce(DataFrame.union, out)


def status(expected: DataFrame, runs: Mapping[str, DataFrame]) -> DataFrame:
    """(method, status): ready if a run covers the expected samples exactly, else incomplete."""
    whole = (F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("repeated") == 0)
    return identity(expected, runs).select("method", F.when(whole, "ready").otherwise("incomplete").alias("status"))


def gate(expected: DataFrame, runs: Mapping[str, DataFrame]) -> DataFrame:
    """Metrics of the runs that cover the expected samples exactly."""
    rows = reduce(DataFrame.unionByName, (r.select("label", "predicted", "score", F.lit(name).alias("method")) for name, r in runs.items()))
    ready = status(expected, runs).where("status = 'ready'").select("method")
    return classification_metrics(rows.join(F.broadcast(ready), "method", "left_semi"), ["method"])
