"""Tables for reports and charts: which metrics are shown, under which names, and how they are rounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.operators.metrics import CORE_CLASSIFICATION_METRICS, SUPPLEMENTARY_RANKING_METRICS

#: Digits shown.
DIGITS = 4
#: Names that reports give to metrics.
SHOWN = {"pr_auc": "average_precision"}


def core(metrics: DataFrame, by: str, digits: int = DIGITS) -> DataFrame:
    """by and the five core metrics, rounded."""
    return metrics.select(by, *(F.round(m, digits).alias(m) for m in CORE_CLASSIFICATION_METRICS))


def ranking(metrics: DataFrame, by: str, digits: int = DIGITS) -> DataFrame:
    """by and the supplementary ranking metrics, renamed and rounded."""
    return metrics.select(by, *(F.round(m, digits).alias(SHOWN.get(m, m)) for m in SUPPLEMENTARY_RANKING_METRICS))


def confusion(metrics: DataFrame, by: str) -> DataFrame:
    """by and the counts of the confusion matrix: tn, fp, fn, tp."""
    return metrics.select(by, "tn", "fp", "fn", "tp")


def bars(metrics: DataFrame, by: str) -> DataFrame:
    """What a chart of the metrics of which more is better shows: by, metric, value; one row a bar."""
    names = [m for m in CORE_CLASSIFICATION_METRICS if m != "false_positive_rate"]
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.round(m, DIGITS).alias("value")) for m in names))).alias("bar")
    return metrics.select(by, each).select(by, "bar.metric", "bar.value")


def split_bars(pivoted: DataFrame) -> DataFrame:
    """What a chart of messages by source and split shows: source, split, messages; one row a bar."""
    names = [c for c in pivoted.columns if c != "source"]
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("split"), F.col(c).cast("long").alias("messages")) for c in names))).alias("bar")
    return pivoted.select("source", each).select("source", "bar.split", "bar.messages")
