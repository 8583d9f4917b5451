"""A batch's state from its append-only ledger, as aggregates.

A sample is done when a record accepts it. Accepted, rejected and mismatched answers count as attempts of
their round, transport errors don't. A sample whose latest round is used up is exhausted, until a new
round is authorised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions.prompts import MODEL, OUTPUT

BILLABLE = ("accepted", "rejected", "model_mismatch")
MAX_ATTEMPTS = 2

RECORD = (
    "recorded_at_utc string, protocol_id string, sample_id string, source string, corpus_label int, similarity_group_id string, status string, retry_round int, authorised_retry boolean, attempt int, "
    f"request_key string, provider_request_id string, requested_model string, resolved_model string, input_tokens long, cached_input_tokens long, output_tokens long, output {OUTPUT}, "
    "validation_error string, response_sha256 string, error string"
)


def rounds(records: DataFrame) -> DataFrame:
    """(sample_id, accepted, retry_round, used, billable): each sample's latest round and what it has used."""
    r = F.coalesce(F.col("retry_round"), F.lit(1))
    per = records.groupBy("sample_id", r.alias("retry_round")).agg(
        F.count_if(F.col("status").isin(*BILLABLE)).alias("used"), F.count_if(F.col("status") == "accepted").alias("ok")
    )
    latest = F.max(F.struct("retry_round", "used")).alias("last")
    return per.groupBy("sample_id").agg((F.sum("ok") > 0).alias("accepted"), latest, F.sum("used").alias("billable")).select("sample_id", "accepted", "last.retry_round", "last.used", "billable")


def state(samples: DataFrame, records: DataFrame, attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """samples (sample_id) with what each awaits: accepted, exhausted or pending, and its next attempt."""
    rows = samples.select("sample_id").join(rounds(records), "sample_id", "left")
    used, done = F.coalesce("used", F.lit(0)), F.coalesce("accepted", F.lit(False))
    rows = rows.withColumn("retry_round", F.coalesce("retry_round", F.lit(1))).withColumn("used", used).withColumn("billable", F.coalesce("billable", F.lit(0)))
    what = F.when(done, "accepted").when(F.col("used") >= attempts, "exhausted").otherwise("pending")
    return rows.select("sample_id", what.alias("state"), "retry_round", "used", "billable")


def pending(states: DataFrame, limit: int | None, retry_exhausted: bool = False) -> DataFrame:
    """The next samples to send, at most limit by id, or all for None: sample_id, retry_round, attempt."""
    again = F.lit(retry_exhausted) & (F.col("state") == "exhausted")
    rows = states.where((F.col("state") == "pending") | again)
    nxt = rows.select("sample_id", F.when(again, F.col("retry_round") + 1).otherwise(F.col("retry_round")).alias("retry_round"), F.when(again, 1).otherwise(F.col("used") + 1).cast("int").alias("attempt"))
    return nxt if limit is None else nxt.orderBy("sample_id").limit(limit)


def strangers(samples: DataFrame, records: DataFrame) -> DataFrame:
    """Accepted samples that aren't among samples; there must be none."""
    return records.where("status = 'accepted'").select("sample_id").distinct().join(samples.select("sample_id"), "sample_id", "left_anti")


def usage(records: DataFrame) -> DataFrame:
    """One row: sums of tokens, missing ones as 0, and resolved models (at most one is allowed)."""
    total = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).cast("long").alias(c)
    return records.agg(*(total(c) for c in ("input_tokens", "cached_input_tokens", "output_tokens")), F.countDistinct("resolved_model").alias("resolved_models"))


def batch_status(states: DataFrame, paused: Column | None = None) -> DataFrame:
    """One row: counts, and complete, the reason for a pause, retry_exhausted or paused, in this order."""
    n = {s: F.count_if(F.col("state") == s).alias(s) for s in ("accepted", "exhausted", "pending")}
    row = states.agg(F.count(F.lit(1)).alias("samples"), *n.values())
    reason = F.lit(None).cast("string") if paused is None else paused
    status = F.when(F.col("accepted") == F.col("samples"), "complete").otherwise(F.coalesce(reason, F.when(F.col("exhausted") > 0, "retry_exhausted"), F.lit("paused")))
    return row.select("samples", "accepted", "exhausted", (F.col("samples") - F.col("accepted")).alias("remaining"), status.alias("status"))


def request_key(protocol: Column, sample: Column, round_: Column, attempt: Column) -> Column:
    """A digest of what identifies a request; the first round isn't part of it."""
    nul = F.lit("\0")
    tail = F.when(round_ == 1, attempt.cast("string")).otherwise(F.concat_ws("\0", round_.cast("string"), attempt.cast("string")))
    return F.sha2(F.concat(protocol, nul, sample, nul, tail), 256)


def with_keys(batch: DataFrame, protocol: str, attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """batch (of pending) with request_keys: those of its next attempt and of the ones after it in its round."""
    at = F.sequence(F.col("attempt"), F.greatest(F.col("attempt"), F.lit(attempts)))
    return batch.withColumn("request_keys", F.transform(at, lambda a: request_key(F.lit(protocol), F.col("sample_id"), F.col("retry_round"), a)))


def predictions(records: DataFrame, representation: str) -> DataFrame:
    """The last accepted record of each sample as a prediction."""
    last = records.where("status = 'accepted'").groupBy("sample_id").agg(F.max_by(F.struct("source", "corpus_label", "similarity_group_id", "output"), F.struct("recorded_at_utc", "request_key")).alias("r"))
    label = (F.col("r.output.label") == "phishing").cast("int")
    return last.select("sample_id", "r.source", "r.corpus_label", "r.similarity_group_id", F.lit(representation).alias("representation"), label.alias("predicted_label"), F.col("r.output.phishing_probability").alias("phishing_probability"))
