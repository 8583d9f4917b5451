"""Ledger records as a stream: files of JSON lines in, the state of each sample out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lettermill.operators.ledger import BILLABLE, RECORD


def read(spark: SparkSession, directory: str, per_trigger: int = 100) -> DataFrame:
    """New files of records in a directory, as they come."""
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", per_trigger).json(directory)


def attempts(records: DataFrame) -> DataFrame:
    """Running (sample_id, retry_round, used, accepted), one row a sample and round."""
    r = F.coalesce(F.col("retry_round"), F.lit(1)).alias("retry_round")
    return records.groupBy("sample_id", r).agg(F.count_if(F.col("status").isin(*BILLABLE)).alias("used"), F.count_if(F.col("status") == "accepted").alias("accepted"))


def write_states(states: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Replace the table at path by the whole state after every batch of records."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return states.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
