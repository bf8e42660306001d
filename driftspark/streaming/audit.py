"""Audit log as a stream: JSON lines in, append-only table out, each line once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftspark.operators.events import event_totals

_FIELDS = ["run_id", "ts_utc", "phase", "msg", "level"]


def parse_audit(lines: DataFrame) -> DataFrame:
    """Named fields plus the whole line; works on a batch and on a stream."""
    event = F.from_json("value", "MAP<STRING,STRING>")
    return lines.select(event.alias("event"), F.col("value").alias("line")).select(
        *[F.col("event")[name].alias(name) for name in _FIELDS], "line"
    )


def stream_audit(spark: SparkSession, log_path: str, table_path: str, checkpoint: str) -> StreamingQuery:
    """Take in all lines written since the last call, then stop.

    The checkpoint, in a shared folder, remembers which files were read, so a rerun or a lost executor
    neither loses nor repeats a line.
    """
    return (
        parse_audit(spark.readStream.text(log_path))
        .writeStream.format("parquet")
        .option("path", table_path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def merge_batch(batch: DataFrame, batch_id: int, state: str) -> None:
    """Put the totals of one batch of parsed events into the state, in place of what the same batch put there before.

    Totals of a batch are a folder of their own, so a batch that is repeated after a failure counts once.
    """
    (
        event_totals(batch).withColumn("batch", F.lit(batch_id))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(state)
    )


def roll_up_audit(spark: SparkSession, log_path: str, state: str, checkpoint: str) -> StreamingQuery:
    """Add all lines written since the last call to the totals by run, phase and level, then stop."""
    return (
        parse_audit(spark.readStream.text(log_path))
        .writeStream.foreachBatch(lambda batch, batch_id: merge_batch(batch, batch_id, state))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_roll_up(spark: SparkSession, state: str) -> DataFrame:
    """Totals over all batches."""
    return (
        spark.read.parquet(state)
        .groupBy("run_id", "phase", "level")
        .agg(F.sum("n_events").alias("n_events"), F.min("first_ts_utc").alias("first_ts_utc"), F.max("last_ts_utc").alias("last_ts_utc"))
    )
