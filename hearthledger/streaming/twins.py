"""Structured Streaming twins of the keyed-state operators. Each equals its batch form on the same input.

Watermarks are parameters: the repeat guard keeps two hours of keys, sessions close half an hour after their
last event. Rows later than the watermark are dropped; the batch forms in hearthledger.operators.state are the
oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """A stream of event files; event time as an instant, which watermarks need."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def latest_state(events: DataFrame) -> DataFrame:
    """user_id, state, ts: for output mode ``complete`` or ``update``."""
    top = F.max(F.struct("ts", "event_id", "event_type")).alias("t")
    return events.groupBy("user_id").agg(top).select("user_id", F.col("t.event_type").alias("state"), F.col("t.ts").alias("ts"))


def first_claims(events: DataFrame, hold: str = "2 hours") -> DataFrame:
    """One event of a (user, type) within the watermark's reach: the repeat guard as a deduplicating filter."""
    return events.withWatermark("ts", hold).dropDuplicatesWithinWatermark(["user_id", "event_type"])


def silent_sessions(events: DataFrame, silence: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """A row when a user has been silent for ``silence``: the closing of a session is the watchdog's alarm."""
    window = F.session_window("ts", silence)
    return events.withWatermark("ts", lateness).groupBy("user_id", window.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("silent_at"), "n")


def hourly_values(events: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Tumbling hours by type."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def run_available(stream: DataFrame, sink_path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what is there, once and restartable, into Parquet (append) files."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink_path)
    query.awaitTermination()
    return query


def replace_latest(stream: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the newest state of each user as a table: every batch writes a new version beside the last."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_path}/epoch={epoch}")

    query = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
