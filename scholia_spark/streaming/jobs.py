"""Structured Streaming forms: message dispatch, watermarks, deduplication, windows. Sinks are keyed so that replays change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scholia_spark.operators.activity import advance_watermarks

KINDS = ("tick", "new", "update", "withdraw", "rebuild")


def parse_jobs(messages: DataFrame) -> DataFrame:
    """JSON messages become jobs; ``route`` is ok, dlq (never valid) or retry (valid, but its time has not come)."""
    job = F.from_json("body", "kind string, paper_id string, version int, not_before timestamp")
    df = messages.withColumn("job", job)
    bad = F.col("job").isNull() | F.col("job.kind").isNull() | ~F.col("job.kind").isin(*KINDS) | ((F.col("job.kind") != "tick") & F.col("job.paper_id").isNull()) | (F.coalesce("job.version", F.lit(1)) < 1)
    route = F.when(bad, "dlq").when(F.col("job.not_before") > F.current_timestamp(), "retry").otherwise("ok")
    return df.withColumn("route", route)


def dispatch(messages: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """One table a route; a batch overwrites only its own partition, so a replay is idempotent."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = parse_jobs(batch).select("message_id", "body", "route").withColumn("batch", F.lit(batch_id))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "route").parquet(folder)

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watermark_stream(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Per source the greatest time so far; each batch writes a new generation and reads the one before."""

    def write(batch: DataFrame, batch_id: int) -> None:
        now = batch.select("source", "ts").groupBy("source").agg(F.max("ts").alias("ts"))
        if batch_id:
            now = advance_watermarks(batch.sparkSession.read.parquet(f"{folder}/generation={batch_id - 1}"), now)
        now.write.mode("overwrite").parquet(f"{folder}/generation={batch_id}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(events: DataFrame, key: str = "event_id", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """First delivery of each key; state is dropped behind the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def counts_by_window(events: DataFrame, length: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """An addition: event counts in epoch-aligned windows with late rows accepted within the delay."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def telemetry_sink(events: DataFrame, folder: str, checkpoint: str, every: str = "10 seconds", once: bool = True) -> StreamingQuery:
    """Events in batches, one partition a batch, so a replayed batch replaces its own rows."""

    def ship(batch: DataFrame, batch_id: int) -> None:
        out = batch.withColumn("batch", F.lit(batch_id))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)

    writer = events.writeStream.foreachBatch(ship).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
