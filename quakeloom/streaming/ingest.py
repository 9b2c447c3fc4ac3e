"""Incremental ingest and replay with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.catalog import append_if_absent


def landing_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a landing folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(stream: DataFrame, table_path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Appends rows whose key the table lacks; a batch that is run again adds nothing, late rows are kept."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            held = spark.read.schema(batch.schema).parquet(table_path)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            held = spark.createDataFrame([], batch.schema)
        append_if_absent(batch, held, keys).write.mode("append").parquet(table_path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_counts(stream: DataFrame, time: str = "available_at", width: str = "7 days", delay: str = "1 day") -> DataFrame:
    """Events per window of their availability; state is dropped behind the watermark."""
    t = F.col(time).cast("timestamp")
    return stream.withColumn("__t", t).withWatermark("__t", delay).groupBy(F.window("__t", width)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "n")


def hopping_counts(stream: DataFrame, time: str = "available_at", width: str = "7 days", step: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Events per window of ``width`` that begins at every ``step``: an event counts in each one it lies in."""
    t = F.col(time).cast("timestamp")
    return stream.withColumn("__t", t).withWatermark("__t", delay).groupBy(F.window("__t", width, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "n")


def deduplicated(stream: DataFrame, keys: list[str], time: str = "available_at", delay: str = "1 day") -> DataFrame:
    return stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", delay).dropDuplicatesWithinWatermark(keys).drop("__t")


def replay(events: DataFrame) -> DataFrame:
    """Events in the order in which they became known."""
    return events.orderBy("available_at", "event_id")


def notify(batch: DataFrame, seen_path: str, send: Callable[[list], None], now: Column, most: int = 3, max_age: str = "2 hours") -> int:
    """One run over the events at hand: sends up to ``most`` unseen ones, oldest first, each id once.

    What is over the limit stays unseen for the next run. Events older than ``max_age`` at ``now`` are
    marked without being sent, and the first run only marks what is there."""
    spark = batch.sparkSession
    known = batch.where("event_id is not null").dropDuplicates(["event_id"])
    try:
        seen = spark.read.schema("event_id long").parquet(seen_path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known.select("event_id").write.mode("append").parquet(seen_path)
        return 0
    fresh = known.join(seen.distinct(), "event_id", "left_anti")
    old = F.coalesce(F.col("event_time") < now - F.expr(f"interval {max_age}"), F.lit(False))
    sent = fresh.where(~old).orderBy("event_time", "event_id").limit(most).collect()
    send(sent)
    # ids of this run in one file: those that were sent, and those that are too old
    told = spark.createDataFrame([(r.event_id,) for r in sent], "event_id long")
    fresh.where(old).select("event_id").unionByName(told).write.mode("append").parquet(seen_path)
    return len(sent)


def notifications(stream: DataFrame, pending_path: str, seen_path: str, checkpoint: str, send: Callable[[list], None], now: Column | None = None, most: int = 3) -> StreamingQuery:
    """``notify`` after each batch of a stream, over all events that arrived and wait in ``pending_path``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{pending_path}/batch={batch_id}")
        pending = batch.sparkSession.read.schema(batch.schema).parquet(pending_path)
        notify(pending, seen_path, send, F.current_timestamp() if now is None else now, most)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
