"""Replay on a stream: a clock for each source that moves forward only."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .linkage import PROVIDER

STEP = "source_id string, event_id long, event_time timestamp, available_at timestamp, step long"


class Clock(StatefulProcessor):
    """Emits a source's rows in the order of (available_at, event_id), numbered; its clock stands at the last.

    A row that became available before the clock is an error: it would have to be seen in the past."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "at long, step long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values(["at", "event_id"], kind="stable")
        at, step = self.now.get() if self.now.exists() else (None, 0)
        first, last = int(new["at"].iloc[0]), int(new["at"].iloc[-1])
        if at is not None and first < at:
            raise ValueError(f"the clock of {key[0]} can't go back from {at} to {first}")
        self.now.update((last, step + len(new)))
        yield pd.DataFrame({"source_id": key[0], "event_id": new.event_id, "event_time": new.event_time, "available_at": new.available_at, "step": range(step + 1, step + len(new) + 1)})

    def close(self) -> None:
        return


def replay_stream(events: DataFrame) -> DataFrame:
    """A stream of (source_id, event_id, event_time, available_at) as each source's steps of a replay.

    An event shows when it became available, not when it happened: a late report comes after all that was
    known before it. Rows without a source or an ``available_at`` never show."""
    rows = events.select("source_id", "event_id", F.col("event_time").cast("timestamp").alias("event_time"), F.col("available_at").cast("timestamp").alias("available_at")).where("source_id is not null and available_at is not null")
    rows = rows.withColumn("at", F.unix_micros("available_at"))
    return rows.groupBy("source_id").transformWithStateInPandas(Clock(), STEP, "Append", "None")


def start_replay(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the steps of ``replay_stream`` to a Parquet folder, from where the checkpoint stands."""
    spark = events.sparkSession
    before = spark.conf.get(*PROVIDER)
    spark.conf.set(*PROVIDER)
    try:
        return replay_stream(events).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER[0], before)
