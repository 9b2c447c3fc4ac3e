"""Linking observations to canonical events as they arrive.

Two steps. A stateful operator keyed by buckets of event time and latitude holds the observations of its
bucket; an arriving one is kept in its own bucket and compared in every bucket that its reach touches, so
each pair of automatic matches comes out once. A timer drops a bucket once no observation of its time is
expected any more. Each batch's new observations are then settled in order, against the members that
earlier batches have written, by the same rounds of joins as the batch form.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.linkage import AUTO, DEPTH_KM, DISTANCE_KM, MAGNITUDE, TIME_S, settle

OBSERVATION = "event_id long, source_id string, event_time timestamp, available_at timestamp, latitude double, longitude double, magnitude double, depth_km double"
#: Width of a bucket; most that an automatic match can be apart in time, and in degrees of latitude.
BUCKET_S, BUCKET_DEG = 1800.0, 5.0
REACH_S = TIME_S * math.sqrt(-2 * math.log(AUTO)) * 1.000001
REACH_DEG = math.degrees(DISTANCE_KM * math.sqrt(-math.log(AUTO)) / 6371.0088) * 1.000001
#: Days after an event's time in which its observations may still arrive.
KEEP_DAYS = 7.0
_HELD = "event_id long, source_id string, t double, arrived double, latitude double, longitude double, magnitude double, depth_km double"
_COLUMNS = [f.split()[0] for f in _HELD.split(", ")]
MATCH = "event_id long, source_id string, arrived double, other_id long, probability double"
_KINDS = {"event_id": "int64", "source_id": "object", "arrived": "float64", "other_id": "Int64", "probability": "Float64"}
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def match_probability(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """The linkage score of each row of ``a`` with the row of ``b`` beside it."""
    at = lambda x, k: x[k].to_numpy(float)
    gap = lambda k: np.abs(at(a, k) - at(b, k))
    p, q = np.radians(at(a, "latitude")), np.radians(at(b, "latitude"))
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(at(b, "longitude") - at(a, "longitude")) / 2) ** 2
    km = 2 * 6371.0088 * np.arcsin(np.sqrt(np.minimum(h, 1.0)))
    total = (gap("t") / TIME_S) ** 2 + 2 * (km / DISTANCE_KM) ** 2
    for k, scale in (("magnitude", MAGNITUDE), ("depth_km", DEPTH_KM)):
        total = total + np.nan_to_num((gap(k) / scale) ** 2)
    return np.exp(-0.5 * total)


def near_pairs(new: pd.DataFrame, known: pd.DataFrame, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of ``new``, row of ``known``) of the pairs within reach in time, about ``most`` at once."""
    order = np.argsort(known.t.to_numpy(float), kind="stable")
    t, mine = known.t.to_numpy(float)[order], new.t.to_numpy(float)
    lo, hi = np.searchsorted(t, mine - REACH_S), np.searchsorted(t, mine + REACH_S, "right")
    ends, a = np.cumsum(hi - lo), 0
    while a < len(new):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        n = (hi - lo)[a:z]
        yield np.repeat(np.arange(a, z), n), order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[a:z], n)]
        a = z


class Matcher(StatefulProcessor):
    """Holds a bucket's observations; emits (later, earlier) for each automatic match.

    What an earlier batch brought is earlier; within a batch the order is that of (available_at, event_id)."""

    def __init__(self, keep_days: float):
        self.keep_ms = int(keep_days * 86_400_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _HELD)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        old = pd.DataFrame(list(self.held.get()), columns=_COLUMNS)
        home = new[new.home]
        if len(home):
            self.held.appendList([tuple(None if pd.isna(x) else x for x in r) for r in home[_COLUMNS].astype(object).itertuples(index=False)])
            if not len(old):
                self.handle.registerTimer(int((key[0] + 1) * BUCKET_S * 1000) + self.keep_ms)
        out = []
        for known, before in ((old, True), (home, False)):
            if not len(known) or not len(new):
                continue
            for i, j in near_pairs(new, known):
                x, y = new.iloc[i], known.iloc[j]
                p = match_probability(x, y)
                good = (p >= AUTO) & (x.event_id.to_numpy() != y.event_id.to_numpy())
                if not before:
                    early, late = y.arrived.to_numpy(float), x.arrived.to_numpy(float)
                    good &= (early < late) | ((early == late) & (y.event_id.to_numpy(np.int64) < x.event_id.to_numpy(np.int64)))
                x, y = x[good], y[good]
                out.append(pd.DataFrame({"event_id": x.event_id.to_numpy(), "source_id": x.source_id.to_numpy(), "arrived": x.arrived.to_numpy(), "other_id": y.event_id.to_numpy(), "probability": p[good]}))
        # every observation comes out once, from its own bucket, so that the batch knows all its rows
        out.append(pd.DataFrame({"event_id": home.event_id, "source_id": home.source_id, "arrived": home.arrived, "other_id": pd.NA, "probability": pd.NA}))
        yield pd.concat([x.astype(_KINDS) for x in out], ignore_index=True)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield pd.DataFrame({"event_id": [], "source_id": [], "arrived": [], "other_id": [], "probability": []}).astype(_KINDS)

    def close(self) -> None:
        return


def matches(observations: DataFrame, keep_days: float = KEEP_DAYS) -> DataFrame:
    """A stream of observations as (event_id, source_id, arrived, other_id, probability): a row for each
    automatic match with an earlier one, and a row without ``other_id`` for each observation.

    Observations without time or latitude match nothing and are dropped here. The stream's clock is
    ``available_at``; rows must come in its order, as a replay gives them."""
    t, arrived = (F.unix_micros(F.col(c).cast("timestamp")) / 1e6 for c in ("event_time", "available_at"))
    rows = observations.withColumn("clock", F.col("available_at").cast("timestamp")).withWatermark("clock", "0 seconds")
    rows = rows.withColumns({"t": t, "arrived": arrived}).where("t is not null and latitude is not null and event_id is not null")
    span = lambda c, width, reach: F.sequence(F.floor((F.col(c) - reach) / width), F.floor((F.col(c) + reach) / width))
    rows = rows.withColumn("tb", F.explode(span("t", BUCKET_S, REACH_S))).withColumn("lb", F.explode(span("latitude", BUCKET_DEG, REACH_DEG)))
    home = (F.col("tb") == F.floor(F.col("t") / BUCKET_S)) & (F.col("lb") == F.floor(F.col("latitude") / BUCKET_DEG))
    rows = rows.select("clock", "tb", "lb", home.alias("home"), *_COLUMNS)
    return rows.groupBy("tb", "lb").transformWithStateInPandas(Matcher(keep_days), MATCH, "Append", "EventTime")


def link_stream(observations: DataFrame, members: str, checkpoint: str, keep_days: float = KEEP_DAYS) -> StreamingQuery:
    """Appends (event_id, source_id, canonical_id, arrived) of each batch to the folder ``members``.

    Rows of a batch lie in a folder of their own that is written over if the batch is run again, so a
    restart neither loses nor doubles any. Of the members before, those are read that arrived since the
    oldest state that can still match."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        try:
            nodes = rows.where("other_id is null").select("event_id", "source_id", F.struct("arrived", "event_id").alias("place"), "arrived")
            links = rows.where("other_id is not null").select("event_id", "source_id", F.struct("arrived", "event_id").alias("place"), "other_id", "probability")
            held = read_members(spark, members).where(F.col("batch") < number)
            since = rows.agg(F.min("arrived")).first()[0]
            if since is not None:
                held = held.where(F.col("arrived") >= since - 2 * keep_days * 86_400)
            near = links.select(F.col("other_id").alias("event_id")).distinct()
            touched = held.join(near, "event_id", "left_semi").select("canonical_id").distinct()
            done = settle(nodes.drop("arrived"), links, held.join(touched, "canonical_id", "left_semi").select("event_id", "source_id", "canonical_id"))
            nodes.select("event_id", "arrived").join(done, "event_id").select("event_id", "source_id", "canonical_id", "arrived").write.mode("overwrite").parquet(f"{members}/batch={number}")
        finally:
            rows.unpersist()

    spark = observations.sparkSession
    before = spark.conf.get(*PROVIDER)
    spark.conf.set(*PROVIDER)
    try:
        return matches(observations, keep_days).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER[0], before)


def read_members(spark: SparkSession, members: str) -> DataFrame:
    """(event_id, source_id, canonical_id, arrived, batch) of all batches; empty before the first one."""
    schema = "event_id long, source_id string, canonical_id long, arrived double"
    try:
        return spark.read.schema(f"{schema}, batch long").parquet(members)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{schema}, batch long")
