"""Linkage as observations arrive: equal to the batch form in the same order, restarts, dropped state."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quakeloom.operators import linkage
from quakeloom.streaming import linkage as stream


def observations(spark, n=64, seed=4):
    """Several sources' reports of events that crowd in time and place, so that matches form chains."""
    r = np.random.default_rng(seed)
    event = r.integers(0, n // 4, n)
    t = pd.Timestamp("2024-03-01") + pd.to_timedelta(event * 6.0 + r.normal(0, 2.5, n), unit="s")
    df = pd.DataFrame({"event_id": np.arange(n), "source_id": r.choice(["a", "b", "c", "d"], n), "event_time": t, "available_at": t + pd.to_timedelta(r.integers(5, 400, n), unit="s"), "latitude": -30.0 + event % 3 * 0.02 + r.normal(0, 0.01, n), "longitude": -71.0 + r.normal(0, 0.01, n), "magnitude": np.where(r.random(n) < 0.2, np.nan, 5 + r.normal(0, 0.05, n)), "depth_km": np.where(r.random(n) < 0.2, np.nan, 30 + r.normal(0, 2, n))})
    rows = spark.createDataFrame(df.astype({"source_id": "str"}))
    none = lambda c: F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c)
    return rows.select("event_id", "source_id", "event_time", "available_at", "latitude", "longitude", none("magnitude"), none("depth_km"))


def land(df, folder, parts):
    """Writes the rows in their order of arrival, one file for each part."""
    rows = df.orderBy("available_at", "event_id").toPandas()
    for k, ids in enumerate(np.array_split(rows.event_id.to_numpy(), parts)):
        df.where(F.col("event_id").isin([int(x) for x in ids])).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def source(spark, folder):
    return spark.readStream.schema(stream.OBSERVATION).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def members(spark, folder):
    return {r.event_id: r.canonical_id for r in stream.read_members(spark, f"{folder}/members").collect()}


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_the_batch_form(spark, tmp_path, parts):
    df = observations(spark)
    land(df, tmp_path, parts)
    q = stream.link_stream(source(spark, tmp_path), f"{tmp_path}/members", f"{tmp_path}/check")
    q.awaitTermination()
    want = {r.event_id: r.canonical_id for r in linkage.canonical_events(df).collect()}
    assert members(spark, tmp_path) == want and len(set(want.values())) < 0.8 * len(want)


def test_restart_and_repeat(spark, tmp_path):
    df = observations(spark, 64, 9)
    order = df.orderBy("available_at", "event_id").select("event_id").toPandas().event_id.to_numpy()
    first, second = ([int(x) for x in p] for p in np.array_split(order, 2))
    for ids in (first, second):
        df.where(F.col("event_id").isin(ids)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream.link_stream(source(spark, tmp_path), f"{tmp_path}/members", f"{tmp_path}/check").awaitTermination()
        assert len(members(spark, tmp_path)) == (len(first) if ids is first else len(order))
    assert members(spark, tmp_path) == {r.event_id: r.canonical_id for r in linkage.canonical_events(df).collect()}
    stream.link_stream(source(spark, tmp_path), f"{tmp_path}/members", f"{tmp_path}/check").awaitTermination()
    assert stream.read_members(spark, f"{tmp_path}/members").count() == len(order)


def test_old_state_is_dropped(spark, tmp_path):
    """A report that comes later than ``keep_days`` founds an event of its own."""
    t = pd.Timestamp("2024-03-01 00:00:00")
    day = pd.Timedelta(days=1)
    rows = [(1, "a", t, t), (2, "b", t, t + day), (3, "a", t + 8 * day, t + 8 * day), (4, "a", t + 9 * day, t + 9 * day), (5, "c", t, t + 9.5 * day)]
    df = spark.createDataFrame([(i, s, e.to_pydatetime(), a.to_pydatetime(), -30.0, -71.0, 5.0, None) for i, s, e, a in rows], stream.OBSERVATION)
    land(df, tmp_path, 5)
    stream.link_stream(source(spark, tmp_path), f"{tmp_path}/members", f"{tmp_path}/check", keep_days=3.0).awaitTermination()
    assert members(spark, tmp_path) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
