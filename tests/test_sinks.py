"""Archives and claims, manifests, exact quantiles, bootstraps, replay clocks and hopping windows."""

import hashlib
import math
import os
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quakeloom.operators import catalog, scoring
from quakeloom.operators.quantiles import exact_quantiles
from quakeloom.sources import sinks
from quakeloom.streaming import clock, ingest


def test_archive_never_overwrites(spark, tmp_path):
    url = "file://" + str(tmp_path / "raw")
    rows = [("a", b"one", "application/json"), ("a", b"one", "text/html"), ("b", b"one", "text/csv"), ("a", b"", None), (None, b"x", None), ("a", None, None)]
    df = spark.createDataFrame(rows, "source string, content binary, media_type string")
    first = {(r.source, r.sha256): r for r in sinks.write_archive(df, url).collect()}
    sha = hashlib.sha256(b"one").hexdigest()
    assert set(first) == {("a", sha), ("b", sha), ("a", hashlib.sha256(b"").hexdigest())} and all(r.written for r in first.values())
    r = first["b", sha]
    assert r.uri == f"{url}/b/{sha[:2]}/{sha[2:4]}/{sha}.csv" and r.byte_length == 3
    path = r.uri.removeprefix("file://")
    stamp = os.stat(path).st_mtime_ns
    again = sinks.write_archive(df, url).collect()
    assert not any(r.written for r in again) and os.stat(path).st_mtime_ns == stamp
    assert sorted((r.source, bytes(r.content)) for r in sinks.read_archive(spark, url).collect()) == [("a", b"one"), ("b", b"one")]
    assert not [f for _, _, names in os.walk(tmp_path) for f in names if f.endswith(".tmp")]
    with open(path, "wb") as f:
        f.write(b"other")
    with pytest.raises(Exception, match="differs from its name"):
        sinks.read_archive(spark, url).collect()


def test_one_of_several_writers_wins(tmp_path):
    from pyarrow import fs

    with ThreadPoolExecutor(16) as pool:
        won = list(pool.map(lambda k: sinks.create_once(fs.LocalFileSystem(), str(tmp_path / "d" / "claim"), str(k).encode()), range(64)))
    assert sum(won) == 1 and (tmp_path / "d" / "claim").read_bytes() == str(won.index(True)).encode()


def test_issuers_at_once_append_once(spark, tmp_path):
    req = spark.createDataFrame([("etas", k) for k in range(20)] + [("etas", 3)], "model string, hour int")
    table, claims = str(tmp_path / "runs"), "file://" + str(tmp_path / "claims")
    with ThreadPoolExecutor(4) as pool:
        made = [f.result().count() for f in [pool.submit(sinks.issue_once, req, table, claims, ["model", "hour"]) for _ in range(4)]]
    assert sum(made) == 20 and sorted(r.hour for r in spark.read.parquet(table).collect()) == list(range(20))
    assert sinks.issue_once(req, table, claims, ["model", "hour"]).count() == 0


def test_an_issuer_that_died_goes_on(spark, tmp_path, monkeypatch):
    req = spark.createDataFrame([("m", 1), ("m", 2)], "model string, hour int")
    table, claims = str(tmp_path / "runs"), "file://" + str(tmp_path / "claims")
    real = sinks.materialize

    def dies(df, name):
        real(df, name).count()
        raise OSError("lost")

    monkeypatch.setattr(sinks, "materialize", dies)
    with pytest.raises(OSError):
        sinks.issue_once(req, table, claims, ["model", "hour"], issuer="one")
    monkeypatch.setattr(sinks, "materialize", real)
    assert sinks.issue_once(req, table, claims, ["model", "hour"], issuer="two").count() == 0
    assert sinks.issue_once(req, table, claims, ["model", "hour"], issuer="one").count() == 2
    assert sinks.issue_once(req, table, claims, ["model", "hour"], issuer="one").count() == 0


@pytest.mark.parametrize("leaf", [3, 5, 1000])
def test_manifest_is_a_merkle_root(spark, leaf):
    rows = [(k * 7 % 101, "ab"[k % 2] if k % 5 else None) for k in range(101)] + [(None, "a")]
    df = spark.createDataFrame(rows, "event_id long, source_id string").repartition(4)

    def digest(ids):
        entries = [str(i) for i in sorted(ids)]
        while len(entries) > leaf:
            entries = [hashlib.sha256(",".join(entries[k : k + leaf]).encode()).hexdigest() for k in range(0, len(entries), leaf)]
        return hashlib.sha256(("then|" + ",".join(entries)).encode()).hexdigest()

    for r in catalog.manifest(df, "then", leaf).collect():
        ids = [i for i, s in rows if s == r.source_id and i is not None]
        assert r.digest == digest(ids) and r.revisions == len(ids) + (r.source_id == "a")
    assert catalog.manifest(df.limit(0), "then").count() == 0


@pytest.mark.parametrize("kind", ["normal", "ties", "wide", "one"])
def test_exact_quantiles(spark, kind):
    r = np.random.default_rng(4)
    x = {"normal": r.normal(0, 1, 40_000), "ties": np.repeat([1.0, 2.0, 2.5], [10, 30_000, 7]), "wide": np.concatenate([10.0 ** r.uniform(-300, 300, 3000), -(10.0 ** r.uniform(-300, 300, 3000)), [1.7e308, -1.7e308, 0.0]]), "one": np.array([3.5])}[kind]
    q = [0.0, 0.05, 0.5, 0.975, 1.0]
    df = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(5)
    got = list(exact_quantiles(df, [], "x", q).first())
    s, want = np.sort(x), []
    for p in q:
        a, z = s[math.floor(p * (len(s) - 1))], s[math.ceil(p * (len(s) - 1))]
        want.append(a if a == z else a + (z - a) * (p * (len(s) - 1) - math.floor(p * (len(s) - 1))))
    assert got == want


def test_exact_quantiles_by_group(spark):
    rows = [(g, float(k)) for g, n in (("a", 11), ("b", 2), (None, 4)) for k in range(n)] + [("c", None), ("d", float("nan")), ("a", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    assert {r.g: (r.q0, r.q1) for r in exact_quantiles(df, ["g"], "x", [0.5, 0.9]).collect()} == {"a": (5.0, 9.0), "b": (0.5, 0.9), None: (1.5, pytest.approx(2.7))}
    assert exact_quantiles(df.limit(0), ["g"], "x", [0.5]).count() == 0 and exact_quantiles(df.limit(0), [], "x", [0.5]).count() == 0
    many = spark.range(3000).select(F.col("id").alias("g"), F.col("id").cast("double").alias("x"))
    assert exact_quantiles(many, ["g"], "x", [0.5]).where("g = q0").count() == 3000


def test_bootstrap_of_many_folds(spark):
    """A million folds stay where they are; the interval is that of the mean's normal law."""
    df = spark.range(1_000_000).select((F.randn(5) * 2 + 1).alias("x"))
    mean, low, high = scoring.bootstrap_mean(df, "x", 400).first()
    at = df.agg(F.avg("x"), F.stddev("x")).first()
    wide = 1.96 * at[1] / 1000
    assert abs(mean - at[0]) < 1e-9 and abs(low - (mean - wide)) < 0.25 * wide and abs(high - (mean + wide)) < 0.25 * wide
    tied = spark.createDataFrame([(1.0,)] * 30 + [(3.0,)] * 10 + [(None,)], "x double")
    mean, low, high = scoring.bootstrap_mean(tied, "x", 2000).first()
    assert mean == 1.5 and abs(low - 1.25) <= 0.051 and abs(high - 1.8) <= 0.051
    assert tuple(scoring.bootstrap_mean(tied.limit(1), "x").first()) == (1.0, None, None) and scoring.bootstrap_mean(tied.limit(0), "x").first().mean is None


SOURCE = "source_id string, event_id long, event_time timestamp, available_at timestamp"


def land(spark, folder, rows):
    t = pd.Timestamp("2026-01-01")
    at = lambda h: (t + pd.Timedelta(hours=h)).to_pydatetime()
    spark.createDataFrame([(s, i, at(e), None if a is None else at(a)) for s, i, e, a in rows], SOURCE).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def replayed(spark, folder):
    q = clock.start_replay(spark.readStream.schema(SOURCE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/check")
    q.awaitTermination()
    return [(r.source_id, r.step, r.event_id) for r in spark.read.parquet(f"{folder}/out").orderBy("source_id", "step").collect()]


def test_replay_is_by_availability_and_the_clock_never_goes_back(spark, tmp_path):
    land(spark, tmp_path, [("a", 1, 1, 4), ("a", 2, 2, 3), ("b", 9, 0, 30), ("a", 7, 1, None), (None, 8, 1, 1)])
    assert replayed(spark, tmp_path) == [("a", 1, 2), ("a", 2, 1), ("b", 1, 9)]
    land(spark, tmp_path, [("a", 3, 0, 5), ("a", 4, 4, 4)])  # a late report of the first hour shows at five
    assert replayed(spark, tmp_path)[:4] == [("a", 1, 2), ("a", 2, 1), ("a", 3, 4), ("a", 4, 3)]
    land(spark, tmp_path, [("a", 5, 0, 2)])
    with pytest.raises(Exception, match="can't go back"):
        replayed(spark, tmp_path)


def test_hopping_windows_on_a_stream(spark, tmp_path):
    land(spark, tmp_path, [("a", k, 0, 5 * k) for k in range(20)])
    land(spark, tmp_path, [("a", 99, 0, 2000)])
    s = spark.readStream.schema(SOURCE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = ingest.hopping_counts(s, width="2 days", step="1 day", delay="0 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {int((r.start - pd.Timestamp("2026-01-01")).total_seconds() // 86400): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {d: sum(24 * d <= 5 * k < 24 * d + 48 for k in range(20)) for d in range(-1, 4)}
    assert got == {d: n for d, n in want.items() if n}
