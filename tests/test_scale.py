"""Claims of reviews about dense catalogs: whole results where many events share a time or a place."""

import math
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest

from pyspark.sql import functions as F

from quakeloom import queries
from quakeloom.functions import optim
from quakeloom.operators import grid, linkage
from quakeloom.sources import bounded


def test_a_place_counts_all_of_its_circle(spark):
    """Points just inside the circle count in every direction, also where it touches a box around it."""
    _, _, lat, lon = grid.PLACES[0]
    points = []
    for km, n in ((39.99, 360), (40.01, 360)):
        for k in range(n):
            d, a, p = km / 6371.0, math.radians(k), math.radians(lat)
            up = math.asin(math.sin(p) * math.cos(d) + math.cos(p) * math.sin(d) * math.cos(a))
            points.append((math.degrees(up), lon + math.degrees(math.atan2(math.sin(a) * math.sin(d) * math.cos(p), math.cos(d) - math.sin(p) * math.sin(up))), 1.0))
    got = grid.place_readout(spark.createDataFrame(points, "latitude double, longitude double, expected double")).where(F.col("place_id") == grid.PLACES[0][0]).first()
    assert (got.cells, got.expected) == (360, 360.0)


def test_simulated_catalogs_of_any_size(spark, tmp_path):
    """Sixty great events feed more than 50,000 events a week."""
    rows = spark.range(3060).selectExpr("id as event_id", "timestamp_ntz'2024-01-20 23:59:50' as ts", "id % 50 as user_id", "'click' as event_type", "if(id < 60, 1000D, 0D) as value", "'' as props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = queries.QUERIES["simulated_catalogs"](spark, str(tmp_path)).first()
    assert got.runs == 500 and got.q5 > 50_000


@pytest.mark.parametrize("n", [0, 1, 5, 300])
def test_batches_arrive_whole(spark, tmp_path, n):
    """Ranges that lie in one batch only leave no gap in the files that a trigger takes."""
    rows = spark.range(0, n, 1, 64).selectExpr("id as event_id", "timestamp_seconds(1700000000 + id) as available_at")
    seen = []
    q = queries.arriving(spark, rows, 2).writeStream.foreachBatch(lambda b, _: seen.append(sorted(r.event_id for r in b.collect()))).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination()
    size = max(1, -(-n // 2))
    assert [b for b in seen if b] == [list(range(k, min(n, k + size))) for k in range(0, n, size)]


def test_a_count_reads_each_slot_once(spark, tmp_path, monkeypatch):
    """Counts that cut slots are right, and don't read one for each tenth of a magnitude or each count."""
    rows = spark.range(3000).selectExpr("id as event_id", "timestamp_millis(1704067200000 + id * 60000) as event_time", "timestamp_millis(1704067200000) as available_at", "-30D as latitude", "-70D as longitude", "1D as depth_km", "if(id % 7 = 0, null, 3 + id % 400 / 100) as magnitude", "'mw' as magnitude_type")
    bounded.write_feed(rows, f"file://{tmp_path}")
    read, real = [], bounded.FolderService._lines
    monkeypatch.setattr(bounded.FolderService, "_lines", lambda self, folder: read.append(folder) or real(self, folder))
    service = bounded.FolderService(f"file://{tmp_path}")
    day = datetime(2024, 1, 1, tzinfo=UTC)
    for lo, hi in ((0, 3000), (10, 20), (100, 2000), (1440, 2880), (1439, 1441), (2990, 9000), (-50, 5)):
        for least in (None, 4.55):
            q = bounded.Query(day + timedelta(minutes=lo), day + timedelta(minutes=hi), min_magnitude=least)
            known = [3 + k % 400 / 100 if k % 7 else None for k in range(max(lo, 0), min(hi, 3000))]
            want = len(known) if least is None else sum(m is not None and math.floor(m * 10) >= 45 for m in known)
            assert bounded.parse_count(service.count(q)) == want
    assert len(read) <= 4


def test_dense_catalogs_are_read_whole(spark, tmp_path):
    """More events in six hours than a slice may hold."""
    rows = spark.range(40_000).selectExpr("id as event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(id % 20000 as decimal(18, 6))) as ts", "id % 1500 as user_id", "'click' as event_type", "id % 500 + 0.5D as value", "'' as props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    held = queries.catalog(spark, str(tmp_path)).where("latitude between -60 and -15 and longitude between -82 and -62").count()
    got = queries.QUERIES["bounded_scan"](spark, str(tmp_path))
    assert got.count() == got.select("source_event_id").distinct().count() == held > 30_000


@pytest.mark.parametrize("seconds", [300, 4])
def test_automatic_matches_are_those_of_all_candidates(spark, seconds):
    """Times and positions up to the edge of what a match allows, nulls among them."""
    at = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(id * 37 % 1201 / 100 as decimal(18, 6)))"
    rows = spark.range(600).selectExpr("id as event_id", f"{at} as event_time", "if(id % 50 = 3, null, -30 + id * 13 % 140 / 1000) as latitude", "-71 + id * 7 % 30 / 1000 as longitude", "if(id % 11 = 0, null, 5D) as magnitude", "if(id % 7 = 0, null, 30 + id % 3) as depth_km")
    other = rows.withColumnRenamed("event_id", "other_id")
    want = linkage.link_candidates(rows, other, seconds).where("decision = 'auto_match'")
    got = linkage.auto_matches(rows, other, seconds)
    assert got.count() == want.count() > 10_000 and got.exceptAll(want).isEmpty()


def test_canonical_events_compare_few_pairs(spark, monkeypatch):
    """Observations of ten seconds all over a region are not all compared, though all lie within the window."""
    rows = spark.range(4000).selectExpr("id as event_id", "cast(id % 2 as string) as source_id", "timestamp_micros(1700000000000000 + id * 2500) as event_time", "timestamp_seconds(1700000100) as available_at", "-60 + id * 7919 % 4500 / 100 as latitude", "-82 + id * 10473 % 2000 / 100 as longitude", "5D as magnitude", "30D as depth_km")
    scored, real = [], linkage._scored
    monkeypatch.setattr(linkage, "_scored", lambda pairs: scored.append(pairs.count()) or real(pairs))
    linkage.canonical_events(rows).count()
    assert sum(scored) < 0.03 * 4000 * 4000


def test_shorter_steps_are_tried_where_the_whole_one_fails():
    """The same minima from fewer points."""

    def bowls(x, which):
        seen.append(len(x))
        centre = np.array([[1.0, 2.0], [3.0, 0.5]])[which]
        return ((x - centre) ** 2 * [1.0, 50.0]).sum(axis=1), 2 * (x - centre) * [1.0, 50.0]

    found, counts = [], []
    for first in (False, True):
        seen = []
        x, value, ok = optim.minimize_batch(bowls, [[2.0, 2.0], [2.0, 2.0]], [0.0, 0.0], [5.0, 5.0], whole_first=first)
        assert ok.all() and value.max() < 1e-5
        found.append(x)
        counts.append(sum(seen))
    assert np.allclose(found[0], found[1], atol=2e-3) and counts[1] < 0.7 * counts[0]
