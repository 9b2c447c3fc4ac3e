"""The bounded source: planning, push-down, refusal, isolation and resumed backfills."""

import json
import math
import os
import re
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quakeloom.sources import bounded
from quakeloom.sources.bounded import Query

START, END = datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 1, 9, tzinfo=UTC)


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """4,000 events over eight days, a third of them within one hour."""
    hot = F.when(F.col("id") % 3 == 0, F.lit(200_000) + F.col("id")).otherwise(F.col("id") * 172)
    events = spark.range(4000).select(
        F.col("id").alias("event_id"),
        F.timestamp_micros(F.lit(int(START.timestamp() * 1e6)) + hot * 1_000_000 + F.col("id") % 7 * 1000).alias("event_time"),
        F.timestamp_micros(F.lit(int(END.timestamp() * 1e6))).alias("available_at"),
        (-59.0 + (F.col("id") * 7 % 430) / 10).alias("latitude"),
        (-81.0 + (F.col("id") * 11 % 180) / 10).alias("longitude"),
        F.when(F.col("id") % 5 > 0, F.lit(10.0)).alias("depth_km"),
        F.when(F.col("id") % 13 > 0, 3 + (F.col("id") * 29 % 400) / 100).alias("magnitude"),
        F.lit(" Mw ").alias("magnitude_type"),
    )
    url = "file://" + str(tmp_path_factory.mktemp("feed"))
    bounded.write_feed(events, url)
    return events, url


class Recording(bounded.FolderService):
    """Writes down its queries, and fails where a file says so."""

    def fetch(self, q):
        log = self.root + "/asked"
        with open(log, "a") as f:
            f.write(json.dumps(q.parameters()) + "\n")
        if os.path.exists(self.root + "/broken") and q.start <= START + timedelta(days=2) < q.end:
            raise OSError("no connection")
        return super().fetch(q)


SERVICE = f"{__name__}:Recording"


def asked(url):
    path = url.removeprefix("file://") + "/asked"
    rows = [json.loads(x) for x in open(path)] if os.path.exists(path) else []
    if rows:
        os.remove(path)
    return rows


def ids(df):
    return sorted(int(r.source_event_id) for r in df.select("source_event_id").collect())


def test_counts_are_read_in_both_forms():
    assert bounded.parse_count("2\n") == 2 and bounded.parse_count('{"count":2,"maxAllowed":20000}') == 2
    with pytest.raises(ValueError, match="integer count"):
        bounded.parse_count('{"maxAllowed":20000}')


def test_parameters_are_bounded():
    p = Query(START, END).parameters()
    assert (p["minlatitude"], p["maxlatitude"], p["minlongitude"], p["maxlongitude"]) == (-60, -15, -82, -62) and "minmagnitude" not in p
    with pytest.raises(ValueError, match="before"):
        bounded.plan_slices(lambda q: 0, Query(END, START))


@pytest.mark.parametrize("density", ["even", "swarm", "empty"])
def test_plan_covers_without_gaps(density):
    def count(q):
        hours = (q.end - q.start) / timedelta(hours=1)
        if density == "empty":
            return 0
        swarm = max(0.0, (min(q.end, START + timedelta(hours=60)) - max(q.start, START + timedelta(hours=48))) / timedelta(hours=1))
        return math.ceil(hours * 10 + (swarm * 900 if density == "swarm" else 0))

    plan = bounded.plan_slices(count, Query(START, END), 3000, timedelta(hours=1))
    assert plan[0].start == START and plan[-1].end == END and all(a.end == b.start for a, b in zip(plan, plan[1:], strict=False))
    assert all(count(q) <= 3000 for q in plan) and (density != "empty" or len(plan) == 1)
    if density == "swarm":
        with pytest.raises(RuntimeError, match="least length"):
            bounded.plan_slices(count, Query(START, END), 500, timedelta(hours=1))


def test_whole_read_and_counts(spark, feed):
    events, url = feed
    df = bounded.bounded_events(spark, url, START, END, slice_results=700, min_slice_hours=0.05)
    assert ids(df) == list(range(4000)) and df.select("slice_start").distinct().count() > 5
    assert df.groupBy("slice_start").count().agg(F.max("count")).first()[0] <= 700
    r = df.where("source_event_id = '14'").first()
    own = events.where("event_id = 14").first()
    assert (r.latitude, r.magnitude, r.magnitude_type) == (own.latitude, own.magnitude, "mw") and r.event_time == own.event_time


def test_filters_reach_the_service(spark, feed):
    events, url = feed
    asked(url)
    df = bounded.bounded_events(spark, url, START, END, service=SERVICE)
    lo, hi = START + timedelta(days=2), START + timedelta(days=3)
    cut = (F.col("event_time") >= F.lit(lo)) & (F.col("event_time") < F.lit(hi)) & (F.col("magnitude") >= 4.5) & (F.col("latitude") > -50) & (F.col("longitude") <= -70)
    got = df.where(cut)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "> -50.0" in plan and not re.search(r">= 4.5|<= -70|event_time#\d+ [<>]", plan)
    want = events.where(cut).select("event_id").collect()
    assert ids(got) == sorted(r.event_id for r in want) and len(want) > 20
    for p in asked(url):
        assert p["minmagnitude"] == 4.5 and p["maxlongitude"] == -70 and p["minlatitude"] == -50
        assert datetime.fromisoformat(p["starttime"]) >= lo and datetime.fromisoformat(p["endtime"]) <= hi
    assert ids(df.where("magnitude > 6.9 and event_time <= timestamp '2024-01-02 00:00:00+00'")) == sorted(r.event_id for r in events.where("magnitude > 6.9 and event_time <= timestamp '2024-01-02 00:00:00+00'").collect())
    assert df.where(F.col("event_time") < F.lit(START)).count() == 0


def test_too_large_a_query_is_refused(spark, feed):
    with pytest.raises(Exception, match="cut it below 500"):
        bounded.bounded_events(spark, feed[1], START, END, max_results=500).count()


def test_backfill_isolates_and_resumes(spark, feed, tmp_path):
    events, url = feed
    root = url.removeprefix("file://")
    table, ledger = f"file://{tmp_path}/events", f"file://{tmp_path}/ledger"
    run = lambda **more: bounded.backfill(spark, url, START, END, table, ledger, service=SERVICE, slice_results=700, min_slice_hours=0.05, backoff_s=0.01, **more).collect()
    open(root + "/broken", "w").close()
    asked(url)
    first = run()
    assert {r.status for r in first} == {"succeeded", "failed"} and sum(r.status == "failed" for r in first) == 1
    assert next(r.error for r in first if r.status == "failed") == "no connection"
    assert len(asked(url)) == len(first) - 1 + bounded.RETRIES  # the failed slice was tried again and again, the others once
    held = spark.read.parquet(table)
    assert held.count() == sum(r.events or 0 for r in first) < 4000
    os.remove(root + "/broken")
    second = run()
    assert [r.status for r in second] == ["succeeded"] and len(asked(url)) == 1  # the open slice only
    assert ids(spark.read.parquet(table)) == list(range(4000))
    assert run() == [] and asked(url) == []
    assert len(run(min_magnitude=5.0)) > 0 and spark.read.parquet(table).count() == 4000  # other bounds are other slices, events are held once
