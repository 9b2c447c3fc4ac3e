"""Policies, registries, pinned assets, and samples of what was known."""

import hashlib
import os
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from quakeloom.operators import catalog, grid
from quakeloom.sources import assets, policies


def put(folder, name, text):
    path = folder / name
    path.write_text(text)
    return "file://" + str(path)


def test_policies(spark, tmp_path):
    c = policies.CompletenessPolicy.read(spark, put(tmp_path, "c.yaml", "version: 3\nbin_width_magnitude: 0.2\nrestrictions: {publish: false}\n"))
    assert c.bin_width_magnitude == 0.2 and c.research_only_minimum_events == 50
    s = policies.ForecastSpecification.read(spark, put(tmp_path, "f.yaml", "version: 1\nstatus: draft\ngrid: {id: g1}\nhorizons:\n  - {id: P1D, seconds: 86400}\nmagnitude_bins:\n  - {lower: 3, upper: 5}\n  - {lower: 5, upper: null, status: experimental}\n"))
    assert s.seconds("P1D") == 86400.0 and s.bins == ((3.0, 5.0, "active"), (5.0, None, "experimental"))
    assert s.reject_threshold_below_mc and s.stale_data_action == "not_estimable"
    with pytest.raises(ValueError, match="P9D"):
        s.seconds("P9D")
    events = spark.createDataFrame([(1, 2.9), (2, 3.0), (3, 5.0), (4, 9.0), (5, None)], "event_id long, magnitude double")
    assert {r.event_id: r.bin for r in grid.assign_bins(events, s.bounds()).collect()} == {2: 0, 3: 1, 4: 1}
    with pytest.raises(ValueError, match="mapping"):
        policies.CompletenessPolicy.read(spark, put(tmp_path, "list.yaml", "- 1\n"))


def test_classifier_policy_takes_effect(spark, tmp_path):
    strict = policies.ClassifierPolicy.read(spark, put(tmp_path, "t.yaml", "minimum_label_probability: 0.99\ninterface_half_width_km: 12.5\n"))
    assert strict.interface_half_width_km == 12.5 and strict.maximum_crustal_depth_km == 50.0
    events = spark.createDataFrame([(10.0, 80.0), (30.0, 32.0)], "depth_km double, slab_depth double")
    usual, narrow = grid.classify(events).collect(), grid.classify(events, strict).collect()
    assert narrow[1].label == "unknown" and narrow[1].interface > usual[1].interface


SOURCE = "{id: a, authority: x, role: event_catalog, license: l, stability: high, enabled: true, endpoints: [{kind: feed}, {kind: html}], note: n}"
ASSET = "{type: depth, filename: d.grd, url: 'mem:d', byte_length: 3, sha256: %s}" % ("a" * 64)


def test_registries(spark, tmp_path):
    head = "version: 1\nreviewed_at: 2026-01-01T00:00:00Z\n"
    got = policies.source_registry(spark, put(tmp_path, "s.yaml", f"{head}sources:\n  - {SOURCE}\n  - {SOURCE.replace('id: a', 'id: b').replace('true', 'false')}\n")).orderBy("position").collect()
    assert [(r.source_id, r.enabled, r.endpoints) for r in got] == [("a", True, ["feed", "html"]), ("b", False, ["feed", "html"])]
    with pytest.raises(ValueError, match="license"):
        policies.source_registry(spark, put(tmp_path, "s2.yaml", f"{head}sources:\n  - {SOURCE.replace('license: l, ', '')}\n"))
    with pytest.raises(ValueError, match="extra"):
        policies.source_registry(spark, put(tmp_path, "s3.yaml", f"{head}extra: 1\nsources: []\n"))
    release = "  - {id: %s, source_id: a, assets: [%s]}\n"
    got = policies.asset_registry(spark, put(tmp_path, "r.yaml", f"{head}releases:\n{release % ('r1', ASSET)}")).collect()
    assert [(r.release_id, r.name, r.bytes) for r in got] == [("r1", "d.grd", 3)]
    for bad, why in ((release % ("r1", ASSET) * 2, "ids"), (release % ("r1", ASSET + ", " + ASSET), "types"), (release % ("r1", ASSET.replace("a" * 64, "A" * 64)), "digest"), (release % ("r1", ASSET.replace(": 3", ": 0")), "length")):
        with pytest.raises(ValueError, match=why):
            policies.asset_registry(spark, put(tmp_path, f"bad-{why}.yaml", f"{head}releases:\n{bad}"))


def test_retries():
    def failing(*errors):
        left = list(errors)
        return lambda: "ok" if not left else (_ for _ in ()).throw(left.pop(0))

    waits = []
    assert assets.with_retries(failing(assets.Refused(503), ConnectionError(), assets.Refused(429)), sleep=waits.append) == ("ok", 4, None)
    assert waits == [0.5, 1.0, 2.0]
    for error, tries in ((assets.Refused(404), 1), (ValueError("x"), 1), (assets.Refused(408), 4), (TimeoutError(), 4)):
        result, n, e = assets.with_retries(failing(*[error] * 9), sleep=lambda s: None)
        assert (result, n) == (None, tries) and e is error
    waits.clear()
    assets.with_retries(failing(*[ConnectionError()] * 9), attempts=8, sleep=waits.append)
    assert max(waits) == 8.0


def test_assets_are_acquired_once(spark, tmp_path):
    calls, store = str(tmp_path / "calls"), "file://" + str(tmp_path / "store")
    os.mkdir(calls)

    def fetch(url):
        n = len([x for x in os.listdir(calls) if x.startswith(url + ".")])
        open(f"{calls}/{url}.{n}", "x").close()
        if url == "gone":
            raise assets.Refused(404)
        if url == "busy" and n < 2:
            raise assets.Refused(503)
        return url.encode()

    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [("fine", "fine", 4, digest("fine").upper()), ("again", "fine", 4, digest("fine")), ("busy", "busy", 4, digest("busy")), ("gone", "gone", 4, digest("gone")), ("short", "short", 9, digest("short")), ("other", "other", 5, digest("fine!")), ("none", None, 5, digest("none"))]
    table = spark.createDataFrame(rows, "name string, url string, bytes long, sha256 string").withColumn("status", F.lit("x"))
    got = {r.name: r for r in assets.acquire(table, fetch, store, wait=0.01).collect()}
    assert {k: (r.status, r.tries) for k, r in got.items()} == {"fine": ("acquired", 1), "again": ("acquired", 1), "busy": ("acquired", 3), "gone": ("failed", 1), "short": ("failed", 1), "other": ("failed", 1), "none": ("failed", 0)}
    assert "404" in got["gone"].error and "length" in got["short"].error and "SHA" in got["other"].error and got["none"].error
    before = sorted(os.listdir(calls))
    kept = {r.name: r.status for r in assets.acquire(table.where("name in ('fine', 'busy')"), fetch, store).collect()}
    assert kept == {"fine": "held", "busy": "held"} and sorted(os.listdir(calls)) == before
    sha = digest("busy")
    (tmp_path / "store" / sha[:2] / sha).write_bytes(b"bust")
    assert [r.status for r in assets.acquire(table.where("name = 'busy'"), fetch, store).collect()] == ["failed"]
    assert assets.acquire(table.limit(0), fetch, store).isEmpty()


def test_samples_are_part_of_one_page(spark):
    """Limits come before the magnitude type; revisions that came later, and other members, never show."""
    t = lambda d, h=0: datetime(2024, 1, d, h)
    rows = [
        (1, 1, "a", 1, t(1), t(1), 1.0, 2.0, 4.0, "mw"),
        (2, 1, "a", 1, t(1), t(2), 1.0, 2.0, 4.5, "mw"),  # a revision
        (3, 1, "a", 1, t(1), t(9), 1.0, 2.0, 6.0, "mw"),  # known too late
        (4, 2, "b", 1, t(1), t(2), 1.0, 2.0, 5.0, "mw"),  # the same event by a source that counts less
        (5, 3, "a", 3, t(2), t(2), 1.0, 2.0, None, "mw"),
        (6, 4, "a", 4, t(3), t(3), None, 2.0, 4.2, "mw"),
        (7, 5, "a", 5, t(4), t(4), 1.0, 2.0, 4.1, "mb"),
        (8, 6, "a", 6, t(4), t(4), 1.0, 2.0, 4.3, "mw"),
        (9, 7, "a", 7, t(5), t(5), 1.0, 2.0, 4.3, "mw"),  # at the open end
    ]
    names = "event_id long, source_event_key long, source_id string, canonical long, event_time timestamp_ntz, available_at timestamp_ntz, latitude double, longitude double, magnitude double, magnitude_type string"
    revisions = spark.createDataFrame(rows, names)
    ask = (revisions, t(8), t(1), t(5), "mw", "canonical", catalog.source_priority(F.col("source_id"), {"a": 0}))
    times = lambda df: sorted((r.event_time.day, r.magnitude) for r in df.collect())
    assert times(catalog.magnitude_sample(*ask)) == [(1, 4.5), (3, 4.2), (4, 4.3)]
    assert times(catalog.magnitude_sample(*ask, limit=1)) == [(4, 4.3)]  # of equal times the later id
    assert times(catalog.magnitude_sample(*ask, limit=3)) == [(3, 4.2), (4, 4.3)]  # another type takes a place
    assert times(catalog.declustering_sample(*ask, min_magnitude=4.25)) == [(1, 4.5), (4, 4.3)]
    assert times(catalog.declustering_sample(*ask, min_magnitude=0.0, bbox=(0, 0.5, 0, 9))) == []
    assert times(catalog.magnitude_sample(revisions, t(8).replace(tzinfo=UTC), *ask[2:])) == [(1, 4.5), (3, 4.2), (4, 4.3)]
    assert catalog.magnitude_sample(revisions.limit(0), *ask[1:]).isEmpty()
    with pytest.raises(ValueError, match="before"):
        catalog.magnitude_sample(revisions, t(8), t(5), t(5), *ask[4:])
