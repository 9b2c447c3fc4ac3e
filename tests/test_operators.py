"""Claims about single operators: golden values, refusals, recovery, edge cases."""

import inspect
import io
import math
import os
import struct
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quakeloom import queries
from quakeloom.functions import geo, stats
from quakeloom.operators import catalog, fitting, forecasting, grid, linkage, magnitudes, scoring, seismicity
from quakeloom.operators.traces import nearest_trace
from quakeloom.plans import graph
from quakeloom.plans.graph import connected_components
from quakeloom.sources import files
from quakeloom.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_functions(spark):
    for x in (-6.0, -1.3, 0.0, 0.4, 2.2, 4.9):
        assert abs(one(spark, stats.erf(F.lit(x))) - math.erf(x)) < 1e-9
    assert abs(one(spark, stats.poisson_cdf(F.lit(3), F.lit(2.0))) - sum(math.exp(-2) * 2**k / math.factorial(k) for k in range(4))) < 1e-12
    assert abs(one(spark, stats.poisson_log_pmf(F.lit(5), F.lit(2.5))) - (5 * math.log(2.5) - 2.5 - math.lgamma(6))) < 1e-12
    assert abs(one(spark, stats.omori_integral(0.1, 1.0, 9.9)) - math.log(100)) < 1e-9
    assert one(spark, stats.excess_deviance(F.lit(3.0), F.lit(5.0))) == 0
    assert one(spark, stats.bin_fraction(F.lit(3.0), F.lit(4.0), 1.0, 3.5)) is None
    assert abs(one(spark, stats.bin_fraction(F.lit(4.0), F.lit(None).cast("double"), 1.0, 3.0)) - 0.1) < 1e-12
    assert one(spark, stats.magnitude_bin(F.lit(3.05))) in (3.0, 3.1)
    assert abs(one(spark, geo.haversine_km(0.0, 0.0, 0.0, 1.0)) - 111.195) < 0.01


def test_support_bands(spark):
    got = spark.createDataFrame([(k,) for k in (49, 50, 99, 100, 199, 200)], "n int").select(stats.support_state(F.col("n"))).collect()
    assert [r[0] for r in got] == ["not_estimable", "research_only", "research_only", "high_uncertainty", "high_uncertainty", "supported"]


def test_circular_mean_crosses_north(spark):
    df = spark.createDataFrame([(1.0, 350.0), (1.0, 10.0)], "w double, d double")
    assert abs(df.agg(geo.circular_mean("w", "d")).first()[0]) < 1e-9
    df = spark.createDataFrame([(1.0, 90.0), (1.0, 270.0)], "w double, d double")
    assert df.agg(geo.circular_mean("w", "d")).first()[0] is None


def test_magnitudes(spark):
    m = [2.0 + 0.1 * k for k, n in enumerate([1, 2, 4, 8, 15, 25, 40, 60, 80, 90, 95, 75, 60, 48, 38, 30]) for _ in range(n)]
    df = spark.createDataFrame([(x,) for x in m], "magnitude double")
    r = magnitudes.mc_maximum_curvature(df, []).first()
    assert abs(r.mc - 3.2) < 1e-9
    exact = [3.0 + 0.1 * k for k in range(21) for _ in range(round(1000 * (10 ** (-0.1 * k) - 10 ** (-0.1 * (k + 1)))))]
    b = magnitudes.b_value(spark.createDataFrame([(x,) for x in exact], "magnitude double"), [], 3.0).first()
    assert abs(b.b - 1.0) < 0.06 and not b.unusual and not b.limited_range
    few = magnitudes.b_value(spark.createDataFrame([(3.5,)] * 20, "magnitude double"), [], 3.0).first()
    assert few.b is None and few.n == 20
    fit = magnitudes.mc_goodness_of_fit(spark.createDataFrame([(x,) for x in exact], "magnitude double"), []).first()
    assert abs(fit.mc - 3.0) < 1e-9


def test_golden_histogram_b(spark):
    counts = {5.0: 200, 5.1: 110, 5.2: 70, 5.3: 45, 5.4: 25, 5.5: 15, 5.6: 9, 5.7: 5, 5.8: 2, 5.9: 1, 6.2: 1}
    rows = [(m,) for m, n in counts.items() for _ in range(n)]
    r = magnitudes.b_value(spark.createDataFrame(rows, "magnitude double"), [], 5.0).first()
    v = np.array([m[0] for m in rows])
    b = math.log10(math.e) / (v.mean() - 4.95)
    assert r.n == 483 and abs(r.b - b) < 1e-9 and r.limited_range and r.unusual


def test_entire_range_recovers(spark):
    r = np.random.default_rng(1)
    x = 2.0 + r.exponential(1 / math.log(10), 60000)
    keep = r.random(len(x)) < np.array([0.5 * (1 + math.erf((v - 3.0) / (0.12 * math.sqrt(2)))) for v in x])
    h = magnitudes.histogram(spark.createDataFrame(pd.DataFrame({"magnitude": x[keep]})), [])
    got = fitting.entire_range(h.select("bin", "n"), resamples=16).first()
    assert abs(got.mc - 3.0) < 0.15 and abs(got.sigma - 0.12) < 0.1 and abs(got.beta - math.log(10)) < 0.3
    assert got.low <= got.mc + 0.05 and got.high >= got.mc - 0.05


def test_as_of_and_late_revisions(spark):
    rows = [(1, 1, "2024-01-01 00:00:00", 4.2), (2, 1, "2024-01-01 01:00:00", 4.4), (3, 2, "2024-01-02 00:00:00", 5.9)]
    df = spark.createDataFrame(rows, "event_id long, source_event_key long, available_at string, magnitude double").withColumn("available_at", F.col("available_at").cast("timestamp"))
    at = lambda t: {r.source_event_key: r.magnitude for r in catalog.as_of(df, F.lit(t).cast("timestamp")).collect()}
    assert at("2024-01-01 00:30:00") == {1: 4.2}
    assert at("2024-01-01 01:00:00") == {1: 4.4}
    assert at("2024-01-03 00:00:00") == {1: 4.4, 2: 5.9}


def test_ledgers(spark):
    held = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "k int, v string")
    assert [r.k for r in catalog.append_if_absent(new, held, ["k"]).collect()] == [3]
    assert sorted(map(tuple, catalog.upsert(held, new.distinct(), ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    a = spark.createDataFrame([(1, None)], "b int, a string").select(catalog.revision_hash(["b", "a"])).first()[0]
    assert a == spark.createDataFrame([(None, 1)], "a string, b int").select(catalog.revision_hash(["a", "b"])).first()[0]


def test_linkage_needs_another_source(spark):
    rows = [(1, "x", "2024-01-01 00:00:00", 0.0, 0.0, 5.0), (2, "y", "2024-01-01 00:00:02", 0.0, 0.01, 5.0), (3, "x", "2024-01-01 00:00:01", 0.0, 0.0, 5.0)]
    df = spark.createDataFrame(rows, "event_id long, source_id string, event_time string, latitude double, longitude double, magnitude double")
    df = df.withColumn("event_time", F.col("event_time").cast("timestamp")).withColumn("available_at", F.col("event_time")).withColumn("depth_km", F.lit(None).cast("double"))
    got = {r.event_id: r.canonical_id for r in linkage.canonical_events(df).collect()}
    assert len(set(got.values())) == 2 and got[1] != got[3] and got[2] in (got[1], got[3])


def test_linkage_settles_in_rounds(spark):
    r = np.random.default_rng(12)
    t0, n = pd.Timestamp("2024-01-01"), 160
    p = pd.DataFrame({"event_id": range(n), "source_id": r.choice(list("xyz"), n), "s": r.uniform(0, 400, n), "latitude": r.normal(0, 0.01, n), "longitude": 0.0, "magnitude": 5.0, "later": r.integers(0, 40, n)})
    p["event_time"], p["available_at"] = t0 + pd.to_timedelta(p.s, unit="s"), t0 + pd.to_timedelta(p.later, unit="h")
    df = spark.createDataFrame(p.drop(columns=["s", "later"])).withColumn("depth_km", F.lit(None).cast("double"))
    assert "applyInPandas" not in inspect.getsource(linkage.canonical_events)  # no component goes to one task
    near = {}
    for x in linkage.link_candidates(df, df.withColumnRenamed("event_id", "other_id")).where("event_id <> other_id and decision = 'auto_match'").collect():
        near.setdefault(x.event_id, []).append((x.probability, x.other_id))
    home, sources = {}, {}
    for x in p.sort_values(["available_at", "event_id"]).itertuples():
        free = sorted((-q, home[o]) for q, o in near.get(x.event_id, ()) if o in home and x.source_id not in sources[home[o]])
        home[x.event_id] = free[0][1] if free else x.event_id
        sources.setdefault(home[x.event_id], set()).add(x.source_id)
    got = linkage.canonical_events(df).collect()
    assert len(near) > 100 and len(got) == n and {g.event_id: g.canonical_id for g in got} == home


def test_declustering(spark):
    r = np.random.default_rng(3)
    t0 = pd.Timestamp("2024-01-01")
    back = pd.DataFrame({"h": r.uniform(0, 17520, 150), "latitude": r.uniform(-40, -20, 150), "longitude": r.uniform(-80, -66, 150), "magnitude": 3 + r.exponential(0.4, 150), "free": True})
    parts = [back]
    for k in range(3):
        lat, lon, h = -25.0 - 5 * k, -70.0, 3000.0 + 4000 * k
        parts.append(pd.DataFrame({"h": [h], "latitude": lat, "longitude": lon, "magnitude": 6.5, "free": True}))
        parts.append(pd.DataFrame({"h": h + r.exponential(24, 25) + 0.1, "latitude": lat + r.normal(0, 0.03, 25), "longitude": lon + r.normal(0, 0.03, 25), "magnitude": 3 + r.exponential(0.3, 25), "free": False}))
    p = pd.concat(parts, ignore_index=True)
    p["event_time"] = t0 + pd.to_timedelta(p.h, unit="h")
    p["event_id"] = range(len(p))
    df = spark.createDataFrame(p[["event_id", "event_time", "latitude", "longitude", "magnitude"]])
    got = seismicity.decluster(df).toPandas().merge(p, on="event_id")
    assert got[got.free].is_background.mean() > 0.85 and (~got[~got.free].is_background.astype(bool)).mean() > 0.9
    roots = seismicity.family_roots(seismicity.decluster(df)).toPandas()
    assert roots.root_id.notna().all() and len(roots) == len(p)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_complete_samples_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    ev = queries.catalog(spark, sf).where("magnitude is not null").select("event_id", F.unix_micros(F.col("event_time").cast("timestamp")).alias("us"), "latitude", "longitude", "magnitude").toPandas()
    k = np.rint(ev.magnitude / 0.1).astype(int)
    mc = round(0.1 * min(k.mode()) + 0.2, 10)  # the fullest bin, the lowest of equal ones
    assert queries.completeness(spark, sf) == mc
    s = ev[ev.magnitude >= mc].sort_values(["us", "event_id"]).reset_index(drop=True)
    la, lo = np.radians(s.latitude.to_numpy()), np.radians(s.longitude.to_numpy())
    a = np.sin((la[:, None] - la) / 2) ** 2 + np.cos(la)[:, None] * np.cos(la) * np.sin((lo[:, None] - lo) / 2) ** 2
    km = 2 * 6371.0088 * np.arcsin(np.sqrt(np.clip(a, 0, 1)))
    eta = np.maximum((s.us.to_numpy()[:, None] - s.us.to_numpy()) / 8.64e10, 1 / 86400) * np.maximum(km, 1e-3) ** 1.6 * 10.0 ** -s.magnitude.to_numpy()
    eta[np.triu_indices(len(s))] = np.inf
    best = dict(zip(s.event_id[1:], zip(s.event_id.to_numpy()[eta.argmin(axis=1)][1:], np.log10(eta.min(axis=1)[1:]), strict=True), strict=True))
    for r in (got := queries.QUERIES["nearest_parents"](spark, sf).collect()):
        assert r.parent_id == best[r.event_id][0] and abs(r.log_eta - best[r.event_id][1]) < 2e-6
    assert len(got) == len(s) - 1
    np.fill_diagonal(km, np.inf)
    width = dict(zip(s.event_id, np.maximum(1.0, np.sort(km, axis=1)[:, 4]), strict=True))
    got = queries.QUERIES["kernel_bandwidths"](spark, sf).collect()
    assert len(got) == len(s) and all(abs(r.bandwidth_km - width[r.event_id]) < 2e-6 for r in got)
    assert queries.QUERIES["declustered"](spark, sf).count() == len(s)


def test_small_catalog_is_unclassified(spark):
    df = spark.createDataFrame([(k, pd.Timestamp("2024-01-01").to_pydatetime(), -30.0, -70.0, 4.0) for k in range(30)], "event_id long, event_time timestamp, latitude double, longitude double, magnitude double")
    out = seismicity.decluster(df).collect()
    assert len(out) == 30 and all(r.is_background is None for r in out)


def test_background_mass(spark):
    r = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame({"event_id": range(80), "latitude": r.normal(-30, 0.5, 80), "longitude": r.normal(-70, 0.5, 80)}))
    cells = grid.cells(spark, -33, -27, -73, -67, 0.1)
    total = seismicity.background_rates(cells, seismicity.bandwidths(df), 365.25).agg(F.sum("rate_per_year")).first()[0]
    assert abs(total - 80) < 0.8


def test_grid(spark):
    with pytest.raises(ValueError):
        grid.cells(spark, 0, 1, 0, 1, 0.3)
    c = grid.cells(spark, -20, -19, -71, -70, 0.1)
    assert c.count() == 100
    where = grid.point_to_cell(F.lit(-19.9), F.lit(-70.0001), -20, -19, -71, -70, 0.1)
    assert one(spark, where) == "grid:r0001:c0009"
    assert one(spark, grid.point_to_cell(F.lit(-18.0), F.lit(-70.5), -20, -19, -71, -70, 0.1)) is None


def test_classes(spark):
    df = spark.createDataFrame([(30.0, 30.0), (10.0, 80.0), (None, 30.0), (200.0, 150.0)], "depth_km double, slab_depth double")
    got = grid.classify(df).collect()
    assert [r.label for r in got][2] == "unknown" and got[2].unknown == 1.0
    assert all(abs(r.interface + r.intraslab + r.crustal + r.unknown - 1) < 1e-9 for r in got)
    assert got[1].label == "crustal"


def arc_km(lat, lon, lat1, lon1, lat2, lon2):
    """Least distance to an arc by points along it that draw together."""

    def unit(a, o):
        a, o = np.radians(a), np.radians(o)
        return np.array([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)])

    p, a, b = unit(lat, lon), unit(lat1, lon1), unit(lat2, lon2)
    low, high = 0.0, 1.0
    for _ in range(12):
        t = np.linspace(low, high, 201)
        q = a[:, None] * (1 - t) + b[:, None] * t
        chord = np.linalg.norm(q / np.linalg.norm(q, axis=0) - p[:, None], axis=0)
        k, step = chord.argmin(), (high - low) / 200
        low, high = max(0.0, t[k] - step), min(1.0, t[k] + step)
    return 2 * np.arcsin(min(1.0, chord.min() / 2)) * geo.EARTH_KM


def test_nearest_trace_on_the_sphere(spark):
    """Far points, both sides of 180 degrees, poles, arcs over a pole, points of no length, unwrapped longitudes."""
    r = np.random.default_rng(5)
    rows = [(1, -51.5, -70.0, -51.0, -70.0), (2, -60.0, -59.9, -59.5, -59.5), (3, 10.0, 179.5, 12.0, -179.0), (4, 80.0, 20.0, 80.0, -160.0), (5, -33.0, -71.0, -33.0, -71.0), (6, 0.0, 60.0, 5.0, 130.0), (7, 0.0, 60.0, 5.0, 130.0)]
    rows += [(10 + k, *map(float, (a, o, a + r.normal(0, 2), o + r.normal(0, 2)))) for k, (a, o) in enumerate(zip(r.uniform(-80, 80, 40), r.uniform(-180, 180, 40), strict=True))]
    places = [(1, -60.0, -70.0), (2, 10.0, 100.0), (3, 11.0, -179.9), (4, 90.0, 0.0), (5, -90.0, 13.0), (6, -33.0, 289.0), (7, 2.0, 95.0), (8, 2.0, 95.0)]
    places += [(20 + k, float(a), float(o)) for k, (a, o) in enumerate(zip(r.uniform(-89, 89, 60), r.uniform(-180, 180, 60), strict=True))]
    segments = spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0, 1.0), (99, None, 1.0, 1.0, 1.0)], "trace_id long, lat1 double, lon1 double, lat2 double, lon2 double")
    points = spark.createDataFrame([*places, (98, None, 1.0)], "point_id long, latitude double, longitude double").withColumn("km", F.lit(-1))
    got = {x.point_id: x for x in nearest_trace(points, segments).collect()}
    assert sorted(got) == sorted(k for k, *_ in places)
    for k, lat, lon in places:
        km = {t: arc_km(lat, lon, *ends) for t, *ends in rows}
        assert abs(got[k].km - min(km.values())) < 1e-3
        assert km[got[k].trace_id] - min(km.values()) < 1e-3
    assert got[7].trace_id == got[8].trace_id == 6  # a tie
    assert nearest_trace(points, segments.limit(0)).isEmpty() and nearest_trace(points.limit(0), segments).isEmpty()


def test_fits(spark):
    r = np.random.default_rng(5)
    c, p, k, days = 0.05, 1.1, 50.0, 30.0
    total = (c ** (1 - p) - (days + c) ** (1 - p)) / (p - 1)
    u = r.random(int(k * total * 4))
    t = (c ** (1 - p) - u * (c ** (1 - p) - (days + c) ** (1 - p))) ** (1 / (1 - p)) - c
    df = spark.createDataFrame(pd.DataFrame({"root": 1, "t_days": t}))
    got = fitting.omori(df, ["root"], days).first()
    assert abs(got.p - p) < 0.15 and abs(got.c - c) < 0.03
    few = fitting.omori(df.limit(5), ["root"], days).first()
    assert few.k is None and not few.converged


def test_etas_recovers_background(spark):
    r = np.random.default_rng(6)
    mu, k0, a, c, p, days = 1.0, 0.043, 1.0, 0.1, 1.2, 300.0
    t, m = list(r.uniform(0, days, r.poisson(mu * days))), None
    m = list(3 + r.exponential(1 / math.log(10), len(t)))
    k = 0
    while k < len(t):
        span = days - t[k]
        mass = (c ** (1 - p) - (span + c) ** (1 - p)) / (p - 1)
        for _ in range(r.poisson(k0 * math.exp(a * (m[k] - 3)) * mass)):
            u = r.random()
            t.append(t[k] + (c ** (1 - p) - u * (c ** (1 - p) - (span + c) ** (1 - p))) ** (1 / (1 - p)) - c)
            m.append(3 + r.exponential(1 / math.log(10)))
        k += 1
    df = spark.createDataFrame(pd.DataFrame({"t_days": t, "magnitude": m}))
    got = fitting.temporal_etas(df, days, 3.0, restarts=1).first()
    assert abs(got.mu - mu) < 0.4 and got.n == len(t)


def test_simulation_is_poisson_without_triggering(spark):
    etas = forecasting.Etas(mu=2.0, k0=0.0)
    got = forecasting.simulate(spark, etas, 1.0, 3.0, pd.DataFrame({"t_days": [], "magnitude": []}), 0.0, 1.0, 2000).toPandas()
    assert abs(got.events.mean() - 2) < 0.15 and abs((got.events > 0).mean() - (1 - math.exp(-2))) < 0.03


def test_simulation_is_fed_by_all_history(spark):
    etas = forecasting.Etas(mu=0.5, k0=0.02, alpha=0.0)
    past = spark.range(1000).select(F.col("id").alias("event_id"), (-F.col("id") / 500).alias("t_days"), F.lit(4.5).alias("magnitude"))
    runs = lambda n: forecasting.simulate(spark, etas, 1.0, 4.5, past.repartition(n), 0.0, 7.0, 300).orderBy("run").toPandas()
    got = runs(3)
    assert got.equals(runs(1)) and len(got) == 300
    part = lambda x: ((x + 0.1) ** -0.2 - 0.1**-0.2) / -0.2
    first = 0.5 * 7 + sum(0.02 * (part(7 + k / 500) - part(k / 500)) for k in range(1000))
    # later generations add at most k0 times the whole integral each
    assert 0.97 * first < got.events.mean() < 1.03 * first / (1 - 0.02 * part(7))
    with pytest.raises(Exception, match="more than 5 events"):
        forecasting.simulate(spark, etas, 1.0, 4.5, past, 0.0, 7.0, 10, limit=5).collect()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables are not here")
def test_simulated_catalogs_counts_small_parents(spark):
    sf, e = "/root/testdata/sf0.01", queries.ETAS
    least = queries.completeness(spark, sf)
    past = queries.sample(spark, sf, least).where("t_days < 20")
    fed = e.k0 * F.exp(e.alpha * (F.col("magnitude") - least)) * (stats.omori_integral(e.c, e.p, 27 - F.col("t_days")) - stats.omori_integral(e.c, e.p, 20 - F.col("t_days")))
    first = e.mu * 7 + past.agg(F.sum(fed)).first()[0]
    assert queries.QUERIES["simulated_catalogs"](spark, sf).first()["mean"] > 0.95 * first


def test_folds_cover_the_catalog(spark):
    for start, end in ((10.0, 30.0), (10.0, 13.0), (0.0, 92.9), (5.0, 14.0)):
        f = forecasting.covering_folds(spark, start, end, 3.0).orderBy("fold").toPandas()
        assert f.start[0] == start and abs(f.stop.iloc[-1] - end) < 1e-9 and len(f) == math.ceil((end - start) / 3)
        assert (f.start.to_numpy()[1:] <= f.stop.to_numpy()[:-1] + 1e-9).all()
    assert forecasting.covering_folds(spark, 10.0, 12.0, 3.0).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_whole_catalog_is_replayed_and_scored(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES["replay_order"](spark, sf)
    assert got.count() == queries.catalog(spark, sf).count() == got.select("step").distinct().count()
    s = queries.sample(spark, sf, queries.completeness(spark, sf)).withColumn("cell", grid.point_to_cell(F.col("latitude"), F.col("longitude"), *queries.GRID))
    first = queries.sample(spark, sf, -1.0).agg(F.min("t_days")).first()[0]
    assert queries.QUERIES["walk_forward_scores"](spark, sf).agg(F.sum("events")).first()[0] >= s.where(F.col("t_days") >= first + 10.5).where("cell is not null").count() > 0


def test_scores_by_hand(spark):
    rows = [(1, 1, 0.9, 1.0, 0.5), (2, 0, 0.2, 0.3, 0.5), (3, 1, 0.6, 0.8, 0.5), (4, 0, 0.6, 0.4, 0.5)]
    df = spark.createDataFrame(rows, "id long, observed int, probability double, rate double, reference_rate double").withColumn("g", F.lit(1))
    s = scoring.basic_scores(df, ["g"]).first()
    assert abs(s.brier - (0.01 + 0.04 + 0.16 + 0.36) / 4) < 1e-12
    assert abs(scoring.roc_auc(df).first().auc - (1 + 1 + 1 + 0.5) / 4) < 1e-12
    assert abs(scoring.average_precision(df, "id").first().average_precision - 1.0) < 1e-9
    t = {r.threshold: r for r in scoring.threshold_scores(df, [0.5, 2.0]).collect()}
    assert t[2.0].precision is None and abs(t[0.5].precision - 2 / 3) < 1e-12
    assert scoring.roc_auc(df.where("observed > 0")).first().auc is None


def test_number_test_at_large_rates(spark):
    def exact(n, rate):  # in log space around the largest term
        logs = [k * math.log(rate) - rate - math.lgamma(k + 1) for k in range(n + 1)]
        top = max(logs, default=0.0)
        return math.exp(top) * math.fsum(math.exp(x - top) for x in logs)

    cases = [(n, rate) for rate in (0.3, 19.5, 25.0, 740.0, 1200.0, 2800.0, 50000.0) for n in sorted({0, 3, 19, 20, int(rate), *(max(0, int(rate + z * rate**0.5)) for z in (-4, -2, -1, 1, 2, 4))})]
    df = spark.createDataFrame([(n, rate) for n, rate in cases], "observed long, expected double")
    for r in scoring.number_test(df).collect():
        low, high = exact(r.observed, r.expected), 1 - exact(r.observed - 1, r.expected)
        assert abs(r.p_at_most - low) < 1e-9 and abs(r.p_at_least - high) < 1e-9
        assert r.consistent == (low > 0.025 and high > 0.025)


def test_poisson_quantiles(spark):
    def exact(q, rate):
        n, total = 0, 0.0
        while True:
            total += math.exp(n * math.log(rate) - rate - math.lgamma(n + 1))
            if total >= q:
                return n
            n += 1

    cases = [(q, rate) for rate in (1e-6, 0.05, 0.7, 3.0, 19.5, 300.0, 5000.0) for q in (0.025, 0.31, 0.5, 0.9, 0.975)]
    df = spark.createDataFrame([*cases, (0.0, 1.0), (1.0, 1.0), (None, 1.0)], "q double, rate double")
    got = [(r.q, r.rate, r.n) for r in df.select("q", "rate", stats.poisson_ppf(F.col("q"), F.col("rate")).alias("n")).collect()]
    assert got[:-3] == [(q, rate, exact(q, rate)) for q, rate in cases] and [x[2] for x in got[-3:]] == [None] * 3


def test_flat_area(spark):
    side = math.radians(1) * 6371.0088
    assert abs(one(spark, geo.flat_area_km2(F.lit(-0.5), F.lit(0.5), F.lit(-71.0), F.lit(-70.0))) - side**2) < 1e-6
    assert abs(one(spark, geo.flat_area_km2(F.lit(-61.0), F.lit(-59.0), F.lit(-70.0), F.lit(-71.0))) - 2 * side**2 * 0.5) < 1e-6


def test_promotion_gate(spark):
    few = spark.createDataFrame([(1.0, 0.0, 10)] * 3, "candidate_ll double, champion_ll double, events int")
    assert scoring.promotion(few, resamples=20).first().decision == "insufficient_evidence"
    good = spark.createDataFrame([(5.0 + k, 0.0, 20) for k in range(12)], "candidate_ll double, champion_ll double, events int")
    assert scoring.promotion(good, resamples=50).first().decision == "promote"
    bad = spark.createDataFrame([(-5.0 - k, 0.0, 20) for k in range(12)], "candidate_ll double, champion_ll double, events int")
    assert scoring.promotion(bad, resamples=50).first().decision == "retain_champion"


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert set(got[k] for k in range(41)) == {0} and got[101] == 100
    assert connected_components(links.where("a < 0")).count() == 0


@pytest.mark.parametrize("order", ["falling", "random", "bit-reversed"])
def test_components_of_long_chains(spark, order, monkeypatch):
    n = 10_000 if order != "bit-reversed" else 4096
    ids = {"falling": np.arange(n)[::-1], "random": np.random.default_rng(7).permutation(n), "bit-reversed": np.array([int(f"{k:012b}"[::-1], 2) for k in range(4096)])}[order]
    rounds, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: rounds.append(name) or write(df, name))
    got = connected_components(spark.createDataFrame(pd.DataFrame({"a": ids[:-1], "b": ids[1:]})))
    assert got.agg(F.count("*"), F.max("component")).first() == (n, 0)
    assert rounds.count("pointers") - 1 <= 20


def test_sources(spark, tmp_path):
    (tmp_path / "feed.json").write_text('{"type": "FeatureCollection", "features": [{"id": "a1", "properties": {"mag": 4.5, "time": 1700000000000, "updated": 1700000100000, "magType": " MB "}, "geometry": {"type": "Point", "coordinates": [-70.5, -30.25, 33.0]}}, {"id": null, "properties": {"time": 1}, "geometry": {"coordinates": [0, 0]}}, {"id": "c3", "properties": {"time": 1700000000000}, "geometry": {"coordinates": [10.0, 50.0]}}]}')
    events, rejected = files.geojson_events(spark, str(tmp_path / "feed.json"), (-60, -15, -82, -62))
    r = events.collect()
    assert [(x.source_event_id, x.magnitude_type, x.depth_km) for x in r] == [("a1", "mb", 33.0)] and rejected.count() == 1
    page = "<table><tr><th>x</th></tr><tr><td><a href='/e/123.html'>2026-07-21 01:02:03<br>10 km al S de X</a></td><td>2026-07-21 05:02:03</td><td>-30.100 -71.200</td><td>45 km</td><td>3.4 Ml</td></tr><tr><td>2026-07-21 01:02:03</td><td>2026-07-21 06:02:03</td><td>-31.5 -71.25</td><td>4 km</td><td>2.9 Mww</td></tr></table>"
    got = files.daily_table_events(spark.createDataFrame([("p", page.encode())], "path string, content binary")).orderBy("event_time").collect()
    assert [x.source_event_id for x in got] == ["123", "20260721060203_m31p500_m71p250"] and got[0].place == "10 km al S de X" and got[1].magnitude_type == "mww"
    (tmp_path / "r.csv").write_text("289.5,-30.0,12.0\n290.0,-30.0,NaN\n10.0,80.0,3.0\n")
    assert [tuple(x) for x in files.xyz_raster(spark, str(tmp_path / "r.csv"), (-60, -15, -82, -62), 0.05).collect()] == [(-600, -1410, 12.0)]
    (tmp_path / "d.csv").write_text("289.5,-30.0,12.0\n289.5,-30.0,13.0\n")
    with pytest.raises(ValueError):
        files.xyz_raster(spark, str(tmp_path / "d.csv"), (-60, -15, -82, -62), 0.05)
    texts = spark.createDataFrame([("90",), ("~90",), ("-165 +/- 15",), ("10-20",), ("steep",), ("",), ("nan",)], "t string")
    assert [tuple(x.n) for x in texts.select(files.interpreted_number(F.col("t")).alias("n")).collect()] == [(90.0, "exact"), (90.0, "approximate"), (-165.0, "uncertain"), (None, "range"), (None, "qualitative"), (None, "missing"), (None, "non_finite")]
    counts = spark.createDataFrame([("2\n",), ('{"count":7}',), ('{"n":1}',)], "b string").select(files.count_response(F.col("b"))).collect()
    assert [x[0] for x in counts] == [2, 7, None]


def test_shapefile(spark):
    shape = struct.pack("<i4d2i", 3, -71, -31, -70, -30, 1, 2) + struct.pack("<i4d", 0, -71, -31, -70, -30)
    shp = bytes(100) + struct.pack(">2i", 1, len(shape) // 2) + shape
    field = b"dip".ljust(11, b"\0") + b"C" + bytes(4) + bytes([6]) + bytes(15)
    dbf = b"\x03" + bytes(3) + struct.pack("<IHH", 1, 32 + 32 + 1, 7) + bytes(20) + field + b"\x0d" + b" " + b"~90   "
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("f.shp", shp)
        z.writestr("f.dbf", dbf)
    got = files.shapefile_traces(spark.createDataFrame([("f.zip", out.getvalue())], "path string, content binary")).first()
    assert got.attributes == {"dip": "~90"} and [(p.lon, p.lat) for p in got.parts[0]] == [(-71.0, -31.0), (-70.0, -30.0)]


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    schema = "event_id long, available_at timestamp, magnitude double"
    day = lambda k: (pd.Timestamp("2024-01-01") + pd.Timedelta(days=k)).to_pydatetime()
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "land"))
    put([(1, day(0), 4.0), (2, day(9), 5.0)])
    run = lambda: ingest.ingest(ingest.landing_stream(spark, str(tmp_path / "land"), schema), str(tmp_path / "table"), str(tmp_path / "ck"), ["event_id"]).awaitTermination()
    run()
    put([(2, day(9), 5.0), (3, day(1), 3.0)])
    run()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "table")).collect()) == [1, 2, 3]
    q = ingest.tumbling_counts(ingest.landing_stream(spark, str(tmp_path / "land"), schema)).writeStream.format("memory").queryName("weeks").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.n for r in spark.table("weeks").collect()) == 4
