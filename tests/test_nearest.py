"""Pruned searches and series of the catalog against all pairs, on awkward catalogs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quakeloom.operators import nearest, seismicity
from quakeloom.plans import intervals


def catalog_of(kind, n=1500, seed=5):
    r = np.random.default_rng(seed)
    day = r.uniform(0, 400, n)
    lat, lon = r.uniform(-60, -15, n), r.uniform(-82, -62, n)
    if kind == "swarm":  # a third in one place within a day, a third of these at one instant
        k = n // 3
        lat[:k], lon[:k], day[:k] = -33 + r.normal(0, 0.02, k), -71 + r.normal(0, 0.02, k), 200 + r.uniform(0, 1, k)
        day[: k // 3] = 200.5
    if kind == "repeats":  # few places, times and magnitudes
        lat, lon, day = np.round(lat / 5) * 5, np.round(lon / 5) * 5, np.round(day / 20) * 20
    if kind == "globe":  # both sides of the date line, and the poles
        lat, lon = r.choice([-90.0, 90.0, 89.99, -89.9, 0.0, 1.0, 45.0], n) + 0.0, r.choice([-180.0, 180.0, 179.9, -179.95, 0.0], n)
        lat = np.clip(lat + r.normal(0, 0.5, n), -90, 90)
    m = 3 + r.exponential(0.4, n)
    m[r.integers(0, n, 3)] = 7.9
    if kind == "repeats":
        m = np.round(m)
    return pd.DataFrame({"event_id": r.permutation(n), "event_time": pd.Timestamp("2020-01-01") + pd.to_timedelta(np.round(day * 86400, 3), unit="s"), "latitude": lat, "longitude": lon, "magnitude": m})


def kilometres(p):
    return nearest._haversine(p.latitude.to_numpy()[:, None], p.longitude.to_numpy()[:, None], p.latitude.to_numpy(), p.longitude.to_numpy())


@pytest.mark.parametrize("kind", ["even", "swarm", "repeats", "globe"])
def test_nearest_parents(spark, kind):
    p = catalog_of(kind)
    us = p.event_time.astype("datetime64[us]").astype("int64").to_numpy()
    order = np.lexsort((p.event_id, us))
    p, us = p.iloc[order].reset_index(drop=True), us[order]
    eta = np.maximum((us[:, None] - us) / 8.64e10, 1 / 86400) * np.maximum(kilometres(p), 1e-3) ** 1.6 * 10.0 ** (-0.9 * p.magnitude.to_numpy())
    eta[np.triu_indices(len(p))] = np.inf
    got = {r.event_id: r for r in nearest.nearest_parents(spark.createDataFrame(p), 0.9, near=16).collect()}
    assert len(got) == len(p) - 1 and p.event_id[0] not in got
    for k in range(1, len(p)):
        r = got[p.event_id[k]]
        assert abs(r.log_eta - math.log10(eta[k].min())) < 1e-9
        assert eta[k][p.index[p.event_id == r.parent_id][0]] <= eta[k].min() * (1 + 1e-12)


def test_nearest_parents_ties_nulls_and_nothing(spark):
    t = pd.Timestamp("2024-01-01").to_pydatetime()
    rows = [(3, t, 0.0, 0.0, 5.0), (1, t, 0.0, 0.0, 5.0), (2, t, 0.0, 0.0, 5.0), (4, t, None, 0.0, 5.0), (5, None, 0.0, 0.0, 5.0), (6, t, 0.0, 0.0, None), (None, t, 0.0, 0.0, 5.0)]
    df = spark.createDataFrame(rows, "event_id long, event_time timestamp, latitude double, longitude double, magnitude double")
    assert {r.event_id: r.parent_id for r in nearest.nearest_parents(df).collect()} == {2: 1, 3: 1}
    assert nearest.nearest_parents(df.where("event_id = 1")).count() == 0 and nearest.nearest_parents(df.limit(0)).count() == 0


def test_few_pairs_are_compared(spark, monkeypatch):
    p = catalog_of("even", 6000)
    seen, real = [], nearest._compare

    def counted(pairs, parents, b, dimension):
        strip = parents.groupBy("k", "level", "i", "strip").count()
        seen.append(pairs.where("reach < 360").join(strip, ["k", "level", "i", "strip"]).agg(F.sum(F.col("count") * F.least(F.lit(1.0), 2 * F.col("reach") / 45))).first()[0] or pairs.join(strip, ["k", "level", "i", "strip"]).agg(F.sum("count")).first()[0])
        return real(pairs, parents, b, dimension)

    monkeypatch.setattr(nearest, "_compare", counted)
    nearest.nearest_parents(spark.createDataFrame(p), near=8).count()
    assert sum(seen) < 0.05 * 6000 * 5999 / 2


@pytest.mark.parametrize("kind", ["even", "swarm", "repeats", "globe"])
@pytest.mark.parametrize("k", [1, 5])
def test_kth_neighbours(spark, kind, k):
    p = catalog_of(kind, 700)
    if kind == "globe":
        p.loc[p.longitude == 180.0, "longitude"] = -180.0  # one name for a place
    km = kilometres(p)
    np.fill_diagonal(km, np.inf)
    want = dict(zip(p.event_id, np.sort(km, axis=1)[:, k - 1], strict=True))
    got = nearest.kth_neighbours(spark.createDataFrame(p), k).collect()
    assert len(got) == len(p) and all(abs(r.km - want[r.event_id]) < 1e-6 for r in got)


def test_kth_neighbours_of_few(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 0.0, 3.0), (4, None, 0.0)], "event_id long, latitude double, longitude double")
    one = math.radians(1) * 6371.0088
    got = {r.event_id: r.km for r in nearest.kth_neighbours(df, 5).collect()}
    assert {k: round(v / one, 9) for k, v in got.items()} == {1: 3.0, 2: 2.0, 3: 3.0}
    assert nearest.kth_neighbours(df.where("event_id = 1"), 5).first().km is None and nearest.kth_neighbours(df.limit(0), 5).count() == 0
    assert seismicity.bandwidths(df.where("event_id = 1")).first().bandwidth_km == 1.0


@pytest.mark.parametrize("kind", ["even", "swarm", "repeats"])
@pytest.mark.parametrize("c,p", [(0.1, 1.2), (1e-3, 1.0), (0.01, 2.5)])
def test_intensities(spark, kind, c, p):
    d = catalog_of(kind, 900)
    d["t_days"] = (d.event_time - pd.Timestamp("2020-01-01")) / pd.Timedelta(days=1)
    df = spark.createDataFrame(d[["event_id", "t_days", "magnitude"]])
    t, own = d.t_days.to_numpy(), 0.05 * np.exp(1.1 * (d.magnitude.to_numpy() - 3))
    dt = t[:, None] - t
    want = dict(zip(d.event_id, 0.5 + np.where(dt > 0, np.maximum(dt, 0) + c, np.inf) ** -p @ own, strict=True))
    for r in seismicity.intensities(df, 0.5, 0.05, 1.1, c, p, 3.0).collect():
        assert abs(r.intensity - want[r.event_id]) <= r.error_bound + 1e-12 * want[r.event_id] and r.error_bound < 1e-8 * r.intensity


def test_intensities_of_nothing(spark):
    df = spark.createDataFrame([(1, 2.0, 4.0), (2, None, 4.0), (3, 2.0, None), (4, 3.0, None)], "event_id long, t_days double, magnitude double")
    got = {r.event_id: r.intensity for r in seismicity.intensities(df, 0.5, 0.05, 1.0, 0.1, 1.2, 4.0).collect()}
    assert got[1] == got[3] == 0.5 and abs(got[4] - 0.5 - 0.05 * 1.1**-1.2) < 1e-12 and 2 not in got
    assert seismicity.intensities(df.limit(0), 0.5, 0.05, 1.0, 0.1, 1.2, 4.0).count() == 0


@pytest.mark.parametrize("levels", [1, 2, 3, 6])
def test_intervals_cover_the_past_once(spark, levels):
    df = spark.range(2**levels).select(F.col("id").alias("i"), intervals.near(F.col("id")).alias("near"), intervals.far(F.col("id"), levels).alias("far"))
    for r in df.collect():
        covered = [*r.near, *(x for f in r.far for x in range(f.i << f.level, (f.i + 1) << f.level))]
        assert sorted(covered) == list(range(r.i + 1))
        assert all((r.i >> f.level) - f.i >= 2 for f in r.far)
