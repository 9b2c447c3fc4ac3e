"""Forecast cubes, branching simulation, and walk-forward folds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import LN10, bin_fraction, omori_integral
from ..plans.blocks import block_join
from .grid import bins_frame
from .seismicity import _haversine


#: Events whose descendants are drawn together.
FAMILIES = 256


@dataclass(frozen=True)
class Etas:
    """Background per day, productivity, magnitude scaling, Omori law, spatial kernel."""

    mu: float = 0.5
    k0: float = 0.05
    alpha: float = 1.0
    c: float = 0.1
    p: float = 1.2
    d0: float = 5.0
    gamma: float = 0.5
    q: float = 1.8


def forecast_cells(cells: DataFrame, sample: DataFrame, etas: Etas, start: float, stop: float, reference: float, region_km2: float | None = None, weights: DataFrame | None = None) -> DataFrame:
    """(cell_id, expected): background share plus what earlier events trigger in each cell.

    Productivity over the horizon and kernel width are columns of the sample, computed once; cells
    and events meet in blocks. ``weights`` (cell_id, weight) must cover every cell and be positive in
    sum; without them the background is spread by area over ``region_km2``."""
    own = etas.k0 * F.exp(etas.alpha * (F.col("magnitude") - reference)) * (omori_integral(etas.c, etas.p, F.lit(stop) - F.col("t_days")) - omori_integral(etas.c, etas.p, F.lit(start) - F.col("t_days")))
    fed = sample.where(F.col("t_days") < start).select("event_id", "latitude", "longitude", own.alias("fed"), (etas.d0 * F.exp(etas.gamma * (F.col("magnitude") - reference))).alias("d"))

    def compare(c: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        r = _haversine(c.latitude.to_numpy()[:, None], c.longitude.to_numpy()[:, None], e.latitude.to_numpy(), e.longitude.to_numpy())
        d = e.d.to_numpy()
        density = (etas.q - 1) / (np.pi * d * d) * (1 + (r / d) ** 2) ** -etas.q
        return pd.DataFrame({"cell_id": c.cell_id.to_numpy(), "part": density @ e.fed.to_numpy() * c.area_km2.to_numpy()})

    part = block_join(cells.select("cell_id", "latitude", "longitude", "area_km2"), fed, "cell_id", "event_id", compare, "cell_id string, part double", rows=2048)
    triggered = part.groupBy("cell_id").agg(F.sum("part").alias("triggered"))
    out = cells.join(triggered, "cell_id", "left")
    if weights is None:
        if not region_km2:
            raise ValueError("a region's area or background weights are needed")
        share = F.col("area_km2") / region_km2
    else:
        faults = cells.join(weights, "cell_id", "left").agg(F.count_if(F.col("weight").isNull() | (F.col("weight") < 0)).alias("bad"), F.sum("weight").alias("total")).first()
        if faults.bad or not faults.total:
            raise ValueError("background weights must cover all cells, be non-negative and have mass")
        out, share = out.join(weights, "cell_id"), F.col("weight") / faults.total
    return out.select(*cells.columns, (etas.mu * share * (stop - start) + F.coalesce("triggered", F.lit(0.0))).alias("expected"))


def forecast_cube(rates: DataFrame, b: float, reference: float) -> DataFrame:
    """Each cell's expected count split over the magnitude bins; bins below the reference have no estimate."""
    share = bin_fraction(F.col("lower"), F.col("upper"), b, reference)
    cube = rates.withColumnRenamed("expected", "all").join(F.broadcast(bins_frame(rates.sparkSession)), F.lit(True))
    cube = cube.withColumn("expected", F.col("all") * share)
    return cube.select("cell_id", "bin", "lower", "upper", "expected", (1 - F.exp(-F.col("expected"))).alias("probability"), F.when(F.col("expected").isNull(), "not_estimable").otherwise("estimable").alias("support"))


def stability(params: DataFrame) -> DataFrame:
    """Branching diagnostics of (mu, k0, alpha, c, p, b, horizon) rows."""
    beta = F.col("b") * LN10
    finite = F.col("alpha") < beta
    factor = F.when(finite, beta / (beta - F.col("alpha")))
    lifetime = F.when(finite & (F.col("p") > 1), F.col("k0") * factor * F.pow("c", 1 - F.col("p")) / (F.col("p") - 1))
    state = F.when(~finite, "non_finite_magnitude_productivity").when(F.col("p") <= 1, "finite_horizon_only_p_not_above_one").when(lifetime >= 1, "supercritical_lifetime_branching").otherwise("subcritical_lifetime_branching")
    direct = F.col("k0") * factor * omori_integral(F.col("c"), F.col("p"), F.col("horizon"))
    return params.select("*", direct.alias("direct_offspring"), lifetime.alias("lifetime_offspring"), state.alias("state"))


def simulate(spark: SparkSession, etas: Etas, b: float, reference: float, history: DataFrame | pd.DataFrame, start: float, stop: float, runs: int, seed: int = 1, largest: float = 9.5, limit: int | None = 50_000) -> DataFrame:
    """(run, events, largest) of simulated catalogs: immigrants and all generations of offspring.

    Families are independent given their first parent, so the catalogs are superposed: every event of
    ``history`` (event_id, t_days, magnitude) draws its descendants in all runs together with those of its
    chunk of ids, immigrants theirs run by run, and the runs are summed. Each chunk and each run has its own
    random stream, so results do not depend on partitioning. A run of more than ``limit`` events is
    refused; only counts are kept, so that none (None) is needed for memory where few events follow from
    each. A pandas history (t_days, magnitude) is numbered by its rows."""
    if isinstance(history, pd.DataFrame):
        history = spark.createDataFrame([(k, float(t), float(m)) for k, (t, m) in enumerate(zip(history.t_days, history.magnitude, strict=True))], "event_id long, t_days double, magnitude double")
    beta = b * LN10
    top = 1 - np.exp(-beta * (largest - reference))
    schema = "run long, events long, largest double"
    refused = f"a simulated catalog has more than {limit} events"

    def integral(x):
        return np.log((x + etas.c) / etas.c) if abs(etas.p - 1) < 1e-8 else ((x + etas.c) ** (1 - etas.p) - etas.c ** (1 - etas.p)) / (1 - etas.p)

    def delays(r, lo, hi):
        u = r.random(len(lo))
        if abs(etas.p - 1) < 1e-8:
            return np.exp(np.log(lo + etas.c) + u * (np.log(hi + etas.c) - np.log(lo + etas.c))) - etas.c
        a, z = (lo + etas.c) ** (1 - etas.p), (hi + etas.c) ** (1 - etas.p)
        return (a + u * (z - a)) ** (1 / (1 - etas.p)) - etas.c

    def sizes(r, n):
        return reference - np.log(1 - r.random(n) * top) / beta

    def descend(r, t, m, run, events, most):
        """Adds all generations of offspring of parents (t, m) in their runs."""
        while len(t):
            lo = np.maximum(start - t, 0)
            hi = np.maximum(stop - t, lo)
            n = r.poisson(etas.k0 * np.exp(etas.alpha * (m - reference)) * (integral(hi) - integral(lo)))
            lo, hi, base, run = np.repeat(lo, n), np.repeat(hi, n), np.repeat(t, n), np.repeat(run, n)
            t = base + delays(r, lo, hi)
            m = sizes(r, len(t))
            events += np.bincount(run, minlength=len(events))
            np.maximum.at(most, run, m)
            if limit is not None and events.max() > limit:
                raise ValueError(refused)

    def immigrants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k in batch.id:
                r = np.random.default_rng([seed, int(k)])
                t = r.uniform(start, stop, r.poisson(etas.mu * (stop - start)))
                m = sizes(r, len(t))
                events, most = np.array([len(t)]), np.array([m.max() if len(m) else -np.inf])
                descend(r, t, m, np.zeros(len(t), int), events, most)
                rows.append((int(k), int(events[0]), float(most[0]) if events[0] else None))
            yield pd.DataFrame(rows, columns=["run", "events", "largest"])

    def families(g: pd.DataFrame) -> pd.DataFrame:
        events, most = np.zeros(runs, int), np.full(runs, -np.inf)
        i = int(g.chunk.iloc[0])
        # four words, the last one 1: never an immigrants' stream, which has zeros there
        r = np.random.default_rng([seed, i & 0xFFFFFFFF, i >> 32 & 0xFFFFFFFF, 1])
        g = g.sort_values(["event_id", "t_days", "magnitude"])
        t, m = g.t_days.to_numpy(), g.magnitude.to_numpy()
        lo = np.maximum(start - t, 0)
        drawn = runs * (1 + etas.k0 * np.exp(etas.alpha * (m - reference)) * (integral(np.maximum(stop - t, lo)) - integral(lo)))
        # about a million draws at a time
        for part in np.split(np.arange(len(g)), np.flatnonzero(np.diff(np.cumsum(drawn) // 1_000_000)) + 1):
            descend(r, np.repeat(t[part], runs), np.repeat(m[part], runs), np.tile(np.arange(runs), len(part)), events, most)
        some = np.flatnonzero(events)
        return pd.DataFrame({"run": some, "events": events[some], "largest": most[some]})

    past = history.select(F.col("event_id").cast("long"), F.col("t_days").cast("double"), F.col("magnitude").cast("double"))
    past = past.withColumn("chunk", F.floor(F.col("event_id") / FAMILIES).cast("long"))
    parts = spark.range(runs).mapInPandas(immigrants, schema).union(past.groupBy("chunk").applyInPandas(families, schema))
    total = F.sum("events")
    counted = total if limit is None else F.when(total > limit, F.raise_error(refused).cast("long")).otherwise(total)
    return parts.groupBy("run").agg(counted.alias("events"), F.max("largest").alias("largest"))


def folds(spark: SparkSession, start: float, end: float, step: float, horizon: float) -> DataFrame:
    """(fold, start, stop) of walk-forward windows: issued every ``step`` days while the horizon fits."""
    n = int(np.floor((end - start - horizon) / step + 1e-9)) + 1
    return spark.range(max(0, n)).select(F.col("id").cast("int").alias("fold"), (F.lit(start) + F.col("id") * step).alias("start"), (F.lit(start) + F.col("id") * step + horizon).alias("stop"))


def covering_folds(spark: SparkSession, start: float, end: float, horizon: float) -> DataFrame:
    """(fold, start, stop) of the fewest windows of a horizon that leave no time between ``start`` and
    ``end`` out: the step is the horizon, or less where the last one would run beyond the end."""
    n = int(np.ceil((end - start) / horizon - 1e-9))
    if end - start < horizon:
        return folds(spark, start, start, horizon, horizon)
    return folds(spark, start, end, (end - start - horizon) / (n - 1) if n > 1 else horizon, horizon)


def walk_forward(cells: DataFrame, sample: DataFrame, etas: Etas, windows: DataFrame, reference: float, region_km2: float) -> DataFrame:
    """(fold, cell_id, rate, reference_rate, probability) for every cell of every (fold, start, stop).

    All folds are one job: a cell of a fold is a row, and rows meet events in blocks. A fold sees the
    events before its start only; its baseline is the background alone."""
    rows = cells.select("cell_id", "latitude", "longitude", "area_km2").join(F.broadcast(windows), F.lit(True)).withColumn("key", F.concat_ws("@", "cell_id", "fold"))

    def integral(x: np.ndarray) -> np.ndarray:
        return np.log((x + etas.c) / etas.c) if abs(etas.p - 1) < 1e-8 else ((x + etas.c) ** (1 - etas.p) - etas.c ** (1 - etas.p)) / (1 - etas.p)

    def compare(c: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        own, d = etas.k0 * np.exp(etas.alpha * (e.magnitude.to_numpy() - reference)), etas.d0 * np.exp(etas.gamma * (e.magnitude.to_numpy() - reference))
        t, out = e.t_days.to_numpy(), []
        for _, g in c.groupby("fold"):
            start, stop = g.start.iloc[0], g.stop.iloc[0]
            fed = np.where(t < start, own * (integral(np.maximum(stop - t, 0)) - integral(np.maximum(start - t, 0))), 0.0)
            r = _haversine(g.latitude.to_numpy()[:, None], g.longitude.to_numpy()[:, None], e.latitude.to_numpy(), e.longitude.to_numpy())
            density = (etas.q - 1) / (np.pi * d * d) * (1 + (r / d) ** 2) ** -etas.q
            out.append(pd.DataFrame({"key": g.key.to_numpy(), "part": density @ fed * g.area_km2.to_numpy()}))
        return pd.concat(out)

    events = sample.select("event_id", "t_days", "latitude", "longitude", "magnitude")
    part = block_join(rows, events, "key", "event_id", compare, "key string, part double", rows=2048)
    fed = part.groupBy("key").agg(F.sum("part").alias("fed"))
    base = etas.mu * F.col("area_km2") / region_km2 * (F.col("stop") - F.col("start"))
    out = rows.join(fed, "key", "left").select("fold", "cell_id", (base + F.coalesce("fed", F.lit(0.0))).alias("rate"), base.alias("reference_rate"))
    return out.withColumn("probability", 1 - F.exp(-F.col("rate")))


def latest_run(runs: DataFrame, moment: Column) -> DataFrame:
    """The run issued last at or before ``moment``; ties go to the largest run_id. No row without one."""
    return runs.where(F.col("issued_at") <= moment).orderBy(F.desc("issued_at"), F.desc("run_id")).limit(1)


def run_detail(bins: DataFrame, cells: DataFrame, reference: float, magnitude_lower: float | None = None, limit: int = 3000) -> DataFrame:
    """Estimable cells of one magnitude bin of a run, by falling expectation (ties by cell_id).

    Without ``magnitude_lower`` the bin is the lowest that starts at the reference magnitude or above,
    else the lowest. A top-k read: each task keeps ``limit`` rows."""
    if magnitude_lower is None:
        lowest = bins.agg(F.coalesce(F.min(F.when(F.col("lower") >= reference, F.col("lower"))), F.min("lower")).alias("lower"))
        chosen = bins.join(F.broadcast(lowest), "lower")
    else:
        chosen = bins.where(F.col("lower") == magnitude_lower)
    places = cells.select("cell_id", "latitude", "longitude")
    return chosen.where("support = 'estimable'").join(places, "cell_id").orderBy(F.desc("expected"), "cell_id").limit(limit)
