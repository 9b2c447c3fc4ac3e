"""Declustering, background rates, triggering intensities and anomaly windows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import excess_deviance, omori_integral
from ..plans import intervals
from ..plans.blocks import block_join
from ..plans.checkpointing import materialize
from ..plans.ranks import running_rank
from .nearest import _haversine, kth_neighbours, nearest_parents
from .quantiles import exact_quantiles

__all__ = ["nearest_parents", "running_rank"]
NEIGHBOURS = 5
MIN_BANDWIDTH_KM = 1.0
DAYS_PER_YEAR = 365.25


def days_since(time: Column, start: Column) -> Column:
    return (F.unix_micros(time.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 8.64e10


def two_component_threshold(log_eta: DataFrame, column: str = "log_eta", rounds: int = 200, tolerance: float = 1e-8) -> dict[str, float] | None:
    """Crossover of two Gaussians fitted by EM; None below 50 values.

    Starts from the lower and upper half; every pass is one aggregate of seven sums on the cluster."""
    x = F.col(column)
    n = log_eta.count()
    if n < 50:
        return None
    middle = exact_quantiles(log_eta, [], column, [0.5]).first().q0
    half = log_eta.agg(*(f(F.when(side, x)) for side in (x <= middle, x > middle) for f in (F.avg, F.var_pop))).first()
    if half[2] is None:
        return None
    mean, var, weight = np.array([half[0], half[2]]), np.array([half[1], half[3]]) + 1e-6, np.array([0.5, 0.5])
    last = -np.inf
    for _ in range(rounds):
        density = [F.lit(float(w / np.sqrt(2 * np.pi * v))) * F.exp(-((x - float(m)) ** 2) / float(2 * v)) for m, v, w in zip(mean, var, weight, strict=True)]
        total = F.greatest(density[0] + density[1], F.lit(1e-300))
        share = [d / total for d in density]
        r = log_eta.agg(F.sum(share[0]), F.sum(share[0] * x), F.sum(share[0] * x * x), F.sum(share[1]), F.sum(share[1] * x), F.sum(share[1] * x * x), F.sum(F.log(total))).first()
        s, sx, sxx = (np.array([r[k], r[k + 3]]) for k in range(3))
        s = np.maximum(s, 1e-12)
        mean, weight = sx / s, s / n
        var = np.maximum(sxx / s - mean**2, 1e-8)
        if abs(r[6] - last) < tolerance * max(1.0, abs(r[6])):
            break
        last = r[6]
    lo, hi = np.argsort(mean)
    gap = lambda y: np.log(weight[lo] / np.sqrt(var[lo])) - (y - mean[lo]) ** 2 / (2 * var[lo]) - np.log(weight[hi] / np.sqrt(var[hi])) + (y - mean[hi]) ** 2 / (2 * var[hi])
    a, c = mean[lo], mean[hi]
    cut = (a + c) / 2
    if gap(a) * gap(c) < 0:
        for _ in range(200):
            cut = (a + c) / 2
            a, c = (cut, c) if gap(a) * gap(cut) > 0 else (a, cut)
    return {"threshold": float(cut), "mean_low": float(mean[lo]), "mean_high": float(mean[hi]), "weight_low": float(weight[lo])}


def decluster(events: DataFrame, b: float = 1.0) -> DataFrame:
    """(event_id, parent_id, log_eta, is_background): above the crossover is background; null if the
    catalog is too small for one; the first event is background."""
    links = materialize(nearest_parents(events, b), "parents")
    fit = two_component_threshold(links)
    own = events.where("magnitude is not null and latitude is not null and longitude is not null").select("event_id")
    out = own.join(links, "event_id", "left")
    flag = F.lit(None).cast("boolean") if fit is None else F.coalesce(F.col("log_eta") >= fit["threshold"], F.lit(True))
    return out.withColumn("is_background", flag)


def family_roots(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(event_id, root_id) from (event_id, parent_id, is_background): the nearest background ancestor.

    Pointers are doubled in each round, so the number of joins grows with the logarithm of the
    longest chain."""
    state = links.select("event_id", F.when(F.coalesce("is_background", F.lit(False)) | F.col("parent_id").isNull(), F.col("event_id")).otherwise(F.col("parent_id")).alias("root_id"))
    state = materialize(state, "roots")
    for _ in range(max_rounds):
        up = state.select(F.col("event_id").alias("root_id"), F.col("root_id").alias("next"))
        step = materialize(state.join(up, "root_id", "left").select("event_id", F.coalesce("next", "root_id").alias("root_id"), (F.coalesce("next", "root_id") != F.col("root_id")).alias("moved")), "roots")
        state = step.select("event_id", "root_id")
        if step.where("moved").isEmpty():
            return state
    raise ValueError("links have a cycle")


def aftershocks(events: DataFrame, links: DataFrame) -> DataFrame:
    """(family, event_id, t_days, duration) of every triggered event: days since its family's root, and
    from there to the catalog's last event.

    ``links`` are those of ``decluster``; a family is named after its root, its nearest background ancestor."""
    time = events.select("event_id", (F.unix_micros(F.col("event_time").cast("timestamp")) / 8.64e10).alias("day"))
    roots = family_roots(links).where("event_id <> root_id")
    last = events.agg((F.unix_micros(F.max("event_time").cast("timestamp")) / 8.64e10).alias("last"))
    own = roots.join(time, "event_id").join(time.select(F.col("event_id").alias("root_id"), F.col("day").alias("start")), "root_id")
    return own.join(F.broadcast(last), F.lit(True)).select(F.col("root_id").alias("family"), "event_id", (F.col("day") - F.col("start")).alias("t_days"), (F.col("last") - F.col("start")).alias("duration"))


def bandwidths(events: DataFrame, k: int = NEIGHBOURS, floor_km: float = MIN_BANDWIDTH_KM) -> DataFrame:
    """(event_id, latitude, longitude, bandwidth_km): distance to the k-th nearest other event."""
    width = F.greatest(F.coalesce("km", F.lit(floor_km)), F.lit(floor_km))
    return kth_neighbours(events, k).select("event_id", "latitude", "longitude", width.alias("bandwidth_km"))


def background_rates(cells: DataFrame, kernels: DataFrame, duration_days: float) -> DataFrame:
    """(cell_id, density, rate_per_year): Gaussian kernels of their own bandwidth at cell centres.

    Cells (cell_id, latitude, longitude, area_km2) meet kernels block by block."""

    def compare(c: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        h = e.bandwidth_km.to_numpy()
        d = _haversine(c.latitude.to_numpy()[:, None], c.longitude.to_numpy()[:, None], e.latitude.to_numpy(), e.longitude.to_numpy())
        return pd.DataFrame({"cell_id": c.cell_id.to_numpy(), "part": (np.exp(-0.5 * (d / h) ** 2) / (2 * np.pi * h**2)).sum(axis=1)})

    part = block_join(cells, kernels, "cell_id", "event_id", compare, "cell_id string, part double", rows=2048)
    density = part.groupBy("cell_id").agg(F.sum("part").alias("density"))
    out = cells.join(density, "cell_id", "left").withColumn("density", F.coalesce("density", F.lit(0.0)))
    return out.select("cell_id", "density", (F.col("density") * F.col("area_km2") / (duration_days / DAYS_PER_YEAR)).alias("rate_per_year"))


#: Terms of a far interval's series; events in a finest interval, on average and at most.
TERMS, NEAR, CROWD = 24, 32, 512


def intensities(sample: DataFrame, mu: float, k0: float, alpha: float, c: float, p: float, reference: float) -> DataFrame:
    """(event_id, intensity, error_bound) of (event_id, t_days, magnitude): every strictly earlier event adds
    k0 * exp(alpha * (magnitude - reference)) * (dt + c) ** -p to ``mu``.

    Near events are added one by one. A far interval (``plans.intervals``) is a series of its moments about
    its middle: it lies three half widths away or more, so that each term is at most a third of the last
    but for slowly growing coefficients, and ``TERMS`` of them leave a relative error of about 1e-11. What
    they leave at most, summed over the intervals, is ``error_bound``. Events of one time are one source.
    Rows without time or magnitude feed nothing; those without time have no row."""
    if c <= 0 or p <= 0:
        raise ValueError("c and p must be positive")
    rows = sample.select("event_id", F.col("t_days").cast("double").alias("t_days"), F.col("magnitude").cast("double").alias("magnitude")).where("t_days is not null")
    own = F.lit(k0) * F.exp(F.lit(alpha) * (F.col("magnitude") - reference))
    sources = materialize(rows.groupBy("t_days").agg(F.coalesce(F.sum(own), F.lit(0.0)).alias("k")), "sources")
    ends = sources.agg(F.min("t_days"), F.max("t_days"), F.count("*")).first()
    if not ends[2]:
        return rows.select("event_id", F.lit(mu).alias("intensity"), F.lit(0.0).alias("error_bound"))
    levels = max(1, math.ceil(math.log2(max(2.0, ends[2] / NEAR))))
    index = lambda n: F.floor((F.col("t_days") - ends[0]) / ((ends[1] - ends[0]) * (1 + 1e-12) / 2**n or 1.0))
    while levels < 40 and sources.groupBy(index(levels)).count().agg(F.max("count")).first()[0] > CROWD:
        levels += 3
    width = (ends[1] - ends[0]) * (1 + 1e-12) / 2**levels or 1.0
    placed = sources.withColumn("index", index(levels))
    half = F.lit(width / 2) * F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))
    middle = F.lit(ends[0]) + (2 * F.col("i") + 1) * half

    held = placed.select("t_days", "k", F.inline(intervals.holding(F.col("index"), levels)))
    off = (F.col("t_days") - middle) / half
    moments = held.withColumn("off", off).groupBy("level", "i").agg(*(F.sum(F.col("k") * F.pow("off", F.lit(q))).alias(f"m{q}") for q in range(TERMS)))
    looks = placed.select("t_days", F.inline(intervals.far(F.col("index"), levels))).join(moments, ["level", "i"])
    x = F.col("t_days") - middle + c
    ratio, series, factor = half / x, F.lit(0.0), [1.0]
    for q in range(TERMS):
        factor.append(factor[-1] * (p + q) / (q + 1))
    for q in reversed(range(TERMS)):
        series = F.col(f"m{q}") * factor[q] + F.col("ratio") * series
    grown = max(1.0, (p + TERMS) / (TERMS + 1))
    left = F.col("m0") * factor[TERMS] * F.pow("ratio", F.lit(TERMS)) / (1 - F.col("ratio") * grown)
    far = looks.withColumns({"ratio": ratio, "x": x}).select("t_days", (F.pow("x", F.lit(-p)) * series).alias("part"), (F.pow("x", F.lit(-p)) * left).alias("left"))
    close = placed.select("t_days", F.explode(intervals.near(F.col("index"))).alias("index"))
    earlier = placed.select("index", F.col("t_days").alias("s"), "k")
    near = close.join(earlier, "index").where("s < t_days").select("t_days", (F.col("k") * F.pow(F.col("t_days") - F.col("s") + c, F.lit(-p))).alias("part"), F.lit(0.0).alias("left"))
    total = far.union(near).groupBy("t_days").agg(F.sum("part").alias("part"), F.sum("left").alias("left"))
    out = rows.join(total, "t_days", "left")
    return out.select("event_id", (F.lit(mu) + F.coalesce("part", F.lit(0.0))).alias("intensity"), F.coalesce("left", F.lit(0.0)).alias("error_bound"))


def expected_counts(windows: DataFrame, sample: DataFrame, mu: float, k0: float, alpha: float, c: float, p: float, reference: float) -> DataFrame:
    """(w, expected) for (w, start, stop) in days: events strictly before a window feed it.

    Windows are few (one per week of the catalog) and are sent to the events, whose parts are summed
    before the shuffle."""
    own = k0 * F.exp(alpha * (F.col("magnitude") - reference))
    pairs = sample.join(F.broadcast(windows), F.col("t_days") < F.col("start"))
    fed = own * (omori_integral(c, p, F.col("stop") - F.col("t_days")) - omori_integral(c, p, F.col("start") - F.col("t_days")))
    part = pairs.groupBy("w").agg(F.sum(fed).alias("fed"))
    return windows.join(part, "w", "left").select("w", "start", "stop", (mu * (F.col("stop") - F.col("start")) + F.coalesce("fed", F.lit(0.0))).alias("expected"))


def anomaly_index(sample: DataFrame, end_days: float, mu: float, k0: float, alpha: float, c: float, p: float, reference: float, window_days: float = 7.0, least_windows: int = 30) -> DataFrame:
    """One row: the last window's excess deviance ranked among the contiguous windows before it.

    Window 0 is [end - window, end); window w lies w windows earlier, as long as it starts at or
    after the first event. Empty windows count."""
    first = sample.agg(F.min("t_days").alias("first"))
    start = F.lit(end_days - window_days)
    windows = first.select(F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((start - F.col("first")) / window_days).cast("int")))).alias("w"))
    windows = windows.select("w", (start - F.col("w") * window_days).alias("start"), (start - (F.col("w") - 1) * window_days).alias("stop"))
    index = F.floor((F.lit(end_days) - F.col("t_days")) / window_days)
    exact = F.when(F.col("t_days") == F.lit(end_days) - index * window_days, index - 1).otherwise(index)
    seen = sample.where(F.col("t_days") < end_days).groupBy(exact.cast("int").alias("w")).agg(F.count("*").alias("observed"))
    each = expected_counts(windows, sample, mu, k0, alpha, c, p, reference).join(seen, "w", "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    each = each.withColumn("deviance", excess_deviance(F.col("observed").cast("double"), F.col("expected")))
    now = each.where("w = 0").select(F.col("observed").alias("observed"), F.col("expected").alias("expected"), F.col("deviance").alias("now"))
    past = each.where("w > 0").join(F.broadcast(now.select("now")), F.lit(True)).agg(F.count("*").alias("windows"), F.count_if(F.col("deviance") <= F.col("now")).alias("below"))
    return now.join(past, F.lit(True)).select("observed", "expected", F.col("now").alias("deviance"), "windows", F.when(F.col("windows") >= least_windows, 100.0 * F.col("below") / F.col("windows")).alias("score"))
