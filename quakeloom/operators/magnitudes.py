"""Frequency-magnitude statistics, grouped by any keys so that all samples share one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import magnitude_bin, support_state

WIDTH = 0.1
CORRECTION = 0.2
MIN_EVENTS = 50
FIT_EVENTS = FIT_BINS = 10
TARGETS = (95.0, 90.0)


def _match(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on the keys; without keys each side is the one sample's few rows."""
    return a.join(b, keys) if keys else a.join(F.broadcast(b), F.lit(True))


def histogram(sample: DataFrame, keys: list[str], width: float = WIDTH) -> DataFrame:
    """(keys, k, bin, n, n_above): counts by bin from the least to the largest one, empty bins too."""
    counts = sample.where("magnitude is not null").groupBy(*keys, F.rint(F.col("magnitude") / width).cast("int").alias("k")).agg(F.count("*").alias("n"))
    axis = counts.groupBy(*keys).agg(F.explode(F.sequence(F.min("k"), F.max("k"))).alias("k"))
    above = Window.partitionBy(*keys).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    filled = axis.join(counts, [*keys, "k"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.withColumns({"bin": F.round(F.col("k") * width, 10), "n_above": F.sum("n").over(above)})


def mc_maximum_curvature(sample: DataFrame, keys: list[str]) -> DataFrame:
    """Mode of the histogram plus a correction; the smallest bin wins ties, small samples have none."""
    h = sample.where("magnitude is not null").groupBy(*keys, magnitude_bin(F.col("magnitude")).alias("bin")).agg(F.count("*").alias("n"))
    out = h.groupBy(*keys).agg(F.sum("n").alias("events"), F.max_by("bin", F.struct("n", -F.col("bin"))).alias("mode"))
    return out.select(*keys, "events", support_state(F.col("events")).alias("support"), F.when(F.col("events") >= MIN_EVENTS, F.round(F.col("mode") + CORRECTION, 10)).alias("mc"))


def mc_goodness_of_fit(sample: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest bin whose exponential law explains 95 (else 90) per cent of the counts above it.

    Residuals compare cumulative counts with those of the maximum-likelihood law from each candidate
    bin; candidates need ten events and ten bins above them. All candidates of all groups are one
    join of the histogram with itself, some eighty rows a group."""
    h = histogram(sample, keys)
    moments = Window.partitionBy(*keys).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    c = h.withColumn("mean", F.sum(F.col("n") * F.col("bin")).over(moments) / F.col("n_above"))
    c = c.withColumn("b", F.log10(F.lit(2.718281828459045)) / (F.col("mean") - (F.col("bin") - WIDTH / 2)))
    top = h.groupBy(*keys).agg(F.max("k").alias("top"), F.sum("n").alias("events"))
    c = _match(c, top, keys).where((F.col("n_above") >= FIT_EVENTS) & (F.col("top") - F.col("k") + 1 >= FIT_BINS) & (F.col("mean") > F.col("bin") - WIDTH / 2))
    x, y = c.select(*keys, F.col("k").alias("k0"), F.col("bin").alias("bin0"), F.col("n_above").alias("n0"), "b", "events"), h.select(*keys, "k", "bin", "n_above")
    law = F.col("n0") * F.pow(F.lit(10.0), -F.col("b") * (F.col("bin") - F.col("bin0")))
    fit = _match(x, y, keys).where("k >= k0").groupBy(*keys, "k0", "bin0", "b", "events").agg((100 * (1 - F.sum(F.abs(F.col("n_above") - law)) / F.sum("n_above"))).alias("fit"))
    best = fit.groupBy(*keys).agg(F.max("events").alias("events"), *(F.min(F.when(F.col("fit") >= t, F.col("bin0"))).alias(f"mc{int(t)}") for t in TARGETS))
    return best.select(*keys, "events", F.when(F.col("events") >= MIN_EVENTS, F.coalesce("mc95", "mc90")).alias("mc"), F.when(F.col("mc95").isNotNull(), 95).when(F.col("mc90").isNotNull(), 90).alias("confidence"))


def b_value(sample: DataFrame, keys: list[str], mc) -> DataFrame:
    """Aki's b of binned magnitudes at or above ``mc`` with its error, a, and flags; nulls below 50."""
    binned, cut = magnitude_bin(F.col("magnitude")), magnitude_bin(mc if not isinstance(mc, float) else F.lit(mc))
    s = sample.where("magnitude is not null").withColumns({"m": binned, "mc": cut}).where(F.col("m") >= F.col("mc") - 1e-9)
    g = s.groupBy(*keys, "mc").agg(F.count("*").alias("n"), F.avg("m").alias("mean"), F.var_samp("m").alias("var"), (F.max("m") - F.first("mc")).alias("range"))
    ok = (F.col("n") >= MIN_EVENTS) & (F.col("mean") > F.col("mc") - WIDTH / 2)
    b = F.when(ok, F.log10(F.lit(2.718281828459045)) / (F.col("mean") - (F.col("mc") - WIDTH / 2)))
    g = g.withColumn("b", b).withColumns({"b_error": 2.30 * F.col("b") * F.col("b") * F.sqrt(F.col("var") / F.col("n")), "a": F.log10("n") + F.col("b") * F.col("mc")})
    return g.select(*keys, "mc", "n", "b", "b_error", "a", (F.col("range") < 1.5).alias("limited_range"), F.when(F.col("b").isNotNull(), ~F.col("b").between(0.5, 1.5)).alias("unusual"))


def b_value_sweep(sample: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """b for several thresholds at once: each magnitude counts towards every threshold below it."""
    spread = sample.withColumn("threshold", F.explode(F.array(*(F.lit(float(x)) for x in thresholds))))
    return b_value(spread, [*keys, "threshold"], F.col("threshold"))
