"""Scores of probability and rate forecasts, and their consistency tests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import poisson_cdf, poisson_log_pmf
from ..plans.checkpointing import materialize
from ..plans.ranks import running_rank

CLIP = 1e-12
#: Parts into which the bins of a simulated test are dealt.
BLOCKS = 256


def basic_scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Log loss, Brier score, joint log likelihood, coverage and information gain per event of
    (observed, probability, rate, reference_rate): one pass for all groups."""
    y = (F.col("observed") > 0).cast("double")
    p = F.least(F.greatest("probability", F.lit(CLIP)), F.lit(1 - CLIP))
    n = F.col("observed").cast("double")
    inside = ((F.col("observed") == 0) | (poisson_cdf(F.col("observed") - 1, F.col("rate")) < 0.975)) & (poisson_cdf(F.col("observed"), F.col("rate")) >= 0.025)
    own, other = poisson_log_pmf(n, F.col("rate")), poisson_log_pmf(n, F.col("reference_rate"))
    g = rows.groupBy(*keys).agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"), F.avg((F.col("probability") - y) ** 2).alias("brier"), F.sum(own).alias("log_likelihood"), F.sum(other).alias("reference_log_likelihood"), F.avg(inside.cast("double")).alias("coverage"), F.sum("observed").alias("events"), F.sum("rate").alias("expected"))
    gain = F.try_divide(F.col("log_likelihood") - F.col("reference_log_likelihood"), F.col("events"))
    return g.withColumn("gain_per_event", gain)


def threshold_scores(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """Precision, recall, false alarm rate and F1 at each threshold; null where undefined."""
    t = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    hit, said = F.col("observed") > 0, F.col("probability") >= F.col("threshold")
    g = t.groupBy("threshold").agg(F.count_if(said & hit).alias("tp"), F.count_if(said & ~hit).alias("fp"), F.count_if(~said & hit).alias("fn"), F.count_if(~said & ~hit).alias("tn"))
    return g.select("threshold", "tp", "fp", "fn", "tn", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"), F.try_divide("fp", F.col("fp") + F.col("tn")).alias("false_alarm"), F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def roc_auc(rows: DataFrame) -> DataFrame:
    """Chance that a hit outranks a miss, ties counting half; null with one class only.

    Counts per distinct probability are enough: values are ranked in ranges, not in one task."""
    g = rows.groupBy("probability").agg(F.count_if(F.col("observed") > 0).alias("hits"), F.count_if(F.col("observed") == 0).alias("misses"))
    ranged = g.repartitionByRange("probability").withColumn("part", F.spark_partition_id())

    ranged = materialize(ranged, "auc")
    before = ranged.groupBy("part").agg(F.sum("misses").alias("n")).withColumn("head", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("part").orderBy("probability").rowsBetween(Window.unboundedPreceding, -1)
    lower = ranged.withColumn("lower", F.coalesce(F.sum("misses").over(w), F.lit(0))).join(F.broadcast(before.select("part", "head")), "part")
    s = lower.agg(F.sum(F.col("hits") * (F.col("head") + F.col("lower") + F.col("misses") / 2)).alias("u"), F.sum("hits").alias("h"), F.sum("misses").alias("m"))
    return s.select(F.try_divide(F.col("u"), F.col("h").cast("double") * F.col("m")).alias("auc"))


def average_precision(rows: DataFrame, id_column: str) -> DataFrame:
    """Mean of precision over the steps of recall, by falling probability (ties by id)."""
    r = running_rank(rows.select(F.struct((-F.col("probability")).alias("p"), F.col(id_column).alias("i")).alias("o"), "observed"), "o")
    hits = running_rank(r.where("observed > 0").select("o", F.col("rank").alias("place")), "o")
    return hits.agg((F.sum(F.col("rank") / F.col("place")) / F.count("*")).alias("average_precision"))


def reliability(rows: DataFrame, id_column: str, buckets: int = 10) -> DataFrame:
    """(bucket, n, mean_probability, observed_share): equal-count buckets with edges trunc(i * n / B)."""
    n = rows.count()
    r = running_rank(rows.select(F.struct("probability", F.col(id_column).alias("i")).alias("o"), "probability", "observed"), "o")
    edges = [i * n // buckets for i in range(buckets + 1)]
    bucket = F.lit(buckets - 1)
    for k in range(buckets - 2, -1, -1):
        bucket = F.when(F.col("rank") <= edges[k + 1], k).otherwise(bucket)
    return r.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg("probability").alias("mean_probability"), F.avg((F.col("observed") > 0).cast("double")).alias("observed_share"))


def number_test(totals: DataFrame, alpha: float = 0.05) -> DataFrame:
    """``totals`` (observed, expected) with both tails and whether the count is consistent."""
    low, high = poisson_cdf(F.col("observed"), F.col("expected")), 1 - poisson_cdf(F.col("observed") - 1, F.col("expected"))
    return totals.select("*", high.alias("p_at_least"), low.alias("p_at_most"), ((low > alpha / 2) & (high > alpha / 2)).alias("consistent"))


def calibration_error(curve: DataFrame) -> DataFrame:
    """(ece): mean distance between probability and observed share of a reliability curve, by its counts."""
    gap = F.abs(F.col("mean_probability") - F.col("observed_share"))
    return curve.agg(F.try_divide(F.sum(F.col("n") * gap), F.sum("n")).alias("ece"))


def _in_blocks(bins: DataFrame) -> DataFrame:
    return bins.select("id", "observed", "rate", F.pmod(F.xxhash64("id"), F.lit(BLOCKS)).cast("int").alias("block"))


def _simulated(blocks: DataFrame, simulations: int, alpha: float, scale: float, draws) -> DataFrame:
    """Where the observed joint log likelihood lies among simulated ones.

    ``draws(block, rates)`` yields one array of counts per simulation. A block is a fixed share of the
    bins, in the order of their ids, so the result does not depend on partitions; one vector of sums
    per block is shuffled."""

    def part(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        rate = g.rate.to_numpy(float)
        lam = np.maximum(rate * scale, CLIP)
        log_lam, area, table = np.log(lam), lam.sum(), np.zeros(1)

        def score(counts: np.ndarray) -> float:
            nonlocal table
            top = int(counts.max(initial=0))
            if top >= len(table):
                table = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 2 * top + 2)))])
            return float(counts @ log_lam - area - table[counts].sum())

        ll = [score(n) for n in draws(int(key[0]), rate)]
        return pd.DataFrame({"sim": np.arange(-1, simulations), "part": [score(g.observed.to_numpy(np.int64)), *ll]})

    sums = blocks.groupBy("block").applyInPandas(part, "sim int, part double").groupBy("sim").agg(F.sum("part").alias("ll"))
    seen = sums.where("sim = -1").select(F.col("ll").alias("seen"))
    both = sums.where("sim >= 0").join(F.broadcast(seen), F.lit(True))
    out = both.agg(F.first("seen").alias("observed_ll"), F.avg("ll").alias("mean_ll"), F.percentile("ll", 0.05).alias("p05_ll"), F.percentile("ll", 0.95).alias("p95_ll"), F.avg((F.col("ll") <= F.col("seen")).cast("double")).alias("quantile")).where("quantile is not null")
    return out.withColumn("consistent", F.col("quantile") >= alpha)


def likelihood_test(bins: DataFrame, simulations: int = 1000, seed: int = 1, alpha: float = 0.05) -> DataFrame:
    """L-test: (observed_ll, mean_ll, p05_ll, p95_ll, quantile, consistent) of independent Poisson bins
    (id, observed, rate); no row without bins."""

    def draws(block: int, rate: np.ndarray) -> Iterator[np.ndarray]:
        r = np.random.default_rng([seed, block])
        return (r.poisson(np.maximum(rate, CLIP)) for _ in range(simulations))

    return _simulated(_in_blocks(bins), simulations, alpha, 1.0, draws)


def marginal_test(bins: DataFrame, simulations: int = 1000, seed: int = 1, alpha: float = 0.05) -> DataFrame:
    """S-test (bins are cells) or M-test (bins are magnitude bins): the shape alone, given the total.

    Every simulated catalog has the observed number of events: it is dealt to the blocks by one
    multinomial, the same in every task, and within a block by another. Rates are scaled to the total.
    No row where nothing was observed or expected."""
    blocks = _in_blocks(bins)
    sums = {r.block: (float(r.rate or 0), int(r.n or 0)) for r in blocks.groupBy("block").agg(F.sum("rate").alias("rate"), F.sum("observed").alias("n")).collect()}  # BLOCKS rows at most
    keys = sorted(sums)
    weight, n = np.array([sums[k][0] for k in keys]), sum(v[1] for v in sums.values())
    if n == 0 or weight.sum() <= 0:
        return _simulated(blocks.limit(0), simulations, alpha, 1.0, lambda block, rate: iter(()))

    def draws(block: int, rate: np.ndarray) -> Iterator[np.ndarray]:
        share = np.random.default_rng([seed]).multinomial(n, weight / weight.sum(), simulations)[:, keys.index(block)]
        r, p = np.random.default_rng([seed, block]), rate / (rate.sum() or 1.0)
        return (r.multinomial(k, p) if k else np.zeros(len(p), np.int64) for k in share)

    return _simulated(blocks, simulations, alpha, n / float(weight.sum()), draws)


def bootstrap_mean(values: DataFrame, column: str, resamples: int = 1000, seed: int = 1, level: float = 0.95) -> DataFrame:
    """(mean, low, high): the mean of the values and percentiles of its resampled means; null below two.

    Values stay on the cluster. A resample draws as many values as there are: one multinomial, the same in
    every task, deals the draws to ``BLOCKS`` blocks of distinct values, and one in each block deals them to
    its values by their counts. A block hands on one sum per resample. Nulls and NaN are left out."""
    x = F.col(column).cast("double")
    counts = values.select(x.alias("x")).where("x is not null and not isnan(x)").groupBy("x").agg(F.count("*").alias("n"))
    counts = materialize(counts.withColumn("block", F.pmod(F.xxhash64("x"), F.lit(BLOCKS)).cast("int")), "values")
    held = {r.block: int(r.n) for r in counts.groupBy("block").agg(F.sum("n").alias("n")).collect()}  # BLOCKS rows at most
    keys, total = sorted(held), sum(held.values())
    mean = counts.agg(F.try_divide(F.sum(F.col("x") * F.col("n")), F.sum("n")).alias("mean"))
    if total < 2:
        return mean.select("mean", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    weight = np.array([held[k] for k in keys]) / total

    def draw(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("x")
        share = np.random.default_rng([seed]).multinomial(total, weight, resamples)[:, keys.index(int(key[0]))]
        r, p, v = np.random.default_rng([seed, int(key[0])]), g.n.to_numpy() / g.n.sum(), g.x.to_numpy()
        return pd.DataFrame({"sim": np.arange(resamples), "part": [float(r.multinomial(k, p) @ v) if k else 0.0 for k in share]})

    sums = counts.groupBy("block").applyInPandas(draw, "sim int, part double").groupBy("sim").agg((F.sum("part") / total).alias("mean"))
    tail = (1 - level) / 2
    return mean.join(sums.agg(F.percentile("mean", tail).alias("low"), F.percentile("mean", 1 - tail).alias("high")), F.lit(True))


def promotion(folds: DataFrame, least_folds: int = 10, least_events: int = 100, resamples: int = 1000, seed: int = 1) -> DataFrame:
    """One row: insufficient_evidence, retain_champion or promote, from paired folds
    (candidate_ll, champion_ll, events). The candidate must gain with 95 per cent confidence."""
    have = folds.agg(F.count("*").alias("n"), F.coalesce(F.sum("events"), F.lit(0)).alias("events")).first()
    gain = folds.select(F.try_divide(F.col("candidate_ll") - F.col("champion_ll"), F.col("events")).alias("gain"))
    out = bootstrap_mean(gain, "gain", resamples, seed)
    short = have.n < least_folds or have.events < least_events
    state = F.lit("insufficient_evidence") if short else F.when(F.col("low") > 0, "promote").otherwise("retain_champion")
    return out.select("mean", "low", "high", F.lit(have.n).alias("folds"), F.lit(have.events).alias("events"), state.alias("decision"))
