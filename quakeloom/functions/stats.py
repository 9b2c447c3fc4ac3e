"""Probability functions that Spark lacks, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LN10 = math.log(10.0)
# fixed values: rational approximations of the error function (Cody, 1969)
ERF_TOP = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
ERF_BOTTOM = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
ERFC_TOP = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3)
ERFC_BOTTOM = (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3)


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def erf(x: Column) -> Column:
    """Error function in plain arithmetic, which stays in generated code; errors below 1e-12."""
    z, y = F.least(F.abs(x), F.lit(6.0)), x * x
    near = x * _polynomial(y, ERF_TOP) / _polynomial(y, ERF_BOTTOM)
    far = 1.0 - F.exp(-z * z) * _polynomial(z, ERFC_TOP) / _polynomial(z, ERFC_BOTTOM)
    return F.when(F.abs(x) <= 0.46875, near).otherwise(F.signum(x) * far)


def normal_cdf(value: Column, mean: Column, sigma: Column) -> Column:
    return 0.5 * (1.0 + erf((value - mean) / (sigma * math.sqrt(2.0))))


def interval_mass(lower: Column, upper: Column, mean: Column, sigma: Column) -> Column:
    return F.greatest(F.lit(0.0), normal_cdf(upper, mean, sigma) - normal_cdf(lower, mean, sigma))


def log_factorial(n: Column) -> Column:
    terms = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(terms, F.lit(0.0), lambda a, k: a + F.log(k.cast("double")))


def poisson_log_pmf(n: Column, rate: Column) -> Column:
    """Log probability of a count; rates are floored at 1e-12."""
    floored = F.greatest(rate, F.lit(1e-12))
    return n * F.log(floored) - floored - log_factorial(n)


def _poisson_pmf(n: Column, rate: Column) -> Column:
    """Probability of a count of 20 or more, by Stirling's series and the deviance n (u - log(1 + u)) of
    u = rate / n - 1, which keeps its digits where n and the rate are large and close."""
    u = (rate - n) / n
    series = 1 / (12 * n) - 1 / (360 * F.pow(n, 3)) + 1 / (1260 * F.pow(n, 5)) - 1 / (1680 * F.pow(n, 7))
    return F.exp(-n * (u - F.log1p(u)) - 0.5 * F.log(2 * math.pi * n) - series)


def poisson_cdf(n: Column, rate: Column) -> Column:
    """P(N <= n); 0 below zero.

    Counts below 20 are summed from zero. From 20 on, the tail that lies away from the mode is summed
    from its largest term, whose factors fall below exp(-40) of it within 12 sqrt(n or rate) + 100
    terms, under the last digit of a double; nothing underflows at large rates."""
    steps = F.sequence(F.lit(0), F.least(F.greatest(n, F.lit(0)), F.lit(19)).cast("int"))
    start = F.struct(F.exp(-rate).alias("term"), F.lit(0.0).alias("total"))
    small = F.aggregate(steps, start, lambda a, k: F.struct((a.term * rate / (k + 1)).alias("term"), (a.total + a.term).alias("total"))).total

    def tail(first: Column, far: Column, factor) -> Column:
        terms = F.sequence(F.lit(1), (12 * F.sqrt(far) + 100).cast("int"))
        one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
        step = lambda a, j: F.struct((a.term * factor(j)).alias("term"), (a.total + a.term * factor(j)).alias("total"))
        return _poisson_pmf(first, rate) * F.aggregate(terms, one, step).total

    m = n.cast("double")
    below = tail(m, rate, lambda j: F.greatest(m - j + 1, F.lit(0.0)) / rate)
    above = 1 - tail(m + 1, m + 1, lambda j: rate / (m + 1 + j))
    return F.when(n < 0, 0.0).otherwise(F.least(F.lit(1.0), F.when(n < 20, small).when(rate <= 0, 1.0).when(n < rate, below).otherwise(above)))


def poisson_ppf(q: Column, rate: Column) -> Column:
    """The least n with P(N <= n) >= q, for 0 < q < 1; null for other q.

    Terms are added up from 12 standard deviations below the rate, where nothing is left out that a double
    shows, to as far above it."""
    rate = F.greatest(rate, F.lit(1e-12))
    first = F.greatest(F.lit(0.0), F.floor(rate - 12 * F.sqrt(rate) - 12).cast("double"))
    term = F.when(first > 0, _poisson_pmf(F.greatest(first, F.lit(1.0)), rate)).otherwise(F.exp(-rate))
    steps = F.sequence(F.lit(1), (24 * F.sqrt(rate) + 60).cast("int"))
    start = F.struct(term.alias("term"), term.alias("total"), first.alias("n"))

    def step(a: Column, j: Column) -> Column:
        more, next_term = a.total < q, a.term * rate / (first + j)
        return F.struct(next_term.alias("term"), F.when(more, a.total + next_term).otherwise(a.total).alias("total"), F.when(more, first + j).otherwise(a.n).alias("n"))

    return F.when((q > 0) & (q < 1), F.aggregate(steps, start, step).n.cast("long"))


def at_least_one(expected: Column) -> Column:
    """Chance of an event, with the clamps used for places."""
    return F.when(expected <= 0, 0.0).when(expected > 50, 1.0).otherwise(1.0 - F.exp(-expected))


def excess_deviance(observed: Column, expected: Column) -> Column:
    """One-sided Poisson deviance: only counts above the expectation score."""
    inside = 2.0 * (observed * F.log(observed / expected) - (observed - expected))
    return F.when(expected <= 0, F.when(observed == 0, 0.0).otherwise(float("inf"))).when(observed <= expected, 0.0).otherwise(inside)


def omori_integral(c, p, days) -> Column:
    """Integral of (t + c) ** -p from 0 to ``days``; logarithmic at p = 1."""
    c, p, days = (x if isinstance(x, Column) else F.lit(float(x)) for x in (c, p, days))
    power = (F.pow(days + c, 1 - p) - F.pow(c, 1 - p)) / F.when(F.abs(p - 1) < 1e-8, 1.0).otherwise(1 - p)
    return F.when(F.abs(p - 1) < 1e-8, F.log((days + c) / c)).otherwise(power)


def spatial_density(r_km: Column, d_km: Column, q: float) -> Column:
    """Isotropic power-law density around a parent, of mass 1 on the plane."""
    return (q - 1) / (math.pi * d_km * d_km) * F.pow(1 + r_km * r_km / (d_km * d_km), F.lit(-q))


def magnitude_bin(m: Column, width: float = 0.1) -> Column:
    """Bin of a magnitude: half-even on the index, then rounded to 10 decimals."""
    return F.round(F.rint(m / width) * width, 10)


def bin_fraction(lower: Column, upper: Column, b: float, reference: float) -> Column:
    """Share of events above ``reference`` in [lower, upper); an open bin has a null upper edge, a
    bin that starts below the reference has no estimate."""
    top = F.pow(F.lit(10.0), -b * (lower - reference))
    rest = F.coalesce(F.pow(F.lit(10.0), -b * (upper - reference)), F.lit(0.0))
    return F.when(lower >= reference, top - rest)


def support_state(n: Column) -> Column:
    return F.when(n >= 200, "supported").when(n >= 100, "high_uncertainty").when(n >= 50, "research_only").otherwise("not_estimable")
