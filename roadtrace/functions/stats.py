"""Aggregate Column builders that follow the library's NULL and edge rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadtrace.functions.geo import _c


def finite(x) -> Column:
    """The number, with NaN and infinities as NULL."""
    x = _c(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def finite_number(text) -> Column:
    """Text to a finite double; anything else is NULL."""
    return finite(F.expr("try_cast(trim(`{}`) as double)".format(text)) if isinstance(text, str) else text)


def safe_corr(x, y, min_n: int = 2, eps: float = 0.0, window=None) -> Column:
    """Pearson correlation of the rows where both are set; NULL below ``min_n`` rows or where a deviation is at most ``eps``.

    Built from population moments because ``corr`` raises on a constant column in ANSI mode.
    """
    x, y = _c(x), _c(y)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    over = (lambda c: c.over(window)) if window is not None else (lambda c: c)
    n, cov, sa, sb = over(F.count(a)), over(F.covar_pop(a, b)), over(F.stddev_pop(a)), over(F.stddev_pop(b))
    return F.when((n >= min_n) & (sa > eps) & (sb > eps), F.try_divide(cov, sa * sb))


PERCENTS = (0, 1, 10, 25, 50, 75, 90, 99, 100)


def distribution(x, percents=PERCENTS) -> list[Column]:
    """samples, mean, std, mean_abs, zero_percent and linear percentiles p0 ... p100."""
    x = _c(x)
    out = [F.count(x).alias("samples"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.avg(F.abs(x)).alias("mean_abs")]
    out.append((100 * F.avg(F.when(x.isNotNull(), (F.abs(x) < 1e-12).cast("double")))).alias("zero_percent"))
    return out + [F.percentile(x, p / 100).alias(f"p{p}") for p in percents]


def running_variance(values) -> Column:
    """Population variance of an array's values in their order by Welford's recurrence (NULLs left out of the array); NULL for an empty one.

    ``var_pop`` forms its squares in another way, so where the variance lies on a threshold the two may differ by a last bit.
    """
    state = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(s, x):
        mean = s["mean"] + (x - s["mean"]) / (s["n"] + 1)
        return F.struct((s["n"] + 1).alias("n"), mean.alias("mean"), (s["m2"] + (x - mean) * (x - s["mean"])).alias("m2"))

    return F.aggregate(values, state, add, lambda s: F.try_divide(s["m2"], s["n"]))


def circular_mean(angle) -> Column:
    angle = _c(angle)
    return F.atan2(F.sum(F.sin(angle)), F.sum(F.cos(angle)))


def circular_r(angle) -> Column:
    """Mean resultant length: 1 where all angles agree."""
    angle = _c(angle)
    return F.try_divide(F.sqrt(F.sum(F.sin(angle)) ** 2 + F.sum(F.cos(angle)) ** 2), F.count(angle))


def regression_metrics(actual, predicted) -> list[Column]:
    """MAE, RMSE, R2 (NULL for a constant target), bias and shares within 1, 2 and 5 units, of rows where both are set."""
    a, p = _c(actual), _c(predicted)
    e = p - a
    a = F.when(e.isNotNull(), a)
    spread = F.sum(a * a) - F.sum(a) * F.try_divide(F.sum(a), F.count(a))
    r2 = 1 - F.try_divide(F.sum(e * e), F.when(F.var_pop(a) > 0, spread))
    within = [(100 * F.avg((F.abs(e) <= k).cast("double"))).alias(f"within_{k}_percent") for k in (1, 2, 5)]
    return [F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), r2.alias("r2"), F.avg(e).alias("bias"), *within]


def delta_metrics(actual, predicted) -> list[Column]:
    """Metrics of a change prediction against predicting no change."""
    a, p = _c(actual), _c(predicted)
    base = F.avg(F.abs(F.when((p - a).isNotNull(), a)))
    mae = F.avg(F.abs(p - a))
    return [*regression_metrics(actual, predicted)[:3], base.alias("zero_delta_mae"), (100 * (1 - F.try_divide(mae, base))).alias("improvement_percent")]


def nearest_rank(rank: Column, n: Column, fraction: float) -> Column:
    """Whether a 1-based rank among n is the one at round-half-even(fraction * (n - 1))."""
    return rank == F.least(n, F.bround(F.lit(fraction) * (n - 1), 0).cast("long") + 1)
