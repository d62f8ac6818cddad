"""Statistical Column expressions: ratios, Wilson interval, MCC."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def z_value(alpha: float = 0.05) -> float:
    """Two-sided normal quantile, computed on the driver once (a literal in the plan)."""
    return NormalDist().inv_cdf(1.0 - alpha / 2.0)


def dbl(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def ratio(num, den, zero=None) -> Column:
    """num/den as double; ``zero`` (a literal or None) when den == 0."""
    num, den = dbl(num), dbl(den)
    out = F.when(den != 0, num / den)
    return out.otherwise(F.lit(zero).cast("double")) if zero is not None else out


def wilson(k, n, alpha: float = 0.05) -> tuple[Column, Column, Column]:
    """Wilson score interval (p, lo, hi) clamped to [0, 1]; all null for n <= 0."""
    z = z_value(alpha)
    k, n = dbl(k), dbl(n)
    p = k / n
    denom = F.lit(1.0) + F.lit(z * z) / n
    center = (p + F.lit(z * z) / (F.lit(2.0) * n)) / denom
    margin = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + F.lit(z * z) / (F.lit(4.0) * n * n)) / denom
    ok = n > 0
    return (
        F.when(ok, p),
        F.when(ok, F.greatest(F.lit(0.0), center - margin)),
        F.when(ok, F.least(F.lit(1.0), center + margin)),
    )


def mcc(tp, fp, fn, tn) -> Column:
    """Matthews correlation; 0 when any marginal is empty."""
    tp, fp, fn, tn = dbl(tp), dbl(fp), dbl(fn), dbl(tn)
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.when(den > 0, (tp * tn - fp * fn) / den).otherwise(F.lit(0.0))


def f1(tp, fp, fn) -> Column:
    tp, fp, fn = dbl(tp), dbl(fp), dbl(fn)
    den = F.lit(2.0) * tp + fp + fn
    return F.when(den > 0, F.lit(2.0) * tp / den).otherwise(F.lit(0.0))
