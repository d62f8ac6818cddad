"""Report formatting expressions (percentages with intervals) and their inverse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pct_ci(est, lo, hi) -> Column:
    """``51.23% (CI: 48.00% - 54.00%)``; ``(CI: N/A)`` when a bound is null; ``N/A`` for null estimate."""
    est, lo, hi = _c(est), _c(lo), _c(hi)
    return (
        F.when(est.isNull(), F.lit("N/A"))
        .when(lo.isNull() | hi.isNull(), F.format_string("%.2f%% (CI: N/A)", est * 100))
        .otherwise(F.format_string("%.2f%% (CI: %.2f%% - %.2f%%)", est * 100, lo * 100, hi * 100))
    )


def num_ci(est, lo, hi, digits: int = 4) -> Column:
    """``0.1234 (CI: 0.0100 - 0.2000)`` for unbounded metrics such as MCC."""
    est, lo, hi = _c(est), _c(lo), _c(hi)
    f = f"%.{digits}f"
    return (
        F.when(est.isNull(), F.lit("N/A"))
        .when(lo.isNull() | hi.isNull(), F.format_string(f"{f} (CI: N/A)", est))
        .otherwise(F.format_string(f"{f} (CI: {f} - {f})", est, lo, hi))
    )


def num(est, digits: int = 4) -> Column:
    est = _c(est)
    return F.when(est.isNull(), F.lit("N/A")).otherwise(F.format_string(f"%.{digits}f", est))


def leading_number(s) -> Column:
    """Inverse of the formats: the leading number of ``'51.23% (CI: ...)'`` as double."""
    return F.regexp_extract(_c(s), r"^\s*(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
