"""Column functions: guarded windows, normal distribution, moments."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def by_time():
    """Each series in order of time."""
    return W.partitionBy("symbol").orderBy("ts")



def trailing(n: int):
    return by_time().rowsBetween(-(n - 1), 0)


def full(value: Column, of: Column, n: int) -> Column:
    """A trailing statistic, null until the window holds n values."""
    return F.when(F.count(of).over(trailing(n)) == n, value)


def log_return(price: str = "adj_close", lag: int = 1) -> Column:
    c = F.col(price)
    return F.ln(c / F.lag(c, lag).over(by_time()))


def normal_cdf(x: Column) -> Column:
    """Abramowitz and Stegun 26.2.17 (absolute error below 7.5e-8)."""
    # The coefficients of the published approximation.
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (b[0] + t * (b[1] + t * (b[2] + t * (b[3] + t * b[4]))))
    upper = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def normal_cdf_sql(x: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({x})))"
    poly = f"{t}*(0.319381530+{t}*(-0.356563782+{t}*(1.781477937+{t}*(-1.821255978+{t}*1.330274429))))"
    upper = f"(exp(-({x})*({x})/2) / {math.sqrt(2 * math.pi)!r} * {poly})"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {upper} ELSE {upper} END)"


def sample_skew(x: Column) -> Column:
    """Adjusted Fisher-Pearson skewness (n >= 3)."""
    n = F.count(x)
    return F.when(n >= 3, F.skewness(x) * F.sqrt((n * (n - 1)).cast("double")) / (n - 2))


def sample_excess_kurtosis(x: Column) -> Column:
    n = F.count(x).cast("double")
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def half_even(x: Column, step: float) -> Column:
    return F.rint(x / step) * step + 0.0
