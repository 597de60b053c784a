"""Fractional differencing with a fixed window, unit-root tests and the search for the least order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import by_time, normal_cdf


def ffd_weights(d: float, threshold: float = 1e-5, size: int | None = None) -> list[float]:
    """Binomial weights, newest first, until one is smaller than the threshold (or ``size`` are made)."""
    out = [1.0]
    while size is None or len(out) < size:
        k = len(out)
        w = -out[-1] * (d - k + 1) / k
        if abs(w) < threshold:
            break
        out.append(w)
    return out


def weight_table(spark, d: float, threshold: float, size: int | None = None) -> DataFrame:
    rows = [(k, w) for k, w in enumerate(ffd_weights(d, threshold, size))]
    return spark.createDataFrame(rows, "k int, weight double")


def frac_diff(df: DataFrame, column: str, d: float, threshold: float = 1e-5) -> DataFrame:
    """symbol, ts, fracdiff: the weighted sum of the last values (missing ones filled forward), null
    until the window is full. Wide windows are convolved in a task per series."""
    weights = ffd_weights(d, threshold)
    n = len(weights)
    filled = df.select("symbol", "ts", F.last(column, ignorenulls=True).over(by_time().rowsBetween(W.unboundedPreceding, 0)).alias("x")).na.drop()
    if n <= 64:
        values = F.collect_list("x").over(by_time().rowsBetween(-(n - 1), 0))
        oldest_first = F.array(*[F.lit(w) for w in weights[::-1]])
        sum_ = F.aggregate(F.zip_with("v", oldest_first, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return filled.withColumn("v", values).select("symbol", "ts", F.when(F.size("v") == n, sum_).alias("fracdiff"))

    def run(pdf):
        import numpy as np

        pdf = pdf.sort_values("ts")
        x = pdf["x"].to_numpy()
        out = np.full(len(x), np.nan)
        if len(x) >= n:
            out[n - 1 :] = np.convolve(x, weights, "valid")
        return pdf.assign(fracdiff=out)[["symbol", "ts", "fracdiff"]]

    out = filled.groupBy("symbol").applyInPandas(run, "symbol string, ts timestamp, fracdiff double")
    return out.withColumn("fracdiff", F.nanvl("fracdiff", F.lit(None).cast("double")))


def adf(df: DataFrame, column: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """keys, adf_stat, p_value, n: regression of the difference on a constant, the lagged level and one
    lagged difference. Everything comes from sums of products of centred columns."""
    w = W.partitionBy(*keys).orderBy("ts")
    own = W.partitionBy(*keys)
    x = df.where(F.col(column).isNotNull()).withColumn("x", F.col(column) - F.avg(column).over(own))
    x = x.withColumn("dx", F.col("x") - F.lag("x").over(w)).withColumns({"l": F.lag("x").over(w), "dl": F.lag("dx").over(w)})
    x = x.where("dl is not null")
    cov = lambda a, b: F.covar_pop(a, b)
    s = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.var_pop("l").alias("ll"), F.var_pop("dl").alias("dd"), cov("l", "dl").alias("ld"),
        cov("dx", "l").alias("yl"), cov("dx", "dl").alias("yd"), F.var_pop("dx").alias("yy"),
    )
    det = F.col("ll") * F.col("dd") - F.col("ld") * F.col("ld")
    b1 = F.try_divide(F.col("yl") * F.col("dd") - F.col("yd") * F.col("ld"), det)
    b2 = F.try_divide(F.col("yd") * F.col("ll") - F.col("yl") * F.col("ld"), det)
    s = s.withColumns({"det": det, "b1": b1, "b2": b2})
    rss = F.greatest(F.col("yy") - F.col("b1") * F.col("yl") - F.col("b2") * F.col("yd"), F.lit(0.0))
    se = F.sqrt(F.try_divide(rss, (F.col("n") - 3).cast("double")) * F.try_divide(F.col("dd"), F.col("det")))
    s = s.withColumn("adf_stat", F.try_divide(F.col("b1"), se))
    return s.select(*keys, "adf_stat", mackinnon_p(F.col("adf_stat")).alias("p_value"), "n")


def mackinnon_p(t: Column) -> Column:
    """Response surface of MacKinnon (1994) with a constant, one series."""
    low = normal_cdf(2.1659 + 1.4412 * t + 0.038269 * t * t)
    high = normal_cdf(1.7339 + 0.93202 * t - 0.12745 * t * t - 0.010368 * t * t * t)
    return F.when(t > 2.74, 1.0).when(t < -18.83, 0.0).when(t <= -1.61, low).otherwise(high)


def sweep(df: DataFrame, column: str, orders: list[float], threshold: float) -> DataFrame:
    """symbol, d, adf_stat, p_value, corr, n_obs, width: every order at once, a task per series and order."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(round(d, 2),) for d in orders], "d double")
    rows = df.select("symbol", "ts", F.col(column).alias("x")).na.drop().crossJoin(F.broadcast(grid))  # a grid of fixed size

    def run(key, pdf):
        import numpy as np

        pdf = pdf.sort_values("ts")
        weights = ffd_weights(key[1], threshold)
        x, n = pdf["x"].to_numpy(), len(weights)
        if len(x) < n:
            return pdf.iloc[:0].assign(y=0.0, width=0)
        return pdf.iloc[n - 1 :].assign(y=np.convolve(x, weights, "valid"), width=n)

    long = rows.groupBy("symbol", "d").applyInPandas(run, "symbol string, ts timestamp, x double, d double, y double, width long")
    with_corr = long.groupBy("symbol", "d").agg(F.corr("x", "y").alias("corr"), F.count(F.lit(1)).alias("n_obs"), F.first("width").alias("width"))
    return adf(long, "y", ("symbol", "d")).drop("n").join(with_corr.where("n_obs >= 10"), ["symbol", "d"])


def least_order(swept: DataFrame, p_max: float = 0.05, corr_min: float = 0.9) -> DataFrame:
    """symbol, d_star, rule: the least stationary order that keeps memory; else the stationary one of
    largest correlation; else 1."""
    still = F.col("p_value") < p_max
    out = swept.groupBy("symbol").agg(
        F.min(F.when(still & (F.col("corr") >= corr_min), F.col("d"))).alias("strict"),
        F.max_by("d", F.when(still, F.col("corr"))).alias("relaxed"),
        F.max(F.when(still, 1).otherwise(0)).alias("any"),
    )
    relaxed = F.when(F.col("any") == 1, F.col("relaxed"))
    rule = F.when(F.col("strict").isNotNull(), "strict").when(relaxed.isNotNull(), "relaxed").otherwise("default")
    return out.select("symbol", F.coalesce("strict", relaxed, F.lit(1.0)).alias("d_star"), rule.alias("rule"))
