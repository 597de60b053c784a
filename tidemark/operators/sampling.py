"""Event sampling and bars built from accumulators that reset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import by_time, log_return


def with_returns(df: DataFrame) -> DataFrame:
    return df.withColumns({"log_return": log_return(), "dollar_volume": F.col("adj_close") * F.col("volume")})


def clean_bars(df: DataFrame) -> DataFrame:
    """Returns and dollar volume; the first row of each series and rows with nulls go."""
    return with_returns(df).na.drop()


def quality(df: DataFrame) -> DataFrame:
    """What must be zero in clean bars, one row."""
    bad = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    keyed = df.withColumn("previous", F.lag("ts").over(by_time()))
    nulls = F.greatest(*[F.col(c).isNull().cast("int") for c in df.columns])
    return keyed.agg(
        F.count(F.lit(1)).alias("n_rows"),
        bad(nulls == 1).alias("n_null"),
        bad(F.col("previous") >= F.col("ts")).alias("n_unordered"),
        bad((F.col("close") <= 0) | (F.col("adj_close") <= 0)).alias("n_price"),
        bad(F.col("volume") <= 0).alias("n_volume"),
    )


def expanding_mean(df: DataFrame, column: str) -> DataFrame:
    mean = F.avg(column).over(by_time().rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("expanding_mean", mean)


def _cusum_places(y, mean, h):
    """Places of events: two one-sided sums with drift and threshold h, both reset by an event."""
    up = down = 0.0
    out = []
    for i, (v, e) in enumerate(zip(y, mean, strict=True)):
        up, down = max(0.0, up + v - e - h), min(0.0, down + v - e + h)
        if up > h or down < -h:
            up = down = 0.0
            out.append(i)
    return out


def _returns_of(pdf):
    """Returns in order of time, without missing ones, and their expanding means."""
    import numpy as np

    pdf = pdf.sort_values("ts")
    price = pdf["adj_close"].to_numpy()
    y = np.log(price[1:] / price[:-1])
    keep = ~np.isnan(y)
    y, ts = y[keep], pdf["ts"].to_numpy()[1:][keep]
    return ts, y, np.cumsum(y) / np.arange(1, len(y) + 1)


def cusum_events(df: DataFrame, h: float) -> DataFrame:
    """symbol, t0 of the symmetric CUSUM filter: a scan with resets, a task per series."""

    def scan(pdf):
        import pandas as pd

        ts, y, mean = _returns_of(pdf)
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "t0": ts[_cusum_places(y.tolist(), mean.tolist(), h)]})

    return df.select("symbol", "ts", "adj_close").groupBy("symbol").applyInPandas(scan, "symbol string, t0 timestamp")


def calibrated_cusum(df: DataFrame, target: int = 400, rounds: int = 20) -> DataFrame:
    """symbol, h, n_events: bisection for the threshold nearest to the target, inside each series' task."""

    def search(pdf):
        import pandas as pd

        _, y, mean = _returns_of(pdf)
        y, mean = y.tolist(), mean.tolist()
        low, high = 1e-4, 0.5
        best, away, found = high, float("inf"), 0
        for _ in range(rounds):
            h = (low + high) / 2
            n = len(_cusum_places(y, mean, h))
            if abs(n - target) < away:
                best, away, found = h, abs(n - target), n
            if n == target:
                break
            if n > target:
                low = h
            else:
                high = h
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "h": [best], "n_events": [found]})

    return df.select("symbol", "ts", "adj_close").groupBy("symbol").applyInPandas(search, "symbol string, h double, n_events long")


def dollar_bars(df: DataFrame, threshold: float) -> DataFrame:
    """Bars of equal dollar volume: a bar closes when its sum reaches the threshold, what exceeds it is
    dropped; a last unfinished bar is left out."""

    def number(pdf):
        pdf = pdf.sort_values("ts")
        total, bar, out = 0.0, 0, []
        for v in (pdf["adj_close"] * pdf["volume"]).tolist():
            total += v
            out.append(bar)
            if total >= threshold:
                total, bar = 0.0, bar + 1
        pdf = pdf.assign(bar=out)
        return pdf[pdf["bar"] < bar]

    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes) + ", bar long"
    numbered = df.groupBy("symbol").applyInPandas(number, schema)
    return numbered.groupBy("symbol", "bar").agg(
        F.max("ts").alias("ts"),
        F.min_by("open", "ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"),
        F.max_by("adj_close", "ts").alias("adj_close"),
        F.sum("volume").alias("volume"),
    )


def dollar_threshold(df: DataFrame, bars_a_year: int = 252) -> DataFrame:
    """symbol, threshold: dollar volume over the bars wanted in the time the series covers."""
    days = F.datediff(F.max("ts"), F.min("ts"))
    years = F.when(days == 0, F.count(F.lit(1)) / 252.0).otherwise(days / 365.25)
    total = F.sum(F.col("adj_close") * F.col("volume"))
    return df.groupBy("symbol").agg(F.coalesce(F.try_divide(total, bars_a_year * years), F.lit(0.0)).alias("threshold"))


def bars_per_year(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol", F.year("ts").alias("year")).agg(F.count(F.lit(1)).alias("n_bars"))


def inter_event_days(events: DataFrame) -> DataFrame:
    w = W.partitionBy("symbol").orderBy("t0")
    out = events.withColumn("days", F.datediff("t0", F.lag("t0").over(w)).cast("long"))
    return out.where("days is not null").select("symbol", "t0", "days")


def outliers(df: DataFrame, sigma: float = 5.0) -> DataFrame:
    own = W.partitionBy("symbol")
    r = F.col("log_return")
    far = F.abs(r - F.avg(r).over(own)) > sigma * F.stddev_samp(r).over(own)
    return df.withColumn("far", far).where("far").drop("far")


def jarque_bera(df: DataFrame, column: str = "log_return") -> DataFrame:
    s, k, n = F.skewness(column), F.kurtosis(column), F.count(column)
    out = df.groupBy("symbol").agg(n.alias("n"), s.alias("skew"), k.alias("excess"))
    jb = F.col("n") / 6.0 * (F.col("skew") * F.col("skew") + F.col("excess") * F.col("excess") / 4)
    return out.select("symbol", jb.alias("jb"), F.exp(-jb / 2).alias("p_value"))


def describe(df: DataFrame, column: str) -> DataFrame:
    at = lambda q: F.percentile(column, F.lit(q))
    return df.groupBy("symbol").agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("low"),
        at(0.25).alias("q25"), at(0.5).alias("q50"), at(0.75).alias("q75"), F.max(column).alias("high"),
    )


def qq_points(df: DataFrame, column: str) -> DataFrame:
    """Sorted values against normal quantiles at (i - 0.5) / n."""

    @F.pandas_udf("double")
    def quantile(p):
        from statistics import NormalDist

        return p.map(NormalDist().inv_cdf)

    w = W.partitionBy("symbol")
    rows = df.where(F.col(column).isNotNull())
    p = (F.row_number().over(w.orderBy(column, "ts")) - 0.5) / F.count(F.lit(1)).over(w)
    return rows.withColumn("p", p).select("symbol", "ts", F.col(column).alias("value"), quantile("p").alias("quantile"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts of equal-width bins between the extremes, the last closed on the right."""
    own = W.partitionBy("symbol")
    x, low, high = F.col(column), F.min(column).over(own), F.max(column).over(own)
    at = F.when(high == low, 0).otherwise(F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1)))
    rows = df.where(x.isNotNull()).withColumn("bin", at.cast("long"))
    return rows.groupBy("symbol", "bin").agg(F.count(F.lit(1)).alias("n"))


def strided(df: DataFrame, stride: int = 10, first: int = 0) -> DataFrame:
    """Every stride-th row of each series from row ``first``."""
    pos = F.row_number().over(by_time()) - 1
    return df.withColumn("pos", pos.cast("long")).where((F.col("pos") % stride == 0) & (F.col("pos") >= first))
