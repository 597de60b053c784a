"""Trailing features of bars. All share one partitioning and order, so one exchange and one sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import by_time, full, log_return, trailing

YEAR = math.sqrt(252)
ENTROPY_WINDOW, ENTROPY_BINS = 50, 10
MOMENTUM = ("ret_5d", "ret_10d", "ret_20d", "ret_60d", "momentum_12_1", "rsi_14")
VOLATILITY = ("vol_20d", "vol_50d")
VOLUME = ("log_dollar_volume", "volume_ratio")
MICROSTRUCTURE = ("corwin_schultz_spread", "bekker_parkinson_vol", "amihud_illiquidity", "roll_spread")
ENTROPY = ("shannon_entropy", "lempel_ziv_complexity")
ALL = (*MOMENTUM, *VOLATILITY, *VOLUME, *MICROSTRUCTURE, *ENTROPY)
CORE = tuple(c for c in (*ALL, "fracdiff") if c not in ("momentum_12_1", "bekker_parkinson_vol"))


def _lag(c: str, n: int = 1) -> Column:
    return F.lag(c, n).over(by_time())


def momentum(df: DataFrame) -> DataFrame:
    cols = {f"ret_{d}d": log_return(lag=d) for d in (5, 10, 20, 60)}
    cols["momentum_12_1"] = log_return(lag=252) - log_return(lag=21)
    return df.withColumns(cols)


def rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's index: recursive averages with alpha 1/n, started by the first difference; a scan per series."""
    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes) + f", rsi_{n} double"

    def run(pdf):
        pdf = pdf.sort_values("ts")
        step = pdf["adj_close"].diff()
        up = step.clip(lower=0).ewm(alpha=1 / n, adjust=False).mean()
        down = (-step.clip(upper=0)).ewm(alpha=1 / n, adjust=False).mean()
        return pdf.assign(**{f"rsi_{n}": 100 - 100 / (1 + up / down)})

    out = df.groupBy("symbol").applyInPandas(run, schema)
    return out.withColumn(f"rsi_{n}", F.nanvl(f"rsi_{n}", F.lit(None).cast("double")))


def volatility(df: DataFrame) -> DataFrame:
    r = df.withColumn("__r", log_return())
    cols = {f"vol_{n}d": full(F.stddev_samp("__r").over(trailing(n)), F.col("__r"), n) * YEAR for n in (20, 50)}
    return r.withColumns(cols).drop("__r")


def volume(df: DataFrame) -> DataFrame:
    dv = F.col("adj_close") * F.col("volume")
    return df.withColumns(
        {
            "log_dollar_volume": F.ln(F.nullif(dv, F.lit(0.0))),
            "volume_ratio": F.try_divide(F.col("volume"), full(F.avg("volume").over(trailing(20)), F.col("volume"), 20)),
        }
    )


def microstructure(df: DataFrame) -> DataFrame:
    """Spread and illiquidity estimates from highs, lows and returns."""
    log_hl = F.ln(F.col("high") / F.col("low"))
    d = df.withColumns(
        {
            "__hl2": log_hl * log_hl,
            "__r": log_return(),
            "__dp": F.col("adj_close") - _lag("adj_close"),
            "__dv": F.nullif(F.col("adj_close") * F.col("volume"), F.lit(0.0)),
            "__ph": _lag("high"),
            "__pl": _lag("low"),
        }
    )
    k = 3 - 2 * math.sqrt(2)
    beta = F.col("__hl2") + _lag("__hl2")
    # greatest and least would pass over the missing neighbour of the first row.
    wide = F.when(F.col("__ph").isNotNull(), F.ln(F.greatest("high", "__ph") / F.least("low", "__pl")))
    alpha = (F.sqrt(2 * beta) - F.sqrt(beta)) / k - F.sqrt(wide * wide / k)
    d = d.withColumns({"__alpha": alpha, "__illiq": F.abs("__r") / F.col("__dv"), "__pdp": F.lag("__dp").over(by_time())})
    spread = 2 * (F.exp("__alpha") - 1) / (1 + F.exp("__alpha"))
    cov = F.covar_samp("__dp", "__pdp").over(trailing(20))
    both = F.when(F.col("__dp").isNotNull(), F.col("__pdp"))
    out = d.withColumns(
        {
            "corwin_schultz_spread": F.when(spread.isNotNull(), F.greatest(spread, F.lit(0.0))),
            "bekker_parkinson_vol": F.col("__hl2") / (4 * math.log(2)),
            "amihud_illiquidity": full(F.avg("__illiq").over(trailing(20)), F.col("__illiq"), 20),
            "roll_spread": full(2 * F.sqrt(F.greatest(-cov, F.lit(0.0))), both, 20),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def lz_phrases(bits: list[int]) -> int:
    """Phrases of the exhaustive history (Lempel and Ziv 1976): each is the shortest next word that did
    not occur before its own last letter."""
    text = bytes(bits)
    count = start = 0
    while start < len(text):
        size = 1
        while start + size <= len(text) and text.find(text[start : start + size], 0, start + size - 1) >= 0:
            size += 1
        count += 1
        start += size
    return count


def entropy(df: DataFrame, window: int = ENTROPY_WINDOW) -> DataFrame:
    """Shannon entropy (natural log) of binned returns and Lempel-Ziv complexity of their signs, in Arrow batches."""
    d = df.withColumn("__r", log_return())
    w = trailing(window)
    d = d.withColumns({"__all": F.collect_list("__r").over(w), "__signs": F.collect_list(F.when(F.col("__r") > 0, 1).otherwise(0)).over(w)})

    @F.pandas_udf("double")
    def shannon(values):
        import numpy as np
        import pandas as pd

        whole = values.map(len) == window
        out = pd.Series(np.nan, index=values.index)
        if whole.any():
            x = np.stack(values[whole].to_list())
            low, span = x.min(axis=1, keepdims=True), np.ptp(x, axis=1, keepdims=True)
            at = np.minimum(np.floor((x - low) / np.where(span > 0, span, 1) * ENTROPY_BINS), ENTROPY_BINS - 1)
            share = (at[:, :, None] == np.arange(ENTROPY_BINS)).mean(axis=1)
            out[whole] = -(share * np.log(np.where(share > 0, share, 1))).sum(axis=1)
        return out

    @F.pandas_udf("double")
    def complexity(signs):
        seen: dict[bytes, float] = {}  # neighbouring windows share few patterns, equal ones are counted once

        def one(s):
            if len(s) < window:
                return None
            key = bytes(s)
            if key not in seen:
                seen[key] = lz_phrases(key) / (len(key) / math.log2(len(key)))
            return seen[key]

        return signs.map(one)

    found = F.nanvl(shannon("__all"), F.lit(None).cast("double"))
    return d.withColumns({"shannon_entropy": found, "lempel_ziv_complexity": complexity("__signs")}).drop("__r", "__all", "__signs")


def features(df: DataFrame) -> DataFrame:
    """All features of each bar."""
    out = rsi(df)
    for group in (momentum, volatility, volume, microstructure, entropy):
        out = group(out)
    return out.select("symbol", "ts", *ALL)


def feature_matrix(table: DataFrame, fracdiff: DataFrame, labels: DataFrame, weights: DataFrame) -> DataFrame:
    """Features at the label times, with label, weight and t1; rows with a null go."""
    at = table.withColumnRenamed("ts", "t0").join(fracdiff.toDF("symbol", "t0", "fracdiff"), ["symbol", "t0"], "left")
    own = labels.select("symbol", "t0", "t1", F.col("bin").alias("label"))
    out = at.join(own, ["symbol", "t0"]).join(weights.select("symbol", "t0", "weight"), ["symbol", "t0"])
    return out.na.drop().select("symbol", "t0", *ALL, "fracdiff", "label", "weight", "t1")


def correlations(matrix: DataFrame, columns) -> DataFrame:
    """Long correlation matrix in one pass."""
    pairs = [(a, b) for a in columns for b in columns]
    one = matrix.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr")) for a, b in pairs]).alias("x"))
    return one.select(F.explode("x").alias("x")).select("x.*")


def audit(matrix: DataFrame, columns) -> DataFrame:
    """Per column: nulls, infinities, extremes, moments, negatives, zeros, distinct values."""
    def stats(c):
        x = F.col(c)
        n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
        return F.struct(
            F.lit(c).alias("column"), n(x.isNull()).alias("n_null"), n(F.abs(x) == float("inf")).alias("n_inf"), F.min(x).alias("low"),
            F.max(x).alias("high"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), n(x < 0).alias("n_negative"),
            n(x == 0).alias("n_zero"), F.count_distinct(x).alias("n_unique"),
        )

    return matrix.agg(F.array(*[stats(c) for c in columns]).alias("x")).select(F.explode("x").alias("x")).select("x.*")
