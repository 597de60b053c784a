"""Bars from line items, files of bars, and synthetic series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_SCHEMA = (
    "symbol string, ts timestamp, open double, high double, low double, close double, adj_close double, volume double"
)


def bars(spark: SparkSession, sf_dir: str, symbol: str | None = "l_returnflag") -> DataFrame:
    """Daily bars of unit prices, one series per value of ``symbol`` (None: a single series ``ALL``).

    adj_close is the volume-weighted price; its sum is decimal and so independent of order.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    name = F.col(symbol).cast("string") if symbol else F.lit("ALL")
    return lines.groupBy(name.alias("symbol"), F.col("l_shipdate").alias("ts")).agg(
        F.min_by(px, order).alias("open"),
        F.max(px).alias("high"),
        F.min(px).alias("low"),
        F.max_by(px, order).alias("close"),
        (F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.sum("l_quantity")).alias("adj_close"),
        F.sum("l_quantity").alias("volume"),
    )


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars with a declared schema: nothing is inferred, NaN becomes NULL."""
    raw = spark.read.schema(BAR_SCHEMA).option("header", True).csv(path)
    return raw.select("symbol", "ts", *[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in raw.columns[2:]])


def read_bars_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BAR_SCHEMA).parquet(path)


def write_bars(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Overwrite; parquet is partitioned by series, CSV has a header, JSON is one object a line."""
    writer = df.write.mode("overwrite")
    if kind == "parquet":
        writer.partitionBy("symbol").parquet(path)
    elif kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "json":
        writer.json(path)
    else:
        raise ValueError(f"no writer for {kind}")


def _series(spark: SparkSession, symbols: list[str], n: int, seed: int, make) -> DataFrame:
    """One task per series; every series has a seed of its own."""

    def build(batches):
        import pandas as pd

        for batch in batches:
            for name, k in zip(batch["symbol"], batch["k"], strict=True):
                days = pd.bdate_range(end="2025-01-01", periods=n)
                yield pd.DataFrame({"symbol": name, "ts": days, "close": make(np.random.default_rng(seed + int(k)), n)})

    rows = spark.createDataFrame([(s, k) for k, s in enumerate(symbols)], "symbol string, k int")
    return rows.repartition(len(symbols), "symbol").mapInPandas(build, "symbol string, ts timestamp, close double")


def trending(
    spark: SparkSession, symbols: list[str], n: int = 5000, drift: float = 5e-4, vol: float = 0.02, seed: int = 42
) -> DataFrame:
    """Geometric Brownian motion from 100 on business days."""
    return _series(spark, symbols, n, seed, lambda rng, n: 100 * np.exp(np.cumsum(drift + vol * rng.standard_normal(n))))


def mean_reverting(
    spark: SparkSession, symbols: list[str], n: int = 5000, theta: float = 0.1, mu: float = 100.0, vol: float = 2.0, seed: int = 42
) -> DataFrame:
    """Ornstein-Uhlenbeck steps around mu, starting there."""

    def make(rng, n):
        shocks, out = rng.standard_normal(n), np.empty(n)
        out[0] = mu
        for t in range(1, n):
            out[t] = out[t - 1] + theta * (mu - out[t - 1]) + vol * shocks[t]
        return out

    return _series(spark, symbols, n, seed, make)
