"""Meta-labels, bet sizes and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import half_even, normal_cdf


def validate_oos(predictions: DataFrame) -> DataFrame:
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return predictions.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), n(F.col("p").isNull()).alias("n_null"), n(~F.col("side").isin(-1.0, 1.0)).alias("n_side"),
        F.avg(F.when(F.col("side") == F.col("label"), 1.0).otherwise(0.0)).alias("accuracy"),
    )


def meta_labels(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """1 where the side earned, else 0 (also for a missing return)."""
    won = F.coalesce((F.col("ret") * F.col("side") > 0).cast("int"), F.lit(0))
    out = predictions.select("symbol", "t0", "side", "p").join(labels.select("symbol", "t0", "t1", "ret"), ["symbol", "t0"])
    return out.withColumn("meta_label", won)


def bet_z(p, classes: int = 2):
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return (p - 1 / classes) / F.sqrt(p * (1 - p))


def bet_signal(rows: DataFrame, step: float = 0.0) -> DataFrame:
    """signal: side times (2 cdf(z) - 1); below even odds the side turns."""
    signal = F.col("side") * (2 * normal_cdf(bet_z(F.col("p"))) - 1)
    return rows.withColumn("signal", half_even(signal, step) if step else signal)


def average_active(signals: DataFrame) -> DataFrame:
    """symbol, ts, signal: the mean of the signals under way at every start and end, 0 if none is.

    A sweep over starts and ends; an end still counts at its own time.
    """
    up = signals.select("symbol", F.col("t0").alias("ts"), F.col("signal").alias("s"), F.lit(1).alias("n"), F.lit(0.0).alias("s2"), F.lit(0).alias("n2"))
    down = signals.where("t1 is not null").select("symbol", F.col("t1").alias("ts"), F.lit(0.0), F.lit(0), F.col("signal"), F.lit(1))
    # An event without an end is never active, though its start is a point.
    up = up.join(signals.where("t1 is null").select("symbol", F.col("t0").alias("ts"), F.lit(1).alias("open")).distinct(), ["symbol", "ts"], "left")
    up = up.select("symbol", "ts", F.when(F.col("open").isNull(), F.col("s")).otherwise(0.0).alias("s"), F.when(F.col("open").isNull(), F.col("n")).otherwise(0).alias("n"), "s2", "n2")
    points = up.union(down).groupBy("symbol", "ts").agg(*[F.sum(c).alias(c) for c in ("s", "n", "s2", "n2")])
    w = W.partitionBy("symbol").orderBy("ts")
    to_here, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    value = F.sum("s").over(to_here) - F.coalesce(F.sum("s2").over(before), F.lit(0.0))
    n = F.sum("n").over(to_here) - F.coalesce(F.sum("n2").over(before), F.lit(0))
    return points.select("symbol", "ts", F.when(n > 0, value / n).otherwise(0.0).alias("signal"))


def daily_positions(signals: DataFrame, bars: DataFrame, step: float = 0.0) -> DataFrame:
    """symbol, ts, position: the last signal at or before each bar, 0 before the first. A signal stays
    on after its events have ended."""
    s = signals.select("symbol", "ts", F.struct((half_even(F.col("signal"), step) if step else F.col("signal")).alias("v")).alias("signal"), F.lit(False).alias("bar"))
    b = bars.select("symbol", "ts", F.lit(None).cast("struct<v: double>").alias("signal"), F.lit(True).alias("bar"))
    w = W.partitionBy("symbol").orderBy("ts", "bar").rowsBetween(W.unboundedPreceding, 0)
    both = s.union(b).withColumn("signal", F.last("signal", ignorenulls=True).over(w))
    return both.where("bar").select("symbol", "ts", F.coalesce("signal.v", F.lit(0.0)).alias("position"))


def position_levels(positions: DataFrame) -> DataFrame:
    return positions.groupBy("symbol", F.round("position", 6).alias("position")).agg(F.count(F.lit(1)).alias("n"))
