"""Barriers and labels. Intervals meet bars by equal keys: positions, never by inequality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import by_time


def positions(bars: DataFrame) -> DataFrame:
    """symbol, ts, pos (from 0), adj_close."""
    return bars.select("symbol", "ts", (F.row_number().over(by_time()) - 1).cast("long").alias("pos"), "adj_close")


def daily_vol(bars: DataFrame, span: int = 50) -> DataFrame:
    """symbol, ts, vol: bias-corrected exponentially weighted deviation of log returns."""

    def run(pdf):
        import numpy as np

        pdf = pdf.sort_values("ts")
        vol = np.log(pdf["adj_close"] / pdf["adj_close"].shift(1)).ewm(span=span).std()
        return pdf.assign(vol=vol)[["symbol", "ts", "vol"]]

    out = bars.select("symbol", "ts", "adj_close").groupBy("symbol").applyInPandas(run, "symbol string, ts timestamp, vol double")
    return out.select("symbol", "ts", F.nanvl("vol", F.lit(None).cast("double")).alias("vol"))


def event_targets(events: DataFrame, vol: DataFrame) -> DataFrame:
    """symbol, t0, trgt of the events that have a volatility."""
    return (
        events.join(vol.select("symbol", F.col("ts").alias("t0"), F.col("vol").alias("trgt")), ["symbol", "t0"])
        .na.drop(subset=["trgt"])
        .select("symbol", "t0", "trgt")
    )


def backfilled(vol: DataFrame) -> DataFrame:
    return vol.withColumn("vol", F.coalesce("vol", F.avg("vol").over(W.partitionBy("symbol"))))


def vertical_barrier(events: DataFrame, bars: DataFrame, days: int = 10) -> DataFrame:
    """t1: the first bar at or after t0 + days (calendar), null past the last bar.

    A forward as-of join without a join: events and bars are sorted together once.
    """
    due = events.withColumn("at", F.col("t0") + F.expr(f"interval {days} days")).withColumn("bar", F.lit(None).cast("timestamp"))
    extra = [c for c in due.columns if c not in ("symbol", "at", "bar")]
    points = bars.select("symbol", F.col("ts").alias("at"), F.col("ts").alias("bar"))
    both = due.withColumn("is_event", F.lit(True)).unionByName(points.withColumn("is_event", F.lit(False)), allowMissingColumns=True)
    w = W.partitionBy("symbol").orderBy(F.col("at"), F.col("is_event").desc()).rowsBetween(0, W.unboundedFollowing)
    found = both.withColumn("t1", F.first("bar", ignorenulls=True).over(w))
    return found.where("is_event").select("symbol", *extra, "t1")


def paths(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Every (event, bar) with the bar in [t0, t1], or to the end if t1 is null: equal keys only."""
    at = positions(bars)
    last = at.groupBy("symbol").agg(F.max("pos").alias("last"))
    start = at.select("symbol", F.col("ts").alias("t0"), F.col("pos").alias("p0"), F.col("adj_close").alias("c0"))
    end = at.select("symbol", F.col("ts").alias("t1"), F.col("pos").alias("p1"))
    spans = events.join(start, ["symbol", "t0"]).join(end, ["symbol", "t1"], "left").join(last, "symbol")
    spans = spans.withColumn("pos", F.explode(F.sequence("p0", F.coalesce("p1", "last")))).drop("last", "p0", "p1")
    return spans.join(at, ["symbol", "pos"])


def triple_barrier(events: DataFrame, bars: DataFrame, pt: float = 1.0, sl: float = 1.0) -> DataFrame:
    """symbol, t0, t1, pt, sl: first touches of the upper and lower barrier on the path (t0 included)."""
    up = F.lit(pt > 0) & (F.col("adj_close") >= F.col("c0") * (1 + pt * F.col("trgt")))
    down = F.lit(sl > 0) & (F.col("adj_close") <= F.col("c0") * (1 - sl * F.col("trgt")))
    return (
        paths(events.select("symbol", "t0", "t1", "trgt"), bars)
        .groupBy("symbol", "t0")
        .agg(F.first("t1").alias("t1"), F.min(F.when(up, F.col("ts"))).alias("pt"), F.min(F.when(down, F.col("ts"))).alias("sl"))
    )


def label_bins(barriers: DataFrame, bars: DataFrame) -> DataFrame:
    """symbol, t0, t1, pt, sl, t_exit, ret, bin; no label without a vertical barrier."""
    at = bars.select("symbol", "ts", "adj_close")
    exit_ = F.when(F.col("t1").isNotNull(), F.least("t1", "pt", "sl"))
    out = barriers.withColumn("t_exit", exit_)
    out = out.join(at.toDF("symbol", "t0", "c0"), ["symbol", "t0"]).join(at.toDF("symbol", "t_exit", "c1"), ["symbol", "t_exit"], "left")
    ret = F.col("c1") / F.col("c0") - 1
    return out.select("symbol", "t0", "t1", "pt", "sl", "t_exit", ret.alias("ret"), (F.signum(ret) + 0.0).alias("bin"))


def drop_rare(labels: DataFrame, least: float = 0.05) -> DataFrame:
    """With three classes or more, the rarest goes if its share is at most ``least``; null labels stay."""
    shares = labels.where("bin is not null").groupBy("symbol", "bin").count()
    w = W.partitionBy("symbol")
    shares = shares.withColumns({"classes": F.count(F.lit(1)).over(w), "share": F.col("count") / F.sum("count").over(w)})
    rank = F.row_number().over(w.orderBy("count", "bin"))
    rare = shares.withColumn("r", rank).where((F.col("r") == 1) & (F.col("classes") >= 3) & (F.col("share") <= least))
    return labels.join(rare.select("symbol", "bin"), ["symbol", "bin"], "left_anti").select(*labels.columns)


def barrier_type(labels: DataFrame) -> DataFrame:
    kind = F.when(F.col("t_exit") == F.col("sl"), "sl").when(F.col("t_exit") == F.col("pt"), "pt").otherwise("t1")
    return labels.withColumn("barrier", kind)


def distribution(labels: DataFrame, column: str = "bin") -> DataFrame:
    n = F.count(F.lit(1))
    out = labels.where(F.col(column).isNotNull()).groupBy("symbol", column).agg(n.alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("symbol")))


def sensitivity(events: DataFrame, bars: DataFrame, grid=(0.5, 1.0, 1.5, 2.0)) -> DataFrame:
    """Shares of labels for every pair of barrier widths, in one pass over the paths."""
    spark = events.sparkSession
    cells = spark.createDataFrame([(p, s) for p in grid for s in grid], "w_pt double, w_sl double")
    base = paths(events.where("t1 is not null").select("symbol", "t0", "t1", "trgt"), bars)
    wide = base.crossJoin(F.broadcast(cells))  # a grid of fixed size
    up = F.col("adj_close") >= F.col("c0") * (1 + F.col("w_pt") * F.col("trgt"))
    down = F.col("adj_close") <= F.col("c0") * (1 - F.col("w_sl") * F.col("trgt"))
    exits = wide.groupBy("symbol", "t0", "w_pt", "w_sl").agg(
        F.min_by("adj_close", F.when(up | down | (F.col("ts") == F.col("t1")), F.col("ts"))).alias("c1"), F.first("c0").alias("c0")
    )
    bin_ = F.signum(F.col("c1") / F.col("c0") - 1)
    share = lambda v: F.avg(F.when(F.col("bin") == v, 1.0).otherwise(0.0))
    return (
        exits.withColumn("bin", bin_)
        .groupBy("w_pt", "w_sl")
        .agg(share(-1).alias("share_down"), share(0).alias("share_flat"), share(1).alias("share_up"), F.count(F.lit(1)).alias("n"))
    )
