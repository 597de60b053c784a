"""Sample weights of overlapping labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .labels import positions


def _spans(events: DataFrame, bars: DataFrame, fill: bool) -> DataFrame:
    """Events with the positions p0, p1 of their interval; an open one ends at the last bar if ``fill``."""
    at = positions(bars)
    start = at.select("symbol", F.col("ts").alias("t0"), F.col("pos").alias("p0"))
    end = at.select("symbol", F.col("ts").alias("t1"), F.col("pos").alias("p1"))
    out = events.join(start, ["symbol", "t0"]).join(end, ["symbol", "t1"], "left")
    if fill:
        last = at.groupBy("symbol").agg(F.max("pos").alias("last"))
        out = out.join(last, "symbol").withColumn("p1", F.coalesce("p1", "last")).drop("last")
    return out


def concurrency(events: DataFrame, bars: DataFrame, fill: bool = True) -> DataFrame:
    """symbol, ts, pos, n: events under way at each bar from the first event to the last end.

    A sweep: +1 where an event starts, -1 after it ends; no join of intervals.
    """
    spans = _spans(events.select("symbol", "t0", "t1"), bars, fill).where("p1 is not null")
    steps = spans.select("symbol", F.explode(F.array(F.struct(F.col("p0").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("p1") + 1).alias("pos"), F.lit(-1).alias("d")))).alias("s"))
    steps = steps.groupBy("symbol", F.col("s.pos").alias("pos")).agg(F.sum("s.d").alias("d"))
    ends = spans.groupBy("symbol").agg(F.min("p0").alias("from"), F.max("p1").alias("to"))
    w = W.partitionBy("symbol").orderBy("pos")
    out = positions(bars).join(steps, ["symbol", "pos"], "left").withColumn("n", F.sum(F.coalesce("d", F.lit(0))).over(w))
    out = out.join(ends, "symbol")
    return out.where(F.col("pos").between(F.col("from"), F.col("to"))).select("symbol", "ts", "pos", F.col("n").cast("long").alias("n"))


def active_count(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Events under way per bar of the whole series; open ones never are."""
    n = concurrency(events, bars, fill=False).select("symbol", "ts", "n")
    return bars.select("symbol", "ts").join(n, ["symbol", "ts"], "left").select("symbol", "ts", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def uniqueness(events: DataFrame, bars: DataFrame) -> DataFrame:
    """symbol, t0, uniqueness: mean of 1 / concurrency over the interval, from prefix sums."""
    w = W.partitionBy("symbol").orderBy("pos")
    c = concurrency(events, bars).withColumn("sum", F.sum(F.when(F.col("n") > 0, 1.0 / F.col("n")).otherwise(0.0)).over(w))
    c = c.withColumn("before", F.coalesce(F.lag("sum").over(w), F.lit(0.0)))
    spans = _spans(events.select("symbol", "t0", "t1"), bars, False)
    out = spans.join(c.select("symbol", F.col("pos").alias("p0"), "before"), ["symbol", "p0"], "left")
    out = out.join(c.select("symbol", F.col("pos").alias("p1"), "sum"), ["symbol", "p1"], "left")
    return out.select("symbol", "t0", ((F.col("sum") - F.col("before")) / (F.col("p1") - F.col("p0") + 1)).alias("uniqueness"))


def indicator(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Sparse indicator matrix: symbol, pos (of the bar), t0."""
    spans = _spans(events.select("symbol", "t0", "t1"), bars, False).where("p1 is not null")
    return spans.select("symbol", F.explode(F.sequence("p0", "p1")).alias("pos"), "t0")


def return_attribution(labels: DataFrame) -> DataFrame:
    w = W.partitionBy("symbol")
    a = F.abs("ret")
    return labels.select("symbol", "t0", (a / F.sum(a).over(w) * F.count(F.lit(1)).over(w)).alias("attribution"))


def time_decay(rows: DataFrame, oldest: float = 0.5) -> DataFrame:
    """Linear in the place among the rows, from ``oldest`` to 1, divided by its mean."""
    w = W.partitionBy("symbol")
    i = F.row_number().over(w.orderBy("t0")) - 1
    d = oldest + (1 - oldest) * i / F.greatest(F.count(F.lit(1)).over(w) - 1, F.lit(1))
    return rows.select("symbol", "t0", d.alias("d")).select("symbol", "t0", (F.col("d") / F.avg("d").over(w)).alias("decay"))


def sample_weights(labels: DataFrame, bars: DataFrame, oldest: float = 0.5) -> DataFrame:
    keys = ["symbol", "t0"]
    out = uniqueness(labels, bars).join(return_attribution(labels), keys).join(time_decay(labels, oldest), keys)
    product = F.col("uniqueness") * F.col("attribution") * F.col("decay")
    out = out.withColumn("product", product)
    return out.select(*keys, "uniqueness", "attribution", "decay", (F.col("product") / F.avg("product").over(W.partitionBy("symbol"))).alias("weight"))


def bootstrap_uniqueness(events: DataFrame, bars: DataFrame, draws: int = 20, seed: int = 42) -> DataFrame:
    """symbol, replicate, kind, n, uniqueness: sequential and plain bootstrap, a task per series and replicate.

    In the sequential one an event is drawn in proportion to its mean uniqueness given what was drawn.
    """
    spans = _spans(events.select("symbol", "t0", "t1"), bars, False).where("p1 is not null").select("symbol", "p0", "p1")
    reps = spans.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("replicate"))

    def run(key, pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["p0", "p1"])
        p0, p1, n = pdf["p0"].to_numpy(), pdf["p1"].to_numpy() + 1, len(pdf)
        base = p0.min()
        rng = np.random.default_rng([seed, int(key[1]), *key[0].encode()])
        drawn = np.zeros(p1.max() - base)

        def mean_of(value):
            sums = np.r_[0.0, np.cumsum(value)]
            return (sums[p1 - base] - sums[p0 - base]) / (p1 - p0)

        chosen = []
        for _ in range(n):
            u = mean_of(1.0 / (drawn + 1))
            i = int(rng.choice(n, p=u / u.sum()))
            chosen.append(i)
            drawn[p0[i] - base : p1[i] - base] += 1
        plain = rng.integers(0, n, n)
        rows = []
        for kind, picks in (("sequential", np.array(chosen)), ("standard", plain)):
            count = np.zeros(len(drawn))
            for i in picks:
                count[p0[i] - base : p1[i] - base] += 1
            u = mean_of(1.0 / np.maximum(count, 1))[picks].mean()
            rows.append((key[0], int(key[1]), kind, n, float(u)))
        return pd.DataFrame(rows, columns=["symbol", "replicate", "kind", "n", "uniqueness"])

    return reps.groupBy("symbol", "replicate").applyInPandas(run, "symbol string, replicate int, kind string, n long, uniqueness double")
