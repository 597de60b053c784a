"""Backtest and its statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import by_time, normal_cdf, sample_excess_kurtosis, sample_skew
from .validation import expected_maximum, psr_z

def up_to_here():
    return by_time().rowsBetween(W.unboundedPreceding, 0)



def backtest(positions: DataFrame, bars: DataFrame, cost_bps: float = 5.0) -> DataFrame:
    """Position of the day before times the day's return, less cost of changes; entry on the first day is free."""
    d = bars.select("symbol", "ts", "adj_close").join(positions, ["symbol", "ts"], "left")
    d = d.withColumn("position", F.coalesce(F.last("position", ignorenulls=True).over(up_to_here()), F.lit(0.0)))
    d = d.withColumns(
        {
            "price_return": F.coalesce(F.col("adj_close") / F.lag("adj_close").over(by_time()) - 1, F.lit(0.0)),
            "held": F.coalesce(F.lag("position").over(by_time()), F.lit(0.0)),
            "cost": F.coalesce(F.abs(F.col("position") - F.lag("position").over(by_time())) * (cost_bps / 1e4), F.lit(0.0)),
        }
    )
    d = d.withColumn("gross_return", F.col("held") * F.col("price_return"))
    d = d.withColumn("net_return", F.col("gross_return") - F.col("cost"))
    d = d.withColumn("cumulative", F.product(1 + F.col("net_return")).over(up_to_here()))
    d = d.withColumn("hwm", F.max("cumulative").over(up_to_here())).withColumn("drawdown", 1 - F.col("cumulative") / F.col("hwm"))
    return d.select("symbol", "ts", "position", "price_return", "gross_return", "cost", "net_return", "cumulative", "hwm", "drawdown")


def buy_and_hold(bars: DataFrame) -> DataFrame:
    r = bars.select("symbol", "ts", F.coalesce(F.col("adj_close") / F.lag("adj_close").over(by_time()) - 1, F.lit(0.0)).alias("r"))
    return r.select("symbol", "ts", F.product(1 + F.col("r")).over(up_to_here()).alias("cumulative"))


def sharpe_column(r: str = "net_return"):
    std = F.stddev_samp(r)
    return F.when(std > 0, F.avg(r) / std * math.sqrt(252)).otherwise(0.0)


def sharpe(run: DataFrame) -> DataFrame:
    return run.groupBy("symbol").agg(sharpe_column().alias("sharpe"))


def deflated(run: DataFrame, trials: int = 50) -> DataFrame:
    """symbol, sr (daily), psr_z, psr, sr_chance, dsr_z, dsr, from sample-adjusted moments."""
    r = "net_return"
    m = run.groupBy("symbol").agg(
        (F.avg(r) / F.stddev_samp(r)).alias("sr"), F.count(r).cast("double").alias("n"), sample_skew(F.col(r)).alias("skew"),
        (sample_excess_kurtosis(F.col(r)) + 3).alias("kurt"),
    )
    var = (1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") * F.col("sr")) / F.greatest(F.lit(1.0), F.col("n") - 1)
    chance = F.sqrt(var) * expected_maximum(1.0, trials)
    m = m.withColumn("sr_chance", chance)
    z = lambda b: psr_z(F.col("sr"), F.col("n"), F.col("skew"), F.col("kurt"), b)
    m = m.withColumns({"psr_z": z(F.lit(0.0)), "dsr_z": z(F.col("sr_chance"))})
    return m.select("symbol", "sr", "psr_z", normal_cdf(F.col("psr_z")).alias("psr"), "sr_chance", "dsr_z", normal_cdf(F.col("dsr_z")).alias("dsr"))


def underwater(run: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """symbol, max_drawdown, time_under_water, peak, trough: episodes as gaps and islands; one that has not
    ended doesn't count; the peak is the first bar of the highest mark of all."""
    d = run.withColumn("under", F.col("drawdown") > tolerance)
    w = by_time()
    d = d.withColumn("starts", (F.col("under") & ~F.coalesce(F.lag("under").over(w), F.lit(False))).cast("int"))
    d = d.withColumn("episode", F.sum("starts").over(up_to_here())).withColumn("next", F.lead("ts").over(w))
    spans = d.where("under").groupBy("symbol", "episode").agg(F.min("ts").alias("from"), F.max_by("next", "ts").alias("to"))
    longest = spans.groupBy("symbol").agg(F.max(F.datediff("to", "from")).alias("days"))
    ends = run.groupBy("symbol").agg(
        F.max("drawdown").alias("max_drawdown"), F.min_by("ts", F.struct(-F.col("hwm"), "ts")).alias("peak"),
        F.min_by("ts", F.struct(-F.col("drawdown"), "ts")).alias("trough"),
    )
    out = ends.join(longest, "symbol", "left")
    return out.select("symbol", "max_drawdown", F.coalesce("days", F.lit(0)).cast("long").alias("time_under_water"), "peak", "trough")


def ratios(run: DataFrame) -> DataFrame:
    """symbol, annual return and volatility, calmar, hit ratio, profit factor."""
    r = F.col("net_return")
    annual = F.pow(1 + F.avg(r), 252) - 1
    inf = F.lit(float("inf"))
    loss = F.abs(F.sum(F.when(r < 0, r).otherwise(0.0)))
    gain = F.sum(F.when(r > 0, r).otherwise(0.0))
    hit = F.try_divide(F.sum(F.when(r > 0, 1).otherwise(0)), F.sum(F.when(r != 0, 1).otherwise(0)))
    return run.groupBy("symbol").agg(
        annual.alias("annual_return"), (F.stddev_samp(r) * math.sqrt(252)).alias("annual_vol"),
        F.when(F.max("drawdown") == 0, inf).otherwise(F.try_divide(annual, F.max("drawdown"))).alias("calmar"), hit.alias("hit_ratio"),
        F.when(loss == 0, inf).otherwise(F.try_divide(gain, loss)).alias("profit_factor"),
    )


def summary(run: DataFrame, trials: int = 50) -> DataFrame:
    """One typed row per series; ``formatted`` turns it into text."""
    ends = run.groupBy("symbol").agg(F.min("ts").alias("first_day"), F.max("ts").alias("last_day"), F.count(F.lit(1)).alias("n_days"))
    out = ends.join(ratios(run), "symbol").join(sharpe(run), "symbol").join(deflated(run, trials), "symbol")
    return out.join(underwater(run), "symbol")


def formatted(summary_row: DataFrame) -> DataFrame:
    percent = lambda c: F.format_string("%.4f%%", F.col(c) * 100)
    plain = lambda c: F.format_string("%.4f", c)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    cells = [
        ("Start", day("first_day")), ("End", day("last_day")), ("Days", F.col("n_days").cast("string")), ("Annual return", percent("annual_return")),
        ("Annual volatility", percent("annual_vol")), ("Sharpe", plain("sharpe")), ("PSR", plain("psr")), ("DSR", plain("dsr")),
        ("Max drawdown", percent("max_drawdown")), ("Time under water", F.concat(F.col("time_under_water").cast("string"), F.lit(" d"))),
        ("Calmar", plain("calmar")), ("Hit ratio", percent("hit_ratio")), ("Profit factor", plain("profit_factor")), ("Peak", day("peak")), ("Trough", day("trough")),
    ]
    rows = F.array(*[F.struct(F.lit(name).alias("metric"), value.alias("value")) for name, value in cells])
    return summary_row.select("symbol", F.explode(rows).alias("x")).select("symbol", "x.metric", "x.value")


def monthly(run: DataFrame) -> DataFrame:
    """symbol, month, ret of every month from first to last, 0 for a month without bars."""
    month = F.trunc("ts", "MM").alias("month")
    got = run.groupBy("symbol", month).agg((F.product(1 + F.col("net_return")) - 1).alias("ret"))
    ends = got.groupBy("symbol").agg(F.min("month").alias("a"), F.max("month").alias("b"))
    every = ends.select("symbol", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return every.join(got, ["symbol", "month"], "left").select("symbol", "month", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def monthly_table(run: DataFrame) -> DataFrame:
    """Years down, months across."""
    m = monthly(run).select("symbol", F.year("month").alias("year"), F.month("month").alias("m"), "ret")
    cells = m.groupBy("symbol", "year").pivot("m", list(range(1, 13))).agg(F.first("ret"))
    return cells.toDF("symbol", "year", *[f"m{i}" for i in range(1, 13)])
