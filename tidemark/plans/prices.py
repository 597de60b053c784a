"""Queries: sources, sampling, bars, returns and features."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import full, trailing
from ..operators import features as ft
from ..operators import sampling as sm
from ..runtime import fresh_path
from ..sources import bars as src
from .base import BARS, events, histogram_sql, query, rounded

BAR_ROWS = f"WITH {BARS} SELECT symbol, ts, round(open,9) AS open, round(high,9) AS high, round(low,9) AS low, round(close,9) AS close, round(adj_close,6) AS adj_close, volume FROM bars"


def _bar_rows(df):
    """Unit prices have seven decimals at most: at nine none lies between two roundings."""
    prices = ("open", "high", "low", "close")
    return df.withColumns({c: F.round(c, 9) for c in prices} | {"adj_close": F.round("adj_close", 6)})


@query("bars", BAR_ROWS)
def _(spark, sf):
    return _bar_rows(src.bars(spark, sf))


@query("scan_csv", BAR_ROWS)
def _(spark, sf):
    path = fresh_path(spark, "csv")
    src.write_bars(src.bars(spark, sf), path, "csv")
    return _bar_rows(src.read_bars_csv(spark, path))


@query("scan_parquet", BAR_ROWS)
def _(spark, sf):
    path = fresh_path(spark, "parquet")
    src.write_bars(src.bars(spark, sf), path)
    return _bar_rows(src.read_bars_parquet(spark, path))


@query("scan_json", BAR_ROWS)
def _(spark, sf):
    path = fresh_path(spark, "json")
    src.write_bars(src.bars(spark, sf), path, "json")
    return _bar_rows(spark.read.schema(src.BAR_SCHEMA).json(path))


def _sink(kind, read):
    @query(f"sink_{kind}", BAR_ROWS)
    def _(spark, sf):
        """What a reader without a schema finds: a folder a symbol, typed or named columns in the files."""
        path = fresh_path(spark, kind)
        src.write_bars(src.bars(spark, sf), path, kind)
        found = read(spark.read, path)
        kinds = dict(src.bars(spark, sf).dtypes)
        return _bar_rows(found.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()]))


_sink("parquet", lambda reader, path: reader.parquet(path))
_sink("csv", lambda reader, path: reader.option("header", True).csv(path))
_sink("json", lambda reader, path: reader.json(path))


@query("source_gbm")
def _(spark, sf):
    return src.trending(spark, ["A", "B"], 1000)


@query("source_ou")
def _(spark, sf):
    return src.mean_reverting(spark, ["A", "B"], 1000)


@query("log_return", f"WITH {BARS} SELECT symbol, ts, round(ret,6) AS log_return FROM r")
def _(spark, sf):
    return rounded(sm.with_returns(src.bars(spark, sf)).select("symbol", "ts", "log_return"))


@query("dollar_volume", f"WITH {BARS} SELECT symbol, ts, round(dv,4) AS dollar_volume FROM r")
def _(spark, sf):
    return rounded(sm.with_returns(src.bars(spark, sf)).select("symbol", "ts", "dollar_volume"), 4)


@query("clean_bars", f"WITH {BARS} SELECT symbol, ts, round(adj_close,6) AS adj_close, round(ret,6) AS log_return, round(dv,4) AS dollar_volume FROM r WHERE ret IS NOT NULL")
def _(spark, sf):
    out = sm.clean_bars(src.bars(spark, sf))
    return out.select("symbol", "ts", F.round("adj_close", 6).alias("adj_close"), F.round("log_return", 6).alias("log_return"), F.round("dollar_volume", 4).alias("dollar_volume"))


@query("data_quality", f"""WITH {BARS}, c AS (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS previous FROM r WHERE ret IS NOT NULL)
SELECT count(*) AS n_rows, count(*) FILTER (symbol IS NULL OR ts IS NULL OR open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR adj_close IS NULL OR volume IS NULL OR dv IS NULL) AS n_null,
  count(*) FILTER (previous >= ts) AS n_unordered, count(*) FILTER (close <= 0 OR adj_close <= 0) AS n_price, count(*) FILTER (volume <= 0) AS n_volume FROM c""")
def _(spark, sf):
    return sm.quality(sm.clean_bars(src.bars(spark, sf)))


@query("expanding_mean", f"WITH {BARS} SELECT symbol, ts, round(avg(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING),6) AS expanding_mean FROM r WHERE ret IS NOT NULL")
def _(spark, sf):
    return rounded(sm.expanding_mean(sm.clean_bars(src.bars(spark, sf)), "log_return").select("symbol", "ts", "expanding_mean"))


H = 0.35
CUSUM_SQL = f"""
WITH RECURSIVE {BARS},
y AS (SELECT symbol, ts, ret, avg(ret) OVER w AS e, row_number() OVER w AS i FROM r WHERE ret IS NOT NULL
  WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)),
s(symbol, i, ts, up, down, hit) AS (
  SELECT symbol, 0::BIGINT, NULL::TIMESTAMP, 0.0::DOUBLE, 0.0::DOUBLE, false FROM (SELECT DISTINCT symbol FROM y)
  UNION ALL
  SELECT q.symbol, q.i, q.ts, CASE WHEN q.u > {H} OR q.d < -{H} THEN 0.0 ELSE q.u END, CASE WHEN q.u > {H} OR q.d < -{H} THEN 0.0 ELSE q.d END, q.u > {H} OR q.d < -{H}
  FROM (SELECT y.symbol, y.i, y.ts, greatest(0.0, s.up + y.ret - y.e - {H}) AS u, least(0.0, s.down + y.ret - y.e + {H}) AS d
        FROM s JOIN y ON y.symbol = s.symbol AND y.i = s.i + 1) q)
"""


@query("cusum_filter", CUSUM_SQL + "SELECT symbol, ts AS t0 FROM s WHERE hit")
def _(spark, sf):
    return sm.cusum_events(src.bars(spark, sf), H)


@query("calibrate_cusum_h")
def _(spark, sf):
    return sm.calibrated_cusum(src.bars(spark, sf), 100)


THETA = 5e6
DOLLAR_SQL = f"""
WITH RECURSIVE {BARS},
s(symbol, pos, total, bar, done) AS (
  SELECT symbol, -1::BIGINT, 0.0::DOUBLE, 0::BIGINT, false FROM (SELECT DISTINCT symbol FROM r)
  UNION ALL
  SELECT s.symbol, r.pos, CASE WHEN s.done THEN 0.0 ELSE s.total END + r.dv, s.bar + CASE WHEN s.done THEN 1 ELSE 0 END,
    CASE WHEN s.done THEN 0.0 ELSE s.total END + r.dv >= {THETA}
  FROM s JOIN r ON r.symbol = s.symbol AND r.pos = s.pos + 1),
closed AS (SELECT symbol, bar FROM s WHERE done)
SELECT s.symbol, s.bar, max(r.ts) AS ts, round(arg_min(r.open, r.ts),6) AS open, round(max(r.high),6) AS high, round(min(r.low),6) AS low,
  round(arg_max(r.close, r.ts),6) AS close, round(arg_max(r.adj_close, r.ts),6) AS adj_close, sum(r.volume) AS volume
FROM s JOIN closed USING (symbol, bar) JOIN r ON r.symbol = s.symbol AND r.pos = s.pos GROUP BY 1, 2
"""


@query("dollar_bars", DOLLAR_SQL)
def _(spark, sf):
    return rounded(sm.dollar_bars(src.bars(spark, sf), THETA))


@query("calibrate_dollar_threshold", f"WITH {BARS} SELECT symbol, round(sum(dv) / (252 * CASE WHEN date_diff('day', min(ts), max(ts)) = 0 THEN count(*) / 252.0 ELSE date_diff('day', min(ts), max(ts)) / 365.25 END), 2) AS threshold FROM r GROUP BY 1")
def _(spark, sf):
    return rounded(sm.dollar_threshold(src.bars(spark, sf)), 2)


@query("bars_per_year", f"WITH {BARS} SELECT symbol, CAST(year(ts) AS INT) AS year, count(*) AS n_bars FROM r GROUP BY 1, 2")
def _(spark, sf):
    return sm.bars_per_year(src.bars(spark, sf))


@query("inter_event_days", CUSUM_SQL + "SELECT symbol, t0, days FROM (SELECT symbol, ts AS t0, date_diff('day', lag(ts) OVER (PARTITION BY symbol ORDER BY ts), ts) AS days FROM s WHERE hit) WHERE days IS NOT NULL")
def _(spark, sf):
    return sm.inter_event_days(sm.cusum_events(src.bars(spark, sf), H))


@query("outliers_sigma", f"WITH {BARS} SELECT symbol, ts, round(ret,6) AS log_return FROM (SELECT *, avg(ret) OVER (PARTITION BY symbol) AS m, stddev_samp(ret) OVER (PARTITION BY symbol) AS s FROM r WHERE ret IS NOT NULL) WHERE abs(ret - m) > 3 * s")
def _(spark, sf):
    return rounded(sm.outliers(sm.clean_bars(src.bars(spark, sf)), 3).select("symbol", "ts", "log_return"))


@query("jarque_bera", f"""WITH {BARS}, c AS (SELECT symbol, ret, avg(ret) OVER (PARTITION BY symbol) AS m FROM r WHERE ret IS NOT NULL),
k AS (SELECT symbol, count(*) AS n, avg((ret-m)**2) AS v, avg((ret-m)**3) AS c3, avg((ret-m)**4) AS c4 FROM c GROUP BY 1),
j AS (SELECT symbol, n / 6.0 * ((c3 / v**1.5)**2 + (c4 / v**2 - 3)**2 / 4) AS jb FROM k)
SELECT symbol, round(jb,4) AS jb, round(exp(-jb/2),4) AS p_value FROM j""")
def _(spark, sf):
    return rounded(sm.jarque_bera(sm.clean_bars(src.bars(spark, sf))), 4)


@query("describe", f"WITH {BARS} SELECT symbol, count(ret) AS n, round(avg(ret),6) AS mean, round(stddev_samp(ret),6) AS std, round(min(ret),6) AS low, round(quantile_cont(ret,0.25),6) AS q25, round(quantile_cont(ret,0.5),6) AS q50, round(quantile_cont(ret,0.75),6) AS q75, round(max(ret),6) AS high FROM r GROUP BY 1")
def _(spark, sf):
    return rounded(sm.describe(sm.with_returns(src.bars(spark, sf)), "log_return"))


@query("qq_points")
def _(spark, sf):
    return sm.qq_points(sm.clean_bars(src.bars(spark, sf)), "log_return")


def _rolling(n, x, fn):
    return f"CASE WHEN count({x}) OVER w{n} = {n} THEN {fn} OVER w{n} END"


def _features_sql(cols):
    windows = ", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING)" for n in (20, 50, 60))
    return f"""WITH {BARS},
d AS (SELECT *, ln(high/low)**2 AS hl2, lag(high) OVER w AS ph, lag(low) OVER w AS pl, adj_close - lag(adj_close) OVER w AS dp,
  abs(ret) / nullif(dv, 0) AS illiq FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
d2 AS (SELECT *, lag(dp) OVER w AS pdp, hl2 + lag(hl2) OVER w AS beta, CASE WHEN ph IS NOT NULL THEN ln(greatest(high, ph) / least(low, pl)) END AS wide
  FROM d WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
d3 AS (SELECT *, (sqrt(2*beta) - sqrt(beta)) / (3 - 2*sqrt(2)) - sqrt(wide*wide/(3 - 2*sqrt(2))) AS alpha FROM d2)
SELECT symbol, ts, {cols} FROM d3 WINDOW w AS (PARTITION BY symbol ORDER BY ts), {windows}"""


@query("rolling_vol_60", _features_sql(f"round({_rolling(60, 'ret', 'stddev_samp(ret)')} * sqrt(252), 6) AS vol_60"))
def _(spark, sf):
    b = sm.with_returns(src.bars(spark, sf))
    vol = full(F.stddev_samp("log_return").over(trailing(60)), F.col("log_return"), 60) * math.sqrt(252)
    return rounded(b.select("symbol", "ts", vol.alias("vol_60")))


def _feature(name, group, column, sql, digits=6):
    @query(name, _features_sql(f"round({sql}, {digits}) AS {column}"))
    def _(spark, sf):
        return rounded(group(src.bars(spark, sf)).select("symbol", "ts", column), digits)


for _d in (5, 10, 20, 60):
    _feature(f"ret_{_d}d", ft.momentum, f"ret_{_d}d", f"ln(adj_close / lag(adj_close, {_d}) OVER w)")
_feature("momentum_12_1", ft.momentum, "momentum_12_1", "ln(adj_close / lag(adj_close, 252) OVER w) - ln(adj_close / lag(adj_close, 21) OVER w)")
for _n in (20, 50):
    _feature(f"vol_{_n}d", ft.volatility, f"vol_{_n}d", f"{_rolling(_n, 'ret', 'stddev_samp(ret)')} * sqrt(252)")
_feature("log_dollar_volume", ft.volume, "log_dollar_volume", "ln(nullif(dv, 0))")
_feature("volume_ratio", ft.volume, "volume_ratio", f"volume / {_rolling(20, 'volume', 'avg(volume)')}")
_feature("corwin_schultz_spread", ft.microstructure, "corwin_schultz_spread", "CASE WHEN alpha IS NOT NULL THEN greatest(0.0, 2*(exp(alpha)-1)/(1+exp(alpha))) END")
_feature("bekker_parkinson_vol", ft.microstructure, "bekker_parkinson_vol", "hl2 / (4*ln(2))")
_feature("amihud_illiquidity", ft.microstructure, "amihud_illiquidity", _rolling(20, "illiq", "avg(illiq)"), 12)
_feature("roll_spread", ft.microstructure, "roll_spread", "CASE WHEN count(CASE WHEN dp IS NOT NULL THEN pdp END) OVER w20 = 20 THEN 2*sqrt(greatest(0.0, -(covar_samp(dp, pdp) OVER w20))) END")


@query("rsi_14", f"""WITH RECURSIVE {BARS},
x AS (SELECT symbol, ts, pos, adj_close - lag(adj_close) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM r),
s(symbol, pos, ts, up, down) AS (
  SELECT symbol, pos, ts, greatest(d, 0.0), greatest(-d, 0.0) FROM x WHERE pos = 1
  UNION ALL
  SELECT x.symbol, x.pos, x.ts, s.up * (1 - 1/14.0::DOUBLE) + greatest(x.d, 0.0) / 14.0::DOUBLE, s.down * (1 - 1/14.0::DOUBLE) + greatest(-x.d, 0.0) / 14.0::DOUBLE
  FROM s JOIN x ON x.symbol = s.symbol AND x.pos = s.pos + 1)
SELECT x.symbol, x.ts, round(CASE WHEN s.down = 0 AND s.up > 0 THEN 100.0 WHEN s.down = 0 THEN NULL ELSE 100 - 100 / (1 + s.up / s.down) END, 6) AS rsi_14
FROM x LEFT JOIN s USING (symbol, pos)""")
def _(spark, sf):
    return rounded(ft.rsi(src.bars(spark, sf)).select("symbol", "ts", "rsi_14"))


@query("shannon_entropy", f"""WITH {BARS},
l AS (SELECT symbol, ts, list(ret) OVER w AS a, count(ret) OVER w AS n, min(ret) OVER w AS lo, max(ret) OVER w AS hi
  FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 49 PRECEDING)),
u AS (SELECT symbol, ts, lo, hi, unnest(a) AS x FROM l WHERE n = 50),
b AS (SELECT symbol, ts, CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / (hi - lo) * 10), 9) END AS bin, count(*) / 50.0::DOUBLE AS p FROM u WHERE x IS NOT NULL GROUP BY 1, 2, 3),
h AS (SELECT symbol, ts, -sum(p * ln(p)) AS e FROM b GROUP BY 1, 2)
SELECT l.symbol, l.ts, round(abs(e), 6) AS shannon_entropy FROM l LEFT JOIN h USING (symbol, ts)""")
def _(spark, sf):
    return rounded(ft.entropy(src.bars(spark, sf)).select("symbol", "ts", F.abs("shannon_entropy").alias("shannon_entropy")))


@query("lempel_ziv_complexity")
def _(spark, sf):
    return ft.entropy(src.bars(spark, sf)).select("symbol", "ts", "lempel_ziv_complexity")


@query("histogram_returns", f"WITH {BARS}, z AS (SELECT symbol, ret AS x FROM r)" + histogram_sql(100))
def _(spark, sf):
    return sm.histogram(sm.with_returns(src.bars(spark, sf)), "log_return", 100)


@query("histogram_volume", f"WITH {BARS}, z AS (SELECT symbol, volume AS x FROM r)" + histogram_sql(20))
def _(spark, sf):
    return sm.histogram(src.bars(spark, sf), "volume", 20)


@query(
    "histogram_inter_event",
    CUSUM_SQL + ", z AS (SELECT symbol, date_diff('day', lag(ts) OVER (PARTITION BY symbol ORDER BY ts), ts) AS x FROM s WHERE hit)" + histogram_sql(50),
)
def _(spark, sf):
    return sm.histogram(sm.inter_event_days(sm.cusum_events(src.bars(spark, sf), H)), "days", 50)


@query("stride_sample", f"WITH {BARS} SELECT symbol, ts, pos FROM r WHERE pos % 10 = 0")
def _(spark, sf):
    return sm.strided(src.bars(spark, sf), 10).select("symbol", "ts", "pos")


@query("chrono_split", f"WITH {BARS}, n AS (SELECT symbol, ts, pos, count(*) OVER (PARTITION BY symbol) AS n FROM r) SELECT symbol, ts, CASE WHEN pos < floor(0.8 * n) THEN 'train' ELSE 'test' END AS part FROM n")
def _(spark, sf):
    w = W.partitionBy("symbol")
    part = F.when(F.row_number().over(w.orderBy("ts")) <= F.floor(0.8 * F.count(F.lit(1)).over(w)), "train").otherwise("test")
    return src.bars(spark, sf).select("symbol", "ts", part.alias("part"))


@query("flagship_events")
def _(spark, sf):
    return events(spark, sf)[1]
