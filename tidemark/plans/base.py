"""What the registered queries share: inputs, rounding, and the common parts of their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import by_time, full, log_return, trailing
from ..operators import labels, sampling
from ..runtime import materialize, ship
from ..sources.bars import bars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many places, without negative zeros."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bars, and every tenth bar from the twentieth as an event: symbol, t0, trgt, t1.

    Plans on events look at the bars many times: they are written once, so line items are read once.
    """
    b = materialize(bars(spark, sf_dir), "bars")
    r = b.withColumn("r", log_return())
    r = r.withColumn("trgt", full(F.stddev_samp("r").over(trailing(20)), F.col("r"), 20))
    picked = sampling.strided(r, 10, 20).select("symbol", F.col("ts").alias("t0"), "trgt")
    return b, labels.vertical_barrier(picked, b, 10)


def labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b, e = events(spark, sf_dir)
    return b, labels.label_bins(labels.triple_barrier(e, b), b)


def pseudo_predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bars, and predictions by rule: p from the event's number, side from the last five days' return."""
    b, lab = labelled(spark, sf_dir)
    r5 = b.select("symbol", F.col("ts").alias("t0"), log_return(lag=5).alias("r5"), (F.row_number().over(by_time()) - 1).alias("pos"))
    out = lab.join(r5, ["symbol", "t0"])
    p = 0.5 + ((F.col("pos") * 37) % 100 - 50) / 250.0
    return b, out.withColumns({"side": F.when(F.col("r5") < 0, -1.0).otherwise(1.0), "p": p})


def histogram_sql(bins: int) -> str:
    """The end of a query that counts z.x of each symbol in bins of equal width."""
    return f""" SELECT symbol, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / (hi - lo) * {bins}), {bins - 1}) END AS BIGINT) AS bin, count(*) AS n
  FROM (SELECT symbol, x, min(x) OVER (PARTITION BY symbol) AS lo, max(x) OVER (PARTITION BY symbol) AS hi FROM z WHERE x IS NOT NULL) GROUP BY 1, 2"""


BARS = """
bars AS (
  SELECT l_returnflag AS symbol, l_shipdate AS ts,
    first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS open,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS close,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / sum(l_quantity) AS adj_close, sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2),
r AS (
  SELECT *, ln(adj_close / lag(adj_close) OVER w) AS ret, row_number() OVER w - 1 AS pos, adj_close * volume AS dv
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""
EVENTS = (
    BARS
    + """,
v AS (
  SELECT symbol, ts, pos, CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w END AS trgt
  FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
e0 AS (SELECT symbol, ts AS t0, pos AS p0, trgt FROM v WHERE pos % 10 = 0 AND pos >= 20),
ev AS (
  SELECT e.symbol, e.t0, e.p0, e.trgt, b.ts AS t1, b.pos AS p1
  FROM e0 e ASOF LEFT JOIN r b ON e.symbol = b.symbol AND e.t0 + INTERVAL 10 DAY <= b.ts)"""
)
TOUCH = (
    EVENTS
    + """,
tb AS (
  SELECT e.symbol, e.t0, e.p0, any_value(e.t1) AS t1, any_value(e.p1) AS p1, any_value(s.adj_close) AS c0,
    min(b.ts) FILTER (b.adj_close >= s.adj_close * (1 + e.trgt)) AS pt, min(b.ts) FILTER (b.adj_close <= s.adj_close * (1 - e.trgt)) AS sl
  FROM ev e JOIN r s ON s.symbol = e.symbol AND s.ts = e.t0
  JOIN r b ON b.symbol = e.symbol AND b.ts >= e.t0 AND (e.t1 IS NULL OR b.ts <= e.t1)
  GROUP BY e.symbol, e.t0, e.p0),
lb AS (
  SELECT t.*, least(t.t1, t.pt, t.sl) AS t_exit, x.adj_close / t.c0 - 1 AS ret,
    CAST(sign(x.adj_close / t.c0 - 1) AS DOUBLE) AS bin
  FROM (SELECT *, CASE WHEN t1 IS NOT NULL THEN least(t1, pt, sl) END AS tx FROM tb) t
  LEFT JOIN r x ON x.symbol = t.symbol AND x.ts = t.tx)"""
)
CONC = (
    EVENTS
    + """,
last_bar AS (SELECT symbol, max(pos) AS m FROM r GROUP BY 1),
sp AS (SELECT ev.*, coalesce(p1, m) AS q1 FROM ev JOIN last_bar USING (symbol)),
lim AS (SELECT symbol, min(p0) AS a, max(q1) AS b FROM sp GROUP BY 1),
conc AS (
  SELECT r.symbol, r.ts, r.pos, count(sp.t0) AS n
  FROM r JOIN lim ON lim.symbol = r.symbol AND r.pos BETWEEN a AND b
  LEFT JOIN sp ON sp.symbol = r.symbol AND r.pos BETWEEN sp.p0 AND sp.q1 GROUP BY 1, 2, 3)"""
)
PRED = (
    TOUCH
    + """,
pr AS (
  SELECT lb.*, CASE WHEN ln(b.adj_close / b5.adj_close) < 0 THEN -1.0 ELSE 1.0 END::DOUBLE AS side,
    0.5 + ((lb.p0 * 37) % 100 - 50) / 250.0::DOUBLE AS p
  FROM lb JOIN r b ON b.symbol = lb.symbol AND b.pos = lb.p0 LEFT JOIN r b5 ON b5.symbol = lb.symbol AND b5.pos = lb.p0 - 5)"""
)
