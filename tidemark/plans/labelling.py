"""Queries: barriers, labels, weights, folds, bets and backtests on strided events."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import normal_cdf_sql
from ..operators import backtest as bt
from ..operators import bets, labels, sampling, validation, weights
from ..sources.bars import bars
from .base import BARS, CONC, EVENTS, PRED, TOUCH, events, histogram_sql, labelled, pseudo_predictions, query, rounded

EWM = f"""WITH RECURSIVE {BARS},
s(symbol, pos, ts, w, w2, m1, m2) AS (
  SELECT symbol, pos, ts, 1.0::DOUBLE, 1.0::DOUBLE, ret, ret * ret FROM r WHERE pos = 1
  UNION ALL
  SELECT r.symbol, r.pos, r.ts, s.w * 49/51.0::DOUBLE + 1, s.w2 * (49/51.0::DOUBLE)**2 + 1, s.m1 * 49/51.0::DOUBLE + r.ret, s.m2 * 49/51.0::DOUBLE + r.ret * r.ret
  FROM s JOIN r ON r.symbol = s.symbol AND r.pos = s.pos + 1),
vol AS (SELECT r.symbol, r.ts, CASE WHEN s.w * s.w - s.w2 > 1e-9 THEN sqrt(greatest(0.0, (s.m2 / s.w - (s.m1 / s.w)**2) * s.w * s.w / (s.w * s.w - s.w2))) END AS vol
  FROM r LEFT JOIN s USING (symbol, pos))"""


@query("daily_vol", EWM + " SELECT symbol, ts, round(vol, 6) AS vol FROM vol")
def _(spark, sf):
    return rounded(labels.daily_vol(bars(spark, sf)))


@query("vol_backfill", EWM + " SELECT symbol, ts, round(coalesce(vol, avg(vol) OVER (PARTITION BY symbol)), 6) AS vol FROM vol")
def _(spark, sf):
    return rounded(labels.backfilled(labels.daily_vol(bars(spark, sf))))


@query("event_trgt", EWM + " SELECT v.symbol, v.ts AS t0, round(v.vol, 6) AS trgt FROM vol v JOIN r USING (symbol, ts) WHERE r.pos % 10 = 0 AND v.vol IS NOT NULL")
def _(spark, sf):
    b = bars(spark, sf)
    picked = sampling.strided(b, 10).select("symbol", F.col("ts").alias("t0"))
    return rounded(labels.event_targets(picked, labels.daily_vol(b)))


@query("vertical_barrier", f"WITH {EVENTS} SELECT symbol, t0, round(trgt, 6) AS trgt, t1 FROM ev")
def _(spark, sf):
    return rounded(events(spark, sf)[1])


@query("triple_barrier", f"WITH {TOUCH} SELECT symbol, t0, t1, pt, sl FROM tb")
def _(spark, sf):
    b, e = events(spark, sf)
    return labels.triple_barrier(e, b)


LABELS = f"WITH {TOUCH} SELECT symbol, t0, t1, pt, sl, CASE WHEN t1 IS NOT NULL THEN t_exit END AS t_exit, round(ret, 6) AS ret, bin FROM lb"


@query("label_bins", LABELS)
def _(spark, sf):
    return rounded(labelled(spark, sf)[1])


@query("labels_final", f"WITH {TOUCH} SELECT symbol, t0, t1, pt, sl, round(ret, 6) AS ret, bin FROM lb")
def _(spark, sf):
    b, e = events(spark, sf)
    touched = labels.triple_barrier(e, b)
    return rounded(touched.join(labels.label_bins(touched, b).select("symbol", "t0", "ret", "bin"), ["symbol", "t0"]))


@query("drop_rare_labels", f"""WITH {TOUCH}, c AS (SELECT symbol, bin, count(*) AS n FROM lb WHERE bin IS NOT NULL GROUP BY 1, 2),
q AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS k, n / sum(n) OVER (PARTITION BY symbol) AS share, row_number() OVER (PARTITION BY symbol ORDER BY n, bin) AS i FROM c)
SELECT lb.symbol, lb.t0, lb.bin FROM lb LEFT JOIN (SELECT symbol, bin FROM q WHERE i = 1 AND k >= 3 AND share <= 0.05) x ON x.symbol = lb.symbol AND x.bin = lb.bin WHERE x.symbol IS NULL""")
def _(spark, sf):
    return labels.drop_rare(labelled(spark, sf)[1]).select("symbol", "t0", "bin")


@query("barrier_type", f"WITH {TOUCH} SELECT symbol, t0, CASE WHEN t1 IS NOT NULL AND t_exit = sl THEN 'sl' WHEN t1 IS NOT NULL AND t_exit = pt THEN 'pt' ELSE 't1' END AS barrier FROM lb")
def _(spark, sf):
    return labels.barrier_type(labelled(spark, sf)[1]).select("symbol", "t0", "barrier")


@query("label_distribution", f"WITH {TOUCH} SELECT symbol, bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY symbol), 6) AS share FROM lb WHERE bin IS NOT NULL GROUP BY 1, 2")
def _(spark, sf):
    return rounded(labels.distribution(labelled(spark, sf)[1]))


@query("barrier_sensitivity", f"""WITH {EVENTS}, g AS (SELECT * FROM (VALUES (0.5::DOUBLE),(1.0),(1.5),(2.0)) a(w_pt), (VALUES (0.5::DOUBLE),(1.0),(1.5),(2.0)) b(w_sl)),
x AS (SELECT e.symbol, e.t0, g.w_pt, g.w_sl, any_value(s.adj_close) AS c0, arg_min(b.adj_close, b.ts) FILTER (b.adj_close >= s.adj_close * (1 + g.w_pt * e.trgt) OR b.adj_close <= s.adj_close * (1 - g.w_sl * e.trgt) OR b.ts = e.t1) AS c1
  FROM ev e JOIN r s ON s.symbol = e.symbol AND s.ts = e.t0 JOIN r b ON b.symbol = e.symbol AND b.ts BETWEEN e.t0 AND e.t1, g GROUP BY 1, 2, 3, 4)
SELECT w_pt, w_sl, round(avg(CASE WHEN c1 < c0 THEN 1.0 ELSE 0 END), 6) AS share_down, round(avg(CASE WHEN c1 = c0 THEN 1.0 ELSE 0 END), 6) AS share_flat, round(avg(CASE WHEN c1 > c0 THEN 1.0 ELSE 0 END), 6) AS share_up, count(*) AS n FROM x GROUP BY 1, 2""")
def _(spark, sf):
    b, e = events(spark, sf)
    return rounded(labels.sensitivity(e, b))


@query("concurrency", f"WITH {CONC} SELECT symbol, ts, pos, n FROM conc")
def _(spark, sf):
    b, e = events(spark, sf)
    return weights.concurrency(e, b)


@query("concurrency_series", f"WITH {CONC} SELECT symbol, ts, n FROM conc")
def _(spark, sf):
    b, e = events(spark, sf)
    return weights.concurrency(e, b).select("symbol", "ts", "n")


ACTIVE = f"WITH {EVENTS}, act AS (SELECT r.symbol, r.ts, count(ev.t0) AS n FROM r LEFT JOIN ev ON ev.symbol = r.symbol AND r.pos BETWEEN ev.p0 AND ev.p1 GROUP BY 1, 2)"


@query("active_count", ACTIVE + " SELECT symbol, ts, n FROM act")
def _(spark, sf):
    b, e = events(spark, sf)
    return weights.active_count(e, b)


@query("active_summary", ACTIVE + " SELECT symbol, max(n) AS most, round(avg(n) FILTER (n > 0), 6) AS mean_active FROM act GROUP BY 1")
def _(spark, sf):
    b, e = events(spark, sf)
    n = weights.active_count(e, b)
    return rounded(n.groupBy("symbol").agg(F.max("n").alias("most"), F.avg(F.when(F.col("n") > 0, F.col("n"))).alias("mean_active")))


UNIQ = CONC + """,
un AS (SELECT e.symbol, e.t0, e.p0, CASE WHEN e.t1 IS NOT NULL THEN avg(1.0 / c.n) END AS u
  FROM ev e LEFT JOIN conc c ON c.symbol = e.symbol AND c.pos BETWEEN e.p0 AND e.p1 GROUP BY e.symbol, e.t0, e.p0, e.t1)"""


@query("avg_uniqueness", f"WITH {UNIQ} SELECT symbol, t0, round(u, 6) AS uniqueness FROM un")
def _(spark, sf):
    b, e = events(spark, sf)
    return rounded(weights.uniqueness(e, b))


@query("histogram_uniqueness", f"""WITH {UNIQ}, m AS (SELECT symbol, round(u, 9) AS x, min(round(u, 9)) OVER (PARTITION BY symbol) AS lo, max(round(u, 9)) OVER (PARTITION BY symbol) AS hi FROM un WHERE u IS NOT NULL)
SELECT symbol, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / (hi - lo) * 50), 49) END AS BIGINT) AS bin, count(*) AS n FROM m GROUP BY 1, 2""")
def _(spark, sf):
    b, e = events(spark, sf)
    return sampling.histogram(weights.uniqueness(e, b).withColumn("u", F.round("uniqueness", 9)), "u", 50)


@query("indicator_matrix", f"WITH {EVENTS} SELECT r.symbol, r.pos, ev.t0 FROM r JOIN ev ON ev.symbol = r.symbol AND r.pos BETWEEN ev.p0 AND ev.p1")
def _(spark, sf):
    b, e = events(spark, sf)
    return weights.indicator(e, b)


@query("seq_bootstrap")
def _(spark, sf):
    b, e = events(spark, sf)
    return weights.bootstrap_uniqueness(e, b, 8).where("kind = 'sequential'")


@query("std_bootstrap")
def _(spark, sf):
    b, e = events(spark, sf)
    return weights.bootstrap_uniqueness(e, b, 8).groupBy("symbol", "kind").agg(F.avg("uniqueness").alias("uniqueness"))


@query("return_attribution", f"WITH {TOUCH} SELECT symbol, t0, round(abs(ret) / sum(abs(ret)) OVER (PARTITION BY symbol) * count(*) OVER (PARTITION BY symbol), 6) AS attribution FROM lb")
def _(spark, sf):
    return rounded(weights.return_attribution(labelled(spark, sf)[1]))


DECAY = "0.5 + 0.5 * (row_number() OVER (PARTITION BY symbol ORDER BY t0) - 1) / greatest(count(*) OVER (PARTITION BY symbol) - 1, 1)"


@query("time_decay", f"WITH {EVENTS}, d AS (SELECT symbol, t0, {DECAY} AS d FROM ev) SELECT symbol, t0, round(d / avg(d) OVER (PARTITION BY symbol), 6) AS decay FROM d")
def _(spark, sf):
    return rounded(weights.time_decay(events(spark, sf)[1]))


# The label part follows the concurrency part; both stand on the same events.
WEIGHT = CONC + TOUCH[len(EVENTS) :] + UNIQ[len(CONC) :] + f""",
wd AS (SELECT symbol, t0, t1, bin, abs(ret) / sum(abs(ret)) OVER (PARTITION BY symbol) * count(*) OVER (PARTITION BY symbol) AS a, {DECAY} AS d0 FROM lb),
wp AS (SELECT wd.*, un.u, a * u * (d0 / avg(d0) OVER (PARTITION BY wd.symbol)) AS prod FROM wd JOIN un USING (symbol, t0)),
wt AS (SELECT *, prod / avg(prod) OVER (PARTITION BY symbol) AS weight FROM wp)"""


@query("sample_weight", f"WITH {WEIGHT} SELECT symbol, t0, round(weight, 6) AS weight FROM wt")
def _(spark, sf):
    b, lab = labelled(spark, sf)
    return rounded(weights.sample_weights(lab, b).select("symbol", "t0", "weight"))


@query("weight_boxplot", f"WITH {WEIGHT} SELECT symbol, round(quantile_cont(weight, 0.25), 6) AS q25, round(quantile_cont(weight, 0.5), 6) AS q50, round(quantile_cont(weight, 0.75), 6) AS q75 FROM wt GROUP BY 1")
def _(spark, sf):
    b, lab = labelled(spark, sf)
    return rounded(sampling.describe(weights.sample_weights(lab, b), "weight").select("symbol", "q25", "q50", "q75"))


def _folds(k):
    return f"""nn AS (SELECT symbol, t0, t1, row_number() OVER (PARTITION BY symbol ORDER BY t0) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n,
  CAST(ntile({k}) OVER (PARTITION BY symbol ORDER BY t0) - 1 AS BIGINT) AS g FROM ev),
bd AS (SELECT symbol, g, min(pos) AS a, max(pos) AS b, min(t0) AS s FROM nn GROUP BY 1, 2)"""


PURGED = f"""WITH {EVENTS}, {_folds(5)},
sp5 AS (SELECT nn.symbol, bd.g AS fold, nn.t0, nn.pos, CASE WHEN nn.pos BETWEEN a AND b THEN 'test' WHEN nn.pos < a AND nn.t1 >= s THEN 'purged'
  WHEN nn.pos > b AND nn.pos <= b + floor(n * 0.01) THEN 'embargo' ELSE 'train' END AS role FROM nn JOIN bd USING (symbol))"""
CPCV = f"""WITH {EVENTS}, {_folds(6)},
cs AS (SELECT x.g AS g1, y.g AS g2, row_number() OVER (ORDER BY x.g, y.g) - 1 AS split FROM range(6) x(g), range(6) y(g) WHERE x.g < y.g),
sp6 AS (SELECT nn.symbol, cs.split, nn.t0, nn.pos, CASE WHEN nn.g IN (g1, g2) THEN 'test' WHEN nn.pos < b1.a AND nn.t1 >= b1.s THEN 'purged'
  WHEN nn.pos > b2.b AND nn.pos <= b2.b + greatest(1, floor(n * 0.01)) THEN 'embargo' ELSE 'train' END AS role
  FROM nn JOIN cs ON true JOIN bd b1 ON b1.symbol = nn.symbol AND b1.g = g1 JOIN bd b2 ON b2.symbol = nn.symbol AND b2.g = g2)"""


@query("purged_kfold", PURGED + " SELECT * FROM sp5")
def _(spark, sf):
    return validation.purged_kfold(events(spark, sf)[1])


@query("fold_composition", PURGED + " SELECT symbol, fold, count(*) FILTER (role='train') AS n_train, count(*) FILTER (role='test') AS n_test, count(*) FILTER (role IN ('purged','embargo')) AS n_missing FROM sp5 GROUP BY 1, 2")
def _(spark, sf):
    return validation.composition(validation.purged_kfold(events(spark, sf)[1]))


@query("kfold_naive", f"WITH {EVENTS}, {_folds(5)} SELECT nn.symbol, bd.g AS fold, nn.t0, nn.pos, CASE WHEN nn.g = bd.g THEN 'test' ELSE 'train' END AS role FROM nn JOIN bd USING (symbol)")
def _(spark, sf):
    return validation.naive_kfold(events(spark, sf)[1])


@query("cpcv_split", CPCV + " SELECT * FROM sp6")
def _(spark, sf):
    return validation.combinatorial_splits(events(spark, sf)[1])


@query("cpcv_split_sizes", CPCV + " SELECT symbol, split, count(*) FILTER (role='train') AS n_train, count(*) FILTER (role='test') AS n_test, count(*) FILTER (role IN ('purged','embargo')) AS n_missing FROM sp6 GROUP BY 1, 2")
def _(spark, sf):
    return validation.composition(validation.combinatorial_splits(events(spark, sf)[1]), "split")


@query("n_splits", "SELECT 5::BIGINT AS kfold, 15::BIGINT AS combinatorial, 5::BIGINT AS paths")
def _(spark, sf):
    one = spark.range(1)
    return one.select(F.lit(5).cast("long").alias("kfold"), F.lit(math.comb(6, 2)).cast("long").alias("combinatorial"), F.lit(math.comb(5, 1)).cast("long").alias("paths"))


# Predictions by rule, with labels as classes: what scores are computed of.
SCORED = f"""WITH {PRED}, q AS (SELECT symbol, t0, p0, ntile(5) OVER (PARTITION BY symbol ORDER BY t0) - 1 AS fold, CASE WHEN bin > 0 THEN 1 ELSE -1 END AS y,
  CASE WHEN p >= 0.5 THEN 1 ELSE -1 END AS pred, greatest(1e-15, least(1 - 1e-15, p)) AS p, 1 + (p0 % 7) / 10.0::DOUBLE AS weight, side, bin FROM pr WHERE ret IS NOT NULL)"""


def scored(spark, sf):
    _, p = pseudo_predictions(spark, sf)
    p = p.where("ret is not null")
    return p.select(
        "symbol", "t0", (F.ntile(5).over(W.partitionBy("symbol").orderBy("t0")) - 1).cast("long").alias("fold"),
        F.when(F.col("bin") > 0, 1).otherwise(-1).alias("y"), F.when(F.col("p") >= 0.5, 1).otherwise(-1).alias("pred"), "p",
        (1 + (F.col("pos") % 7) / 10.0).alias("weight"), "side", F.col("bin").alias("label"), "pos",
    )


_METRICS = """round(sum(CASE WHEN y = pred THEN weight ELSE 0 END) / sum(weight), 6) AS accuracy,
round(sum(weight * ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)) / sum(weight), 6) AS neg_log_loss,
round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2*tp / nullif(2*tp + fp + fn, 0), 0), 6) AS f1"""


def _metrics_sql(by):
    sums = {"tp": "y = 1 AND pred = 1", "fp": "y <> 1 AND pred = 1", "fn": "y = 1 AND pred <> 1"}
    body = _METRICS
    for k, c in sums.items():
        body = body.replace(f"{k} ", f"sum(CASE WHEN {c} THEN weight ELSE 0.0 END) ").replace(f"*{k}", f"*sum(CASE WHEN {c} THEN weight ELSE 0.0 END)").replace(f"+ {k}", f"+ sum(CASE WHEN {c} THEN weight ELSE 0.0 END)")
    return SCORED + f" SELECT {by}, {body} FROM q GROUP BY ALL"


@query("fold_metrics", _metrics_sql("symbol, fold"))
def _(spark, sf):
    return rounded(validation.scores(scored(spark, sf)))


@query("weighted_score", _metrics_sql("symbol"))
def _(spark, sf):
    return rounded(validation.scores(scored(spark, sf), ("symbol",)))


@query("confusion_matrix", SCORED + " SELECT symbol, y, count(*) FILTER (pred = -1) AS pred_down, count(*) FILTER (pred = 1) AS pred_up FROM q GROUP BY 1, 2")
def _(spark, sf):
    return validation.confusion(scored(spark, sf))


@query("majority_baseline", SCORED + ", c AS (SELECT symbol, bin, count(*) AS n FROM q GROUP BY 1, 2) SELECT symbol, round(max(n) / sum(n), 6) AS baseline FROM c GROUP BY 1")
def _(spark, sf):
    return rounded(validation.majority_baseline(scored(spark, sf)))


ACC = SCORED + ", a AS (SELECT symbol, fold, sum(CASE WHEN y = pred THEN weight ELSE 0 END) / sum(weight) AS score FROM q GROUP BY 1, 2)"


@query("representative_fold", ACC + ", d AS (SELECT *, round(abs(score - avg(score) OVER (PARTITION BY symbol)), 12) AS away FROM a) SELECT symbol, first(fold ORDER BY away, fold) AS fold FROM d GROUP BY 1")
def _(spark, sf):
    s = validation.scores(scored(spark, sf)).select("symbol", "fold", F.col("accuracy").alias("score"))
    return validation.representative_fold(s)


@query("cv_results", ACC + " SELECT symbol, CAST(fold AS VARCHAR) AS fold, round(score, 6) AS score FROM a UNION ALL SELECT symbol, 'mean', round(avg(score), 6) FROM a GROUP BY 1 UNION ALL SELECT symbol, 'std', round(stddev_samp(score), 6) FROM a GROUP BY 1")
def _(spark, sf):
    s = validation.scores(scored(spark, sf)).select("symbol", F.col("fold").cast("string").alias("fold"), F.col("accuracy").alias("score"))
    mean = s.groupBy("symbol").agg(F.lit("mean").alias("fold"), F.avg("score").alias("score"))
    std = s.groupBy("symbol").agg(F.lit("std").alias("fold"), F.stddev_samp("score").alias("score"))
    return rounded(s.unionByName(mean).unionByName(std))


@query("validate_oos", SCORED + " SELECT symbol, count(*) AS n, count(*) FILTER (p IS NULL) AS n_null, count(*) FILTER (side NOT IN (-1, 1)) AS n_side, round(avg(CASE WHEN side = bin THEN 1.0 ELSE 0 END), 6) AS accuracy FROM q GROUP BY 1")
def _(spark, sf):
    return rounded(bets.validate_oos(scored(spark, sf)))


@query("oos_accuracy", SCORED + " SELECT symbol, round(avg(CASE WHEN side = bin THEN 1.0 ELSE 0 END), 6) AS accuracy, round(avg(CASE WHEN side = 1 THEN 1.0 ELSE 0 END), 6) AS share_long FROM q GROUP BY 1")
def _(spark, sf):
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    rows = scored(spark, sf)
    return rounded(rows.groupBy("symbol").agg(share(F.col("side") == F.col("label")).alias("accuracy"), share(F.col("side") == 1).alias("share_long")))


META = f"WITH {PRED}, me AS (SELECT *, coalesce(CAST(ret * side > 0 AS INT), 0) AS meta_label FROM pr)"


@query("meta_labels", META + " SELECT symbol, t0, side, round(ret, 6) AS ret, meta_label FROM me")
def _(spark, sf):
    _, p = pseudo_predictions(spark, sf)
    return rounded(bets.meta_labels(p, p).select("symbol", "t0", "side", "ret", "meta_label"))


@query("meta_baseline", META + " SELECT symbol, round(avg(meta_label), 6) AS share FROM me GROUP BY 1")
def _(spark, sf):
    _, p = pseudo_predictions(spark, sf)
    return rounded(bets.meta_labels(p, p).groupBy("symbol").agg(F.avg("meta_label").alias("share")))


Z = "((p - 0.5) / sqrt(p * (1 - p)))"
SIGNAL = f"WITH {PRED}, sg AS (SELECT symbol, t0, t1, side * (2 * {normal_cdf_sql(Z)} - 1) AS signal FROM pr)"
POINTS = SIGNAL + """,
ts AS (SELECT symbol, t0 AS ts FROM sg UNION SELECT symbol, t1 FROM sg WHERE t1 IS NOT NULL),
av AS (SELECT ts.symbol, ts.ts, coalesce(avg(sg.signal), 0.0) AS signal FROM ts LEFT JOIN sg ON sg.symbol = ts.symbol AND ts.ts BETWEEN sg.t0 AND sg.t1 GROUP BY 1, 2)"""
POSITIONS = POINTS + """,
dp AS (SELECT r.symbol, r.ts, r.pos, r.adj_close, coalesce(round_even(av.signal / 0.2, 0) * 0.2, 0.0) AS position FROM r ASOF LEFT JOIN av ON av.symbol = r.symbol AND r.ts >= av.ts)"""


def _signals(spark, sf, step=0.0):
    b, p = pseudo_predictions(spark, sf)
    return b, bets.bet_signal(p, step).select("symbol", "t0", "t1", "signal")


def _positions(spark, sf):
    b, s = _signals(spark, sf)
    return b, bets.daily_positions(bets.average_active(s), b, 0.2)


@query("bet_signal", SIGNAL + " SELECT symbol, t0, round(signal, 6) AS signal FROM sg")
def _(spark, sf):
    return rounded(_signals(spark, sf)[1].select("symbol", "t0", "signal"))


@query("discrete_signal", SIGNAL + " SELECT symbol, t0, round(round_even(signal / 0.1, 0) * 0.1 + 0.0, 6) AS signal FROM sg")
def _(spark, sf):
    return rounded(_signals(spark, sf, 0.1)[1].select("symbol", "t0", "signal"))


@query("histogram_signal", SIGNAL + ", z AS (SELECT symbol, round(signal, 9) AS x FROM sg)" + histogram_sql(20))
def _(spark, sf):
    s = _signals(spark, sf)[1]
    return sampling.histogram(s.withColumn("signal", F.round("signal", 9)), "signal", 20)


@query("histogram_meta_prob", f"WITH {PRED}, z AS (SELECT symbol, round(p, 9) AS x FROM pr)" + histogram_sql(20))
def _(spark, sf):
    p = pseudo_predictions(spark, sf)[1]
    return sampling.histogram(p.withColumn("p", F.round("p", 9)), "p", 20)


@query("histogram_bet_size", POSITIONS + ", z AS (SELECT symbol, round(position, 6) AS x FROM dp)" + histogram_sql(15))
def _(spark, sf):
    d = _positions(spark, sf)[1]
    return sampling.histogram(d.withColumn("position", F.round("position", 6)), "position", 15)


@query("avg_active_signals", POINTS + " SELECT symbol, ts, round(signal, 6) + 0.0 AS signal FROM av")
def _(spark, sf):
    return rounded(bets.average_active(_signals(spark, sf)[1]))


@query("daily_positions", POSITIONS + " SELECT symbol, ts, round(position, 6) + 0.0 AS position FROM dp")
def _(spark, sf):
    return rounded(_positions(spark, sf)[1])


@query("position_levels", POSITIONS + " SELECT symbol, round(position, 6) + 0.0 AS position, count(*) AS n FROM dp GROUP BY 1, 2")
def _(spark, sf):
    return rounded(bets.position_levels(_positions(spark, sf)[1]))


@query("sign_position", f"WITH {PRED} SELECT symbol, t0, CAST(sign(2 * p - 1) AS DOUBLE) + 0.0 AS position FROM pr")
def _(spark, sf):
    _, p = pseudo_predictions(spark, sf)
    return p.select("symbol", "t0", (F.signum(2 * F.col("p") - 1) + 0.0).alias("position"))


RUN = POSITIONS + """,
b1 AS (SELECT *, coalesce(adj_close / lag(adj_close) OVER w - 1, 0.0) AS pr1, coalesce(lag(position) OVER w, 0.0) AS held, coalesce(abs(position - lag(position) OVER w) * 0.0005, 0.0) AS cost FROM dp WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
b2 AS (SELECT *, held * pr1 AS gross, held * pr1 - cost AS net FROM b1),
b3 AS (SELECT *, product(1 + net) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS cum FROM b2),
b4 AS (SELECT *, max(cum) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS hwm FROM b3),
b5 AS (SELECT *, 1 - cum / hwm AS dd FROM b4)"""


def _run(spark, sf):
    b, p = _positions(spark, sf)
    return bt.backtest(p, b)


@query("backtest", RUN + " SELECT symbol, ts, round(position,6)+0.0 AS position, round(pr1,6)+0.0 AS price_return, round(gross,6)+0.0 AS gross_return, round(cost,6)+0.0 AS cost, round(net,6)+0.0 AS net_return, round(cum,6) AS cumulative, round(hwm,6) AS hwm, round(dd,6)+0.0 AS drawdown FROM b5")
def _(spark, sf):
    return rounded(_run(spark, sf))


@query("buy_hold_curve", f"WITH {BARS}, x AS (SELECT symbol, ts, coalesce(adj_close / lag(adj_close) OVER (PARTITION BY symbol ORDER BY ts) - 1, 0.0) AS q FROM r) SELECT symbol, ts, round(product(1 + q) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) AS cumulative FROM x")
def _(spark, sf):
    return rounded(bt.buy_and_hold(bars(spark, sf)))


@query("sharpe", RUN + " SELECT symbol, round(CASE WHEN stddev_samp(net) > 0 THEN avg(net) / stddev_samp(net) * sqrt(252) ELSE 0 END, 6) AS sharpe FROM b5 GROUP BY 1")
def _(spark, sf):
    return rounded(bt.sharpe(_run(spark, sf)))


CHANCE = validation.expected_maximum(1.0, 50)
MOMENTS = RUN + f""",
mo AS (SELECT symbol, avg(net) / stddev_samp(net) AS sr, count(*)::DOUBLE AS n, skewness(net) AS g, kurtosis(net) + 3 AS k FROM b5 GROUP BY 1),
ps AS (SELECT *, sqrt((1 - g * sr + (k - 1) / 4 * sr * sr) / greatest(1.0, n - 1)) * {CHANCE!r} AS sr_chance, sqrt(greatest(1.0, n - 1)) / sqrt(greatest(1e-12, 1 - g * sr + (k - 1) / 4 * sr * sr)) AS f FROM mo)"""


@query("psr_returns", MOMENTS + " SELECT symbol, round(sr * f, 5) AS psr_z FROM ps")
def _(spark, sf):
    return rounded(bt.deflated(_run(spark, sf)).select("symbol", "psr_z"), 5)


@query("dsr_returns", MOMENTS + f" SELECT symbol, round(sr_chance, 6) AS sr_chance, round((sr - sr_chance) * f, 5) AS dsr_z, round({normal_cdf_sql('((sr - sr_chance) * f)')}, 5) AS dsr FROM ps")
def _(spark, sf):
    out = bt.deflated(_run(spark, sf))
    return out.select("symbol", F.round("sr_chance", 6).alias("sr_chance"), F.round("dsr_z", 5).alias("dsr_z"), F.round("dsr", 5).alias("dsr"))


@query("dd_tuw", RUN + """,
f AS (SELECT *, dd > 1e-10 AS under FROM b5), g AS (SELECT *, lead(ts) OVER w AS nx, CASE WHEN under AND NOT coalesce(lag(under) OVER w, false) THEN 1 ELSE 0 END AS st FROM f WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
h AS (SELECT *, sum(st) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS ep FROM g),
s AS (SELECT symbol, ep, min(ts) AS a, arg_max(coalesce(nx, TIMESTAMP '1900-01-01'), ts) AS b FROM h WHERE under GROUP BY 1, 2),
l AS (SELECT symbol, max(date_diff('day', a, b)) FILTER (b > TIMESTAMP '1900-01-01') AS d FROM s GROUP BY 1)
SELECT b5.symbol, round(max(dd), 6) AS max_drawdown, coalesce(any_value(l.d), 0) AS time_under_water, first(ts ORDER BY hwm DESC, ts) AS peak, first(ts ORDER BY dd DESC, ts) AS trough FROM b5 LEFT JOIN l USING (symbol) GROUP BY 1""")
def _(spark, sf):
    return rounded(bt.underwater(_run(spark, sf)))


RATIOS = RUN + """,
ra AS (SELECT symbol, (1 + avg(net))**252 - 1 AS annual_return, stddev_samp(net) * sqrt(252) AS annual_vol, max(dd) AS mdd, count(*) FILTER (net > 0) / nullif(count(*) FILTER (net <> 0), 0) AS hit_ratio,
  sum(net) FILTER (net > 0) / nullif(abs(sum(net) FILTER (net < 0)), 0) AS profit_factor, min(ts) AS first_day, max(ts) AS last_day, count(*) AS n_days FROM b5 GROUP BY 1)"""


def _ratio(name, sql, columns):
    @query(name, RATIOS + f" SELECT symbol, {sql} FROM ra")
    def _(spark, sf):
        return rounded(bt.ratios(_run(spark, sf)).select("symbol", *columns))


_ratio("calmar", "round(annual_return / mdd, 6) AS calmar", ["calmar"])
_ratio("hit_ratio", "round(hit_ratio, 6) AS hit_ratio", ["hit_ratio"])
_ratio("profit_factor", "round(profit_factor, 6) AS profit_factor", ["profit_factor"])


@query("summary_table", RATIOS + " SELECT symbol, first_day, last_day, n_days, round(annual_return, 6) AS annual_return, round(annual_vol, 6) AS annual_vol, round(annual_return / mdd, 6) AS calmar FROM ra")
def _(spark, sf):
    cols = ["symbol", "first_day", "last_day", "n_days", "annual_return", "annual_vol", "calmar"]
    return rounded(bt.summary(_run(spark, sf)).select(*cols))


@query("summary_report")
def _(spark, sf):
    return bt.formatted(bt.summary(_run(spark, sf)))


@query("monthly_returns", RUN + """,
mm AS (SELECT symbol, CAST(date_trunc('month', ts) AS DATE) AS month, product(1 + net) - 1 AS ret FROM b5 GROUP BY 1, 2),
cal AS (SELECT symbol, unnest(generate_series(min(month)::TIMESTAMP, max(month)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month FROM mm GROUP BY 1)
SELECT cal.symbol, cal.month, round(coalesce(mm.ret, 0.0), 6) + 0.0 AS ret FROM cal LEFT JOIN mm USING (symbol, month)""")
def _(spark, sf):
    return rounded(bt.monthly(_run(spark, sf)))


@query("monthly_table")
def _(spark, sf):
    return rounded(bt.monthly_table(_run(spark, sf)))
