"""Queries: fractional differencing, the feature matrix, and models on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import log_return
from ..operators import backtest as bt
from ..operators import bets, features, fracdiff, labels, models, sampling, validation, weights
from ..runtime import fresh_path, materialize
from ..sources import bars as src
from .base import BARS, labelled, query, rounded
from .labelling import SCORED, scored

THRESHOLD = 1e-5
ORDER = 0.4


def _logs(spark, sf):
    return src.bars(spark, sf).select("symbol", "ts", F.ln("adj_close").alias("x"))


WEIGHTS = f"""fw AS (
  SELECT 0 AS k, 1.0::DOUBLE AS weight
  UNION ALL
  SELECT k + 1, -weight * ({ORDER}::DOUBLE - k) / (k + 1) FROM fw WHERE abs(-weight * ({ORDER}::DOUBLE - k) / (k + 1)) >= {THRESHOLD})"""


@query("ffd_weights", f"WITH RECURSIVE {WEIGHTS} SELECT k, round(weight, 9) AS weight FROM fw")
def _(spark, sf):
    return rounded(fracdiff.weight_table(spark, ORDER, THRESHOLD), 9)


@query("fd_weights", f"WITH RECURSIVE {WEIGHTS} SELECT k, round(weight, 9) AS weight FROM fw WHERE k < 5")
def _(spark, sf):
    return rounded(fracdiff.weight_table(spark, ORDER, THRESHOLD, 5), 9)


FFD = f"""WITH RECURSIVE {WEIGHTS}, {BARS},
fx AS (SELECT a.symbol, a.ts, a.pos, sum(fw.weight * ln(b.adj_close)) AS y FROM r a JOIN fw ON a.pos >= (SELECT max(k) FROM fw) JOIN r b ON b.symbol = a.symbol AND b.pos = a.pos - fw.k GROUP BY 1, 2, 3)"""


@query("frac_diff_ffd", FFD + " SELECT r.symbol, r.ts, round(y, 6) AS fracdiff FROM r LEFT JOIN fx USING (symbol, ts)")
def _(spark, sf):
    return rounded(fracdiff.frac_diff(_logs(spark, sf), "x", ORDER, THRESHOLD))


@query("ffd_overlay", FFD + ", p AS (SELECT r.symbol, ln(r.adj_close) AS x, fx.y FROM r JOIN fx USING (symbol, ts)) SELECT symbol, round(corr(x, y), 6) AS corr, count(*) AS n FROM p GROUP BY 1")
def _(spark, sf):
    x = _logs(spark, sf)
    both = x.join(fracdiff.frac_diff(x, "x", ORDER, THRESHOLD).na.drop(), ["symbol", "ts"])
    return rounded(both.groupBy("symbol").agg(F.corr("x", "fracdiff").alias("corr"), F.count(F.lit(1)).alias("n")))


@query("adf_test", f"""WITH {BARS}, x AS (SELECT symbol, ts, ln(adj_close) - avg(ln(adj_close)) OVER (PARTITION BY symbol) AS x FROM r),
d AS (SELECT *, x - lag(x) OVER w AS dx, lag(x) OVER w AS l FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
e AS (SELECT *, lag(dx) OVER (PARTITION BY symbol ORDER BY ts) AS dl FROM d),
s AS (SELECT symbol, count(*) AS n, var_pop(l) AS ll, var_pop(dl) AS dd, covar_pop(l, dl) AS ld, covar_pop(dx, l) AS yl, covar_pop(dx, dl) AS yd, var_pop(dx) AS yy FROM e WHERE dl IS NOT NULL GROUP BY 1),
b AS (SELECT *, ll * dd - ld * ld AS det, (yl * dd - yd * ld) / (ll * dd - ld * ld) AS b1, (yd * ll - yl * ld) / (ll * dd - ld * ld) AS b2 FROM s)
SELECT symbol, round(b1 / sqrt((yy - b1 * yl - b2 * yd) / (n - 3) * dd / det), 5) AS adf_stat, n FROM b""")
def _(spark, sf):
    return rounded(fracdiff.adf(_logs(spark, sf), "x").select("symbol", "adf_stat", "n"), 5)


def _sweep(spark, sf):
    return fracdiff.sweep(_logs(spark, sf), "x", [i / 20 for i in range(21)], THRESHOLD)


@query("ffd_sweep")
def _(spark, sf):
    return rounded(_sweep(spark, sf), 6)


@query("find_min_d")
def _(spark, sf):
    return fracdiff.least_order(_sweep(spark, sf))


_written: dict = {}


def _once(spark, sf, name, make):
    """A table that several queries read, written once a session and folder of tables."""
    key = spark.sparkContext.applicationId, sf, name
    if key not in _written:
        _written[key] = materialize(make(), name)
    return _written[key]


def _matrix(spark, sf):
    """The feature matrix of the strided events."""
    return _once(spark, sf, "matrix", lambda: _new_matrix(spark, sf))


def _new_matrix(spark, sf):
    b, lab = labelled(spark, sf)
    fd = fracdiff.frac_diff(_logs(spark, sf), "x", ORDER, THRESHOLD)
    out = features.feature_matrix(features.features(b), fd, lab, weights.sample_weights(lab, b))
    return out


@query("feature_matrix")
def _(spark, sf):
    return rounded(_matrix(spark, sf))


@query("features_wide")
def _(spark, sf):
    return rounded(features.features(src.bars(spark, sf)))


@query("feature_cols_15")
def _(spark, sf):
    return _matrix(spark, sf).select("symbol", "t0", *features.CORE)


@query("feature_corr")
def _(spark, sf):
    return rounded(features.correlations(_matrix(spark, sf), features.CORE))


@query("nan_inf_audit")
def _(spark, sf):
    return features.audit(_matrix(spark, sf), features.CORE).select("column", "n_null", "n_inf", "std", "n_unique")


@query("feature_stats")
def _(spark, sf):
    return rounded(features.audit(_matrix(spark, sf), features.CORE))


@query("feature_inventory")
def _(spark, sf):
    m = _matrix(spark, sf)
    return m.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(m.columns)))


FOLDS = 5
SEEDS = (42, 123, 456, 789, 2024)


def _data(spark, sf, columns=features.CORE):
    return models.dataset(_matrix(spark, sf), columns)


def _forest(seed=42):
    """The tuned forest."""
    return models.forest(100, 7, 20, seed=seed)


def _meta_forest(seed=42):
    return models.forest(100, 3, 20, seed=seed)


@query("cv_score")
def _(spark, sf):
    return models.cv_score(_forest(), _data(spark, sf), FOLDS)


@query("four_way_weights")
def _(spark, sf):
    return models.four_ways(_forest(), _data(spark, sf), FOLDS)


@query("train_and_evaluate")
def _(spark, sf):
    return models.train_and_evaluate(_forest(), _data(spark, sf), FOLDS)[1]


# Makers of the models that several tables compare (fixed values: the published sizes and tuned parameters).
MODELS = {
    "forest": models.forest(),
    "boosted": models.boosted(),
    "forest tuned": _forest(),
    "boosted tuned": models.boosted(200, 7, 0.01, 0.8, "0.5"),
}


def _fold_scores(spark, sf, name, columns=features.CORE):
    """mean_score and std_score of a model over the purged folds; one fit a session."""

    def make():
        folds = _once(spark, sf, "folds", lambda: validation.purged_kfold(_matrix(spark, sf).select("symbol", "t0", "t1"), FOLDS))
        found = models.cv_score(MODELS[name], _data(spark, sf, columns), FOLDS, folds=folds)
        return found.agg(F.avg("accuracy").alias("mean_score"), F.stddev_samp("accuracy").alias("std_score"))

    return _once(spark, sf, f"scores-{name}-{len(columns)}".replace(" ", "-"), make)


def _majority(spark, sf):
    return _data(spark, sf).groupBy("class").count().agg((F.max("count") / F.sum("count")).alias("baseline"))


@query("rf_baseline")
def _(spark, sf):
    return _fold_scores(spark, sf, "forest")


@query("xgb_baseline")
def _(spark, sf):
    return _fold_scores(spark, sf, "boosted")


@query("model_comparison")
def _(spark, sf):
    forest, boosted = (_fold_scores(spark, sf, name).withColumn("model", F.lit(name)) for name in ("forest", "boosted"))
    out = forest.unionByName(boosted).crossJoin(F.broadcast(_majority(spark, sf)))  # one row
    return out.withColumn("beats_baseline", F.col("mean_score") > F.col("baseline"))


@query("sink_model")
def _(spark, sf):
    from pyspark.ml.classification import RandomForestClassificationModel

    d = _data(spark, sf)
    path = fresh_path(spark, "model")
    models.fit(_forest(), d).write().overwrite().save(path)
    return models.predict(RandomForestClassificationModel.load(path), d).select("symbol", "t0", "pred", "p")


@query("mdi")
def _(spark, sf):
    return models.mdi(models.fit(_forest(), _data(spark, sf)), features.CORE, spark)


@query("mda")
def _(spark, sf):
    return models.mda(_forest(), _data(spark, sf), features.CORE, FOLDS)


@query("sfi")
def _(spark, sf):
    return models.sfi(_forest(), _matrix(spark, sf), features.CORE, FOLDS)


KINDS = ("mdi", "mda", "sfi")


def _importance(spark, sf):
    """feature, and mean and error of each kind of importance, of the models on the feature matrix."""

    def make():
        d, columns = _data(spark, sf), features.CORE
        found = {
            "mdi": models.mdi(models.fit(_forest(), d), columns, spark),
            "mda": models.mda(_forest(), d, columns, FOLDS),
            "sfi": models.sfi(_forest(), _matrix(spark, sf), columns, FOLDS),
        }
        return models.importance_table(**found)

    return _once(spark, sf, "importance", make)


def _ranked(spark, sf):
    means = _importance(spark, sf).select("feature", *[F.col(f"{k}_mean").alias(k) for k in KINDS])
    return validation.ranks(means, KINDS)


@query("importance_rank")
def _(spark, sf):
    return _ranked(spark, sf).select("feature", *[f"{k}_rank" for k in KINDS], "avg_rank")


@query("bottom_quartile_rule")
def _(spark, sf):
    return validation.bottom_quartile(_ranked(spark, sf), KINDS).select("feature", "kept")


@query("importance_table")
def _(spark, sf):
    kept = validation.bottom_quartile(_ranked(spark, sf), KINDS).select("feature", "avg_rank", "kept")
    return _importance(spark, sf).join(kept, "feature")


SPACE = {"trees": (100, 200, 500), "depth": (3, 5, 7, 10), "leaf": (5, 10, 20, 30), "features": ("sqrt", "0.5", "1.0"), "balanced": (True, False)}


GRID = {"trees": (100,), "depth": (3, 7), "leaf": (10, 20)}


@query("grid_search")
def _(spark, sf):
    return models.search(models.forest, _data(spark, sf), models.grid_of(GRID), FOLDS)


@query("random_search")
def _(spark, sf):
    return models.search(models.forest, _data(spark, sf), models.random_grid(SPACE, 25), FOLDS)


# A search whose model is a rule on the event's number: eight points, scored by weighted accuracy in the folds of the
# labelled events. SQL can follow it from line items to the log of trials.
TRIALS_SQL = SCORED + """, tr AS (
  SELECT CAST(t.trial AS INT) AS trial, CAST(fold AS INT) AS fold, CAST(t.trial % 3 AS VARCHAR) AS depth, CAST(t.trial % 2 AS VARCHAR) AS trees,
    round(sum(CASE WHEN y = CASE WHEN (p0 * 37 + 13 * t.trial) % 100 >= 50 THEN 1 ELSE -1 END THEN weight ELSE 0.0 END) / sum(weight), 9) AS score
  FROM q, range(8) t(trial) GROUP BY t.trial, fold),
st AS (SELECT trial, avg(score) AS mean_score, stddev_samp(score) AS std_score FROM tr GROUP BY 1)"""


def _trials(spark, sf):
    """trial, fold, score, params of that search."""
    rows = scored(spark, sf).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(7))))
    said = F.when((F.col("pos") * 37 + 13 * F.col("trial")) % 100 >= 50, 1).otherwise(-1)
    score = F.sum(F.when(F.col("y") == said, F.col("weight")).otherwise(0.0)) / F.sum("weight")
    found = rows.groupBy("trial", F.col("fold").cast("int").alias("fold")).agg(F.round(score, 9).alias("score"))
    text = lambda n: (F.col("trial") % n).cast("string")
    return found.withColumn("params", F.create_map(F.lit("depth"), text(3), F.lit("trees"), text(2)))


@query("evaluate_params", TRIALS_SQL + " SELECT trial, round(mean_score, 6) AS mean_score, round(std_score, 6) AS std_score, round(mean_score / std_score, 6) AS sr_trial FROM st")
def _(spark, sf):
    return rounded(validation.trial_stats(_trials(spark, sf)))


@query("summarise_trials", TRIALS_SQL + " SELECT trial, round(mean_score, 6) AS mean_score, round(std_score, 6) AS std_score FROM st ORDER BY mean_score DESC, trial LIMIT 1")
def _(spark, sf):
    return rounded(validation.best_trial(validation.trial_stats(_trials(spark, sf)).select("trial", "mean_score", "std_score")))


@query("log_trials", TRIALS_SQL + " SELECT trial, any_value(depth) AS param_depth, any_value(trees) AS param_trees, " + ", ".join(f"round(max(score) FILTER (fold = {j}), 6) AS fold_{j + 1}" for j in range(5)) + ", round(avg(score), 6) AS mean_score FROM tr GROUP BY 1")
def _(spark, sf):
    return rounded(models.trial_log(_trials(spark, sf)).drop("std_score", "sr_trial"))


@query("tuning_log", TRIALS_SQL + " SELECT 'rule' AS model, trial, round(mean_score, 6) AS mean_score FROM st UNION ALL SELECT 'against the rule', trial, round(1 - mean_score, 6) FROM st")
def _(spark, sf):
    s = validation.trial_stats(_trials(spark, sf)).select("trial", "mean_score")
    other = s.withColumn("mean_score", 1 - F.col("mean_score"))
    return rounded(s.withColumn("model", F.lit("rule")).unionByName(other.withColumn("model", F.lit("against the rule"))))


@query("tuning_pivot", TRIALS_SQL + " SELECT depth, round(avg(score) FILTER (trees = '0'), 6) AS trees_0, round(avg(score) FILTER (trees = '1'), 6) AS trees_1 FROM tr GROUP BY 1")
def _(spark, sf):
    t = _trials(spark, sf).select(F.col("params")["depth"].alias("depth"), F.col("params")["trees"].alias("trees"), "score")
    return rounded(t.groupBy("depth").pivot("trees", ["0", "1"]).agg(F.avg("score")).toDF("depth", "trees_0", "trees_1"))


@query("histogram_trials", TRIALS_SQL + ", m AS (SELECT mean_score AS x, min(mean_score) OVER () AS lo, max(mean_score) OVER () AS hi FROM st) SELECT 'all' AS symbol, CAST(least(floor((x - lo) / (hi - lo) * 12), 11) AS BIGINT) AS bin, count(*) AS n FROM m GROUP BY 2")
def _(spark, sf):
    s = validation.trial_stats(_trials(spark, sf)).withColumn("symbol", F.lit("all"))
    return sampling.histogram(s, "mean_score", 12)


@query("psr", "SELECT round((8.765985502558033 - 3.1769161463539324) * sqrt(4) / sqrt(1 + 1.3975992040382894 * 8.765985502558033 + (3.133205567209846 - 1) / 4 * 8.765985502558033 ** 2), 6) AS z")
def _(spark, sf):
    # A published case.
    one = spark.createDataFrame([(8.765985502558033, 5.0, -1.3975992040382894, 3.133205567209846, 3.1769161463539324)], "sr double, n double, skew double, kurt double, b double")
    return rounded(one.select(validation.psr_z(*(F.col(c) for c in ("sr", "n", "skew", "kurt", "b"))).alias("z")))


@query("dsr_trials")
def _(spark, sf):
    return validation.deflated_sharpe_of_trials(_trials(spark, sf))


@query("dsr_table")
def _(spark, sf):
    trials = _trials(spark, sf)
    one = validation.deflated_sharpe_of_trials(trials).withColumn("model", F.lit("rule"))
    other = validation.deflated_sharpe_of_trials(trials.withColumn("score", 1 - F.col("score")))
    return one.unionByName(other.withColumn("model", F.lit("against the rule")))


@query("inflation_factor")
def _(spark, sf):
    """Mean accuracy in naive folds less that in purged ones, of the same forest without weights."""
    d = _data(spark, sf)
    out = None
    for name, split in (("naive", validation.naive_kfold), ("purged", validation.purged_kfold)):
        found = models.out_of_sample(_forest(), d, FOLDS, weighted=False, folds=split(d.select("symbol", "t0", "t1"), FOLDS))
        part = validation.scores(found.withColumn("weight", F.lit(1.0)), ("fold",)).agg(F.avg("accuracy").alias(name))
        out = part if out is None else out.crossJoin(F.broadcast(part))  # one row each
    return out.withColumn("inflation", F.col("naive") - F.col("purged"))


@query("sharpe_distribution", TRIALS_SQL + " SELECT round(avg(mean_score), 6) AS mean, round(stddev_pop(mean_score), 6) AS std, round(min(mean_score), 6) AS low, round(max(mean_score), 6) AS high, count(*) FILTER (mean_score > 0) AS n_positive FROM st")
def _(spark, sf):
    s = validation.trial_stats(_trials(spark, sf))
    x = F.col("mean_score")
    return rounded(s.agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"), F.sum((x > 0).cast("int")).cast("long").alias("n_positive")))


@query("stage_summary")
def _(spark, sf):
    """Majority, untuned and tuned models (fixed values: the published parameters), and the forest without the
    features that every importance ranks last."""
    kept = validation.bottom_quartile(_ranked(spark, sf), KINDS).where("kept").collect()  # 15 at most
    columns = [c for c in features.CORE if c in {r["feature"] for r in kept}]
    base = _majority(spark, sf)
    out = base.select(F.lit("majority").alias("stage"), F.col("baseline").alias("mean_score"), F.lit(None).cast("double").alias("std_score"))
    for name in MODELS:
        out = out.unionByName(_fold_scores(spark, sf, name).withColumn("stage", F.lit(name)))
    out = out.unionByName(_fold_scores(spark, sf, "forest tuned", columns).withColumn("stage", F.lit("forest reduced")))
    return out.crossJoin(F.broadcast(base)).withColumn("beats_baseline", F.col("mean_score") > F.col("baseline"))  # one row


def _oos(spark, sf):
    return models.out_of_sample(_forest(), _data(spark, sf), FOLDS)


@query("oos_predictions")
def _(spark, sf):
    return _oos(spark, sf).select("symbol", "t0", "t1", "fold", "pred", "p", "side")


def _meta(spark, sf):
    return _meta_rows(_oos(spark, sf), labelled(spark, sf)[1])


def _meta_rows(oos, lab):
    meta = bets.meta_labels(oos.select("symbol", "t0", "side", "p"), lab).select("symbol", "t0", "meta_label")
    kept = oos.select("symbol", "t0", "t1", "weight", "side", *features.CORE)
    return models.dataset(kept.join(meta, ["symbol", "t0"]), [*features.CORE, "side"], "meta_label")


@query("meta_features")
def _(spark, sf):
    return _meta(spark, sf).select("symbol", "t0", *features.CORE, "side", "meta_label", "weight", "t1")


@query("oos_meta_predictions")
def _(spark, sf):
    rows = _meta(spark, sf).withColumnRenamed("side", "primary_side")
    return models.out_of_sample(_meta_forest(), rows, FOLDS, balanced=True).select("symbol", "t0", "fold", "p", "meta_label", "primary_side")


@query("cpcv_predictions")
def _(spark, sf):
    """Every combination of two test groups of six; the last split that tests a row gives its prediction."""
    d = _data(spark, sf)
    splits = validation.combinatorial_splits(d.select("symbol", "t0", "t1"), 6, 2).withColumnRenamed("split", "fold")
    found = models.out_of_sample(_forest(), d, 15, folds=splits)
    return found.groupBy("symbol", "t0").agg(F.max_by("p", "fold").alias("p"), F.count(F.lit(1)).alias("n_splits"))


@query("cpcv_paths")
def _(spark, sf):
    """Sharpe ratio of the chain from predictions over meta-model to backtest for each of several forest seeds."""
    d, (b, lab) = _data(spark, sf), labelled(spark, sf)
    out = None
    for seed in SEEDS:
        # Predictions are written, so that no seed's plan carries the models of those before.
        oos = models.out_of_sample(_forest(seed), d, 6)
        oos = materialize(oos.select("symbol", "t0", "t1", "weight", "side", "p", *features.CORE), "oos")
        rows = _meta_rows(oos, lab).withColumnRenamed("side", "primary_side")
        meta = models.out_of_sample(_meta_forest(seed), rows, FOLDS, balanced=True)
        meta = materialize(meta.select("symbol", "t0", "t1", F.col("primary_side").alias("side"), "p"), "meta")
        signals = bets.bet_signal(meta)
        run = bt.backtest(bets.daily_positions(bets.average_active(signals), b, 0.2), b)
        part = bt.sharpe(run).withColumn("seed", F.lit(seed))
        out = part if out is None else out.unionByName(part)
    return out


@query("synthetic_backtest")
def _(spark, sf):
    """Events to backtest on series with a planted trend and a planted return to the mean."""
    closes = src.trending(spark, ["trend"], 1500).union(src.mean_reverting(spark, ["revert"], 1500))
    b = closes.withColumnRenamed("close", "adj_close")
    vol = labels.backfilled(labels.daily_vol(b))
    picked = labels.event_targets(sampling.strided(b, 10).select("symbol", F.col("ts").alias("t0")), vol)
    lab = labels.label_bins(labels.triple_barrier(labels.vertical_barrier(picked, b), b), b).where("bin is not null")
    feats = features.volatility(features.momentum(b.withColumn("volume", F.lit(1.0)))).select("symbol", F.col("ts").alias("t0"), "ret_5d", "ret_20d", "vol_20d")
    rows = models.dataset(lab.join(feats, ["symbol", "t0"]).na.drop(subset=["ret_5d", "ret_20d", "vol_20d"]).withColumn("weight", F.lit(1.0)), ["ret_5d", "ret_20d", "vol_20d"], "bin")
    parts = validation.numbered(rows).withColumn("train", F.col("pos") < F.floor(0.8 * F.col("n")))
    out = models.predict(models.fit(models.forest(100, 3, 1), parts.where("train")), parts.where("not train"))
    signal = out.select("symbol", F.col("t0").alias("ts"), F.signum(2 * F.col("p") - 1).alias("signal"))
    return bt.sharpe(bt.backtest(bets.daily_positions(signal, b), b))
