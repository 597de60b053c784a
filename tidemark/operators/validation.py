"""Folds, scores of predictions, and the algebra of trials."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import normal_cdf


def numbered(rows: DataFrame) -> DataFrame:
    """pos (from 0) and n of each row of its series, in order of t0."""
    w = W.partitionBy("symbol")
    return rows.withColumns({"pos": (F.row_number().over(w.orderBy("t0")) - 1).cast("long"), "n": F.count(F.lit(1)).over(w)})


def groups(rows: DataFrame, k: int) -> DataFrame:
    """Contiguous groups of as equal size as can be, the first ones larger: ``fold`` from 0."""
    return numbered(rows).withColumn("fold", F.ntile(k).over(W.partitionBy("symbol").orderBy("t0")) - 1)


def _bounds(parts: DataFrame) -> DataFrame:
    return parts.groupBy("symbol", "fold").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.min("t0").alias("test_start"))


def purged_kfold(rows: DataFrame, k: int = 5, embargo: float = 0.01) -> DataFrame:
    """symbol, fold, t0, pos, role. Rows before the test go if their label reaches into it; rows after it
    if they lie in the embargo (int(n * embargo) rows)."""
    parts = groups(rows, k)
    test = _bounds(parts).withColumnRenamed("fold", "test_fold")  # k rows a series
    gap = F.floor(F.col("n") * embargo)
    role = (
        F.when(F.col("pos").between(F.col("first"), F.col("last")), "test")
        .when((F.col("pos") < F.col("first")) & (F.col("t1") >= F.col("test_start")), "purged")
        .when((F.col("pos") > F.col("last")) & (F.col("pos") <= F.col("last") + gap), "embargo")
        .otherwise("train")
    )
    return parts.join(test, "symbol").select("symbol", F.col("test_fold").cast("long").alias("fold"), "t0", "pos", role.alias("role"))


def naive_kfold(rows: DataFrame, k: int = 5) -> DataFrame:
    parts = groups(rows, k)
    test = parts.select("symbol", F.col("fold").alias("test_fold")).distinct()
    role = F.when(F.col("fold") == F.col("test_fold"), "test").otherwise("train")
    return parts.join(test, "symbol").select("symbol", F.col("test_fold").cast("long").alias("fold"), "t0", "pos", role.alias("role"))


def combinatorial_splits(rows: DataFrame, k: int = 6, p: int = 2, embargo: float = 0.01) -> DataFrame:
    """symbol, split, t0, pos, role: every choice of p test groups; rows between test groups stay in train."""
    parts = groups(rows, k)
    chosen = [(i, g) for i, c in enumerate(combinations(range(k), p)) for g in c]
    choice = rows.sparkSession.createDataFrame(chosen, "split int, fold int")
    ends = _bounds(parts).join(F.broadcast(choice), "fold")  # of fixed size
    ends = ends.groupBy("symbol", "split").agg(
        F.collect_set("fold").alias("tests"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("test_start").alias("test_start")
    )
    gap = F.greatest(F.lit(1), F.floor(F.col("n") * embargo))
    role = (
        F.when(F.array_contains("tests", F.col("fold")), "test")
        .when((F.col("pos") < F.col("first")) & (F.col("t1") >= F.col("test_start")), "purged")
        .when((F.col("pos") > F.col("last")) & (F.col("pos") <= F.col("last") + gap), "embargo")
        .otherwise("train")
    )
    return parts.join(ends, "symbol").select("symbol", F.col("split").cast("long").alias("split"), "t0", "pos", role.alias("role"))


def composition(splits: DataFrame, by: str = "fold") -> DataFrame:
    n = lambda r: F.sum(F.when(F.col("role") == r, 1).otherwise(0)).cast("long")
    missing = F.sum(F.when(F.col("role").isin("purged", "embargo"), 1).otherwise(0)).cast("long")
    return splits.groupBy("symbol", by).agg(n("train").alias("n_train"), n("test").alias("n_test"), missing.alias("n_missing"))


def scores(predictions: DataFrame, by: tuple[str, ...] = ("symbol", "fold")) -> DataFrame:
    """Weighted accuracy, negative log loss, precision, recall and F1 of (y, pred, p, weight); 0 for 0/0."""
    w, y, pred = F.col("weight"), F.col("y"), F.col("pred")
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("p")))
    s = lambda c: F.sum(F.when(c, w).otherwise(0.0))
    tp, fp, fn = s((y == 1) & (pred == 1)), s((y != 1) & (pred == 1)), s((y == 1) & (pred != 1))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return predictions.groupBy(*by).agg(
        (s(y == pred) / F.sum(w)).alias("accuracy"),
        (F.sum(w * F.ln(F.when(y == 1, p).otherwise(1 - p))) / F.sum(w)).alias("neg_log_loss"),
        zero(tp, tp + fp).alias("precision"),
        zero(tp, tp + fn).alias("recall"),
        zero(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def confusion(predictions: DataFrame) -> DataFrame:
    """A row per true class (-1, 1), a column per predicted class."""
    n = lambda v: F.sum(F.when(F.col("pred") == v, 1).otherwise(0)).cast("long")
    return predictions.groupBy("symbol", "y").agg(n(-1).alias("pred_down"), n(1).alias("pred_up"))


def majority_baseline(rows: DataFrame, label: str = "label") -> DataFrame:
    counts = rows.groupBy("symbol", label).count()
    return counts.groupBy("symbol").agg((F.max("count") / F.sum("count")).alias("baseline"))


def representative_fold(fold_scores: DataFrame) -> DataFrame:
    """The fold whose score is nearest to the mean, ties to the first."""
    w = W.partitionBy("symbol")
    away = F.abs(F.col("score") - F.avg("score").over(w))
    return fold_scores.withColumn("away", away).groupBy("symbol").agg(F.min_by("fold", F.struct(F.round("away", 12), "fold")).alias("fold"))


def trial_stats(trials: DataFrame) -> DataFrame:
    """trial, mean, std, sr_trial of (trial, fold, score)."""
    mean, std = F.avg("score"), F.stddev_samp("score")
    return trials.groupBy("trial").agg(mean.alias("mean_score"), std.alias("std_score"), F.when(std > 0, mean / std).alias("sr_trial"))


def best_trial(stats: DataFrame) -> DataFrame:
    """The first trial of the largest mean."""
    return stats.agg(F.min_by(F.struct(*stats.columns), F.struct(-F.col("mean_score"), "trial")).alias("b")).select("b.*")


def expected_maximum(variance: float, n: int) -> float:
    """Expected largest of n Sharpe ratios of no skill."""
    from math import e, sqrt
    from statistics import NormalDist

    gamma, q = 0.5772156649015329, NormalDist().inv_cdf
    n = max(2, n)
    return sqrt(variance) * ((1 - gamma) * q(1 - 1 / n) + gamma * q(1 - 1 / (n * e)))


def psr_z(sr, n, skew, kurt, benchmark):
    """The argument of the normal distribution in the probabilistic Sharpe ratio, of columns."""
    spread = F.greatest(F.lit(1e-12), 1 - skew * sr + (kurt - 1) / 4 * sr * sr)
    return (sr - benchmark) * F.sqrt(F.greatest(F.lit(1.0), n - 1)) / F.sqrt(spread)


def probabilistic_sharpe(sr, n, skew, kurt, benchmark):
    return normal_cdf(psr_z(sr, n, skew, kurt, benchmark))


def deflated_sharpe_of_trials(trials: DataFrame) -> DataFrame:
    """One row: the best trial's Sharpe ratio, the maximum expected by chance, z and the deflated ratio."""
    k = F.count("score").cast("double")
    per = trials.groupBy("trial").agg(
        F.avg("score").alias("mean"), F.coalesce(F.try_divide(F.avg("score"), F.stddev_samp("score")), F.lit(0.0)).alias("sr"),
        F.when(k >= 3, F.skewness("score")).otherwise(0.0).alias("skew"), F.when(k >= 3, F.kurtosis("score") + 3).otherwise(3.0).alias("kurt"), k.alias("n"),
    )
    one = per.agg(
        F.min_by(F.struct("sr", "skew", "kurt", "n"), F.struct(-F.col("mean"), "trial")).alias("b"),
        F.coalesce(F.var_samp("sr"), F.lit(0.0)).alias("var"), F.count(F.lit(1)).alias("trials"),
    )

    @F.pandas_udf("double")
    def chance(var, n):
        import pandas as pd

        return pd.Series([expected_maximum(v, int(m)) for v, m in zip(var, n, strict=True)])

    one = one.withColumn("sr_chance", chance("var", "trials"))
    z = psr_z(F.col("b.sr"), F.col("b.n"), F.col("b.skew"), F.col("b.kurt"), F.col("sr_chance"))
    return one.select(F.col("b.sr").alias("sr_best"), "sr_chance", z.alias("z"), normal_cdf(z).alias("dsr"))


def ranks(table: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Ranks (1 is best, ties share the mean rank cut to a whole number) and their mean, of wide (feature, *kinds)."""
    for c in kinds:
        w = W.orderBy(F.col(c).desc())  # a row per feature
        same = W.partitionBy(c)
        table = table.withColumn(f"{c}_rank", F.floor(F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2).cast("long"))
    return table.withColumn("avg_rank", sum(F.col(f"{c}_rank") for c in kinds) / len(kinds))


def bottom_quartile(ranked: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """kept: false only for features in the last quarter of every ranking."""
    n = F.count(F.lit(1)).over(W.partitionBy())  # a row per feature
    last = n - F.ceil(n * 0.25) + 1
    low = F.lit(True)
    for c in kinds:
        low = low & (F.col(f"{c}_rank") >= last)
    return ranked.withColumn("kept", ~low)
