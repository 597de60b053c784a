"""Ensembles on purged folds: fitting, scoring, search and feature importance with Spark ML.

Folds are a role table, so a fold is a semi-join; fits of different folds, trials or features are
independent jobs and run from a small thread pool, so that the scheduler fills the cluster with them.
Out-of-sample models of tables that a task can hold are fitted in one task a fold (``trees``), by the same rules.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import materialize
from . import trees
from .validation import purged_kfold, scores

JOBS = 4
TASK_ROWS = 50_000  # of a table whose models are fitted in one task each; larger ones go to Spark ML, whole


def forest(trees: int = 500, depth: int = 5, leaf: int = 10, features: str = "sqrt", seed: int = 42) -> Callable:
    return lambda: RandomForestClassifier(
        numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy=features, seed=seed, weightCol="fit_weight"
    )


def boosted(rounds: int = 500, depth: int = 3, rate: float = 0.05, sample: float = 0.8, features: str = "0.8", seed: int = 42) -> Callable:
    return lambda: GBTClassifier(
        maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=sample, featureSubsetStrategy=features, seed=seed, weightCol="fit_weight"
    )


def dataset(matrix: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """Rows with ``features``, a class from 0 (of -1 and 1, or 0 and 1), weight and t1."""
    rows = matrix.withColumns({"y": F.when(F.col(label) > 0, 1).otherwise(-1), "class": (F.col(label) > 0).cast("double")})
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(rows)


def fit(make: Callable, rows: DataFrame, weighted: bool = True, balanced: bool = False):
    """Fit on all rows; ``balanced`` weighs classes by n / (classes * count) of these rows."""
    weight = F.col("weight") if weighted else F.lit(1.0)
    if balanced:
        counts = {r["class"]: r["count"] for r in rows.groupBy("class").count().collect()}  # a row per class
        total = sum(counts.values())
        factor = F.lit(0.0)
        for c, k in counts.items():
            factor = F.when(F.col("class") == c, total / (len(counts) * k)).otherwise(factor)
        weight = weight * factor
    return make().setLabelCol("class").fit(rows.withColumn("fit_weight", weight))


def predict(model, rows: DataFrame) -> DataFrame:
    """pred (-1 or 1), p and side = sign(2 p - 1), 0 counting as 1."""
    return _sided(model.transform(rows).withColumn("p", vector_to_array("probability")[1]))


def _sided(out: DataFrame) -> DataFrame:
    return out.withColumns({"pred": F.when(F.col("p") > 0.5, 1).otherwise(-1), "side": F.when(F.col("p") >= 0.5, 1.0).otherwise(-1.0)})


def fold_parts(rows: DataFrame, folds: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    own = folds.where(F.col("fold") == fold)
    keys = ["symbol", "t0"]
    return tuple(rows.join(own.where(F.col("role") == r).select(*keys), keys, "left_semi") for r in ("train", "test"))


def out_of_sample(make: Callable, rows: DataFrame, k: int = 5, weighted: bool = True, balanced: bool = False, folds: DataFrame | None = None) -> DataFrame:
    """Every row predicted once, by the model of the fold it is tested in."""
    folds = folds if folds is not None else purged_kfold(rows.select("symbol", "t0", "t1"), k)
    if _in_a_task(rows):
        return _in_tasks(make, rows, k, weighted, balanced, folds)

    def one(fold: int) -> DataFrame:
        train, test = fold_parts(rows, folds, fold)
        return predict(fit(make, train, weighted, balanced), test).withColumn("fold", F.lit(fold))

    if _in_a_task(rows):
        found = scores(_in_tasks(make, rows, k, True, False, folds, seed), ("feature", "fold"))
        out = materialize(found.select("feature", F.col("neg_log_loss").alias("score"), "fold"), "shuffled")
    else:
        with ThreadPoolExecutor(JOBS) as pool:
            out = reduce(DataFrame.unionByName, pool.map(one, range(k)))
    return out


def _in_a_task(rows: DataFrame) -> bool:
    return rows.limit(TASK_ROWS + 1).count() <= TASK_ROWS


def _in_tasks(make: Callable, rows: DataFrame, k: int, weighted: bool, balanced: bool, folds: DataFrame, shuffled: int | None = None) -> DataFrame:
    """The same, a task fitting the model of a fold and predicting its test rows; the predictions are written.

    A seed in ``shuffled`` adds the predictions with each column shuffled, by number in ``feature`` (-1: none is).
    """
    given = trees.settings_of(make())
    weight = F.col("weight") if weighted else F.lit(1.0)
    own = rows.select("symbol", "t0", F.col("class").cast("double"), weight.cast("double").alias("w"), vector_to_array("features").alias("x"))
    parts = folds.where(F.col("role").isin("train", "test") & (F.col("fold") < k)).select("fold", "role", "symbol", "t0")

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("symbol", "ascending"), ("t0", "ascending")])  # so no partitioning changes a model
        test = pc.equal(table["role"], "test")
        asked, used = table.filter(test), table.filter(pc.invert(test))
        if len(asked):
            x, z = (np.array(t["x"].to_pylist(), float).reshape(len(t), -1) for t in (used, asked))
            c, w = used["class"].to_numpy(), used["w"].to_numpy()
            if balanced:
                n = np.bincount(c.astype(int))
                w = w * (len(c) / (np.count_nonzero(n) * n))[c.astype(int)]
            which, asked_x = [-1], [z]
            if shuffled is not None:
                order = np.random.default_rng(shuffled).permutation(len(z))
                for j in range(z.shape[1]):
                    which.append(j)
                    asked_x.append(z.copy())
                    asked_x[-1][:, j] = z[order, j]
            p, n = trees.probabilities(x, c, w, np.concatenate(asked_x), given), len(which)
        else:
            p, which, n = np.zeros(0), [], 0
        keys = asked.select(["fold", "symbol", "t0"])
        keys = pa.concat_tables([keys] * n) if n else keys
        return keys.append_column("feature", pa.array(np.repeat(which, len(asked)), pa.int32())).append_column("p", pa.array(p, pa.float64()))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    shape = f"fold {parts.schema['fold'].dataType.simpleString()}, symbol {kinds['symbol']}, t0 {kinds['t0']}, feature int, p double"
    found = parts.join(own, ["symbol", "t0"]).repartition(k, "fold").groupBy("fold").applyInArrow(build, shape)
    found = materialize(found.withColumn("fold", F.col("fold").cast("int")), "predictions")
    return _sided(rows.join(found if shuffled is not None else found.drop("feature"), ["symbol", "t0"]))


def written_folds(rows: DataFrame, k: int) -> DataFrame:
    """The purged folds of the rows as a table, for many fits on the same rows."""
    return materialize(purged_kfold(rows.select("symbol", "t0", "t1"), k), "folds")


def cv_score(
    make: Callable, rows: DataFrame, k: int = 5, fit_weights: bool = True, score_weights: bool = True, balanced: bool = False, folds: DataFrame | None = None
) -> DataFrame:
    """Scores per fold."""
    found = out_of_sample(make, rows, k, fit_weights, balanced, folds)
    found = found if score_weights else found.withColumn("weight", F.lit(1.0))
    return scores(found, ("fold",))


def four_ways(make: Callable, rows: DataFrame, k: int = 5) -> DataFrame:
    out, folds = None, written_folds(rows, k)
    for a, b in product((True, False), repeat=2):
        part = cv_score(make, rows, k, a, b, folds=folds).select("fold", "accuracy", F.lit(a).alias("fit_weighted"), F.lit(b).alias("score_weighted"))
        out = part if out is None else out.unionByName(part)
    return out


def train_and_evaluate(make: Callable, rows: DataFrame, k: int = 5):
    """The model of all rows, and one row of mean and deviation of its fold scores."""
    s = cv_score(make, rows, k)
    return fit(make, rows), s.agg(F.avg("accuracy").alias("mean_score"), F.stddev_samp("accuracy").alias("std_score"))


def search(family: Callable, rows: DataFrame, grid: Sequence[dict], k: int = 5) -> DataFrame:
    """trial, params, fold, score of each parameter set; ``balanced`` in a set goes to the fit."""
    spark, folds = rows.sparkSession, written_folds(rows, k)

    def one(numbered: tuple[int, dict]) -> DataFrame:
        trial, params = numbered
        named = spark.createDataFrame([(trial, {a: str(b) for a, b in params.items()})], "trial int, params map<string,string>")
        own = {a: b for a, b in params.items() if a != "balanced"}
        found = cv_score(family(**own), rows, k, balanced=params.get("balanced", False), folds=folds)
        # A row per fold: written, so that the trial's models can be let go.
        return materialize(found.select("fold", F.col("accuracy").alias("score")).crossJoin(F.broadcast(named)), "trial")  # one row

    with ThreadPoolExecutor(JOBS) as pool:
        parts = list(pool.map(one, enumerate(grid)))
    return reduce(DataFrame.unionByName, parts)


def grid_of(space: dict[str, Sequence]) -> list[dict]:
    return [dict(zip(space, values, strict=True)) for values in product(*space.values())]


def random_grid(space: dict[str, Sequence], n: int, seed: int = 42) -> list[dict]:
    """n different points of the grid."""
    every = grid_of(space)
    return random.Random(seed).sample(every, min(n, len(every)))


def trial_log(trials: DataFrame) -> DataFrame:
    """A row per trial, a column per parameter and fold."""
    names = sorted(r[0] for r in trials.select(F.explode(F.map_keys("params"))).distinct().collect())
    folds = sorted(r[0] for r in trials.select("fold").distinct().collect())
    wide = trials.groupBy("trial").agg(
        *[F.first(F.col("params")[n]).alias(f"param_{n}") for n in names],
        *[F.max(F.when(F.col("fold") == f, F.col("score"))).alias(f"fold_{f + 1}") for f in folds],
        F.avg("score").alias("mean_score"), F.stddev_samp("score").alias("std_score"),
    )
    return wide.withColumn("sr_trial", F.when(F.col("std_score") > 0, F.col("mean_score") / F.col("std_score")))


def mdi(model, columns: Sequence[str], spark) -> DataFrame:
    """Mean decrease of impurity: trees' importances, each summing to 1, with the error of their mean."""
    rows = []
    for t, tree in enumerate(model.trees):
        x = tree.featureImportances.toArray()
        total = x.sum()
        rows += [(t, c, float(v / total) if total else 0.0) for c, v in zip(columns, x, strict=True)]
    table = spark.createDataFrame(rows, "tree int, feature string, value double")
    return table.groupBy("feature").agg(F.avg("value").alias("mean"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("std"))


def mda(make: Callable, rows: DataFrame, columns: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Mean decrease of accuracy (log loss) when one test column is shuffled; all columns in one pass a fold."""
    folds = written_folds(rows, k)
    plain = [c for c in rows.columns if c != "features"]
    w = W.partitionBy()

    def one(fold: int) -> DataFrame:
        train, test = fold_parts(rows, folds, fold)
        model = fit(make, train)
        test = test.select(*plain)
        values = F.array(*columns)
        # Places and shuffled places within the test fold.
        test = test.withColumn("i", F.row_number().over(w.orderBy("symbol", "t0"))).withColumn("u", F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), "i"))))
        other = test.select(F.col("u").alias("i"), values.alias("shuffled"))
        both = test.withColumn("own", values).join(other, "i")
        which = F.explode(F.sequence(F.lit(-1), F.lit(len(columns) - 1))).alias("feature")
        long = both.select("*", which)
        for n, c in enumerate(columns):
            long = long.withColumn(c, F.when(F.col("feature") == n, F.col("shuffled")[n]).otherwise(F.col("own")[n]))
        long = VectorAssembler(inputCols=list(columns), outputCol="features").transform(long)
        return scores(predict(model, long), ("feature",)).select("feature", F.col("neg_log_loss").alias("score"), F.lit(fold).alias("fold"))

    if _in_a_task(rows):
        found = scores(_in_tasks(make, rows, k, True, False, folds, seed), ("feature", "fold"))
        out = materialize(found.select("feature", F.col("neg_log_loss").alias("score"), "fold"), "shuffled")
    else:
        with ThreadPoolExecutor(JOBS) as pool:
            out = reduce(DataFrame.unionByName, pool.map(one, range(k)))
    base = out.where("feature = -1").select("fold", F.col("score").alias("base"))
    loss = out.where("feature >= 0").join(base, "fold").withColumn("loss", F.col("base") - F.col("score"))
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("feature") + 1)
    return loss.groupBy(names.alias("feature")).agg(F.avg("loss").alias("mean"), (F.stddev_samp("loss") / F.sqrt(F.count("loss"))).alias("std"))


def sfi(make: Callable, matrix: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """Single feature importance: the score of a model of each column alone."""
    folds = written_folds(matrix, k)

    def one(c: str) -> DataFrame:
        s = cv_score(make, dataset(matrix, [c]), k, folds=folds)
        error = F.stddev_samp("neg_log_loss") / F.sqrt(F.count("fold"))
        return materialize(s.agg(F.avg("neg_log_loss").alias("mean"), error.alias("std")).select(F.lit(c).alias("feature"), "mean", "std"), "sfi")

    with ThreadPoolExecutor(JOBS) as pool:
        parts = list(pool.map(one, columns))
    return reduce(DataFrame.unionByName, parts)


def importance_table(**tables: DataFrame) -> DataFrame:
    out = None
    for kind, t in tables.items():
        named = t.select("feature", F.col("mean").alias(f"{kind}_mean"), F.col("std").alias(f"{kind}_std"))
        out = named if out is None else out.join(named, "feature", "full_outer")
    return out
