"""Models fitted in tasks: Spark ML's own results where nothing is random, all rows, and no job a round."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models, trees
from tidemark.runtime import ship


@pytest.fixture(scope="module")
def rows(spark):
    ship(spark)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(160, 3))
    said = np.where(x[:, 0] + 0.5 * x[:, 1] * x[:, 2] + 0.6 * rng.normal(size=160) > 0, 1, -1)
    day = lambda i: dt.datetime(2020, 1, 1) + dt.timedelta(days=int(i))
    data = [(f"s{i % 2}", day(i), day(i + 3), float(0.5 + rng.random()), int(said[i]), *map(float, x[i])) for i in range(160)]
    matrix = spark.createDataFrame(data, "symbol string, t0 timestamp, t1 timestamp, weight double, label int, a double, b double, c double")
    return models.dataset(matrix, ["a", "b", "c"]).cache()


def _both(monkeypatch, make, rows):
    out = []
    for bound in (models.TASK_ROWS, 0):
        monkeypatch.setattr(models, "TASK_ROWS", bound)
        found = models.out_of_sample(make, rows, 4)
        out.append({(r["symbol"], r["t0"], r["fold"]): r["p"] for r in found.collect()})
    return out


def test_boosted_trees_are_those_of_spark(spark, rows, monkeypatch):
    # Depth 2: in small nodes several splits are equal but for rounding, and either may be taken.
    here, there = _both(monkeypatch, models.boosted(12, 2, 0.1, 1.0, "all"), rows)
    assert here.keys() == there.keys() and len(here) == 160
    assert max(abs(here[k] - there[k]) for k in here) < 1e-6


def test_forest_is_near_that_of_spark(spark, rows, monkeypatch):
    here, there = _both(monkeypatch, models.forest(150, 4, 5), rows)
    assert here.keys() == there.keys() and len(here) == 160
    away = [here[k] - there[k] for k in here]  # random numbers differ
    assert abs(np.mean(away)) < 0.02 and np.mean(np.abs(away)) < 0.05


def test_rounds_are_no_jobs(spark, rows):
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    assert models.cv_score(models.boosted(200), rows, 4).count() == 4
    assert len(tracker.getJobIdsForGroup(None)) - before < 60


def test_shuffled_columns_lose_accuracy_where_they_matter(spark, rows, monkeypatch):
    for bound in (models.TASK_ROWS, 0):
        monkeypatch.setattr(models, "TASK_ROWS", bound)
        found = {r["feature"]: r["mean"] for r in models.mda(models.forest(50, 4, 5), rows, ["a", "b", "c"], 4).collect()}
        assert set(found) == {"a", "b", "c"} and found["a"] > 0.02 and found["a"] == max(found.values())


def test_balanced_classes_weigh_the_same(spark, rows, monkeypatch):
    few = rows.where((F.col("class") == 1) | (F.dayofmonth("t0") % 3 == 0))
    plain, balanced = (models.out_of_sample(models.forest(60, 3, 5), few, 4, balanced=b).agg(F.avg("p")).first()[0] for b in (False, True))
    assert abs(balanced - 0.5) < abs(plain - 0.5)


def test_split_points_follow_weights_and_a_constant_column_has_none():
    assert trees.split_points(np.full(9, 2.0), np.ones(9), 32).tolist() == []
    assert trees.split_points(np.arange(5.0), np.ones(5), 32).tolist() == [0.5, 1.5, 2.5, 3.5]
    assert len(trees.split_points(np.arange(1000.0), np.ones(1000), 32)) == 31
