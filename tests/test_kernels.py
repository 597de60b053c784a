"""Closed-form cases of the kernels, and properties of the operators on small series."""

import math
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.numeric import half_even, normal_cdf
from tidemark.operators import backtest, bets, features, fracdiff, labels, sampling, validation, weights

DAY = datetime(2020, 1, 1)


def series(spark, prices, symbol="A"):
    rows = [(symbol, DAY + timedelta(days=i), p, p * 1.01, p * 0.99, p, p, 100.0 + i) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, adj_close double, volume double")


def wave(n, step=0.7):
    return [100 + 10 * math.sin(step * i) + i * 0.1 for i in range(n)]


def test_lempel_ziv_cases():
    assert features.lz_phrases([0, 0, 1, 0]) == 3
    assert features.lz_phrases([0] * 32) == 2
    assert features.lz_phrases([0, 1] * 16) == 3
    assert features.lz_phrases([]) == 0 and features.lz_phrases([1]) == 1


@given(st.lists(st.integers(0, 1), min_size=1, max_size=40))
@settings(max_examples=60, deadline=None)
def test_lempel_ziv_bounds(bits):
    assert 1 <= features.lz_phrases(bits) <= len(bits)


def test_ffd_weights():
    assert fracdiff.ffd_weights(0.0) == [1.0]
    assert fracdiff.ffd_weights(1.0) == [1.0, -1.0]
    assert len(fracdiff.ffd_weights(0.25, 1e-5)) == 2804


def test_cusum_resets():
    assert sampling._cusum_places([0.5, 0.0, -0.6, 0.1], [0.0] * 4, 0.2) == [0, 2]
    assert sampling._cusum_places([], [], 0.1) == []


def test_expected_maximum_grows():
    values = [validation.expected_maximum(1.0, n) for n in (2, 10, 100)]
    assert values == sorted(values)


def test_published_psr(spark):
    rows = [(8.765985502558033, 5.0, -1.3975992040382894, 3.133205567209846, 3.1769161463539324, 0.93548034255394),
            (8.05139304319565, 5.0, -0.8999704307275389, 2.629551890938731, 6.843454187445143, 0.65923859528356)]
    df = spark.createDataFrame(rows, "sr double, n double, g double, k double, b double, want double")
    p = validation.probabilistic_sharpe(*(F.col(c) for c in ("sr", "n", "g", "k", "b")))
    assert all(abs(r["p"] - r["want"]) < 1e-6 for r in df.withColumn("p", p).collect())


def test_adf_p_values(spark):
    df = spark.createDataFrame([(-3.43,), (-2.862,), (-2.567,)], "t double")
    got = [r["p"] for r in df.select(fracdiff.mackinnon_p(F.col("t")).alias("p")).collect()]
    assert got == pytest.approx([0.01, 0.05, 0.10], abs=2e-4)


def test_bets(spark):
    rows = [("A", DAY, 1.0, 0.5), ("A", DAY, 1.0, 1.0), ("A", DAY, -1.0, 1.0), ("A", DAY, 1.0, 0.2)]
    out = [r["signal"] for r in bets.bet_signal(spark.createDataFrame(rows, "symbol string, t0 timestamp, side double, p double")).collect()]
    assert out[0] == pytest.approx(0, abs=1e-6) and out[1] == pytest.approx(1) and out[2] == pytest.approx(-1) and out[3] < 0
    steps = spark.createDataFrame([(0.1,), (0.3,), (0.5,), (-0.1,)], "x double").select(half_even(F.col("x"), 0.2).alias("x"))
    assert [round(r["x"], 6) for r in steps.collect()][2] == 0.4
    p = spark.createDataFrame([(0.0,), (1.96,)], "x double").select(normal_cdf(F.col("x")).alias("p")).collect()
    assert p[0]["p"] == pytest.approx(0.5, abs=1e-6) and p[1]["p"] == pytest.approx(0.975, abs=1e-4)


def test_backtest_by_hand(spark):
    b = series(spark, [100.0, 110.0, 99.0])
    pos = spark.createDataFrame([("A", DAY + timedelta(days=i), float(v)) for i, v in enumerate((1, 1, 0))], "symbol string, ts timestamp, position double")
    out = backtest.backtest(pos, b).orderBy("ts").collect()
    assert [round(r["gross_return"], 10) for r in out] == [0, 0.1, -0.1]
    assert [r["cost"] for r in out] == [0, 0, 0.0005]
    assert all(0 <= r["drawdown"] < 1 for r in out)


def test_weights_by_hand(spark):
    rows = [("A", DAY + timedelta(days=i), r) for i, r in enumerate((1.0, -1.0, 2.0))]
    lab = spark.createDataFrame(rows, "symbol string, t0 timestamp, ret double")
    assert [r["attribution"] for r in weights.return_attribution(lab).orderBy("t0").collect()] == [0.75, 0.75, 1.5]
    assert [r["decay"] for r in weights.time_decay(lab).orderBy("t0").collect()] == pytest.approx([2 / 3, 1, 4 / 3])


def test_labels_hold_their_rules(spark):
    b = series(spark, wave(120))
    picked = sampling.strided(b, 7, 5).select("symbol", F.col("ts").alias("t0")).withColumn("trgt", F.lit(0.05))
    e = labels.vertical_barrier(picked, b, 10)
    out = labels.label_bins(labels.triple_barrier(e, b), b).collect()
    assert len(out) == picked.count()
    for r in out:
        if r["t1"] is None:
            assert r["ret"] is None and r["bin"] is None
            continue
        assert r["t_exit"] <= r["t1"] and r["bin"] in (-1, 0, 1)
        assert r["t_exit"] != r["pt"] or r["ret"] > 0
        assert r["t_exit"] != r["sl"] or r["ret"] < 0
    u = weights.uniqueness(e, b).where("uniqueness is not null").collect()
    assert all(0 < r["uniqueness"] <= 1 for r in u)


def test_folds(spark):
    rows = [("A", DAY + timedelta(days=i), DAY + timedelta(days=i + 3)) for i in range(50)]
    df = spark.createDataFrame(rows, "symbol string, t0 timestamp, t1 timestamp")
    k = validation.purged_kfold(df, 5).collect()
    assert sorted(r["pos"] for r in k if r["role"] == "test") == list(range(50))
    starts = {f: min(r["t0"] for r in k if r["fold"] == f and r["role"] == "test") for f in range(5)}
    for r in k:
        if r["role"] == "train" and r["t0"] < starts[r["fold"]]:
            assert r["t0"] + timedelta(days=3) < starts[r["fold"]]
    assert not any(r["role"] == "embargo" for r in k)  # int(50 * .01) rows
    c = validation.combinatorial_splits(df, 6, 2)
    assert c.select("split").distinct().count() == 15
    assert c.where("role = 'embargo'").count() > 0  # one row at least


def test_order_of_input_does_not_matter(spark):
    b = series(spark, wave(60))
    one = sampling.cusum_events(b, 0.02).collect()
    assert sorted(one) == sorted(sampling.cusum_events(b.repartition(7), 0.02).collect()) and one


def test_empty_series(spark):
    b = series(spark, [1.0]).limit(0)
    assert sampling.clean_bars(b).collect() == [] and sampling.cusum_events(b, 0.1).collect() == []
    assert backtest.buy_and_hold(b).collect() == []


def test_cusum_stream(spark, tmp_path):
    from tidemark.streaming.online import OUT, cusum_stream

    b = series(spark, wave(80)).select("symbol", "ts", F.col("adj_close").alias("price"))
    b.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(b.schema).parquet(str(tmp_path / "in"))
    q = cusum_stream(stream, 0.02).writeStream.format("memory").queryName("hits").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = [r["t0"] for r in spark.sql("select * from hits order by t0").collect()]
    assert got == [r["t0"] for r in sampling.cusum_events(b.withColumnRenamed("price", "adj_close"), 0.02).orderBy("t0").collect()]
    assert "direction" in OUT


def test_differencing_queries_keep_the_long_memory(spark, monkeypatch):
    from tidemark.plans import learning

    assert len(fracdiff.ffd_weights(learning.ORDER, learning.THRESHOLD)) == 1458
    walk = series(spark, wave(5000)).select("symbol", "ts", F.ln("adj_close").alias("x"))
    monkeypatch.setattr(learning, "_logs", lambda spark, sf: walk)
    assert sorted(r["d"] for r in learning._sweep(spark, None).collect()) == [round(i / 20, 2) for i in range(21)]


def test_model_queries_take_the_whole_job(monkeypatch):
    from tidemark.plans import base, learning

    class Seen(Exception):
        pass

    def seen(*args, **named):
        raise Seen(args)

    monkeypatch.setattr(base, "ship", lambda spark: None)
    monkeypatch.setattr(learning, "_matrix", lambda spark, sf: None)
    monkeypatch.setattr(learning.models, "dataset", lambda matrix, columns, label="label": tuple(columns))
    for f in ("sfi", "mda", "search", "out_of_sample"):
        monkeypatch.setattr(learning.models, f, seen)
    args = {}
    for name in ("sfi", "mda", "random_search", "oos_predictions"):
        with pytest.raises(Seen) as e:
            base.QUERIES[name](None, None)
        args[name] = e.value.args[0]
    assert args["sfi"][2:] == args["mda"][2:] == (features.CORE, 5) and len(features.CORE) == 15
    assert args["mda"][1] == args["oos_predictions"][1] == args["random_search"][1] == features.CORE
    assert args["oos_predictions"][2] == args["random_search"][3] == 5 and len(args["random_search"][2]) == 25
