"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
NAMES = ("log_return", "cusum_filter", "dollar_bars", "rsi_14", "roll_spread", "triple_barrier", "concurrency", "avg_uniqueness",
         "purged_kfold", "cpcv_split", "daily_positions", "backtest", "dd_tuw", "data_quality", "sink_parquet", "sink_csv", "sink_json",
         "log_trials", "evaluate_params", "tuning_pivot", "histogram_inter_event", "histogram_signal", "histogram_bet_size")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def value(v):
    if isinstance(v, float):
        return float(f"{round(v, 5):.9g}") + 0.0
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(value(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(value(r[c]) for c in cols) for r in df.collect()), key=repr) == want


def test_line_items_are_read_once_for_events(spark):
    import __spark_entry__ as entry

    for name in ("sample_weight", "dd_tuw", "backtest", "concurrency"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_extendedprice" not in plan, name  # the bars are a table by then


def test_registry_without_a_session_and_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['tidemark.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(__file__)))
    assert out.returncode == 0 and int(out.stdout) > 100
