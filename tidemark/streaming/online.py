"""Online forms of the accumulators: the symmetric filter and ticks to dollar bars, with state per series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "symbol string, t0 timestamp, direction int"
STATE = "last double, n long, total double, up double, down double"


def cusum_stream(ticks: DataFrame, h: float, delay: str = "1 day") -> DataFrame:
    """Events (symbol, t0, direction) of a stream of (symbol, ts, price); rows of a batch are taken in order."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        import math

        last, n, total, up, down = state.get if state.exists else (None, 0, 0.0, 0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for ts, price in zip(rows["ts"], rows["price"], strict=True):
            if last is not None and price > 0:
                y = math.log(price / last)
                n, total = n + 1, total + y
                drift = total / n
                up, down = max(0.0, up + y - drift - h), min(0.0, down + y - drift + h)
                if up > h or down < -h:
                    out.append((key[0], ts, 1 if up > h else -1))
                    up = down = 0.0
            if price > 0:
                last = price
        if last is not None:
            state.update((last, n, total, up, down))
        yield pd.DataFrame(out, columns=["symbol", "t0", "direction"])

    return (
        ticks.withWatermark("ts", delay)
        .groupBy("symbol")
        .applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")
    )


def windowed_value(ticks: DataFrame, every: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Count and value of ticks (symbol, ts, price) per time window, late ones being dropped after ``delay``."""
    return (
        ticks.withWatermark("ts", delay)
        .groupBy("symbol", F.window("ts", every).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("value"))
        .select("symbol", F.col("w.start").alias("start"), "n", "value")
    )
