"""All registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import labels, sampling
from ..runtime import ship
from ..sources.bars import bars
from . import labelling, learning, prices  # noqa: F401  (they register their queries)
from .base import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars to labels: which share of sampled events meets its profit before its stop?"""
    ship(spark)
    b = bars(spark, sf_dir)
    picked = labels.event_targets(sampling.cusum_events(b, 0.35), labels.daily_vol(b))
    touched = labels.triple_barrier(labels.vertical_barrier(picked, b), b)
    return labels.distribution(labels.label_bins(touched, b))


def queries() -> dict:
    return {**QUERIES, "flagship": flagship}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
