"""Connected components of an edge table, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MOST_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of the edges (a, b).

    Alternates large-star and small-star steps (each node hooks its neighbours to the smallest of
    them) until the stars stand still; each round is written to the shared folder. Minima are taken
    by partial aggregation, so a node with many neighbours costs no task more than its own map side,
    and joins on them can be split.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = materialize(links, "cc")
    seen = None
    for _ in range(MOST_ROUNDS):
        # Large star: every node ties its larger neighbours to the least of its neighbourhood.
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a <> b").distinct(), "cc")
        # Small star: every node ties its smaller neighbours and itself to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("a", F.col("m").alias("b")))
        links = materialize(small.where("a <> b").distinct(), "cc")
        mark = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")
        ).first()
        if tuple(mark) == seen or mark[0] == 0:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
