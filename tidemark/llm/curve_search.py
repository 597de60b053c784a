"""Approximate nearest neighbours by shifted space-filling curves.

Several random projections of the vectors, each shifted and bent onto a grid, are read along a Hilbert
curve; all curves' keys are range-partitioned and ranked in Spark. A query looks at the vectors within
a window of ranks around its own on every curve, by matrix products; what the windows find is merged
and ordered by the exact inner product. As the order wanted is that of inner products, vectors get one
more coordinate that makes their lengths equal, queries a zero.

The window is fitted: for ``SAMPLE`` queries (those of the smallest id hashes) the true neighbours are
searched among all vectors, and the window is the smallest that holds ``COVER`` of them on some curve.
All vectors are indexed, and every query is searched alike.

Curves and their ranks are made of keys and ids; vectors, in the width of their column, are joined to the
ranks afterwards. On each curve queries are gathered by SUPER blocks (by two windows, if those are wider), so
a vector goes to two gatherings of a curve at most, while the window is below MOST_SUPER / 2 blocks; a
gathering's queries are held and the vectors around them stream past.

Edge cases: vectors that are null, zero, of another length than most, or hold a null or non-finite
component take no part, nor do null ids; of rows with one id the smallest vector counts; with fewer
candidates all are returned; no queries or an empty table give an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship

CURVES = 6
DIMENSIONS, BITS = 9, 7
BLOCK = 1024
SUPER, MOST_SUPER, SLAB = 32, 1024, 64
SAMPLE, COVER = 64, 0.95
FIT_ROWS = 4096
SEED = 20240101


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of grid cells (after Skilling, 2004)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


class Curves:
    """Projections, shifts and scales of the curves, from a bounded sample of vectors."""

    def __init__(self, sample: np.ndarray, longest: float, curves: int):
        rng = np.random.default_rng(SEED)
        self.longest = longest
        width = sample.shape[1] + 1
        n = min(DIMENSIONS, width)
        self.axes = [np.linalg.qr(rng.standard_normal((width, width)))[0][:, :n] for _ in range(curves)]
        self.shifts = rng.random((curves, n))
        lifted = self.lift(sample, False)
        self.mean = [(lifted @ a).mean(axis=0) for a in self.axes]
        self.scale = [(lifted @ a).std(axis=0) + 1e-12 for a in self.axes]

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        length2 = (x * x).sum(axis=1)
        if query:
            return np.c_[x * (self.longest / np.sqrt(length2))[:, None], np.zeros(len(x))]
        return np.c_[x, np.sqrt(np.maximum(0.0, self.longest**2 - length2))]

    def keys(self, x: np.ndarray, query: bool) -> list[np.ndarray]:
        out, lifted = [], self.lift(x, query)
        for a, mean, scale, shift in zip(self.axes, self.mean, self.scale, self.shifts, strict=True):
            even = 1 / (1 + np.exp(-1.702 * np.clip((lifted @ a - mean) / scale, -30, 30)))
            cells = np.minimum(((even + shift) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
            out.append(hilbert_keys(cells, BITS))
        return out


def _vector(raw: bytes, dim: int, n: int = 1) -> np.ndarray:
    """The floats of n vectors in double precision, of the width that the bytes show."""
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * dim * n else np.float64).astype(np.float64)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return _vector(b"".join(column.to_pylist()), dim, len(column)).reshape(-1, dim)


def sound_vectors(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, vec) of the rows that take part, the vector as the bytes of its floats, and its length."""
    kept = "array<float>" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kept).alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where("vec_id is not null and v is not null").where(F.forall("v", finite)).where(F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim = sizes[0]["n"] if sizes else 1
    rows = rows.where(F.size("v") == dim)
    if not rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, dim) if b.num_rows else np.zeros((0, dim))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "vec"])

    return rows.mapInArrow(pack, "vec_id long, vec binary"), dim


def ranked(vectors: DataFrame, dim: int, curves: Curves, query_step: int) -> DataFrame:
    """curve, block, vec_id, query: every vector and query in its block of ranks on each curve."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = b.column(0).to_numpy(), _vectors(b.column(1), dim)
            for query in (False, True):
                at = np.flatnonzero(ids % query_step == 0) if query else np.arange(len(ids))
                if not len(at):
                    continue
                taken = pa.array(ids[at])
                for c, key in enumerate(curves.keys(x[at], query)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), c, np.int32)), pa.array(key), taken, pa.array(np.full(len(at), query))],
                        names=["curve", "key", "vec_id", "query"],
                    )

    rows = vectors.mapInArrow(keys, "curve int, key long, vec_id long, query boolean")
    order = ["curve", "key", "vec_id", "query"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The place within the part; parts are in order, so the rows before a part are counts of parts.
    placed = materialize(
        placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("n")), "curve-ranks"
    )
    per = placed.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("first"))
    from pyspark.sql import Window as W

    # A row per curve and part of the exchange.
    before = per.select(
        "curve", "part", "first",
        F.coalesce(F.sum("rows").over(W.partitionBy("curve").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    rank = F.col("before") + F.col("n") - F.col("first")
    return placed.join(before, ["curve", "part"]).select("curve", F.floor(rank / BLOCK).cast("long").alias("block"), "vec_id", "query")


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(ids) > 4 * k:
        rough = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= rough)
    else:
        keep = np.arange(len(ids))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def _found(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple]:
    """For each query its k nearest of the vectors: ids and exact scores as bytes."""
    products = q @ x.T
    for i, own in enumerate(q_ids):
        rough = products[i]
        rough[ids == own] = -np.inf
        near = best_of(ids, rough, k + 4)
        near = near[ids[near] != own]
        exact = (x[near] * q[i]).sum(axis=1)
        top = best_of(ids[near], exact, k)
        yield int(own), ids[near][top].tobytes(), exact[top].tobytes()


FOUND = "query_id long, ids binary, scores binary"


def merge(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of what was found for each query."""
    schema = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for q, i, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, scores = np.frombuffer(i, np.int64), np.frombuffer(s, np.float64)
                if q in best:
                    ids, first = np.unique(np.concatenate([best[q][0], ids]), return_index=True)
                    scores = np.concatenate([best[q][1], scores])[first]
                top = best_of(ids, scores, k)
                best[q] = ids[top], scores[top]
        for at in range(0, len(best), 5000):
            some = list(best.items())[at : at + 5000]
            sizes = [len(v[0]) for _, v in some]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat([q for q, _ in some], sizes)),
                        pa.array(np.concatenate([np.arange(1, n + 1) for n in sizes]).astype(np.int32)),
                        pa.array(np.concatenate([v[0] for _, v in some])),
                        pa.array(np.concatenate([v[1] for _, v in some])),
                    ],
                    schema=schema,
                )

    return found.repartition("query_id").mapInArrow(build, "query_id long, rank int, vec_id long, score double")


def exact_search(vectors: DataFrame, dim: int, q_ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """Brute force for a bounded set of queries against all vectors, in blocks."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(_found(q_ids, q, b.column(0).to_numpy(), _vectors(b.column(1), dim), k)) if b.num_rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["query_id", "ids", "scores"])

    return merge(vectors.mapInArrow(build, FOUND), k)


def fitted_window(vectors: DataFrame, dim: int, ranks: DataFrame, query_step: int, k: int) -> int:
    """The smallest window (in blocks) that holds COVER of the sample's true neighbours on some curve."""
    sample = vectors.where(F.col("vec_id") % query_step == 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    if not sample:
        return 0
    q_ids = np.array([r["vec_id"] for r in sample])
    q = np.stack([_vector(r["vec"], dim) for r in sample])
    truth = [(r["query_id"], r["vec_id"]) for r in exact_search(vectors, dim, q_ids, q, k).collect()]
    if not truth:
        return 0
    wanted = sorted({i for pair in truth for i in pair})
    place: dict[tuple, int] = {}
    for r in ranks.where(F.col("vec_id").isin(wanted)).select("curve", "vec_id", "query", "block").collect():
        place[r["curve"], r["vec_id"], r["query"]] = r["block"]
    curves = {c for c, _, _ in place}
    away = [min(abs(place[c, a, True] - place[c, b, False]) for c in curves) for a, b in truth]
    return int(np.sort(away)[min(len(away) - 1, int(np.ceil(COVER * len(away))) - 1)])


def nearest(
    df: DataFrame, k: int = 20, query_step: int = 20, curves: int = CURVES, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of each row whose id is a multiple of query_step."""
    spark = df.sparkSession
    ship(spark)
    vectors, dim = sound_vectors(df, id_col, vector_col)
    vectors = materialize(vectors, "vectors")
    sample = [r["vec"] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).collect()]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b.column(1), dim)
            yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((x * x).sum(axis=1)).max())] if len(x) else [0.0])], names=["m"])

    most = vectors.mapInArrow(longest, "m double").agg(F.max("m")).first()[0]
    model = Curves(np.stack([_vector(v, dim) for v in sample]), most, curves)
    ranks = materialize(ranked(vectors, dim, model, query_step), "curve-blocks")
    w = fitted_window(vectors, dim, ranks, query_step, k)

    # Queries of some blocks meet the candidates of these and of a window on both sides.
    wide = min(MOST_SUPER, max(SUPER, 2 * w))
    last = ranks.agg(F.max("block")).first()[0] // wide
    gathering = lambda block: F.floor(block / wide)
    spans = F.sequence(F.greatest(F.lit(0), gathering(F.col("block") - w)), F.least(F.lit(last), gathering(F.col("block") + w)))
    own = F.array(gathering(F.col("block")))
    rows = ranks.join(vectors, "vec_id").withColumn("super", F.explode(F.when(F.col("query"), own).otherwise(spans)))
    order = ["curve", "super", F.desc("query"), "block", "vec_id"]
    rows = rows.select("curve", "super", "query", "block", "vec_id", "vec").repartition("curve", "super").sortWithinPartitions(*order)
    return merge(rows.mapInArrow(lambda batches: searched(batches, dim, w, k), FOUND), k)


def searched(batches: Iterator[pa.RecordBatch], dim: int, w: int, k: int) -> Iterator[pa.RecordBatch]:
    """What each query finds within w blocks in its gathering. Rows come by curve and gathering, queries first,
    both in the order of blocks."""
    place, queries, held, best = None, [], [], {}

    def flush() -> None:
        if queries and held:
            q_block, q_ids, q = (np.concatenate(x) for x in zip(*queries, strict=True))
            block, ids, x = (np.concatenate(y) for y in zip(*held, strict=True))
            for at in np.unique(q_block):
                lo, hi = np.searchsorted(block, [at - w, at + w + 1])
                if lo == hi:
                    continue
                a, b = np.searchsorted(q_block, [at, at + 1])
                for n, near, scores in _found(q_ids[a:b], q[a:b], ids[lo:hi], x[lo:hi], k):
                    if n in best:
                        near, scores = best[n][0] + near, best[n][1] + scores
                        top = best_of(np.frombuffer(near, np.int64), np.frombuffer(scores, np.float64), k)
                        near, scores = np.frombuffer(near, np.int64)[top].tobytes(), np.frombuffer(scores, np.float64)[top].tobytes()
                    best[n] = near, scores
        held.clear()

    def found() -> Iterator[pa.RecordBatch]:
        flush()
        for at in range(0, len(best), 5000):
            some = list(best.items())[at : at + 5000]
            columns = pa.array([n for n, _ in some], pa.int64()), *(pa.array([v[j] for _, v in some], pa.binary()) for j in (0, 1))
            yield pa.RecordBatch.from_arrays(list(columns), names=["query_id", "ids", "scores"])
        queries.clear()
        best.clear()

    for batch in batches:
        curve, gathering, query, block, ids = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:5])
        cuts = np.flatnonzero((np.diff(curve) != 0) | (np.diff(gathering) != 0) | (np.diff(query.astype(np.int8)) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
            if a == b:
                continue
            if place != (curve[a], gathering[a]):
                yield from found()
                place = curve[a], gathering[a]
            if query[a] or queries:
                (queries if query[a] else held).append((block[a:b], ids[a:b], _vectors(batch.column(5).slice(a, b - a), dim)))
            if sum(len(y[1]) for y in held) >= SLAB * BLOCK // 2:
                flush()
    yield from found()
