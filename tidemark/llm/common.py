"""What the operators share: the folder for written tables, hashing and hot-key joins."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import fresh_path, materialize, ship  # noqa: F401  (for the operators)

# Rows without a partner are kept out of an exchange by a Bloom filter of the smaller side; its size is bounded.
HIT_SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
}


HOT_ROWS = MOST_HOT = 10_000


def trim() -> None:
    """Give freed memory back to the system: Python workers live on and would keep their largest size."""
    pa.default_memory_pool().release_unused()  # Arrow's own allocator
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


_caches: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What an operator holds in a Python worker from task to task."""
    return _caches.setdefault(owner, {})


def forget_others(owner: str | None) -> None:
    """Empty the caches of all other operators: their tasks are over when those of another come to the worker."""
    held = [cache for name, cache in _caches.items() if name != owner and cache]
    for cache in held:
        cache.clear()
    if held:
        trim()


def tidy(build: Callable, owner: str | None = None) -> Callable:
    """A function over batches that gives its memory back in the end; the owner's cache stays for its next task."""

    def run(batches: Iterator) -> Iterator:
        forget_others(owner)
        yield from build(batches)
        trim()

    return run


def release_heaps(spark: SparkSession) -> None:
    """Give the executors' unused heap back to the system: it grows with each stage, up to its limit, and would stand
    beside the next stage's Python workers. Garbage holds native buffers and unloaded classes too."""
    n = spark.sparkContext.defaultParallelism  # a task for each core, all dealt at once
    collect = F.reflect(F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, n, 1, n).select(collect.alias("collected")).write.format("noop").mode("overwrite").save()


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings for the time of a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a table in the shared folder, on whatever file system it is."""
    system, where = _file_system(spark, path)
    system.delete(where, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    system, where = _file_system(spark, path)
    return system.exists(where)


def write_once(df: DataFrame, path: str) -> DataFrame:
    """Write df at the path unless a whole table is there already; what a failed try left is never seen."""
    spark = df.sparkSession
    if not path_exists(spark, path):
        staged = fresh_path(spark, "staged")
        df.write.parquet(staged)
        system, where = _file_system(spark, path)
        system.mkdirs(where.getParent())
        if not system.rename(_file_system(spark, staged)[1], where):
            raise OSError(f"{staged} could not be moved to {path}")
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def with_locator(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """The columns, and file and row, which name a row for good; rows not in files are written to some first."""
    named = [c.alias(n) for n, c in cols.items()]
    locator = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    if "_metadata" not in {c.lower() for c in df.columns}:
        try:
            found = df.select(*named, *locator)
            found.schema
            return found
        except AnalysisException:  # not read from files
            pass
    return materialize(df.select(*named), "content").select(*cols, *locator)


def join_counted(rows: DataFrame, counted: DataFrame, key: list[str], count: str, how: str = "inner") -> DataFrame:
    """rows joined to a table of one row a key, whose column ``count`` says how many rows have it.

    A key of more than a ten-thousandth of all that is counted (and of ten thousand rows) would make one
    long task. There are fewer than ten thousand of those, whatever the data, so they are broadcast and
    their rows stay where they are; all others go through an exchange.
    """
    total = counted.agg(F.sum(count)).first()[0] or 0
    many = max(HOT_ROWS, total // MOST_HOT)
    heavy = materialize(counted.where(F.col(count) > many), "hot-keys")
    if heavy.isEmpty():
        return rows.join(counted, key, how)
    at_home = rows.join(F.broadcast(heavy), key)
    moved = rows.join(F.broadcast(heavy.select(*key)), key, "left_anti").join(counted.where(F.col(count) <= many), key, how)
    return at_home.unionByName(moved)
