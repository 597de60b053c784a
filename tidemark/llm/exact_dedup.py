"""Exact deduplication with stateful streaming.

A row is (digest of the normalised text, doc_id, content locator = file and row in it). The rows run
through a Structured Streaming aggregation whose keyed state lies in RocksDB, without watermark or
expiry: for every digest it retains the smallest doc_id with its locator and the group's size. Rows
whose digest others have (hits) are compared by full bytes: their texts are found through the locators,
equal ones of a task are one row before they are exchanged, and a digest with more than one text is
grouped by its bytes instead. Only DataFrame functions run on the executors.

With a ``home`` the state, the digests and the texts fed are kept there, and every call is one more
feed of rows: its hits are compared with the texts of earlier feeds too. A feed has a name; one that is
repeated under its name (a retry) is taken once.

Edge cases: a null text counts as empty; a null doc_id is larger than any other; of rows equal in
text and doc_id the one with the smallest locator stays; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HIT_SETTINGS, fresh_path, join_counted, materialize, settings, with_locator, write_once

BLANKS = "[\\x20\\x09-\\x0D]+"
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Each store would lay out megabytes of log ahead, however few keys it holds.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
FILES_A_TRIGGER = 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def located(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the content locator of each row."""
    return with_locator(df, {"doc_id": F.col(id_col).cast("long"), "text": F.col(text_col).cast("string")})


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("file"), F.col("row"))


class ExactDedup:
    """Keyed state under ``home``; ``feed`` streams the digests put there since."""

    def __init__(self, spark: SparkSession, home: str | None = None, digest: Callable[[Column], Column] = sha256):
        self.spark, self.home, self.digest = spark, home or fresh_path(spark, "dedup"), digest

    def put(self, rows: DataFrame, name: str) -> DataFrame:
        """Write the digests of (doc_id, text, file, row) as the feed of that name, unless it is there."""
        norm = normalised(F.col("text"))
        digests = rows.select("doc_id", "file", "row", self.digest(norm).alias("digest"), sha256(norm).alias("text_sha256"))
        return write_once(digests, f"{self.home}/incoming/{name}")

    def all_rows(self) -> DataFrame:
        return self.spark.read.schema(ROW_SCHEMA).parquet(f"{self.home}/incoming/*")

    def keep_content(self, df: DataFrame, name: str) -> DataFrame:
        """The feed's texts under ``home``, with their locators."""
        return located(write_once(df, f"{self.home}/content/{name}"))

    def all_content(self) -> DataFrame:
        return located(self.spark.read.schema("doc_id long, text string").parquet(f"{self.home}/content/*"))

    def feed(self) -> DataFrame:
        """Run the stream over new rows; the registry: digest, keep (id and locator), group_size."""
        spark = self.spark
        with settings(spark, STATE_SETTINGS):
            state = (
                spark.readStream.schema(ROW_SCHEMA)
                .option("maxFilesPerTrigger", FILES_A_TRIGGER)
                .parquet(f"{self.home}/incoming/*")
                .groupBy("digest")
                .agg(F.min(_order()).alias("keep"), F.count(F.lit(1)).alias("group_size"))
            )
            registry = f"{self.home}/registry"
            query = (
                state.writeStream.outputMode("update")
                .option("checkpointLocation", f"{self.home}/state")
                .trigger(availableNow=True)
                .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{registry}/batch={n}"))
                .start()
            )
            query.awaitTermination()
        fields = (
            "digest string, keep struct<no_id: boolean, doc_id: long, file: string, row: long>, "
            "group_size long, batch long"
        )
        try:
            written = spark.read.schema(fields).parquet(registry)
        except AnalysisException:  # no batch ran: there were no rows
            written = spark.createDataFrame([], fields)
        # Every batch writes the state of the digests it met; the state only grows and its minimum only falls.
        return written.groupBy("digest").agg(F.min("keep").alias("keep"), F.max("group_size").alias("group_size"))


ROW_SCHEMA = "doc_id long, file string, row long, digest string, text_sha256 string"


def _is_kept() -> Column:
    return (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))


def _locator(file: Column, row: Column) -> Column:
    return F.concat_ws(":", row.cast("string"), file)


def _with_text(content: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted rows (with a column ``at``, their locator) with their normalised texts."""
    texts = content.select(_locator(F.col("file"), F.col("row")).alias("at"), "text")
    return texts.join(wanted, "at").withColumn("norm", normalised(F.col("text"))).drop("text")


def _outcome(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        _is_kept().alias("kept"),
        "text_sha256",
        "file",
        "row",
    )


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    home: str | None = None,
    feed: str | None = None,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 and the locator (file, row).

    With a ``home`` keep_id and group_size speak of all rows fed so far.
    """
    dedup = ExactDedup(df.sparkSession, home, digest)
    name = feed or uuid.uuid4().hex
    if home:
        plain = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        rows, content = dedup.put(dedup.keep_content(plain, name), name), dedup.all_content()
    else:
        content = located(df, id_col, text_col)
        rows = dedup.put(content, name)
    return _resolved(dedup, rows, content, home is not None)


def _resolved(dedup: ExactDedup, rows: DataFrame, content: DataFrame, fed_before: bool = False) -> DataFrame:
    """What becomes of the rows just put, whose texts and those of earlier feeds are in content."""
    registry = materialize(dedup.feed(), "dedup-registry")
    tagged = materialize(
        join_counted(rows, registry, ["digest"], "group_size").withColumn("at", _locator(F.col("file"), F.col("row"))),
        "dedup-tagged",
    )

    # Hits: one text a digest, byte for byte, or it is several groups.
    hits = tagged.where("group_size > 1").select("at", "digest", "group_size")
    if fed_before:  # retained rows of earlier feeds
        kept = registry.where("group_size > 1").select(_locator(F.col("keep.file"), F.col("keep.row")).alias("at"), "digest", "group_size")
        hits = kept.join(hits.select("digest").distinct(), "digest", "left_semi").select(*hits.columns).union(hits).distinct()
        hits = materialize(hits, "dedup-hits")
    with settings(rows.sparkSession, HIT_SETTINGS):
        forms = _with_text(content, hits.where("group_size > 1")).select("digest", "norm").distinct()
        broken = materialize(forms.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "dedup-unequal")
    if broken.isEmpty():
        return _outcome(tagged)

    every = dedup.all_rows().join(broken.select("digest"), "digest", "left_semi")
    every = every.withColumn("at", _locator(F.col("file"), F.col("row")))
    split = materialize(_with_text(content, every), "dedup-split")
    by_bytes = split.groupBy("digest", "norm").agg(F.min(_order()).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    apart = split.join(by_bytes, ["digest", "norm"]).join(rows.select("file", "row"), ["file", "row"], "left_semi")
    sound = tagged.join(broken, "digest", "left_anti")
    return _outcome(sound).unionByName(_outcome(apart))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each group of equal texts."""
    # Columns go by number, so that no name can clash.
    numbered = {f"c{i}": F.col(f"`{c}`") for i, c in enumerate(df.columns)}
    whole = with_locator(df, numbered)
    text = f"c{df.columns.index(text_col)}"
    rows = whole.select(F.col(f"c{df.columns.index(id_col)}").alias("doc_id"), F.col(text).alias("text"), "file", "row")
    dedup = ExactDedup(df.sparkSession)
    found = _resolved(dedup, dedup.put(rows, "all"), rows)
    dropped = materialize(found.where(~F.col("kept")).select(_locator(F.col("file"), F.col("row")).alias("at")), "dedup-dropped")
    placed = whole.withColumn("at", _locator(F.col("file"), F.col("row")))
    return placed.join(dropped, "at", "left_anti").select(*numbered).toDF(*df.columns)
