"""WARC archives: writing captures, reading archives back, assembling transactions.

``write_archives`` writes three records a page (request, response or revisit, metadata), tied by
WARC-Concurrent-To, into gzipped archives in any store Spark can write. Pages with equal payloads
share one response, the page with the largest page_id; the others become revisits of it.
``read_archives`` parses archives record by record by their Content-Length, so payloads may hold
any bytes. ``assemble`` joins request, response and metadata records through concurrent-to
identifiers, whichever of the records names the other, also by way of a third record, and emits one
nested row per capture.

Edge cases: null html is an empty payload; a null url gives no target; control characters and blanks
of a url are percent-encoded; a null page_id counts as the smallest, and stays null; of repeated rows
with the largest page_id one is the response; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialize, ship, with_locator

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_A_FILE = 3000
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
HEAD_TYPES = ("response", "revisit", "resource", "conversion")

RECORD_SCHEMA = (
    "record_id string, warc_type string, target_uri string, warc_date string, concurrent_to array<string>, "
    "refers_to string, declared_digest string, payload_digest string, payload_bytes long, "
    "http_status int, fields map<string,string>, payload binary"
)


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a SHA-1 in hex: five hex digits are four letters."""
    letters = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1
            letters.append(F.substr(F.lit(BASE32), at, F.lit(1)))
    return F.concat(*letters)


def _record_id(kind: str, page_id: str, file: str, row: str) -> Column:
    key = F.md5(F.concat_ws("|", F.lit(kind), F.col(page_id).cast("string"), F.col(file), F.col(row).cast("string")))
    parts = [F.substring(key, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(fields: list[tuple[str, Column | str | None]], block: Column) -> Column:
    """One record without its closing blank lines; fields whose value is null are left out."""
    lines = [F.lit("WARC/1.1" + CRLF)]
    for name, value in fields:
        column = F.lit(value) if isinstance(value, str) else value
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), column, F.lit(CRLF)), F.lit("")))
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF)))
    return F.concat(*lines, block)


def _uri(url: Column) -> Column:
    for code in (*range(0x21), 0x7F):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def capture_records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0) -> DataFrame:
    """The records of (page_id, url, html), as text in column ``value``."""
    source = with_locator(pages, {c: F.col(c) for c in ("page_id", "url", "html")}).withColumn("html", F.coalesce("html", F.lit("")))
    source = source.withColumn("sha1", F.sha1("html")).withColumn("n", F.octet_length("html").cast("long"))
    owner = F.max(F.struct("page_id", "file", "row", "url")).alias("owner")
    owners = source.groupBy("sha1", "n").agg(owner)
    joined = source.join(owners, ["sha1", "n"]).select(
        "*",
        F.col("owner.page_id").alias("o_id"),
        F.col("owner.file").alias("o_file"),
        F.col("owner.row").alias("o_row"),
    )
    owns = (F.col("file") == F.col("o_file")) & (F.col("row") == F.col("o_row"))
    is_response = owns | (F.col("n") < least_bytes)
    uri = F.when(F.col("url").isNotNull(), _uri(F.col("url")))
    owner_url = F.col("owner.url")
    head_id = _record_id("response", "page_id", "file", "row")
    digest = F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1")))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("n").cast("string"),
        F.lit(CRLF + CRLF),
    )
    common = [("WARC-Date", date), ("WARC-Target-URI", uri)]
    kind = "Content-Type", "application/http;msgtype=response"
    response = _record(
        [
            ("WARC-Type", "response"),
            ("WARC-Record-ID", head_id),
            *common,
            ("WARC-Payload-Digest", digest),
            kind,
        ],
        F.concat(http, F.col("html")),
    )
    revisit = _record(
        [
            ("WARC-Type", "revisit"),
            ("WARC-Record-ID", head_id),
            *common,
            ("WARC-Payload-Digest", digest),
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", _record_id("response", "o_id", "o_file", "o_row")),
            ("WARC-Refers-To-Target-URI", F.when(owner_url.isNotNull(), _uri(owner_url))),
            ("WARC-Refers-To-Date", date),
            kind,
        ],
        http,
    )
    request = _record(
        [
            ("WARC-Type", "request"),
            ("WARC-Record-ID", _record_id("request", "page_id", "file", "row")),
            *common,
            ("WARC-Concurrent-To", head_id),
            ("Content-Type", "application/http;msgtype=request"),
        ],
        F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{CRLF}{CRLF}")),
    )
    metadata = _record(
        [
            ("WARC-Type", "metadata"),
            ("WARC-Record-ID", _record_id("metadata", "page_id", "file", "row")),
            *common,
            ("WARC-Concurrent-To", head_id),
            ("Content-Type", "application/warc-fields"),
        ],
        F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit("")),
    )
    return joined.select(
        F.explode(F.array(request, F.when(is_response, response).otherwise(revisit), metadata)).alias("value")
    )


def write_archives(records: DataFrame, path: str) -> None:
    """Each file is a WARC file; the line separator is the two blank lines that close a record."""
    (
        records.write.option("lineSep", CRLF + CRLF)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS_A_FILE)
        .text(path)
    )


def _fields(lines: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in lines.decode("utf-8", "replace").split(CRLF):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], out[-1][1] + " " + line.strip())
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip().lower(), value.strip()))
    return out


def parse_archive(content: bytes) -> Iterator[dict]:
    """The records of one archive, gzipped (by file or by record) or not, one at a time."""
    stream = io.BytesIO(content)
    if content[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20)
    while True:
        version = stream.readline()
        if not version:
            return
        if not version.strip():
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {version[:60]!r}")
        lines = []
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            lines.append(line)
        head = _fields(b"".join(lines))
        get = dict(reversed(head)).get
        block = stream.read(int(get("content-length", "0")))
        yield _parsed(head, get, block)


def _parsed(head: list, get, block: bytes) -> dict:
    kind, content_type = get("warc-type"), get("content-type") or ""
    status, fields, payload, size = None, {}, None, None
    if content_type.startswith("application/http") and kind in ("response", "revisit"):
        top, _, payload = block.partition(b"\r\n\r\n")
        first, _, rest = top.partition(b"\r\n")
        word = first.split(b" ")
        status = int(word[1]) if len(word) > 1 and word[1].isdigit() else None
        fields = dict(reversed(_fields(rest)))
        size = len(payload)
    elif content_type.startswith("application/warc-fields"):
        fields = dict(reversed(_fields(block)))
    elif kind in HEAD_TYPES:
        payload, size = block, len(block)
    declared = get("warc-payload-digest")
    computed = None
    if kind == "revisit":  # its payload is that of the record it refers to
        computed, payload = declared and declared.rpartition(":")[2], None
        size = int(n) if (n := fields.get("content-length", "")).isdigit() else None
    elif payload is not None and kind in HEAD_TYPES:
        computed = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return {
        "record_id": get("warc-record-id"),
        "warc_type": kind,
        "target_uri": get("warc-target-uri"),
        "warc_date": get("warc-date"),
        "concurrent_to": [v for k, v in head if k == "warc-concurrent-to"],
        "refers_to": get("warc-refers-to"),
        "declared_digest": declared,
        "payload_digest": computed,
        "payload_bytes": size,
        "http_status": status,
        "fields": list(fields.items()),
        "payload": payload,
    }


def _arrow_schema(with_payload: bool) -> pa.Schema:
    text = pa.string()
    kinds = {
        "concurrent_to": pa.list_(text), "payload_bytes": pa.int64(), "http_status": pa.int32(),
        "fields": pa.map_(text, text), "payload": pa.binary(),
    }
    names = [part.strip().split(" ")[0] for part in RECORD_SCHEMA.replace("map<string,string>", "map").split(",")]
    return pa.schema([(n, kinds.get(n, text)) for n in names if with_payload or n != "payload"])


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives under path; payload digests are computed from the bytes read."""
    ship(spark)
    schema = _arrow_schema(with_payload)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for content in batch.column("content"):
                for record in parse_archive(content.as_py()):
                    if not with_payload:
                        del record["payload"]
                    else:
                        held += len(record["payload"] or b"")
                    rows.append(record)
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    shape = RECORD_SCHEMA if with_payload else RECORD_SCHEMA.replace(", payload binary", "")
    return files.load(path).select("content").mapInArrow(parse, shape)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, requests and metadata.

    ``records`` is read several times and should be a table.
    """
    heads = records.where(F.col("warc_type").isin(*HEAD_TYPES)).select("record_id")
    links = records.select("record_id", F.explode("concurrent_to").alias("other"))
    ties = links.union(links.select("other", "record_id")).distinct()
    near = ties.join(heads.withColumnRenamed("record_id", "other"), "other").select(
        "record_id", F.col("other").alias("capture_id")
    )
    near = near.join(heads, "record_id", "left_anti")
    # Records tied to a capture only by way of another record of it.
    far = (
        ties.join(near.withColumnRenamed("record_id", "other"), "other")
        .select("record_id", "capture_id")
        .join(heads, "record_id", "left_anti")
        .join(near.select("record_id").distinct(), "record_id", "left_anti")
        .distinct()
    )
    members = heads.select("record_id", F.col("record_id").alias("capture_id")).union(near).union(far)
    record = F.struct(*[c for c in records.columns if c != "concurrent_to"])
    kind = F.col("warc_type")
    return (
        records.join(members, "record_id")
        .groupBy("capture_id")
        .agg(
            F.first(F.when(kind.isin(*HEAD_TYPES), record), ignorenulls=True).alias("response"),
            F.collect_list(F.when(kind == "request", record)).alias("requests"),
            F.collect_list(F.when(kind == "metadata", record)).alias("metadata"),
        )
    )


def page_captures(captures: DataFrame) -> DataFrame:
    """page_id, payload size and digest, record type and the page a revisit refers to."""
    flat = captures.select(
        "capture_id",
        F.expr("get(filter(metadata, m -> m.fields['page-id'] is not null), 0).fields['page-id']")
        .cast("long")
        .alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.warc_type").alias("record_type"),
        F.col("response.refers_to").alias("target"),
    )
    owners = flat.where("record_type = 'response'").select(
        F.col("capture_id").alias("target"), F.col("page_id").alias("refers_to")
    )
    return flat.join(owners, "target", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages' archives, read them back and return ``page_captures`` of them."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_archives(capture_records(pages), path)
    records = materialize(read_archives(spark, path, with_payload=False), "warc-records")
    captures = materialize(assemble(records), "warc-captures")
    return page_captures(captures)
