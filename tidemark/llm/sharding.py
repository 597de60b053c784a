"""Sharding by histogram sort.

Keys are (h, doc_id) with h a 60-bit hash of the text, so equal texts stand side by side and a
group of copies too large for one shard is cut at a doc_id. Rounds of exact histograms count the
bytes below candidate boundaries over all partitions, each round laying finer probes inside the
one bucket that holds a boundary, until every splitter is an exact key. Then rows are exchanged
once, by range part, and sorted there. Only DataFrame functions are used.

Law ``bytes``: with rows ordered by key, a row goes to shard ``floor(shards * before / total)``,
``before`` being the bytes of all rows with smaller keys. Shard sizes differ from the ideal by
less than one row (rows equal in both key columns count as one).

Edge cases: a null text has size 1; a null doc_id sorts first; repeated rows (same doc_id and text)
share one key and one shard, with distinct slots; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

PROBES = 256
LEAST = -(2**63)
Key = tuple[int, int]


def text_hash(text: Column) -> Column:
    """60 bits of the MD5 of the text."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def key_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        text_hash(text).alias("h"),
    ).withColumn("d", F.coalesce(F.col("doc_id"), F.lit(LEAST)))


def _keys_literal(bounds: Sequence[Key]) -> Column:
    """The bounds as one literal array of (h, d); Catalyst folds it to a constant."""
    pairs = ", ".join(f"struct({h}L, {_long(d)})" for h, d in bounds)
    return F.expr(f"array({pairs})")


def _long(value: int) -> str:
    return f"{value}L" if value > LEAST else "cast('-9223372036854775808' as bigint)"


def _longs(values: Sequence[int]) -> Column:
    return F.expr(f"array({', '.join(_long(v) for v in values)})")


def rank_of(bounds: Sequence[Key]) -> Column:
    """How many of the ascending bounds are at or below the row's key."""
    if not bounds:
        return F.lit(0)
    key = F.struct(F.col("h").alias("col1"), F.col("d").alias("col2"))
    return F.size(F.filter(_keys_literal(bounds), lambda b: b <= key))


class _Open:
    """A bucket that holds a splitter: its first and last key, bytes before it, the first key after it."""

    def __init__(self, first: Key, last: Key, before: int, after: Key | None):
        self.first, self.last, self.before, self.after = first, last, before, after


def _probes(open_: Sequence[_Open]) -> Column:
    """Index of the probe interval of a row within the bucket numbered ``at``.

    Buckets of several hashes are cut by hash, those of one hash by id, or by a quarter of the id
    where the ids lie so far apart that their difference might not fit 64 bits.
    """
    HASH, ID, QUARTER = 0, 1, 2
    kinds, low, high = [], [], []
    for o in open_:
        (h0, d0), (h1, d1) = o.first, o.last
        kind = HASH if h0 != h1 else ID if d1 - d0 < 2**62 else QUARTER
        kinds.append(kind)
        low.append((h0, d0, d0 >> 2)[kind])
        high.append((h1, d1, d1 >> 2)[kind])
    n = F.col("at") + 1
    kind = F.element_at(_longs(kinds), n)
    value = F.when(kind == HASH, F.col("h")).when(kind == ID, F.col("d")).otherwise(F.shiftright("d", 2))
    width = _longs([(b - a) // PROBES + 1 for a, b in zip(low, high, strict=True)])
    return F.floor((value - F.element_at(_longs(low), n)) / F.element_at(width, n)).cast("int")


def splitters(keys: DataFrame, parts: int) -> tuple[list[Key | None], int]:
    """Exact splitters: the j-th is the smallest key with parts * bytes_before >= j * total.

    None stands for a splitter above all keys. At most parts * PROBES counts reach the driver a round.
    """
    pair = F.struct("h", "d")
    row = keys.agg(F.sum("size").alias("total"), F.min(pair).alias("first"), F.max(pair).alias("last")).first()
    total = row["total"] or 0
    if not total:
        return [None] * (parts - 1), 0
    goals = {j: -(-j * total // parts) for j in range(1, parts)}
    found: dict[int, Key | None] = {}
    waiting = {j: _Open(tuple(row["first"]), tuple(row["last"]), 0, None) for j in goals}
    while waiting:
        for j, o in list(waiting.items()):
            if o.first == o.last:
                found[j] = o.after
                del waiting[j]
        if not waiting:
            break
        buckets = sorted({(o.first, o.last) for o in waiting.values()})
        opened = {(o.first, o.last): o for o in waiting.values()}
        ends = F.element_at(_keys_literal([b[1] for b in buckets]), F.col("at") + 1)
        counts = (
            keys.select("h", "d", "size", (rank_of([b[0] for b in buckets]) - 1).alias("at"))
            .where("at >= 0")
            .where(F.struct(F.col("h").alias("col1"), F.col("d").alias("col2")) <= ends)
            .withColumn("probe", _probes([opened[b] for b in buckets]))
            .groupBy("at", "probe")
            .agg(F.sum("size").alias("bytes"), F.min(pair).alias("first"), F.max(pair).alias("last"))
            .collect()
        )
        cells: dict[int, list] = {}
        for c in sorted(counts, key=lambda c: (c["at"], c["probe"])):
            cells.setdefault(c["at"], []).append(c)
        for j, o in list(waiting.items()):
            before, own = o.before, cells[buckets.index((o.first, o.last))]
            for k, c in enumerate(own):
                after = tuple(own[k + 1]["first"]) if k + 1 < len(own) else o.after
                if before < goals[j] <= before + c["bytes"]:
                    waiting[j] = _Open(tuple(c["first"]), tuple(c["last"]), before, after)
                    break
                before += c["bytes"]
    return [found[j] for j in range(1, parts)], total


def histogram_shards(
    df: DataFrame, shards: int = 8, parts_per_shard: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard, in key order) of each row."""
    keys = materialize(key_rows(df, id_col, text_col), "shard-keys")
    parts = shards * parts_per_shard
    cuts, _ = splitters(keys, parts)
    # Parts that no key falls into share a splitter; counting the splitters at or below a key skips them.
    placed = keys.withColumn("part", rank_of([c for c in cuts if c is not None]))
    counts = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}
    base, before = [], {}
    for p in range(parts):
        s = p // parts_per_shard
        base.append(before.get(s, 0))
        before[s] = before.get(s, 0) + counts.get(p, 0)
    starts = F.array(*[F.lit(b).cast("long") for b in base])
    in_part = W.partitionBy("part").orderBy("h", "d")
    return placed.withColumn("n", F.row_number().over(in_part)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.floor(F.col("part") / F.lit(parts_per_shard)).cast("int").alias("shard"),
        (F.element_at(starts, F.col("part") + 1) + F.col("n") - 1).cast("long").alias("slot"),
    )
