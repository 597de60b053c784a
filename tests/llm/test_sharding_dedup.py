import hashlib
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import ExactDedup, drop_copies, exact_dedup, located
from tidemark.llm.sharding import histogram_shards, key_rows, splitters

SCHEMA = "doc_id long, text string, h string, file string, part int"
ROWS = (
    [(i, f"text {i % 97} " + "x" * (i % 50), "a", None, 1) for i in range(400)]
    + [(i, "hot  copy", "b", "c", 2) for i in range(1000, 1200)]
    + [(i, "hot\tcopy", "b", "c", 2) for i in range(1200, 1250)]
    + [(None, None, None, None, None), (2000, None, None, None, None), (2001, "", "", "", 0)]
    + [(7, "again", "", "", 0)] * 3
    + [(3000, "long " * 50000, None, None, 3)]
)


def brute_shards(rows, shards):
    keyed = []
    for doc_id, text, *_ in rows:
        t = (text or "").encode()
        d = -(2**63) if doc_id is None else doc_id
        keyed.append((int(hashlib.md5(t).hexdigest()[:15], 16), d, len(t) + 1))
    total, sums = sum(k[2] for k in keyed), defaultdict(int)
    for h, d, n in keyed:
        sums[h, d] += n
    before, shard = 0, {}
    for key in sorted(sums):
        shard[key] = shards * before // total
        before += sums[key]
    return shard


def test_histogram_sort_matches_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    out = histogram_shards(df, shards=4, parts_per_shard=3).collect()
    want = brute_shards(ROWS, 4)
    assert len(out) == len(ROWS)
    texts = defaultdict(set)
    for doc_id, text, *_ in ROWS:
        t = (text or "").encode()
        d = -(2**63) if doc_id is None else doc_id
        texts[doc_id].add((len(t) + 1, zlib.crc32(t), want[int(hashlib.md5(t).hexdigest()[:15], 16), d]))
    slots = defaultdict(list)
    for r in out:
        assert (r["size"], r["text_crc32"], r["shard"]) in texts[r["doc_id"]]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_histogram_sort_cuts_a_hot_group(spark):
    df = spark.createDataFrame([(i, "same") for i in range(1000)], "doc_id long, text string")
    out = histogram_shards(df, shards=8, parts_per_shard=2).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in out) == [125] * 8
    far = spark.createDataFrame([(i, "x") for i in (-(2**63), -1, 0, 1, 2, 2**63 - 1)], "doc_id long, text string")
    cuts, total = splitters(key_rows(far), 3)
    assert total == 12 and [c[1] for c in cuts] == [0, 2]


def test_histogram_sort_empty(spark):
    assert histogram_shards(spark.createDataFrame([], SCHEMA)).collect() == []


def test_exact_dedup(spark):
    out = exact_dedup(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert len(out) == len(ROWS)
    groups = defaultdict(list)
    for doc_id, text, *_ in ROWS:
        groups[hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", text or "").encode()).hexdigest()].append(doc_id)
    kept = defaultdict(int)
    for r in out:
        ids = groups[r["text_sha256"]]
        assert r["doc_id"] in ids and r["group_size"] == len(ids)
        assert r["keep_id"] == min((i for i in ids if i is not None), default=None)
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_later_feeds_compare_bytes_with_earlier_ones(spark, tmp_path):
    home = str(tmp_path / "home")
    weak = lambda norm: F.substring(F.sha2(norm, 256), 1, 1)  # noqa: E731  (sixteen digests: nearly all texts collide)
    feeds = [[(i, f"text {i % 40}") for i in range(200)], [(i, f"text  {i % 60}") for i in range(-100, 300)], [], [(900, "text 3")]]
    seen = []
    for n, rows in enumerate(feeds):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        for _ in range(2 if n == 1 else 1):  # a feed that is tried again counts once
            out = exact_dedup(df, home=home, feed=f"feed-{n}", digest=weak).collect()
        seen += rows
        groups = defaultdict(list)
        for i, t in seen:
            groups[re.sub(" +", " ", t)].append(i)
        assert len(out) == len(rows)
        by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
        for r in out:
            ids = by_digest[r["text_sha256"]]
            assert r["doc_id"] in ids and r["group_size"] == len(ids) and r["keep_id"] == min(ids)


def test_state_outlives_a_batch(spark, tmp_path):
    dedup = ExactDedup(spark, str(tmp_path / "home"))
    dedup.put(located(spark.createDataFrame([(5, "a"), (6, "b")], "doc_id long, text string")), "one")
    assert dedup.feed().count() == 2
    dedup.put(located(spark.createDataFrame([(1, "a"), (9, "c")], "doc_id long, text string")), "two")
    again = {r["keep"]["doc_id"]: r["group_size"] for r in dedup.feed().collect()}
    assert again == {1: 2, 6: 1, 9: 1}


def test_drop_copies_with_clashing_names(spark, tmp_path):
    schema = "doc_id long, text string, _metadata string, file string, row long, __row long, at string, keep string, digest string"
    rows = [(i, f"t {i % 5}", "m", "f", i, 3, None, "k", "d") for i in range(50)] + [(60, None, *[None] * 7), (61, "", *[None] * 7)]
    df = spark.createDataFrame(rows, schema)
    kept = drop_copies(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 4, 60]
    path = str(tmp_path / "t")
    df.write.parquet(path)
    again = drop_copies(spark.read.parquet(path)).collect()
    assert sorted(r["doc_id"] for r in again) == [0, 1, 2, 3, 4, 60] and {r["_metadata"] for r in again} == {"m", None}
    assert drop_copies(df.limit(0)).collect() == []


def test_hot_keys_stay_at_home(spark, monkeypatch):
    from tidemark.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 20)
    monkeypatch.setattr(common, "MOST_HOT", 4)
    out = exact_dedup(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert len(out) == len(ROWS) and sum(r["kept"] for r in out) == len({r["text_sha256"] for r in out})
