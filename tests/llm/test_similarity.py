import itertools
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import ngram_jaccard as nj
from tidemark.llm import substring_dedup as sd
from tidemark.llm.components import connected_components
from tidemark.llm.curve_search import hilbert_keys, nearest
from tidemark.llm.substring_dedup import WORD, chains, common_length, cut_words, passages, without_passages


def brute_components(rows, width, num, den):
    sets = {}
    for d, text, *_ in rows:
        w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    up = {d: d for d in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(i for i in sets if i is not None and sets[i]), 2):
        common = len(sets[a] & sets[b])
        if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
            up[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_copies(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for n in (1, 2, 3, 4, 9, 12, 25, 60, 150, 400):
        for _ in range(3):
            base = rng.choices(vocab, k=n)
            for copy in range(6):
                text = list(base)
                for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5]) if copy else 0):
                    text[rng.randrange(len(text))] = rng.choice(vocab)
                rows.append((len(rows), rng.choice(["  ", " "]).join(text).replace("w1", "W1"), "x", None))
    rows += [(9000, None, "x", None), (9001, " \t", "x", None), (None, rows[40][1], "x", None), (9002, rows[40][1] + " z", "x", None)]
    return rows


SCHEMA = "doc_id long, text string, n_shingles string, component long"


@pytest.mark.parametrize("width,num,den", [(3, 90, 100), (5, 80, 100)])
def test_join_matches_brute_force(spark, width, num, den):
    rows = near_copies()
    df = spark.createDataFrame(rows + rows[5:7], SCHEMA).repartition(3)
    out = nj.jaccard_components(df, width, num, den).collect()
    want = brute_components(rows, width, num, den)
    assert len(out) == len(rows) + 2
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert any(d != c for d, (_, c) in want.items())


def test_join_in_parts_and_empty(spark, monkeypatch):
    rows = near_copies(4)
    monkeypatch.setattr(nj, "SPLIT", 3)
    monkeypatch.setattr(nj, "SPLIT_SHINGLES", 500)
    out = nj.jaccard_components(spark.createDataFrame(rows, SCHEMA), 3, 90, 100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_components(rows, 3, 90, 100)
    assert nj.jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_documents_and_colliding_words(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(6):
        base = rng.choices(vocab, k=5000)
        for changed in (0, 20, 60, 120, 200, 1500):
            text = list(base)
            for at in rng.sample(range(5000), changed):
                text[at] = rng.choice(vocab)
            rows.append((len(rows), " ".join(text)))
    a, b = "a", "b"
    for n in range(12):  # words that collide under polynomials modulo 2**64
        a, b = a + b, b + a
        if n >= 9:
            rows += [(100 + 2 * n, a), (101 + 2 * n, b)]
    out = nj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100).collect()
    want = brute_components(rows, 5, 80, 100)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert 6 < len({c for _, c in want.values()}) < 36


def test_repeated_ids_have_the_links_of_all_their_texts(spark):
    rng = random.Random(6)
    one, two = (rng.choices([f"w{i}" for i in range(500)], k=60) for _ in range(2))
    near = lambda t: " ".join([*t[:59], "other"])
    rows = [(5, " ".join(one)), (5, " ".join(two)), (2, near(two)), (8, " ".join(two)), (9, near(one)), (11, "x y z"), (12, None)]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string")
    got = defaultdict(set)
    for r in nj.jaccard_components(df, 3, 90, 100).collect():
        got[r["doc_id"]].add(r["component_id"])
    assert got == {5: {2}, 2: {2}, 8: {2}, 9: {2}, 11: {11}, 12: {12}}


def test_folded_bounds_hold():
    rng = np.random.default_rng(2)
    for n in (1, 3, 20, 90, 700, 5000):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        other = np.r_[base[: n * 9 // 10], rng.integers(0, 1 << 63, n // 5, dtype=np.uint64)]
        points = nj.Points([nj.unpacked(nj.packed(nj.count_vector(np.unique(x)))) for x in (base, other)], nj.Similarity(80, 100))
        common = len(np.intersect1d(base, other))
        points.folds = True
        if common >= points.similarity.needed(*points.size):
            assert points.may_link(0, 1)


def test_rtree_loses_nothing():
    rng = np.random.default_rng(7)
    base = rng.poisson(12, (60, nj.DIMENSIONS))
    counts = np.repeat(base, 25, axis=0) + rng.integers(0, 2, (1500, nj.DIMENSIONS))
    s = nj.Similarity(90, 100)
    tree = nj.CountRTree(counts)
    size = counts.sum(axis=1)
    for i in range(0, 1500, 50):
        near = np.minimum(counts, counts[i]).sum(axis=1) >= s.needed(size, size[i])
        near &= (size * 100 >= 90 * size[i]) & (size[i] * 100 >= 90 * size)
        assert sorted(tree.candidates(i, s).tolist()) == np.flatnonzero(near).tolist()


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (9, 8), (7, 9), (6, 6)]
    out = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in out} == {2: 2, 3: 2, 4: 2, 5: 2, 7: 7, 8: 7, 9: 7}
    assert len(out) == 7


def test_passages(spark):
    rng = random.Random(8)
    words = [f"v{i}" for i in range(5000)]
    some = lambda n: rng.choices(words, k=n)
    shared, short = some(70), some(30)
    fuzzy = list(shared)
    fuzzy[35] = "other"
    del fuzzy[50]
    parts = {1: (some(40), shared, some(20)), 2: (some(10), fuzzy, some(60)), 3: (some(80), short, some(5)), 4: (short, some(90), []),
             5: ([], shared, []), 6: (some(200), [], []), 9: (["again"] * 300, [], [])}
    rows = [(d, " ".join([*a, *b, *c]), "u", 1) for d, (a, b, c) in parts.items()] + [(7, None, None, None), (8, "", "", 0), (None, " ".join(shared), "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, at int")
    out = passages(df).collect()
    got = defaultdict(set)
    for r in out:
        got[r["doc_id"]].add((r["passage_start"], r["passage_end"], r["source_doc_id"]))
    assert got == {2: {(10, 79, 1)}, 5: {(0, 70, 1)}}
    left = {r["doc_id"]: r["text"] for r in without_passages(df, passages(df)).collect()}
    assert set(left) == {1, 2, 3, 4, 6, 7, 8, 9, None} and left[7] is None
    assert left[2] == " ".join([*parts[2][0], *parts[2][2]]) and left[1] == rows[0][1]
    assert passages(df.limit(0)).collect() == []


def test_passages_apart_in_the_same_order(spark):
    rng = random.Random(11)
    some = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], {}
    for case, (a, gap, b) in enumerate([(51, 40, 51), (55, 40, 55), (60, 40, 60), (51, 30, 51)] * 5):
        one, two = some(a), some(b)
        rows.append((2 * case, " ".join([*some(9), *one, *some(gap), *two, *some(9)])))
        rows.append((2 * case + 1, " ".join([*some(30), *one, *some(gap), *two, *some(30)])))
        want[2 * case + 1] = {*range(30, 30 + a), *range(30 + a + gap, 30 + a + gap + b)}
    got = defaultdict(set)
    for r in passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]] |= set(range(r["passage_start"], r["passage_end"]))
    assert got == want


def test_fuzzy_passages(spark):
    rng = random.Random(12)
    some = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for case in range(40):
        text, step = some(60), (10, 12)[case % 2]
        fuzzy = [w if i % step != step // 2 else "other" for i, w in enumerate(text)]
        rows += [(2 * case, " ".join([*some(20), *text, *some(20)])), (2 * case + 1, " ".join([*some(9), *fuzzy, *some(9)]))]
    found = {r["doc_id"] for r in passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == set(range(1, 80, 2))


def slow_extend(a, b):
    """Diagonals one after the other, word by word."""
    i = j = common = 0
    while True:
        ways = []
        for shift in sorted(range(-4, 5), key=abs):
            x, y, value, best, path = i + max(0, shift), j + max(0, -shift), 0, 0, []
            high, end = None, 0
            while x < len(a) and y < len(b):
                path.append(a[x] == b[y])
                value += 1 if path[-1] else -2
                high = value if high is None else max(high, value)
                if high - value > 6:
                    break
                if value > best:
                    best, end = value, len(path)
                x, y = x + 1, y + 1
            gain = best - 2 * abs(shift)
            if gain > 0 and (shift == 0 or gain >= 4):
                ways.append((-gain, len(ways), shift, path[:end]))
        if not ways:
            return i, j, common
        _, _, shift, path = min(ways)
        i, j, common = i + max(0, shift) + len(path), j + max(0, -shift) + len(path), common + sum(path)


def test_extension_matches_a_slow_one():
    rng = random.Random(3)
    for _ in range(300):
        a = rng.choices(range(9), k=rng.randint(0, 40))
        b = [x for x in a if rng.random() > 0.1]
        for _ in range(rng.randint(0, 6)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(9))
        got = sd.extend(np.array(a, np.uint32), np.array(b, np.uint32))
        assert got == slow_extend(a, b), (a, b)


def test_syncmers_leave_no_long_run_out():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 1 << 60, n, dtype=np.uint64) for n in (0, 3, 8, 9, 40, 200, 11, 500)]
    found, text, at = sd.syncmers(texts, 8, 4)
    for i, t in enumerate(texts):
        places = [-1, *at[text == i].tolist(), len(t) - 7] if len(t) >= 11 else []
        assert all(b - a <= 4 for a, b in zip(places, places[1:], strict=False))
        alone = sd.syncmers([t], 8, 4)
        assert alone[0].tolist() == found[text == i].tolist() and alone[2].tolist() == at[text == i].tolist()


def test_passages_against_brute_force(spark):
    """Exact passages of fifty words that an earlier document has, among periodic and hot texts.

    Ends too short for a seed of their own may be lost where the rest has an earlier source.
    """
    rng = random.Random(21)
    vocab = [f"v{i}" for i in range(60)]
    some = lambda n: rng.choices(vocab, k=n)
    line, hot = some(14), some(70)
    docs = []
    for i in range(60):
        parts = [some(rng.randint(0, 120)) for _ in range(2)]
        middle = rng.choice([line * 6, hot, ["again"] * 120, some(10), hot[:49], docs[rng.randrange(i)][:90] if i else []])
        docs.append([*parts[0], *middle, *parts[1]])
    out = passages(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")).collect()
    covered = defaultdict(set)
    for r in out:
        covered[r["doc_id"]] |= set(range(r["passage_start"], r["passage_end"]))
    met = set()
    for i, d in enumerate(docs):
        runs = {tuple(d[p : p + 50]) for p in range(len(d) - 49)}
        want = {w for p in range(len(d) - 49) if tuple(d[p : p + 50]) in met for w in range(p, p + 50)}
        inner = {w for w in want if want >= set(range(w - 11, w + 12))}
        assert inner <= covered[i], (i, sorted(inner - covered[i]))
        met |= runs


def test_runs_are_the_union_of_pieces():
    rng = random.Random(5)
    for _ in range(100):
        pieces = sorted((a, a + rng.randint(1, 30), 7, rng.randint(0, 9), 40, rng.randint(1, 9)) for a in rng.choices(range(300), k=rng.randint(0, 20)))
        runs = sd.joined_runs(pieces)
        near = {w for a, b, *_ in pieces for w in range(a, b)}
        assert near <= {w for a, b, *_ in runs for w in range(a, b)} and sum(r[2] for r in runs) == len(pieces)
        assert all(b[0] > a[1] + sd.JOIN_GAP for a, b in zip(runs, runs[1:], strict=False))


def test_chain_kernels():
    assert sorted(map(sorted, chains(np.array([1, 5, 9, 12]), np.array([3, 7, 900, 13])))) == [[0, 1, 3], [2]]
    rng = random.Random(1)
    for _ in range(100):
        a, b = (rng.choices(range(4), k=rng.randint(0, 9)) for _ in range(2))
        best = max((n for n in range(len(a) + 1) for c in itertools.combinations(a, n) if _inside(c, b)), default=0)
        assert common_length(a, b) == best
    assert cut_words(" a b\n c d ", [(0, 1), (3, 4)]) == " b\n c "


def _inside(c, b):
    it = iter(b)
    return all(x in it for x in c)


def test_hilbert_neighbours_touch():
    grid = np.array(list(itertools.product(range(8), repeat=3)))
    path = grid[np.argsort(hilbert_keys(grid, 3))]
    assert len(set(hilbert_keys(grid, 3).tolist())) == 512
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_nearest_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 16)).astype(np.float32) * rng.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(3000, None, 1), (3020, [0.0] * 16, 1), (3040, [float("nan")] * 16, 1), (3060, [1.0, None] * 8, 1), (3080, [1.0], 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score int").repartition(4)
    out = defaultdict(list)
    for r in nearest(df).collect():
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(out) == list(range(0, 3000, 20))
    d, hits = x.astype(float), 0
    for q, found in out.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in {f[1] for f in found}
        assert all(abs(s - d[q] @ d[i]) < 1e-9 for _, i, s in found)
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(found, found[1:]))
        true = np.argsort(-(d @ d[q]), kind="stable")
        hits += len({f[1] for f in found} & set(true[true != q][:20].tolist()))
    assert hits / (20 * len(out)) >= 0.9
    few = nearest(spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>, score int")).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4]
    assert nearest(df.limit(0)).collect() == []


@pytest.mark.parametrize("common", [[], [3, 7]])
def test_seeds_meet_their_first_occurrence_in_one_exchange(spark, common):
    rng = random.Random(5)
    rows = [(rng.randrange(12), rng.randrange(-9, 9), n) for n in range(300)]
    first = {}
    for seed, doc, at in sorted(rows):
        first.setdefault(seed, (doc, at))
    want = sorted((doc, at, *first[seed]) for seed, doc, at in rows if doc != first[seed][0])
    seeds = spark.createDataFrame(rows, "seed long, doc_id long, at int")
    found = sd.seed_matches(seeds, spark.createDataFrame([(c,) for c in common], "seed long"))
    plan = found._jdf.queryExecution().executedPlan().toString()  # not run yet: no plan of before and after in it
    assert "bloom" not in plan.lower() and plan.count("Exchange hashpartitioning(seed") == 1
    assert sorted(map(tuple, found.collect())) == want


def test_passages_are_the_same_with_common_seeds_apart(spark, monkeypatch):
    rng = random.Random(8)
    line, vocab = [f"c{i}" for i in range(60)], [f"w{i}" for i in range(900)]
    rows = [(d, " ".join(rng.choices(vocab, k=80) + line + rng.choices(vocab, k=70))) for d in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(map(tuple, passages(docs).collect()))
    assert len(plain) == 39
    monkeypatch.setattr(sd, "HOT_SHARE", 2)
    monkeypatch.setattr(sd, "HOT_ROWS", 8)
    monkeypatch.setattr(sd, "MOST_HOT", 10_000)
    assert sd.common_seeds(docs, sd.K, sd.INNER).count() > 0
    assert sorted(map(tuple, passages(docs).collect())) == plain


def test_workers_drop_what_other_operators_held():
    from tidemark.llm.common import tidy, worker_cache

    own, other = worker_cache("one"), worker_cache("another")
    own["table"] = other["table"] = [0]
    assert list(tidy(lambda batches: batches, "one")(iter("ab"))) == ["a", "b"]
    assert own == {"table": [0]} and other == {}
    assert list(tidy(lambda batches: batches)(iter(""))) == [] and own == {}


def test_texts_are_hashed_in_small_parts(spark, monkeypatch):
    from tidemark.llm import packing

    seen = []
    monkeypatch.setattr(sd, "slices", lambda column, most: seen.append(most) or packing.slices(column, most))
    texts = [" ".join(f"w{i * j % 997}" for j in range(3000)) for i in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(texts)], names=["doc_id", "text"])

    class Rows:
        sparkSession = spark
        mapInArrow = staticmethod(lambda build, schema: list(build(iter([batch]))))

    parts = sd.seed_rows(Rows, sd.K, sd.INNER)
    assert seen == [sd.PART_BYTES] and sd.PART_BYTES <= 1 << 19 and len(parts) > 1
    found, text, _ = sd.syncmers(sd.hashed_words(batch.column(1)), sd.K, sd.INNER)
    assert sorted(zip(np.concatenate([p.column(0).to_numpy() for p in parts]), np.concatenate([p.column(1).to_numpy() for p in parts]))) == sorted(
        zip(found.view(np.int64), text)
    )
