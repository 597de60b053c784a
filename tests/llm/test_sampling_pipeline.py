import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import sampling
from tidemark.llm.sampling import Pieces, sample_batch, sample_segmentations

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def all_segmentations(word, weights):
    if not word:
        return [((), 0.0)]
    return [
        ((word[:n], *rest), weights[word[:n]] + p)
        for n in range(1, len(word) + 1)
        if word[:n] in weights
        for rest, p in all_segmentations(word[n:], weights)
    ]


def test_sampling_without_replacement_is_exact():
    pieces = Pieces(MODEL)
    weights = {pieces.text[i]: w for _, ids, ws in pieces.of_length.values() for i, w in zip(ids, ws, strict=True)}
    word = pieces.normalize("abc")
    ways = all_segmentations(word, weights)
    total = sum(math.exp(p) for _, p in ways)
    p = {s: math.exp(w) / total for s, w in ways}
    n = 6000
    drawn = [[(tuple(pieces.text[i] for i in ids), log_p, v, q) for ids, log_p, v, q in r]
             for r in sample_batch([word] * n, np.arange(n, dtype=np.uint64) * 77, pieces, 3)]
    first, second = Counter(r[0][0] for r in drawn), Counter(r[1][0] for r in drawn)
    for s in p:
        after = sum(p[a] * p[s] / (1 - p[a]) for a in p if a != s)
        for seen, want in ((first[s], p[s]), (second[s], after)):
            assert abs(seen / n - want) < 4 * math.sqrt(want * (1 - want) / n) + 1e-3
    assert all(len({s[0] for s in r}) == 3 and r[0][2] >= r[1][2] >= r[2][2] for r in drawn)
    assert all(abs(s[1] - math.log(p[s[0]])) < 1e-9 for r in drawn[:50] for s in r)
    assert abs(np.mean([sum(math.exp(s[1] - s[3]) for s in r) for r in drawn]) - 1) < 0.01


def test_words_are_sampled_as_one_text():
    """Two words and a repeated one: inclusion of every segmentation of the whole text, by enumeration."""
    pieces = Pieces(MODEL)
    weights = {pieces.text[i]: w for _, ids, ws in pieces.of_length.values() for i, w in zip(ids, ws, strict=True)}
    text = pieces.normalize("ab c")
    words = [m for m in ("\u2581ab", "\u2581c")]
    assert text == "".join(words)
    ways = [()], [0.0]
    for w in words:
        own = all_segmentations(w, weights)
        ways = [a + b for a in ways[0] for b, _ in own], [x + y for x in ways[1] for _, y in own]
    total = np.logaddexp.reduce(ways[1])
    p = {s: math.exp(x - total) for s, x in zip(*ways, strict=True)}
    n, k = 8000, 3
    drawn = sample_batch([text] * n, np.arange(n, dtype=np.uint64) * 13, pieces, k)
    seen, weight = Counter(), Counter()
    for row in drawn:
        found = [tuple(pieces.text[i] for i in ids) for ids, *_ in row]
        assert len(set(found)) == min(k, len(p))
        for s, (_, log_p, _, inclusion) in zip(found, row, strict=True):
            assert abs(log_p - math.log(p[s])) < 1e-9
            seen[s] += 1
            weight[s] += math.exp(-inclusion)
    for s in p:  # an inclusion score is the chance to be in the sample, so its inverse weighs the samples to one
        spread = math.sqrt(max(1.0, weight[s] / max(1, seen[s])) / n)
        if p[s] > 1e-3:
            assert abs(weight[s] / n - 1) < 6 * spread + 0.05, (s, p[s], weight[s] / n)


def test_all_segmentations_of_a_rare_tail_are_given():
    """More samples than segmentations: all of them, however small the last ones' mass."""
    pieces = Pieces(MODEL)
    weights = {pieces.text[i]: w for _, ids, ws in pieces.of_length.values() for i, w in zip(ids, ws, strict=True)}
    for word in ("abc", "the", "zq"):
        text = pieces.normalize(word)
        ways = all_segmentations(text, weights)
        (row,) = sample_batch([text], np.array([5], np.uint64), pieces, len(ways) + 3)
        assert sorted(tuple(pieces.text[i] for i in ids) for ids, *_ in row) == sorted(s for s, _ in ways)
        assert all(inclusion == 0 for *_, inclusion in row)


def test_rows_do_not_depend_on_their_batch():
    pieces = Pieces(MODEL)
    texts = [pieces.normalize(t) for t in ["the quick brown fox " * 90, "a", "", "\u65e5\u672c x\u00f6", "zzz " * 400, "Hello there"]]
    keys = np.array([3, 9, 27, 81, 243, 729], np.uint64)
    together = list(sample_batch(texts, keys, pieces, 4))
    for i, row in enumerate(together):
        (alone,) = sample_batch(texts[i : i + 1], keys[i : i + 1], pieces, 4)
        assert [(a.tolist(), *x) for a, *x in alone] == [(a.tolist(), *x) for a, *x in row]


def test_sample_segmentations(spark):
    texts = ["Hello  wörld\n日本 \U0001f9ea", "", None, "a", "x" * 3000, "the quick brown fox " * 800, "tab\there\x00\x7f"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "null", "s"), (0, texts[0], "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sample string").repartition(3)
    out = sample_segmentations(df, MODEL, with_ids=True).collect()
    by = defaultdict(list)
    for r in out:
        assert r["decodes"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        assert r["n_pieces"] == len(r["ids"]) and r["log_inclusion"] <= 0
        by[r["doc_id"]].append(tuple(r["ids"]))
    assert [len(by[i]) for i in (1, 2, 3)] == [1, 1, 2] and by[1] == [()]
    assert all(len(set(by[i])) == 3 for i in (4, 5, 6)) and len(by[0]) == 6 and len(set(by[0])) == 3
    again = sample_segmentations(df.coalesce(1), MODEL).collect()
    key = lambda r: (str(r["doc_id"]), r["sample"], r["ids_crc32"])
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert sample_segmentations(df.limit(0), MODEL).collect() == []


def test_pipeline_stages(spark):
    import random

    import corpus_pipeline as cp

    rng = random.Random(4)
    words = [a + b + c for a in "bdkmnprst" for b in "aeiou" for c in "lmnrst"]
    other = [a + b for a in ("sch", "zw", "pf") for b in ("ü", "ö", "ä", "ei")]
    text = lambda v, n: " ".join(rng.choices(v, k=n))
    docs = {i: [text(words, 120), "aa"] for i in range(40)} | {i: [text(other, 120), "bb"] for i in range(40, 80)}
    shared = text(words, 80)
    docs[80], docs[81] = [docs[3][0].replace(" ", "  "), "aa"], [docs[3][0] + " added", "aa"]
    docs[82], docs[83] = [text(words, 60) + " " + shared, "aa"], [shared + " " + text(words, 70), "aa"]
    docs[84], docs[85] = ["12 34", None], [None, None]
    rows = [(i, t, lang, "s", 0 if t is None else len(t)) for i, (t, lang) in docs.items()]
    stage = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = []
    for name, f in cp.STAGES[:-1]:
        from tidemark.llm.common import materialize

        stage = materialize(f(spark, stage, ""), f"test-{name}")
        assert stage.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r["doc_id"]: r["text"] for r in stage.collect()})
    # Brute force: what each stage leaves of its own input.
    want = {i: t for i, (t, _) in docs.items() if i not in (84, 85)}
    assert kept[0] == want
    del want[80]
    assert kept[1] == want
    del want[81]
    assert kept[2] == want
    want[83] = want[83][len(shared) + 1 :]
    assert kept[3] == want
    packed = cp.STAGES[-1][1](spark, stage, "").collect()
    assert {r["doc_id"] for r in packed} == set(want)


def test_pipeline_stages_with_odd_tables(spark):
    """Repeated rows, ids with several texts, clashing names, empty tables: a defined result, no crash."""
    import random

    import corpus_pipeline as cp

    rng = random.Random(9)
    words = [a + b for a in "bdkmnprst" for b in ("an", "er", "is", "ol")]
    text = lambda n: " ".join(rng.choices(words, k=n))
    shared = text(90)
    docs = [(i, text(100)) for i in range(30)]
    docs += [(40, text(30) + " " + shared), (41, shared + " " + text(40)), (41, "zz short"), (41, shared + " " + text(40)), (None, text(20)), (None, None)]
    docs += [docs[3], docs[3], (50, ""), (51, None), (52, text(20_000))]
    schema = "doc_id long, text string, lang string, row long, file string, c1 string, ranges string, at string, component_id long, _metadata string"
    rows = [(i, t, "aa", 1, "f", "c", None, "a", 7, "m") for i, t in docs]
    df = spark.createDataFrame(rows, schema).repartition(3)
    for name, f in cp.STAGES[:-1]:
        assert f(spark, df.limit(0), "").collect() == [], name
        out = f(spark, df, "")
        assert out.columns == df.columns, name
        got = out.collect()
        assert all(r["row"] == 1 and r["_metadata"] == "m" and r["component_id"] == 7 for r in got)
        texts = {(r["doc_id"], r["text"]) for r in got}
        if name == "substring_dedup":
            least = min(t for i, t in docs if i == 41)  # of several texts of an id only the least is looked at
            assert {t for i, t in texts if i == 41} == {least if not least.startswith(shared) else least[len(shared) + 1 :]} | {t for i, t in docs if i == 41 and t != least}
            assert len(got) == len(docs)
        if name == "exact_dedup":
            assert len(got) == len(docs) - 2 - 2  # a row met again, and null texts are empty
        if name == "language_id":
            assert len(got) == sum(bool(t) and t != "zz short" for _, t in docs)  # its pairs of letters are new
    assert cp.STAGES[-1][1](spark, df.limit(0), "").collect() == []
    assert {r["doc_id"] for r in cp.STAGES[-1][1](spark, df, "").collect()} == {i for i, _ in docs}


def test_pipeline_stages_begin_with_unused_heap_given_back(spark, monkeypatch):
    import corpus_pipeline as cp

    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    for _ in range(12):
        jvm.java.nio.ByteBuffer.allocate(50_000_000)  # garbage
    grown = runtime.totalMemory()
    cp.release_heaps(spark)
    assert runtime.totalMemory() < grown

    class Begun(Exception):
        pass

    def begun(spark):
        raise Begun

    monkeypatch.setattr(cp, "release_heaps", begun)
    for _, stage in cp.STAGES:
        with pytest.raises(Begun):
            stage(spark, None, "")


def test_lattices_of_recurring_words_are_built_once(monkeypatch):
    """Batches that share held lattices give what each gives alone, bit by bit."""
    pieces = Pieces(MODEL)
    built = []
    lattice = sampling._lattice
    monkeypatch.setattr(sampling, "_lattice", lambda words, p: built.extend(words) or lattice(words, p))
    vocab = [f"word{i * 37 % 101}x" for i in range(60)] + ["日本", "a\u2028b"]
    batches = [[pieces.normalize(" ".join(vocab[(i * b + j) % len(vocab)] for j in range(25 + i))) for i in range(5)] + [""] for b in range(1, 7)]
    keys = np.arange(6, dtype=np.uint64)
    held, texts = sampling.Lattices(), 0
    together = [list(sample_batch(b, keys, pieces, 3, held)) for b in batches]
    assert max(built.count(w) for w in built) == 2 and held.held[0] > 40
    built.clear()
    for own, b in zip(together, batches, strict=True):
        for x, y in zip(own, sample_batch(b, keys, pieces, 3), strict=True):
            assert [(c[0].tolist(), *c[1:]) for c in x] == [(c[0].tolist(), *c[1:]) for c in y]
            texts += 1
    assert texts == 36
    monkeypatch.setattr(sampling, "MOST_HELD_ARCS", 0)
    none = sampling.Lattices()
    assert [len(list(sample_batch(b, keys, pieces, 3, none))) for b in batches] == [6] * 6 and none.held == (0, 0, 0)


def test_words_are_split_as_by_the_pattern():
    for text in ("", "▁", "a", "▁a▁b", "a▁", "▁▁a▁b", "a▁▁", "▁a\n▁b", "x▁é\u2028▁y"):
        assert sampling.split_words(text) == sampling.WORDS.findall(text)


def test_repeated_words_are_numbered_as_one(monkeypatch):
    """Only the distinct words of a batch become strings; each place still has its own word."""
    pieces = Pieces(MODEL)
    seen = []
    numbered = sampling.Lattices.numbered
    monkeypatch.setattr(sampling.Lattices, "numbered", lambda self, words, p: seen.append(list(words)) or numbered(self, words, p))
    texts = [pieces.normalize(t) for t in ("one two one\none", "", "two  one", "日本 two", "one")] + ["▁", "▁▁two▁"]
    rows = list(sample_batch(texts, np.arange(7, dtype=np.uint64), pieces, 2))
    assert len(seen) == 1 and len(seen[0]) == len(set(seen[0]))
    assert set(seen[0]) == {w for t in texts for w in sampling.WORDS.findall(t)}
    for text, row in zip(texts, rows, strict=True):
        for chosen, *_ in row:
            assert pieces.decode(sampling.spelled(chosen, pieces)[0]) == text


def test_first_steps_tell_the_best_siblings(monkeypatch):
    """However many steps are looked at first, the samples are the same bit by bit; long texts need only their first ones."""
    pieces = Pieces(MODEL)
    texts = [pieces.normalize(t) for t in ("unbelievable things " * 900, "a b", "x" * 2000, "the quick brown fox " * 30)]
    keys = np.arange(4, dtype=np.uint64) * 5
    out, steps = [], []
    uniforms = sampling._uniform
    for first in (1, 400, 1 << 40):
        monkeypatch.setattr(sampling, "FIRST_STEPS", first)
        drawn = [0]
        monkeypatch.setattr(sampling, "_uniform", lambda k, c, drawn=drawn: drawn.__setitem__(0, drawn[0] + len(k)) or uniforms(k, c))
        out.append([[(a.tolist(), *x) for a, *x in row] for row in sample_batch(texts, keys, pieces, 4)])
        steps.append(drawn[0])
    assert out[0] == out[1] == out[2] and steps[1] < steps[2]
