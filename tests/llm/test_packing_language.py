import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm.distinct_words import content
from tidemark.llm.language_id import RIDGE, accept_languages, fit, identify, presence, train, vectors
from tidemark.llm.packing import HierarchicalPacker, WordEncoder, balanced_groups, pack_documents, split_words

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello, World! it's 2024 — naïve café\tΣΑΣ", "", None, " \n ", "日本語 text", "a\x1cb <|endoftext|> c d\x85e",
    "word " * 5000, "x" * 3000, "don't  stoṕ ｆｕｌｌ",
]


def direct(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def test_word_encoder_equals_tokenizer():
    encoder = WordEncoder(PATH, words_held=3)
    for _ in range(2):
        for text, ids in zip(TEXTS, encoder.encode([t or "" for t in TEXTS]), strict=True):
            assert ids.tolist() == direct(text)
    assert encoder.encode([]) == []


def test_words_of_a_batch_are_found_once_and_split_as_by_the_tokenizer(monkeypatch):
    """Arrow's texts with nulls, cut out of a longer array; every white space and what only looks like it."""
    blanks = [0x20, *range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    others = [0x1C, 0x1D, 0x1E, 0x1F, 0x180E, 0x200B, 0x2060, 0x2011, 0x3001, 0xFEFF, 0xA1, 0xC5, 0x1685]
    texts = ["skipped", *(f"{chr(c)}no{chr(c)}{chr(c)}nö, no{chr(c)}" for c in blanks + others), None, "no", "no nö", "", "  ", "no"]
    array = pa.array(texts)[1:]
    encoder = WordEncoder(PATH)
    learned = []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda words: learned.append(list(words)) or learn(words))
    for text, ids in zip(texts[1:], encoder.encode(array), strict=True):
        assert ids.tolist() == direct(text), ascii(text)
    (words,) = learned
    assert len(words) == len(set(words)) and {"no", "nö,"} <= set(words)
    body, start, n_words = split_words(*content(array))
    found = [bytes(w).decode() for w in np.split(body, start[1:])]
    assert sum(n_words) == len(found) and set(found) == set(words) and n_words[-6:].tolist() == [0, 1, 2, 0, 0, 1]
    assert encoder.encode(pa.array([], pa.string())) == [] and [x.tolist() for x in encoder.encode(["", None])] == [[1], [1]]


def test_packer_fills_every_sequence():
    rng = random.Random(1)
    packer = HierarchicalPacker(window_tokens=20000)
    seen, closed = defaultdict(list), []
    sizes = [rng.choice([1, 3, 200, 700, 1500, 2048, 5000, 9000]) + rng.randint(0, 60) for _ in range(300)]
    for d, n in enumerate(sizes):
        packer.add((d, n), np.arange(n, dtype=np.uint32))
        closed += packer.drain()
        assert packer.held < 20000 + 2048
    closed += packer.drain(last=True)
    for size, pieces in closed:
        assert size & (size - 1) == 0 and sum(p.length for p in pieces) == size <= 2048
        for p in pieces:
            assert p.ids.tolist() == list(range(p.start, p.start + p.length))
            seen[p.doc[0]] += p.ids.tolist()
    assert all(sorted(seen[d]) == list(range(n)) for d, n in enumerate(sizes))
    groups = balanced_groups([5, 1, 4, 2, 3, 3], 2)
    assert sorted(groups) == [0, 0, 1, 1, 2, 2]


def test_pack_documents(spark):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(None, "null id", "s"), (0, TEXTS[0], "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(2)
    out = pack_documents(df, PATH, with_ids=True).collect()
    places, pieces = defaultdict(list), defaultdict(list)
    for r in out:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], r["ids"], r["doc_tokens"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= 2048
    for doc_id, text, _ in rows[:-1]:
        if doc_id != 0:
            ids = [x for _, part, _ in sorted(pieces[doc_id]) for x in part]
            assert ids == direct(text) and {n for *_, n in pieces[doc_id]} == {len(ids)}
    assert sum(r["length"] for r in out if r["doc_id"] == 0) == 2 * len(direct(TEXTS[0]))
    assert pack_documents(df.limit(0), PATH).collect() == []


def test_language_id(spark):
    rng = random.Random(2)
    words = {"aa": "ka la ma na pa".split(), "bb": "io eu ai ou ei".split(), "cc": "strk brt krn ptt".split()}
    rows = [(i, " ".join(rng.choices(words[lang], k=30)), lang, lang) for i in range(300) for lang in [rng.choice("aa bb cc".split())]]
    extra = [(1000, None, "aa", None), (1001, "123 ?!", "aa", None), (None, rows[0][1], None, None), (1002, rows[1][1] * 300, None, "lang_pred")]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, score string")
    out = {r["doc_id"]: r for r in identify(df).collect()}
    assert len(out) == 304
    assert all(out[i]["lang_pred"] == lang for i, _, lang, _ in rows if out[i]["held_out"])
    assert {i for i, r in out.items() if r["held_out"]} == {i for i in out if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    assert out[1000]["lang_pred"] == out[1001]["lang_pred"] == "und" and out[1002]["lang_pred"] == rows[1][2]
    assert out[None]["lang_pred"] == rows[0][2] and all(0 <= r["score"] <= 1 for r in out.values())
    bare = identify(df.where("text is null"))
    assert [r["lang_pred"] for r in bare.collect()] == ["und"] and fit(df.limit(0)) is None


def test_kernel_is_mean_cosine_of_presence():
    a, b = presence("abc abc"), presence("ABC! abd")
    k = float((vectors([a]) @ vectors([b]).T)[0, 0])
    def grams(t, n):
        return {t[i : i + n] for i in range(len(t) - n + 1)}
    want = 0
    for n in (1, 2, 3, 4):
        x, y = grams(" abc abc ", n), grams(" abc abd ", n)
        want += len(x & y) / (len(x) * len(y)) ** 0.5 / 4
    assert abs(k - want) < 1e-6


def toy_rows(n, seed=2):
    rng = random.Random(seed)
    words = {"aa": "ka la ma na pa".split(), "bb": "io eu ai ou ei".split(), "cc": "strk brt krn ptt".split()}
    return [(" ".join(rng.choices(words[lang], k=rng.randint(3, 30))), lang) for lang in words for _ in range(n)]


def test_ridge_matches_a_direct_solution():
    """With every row a landmark the features span the kernel: the same least squares by another way."""
    rows = toy_rows(30)
    found = [presence(t) for t, _ in rows]
    model = train(found, [lang for _, lang in rows])
    x = vectors(found).astype(float)
    k = x @ x.T
    values, axes = np.linalg.eigh(k)
    root = axes * np.sqrt(np.maximum(values, 0))  # k = root root'
    y = np.array([[1.0 if lang == c else -1.0 for c in ("aa", "bb", "cc")] for _, lang in rows])
    w = np.sqrt(np.full(len(rows), 1 / 30))[:, None]
    upper = np.hstack([w * root, w])
    lower = np.hstack([np.sqrt(RIDGE) * np.eye(len(rows)), np.zeros((len(rows), 1))])
    solved, *_ = np.linalg.lstsq(np.vstack([upper, lower]), np.vstack([w * y, np.zeros((len(rows), 3))]), rcond=None)
    direct = root @ solved[:-1] + solved[-1]
    got = x @ model.weights.astype(float) + model.bias
    assert np.abs(direct - got).max() < 1e-2


def test_foreign_texts_are_rejected(spark):
    rows = [(i, t, lang, "m") for i, (t, lang) in enumerate(toy_rows(60))]
    foreign = ["\u05e9\u05dc\u05d5\u05dd \u05e2\u05d5\u05dc\u05dd \u05d6\u05d4 \u05d8\u05e7\u05e1\u05d8", "qxz vwj hgf dcy xqw zvj", "\u3053\u308c\u306f\u65e5\u672c\u8a9e\u306e\u6587\u3067\u3059"]
    extra = [(1000 + i, t, None, None) for i, t in enumerate(foreign)] + [(1, None, None, None), (2, "", "", ""), (3, "123", "aa", ""), (None, rows[0][1], None, None)]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, score string")
    left = accept_languages(df).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in left if r["doc_id"] is not None) == [(False, i) for i in range(180)]
    assert sum(r["doc_id"] is None for r in left) == 1
    assert accept_languages(df.limit(0)).collect() == [] and accept_languages(df).columns == df.columns


def test_ties_go_to_the_first_language():
    model = train([presence("abc"), presence("abc")], ["y", "x"])
    assert model.predict([presence("abc")])[0] == ["x"]


def test_held_out_accuracy_by_length(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    true = {r["doc_id"]: (r["lang"], r["n"]) for r in table.selectExpr("doc_id", "lang", "length(text) n").collect()}
    out = [r for r in identify(table).collect() if r["held_out"] and true[r["doc_id"]][0] and r["lang_pred"] != "und"]
    for low, high, least in ((0, 100, 0.7), (100, 2000, 0.97), (2000, 10**9, 0.97)):
        own = [r["lang_pred"] == true[r["doc_id"]][0] for r in out if low <= true[r["doc_id"]][1] < high]
        assert len(own) < 3 or np.mean(own) >= least, (low, len(own), np.mean(own))
