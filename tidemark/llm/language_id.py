"""Language identification with a blended-spectrum string kernel.

The kernel of two texts is the mean, over n-gram orders, of the cosine of their sets of character
n-grams (presence, not counts), n-grams being hashed into fixed ranges. A bounded sample of labelled
documents gives Nystroem landmarks and training rows; kernel ridge regression, one against the rest,
is solved on the Nystroem features. As the kernel is a scalar product of presence vectors, landmarks,
whitening and ridge weights fold into one matrix; texts are scored by products of batches of their
vectors with it. Whole texts are read.

The sample: at most ``ROWS_A_LANGUAGE`` documents of each label, those of the smallest id hashes, among
documents outside the held-out fold, for the ``LANGUAGES`` labels of most documents (ties: the smaller
label); these bounds are parameters.

``accept_languages`` drops texts of no learned language: those without a letter, and those of whose
character pairs too few are known in the language predicted. What is too few is fitted on the sample,
one half against the other.

Edge cases: a text that is null or has no letter is ``und`` with score 1; a null doc_id is never
trained on nor held out; without any training row all texts are ``und``; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ship, tidy

ORDERS = (1, 2, 3, 4)
RANGE_BITS = 13
ROWS_A_LANGUAGE = 250
LANDMARKS_A_LANGUAGE = 48
LANGUAGES = 400
RIDGE = 1e-3
BATCH = 128
UNDETERMINED = "und"
WIDTH = len(ORDERS) << RANGE_BITS
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def presence(text: str | None) -> np.ndarray | None:
    """Sorted indices of the n-grams of a text, all orders; None without a letter.

    Text is lower-cased; each run of other characters than letters is one blank.
    """
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    points = np.where(letter, points, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    points = np.concatenate([[32], points[keep], [32]]).astype(np.uint64)
    seen = np.zeros(WIDTH, bool)
    grams = np.zeros(len(points), np.uint64)
    for k, n in enumerate(ORDERS):
        if len(points) < n:
            break
        grams = (grams[: len(points) - n + 1] + points[n - 1 :] + np.uint64(n)) * MULTIPLIER
        grams ^= grams >> np.uint64(29)
        seen[(grams >> np.uint64(64 - RANGE_BITS)).astype(np.int64) + (k << RANGE_BITS)] = True
    return np.flatnonzero(seen).astype(np.int32)


def vectors(found: list[np.ndarray]) -> np.ndarray:
    """Rows whose scalar products are the kernel."""
    out = np.zeros((len(found), WIDTH), np.float32)
    for row, at in zip(out, found, strict=True):
        row[at] = 1
        for k in range(len(ORDERS)):
            part = row[k << RANGE_BITS : (k + 1) << RANGE_BITS]
            if n := part.sum():
                part /= np.sqrt(n * len(ORDERS))
    return out


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    known: np.ndarray  # pairs that the sample has, by language
    least_known: float  # the share of a text's pairs that texts of the language have

    def familiar(self, found: np.ndarray, language: int) -> bool:
        """Whether a text's pairs are those of the language; a few may always be new."""
        pairs = _pairs(found)
        new = len(pairs) - int(self.known[language][pairs].sum())
        return new < FEW or new <= (1 - self.least_known) * len(pairs)

    def predict(self, found: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
        values = vectors(found) @ self.weights + self.bias
        best = values.argmax(axis=1)
        top = values[np.arange(len(best)), best]
        return [self.languages[b] for b in best], np.clip((top + 1) / 2, 0, 1).astype(float)


PAIRS = slice(ORDERS.index(2) << RANGE_BITS, (ORDERS.index(2) + 1) << RANGE_BITS)
FEW = 4


def _pairs(found: np.ndarray) -> np.ndarray:
    return found[(found >= PAIRS.start) & (found < PAIRS.stop)] - PAIRS.start


def known_pairs(found: list[np.ndarray], labels: list[str], languages: list[str]) -> np.ndarray:
    out = np.zeros((len(languages), 1 << RANGE_BITS), bool)
    for f, label in zip(found, labels, strict=True):
        out[languages.index(label), _pairs(f)] = True
    return out


def least_known(found: list[np.ndarray], labels: list[str], languages: list[str]) -> float:
    """Three quarters of what all but a hundredth of one half's texts have of their pairs in the other half."""
    shares = [1.0]
    for half in (0, 1):
        known = known_pairs(found[half::2], labels[half::2], languages)
        for f, label in zip(found[1 - half :: 2], labels[1 - half :: 2], strict=True):
            pairs = _pairs(f)
            if len(pairs) > 20:
                shares.append(known[languages.index(label), pairs].mean())
    return 0.75 * float(np.quantile(shares, 0.01))


def train(found: list[np.ndarray], labels: list[str]) -> Model:
    """Landmarks are the first rows of each label; the rest is linear algebra."""
    languages = sorted(set(labels))
    chosen: list[int] = []
    for lang in languages:
        chosen += [i for i, x in enumerate(labels) if x == lang][:LANDMARKS_A_LANGUAGE]
    rows = vectors(found)
    marks = rows[chosen]
    values, axes = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > values.max() * 1e-6
    whiten = axes[:, good] / np.sqrt(values[good])
    features = (rows @ marks.T).astype(np.float64) @ whiten
    targets = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # Labels count alike, however many rows each has.
    weight = np.array([1.0 / labels.count(x) for x in languages])[[languages.index(x) for x in labels]]
    mean_x, mean_y = np.average(features, axis=0, weights=weight), np.average(targets, axis=0, weights=weight)
    x, y = features - mean_x, targets - mean_y
    gram = (x * weight[:, None]).T @ x + RIDGE * np.eye(x.shape[1])
    solved = np.linalg.solve(gram, (x * weight[:, None]).T @ y)
    weights = marks.T.astype(np.float64) @ (whiten @ solved)
    bias = mean_y - mean_x @ solved
    known = known_pairs(found, labels, languages), least_known(found, labels, languages)
    return Model(languages, weights.astype(np.float32), bias.astype(np.float32), *known)


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit(df: DataFrame, rows_a_language: int = ROWS_A_LANGUAGE, languages: int = LANGUAGES) -> Model | None:
    """Train on documents outside fold 0 that have a label and a letter."""
    ship(df.sparkSession)
    labelled = df.selectExpr("cast(doc_id as bigint) doc_id", "cast(lang as string) lang", "cast(text as string) text").where(
        (fold_of(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    most = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).select("lang")
    # Bounded by the parameters: languages * rows_a_language ids and languages labels.
    chosen = (
        labelled.select("lang", "doc_id")
        .join(F.broadcast(most), "lang")
        .withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= rows_a_language)
        .select("doc_id")
        .distinct()
    )
    # Repeated ids give one row.
    picked = labelled.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("x"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [presence(t) for t in batch.column(2).to_pylist()]
            raw = pa.array([None if f is None else f.tobytes() for f in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), raw], names=["doc_id", "lang", "found"])

    rows = picked.select("doc_id", "x.lang", "x.text").mapInArrow(sparse, "doc_id long, lang string, found binary").collect()
    rows = sorted((r for r in rows if r["found"] is not None), key=lambda r: (hash_order(r["doc_id"]), r["doc_id"]))
    return train([np.frombuffer(r["found"], np.int32) for r in rows], [r["lang"] for r in rows]) if rows else None


def hash_order(doc_id: int) -> int:
    return (doc_id * 0x9E3779B97F4A7C15) & (2**64 - 1)


def identify(df: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row; the model is trained on df if none is given."""
    ship(df.sparkSession)
    model = model or fit(df)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
    rows = df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(fold_of(F.col("doc_id").cast("long")) == 0, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed width, and a column per language

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            langs = [UNDETERMINED] * batch.num_rows
            scores = np.ones(batch.num_rows)
            at: list[int] = []
            found: list[np.ndarray] = []

            def flush() -> None:
                if found:
                    names, values = model.predict(found)
                    for i, name, value in zip(at, names, values, strict=True):
                        langs[i], scores[i] = name, value
                    at.clear()
                    found.clear()

            for i, text in enumerate(batch.column(2)):
                grams = presence(text.as_py()) if model else None
                if grams is not None:
                    at.append(i)
                    found.append(grams)
                    if len(found) == BATCH:
                        flush()
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores)], schema=schema
            )

    return rows.mapInArrow(tidy(predict), "doc_id long, held_out boolean, lang_pred string, score double")


def accept_languages(df: DataFrame, model: Model | None = None) -> DataFrame:
    """df without documents whose language can't be told: no letters, or pairs of letters of none learned.

    Rows of one doc_id are told apart by nothing: each text counts by itself. Null and empty texts go.
    """
    ship(df.sparkSession)
    model = model or fit(df)
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index("text")

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                found = [presence(t.as_py()) if model else None for t in part.column(at)]
                some = [i for i, f in enumerate(found) if f is not None]
                keep = np.zeros(len(found), bool)
                if some:
                    names, _ = model.predict([found[i] for i in some])
                    keep[some] = [model.familiar(found[i], model.languages.index(n)) for i, n in zip(some, names, strict=True)]
                yield part.filter(pa.array(keep))

    return df.mapInArrow(tidy(accept), df.schema)
