"""Repeated passages by collinear chaining of shared k-mer seeds.

1. Seeds: those k-word shingles of every whole text whose least inner shingle (by hash) stands first or
   last in them (closed syncmers). The choice depends on the shingle alone, so both texts of a fuzzy
   match choose alike; of ``k - inner`` neighbours one is chosen at least, so any exact run of
   ``2 * k - inner - 1`` words has a seed. All occurrences of a seed come together in one exchange (those
   of very common seeds stay, and their sources are broadcast). Each seed that several documents share is tied to its first
   occurrence (smallest doc_id, then place): one match per occurrence, however many documents share it.
2. Chains: per document and source document, matches in rising order of both places are chained by
   dynamic programming; the score of a chain is its seeds less a cost linear in the gaps, and the best
   predecessor is a prefix maximum in a Fenwick tree over the source's places. A single seed is a chain.
3. Alignment: the words around each chain come from both texts; runs between seeds are aligned by
   bit-parallel longest common subsequences, ends are extended by x-drop over nearby diagonals. A chain
   that isn't similar enough as a whole gives every longest stretch of its alignment that is.
4. Aligned pieces that touch, whatever their source, form a passage; passages of at least
   ``min_words`` words are the result, one row each. As sources are first occurrences, up to ten words
   at a passage's ends, too few for a seed, can be missing where its inside occurred earlier elsewhere. The first occurrence of a passage is never part of it.

Words are runs of other characters than the six ASCII blanks, A-Z lower-cased.

Edge cases: null and blank texts have no seeds; a null doc_id takes no part; rows of one doc_id are one
document, its least text counting; repeats inside one document only are none; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HIT_SETTINGS, HOT_ROWS, MOST_HOT, materialize, settings, ship, tidy
from .ngram_jaccard import MULT, PART_BYTES, U, _id_text, _signed
from .packing import slices
from .word_hash import hashed_words, mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
K, INNER = 8, 4
MIN_WORDS = 50
MAX_GAP, MAX_SHIFT = 60, 20
GAP_COST = 0.01
IDENTITY = 0.8
PAD, GRID = 40, 64
JOIN_GAP = 3
X_DROP, DIAGONALS = 6, 4
HOT_SHARE = 64


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    n = max(0, len(h) - k + 1)
    grams = np.full(n, U(k))
    for j in range(k):
        grams = mix(grams * MULT + h[j : j + n])
    return grams


def syncmers(texts: list[np.ndarray], k: int, inner: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, texts (by number) and places of the chosen shingles of texts given by their word hashes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.concatenate(texts) if len(texts) else np.zeros(0, U)
    n, last = len(flat) - k + 1, k - inner
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    small = _grams(flat, inner)
    least = small[:n]
    for j in range(1, last + 1):
        least = np.minimum(least, small[j : j + n])
    ends = np.cumsum(sizes)
    whole = np.repeat(ends, sizes)[:n] - np.arange(n) >= k  # not over a text's end
    at = np.flatnonzero(whole & (np.minimum(small[:n], small[last : last + n]) == least))
    # A shingle is its inner shingles at both ends, and what they leave out between them.
    found = mix(small[at] * MULT + small[at + last])
    for j in range(inner, last):
        found = mix(found * MULT + flat[at + j])
    # In runs of one repeated word all shingles are one: a seed every k places is enough.
    new = np.ones(len(at), bool)
    new[1:] = (found[1:] != found[:-1]) | (np.diff(at) > 1)
    start = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))] if len(at) else at
    keep = (at - start) % k == 0
    found, at = found[keep], at[keep]
    text = np.searchsorted(ends, at, "right")
    return found, text, at - (ends - sizes)[text]


def seed_rows(docs: DataFrame, k: int, inner: int) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1), PART_BYTES):
                found, text, at = syncmers(hashed_words(batch.column(1)[part]), k, inner)
                ids = batch.column(0)[part].to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [_signed(found), pa.array(ids[text]), pa.array(at.astype(np.int32))], names=["seed", "doc_id", "at"]
                )

    ship(docs.sparkSession)
    return docs.mapInArrow(tidy(build), "seed long, doc_id long, at int")


def common_seeds(docs: DataFrame, k: int, inner: int) -> DataFrame:
    """Seeds that would make a long task, fewer than ``MOST_HOT``. They are told from the documents of one hash in
    ``HOT_SHARE``; a seed not found here only stays with all others, the matches are the same."""
    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(HOT_SHARE)) == 0)
    counted = materialize(seed_rows(part, k, inner).groupBy("seed").count(), "seed-counts")
    total = counted.agg(F.sum("count")).first()[0] or 0
    return counted.where(F.col("count") > max(HOT_ROWS // HOT_SHARE, total // MOST_HOT)).select("seed")


def seed_matches(seeds: DataFrame, common: DataFrame) -> DataFrame:
    """(doc_id, at, source, source_at) of each occurrence of a seed outside the first document that has it.

    All occurrences of a seed come together once, so a source needs no join of its own. Those of common
    seeds stay where they are, and their sources are broadcast.
    """
    from pyspark.sql import Window as W

    spot = F.struct("doc_id", "at")
    # In rising order the first row so far is the first of all.
    by = W.partitionBy("seed").orderBy("doc_id", "at").rowsBetween(W.unboundedPreceding, W.currentRow)
    common = materialize(common, "common-seeds")
    hot = None
    if not common.isEmpty():
        at_home = seeds.join(F.broadcast(common), "seed")
        first = materialize(at_home.groupBy("seed").agg(F.min(spot).alias("first")), "seed-sources")
        hot = at_home.join(F.broadcast(first), "seed")
        seeds = seeds.join(F.broadcast(common), "seed", "left_anti")
    found = seeds.withColumns({"source": F.first("doc_id").over(by), "source_at": F.first("at").over(by)})
    if hot is not None:
        found = found.unionByName(hot.select("seed", "doc_id", "at", F.col("first.doc_id").alias("source"), F.col("first.at").alias("source_at")))
    return found.where(F.col("doc_id") != F.col("source")).select("doc_id", F.col("at").cast("long"), "source", F.col("source_at").cast("long"))


class PrefixMaximum:
    """Fenwick tree: raise a value at a place, ask for the largest value and its owner below a place."""

    def __init__(self, n: int):
        self.best = [(float("-inf"), -1)] * (n + 1)

    def put(self, place: int, value: float, owner: int) -> None:
        i, n, best = place + 1, len(self.best), self.best
        while i < n:
            if best[i][0] < value:
                best[i] = (value, owner)
            i += i & -i

    def below(self, place: int) -> tuple[float, int]:
        out, i, best = (float("-inf"), -1), place, self.best
        while i > 0:
            if best[i][0] > out[0]:
                out = best[i]
            i -= i & -i
        return out


def chains(x: np.ndarray, y: np.ndarray) -> list[list[int]]:
    """Indices of matches (x rising) by chain, best chains first; a match is in one chain at most."""
    n = len(x)
    places = np.unique(y)
    rank = np.searchsorted(places, y)
    tree = PrefixMaximum(len(places))
    score, before = [1.0] * n, [-1] * n
    xs, ys = x.tolist(), y.tolist()
    i = 0
    while i < n:
        j = i
        while j < n and xs[j] == xs[i]:  # matches of one place don't follow each other
            value, owner = tree.below(int(rank[j]))
            if owner >= 0 and (gain := value - GAP_COST * (xs[j] + ys[j])) > 0:
                score[j], before[j] = 1.0 + gain, owner
            j += 1
        for m in range(i, j):
            tree.put(int(rank[m]), score[m] + GAP_COST * (xs[m] + ys[m]), m)
        i = j
    used, out = [False] * n, []
    for end in sorted(range(n), key=lambda m: -score[m]):
        chain = []
        while end >= 0 and not used[end]:
            used[end] = True
            chain.append(end)
            end = before[end]
        if chain:
            out.extend(_split(chain[::-1], xs, ys))
    return out


def _split(chain: list[int], xs: list[int], ys: list[int]) -> list[list[int]]:
    """Cut a chain where its gaps are too long or shift too far."""
    out, part = [], chain[:1]
    for a, b in zip(chain, chain[1:], strict=False):
        dx, dy = xs[b] - xs[a], ys[b] - ys[a]
        if max(dx, dy) > MAX_GAP or abs(dx - dy) > MAX_SHIFT:
            out.append(part)
            part = []
        part.append(b)
    return [*out, part]


def chain_rows(matches: DataFrame, k: int) -> DataFrame:
    """Chains of (doc_id, at, source, source_at): the rows of a document come to one task."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(c.to_numpy() for c in b.columns) for b in batches]
        if not parts:
            return
        doc, at, source, source_at = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((source_at, at, source, doc))
        doc, at, source, source_at = doc[order], at[order], source[order], source_at[order]
        # Inside a run of words equal in both texts a match every k places is enough.
        on = (np.diff(doc) == 0) & (np.diff(source) == 0) & (np.diff(at) == 1) & (np.diff(source_at) == 1)
        inside = np.r_[False, on] & np.r_[on, False] & (at % k != 0)
        doc, at, source, source_at = doc[~inside], at[~inside], source[~inside], source_at[~inside]
        first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (source[1:] != source[:-1])])
        last = np.r_[first[1:], len(doc)]
        rows: list[tuple] = []
        lists, whole = pa.list_(pa.list_(pa.int32())), pa.int32()
        schema = pa.schema(
            [("doc_id", pa.int64()), ("source", pa.int64()), ("low", whole), ("high", whole), ("s_low", whole), ("s_high", whole), ("xs", lists), ("ys", lists)]
        )

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows.clear()
            return batch

        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            x, y = at[a:b], source_at[a:b]
            for near in neighbours([(x[c].tolist(), y[c].tolist()) for c in chains(x, y)]):
                xs, ys = zip(*near, strict=True)
                rows.append((doc[a], source[a], *_reach(xs, k), *_reach(ys, k), list(xs), list(ys)))
            if len(rows) >= 5000:
                yield flush()
        if rows:
            yield flush()

    shape = "doc_id long, source long, low int, high int, s_low int, s_high int, xs array<array<int>>, ys array<array<int>>"
    return matches.repartition("doc_id").mapInArrow(tidy(build), shape)


def neighbours(found: list[tuple[list[int], list[int]]]) -> list[list[tuple[list[int], list[int]]]]:
    """Chains of two documents put together where the words around them overlap, as those of a line that
    one of them repeats do; together they are no longer than the words around each."""
    out: list[list] = []
    end = low = high = 0
    for x, y in sorted(found):
        if out and x[0] <= end and max(high, y[-1]) - min(low, y[0]) <= 4 * PAD and len(out[-1]) < 1000:
            out[-1].append((x, y))
        else:
            out.append([(x, y)])
            end, low, high = 0, y[0], y[-1]
        end, low, high = max(end, x[-1] + 2 * PAD), min(low, y[0]), max(high, y[-1])
    return out


def _reach(places: Sequence[list[int]], step: int) -> tuple[int, int]:
    """The words around chains, on a grid."""
    low, high = max(0, min(p[0] for p in places) - PAD), max(p[-1] for p in places) + PAD + step
    return low // GRID * GRID, -(-high // GRID) * GRID


def common_length(a: list[int], b: list[int]) -> int:
    """Length of a longest common subsequence, a row of the table being one integer's bits."""
    if a == b:
        return len(a)
    masks: dict[int, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        both = row & masks.get(w, 0)
        row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


_SHIFTS = np.arange(-DIAGONALS, DIAGONALS + 1)
_SHIFTS = _SHIFTS[np.argsort(np.abs(_SHIFTS), kind="stable")]  # of equal ways the straightest


def extend(a: np.ndarray, b: np.ndarray, steps: list | None = None) -> tuple[int, int, int]:
    """How far both run on from their starts: words of a, of b, and words in common. ``steps`` takes the
    same three numbers of each run of equal or of different words on the way.

    All diagonals are looked at together, with a row each; beyond a text's end nothing is equal.
    """
    used_a = used_b = common = 0
    skip_a, skip_b = np.maximum(_SHIFTS, 0), np.maximum(-_SHIFTS, 0)
    while True:
        n = min(len(a) - used_a, len(b) - used_b)
        if n <= 0:
            return used_a, used_b, common
        n += DIAGONALS
        along = np.arange(n)
        in_a, in_b = used_a + skip_a[:, None] + along, used_b + skip_b[:, None] + along
        inside = (in_a < len(a)) & (in_b < len(b))
        same = inside & (a[np.minimum(in_a, len(a) - 1)] == b[np.minimum(in_b, len(b) - 1)])
        value = np.cumsum(np.where(same, 1, -2), axis=1)
        given_up = np.logical_or.accumulate(np.maximum.accumulate(value, axis=1) - value > X_DROP, axis=1)
        value[given_up] = -1
        top = value.argmax(axis=1)
        gain = value[np.arange(len(_SHIFTS)), top] - 2 * np.abs(_SHIFTS)
        gain[1:][gain[1:] < 4] = 0
        way = int(gain.argmax())
        if gain[way] <= 0:
            return used_a, used_b, common
        path = same[way, : top[way] + 1]
        if steps is not None:
            n = len(path)
            if skip_a[way] or skip_b[way]:
                steps.append((int(skip_a[way]), int(skip_b[way]), 0))
            cuts = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), n]
            steps.extend((q - p, q - p, (q - p) * int(path[p])) for p, q in zip(cuts, cuts[1:]))
        used_a += int(skip_a[way]) + len(path)
        used_b += int(skip_b[way]) + len(path)
        common += int(path.sum())


def align(a: np.ndarray, b: np.ndarray, x: list[int], y: list[int], k: int) -> tuple[int, int, int, int, int]:
    """Ends of the passage in both texts (places in a and b), and its words in common."""
    common, ex, ey = k, x[0] + k, y[0] + k
    la, lb = a.tolist(), b.tolist()
    for p, q in zip(x[1:], y[1:], strict=True):
        # Seeds may overlap; where they do unevenly the overlap counts once.
        if p >= ex and q >= ey:
            common += common_length(la[ex:p], lb[ey:q]) + k
        else:
            common += max(0, min(p + k - ex, q + k - ey))
        ex, ey = p + k, q + k
    more_a, more_b, right = extend(a[ex:], b[ey:])
    less_a, less_b, left = extend(a[: x[0]][::-1], b[: y[0]][::-1])
    return x[0] - less_a, ex + more_a, y[0] - less_b, ey + more_b, common + left + right


def steps_of(a: np.ndarray, b: np.ndarray, x: list[int], y: list[int], k: int) -> tuple[int, int, list[tuple[int, int, int]]]:
    """The alignment in steps (words of a, of b, in common) from its first places on: seeds, and between
    them what runs on from either side and the rest."""
    left: list[tuple[int, int, int]] = []
    less_a, less_b, _ = extend(a[: x[0]][::-1], b[: y[0]][::-1], left)
    steps = [*left[::-1], (k, k, k)]
    ex, ey = x[0] + k, y[0] + k
    for p, q in zip(x[1:], y[1:], strict=True):
        if p >= ex and q >= ey:
            on_a, on_b, _ = extend(a[ex:p], b[ey:q], steps)
            back: list[tuple[int, int, int]] = []
            back_a, back_b, _ = extend(a[ex + on_a : p][::-1], b[ey + on_b : q][::-1], back)
            rest_a, rest_b = a[ex + on_a : p - back_a].tolist(), b[ey + on_b : q - back_b].tolist()
            if rest_a or rest_b:
                steps.append((len(rest_a), len(rest_b), common_length(rest_a, rest_b)))
            steps += [*back[::-1], (k, k, k)]
        else:
            steps.append((p + k - ex, q + k - ey, max(0, min(p + k - ex, q + k - ey))))
        ex, ey = p + k, q + k
    extend(a[ex:], b[ey:], steps)
    return x[0] - less_a, y[0] - less_b, steps


def similar_parts(a: np.ndarray, b: np.ndarray, x: list[int], y: list[int], k: int) -> list[tuple[int, int, int, int, int]]:
    """The alignment where it is similar enough, else its stretches that are and lie in no longer one."""
    whole = align(a, b, x, y, k)
    if whole[4] >= IDENTITY * max(whole[1] - whole[0], whole[3] - whole[2]):
        return [whole]
    start_a, start_b, steps = steps_of(a, b, x, y, k)
    own = np.array(steps)
    at = np.vstack([np.zeros((1, 3), np.int64), np.cumsum(own, axis=0)])
    gain = own[:, 2] - IDENTITY * own[:, :2].max(axis=1)
    total = np.r_[0.0, np.cumsum(gain)]
    ends = np.flatnonzero(gain > 0) + 1  # stretches begin and end with words in common
    highest = np.maximum.accumulate(total[ends][::-1])[::-1]
    out, reached = [], 0
    for i in (ends - 1).tolist():
        last = int(np.searchsorted(-highest, -(total[i] - 1e-9), side="right")) - 1
        if last >= 0 and (end := int(ends[last])) > max(i, reached):
            (a0, b0, n0), (a1, b1, n1) = at[i].tolist(), at[end].tolist()
            out.append((start_a + a0, start_a + a1, start_b + b0, start_b + b1, n1 - n0))
            reached = end
    return out


def word_slices(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The word hashes (32 bits) of the wanted (doc_id, low, high)."""
    lists = wanted.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("low", "high")).alias("cuts"))
    lists = materialize(lists, "passage-cuts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1), PART_BYTES):
                ids, lows, highs, blobs = [], [], [], []
                hashed = hashed_words(batch.column(1)[part])
                for d, h, cuts in zip(batch.column(0)[part].to_pylist(), hashed, batch.column(2)[part].to_pylist(), strict=True):
                    h = h.astype(np.uint32)
                    for c in cuts:
                        ids.append(d)
                        lows.append(c["low"])
                        highs.append(c["high"])
                        blobs.append(h[c["low"] : c["high"]].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(lows, pa.int32()), pa.array(highs, pa.int32()), pa.array(blobs, pa.binary())],
                    names=["doc_id", "low", "high", "words"],
                )

    # A document's cuts are on a grid, so they are bounded by its length; the condition lets Spark
    # filter the texts by a Bloom filter before the exchange.
    joined = docs.join(lists.where(F.size("cuts") > 0), "doc_id").select("doc_id", "text", "cuts")
    return joined.mapInArrow(tidy(cut), "doc_id long, low int, high int, words binary")


def aligned(chain_table: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The aligned pieces of each chain that are similar enough."""
    placed = chain_table
    wanted = placed.select("doc_id", "low", "high").union(placed.select("source", "s_low", "s_high"))
    with settings(docs.sparkSession, HIT_SETTINGS):
        cuts = materialize(word_slices(docs, wanted), "passage-words")
    source = cuts.toDF("source", "s_low", "s_high", "s_words")
    both = placed.join(cuts, ["doc_id", "low", "high"]).join(source, ["source", "s_low", "s_high"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                a, b = np.frombuffer(r["words"], np.uint32), np.frombuffer(r["s_words"], np.uint32)
                found = set()
                for xs, ys in zip(r["xs"], r["ys"], strict=True):
                    x, y = [v - r["low"] for v in xs], [v - r["s_low"] for v in ys]
                    found.update(
                        (x0 + r["low"], x1 + r["low"], r["source"], y0 + r["s_low"], y1 + r["s_low"], n)
                        for x0, x1, y0, y1, n in similar_parts(a, b, x, y, k)
                    )
                out.extend((r["doc_id"], *run) for run in joined_runs(sorted(found)))
            kinds = [pa.int64(), *[pa.int32()] * 5, pa.int64(), *[pa.int32()] * 3]
            cols = list(zip(*out)) or [()] * len(PIECE_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=PIECE_NAMES)

    wide = both.select("doc_id", "low", "xs", "words", "source", "s_low", "ys", "s_words")
    return wide.mapInArrow(tidy(build), PIECE_SCHEMA)


PIECE_SCHEMA = (
    "doc_id long, run_start int, run_end int, n_pieces int, "
    "start_word int, end_word int, source_doc_id long, source_start int, source_end int, matched_words int"
)
PIECE_NAMES = [p.strip().split(" ")[0] for p in PIECE_SCHEMA.split(",")]


def joined_runs(pieces: list[tuple]) -> list[tuple]:
    """Pieces (start, end, source, its start and end, words in common; by start) that touch, as one run each:
    its ends, the number of its pieces, and the one with most words in common."""
    out: list[list] = []
    for piece in pieces:
        if out and piece[0] <= out[-1][1] + JOIN_GAP:
            run = out[-1]
            run[1], run[2] = max(run[1], piece[1]), run[2] + 1
            if _merit(piece) < _merit(run[3]):
                run[3] = piece
        else:
            out.append([piece[0], piece[1], 1, piece])
    return [(*run[:3], *run[3]) for run in out]


def _merit(piece: tuple) -> tuple:
    start, end, source, source_start, source_end, matched = piece
    return -matched, source, source_start, start, end, source_end


def passages(
    df: DataFrame, k: int = K, inner: int = INNER, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The repeated passages of each document, with the piece of each that has most words in common.

    doc_id, passage_start, passage_end, n_pieces, and of the best piece start_word, end_word, source_doc_id,
    source_start, source_end, matched_words (word places; ends are exclusive).
    """
    docs = _id_text(df, id_col, text_col).where("doc_id is not null")
    repeated = docs.groupBy("doc_id").count().where("count > 1")
    if not repeated.isEmpty():
        docs = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    matches = seed_matches(seed_rows(docs, k, inner), common_seeds(docs, k, inner))
    chain_table = materialize(chain_rows(matches, k), "chains")
    pieces = materialize(aligned(chain_table, docs, k), "pieces")
    return merged(pieces, min_words)


def merged(pieces: DataFrame, min_words: int) -> DataFrame:
    """Passages long enough, a passage being a run of pieces that touch, with its best piece."""
    from pyspark.sql import Window as W

    by = W.partitionBy("doc_id").orderBy("run_start", "run_end", "source_doc_id", "source_start")
    ended = F.max("run_end").over(by.rowsBetween(W.unboundedPreceding, -1))
    runs = pieces.withColumn("new", (ended.isNull() | (F.col("run_start") > ended + JOIN_GAP)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    # The most words in common; of equal pieces that of the smallest source.
    order = F.struct(-F.col("matched_words"), "source_doc_id", "source_start", "start_word", "end_word", "source_end", "matched_words")
    found = runs.groupBy("doc_id", "run").agg(
        F.min("run_start").alias("passage_start"),
        F.max("run_end").alias("passage_end"),
        F.sum("n_pieces").alias("n_pieces"),
        F.min(order).alias("best"),
    )
    best = [F.col(f"best.{c}").alias(c) for c in PIECE_NAMES[4:]]
    return found.where(F.col("passage_end") - F.col("passage_start") >= min_words).select(
        "doc_id", "passage_start", "passage_end", "n_pieces", *best
    )


def cut_words(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the words of the ranges (rising, apart), each with the blanks after it."""
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for a, b in ranges:
        out.append(text[at : starts[a]])
        at = starts[min(b, len(starts) - 1)]
    return "".join([*out, text[at:]])


def without_passages(df: DataFrame, found: DataFrame) -> DataFrame:
    """df with the passages cut out of its texts; documents of which nothing is left go.

    Of the rows of one doc_id those with the least text, in which the passages were found, are cut; its
    other texts stay as they are. Rows without a passage stay, null and empty texts too.
    """
    # Columns go by number, so that no name can clash.
    columns = [f"c{i}" for i in range(len(df.columns))]
    numbered = df.toDF(*columns)
    key, at = columns[df.columns.index("doc_id")], df.columns.index("text")
    ranges = (
        found.select(F.col("doc_id").alias(key), "passage_start", "passage_end")
        .distinct()
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("passage_start", "passage_end"))).alias("ranges"))
    )
    repeated = numbered.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(columns[at]).alias("least")).where("n > 1")
    joined = numbered.join(ranges, key, "left").withColumn("cut", F.col("ranges"))
    if not numbered.groupBy(key).count().where("count > 1").isEmpty():
        joined = joined.join(repeated.drop("n"), key, "left")
        other = F.col("least").isNotNull() & ~F.col(columns[at]).eqNullSafe(F.col("least"))
        joined = joined.withColumn("cut", F.when(~other, F.col("ranges")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for text, own in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True):
                if text and own:
                    text = cut_words(text, [(r["passage_start"], r["passage_end"]) for r in own])
                    keep.append(bool(WORD.search(text)))
                else:
                    keep.append(True)
                texts.append(text)
            cols = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(cols, names=columns).filter(pa.array(keep, pa.bool_()))

    return joined.select(*columns, "cut").mapInArrow(tidy(cut), numbered.schema).toDF(*df.columns)
