"""Hierarchical multi-length packing of tokenized documents.

Each partition streams through a packer. A document gives up its full-length windows at once; what is
left is routed to the smallest context tier that holds it. Tiers are packed from the longest to the
shortest by best fit; gaps of long windows are filled from the pieces of shorter tiers, the last bit
by cutting one piece. Every closed sequence is exactly as long as its tier, a power of two; what remains
at a partition's end is laid out in sequences of falling powers of two. So nothing is padded. The
sequences of a tier are dealt to step groups of equal token count so that their attention costs
balance. No rows are exchanged, and memory holds a window of pieces, not a partition.

Edge cases: a null text is empty and holds the end id alone; a null doc_id is carried; repeated rows
are documents of their own; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import os
import string
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import ship, tidy, worker_cache
from .distinct_words import content, distinct

TIERS = (2048, 1024, 512, 256)
END_ID = 1
WINDOW_TOKENS = 1 << 20
STEP_TOKENS = 1 << 15
WORDS_HELD = 800_000
PUNCTUATION = string.punctuation
SEQUENCES_A_PARTITION = 1 << 40


class WordEncoder:
    """Token ids of texts by way of a table of words met before.

    The tokenizer's pattern matches no white space, so the ids of a text are those of its words in
    turn. The table is emptied when it holds too many words; results don't depend on it.
    """

    def __init__(self, path: str, words_held: int = WORDS_HELD):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # executors' cores are Spark's to share out
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends_word = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.words_held = words_held
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.first = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.used = 0
        self._append(["\n"], np.array([END_ID]), np.array([1]))  # no word: it stands for the end of a document

    def _append(self, words: list[str], ids: np.ndarray, length: np.ndarray) -> None:
        k, n, end = len(self.number), len(words), self.used + len(ids)
        while k + n > len(self.first):
            self.first, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.length))
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : end] = ids
        self.length[k : k + n] = length
        self.first[k : k + n] = self.used + np.cumsum(length) - length
        self.number.update(zip(words, range(k, k + n), strict=True))
        self.used = end

    def _learn_each(self, words: list[str]) -> None:
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            length = np.fromiter(map(len, ids), np.int64, len(ids))
            self._append(some, np.fromiter(chain.from_iterable(ids), np.uint32, int(length.sum())), length)

    def _learn(self, words: list[str]) -> None:
        """Words of letters only end in the only piece that ends a word: many are encoded as one text."""
        ended: list[tuple[str, str, str]] = []
        plain = {w for w in words if w.isalpha()}
        odd: list[str] = []
        for w in words:
            if w in plain:
                continue
            core = w.rstrip(PUNCTUATION)
            if core.isalpha():
                ended.append((w, core, w[len(core) :]))
            else:
                odd.append(w)
        known = self.number
        plain.update(c for _, c, _ in ended if c not in known)
        todo = list(plain)
        for at in range(0, len(todo), 64 * 64):
            parts = [todo[k : k + 64] for k in range(at, min(len(todo), at + 64 * 64), 64)]
            texts = self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)
            good: list[str] = []
            ids: list[np.ndarray] = []
            for part, e in zip(parts, texts, strict=True):
                own = np.array(e.ids, np.uint32)
                ends = self.ends_word[own]
                if len(own) and ends[-1] and np.count_nonzero(ends) == len(part):
                    good += part
                    ids.append(own)
                else:  # letters that normalise to more than letters
                    self._learn_each(part)
            if good:
                flat = np.concatenate(ids)
                self._append(good, flat, np.diff(np.flatnonzero(self.ends_word[flat]), prepend=-1))
        self._learn_each([w for w in {*odd, *(t for *_, t in ended)} if w not in known])
        if ended:
            pair = np.fromiter((known[x] for _, c, t in ended for x in (c, t)), np.int64, 2 * len(ended))
            length = self.length[pair]
            self._append([w for w, *_ in ended], self._gather(pair, length), length.reshape(-1, 2).sum(axis=1))

    def _gather(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        stop = np.cumsum(length)
        return self.flat[np.repeat(self.first[at] - (stop - length), length) + np.arange(stop[-1] if len(stop) else 0)]

    def encode(self, texts: pa.Array | Sequence[str]) -> list[np.ndarray]:
        """The ids of each text, followed by the end id. A null is empty."""
        if not len(texts):
            return []
        if len(self.number) > self.words_held:
            self.clear()
        body, start, n_words = split_words(*content(texts))
        which, words = distinct(body, start)
        known = self.number
        self._learn([w for w in words if w not in known])
        numbers = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        at = np.zeros(len(which) + len(texts), np.int64)  # the end of a document has number 0
        at[np.arange(len(which)) + np.repeat(np.arange(len(texts)), n_words)] = numbers[which]
        length = self.length[at]
        ids, stop = self._gather(at, length), np.cumsum(length)
        return np.split(ids, stop[np.cumsum(n_words + 1) - 1][:-1])


# The tokenizer's white space: by bytes, and code points of more than one byte, which begin with these bytes.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_WIDE = np.array([0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words end to end, where each begins in them, and the number of words of each text."""
    if not len(data):
        return data, np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    is_word = ~_BLANK[data]
    lead = np.flatnonzero(_LEADS[data])
    if len(lead):
        first, second, third = (data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) & 0x3F for k in range(3))
        two = data[lead] == 0xC2
        blank = np.isin(np.where(two, second | 0x80, (first & 0x0F) << 12 | second << 6 | third), _WIDE)
        for k, which in enumerate((blank, blank, blank & ~two)):
            is_word[lead[which] + k] = False
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begins[heads] = is_word[heads]  # a text's first word begins even where the text before ends in one
    start = np.flatnonzero(begins)
    n_words = np.diff(np.searchsorted(start, offsets))
    return data[is_word], np.cumsum(is_word, dtype=np.int64)[start] - 1, n_words


class Piece:
    __slots__ = ("length", "order", "doc", "start", "ids")

    def __init__(self, length: int, order: int, doc: tuple, start: int, ids: np.ndarray):
        self.length, self.order, self.doc, self.start, self.ids = length, order, doc, start, ids

    def __lt__(self, other: Piece) -> bool:
        return (self.length, self.order) < (other.length, other.order)


class HierarchicalPacker:
    """``add`` documents, take closed sequences from ``drain``: (tier, pieces) with pieces filling the tier."""

    def __init__(self, tiers: Sequence[int] = TIERS, window_tokens: int = WINDOW_TOKENS):
        if any(t & (t - 1) for t in tiers) or sorted(tiers, reverse=True) != list(tiers):
            raise ValueError("tiers are falling powers of two")
        self.tiers, self.window_tokens = tuple(tiers), window_tokens
        self.pool: list[Piece] = []  # ascending by length
        self.held, self.order = 0, 0
        self.closed: list[tuple[int, list[Piece]]] = []

    def _piece(self, doc: tuple, start: int, ids: np.ndarray) -> Piece:
        self.order += 1
        return Piece(len(ids), self.order, doc, start, ids)

    def add(self, doc: tuple, ids: np.ndarray) -> None:
        longest = self.tiers[0]
        full = len(ids) // longest * longest
        for start in range(0, full, longest):
            self.closed.append((longest, [self._piece(doc, start, ids[start : start + longest])]))
        if full < len(ids):
            insort(self.pool, self._piece(doc, full, ids[full:].copy() if full else ids[full:]))
            self.held += len(ids) - full

    def drain(self, last: bool = False) -> list[tuple[int, list[Piece]]]:
        """Sequences closed so far; with ``last``, all there is."""
        if last or self.held >= self.window_tokens:
            for i, tier in enumerate(self.tiers):
                shorter = self.tiers[i + 1] if i + 1 < len(self.tiers) else 0
                # A tier's own pieces are those too long for the next one.
                while self.pool and self.pool[-1].length > shorter and self.held >= tier:
                    self.closed.append((tier, self._fill(tier)))
            if last and self.pool:
                self._close_rest()
        out, self.closed = self.closed, []
        return out

    def _fill(self, tier: int) -> list[Piece]:
        """One sequence: the longest piece, then by best fit from what is shorter, then a cut."""
        top = self.pool.pop()
        if top.length > tier:  # too little is left to fill a longer window
            top = self._cut(top, tier)
        pieces, gap = [top], tier - top.length
        while gap:
            i = bisect_right(self.pool, gap, key=lambda p: p.length)
            if i:
                piece = self.pool.pop(i - 1)
            else:  # all that is left is longer: cut the shortest
                piece = self._cut(self.pool.pop(0), gap)
            pieces.append(piece)
            gap -= piece.length
        self.held -= tier
        return pieces

    def _cut(self, piece: Piece, length: int) -> Piece:
        insort(self.pool, self._piece(piece.doc, piece.start + length, piece.ids[length:]))
        return self._piece(piece.doc, piece.start, piece.ids[:length])

    def _close_rest(self) -> None:
        """Less than a window is left: sequences of falling powers of two hold it without padding."""
        rest, self.pool = self.pool[::-1], []
        while self.held:
            size = min(self.tiers[0], 1 << (self.held.bit_length() - 1))
            pieces, gap = [], size
            while gap:
                piece = rest.pop(0)
                if piece.length > gap:
                    rest.insert(0, self._piece(piece.doc, piece.start + gap, piece.ids[gap:]))
                    piece = self._piece(piece.doc, piece.start, piece.ids[:gap])
                pieces.append(piece)
                gap -= piece.length
            self.closed.append((size, pieces))
            self.held -= size


def balanced_groups(costs: Sequence[float], size: int) -> list[int]:
    """Group of each sequence: groups of ``size``, filled in snake order of falling cost."""
    n = -(-len(costs) // size)
    out = [0] * len(costs)
    for rank, i in enumerate(sorted(range(len(costs)), key=lambda i: -costs[i])):
        lap, k = divmod(rank, n)
        out[i] = k if lap % 2 == 0 else n - 1 - k
    return out


FIELDS = [
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("context", pa.int32()),
    ("step_group", pa.int64()),
]
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "context int, step_group long"
)


def _encoder(path: str) -> WordEncoder:
    held = worker_cache("packing")  # workers are used again for later tasks
    if path not in held:
        held[path] = WordEncoder(path)
    return held[path]


def slices(column: pa.Array, most_bytes: int = 8 << 20) -> Iterator[slice]:
    """Cut a batch of texts so that no part holds much more than ``most_bytes``."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + most_bytes, "right")))
        yield slice(at, end)
        at = end


def pack_documents(
    df: DataFrame,
    tokenizer_path: str,
    tiers: Sequence[int] = TIERS,
    step_tokens: int = STEP_TOKENS,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece, its place in a sequence, and with ``with_ids`` its token ids."""
    fields = FIELDS + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = _encoder(tokenizer_path), HierarchicalPacker(tiers)
        base = TaskContext.get().partitionId() * SEQUENCES_A_PARTITION
        sequence, group = base, base

        def rows(closed: list) -> Iterator[pa.RecordBatch]:
            nonlocal sequence, group
            if not closed:
                return
            group_of: dict[int, int] = {}
            for tier in {t for t, _ in closed}:
                own = [i for i, (t, _) in enumerate(closed) if t == tier]
                costs = [float(sum(p.length**2 for p in closed[i][1])) for i in own]
                groups = balanced_groups(costs, max(1, step_tokens // tier))
                group_of.update((i, group + g) for i, g in zip(own, groups, strict=True))
                group += max(groups) + 1
            cols: list[list] = [[] for _ in fields]
            for i, (tier, pieces) in enumerate(closed):
                offset = 0
                for p in pieces:
                    crc = zlib.crc32(np.ascontiguousarray(p.ids, "<u4"))
                    values = (p.doc[0], p.start, p.length, crc, p.doc[1], sequence, offset, tier, group_of[i])
                    for col, v in zip(cols, values, strict=False):
                        col.append(v)
                    if with_ids:
                        cols[-1].append(p.ids.astype(np.int32))
                    offset += p.length
                sequence += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for part in slices(texts, 2 << 20):
                encoded = encoder.encode(texts[part])
                for doc_id, e in zip(ids[part], encoded, strict=True):
                    packer.add((doc_id, len(e)), e)
                yield from rows(packer.drain())
        yield from rows(packer.drain(last=True))

    ship(df.sparkSession)
    rows_in = df.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text")
    return rows_in.mapInArrow(tidy(pack, "packing"), SCHEMA + ", ids array<int>" * with_ids)
