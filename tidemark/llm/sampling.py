"""Sampling SentencePiece segmentations without replacement, and decoding them.

Every text is a lattice of pieces. With the sums over all ways from each place to the end, a
segmentation is drawn left to right, and the tree of prefixes carries Gumbel-perturbed log
probabilities: a node's value is the maximum over its leaves, so the leaves of largest value are a
sample without replacement, drawn in proportion to probability. The search for the k best is A-star
with these values as exact bounds: the queue holds, for each path drawn, the sets of siblings passed by
at each step, each with its maximum (a Gumbel truncated at the node's value); the best one is opened,
a child is drawn in it, and followed to a leaf. The (k+1)-th value is the threshold by which each
sample has its inclusion score, log(1 - exp(-exp(log p - threshold))).

Pieces don't reach over a word's start, so words are lattices of their own; equal words of a batch
share one, and those of recurring words are held for later batches. Drawing runs over all words of a batch at once. Random numbers are a counter hash of the
row's key, the sample and the place, so results depend on the row alone.

A BPE model has merge ranks for scores; a piece of rank r weighs -SHARPNESS * log(r + 2). Characters
without a piece are spelled in byte pieces.

Edge cases: null and empty texts have one segmentation, of no pieces; texts with fewer than k
segmentations give all of them, with inclusion score 0; a null key is a key of its own; rows of one key
and text have the same samples; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, fields
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship, tidy, worker_cache
from .distinct_words import content, distinct
from .packing import slices
from .word_hash import mix

SAMPLES = 3
SHARPNESS = 1.0
BYTE_WEIGHT = -14.0
UNKNOWN_WEIGHT = -20.0
BATCH_BYTES = 1 << 20
LATTICE_PART, DRAW_PART = 40_000, 40_000
MOST_HELD_ARCS, MOST_ONCE = 4_000_000, 400_000
FIRST_STEPS = 400
MOST_UNIFORM, LARGEST_GUMBEL = 1 - 2.0**-53, 38.0  # -log(-log u) is below 37 there
SPACE = "▁"
WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
U = np.uint64


class Pieces:
    """The model's pieces by length, hashed for look-up of all substrings of a batch at once."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m, n = self.model, self.model.get_piece_size()
        self.text = [m.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i))]
        scores = np.array([m.get_score(i) for i in normal])
        ranks = np.argsort(np.argsort(-scores, kind="stable"), kind="stable")
        weights = -SHARPNESS * np.log(ranks + 2.0)
        self.bytes = {int(self.text[i][1:-1], 16): i for i in range(n) if m.is_byte(i)}
        self.unknown = m.unk_id()
        self.whole = any(SPACE in self.text[i].lstrip(SPACE) for i in normal)
        self.of_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by_length: dict[int, list[int]] = {1: []}
        for k, i in enumerate(normal):
            by_length.setdefault(len(self.text[i]), []).append(k)
        # The starts of pieces: by hash the piece (or -1), its weight, and whether longer pieces start so.
        starts: dict[int, list] = {}
        for length, own in sorted(by_length.items()):
            points = np.frombuffer("".join(self.text[normal[k]] for k in own).encode("utf-32-le"), np.uint32).astype(U)
            points = points.reshape(-1, length)
            h = np.full(len(own), U(0))
            for j in range(length):
                h = _roll(h, points[:, j])
                if j + 1 < length:
                    for x in np.unique(h).tolist():
                        starts.setdefault(x, [-1, 0.0, False])[2] = True
                else:
                    for x, k in zip(h.tolist(), own, strict=True):
                        starts.setdefault(x, [-1, 0.0, False])[:2] = normal[k], weights[k]
            order = np.argsort(h)
            self.of_length[length] = h[order], np.array([normal[k] for k in own], np.int32)[order], weights[own][order]
        self.starts = Starts(starts)

        raw = [t.encode() for t in self.text]
        for b, i in self.bytes.items():
            raw[i] = bytes([b])
        self.raw = pa.array(raw, pa.large_binary())

    def normalize(self, text: str) -> str:
        return self.model.normalize(text) if text else ""

    def decode(self, ids: Sequence[int] | np.ndarray) -> str:
        """The normalised text of a segmentation."""
        return self.decoded(np.asarray(ids, np.int64))[0].decode("utf-8", "replace")

    def decoded(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes that ids spell, and how many each does."""
        _, ends, body = self.raw.take(pa.array(ids)).buffers()
        widths = np.diff(np.frombuffer(ends, np.int64)[: len(ids) + 1]) if len(ids) else np.zeros(0, np.int64)
        return body.to_pybytes() if body is not None else b"", widths


def _roll(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (h + c + U(1)) * U(0x9E3779B97F4A7C15) ^ (h >> U(31))


class Starts:
    """An open-addressed table of hashes, looked up for whole arrays at once."""

    def __init__(self, rows: dict[int, list]):
        bits = max(8, (4 * len(rows)).bit_length())
        self.shift, mask, slots = U(64 - bits), (1 << bits) - 1, [-1] * (1 << bits)
        for n, x in enumerate(rows):
            at = x >> (64 - bits)
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = n
        self.mask, self.slots = mask, np.array(slots, np.int32)
        self.hashes = np.array([*rows, 0], U)  # the last one stands for an empty slot
        self.piece = np.array([*(r[0] for r in rows.values()), -1], np.int64)
        self.weight = np.array([*(r[1] for r in rows.values()), 0.0])
        self.more = np.array([*(r[2] for r in rows.values()), False], bool)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h that are known, and their entries."""
        at = (h >> self.shift).astype(np.int64)
        entry = self.slots[at]
        good = self.hashes[entry] == h
        open_ = np.flatnonzero(~good & (entry >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            entry[open_] = self.slots[at[open_]]
            good[open_] = self.hashes[entry[open_]] == h[open_]
            open_ = open_[~good[open_] & (entry[open_] >= 0)]
        known = np.flatnonzero(good & (entry >= 0))
        return known, entry[known]


@dataclass
class Lattice:
    """Arcs are choices at a place of a word, with conditional log probabilities, cumulated (the last one of a place
    beyond 1); the choices of a place stand together. ``first`` has the first arc of each word, ``follows`` the first
    one of the place an arc leads to, -1 at the word's end.

    ``rest`` is the probability of a place's other choices.
    """

    first: np.ndarray
    cumulated: np.ndarray
    log_p: np.ndarray
    rest: np.ndarray
    piece: np.ndarray
    follows: np.ndarray


class Lattices:
    """A lattice that words are appended to. Those met in an earlier batch too are held from batch to batch, up to
    ``MOST_HELD_ARCS``; all others make room for the next batch's. A word's lattice is the same wherever it stands."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.once: set[str] = set()
        self.arrays = {f.name: np.zeros(0, float if f.name in ("cumulated", "log_p", "rest") else np.int64) for f in fields(Lattice)}
        self.used = self.held = (0, 0, 0)  # words, characters, arcs

    def add(self, words: list[str], pieces: Pieces) -> None:
        """Append the words in parts small enough for a processor's cache."""
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        at = 0
        while at < len(words):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LATTICE_PART, "right")))
            part = _lattice(words[at:end], pieces)
            own, characters, arcs = self.used
            part.follows[part.follows >= 0] += arcs
            part.first += arcs
            for name, kept in self.arrays.items():
                new = getattr(part, name)
                start = own if name == "first" else arcs
                if start + len(new) > len(kept):
                    self.arrays[name] = np.empty(max(start + len(new), len(kept) * 3 // 2), kept.dtype)
                    self.arrays[name][:start] = kept[:start]
                self.arrays[name][start : start + len(new)] = new
            self.used = own + end - at, characters + sum(map(len, words[at:end])), arcs + len(part.piece)
            at = end

    def lattice(self) -> Lattice:
        return Lattice(**self.arrays)

    def numbered(self, words: list[str], pieces: Pieces) -> tuple[np.ndarray, Lattice]:
        """The number of each distinct word of a batch, and the lattice. It stands until the next batch."""
        self.used = self.held
        numbers = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(numbers < 0)
        once = self.once if self.held[2] < MOST_HELD_ARCS else ()
        is_new = np.fromiter((words[n] not in once for n in missing.tolist()), bool, len(missing))
        places = np.concatenate([missing[~is_new], missing[is_new]])  # those held from now on come first
        numbers[places] = self.held[0] + np.arange(len(places))
        recurring, new = ([words[n] for n in missing[x].tolist()] for x in (~is_new, is_new))
        self.number.update(zip(recurring, range(self.held[0], self.held[0] + len(recurring)), strict=True))
        self.add(recurring, pieces)
        self.held = self.used
        self.add(new, pieces)
        if len(self.once) > MOST_ONCE:
            self.once.clear()
        self.once.difference_update(recurring)
        self.once.update(new)
        return numbers, self.lattice()


def build_lattice(words: list[str], pieces: Pieces) -> Lattice:
    """The lattice of all words."""
    out = Lattices()
    out.add(words, pieces)
    return Lattice(**{name: kept[: out.used[0 if name == "first" else 2]] for name, kept in out.arrays.items()})


def _lattice(words: list[str], pieces: Pieces) -> Lattice:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    start, n_states = np.cumsum(sizes) - sizes, len(points)
    left = np.repeat(start + sizes, sizes) - np.arange(n_states)  # characters to the word's end
    # States are numbered by the characters left, so sums to the end go over slices; the last one is the end.
    by_left = np.argsort(left.astype(np.int16) if n_states and left.max() < 1 << 15 else left, kind="stable")
    state = np.full(n_states + 1, n_states)
    state[by_left] = np.arange(n_states)
    found: list[tuple] = []
    count = np.zeros(n_states, np.int64)
    h, at = np.zeros(n_states, U), np.arange(n_states)

    def add(where: np.ndarray, want: int, piece: np.ndarray, weight: np.ndarray | float) -> None:
        found.append((where, want, piece, weight, count[where]))
        count[where] += 1

    table, n = pieces.starts, 0
    while len(at):
        n += 1
        h = _roll(h, points[at + (n - 1)])
        known, entry = table.find(h)
        ids = table.piece[entry]
        hit = np.flatnonzero(ids >= 0)
        add(at[known[hit]], n, ids[hit], table.weight[entry[hit]])
        if n == 1:
            # Characters without a piece are spelled in bytes: one choice, -1 - the character's place.
            bare = np.flatnonzero(count == 0)
            spelled = np.where(points[bare] < 0x80, 1, np.where(points[bare] < 0x800, 2, np.where(points[bare] < 0x10000, 3, 4)))
            cost = BYTE_WEIGHT * spelled if pieces.bytes else UNKNOWN_WEIGHT
            add(bare, 1, -1 - points[bare].astype(np.int64), cost)
        go = known[table.more[entry] & (left[at[known]] > n)]
        at, h = at[go], h[go]
    # Choices of a state stand together, the longest first: it is the likeliest most often, so few are passed by in drawing.
    count = count[by_left]
    last = np.cumsum(count) - 1
    first = last + 1 - count
    total = int(count.sum())
    piece, target, value = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total)
    for where, want, ids, weight, number in found:
        place = last[state[where]] - number
        piece[place] = ids
        value[place] = weight
        target[place] = np.where(left[where] == want, n_states, state[where + want])
    beta = np.zeros(n_states + 1)
    ends = np.cumsum(np.bincount(left, minlength=2)) if n_states else np.zeros(1, int)
    for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if s == e:
            continue
        own = slice(int(first[s]), int(first[e]) if e < n_states else total)
        value[own] += beta[target[own]]
        block, x = first[s:e] - first[s], value[own]
        top = np.maximum.reduceat(x, block)
        beta[s:e] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, count[s:e])), block))
    log_p = value - np.repeat(beta[:-1], count)
    # Sums inside a state only, so that nothing depends on the words around.
    p = np.exp(log_p)
    cumulated = p.copy()
    states, c = np.flatnonzero(count > 1), 1
    while len(states):
        place = first[states] + c
        cumulated[place] += cumulated[place - 1]
        c += 1
        states = states[count[states] > c]
    cumulated[last] = 2.0  # rounding must not leave a gap at the end
    # The others of a choice of nearly all weight are added up: 1 - p would be rounding.
    large = p > 0.75
    rest = 1 - p
    if len(p):
        heavy = np.flatnonzero(large)
        rest[heavy] = np.repeat(np.add.reduceat(np.where(large, 0.0, p), first), count)[heavy]
    return Lattice(first[state[start]], cumulated, log_p, rest, piece, np.append(first, -1)[target])


def uniform(key: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that depend on key and counter alone."""
    return _uniform(mix(key), counter)


def _uniform(mixed_key: np.ndarray, counter: np.ndarray) -> np.ndarray:
    x = mix(mixed_key ^ (counter.astype(U, copy=False) * U(0x9E3779B97F4A7C15)))
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def draw(lattice: Lattice, first: np.ndarray, key: np.ndarray, counter: np.ndarray) -> tuple[np.ndarray, ...]:
    """Follow each word from a place, whose first arc is given, to its end: arcs in word order, and arcs per word.

    ``key`` is mixed already; ``counter`` numbers the words of a row; a first arc of -1 is a word's end.
    """
    cuts = range(0, max(1, len(first)), DRAW_PART)
    parts = [_draw(lattice, *(x[at : at + DRAW_PART] for x in (first, key, counter))) for at in cuts]
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _draw(lattice: Lattice, first: np.ndarray, key: np.ndarray, counter: np.ndarray) -> tuple[np.ndarray, ...]:
    steps: list[tuple] = []
    count = np.zeros(len(first), np.int64)
    word = np.flatnonzero(first >= 0)
    arc, key, c = first[word], key[word], counter[word].astype(U) << U(20)
    while len(word):
        u = _uniform(key, c)
        low = np.flatnonzero(lattice.cumulated[arc] <= u)
        while len(low):
            further = arc[low] + 1
            arc[low] = further
            low = low[lattice.cumulated[further] <= u[low]]
        steps.append((word, arc))
        count[word] += 1
        arc = lattice.follows[arc]
        go = np.flatnonzero(arc >= 0)
        word, arc, key, c = word[go], arc[go], key[go], c[go] + U(1)
    start = np.cumsum(count) - count
    arcs = np.zeros(count.sum(), np.int64)
    for k, (w, a) in enumerate(steps):
        arcs[start[w] + k] = a
    return arcs, count


def truncated(bound: float, location: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Gumbel variables at the locations, given that they are below the bound; noise: log(-log u)."""
    return bound - np.logaddexp(0.0, noise + bound - location)


@dataclass
class Path:
    value: float
    arcs: np.ndarray
    words: np.ndarray  # arcs up to the end of each word


class Search:
    """The queue of one row: sets of siblings passed by, each with the largest value in it.

    An entry is that value, the path it left, the step, the choices taken there, and the log probability
    of the steps before.
    """

    def __init__(self, k: int):
        self.k = k
        self.paths: list[Path] = []
        self.queue: list[tuple] = []

    def push(self, path: Path, steps: list[int], values: list[float], before: list[float], since: int, shut: tuple) -> None:
        for t, v, b in zip(steps, values, before, strict=True):
            if v > -np.inf:
                others = (*(shut if t == since else ()), int(path.arcs[t]))
                heapq.heappush(self.queue, (-v, len(self.paths) - 1, t, others, b))


def queue_siblings(
    lattice: Lattice, searches: list[Search], keys: np.ndarray, paths: list[Path], since: list[int], options: list[list],
    shut: list[tuple], base: list[float],
) -> None:
    """For each row queue the siblings along its newest path from step ``since`` on; ``shut``: choices taken
    before at that step, ``options``: those that were left; ``base``: the log probability of the steps before it.

    Every step's set has its Gumbel variable; of one path no more than the k + 1 best sets are ever opened or
    give the threshold, so those are queued. The log probability before a step bounds its set's, and a Gumbel
    variable its noise, so the first steps tell where no later one can be among the best; rows for which they
    don't are gone through further. Truncation at the path's value keeps the order of sets, so it is left to
    the best ones.
    """
    for search, path in zip(searches, paths, strict=True):
        search.paths.append(path)
    k, n = searches[0].k, len(searches[0].paths)
    mixed, todo, most = mix(keys), np.arange(len(paths)), FIRST_STEPS
    while len(todo):
        own = todo.tolist()
        arcs = [paths[r].arcs[since[r] : since[r] + most] for r in own]
        length = np.array([len(a) for a in arcs])
        start = np.cumsum(length) - length
        flat = np.concatenate(arcs)
        step = np.arange(len(flat)) - np.repeat(start - np.array(since)[todo], length)
        log_p = lattice.log_p[flat]
        with np.errstate(divide="ignore"):
            rest = np.log(lattice.rest[flat])
        before = np.empty(len(flat))
        for r, a, m in zip(own, start.tolist(), length.tolist(), strict=True):
            before[a] = base[r]
            np.cumsum(log_p[a : a + m - 1], out=before[a + 1 : a + m])
            if base[r]:
                before[a + 1 : a + m] += base[r]
            if shut[r]:
                rest[a] = _rest(lattice, options[r], int(paths[r].arcs[since[r]]))
        key = np.repeat(mixed[todo], length)
        noise = np.empty(len(flat))
        for at in range(0, len(flat), DRAW_PART):
            cut = slice(at, at + DRAW_PART)
            u = _uniform(key[cut], (step[cut].astype(U) << U(8)) + U(n + (1 << 50)))
            noise[cut] = np.log(-np.log(np.minimum(u, MOST_UNIFORM)))
        place = before + rest
        free = place - noise
        open_ = []
        for r, a, m in zip(own, start.tolist(), length.tolist(), strict=True):
            path, t = paths[r], since[r]
            top = np.argpartition(free[a : a + m], m - k - 1)[m - k - 1 :] if m > k + 1 else np.arange(m)
            if t + m < len(path.arcs) and not (m > k and free[a + top].min() > before[a + m - 1] + LARGEST_GUMBEL):
                open_.append(r)
                continue
            value = truncated(path.value, place[a + top], noise[a + top])
            searches[r].push(path, (top + t).tolist(), value.tolist(), before[a + top].tolist(), t, shut[r])
        todo, most = np.array(open_, np.int64), most * 8


def _choices(lattice: Lattice, first: int, shut: Sequence[int]) -> list[int]:
    last = first
    while lattice.cumulated[last] <= 1.5:
        last += 1
    return [a for a in range(first, last + 1) if a not in shut]


def _rest(lattice: Lattice, options: list[int], taken: int) -> float:
    left = [a for a in options if a != taken]
    return float(np.log(np.exp(lattice.log_p[left]).sum())) if left else -np.inf


_MARK = SPACE.encode()


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the words that WORDS finds begin in the bytes of texts: at a text's start and at the first of a run of marks."""
    is_start = np.zeros(len(data), bool)
    mark = np.flatnonzero(data == _MARK[0])
    mark = mark[mark < len(data) - 2]
    mark = mark[(data[mark + 1] == _MARK[1]) & (data[mark + 2] == _MARK[2])]
    is_start[mark[np.diff(mark, prepend=-len(_MARK) - 1) != len(_MARK)]] = True
    is_start[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(is_start)


def split_words(text: str) -> list[str]:
    """What WORDS finds."""
    data, offsets = content([text])
    which, words = distinct(data, word_starts(data, offsets))
    return [words[n] for n in which.tolist()]


def sample_batch(texts: list[str], keys: np.ndarray, pieces: Pieces, k: int, held: Lattices | None = None) -> Iterator[list[tuple]]:
    """For each normalised text its samples: (ids' arcs as piece numbers, log p, value, log inclusion).

    ``held`` has lattices of words met before; one batch at a time can go by it."""
    data, offsets = content(texts)
    start = offsets[:-1][np.diff(offsets) > 0] if pieces.whole else word_starts(data, offsets)
    size = np.diff(np.searchsorted(start, offsets))
    # Equal words share a lattice.
    which, words = distinct(data, start)
    numbers, lattice = (held or Lattices()).numbered(words, pieces)
    flat = numbers[which]
    row = np.repeat(np.arange(len(texts)), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    searches = [Search(k) for _ in texts]

    mixed = mix(keys)
    arcs, count = draw(lattice, lattice.first[flat], mixed[row], place)
    tops = -np.log(-np.log(uniform(keys, np.full(len(keys), 2**60))))
    paths = [Path(float(v), a, np.cumsum(c)) for v, (a, c) in zip(tops, _by_row(arcs, count, size), strict=True)]
    some = [r for r, path in enumerate(paths) if len(path.arcs)]
    for r in set(range(len(texts))) - set(some):
        searches[r].paths.append(paths[r])
    if some:
        zeros, none = [0] * len(some), [()] * len(some)
        queue_siblings(lattice, [searches[r] for r in some], keys[some], [paths[r] for r in some], zeros, none, none, zeros)
    begin = np.cumsum(size) - size
    for n in range(1, k):
        opened = []  # row, value, the path left, step, shut choices, choice, its word, log probability before, choices left
        us = uniform(keys, np.full(len(keys), (n << 40) + 7)).tolist()
        for r, search in enumerate(searches):
            if search.queue and len(search.paths) == n:
                v, p, t, others, base = heapq.heappop(search.queue)
                path = search.paths[p]
                word = int(np.searchsorted(path.words, t, "right"))
                starts_word = t == (path.words[word - 1] if word else 0)
                first = int(lattice.first[flat[begin[r] + word]] if starts_word else lattice.follows[path.arcs[t - 1]])
                options = _choices(lattice, first, others)
                weight = np.cumsum(np.exp(lattice.log_p[options]))
                arc = options[min(len(options) - 1, int(np.searchsorted(weight, us[r] * weight[-1], "right")))]
                opened.append((r, -v, path, t, others, arc, word, base, options))
        if not opened:
            break
        rest = [flat[begin[o[0]] + o[6] : begin[o[0]] + size[o[0]]] for o in opened]
        lengths = np.array([len(x) for x in rest])
        first_arc = lattice.first[np.concatenate(rest)]
        first_arc[np.cumsum(lengths) - lengths] = lattice.follows[[o[5] for o in opened]]
        at = np.arange(len(first_arc)) - np.repeat(np.cumsum(lengths) - lengths - np.array([o[6] for o in opened]), lengths)
        own_keys = mix(keys[[o[0] for o in opened]] ^ U(n))
        arcs, count = draw(lattice, first_arc, np.repeat(own_keys, lengths), at)
        new = []
        for o, (a, c) in zip(opened, _by_row(arcs, count, lengths), strict=True):
            _, value, path, t, _, arc, word, *_ = o
            new.append(Path(value, np.concatenate([path.arcs[:t], [arc], a]), np.concatenate([path.words[:word], t + 1 + np.cumsum(c)])))
        rows, _, _, since, shut, _, _, base, options = zip(*opened, strict=True)
        queue_siblings(lattice, [searches[r] for r in rows], keys[list(rows)], new, since, options, shut, base)
    for search in searches:
        threshold = -search.queue[0][0] if search.queue and len(search.paths) == k else None
        out = []
        for path in search.paths:
            log_p = float(lattice.log_p[path.arcs].sum())
            inclusion = 0.0 if threshold is None else log_inclusion(log_p - threshold)
            out.append((lattice.piece[path.arcs], log_p, path.value, inclusion))
        yield out


def log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x)))."""
    return x if x < -30 else float(np.log(-np.expm1(-np.exp(min(x, 700.0)))))


def _by_row(arcs: np.ndarray, count: np.ndarray, words: np.ndarray) -> Iterator[tuple]:
    word_ends = np.r_[0, np.cumsum(words)]
    ends = np.r_[0, np.cumsum(count)][word_ends]
    for r in range(len(words)):
        yield arcs[ends[r] : ends[r + 1]], count[word_ends[r] : word_ends[r + 1]]


def spelled(chosen: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids, and how many each choice gives; choices below zero are characters to be spelled."""
    bare = np.flatnonzero(chosen < 0)
    count = np.ones(len(chosen), np.int64)
    if not len(bare):
        return chosen.astype(np.int32), count
    points, which = np.unique(chosen[bare], return_inverse=True)
    if pieces.bytes:
        spellings = [[pieces.bytes[b] for b in chr(-1 - int(c)).encode("utf-8", "replace")] for c in points]
    else:
        spellings = [[pieces.unknown]] * len(points)
    count[bare] = np.array([len(x) for x in spellings])[which]
    start = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.int32)
    out[start] = chosen
    for n, ids in enumerate(spellings):
        at = start[bare[which == n]]
        for j, i in enumerate(ids):
            out[at + j] = i
    return out, count


def sample_segmentations(
    df: DataFrame, model_path: str, k: int = SAMPLES, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Up to k distinct segmentations a row: key, sample, n_pieces, log_prob, perturbed, log_inclusion,
    ids_crc32 (of little-endian 32-bit ids), decodes (whether decoding gives the normalised text), ids."""
    columns = [
        ("doc_id", pa.int64()), ("sample", pa.int32()), ("n_pieces", pa.int64()), ("log_prob", pa.float64()),
        ("perturbed", pa.float64()), ("log_inclusion", pa.float64()), ("ids_crc32", pa.int64()), ("decodes", pa.bool_()),
    ] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(columns)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = worker_cache("sampling")  # workers are used again for later tasks
        if model_path not in held:
            held[model_path] = Pieces(model_path), Lattices()
        pieces, lattices = held[model_path]
        for batch in batches:
            for part in slices(batch.column(1), BATCH_BYTES):
                ids = batch.column(0)[part].to_pylist()
                texts = [pieces.normalize(t or "") for t in batch.column(1)[part].to_pylist()]
                keys = np.array([(1 << 63) + 1 if i is None else i & (2**64 - 1) for i in ids], U)
                samples = list(sample_batch(texts, keys, pieces, k, lattices))
                # All samples of a batch are spelled and decoded together.
                flat, spells = spelled(np.concatenate([c[0] for own in samples for c in own]), pieces)
                raw, widths = pieces.decoded(flat)
                piece_ends, byte_ends = np.r_[0, np.cumsum(spells)], np.r_[0, np.cumsum(widths)]
                rows: list[tuple] = []
                choice = 0
                for doc_id, text, own in zip(ids, texts, samples, strict=True):
                    text_bytes = text.encode()
                    for n, (chosen, log_p, value, inclusion) in enumerate(own, 1):
                        a, b = int(piece_ends[choice]), int(piece_ends[choice + len(chosen)])
                        choice += len(chosen)
                        out = flat[a:b]
                        decodes = raw[byte_ends[a] : byte_ends[b]] == text_bytes
                        row = (doc_id, n, b - a, log_p, value, inclusion, zlib.crc32(out.astype("<u4").tobytes()), decodes)
                        rows.append((*row, out) if with_ids else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    rows_in = df.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text")
    ship(df.sparkSession)
    shape = (
        "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double, "
        "ids_crc32 long, decodes boolean" + ", ids array<int>" * with_ids
    )
    return rows_in.mapInArrow(tidy(build, "sampling"), shape)
