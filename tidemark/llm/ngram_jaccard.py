"""N-gram Jaccard join with a count-vector R-tree.

A document is the set of its word shingles. Two sets can only reach similarity t = num/den if they
differ in at most D = 2 U (den - num) / (den + num) shingles, U being the larger size. The join:

1. *Grouping.* Sizes fall into levels; at a level shingles are hashed into D + 1 + E groups, so that
   a linked pair agrees exactly on 1 + E groups at least. The contents of groups are keys; sets that
   share a key meet in one bucket. Empty groups would bring strangers together: a set with at most E
   of them leaves them out, as one of the groups agreed on isn't empty then. Sets equal in all
   shingles are one point from here on.
2. *R-tree.* In a bucket every set is a point, the counts of its shingles in hash groups, of which a set
   has one for four shingles or so (a power of two; vectors of unequal lengths are folded onto the
   shorter). An R-tree over the points, folded to ``DIMENSIONS`` at most, finds the pairs whose overlap
   can be large enough: it is bounded by the sum over coordinates of the minima, for a node with the
   node's upper corner; the bound of whole vectors decides. With so many groups, sets that share less
   than about 0.6 of their shingles don't pass, whatever their length. Points already connected need no
   comparing, so a bucket gives a forest of links, not its pairs.
3. *Verification.* Sets connected by such links come together as a block, as arrays of shingles; the
   R-tree proposes pairs again and exact intersections decide, pairs of one component being skipped.
4. Components of verified links are those of the join, and each document gets the smallest doc_id.

Buckets and blocks of more than ``SPLIT`` points or ``SPLIT_SHINGLES`` shingles are divided by hash
and joined part against part, so no task holds more than two parts, and nothing is left out.

Shingles are 64-bit hashes (of words hashed without structure, see ``word_hash``): two documents of n
shingles share one by accident with a chance of n * n / 2**64.

Edge cases: null and blank texts have the empty set, linked with nothing; a text of fewer words than
a shingle is one shingle; a null doc_id is linked with nothing and keeps a null component; rows of
one doc_id are one document, which has the links of all its texts; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HIT_SETTINGS, join_counted, materialize, settings, ship, tidy, trim
from .components import connected_components
from .packing import slices
from .word_hash import hashed_words, mix

DIMENSIONS = 512
SHINGLES_A_GROUP, MOST_BITS = 4, 20
FANOUT = 32
LEAF_ONLY = 160
LEVEL_RATIO = 1.5
SPLIT, SPLIT_SHINGLES = 20_000, 2_000_000
SMALL_BUCKET = 4
PART_BYTES = 1 << 19  # of texts hashed at once; parts of 2 MB took a worker from 190 to 298 MB

U = np.uint64
MULT = U(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array | list, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = hashed_words(texts)
    sizes = np.array([len(w) for w in words], np.int64)
    if not sizes.sum():
        return [np.zeros(0, U)] * len(words)
    flat = np.concatenate(words)
    # Shingles of all texts at once; those that would run over a text's end are passed over.
    out_of = np.cumsum(sizes)
    long = flat
    grams = mix(np.full(max(0, len(long) - width + 1), U(width)))
    for k in range(width):
        grams = mix(grams * MULT + long[k : k + len(grams)])
    out = []
    for start, n in zip((out_of - sizes).tolist(), sizes.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(grams[start : start + n - width + 1]))
        elif n:
            s = np.full(1, U(n))
            for k in range(n):
                s = mix(s * MULT + flat[start + k : start + k + 1])
            out.append(s)
        else:
            out.append(np.zeros(0, U))
    return out


class Similarity:
    """The threshold num/den, and the levels of sizes."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den or den / num >= LEVEL_RATIO:
            raise ValueError("thresholds lie above 2/3 and at most 1")
        self.num, self.den = num, den
        # Up to the first cap linked sets are equal.
        caps = [max(1, -(-(den + num) // (2 * max(1, den - num))) - 1)]
        while caps[-1] < 1 << 40:
            caps.append(int(caps[-1] * LEVEL_RATIO) + 1)
        self.caps = np.array(caps, np.int64)
        # Shingles a group has at least; where they are few, more groups are empty.
        self.spare = 12 if (den + num) / (2 * max(1, den - num) * LEVEL_RATIO) > 5 else 4

    def groups(self, level: int) -> tuple[int, int]:
        """The number of groups of a level, and how many of them may be empty without being keys."""
        most = int(2 * int(self.caps[level]) * (self.den - self.num) // (self.den + self.num))
        empty = -(-(most + 1) // self.spare) if most else 0
        return most + 1 + empty, empty

    def needed(self, a, b):
        """The least overlap of linked sets of sizes a and b."""
        return -((-self.num * (a + b)) // (self.num + self.den))

    def levels(self, n: int) -> list[int]:
        own = int(np.searchsorted(self.caps, n))
        # A partner larger by 1/t at most may be in the next level.
        return [own, own + 1] if n * self.den // self.num > self.caps[own] else [own]


def keys_of(shingles: np.ndarray, similarity: Similarity) -> np.ndarray:
    """The keys of a set: at each of its levels the content of every group."""
    found = []
    mixed = mix(shingles ^ U(0xD6E8FEB86659FD93))
    for level in similarity.levels(len(shingles)):
        m, may_be_empty = similarity.groups(level)
        group = (shingles % U(m)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        sums = np.zeros(m, U)
        used, first = np.unique(group[order], return_index=True)
        sums[used] = np.add.reduceat(mixed[order], first)
        keys = mix(sums + mix((np.arange(m, dtype=U) << U(8)) + U(level + 1)))
        found.append(keys[used] if m - len(used) <= may_be_empty else keys)
    return np.concatenate(found)


def count_vector(shingles: np.ndarray) -> np.ndarray:
    """Counts in hash groups, a power of two of them, of the least type that holds them."""
    bits = min(MOST_BITS, max(4, (len(shingles) // SHINGLES_A_GROUP).bit_length()))
    counts = np.bincount(((shingles >> U(40)) & U((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.min_scalar_type(int(counts.max())))


def packed(counts: np.ndarray) -> bytes:
    return bytes([counts.itemsize]) + counts.tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"u{blob[0]}", offset=1)


def folded(counts: np.ndarray, n: int) -> np.ndarray:
    return counts if len(counts) == n else counts.reshape(-1, n).sum(axis=0, dtype=np.uint32)


class Points:
    """Count vectors, and their common folding for the R-tree."""

    def __init__(self, vectors: list[np.ndarray], similarity: Similarity):
        self.vectors, self.similarity = vectors, similarity
        self.size = [int(v.sum(dtype=np.int64)) for v in vectors]
        n = min([DIMENSIONS, *(len(v) for v in vectors)])
        self.common = np.stack([folded(v, n) for v in vectors])
        self.folds = any(len(v) != n for v in vectors)

    def may_link(self, i: int, j: int) -> bool:
        """Whether the bound of the whole vectors lets the pair pass."""
        if not self.folds:
            return True  # the tree has looked at them
        a, b = self.vectors[i], self.vectors[j]
        n = min(len(a), len(b))
        bound = int(np.minimum(folded(a, n), folded(b, n)).sum(dtype=np.int64))
        return bound >= self.similarity.needed(self.size[i], self.size[j])


class Forest:
    """Union-find with the smaller number as root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = int(up[i])
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def roots(self) -> np.ndarray:
        up = self.up
        while not np.array_equal(up, up[up]):
            up = up[up]
        self.up = up
        return up


class CountRTree:
    """Points (count vectors) packed by size and then by coordinates, under levels of boxes."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.size = self.counts.sum(axis=1, dtype=np.int64)
        spread = self.counts[:: max(1, len(counts) // 1000)].std(axis=0)  # an order only, any would do
        main = np.argsort(-spread)[:2]
        slab = self.size if len(counts) < FANOUT * FANOUT else np.argsort(np.argsort(self.size)) // (FANOUT * FANOUT)
        self.order = np.lexsort((self.counts[:, main[1]], self.counts[:, main[0]] // 4, slab))
        low, high, top = self.size[self.order], self.size[self.order], self.counts[self.order]
        self.levels = []
        while len(top) > 1:
            first = np.arange(0, len(top), FANOUT)
            low = np.minimum.reduceat(low, first)
            high = np.maximum.reduceat(high, first)
            top = np.maximum.reduceat(top, first, axis=0)
            self.levels.append((low, high, top))

    def candidates(self, i: int, s: Similarity, comp: np.ndarray | None = None, uniform: list | None = None) -> np.ndarray:
        """Points whose bounded overlap with point i suffices; boxes inside i's component are passed over."""
        q, n = self.counts[i], self.size[i]
        least, most = -(-s.num * n // s.den), s.den * n // s.num
        nodes = np.zeros(1, np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            low, high, top = self.levels[k]
            if k < len(self.levels) - 1:
                nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                nodes = nodes[nodes < len(low)]
            if uniform is not None:
                nodes = nodes[uniform[k][nodes] != comp[i]]
            nodes = nodes[(high[nodes] >= least) & (low[nodes] <= most)]
            bound = np.minimum(top[nodes], q).sum(axis=1, dtype=np.int64)
            nodes = nodes[bound >= s.needed(n, np.maximum(low[nodes], least))]
            if not len(nodes):
                return nodes
        if self.levels:
            nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            nodes = nodes[nodes < len(self.order)]
        points = self.order[nodes]
        points = points[(self.size[points] >= least) & (self.size[points] <= most)]
        bound = np.minimum(self.counts[points], q).sum(axis=1, dtype=np.int64)
        return points[bound >= s.needed(n, self.size[points])]

    def uniform(self, comp: np.ndarray) -> list[np.ndarray]:
        """For each box the component all its points lie in, or -1."""
        low = high = comp[self.order]
        out = []
        for _ in self.levels:
            first = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            out.append(np.where(low == high, low, -1))
        return out


def linked(counts: np.ndarray, similarity: Similarity, verify=None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that the bound, and ``verify`` if given, let pass."""
    n = len(counts)
    if n <= LEAF_ONLY:
        return _linked_leaf(counts, similarity, verify)
    tree, forest, out = CountRTree(counts), Forest(n), []
    comp, uniform = forest.roots(), None
    stale = 0
    for i in range(n):
        if stale >= 32 or uniform is None:
            comp = forest.roots().copy()
            uniform = tree.uniform(comp)
            stale = 0
        for j in tree.candidates(i, similarity, comp, uniform):
            j = int(j)
            if j < i and forest.find(i) != forest.find(j) and (verify is None or verify(i, j)):
                forest.join(i, j)
                out.append((i, j))
                stale += 1
        stale += 1
    return out


def _linked_leaf(counts: np.ndarray, similarity: Similarity, verify) -> list[tuple[int, int]]:
    """The same where all points fit a leaf: the bound of all of them against each other at once."""
    size = counts.sum(axis=1, dtype=np.int64)
    bound = np.stack([np.minimum(counts, c).sum(axis=1, dtype=np.int64) for c in counts])
    a, b = np.nonzero(np.tril(bound >= similarity.needed(size[:, None], size[None, :]), -1))
    forest, out = Forest(len(counts)), []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        if forest.find(i) != forest.find(j) and (verify is None or verify(i, j)):
            forest.join(i, j)
            out.append((i, j))
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text")


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def set_names(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, which name it."""
    sums = [(int(s.sum()), int(mix(s).sum()) if len(s) else 0) for s in sets]
    return mix(np.array([a for a, _ in sums], U)), mix(np.array([b for _, b in sums], U))


def set_rows(df: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, two hashes of the set, and its count vector."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1), PART_BYTES):
                sets = shingle_sets(batch.column(1)[part], width)
                s1, s2 = set_names(sets)
                vectors = pa.array([packed(count_vector(s)) for s in sets], pa.binary())
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part], sizes, _signed(s1), _signed(s2), vectors],
                    names=["doc_id", "n_shingles", "s1", "s2", "vec"],
                )

    ship(df.sparkSession)
    return df.mapInArrow(tidy(build), "doc_id long, n_shingles long, s1 long, s2 long, vec binary")


def key_rows(df: DataFrame, width: int, similarity: Similarity) -> DataFrame:
    """key and s1 of each set; a set met again in the same task is passed over."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for part in slices(batch.column(1), PART_BYTES):
                keys, owners = [], []
                for s in shingle_sets(batch.column(1)[part], width):
                    s1 = int(mix(np.array([s.sum()], U))[0]) if len(s) else None
                    if s1 is None or s1 in met:
                        continue
                    met.add(s1)
                    keys.append(keys_of(s, similarity))
                    owners.append(np.full(len(keys[-1]), s1, U))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [_signed(np.concatenate(keys)), _signed(np.concatenate(owners))], names=["key", "s1"]
                    )

    return df.select("doc_id", "text").mapInArrow(tidy(build), "key long, s1 long")


def shared_keys(keys: DataFrame) -> DataFrame:
    """(key, s1, n): the sets of every key that several have, n being their number; key names the bucket.

    Keys were made distinct per task, so a key has at most one row per set and task; rows come to a
    partition as two numbers each, and the sort here is over arrays of them.
    """

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        key, s1 = (np.concatenate(p) for p in zip(*parts, strict=True))
        del parts
        order = np.lexsort((s1, key))
        key, s1 = key[order], s1[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (s1[1:] != s1[:-1])
        key, s1 = key[new], s1[new]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[first, len(key)])
        each = np.repeat(count, count)
        keep = each > 1
        key, s1, each = key[keep], s1[keep], each[keep]
        if not len(key):
            return
        # Copies share many keys: buckets of the same sets are one bucket, named by the sum over its sets.
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        bucket = np.add.reduceat(mix(s1.view(U)), first)
        size = np.diff(np.r_[first, len(key)])
        _, chosen = np.unique(bucket, return_index=True)
        only = np.zeros(len(first), bool)
        only[chosen] = True
        keep = np.repeat(only, size)
        key, s1, each = np.repeat(bucket, size)[keep].view(np.int64), s1[keep], each[keep]
        for at in range(0, len(key), 100_000):
            cut = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[cut]), pa.array(s1[cut]), pa.array(each[cut])], names=["key", "s1", "n"]
            )

    return keys.repartition("key").mapInArrow(tidy(shared), "key long, s1 long, n long")


def in_parts(rows: DataFrame, group: str, parts, member: str) -> DataFrame:
    """Columns i and j: the pair of parts in which a row takes its place; one pair where ``parts`` is 1."""
    own = F.pmod(F.xxhash64(F.col(member), F.lit(7)), parts.cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)).alias("other")
    spread = rows.withColumn("own", own).select("*", other)
    return spread.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("own", "other")


def bound_links(shared: DataFrame, vectors: DataFrame, similarity: Similarity) -> DataFrame:
    """Links a, b (set hashes) that the R-trees of the buckets let pass, connected as the pairs are."""
    small = (
        shared.where(F.col("n") <= SMALL_BUCKET)
        .groupBy("key")
        .agg(F.collect_set("s1").alias("all"))  # at most SMALL_BUCKET
        .select(F.explode(F.expr("flatten(transform(all, x -> transform(filter(all, y -> y < x), y -> struct(x as a, y as b))))")).alias("p"))
        .select("p.a", "p.b")
        .distinct()
    )

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                two = Points([unpacked(a), unpacked(b)], similarity)
                two.folds = True
                keep.append(two.may_link(0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    va, vb = (vectors.select(F.col("s1").alias(x), F.col("vec").alias(f"v{x}")) for x in "ab")
    from_small = small.join(va, "a").join(vb, "b").select("a", "b", "va", "vb").mapInArrow(pairs, "a long, b long")

    def tree(table: pa.Table) -> pa.Table:
        s1 = table.column("s1").to_numpy()
        points = Points([unpacked(v) for v in table.column("vec").to_pylist()], similarity)
        found = linked(points.common, similarity, points.may_link)
        a, b = (np.array([s1[f[k]] for f in found], np.int64) for k in (0, 1))
        if table.num_rows > LEAF_ONLY:
            del points
            trim()
        return pa.table({"a": a, "b": b})

    large = in_parts(shared.where(F.col("n") > SMALL_BUCKET).distinct(), "key", F.ceil(F.col("n") / SPLIT), "s1")
    from_large = (
        large.select("key", "i", "j", "s1").join(vectors, "s1").groupBy("key", "i", "j").applyInArrow(tree, "a long, b long")
    )
    return from_small.union(from_large)


def member_sets(members: DataFrame, width: int) -> DataFrame:
    """block, i, j, doc_id, s1, s2 and shingles of the rows (text and the same) whose text is the set meant."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0), PART_BYTES):
                sets = shingle_sets(batch.column(0)[part], width)
                rows = batch[part].select(MEMBER)
                keep = np.ones(rows.num_rows, bool)
                for own, name in zip(set_names(sets), ("s1", "s2"), strict=True):
                    keep &= own.view(np.int64) == rows.column(name).to_numpy()
                arrays = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*rows.columns, arrays], names=[*MEMBER, "shingles"]).filter(pa.array(keep))

    schema = "block long, i int, j int, doc_id long, s1 long, s2 long, shingles binary"
    return members.select("text", *MEMBER).mapInArrow(tidy(build), schema)


MEMBER = ["block", "i", "j", "doc_id", "s1", "s2"]


def verified_links(members: DataFrame, similarity: Similarity) -> DataFrame:
    """Links of documents whose sets are similar enough, out of (block, i, j, doc_id, s1, s2, shingles)."""

    def verify(table: pa.Table) -> pa.Table:
        rows = {}
        for *key, s in zip(*(table.column(c).to_pylist() for c in ("doc_id", "s1", "s2", "shingles")), strict=True):
            rows.setdefault(tuple(key), s)
        ids = [key[0] for key in rows]
        sets = [np.frombuffer(s, U) for s in rows.values()]
        points = Points([count_vector(s) for s in sets], similarity)

        def similar(i: int, j: int) -> bool:
            if not points.may_link(i, j):
                return False
            a, b = sets[i], sets[j]
            common = overlap(a, b)
            return similarity.den * common >= similarity.num * (len(a) + len(b) - common)

        found = linked(points.common, similarity, similar)
        a, b = (np.array([ids[f[k]] for f in found], np.int64) for k in (0, 1))
        if table.num_rows > LEAF_ONLY:
            sets.clear()
            rows.clear()
            trim()
        return pa.table({"a": a, "b": b})

    return members.groupBy("block", "i", "j").applyInArrow(verify, "a long, b long")


def jaccard_components(
    df: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of each row."""
    similarity = Similarity(num, den)
    docs = _id_text(df, id_col, text_col)
    sets = materialize(set_rows(docs, width), "jaccard-sets")
    some = sets.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(
        some.groupBy("s1", "s2").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("rows")
        ),
        "jaccard-classes",
    )
    shared = materialize(shared_keys(key_rows(docs.where("doc_id is not null"), width, similarity)), "jaccard-shared")
    near = materialize(bound_links(shared, classes.select("s1", "vec"), similarity), "jaccard-bound")
    blocks = materialize(connected_components(near), "jaccard-blocks")

    # Sets whose first hashes agree by chance are both members of the block.
    members = classes.select("s1", "s2", "rep", "n").join(blocks.withColumnRenamed("node", "s1"), "s1")
    weight = members.groupBy("component").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / SPLIT, F.sum("n") / SPLIT_SHINGLES)).alias("parts")
    )
    placed = in_parts(members.join(weight, "component"), "component", F.col("parts"), "s2")
    placed = materialize(
        placed.select(F.col("component").alias("block"), "i", "j", F.col("rep").alias("doc_id"), "s1", "s2"), "jaccard-members"
    )
    # The condition holds for all rows; it lets Spark filter the texts by a Bloom filter before the exchange.
    chosen = docs.join(placed.where(F.col("i") >= 0), "doc_id")
    with settings(df.sparkSession, HIT_SETTINGS):
        links = materialize(verified_links(member_sets(chosen, width), similarity), "jaccard-links")

    reps = classes.select("s1", "s2", "rep", "rows")
    several = some.select("doc_id", "s1", "s2").distinct().groupBy("doc_id").count().where("count > 1")
    if _repeats(sets):  # the texts of one document are linked
        own = some.join(several.select("doc_id"), "doc_id", "left_semi").join(reps, ["s1", "s2"])
        links = links.union(own.select("doc_id", "rep"))
    components = materialize(connected_components(links), "jaccard-components")

    named = reps.join(components.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("s1", "s2", F.coalesce("component", "rep").alias("component"), "rows")
    out = join_counted(sets.select("doc_id", "n_shingles", "s1", "s2"), named, ["s1", "s2"], "rows", "left")
    own = F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def _repeats(sets: DataFrame) -> bool:
    """Whether a doc_id has several rows."""
    return not sets.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
