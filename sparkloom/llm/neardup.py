"""Near-duplicate records with small edits, by PartEnum signatures (problem 6).

Method (Arasu, Ganti, Kaushik 2006), with a bound by ratio in place of one by count. The feature domain is partitioned by the bits
of a hash, nested: a node of depth d holds the features that agree in d bits. Where two sets reach the threshold (den * common >=
num * all) so do their parts in at least one non-empty half of the domain, since ``(den - num) * common - num * different`` is a
sum over halves; so it goes down to ever smaller parts. A set enumerates, in every node where it has at most ``PART`` features, the
subsets of them that can be all a similar set shares with it there: those K with ``den * |K| >= num * |part|``. Similar sets
share one of these signatures (node, K): where the larger of their parts in the node has at most ``PART`` features both enumerate
there, and otherwise both go on to the halves, since the smaller part has at least ``num / den`` of the larger. So a node is the band
of sizes in which both enumerate, and nothing is missed.

Features that only one set has can't be shared: they count in the size of a part but stand in no subset, and a set with too many of
them has no signatures at all.

Where a signature is met, a pair goes on if its parts are as similar as K demands and if the parity sketches of the node two levels
higher (which differ in no more bits than the parts in features) allow the differences of that node. A signature shared by more
than ``hot`` sets is not paired: its sets go on to another, independent partition, in which its similar pairs must share a signature
as well, so a level has no more rows than the one before; what is still hot after ``LEVELS`` partitions is met block by block,
each block with each, so all of it is met and no task holds more than two blocks. The pairs are then verified on the whole sets.

Scale: equal sets are folded first, so copies cost one row a class. A level is one shuffle of small rows (key, id, sketch),
about one and a half for each feature, sorted and met in one pass in Arrow batches that hold at most ``hot`` rows of a key; one
key has at most one row a set. Nothing is collected.

Defined results: records with null keys or texts, and texts too short for a run of ``run`` words, match nothing; rows that
repeat count once; a key whose rows hold several texts is compared by each; equal texts are pairs; empty tables give none.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import sets
from sparkloom.plans.lineage import cut

PART = 6  # 7 at most: a sketch has three bits for it
# Comparing the sets of a signature costs in the square of their number, splitting them anew in proportion to it.
HOT = 4_096
LEVELS = 3
KEYS_A_FEATURE, ROWS_A_TASK = 2, 1_000_000  # so that a task sorts its rows in memory
SLICE = 200_000  # features enumerated at once
FEW = 48
PARITY_BITS = 50


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix), so that sums of mixed values tell multisets apart."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(features: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A word for each run of ``size`` features from ``begin`` on: its size (8 bits, 255 for more), 6 bits left open, its parity.

    Every feature flips one bit of the parity, so two sets differ in at least as many features as bits.
    """
    bit = np.uint64(1) << (mix(features ^ np.uint64(0xA5A5A5A5)) % np.uint64(PARITY_BITS))
    parity = np.bitwise_xor.reduceat(bit, begin) if len(begin) else np.zeros(0, np.uint64)
    return (np.minimum(size, 255).astype(np.uint64) << np.uint64(56)) | parity


@functools.lru_cache(maxsize=256)
def choices(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)))


def signatures(features: np.ndarray, owner: np.ndarray, alone: np.ndarray, num: int, den: int, seed: int, part: int = PART) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, owner, sketch) of all signatures; feature i belongs to set owner[i] (ascending), and alone[i] says that no other set has it."""
    with np.errstate(over="ignore"):
        h = mix(features ^ np.uint64(seed * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF))
        value = mix(h)
        low = -(-num * (part + 1) // den)
        path = np.ones(len(h), np.uint64)
        above: list[np.ndarray] = []  # of every feature, the sketches of its last two nodes
        keys, owners, marks = [], [], []
        while len(h):
            # after ``owner`` and ``path`` the shared features come first, so a subset is a choice of leading places
            order = np.lexsort((alone, path, owner))
            owner, alone, path, h, value = owner[order], alone[order], path[order], h[order], value[order]
            above = [x[order] for x in above]
            begin = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (path[1:] != path[:-1])]))
            size = np.diff(np.append(begin, len(h)))
            shared = size - np.add.reduceat(alone.astype(np.int64), begin)
            above = [*above, np.repeat(sketches(value, begin, size), size)][-3:]
            hope = den * shared >= num * size
            for n in range(1, part + 1):
                for m in range(-(-num * n // den), n + 1):
                    mine = begin[hope & (size == n) & (shared == m)]
                    if not len(mine):
                        continue
                    held = value[mine[:, None] + np.arange(m)]
                    node = mix(path[mine] ^ np.uint64(seed << 32))[:, None]
                    for k in range(-(-num * n // den), m + 1):
                        sums = held[:, choices(m, k)].sum(axis=2, dtype=np.uint64)
                        keys.append(mix(sums ^ node).ravel())
                        owners.append(np.repeat(owner[mine], sums.shape[1]))
                        marks.append(np.repeat(above[0][mine] | np.uint64(n << 53 | k << 50), sums.shape[1]))
            on = np.repeat(hope & (size >= low), size)
            owner, alone, h, value = owner[on], alone[on], h[on], value[on]
            above = [x[on] for x in above]
            path = (path[on] << np.uint64(1)) | (h & np.uint64(1))
            h = h >> np.uint64(1)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(marks)


EMITTED = "key long, id long, sketch long"


def slices(sizes: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``most`` features, or one row."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
        yield at, max(at + 1, upto)
        at = max(at + 1, upto)


def rows_of(key: np.ndarray, ids: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids), pa.array(sketch.view(np.int64))], names=["key", "id", "sketch"])


def lists_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) of a column of lists; null lists are empty."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), sizes


def in_slice(key: np.ndarray, k: int, of: int) -> np.ndarray:
    """Which keys belong to slice ``k`` of ``of``."""
    return mix(key.view(np.uint64)) % np.uint64(of) == k if of > 1 else np.ones(len(key), bool)


def _emit(num: int, den: int, level: int, k: int = 0, of: int = 1):
    """A row a signature, of the signatures in slice ``k`` of ``of``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            values, sizes = lists_of(b["hashes"])
            private, n_private = lists_of(b["alone"])
            ends, private_ends = np.append(0, np.cumsum(sizes)), np.append(0, np.cumsum(n_private))
            ids = b["id"].to_numpy(zero_copy_only=False)
            for lo, hi in slices(sizes):
                mine = values[ends[lo] : ends[hi]]
                # a feature that no other set has is met once in the batch too, unless a set stands there under several keys
                alone = np.isin(mine, private[private_ends[lo] : private_ends[hi]])
                key, owner, sketch = signatures(mine.view(np.uint64), np.repeat(np.arange(lo, hi), sizes[lo:hi]), alone, num, den, level)
                here = in_slice(key, k, of)
                yield rows_of(key[here], ids[owner[here]], sketch[here])

    return run


MET = "a long, b long, id long, key long"


def _meet(num: int, den: int, hot: int):
    """Over rows sorted by key: the pairs of each key, or its rows as they are where it has more than ``hot``."""
    six, eight = np.uint64(7), np.uint64(255)

    def fits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        differ = np.bitwise_count((x ^ y) & np.uint64((1 << PARITY_BITS) - 1)).astype(np.int64)
        n, m = ((s >> np.uint64(56)) & eight for s in (x, y))
        n, m = n.astype(np.int64), m.astype(np.int64)
        common = ((x >> np.uint64(50)) & six).astype(np.int64)
        parts = (((x >> np.uint64(53)) & six) + ((y >> np.uint64(53)) & six)).astype(np.int64)
        return (differ * (den + num) <= (den - num) * (n + m)) & (np.minimum(n, m) * den >= np.maximum(n, m) * num) & (common * (den + num) >= parts * num)

    def pairs_of(ids: np.ndarray, sketch: np.ndarray, lo: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        out = []
        for m in np.unique(size[(size > 1) & (size <= FEW)]):
            begin = lo[size == m]
            i, j = np.triu_indices(int(m), 1)
            step = max(1, 500_000 // len(i))
            for at in range(0, len(begin), step):
                rows = begin[at : at + step, None]
                p, q = (rows + i).ravel(), (rows + j).ravel()
                good = fits(sketch[p], sketch[q])
                out.append(np.stack([ids[p[good]], ids[q[good]]]))
        for begin, m in zip(lo[size > FEW], size[size > FEW]):
            for at in range(begin, begin + m, 128):
                some, rest = slice(at, min(at + 128, begin + m)), slice(at, begin + m)
                p, q = np.nonzero(fits(sketch[some, None], sketch[None, rest]))
                out.append(np.stack([ids[at + p], ids[at + q]]))
        return out

    def batch(pairs: list[np.ndarray], hot_rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ab = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
        ab = np.unique(np.stack([ab.min(axis=0), ab.max(axis=0)])[:, ab[0] != ab[1]], axis=1) if ab.size else ab
        hid, hkey = (np.concatenate(x) for x in zip(*hot_rows)) if hot_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        none = lambda k: pa.nulls(k, pa.int64())
        join = lambda x, y: pa.concat_arrays([x, y])
        a, h = ab.shape[1], len(hid)
        return pa.RecordBatch.from_arrays([join(pa.array(ab[0]), none(h)), join(pa.array(ab[1]), none(h)), join(none(a), pa.array(hid)), join(none(a), pa.array(hkey))], names=["a", "b", "id", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # key, id, sketch of the last key, which may go on
        hot_key = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b[c].to_numpy(zero_copy_only=False) for c in ("key", "id", "sketch")]
            cols[2] = cols[2].view(np.uint64)
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            key, ids, sketch = cols
            edge = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            lo, size = edge[:-1], np.diff(edge)
            big = size > hot
            if hot_key is not None and key[0] == hot_key:
                big[0] = True
            hot_key = key[-1] if big[-1] else None
            hot_rows = [(ids[x : x + m], key[x : x + m]) for x, m in zip(lo[big], size[big])]
            closed = ~big
            closed[-1] = False
            pairs = pairs_of(ids, sketch, lo[closed], size[closed])
            held = None if big[-1] else [c[lo[-1] :] for c in cols]
            if pairs or hot_rows:
                yield batch(pairs, hot_rows)
        if held is not None:
            yield batch(pairs_of(held[1], held[2], np.array([0]), np.array([len(held[0])])), [])

    return run


def _in_blocks(rest: DataFrame, sets_: DataFrame, num: int, den: int, hot: int) -> DataFrame:
    """(a, b), a < b: of all rows (id, key) of one key those that sizes and sketches allow, each block of rows met with each other one.

    A key of m rows has ``ceil(m / hot)`` blocks; a row goes to as many cells, and a cell has the rows of two blocks.
    """
    blocks = rest.groupBy("key").agg(F.expr(f"cast(ceil(count(1) * 2 / {hot}) as int)").alias("n_blocks"))
    whole = sets_.select("id", "hashes").mapInArrow(_whole, "id long, sketch long")
    rows = rest.join(blocks, "key").join(whole, "id").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    cells = rows.select("*", other.alias("other")).select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "id", "sketch")
    many = rows.agg(F.sum("n_blocks")).first()[0]
    parts = max(int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-many // ROWS_A_TASK))
    # a cell is never split again: two blocks are about ``hot`` rows, but for chance
    return cells.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_meet(num, den, 1 << 40), MET).select("a", "b")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values, sizes = lists_of(b["hashes"])
        sketch = sketches(mix(values.view(np.uint64)), (np.cumsum(sizes) - sizes), sizes) if len(values) else np.zeros(len(sizes), np.uint64)
        yield pa.RecordBatch.from_arrays([b["id"], pa.array(sketch.view(np.int64))], names=["id", "sketch"])


def partitioned_pairs(todo: list[DataFrame], sets_: DataFrame, num: int, den: int, hot: int = HOT) -> DataFrame:
    """(a, b), a < b: the pairs of sets (id LONG, hashes, alone ARRAY<LONG>) that meet under a key of ``todo`` and could reach the threshold.

    ``todo`` has the rows in slices of the keys, met one after the other, so that the disk holds the shuffle of one slice. The sets of
    keys with more than ``hot`` rows get the signatures of another partition, level by level, each set once however many such keys
    it has; what is hot in the last one is met by blocks.
    """
    spark, of = sets_.sparkSession, len(todo)
    every: list[DataFrame] = []
    rows = (sets_.agg(F.sum(F.size("hashes"))).first()[0] or 0) * KEYS_A_FEATURE
    for level in range(1, LEVELS + 1):
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // (ROWS_A_TASK * of)))
        met = [mine.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_meet(num, den, hot), MET) for mine in todo]
        met = [cut(m.distinct() if of > 1 else m) for m in met]
        every += [m.where("a is not null").select("a", "b") for m in met]
        rest = functools.reduce(DataFrame.unionByName, [m.where("id is not null").select("id", "key") for m in met]).distinct()
        found = functools.reduce(DataFrame.unionByName, every)
        if not rest.take(1):
            return found.distinct()
        if level < LEVELS:
            again = cut(sets_.select("id", "hashes", "alone").join(rest.select("id").distinct(), "id", "left_semi"))
            rows = again.agg(F.sum(F.size("hashes"))).first()[0] * KEYS_A_FEATURE
            todo = [again.mapInArrow(_emit(num, den, level + 1, k, of), EMITTED) for k in range(of)]
    return found.unionByName(_in_blocks(rest, sets_, num, den, hot)).distinct()


def counted(found: DataFrame) -> DataFrame:
    """(h, df, id): how many sets have a feature, and one that does."""
    return found.select("id", F.explode("hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("id").alias("id"))


def with_alone(found: DataFrame, features: DataFrame, num: int, den: int) -> DataFrame:
    """(id, hashes, alone): sets with the features that no other set has; those that have too many of them to match leave."""
    alone = features.where("df = 1").groupBy("id").agg(F.collect_list("h").alias("alone"))
    known = found.select("id", "hashes").join(alone, "id", "left").withColumn("alone", F.coalesce("alone", F.array().cast("array<bigint>")))
    return cut(known.where(F.size("hashes") * num <= (F.size("hashes") - F.size("alone")) * den))


def candidates(sets_: DataFrame, num: int, den: int, hot: int = HOT) -> DataFrame:
    """(a, b), a < b: every pair of sets that shares its signatures and could reach the threshold."""
    known = with_alone(sets_, counted(sets_), num, den)
    return partitioned_pairs([known.mapInArrow(_emit(num, den, 1), EMITTED)], known, num, den, hot)


def similar_pairs(records: DataFrame, key: str, text: str, *, run: int, num: int = 3, den: int = 5, hot: int = HOT) -> DataFrame:
    """(key_a, key_b), smaller first: the different keys whose sets of ``run`` consecutive words have common / all >= num / den."""
    found, members = sets.classes(records, key, text, run)
    exact = sets.verified(candidates(found, num, den, hot), found, "a", "b", num, den)
    return sets.expand(exact, members)
