"""Likely duplicate or conflicting claims: the exact set-similarity self-join, and its numbering.

Only records that share a value (a tag) are compared, so a record goes to a cell for each of its tags; a tag of many records is cut
into blocks, and every two of its blocks are a cell. A cell holds its sets whole, so pairs are verified where they meet and nothing
but pairs leaves it; a pair that shares several tags comes from the cell of the first. What meets within a cell is found by prefix
filtering with positions: elements are ranked rare first; sets of similarity t share an element among their first n - ceil(t n) + 1,
and what stands behind one that they share must still allow the overlap. Parities of 256 bits, which differ in no more bits
than the sets in elements, drop most of the rest; the others are counted on the whole sets, in integers.

Scale: elements travel as the ranks of the ``HEAVY`` most frequent ones, two bytes each, and as 64-bit hashes of the others; the list
of those is a bounded table sent to the workers, and no result depends on it. A cell has two blocks of about ``BLOCK`` sets, so no task
holds more; the shuffle has a row for each tag of a record and block of the tag. Hashes that collide could only join a pair more
or less in a set of billions of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import round3, tokens
from sparkloom.plans.lineage import cut

# Fixed value: the least similarity of a candidate pair, 7/20 = 0.35.
NUM, DEN = 7, 20
HEAVY = 50_000  # at most 65,536, as a rank is held in two bytes
BLOCK = 65_536
FEW, AT_ONCE = 48, 1_000_000
WORDS = 4  # of 64 bits, for parities


def frequent_elements(rows: DataFrame) -> np.ndarray:
    """The at most ``HEAVY`` most frequent of the elements that stand in more than one row of (e ARRAY<LONG>)."""
    seen = rows.select(F.explode("e").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    return np.array([r["h"] for r in seen.orderBy(F.desc("df"), "h").limit(HEAVY).select("h").collect()], np.int64)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _coded(heavy: np.ndarray, others: list[str]):
    """Sets ``e`` of hashes as ranks among the frequent elements (``common``) and the hashes of the others (``other``)."""
    by_hash = np.argsort(heavy, kind="stable")
    known = heavy[by_hash]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            values, sizes = _lists(b["e"])
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(known, values), max(0, len(known) - 1))
            frequent = known[at] == values if len(known) else np.zeros(len(values), bool)
            rank = by_hash[at[frequent]] if len(known) else np.zeros(0, np.int64)
            lists = []
            for mine, held in ((frequent, pa.array(rank.astype(np.uint16).view(np.int16))), (~frequent, pa.array(values[~frequent]))):
                ends = np.append(0, np.cumsum(np.bincount(owner[mine], minlength=len(sizes)))).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(ends), held))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in others), *lists], names=[*others, "common", "other"])

    return run


def _shared(i: np.ndarray, j: np.ndarray, values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, value) of what the lists i[k] and j[k] both have, in order. ``values``: small numbers, different within a list."""
    rows = np.concatenate([i, j])
    n = sizes[rows]
    at = np.repeat(starts[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    both = np.sort((np.repeat(np.tile(np.arange(len(i)), 2), n) << 32) | values[at])
    both = both[1:][both[1:] == both[:-1]]
    return both >> 32, both & 0xFFFFFFFF


def _met(entry: np.ndarray, group: np.ndarray, room: np.ndarray, need: np.ndarray, side: np.ndarray, sketch: np.ndarray, allowed: np.ndarray) -> Iterator[np.ndarray]:
    """[i, j], i < j, of the rows whose entries are in one group and could be similar. ``entry``: rows, ordered by ``group``.

    ``allowed``: sets of similarity num / den differ in (den - num) / (den + num) of their sizes' sum at most. ``room``: of an entry, what is left from it on; ``need``: of a row; ``side``: -1, or the block of the cell the row is in.
    """

    def likely(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        i, j = entry[p], entry[q]
        differ = np.zeros(len(i), np.int32)
        for word in sketch:
            differ += np.bitwise_count(word[i] ^ word[j])
        good = (differ * allowed[2] <= allowed[1] * ((need[i] + need[j]) // allowed[0])) & (i != j)
        return np.stack([np.minimum(i, j)[good], np.maximum(i, j)[good]])

    lo = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.append(lo, len(group)))
    wants, sides = need[entry], side[entry]
    for m in np.unique(size[(size > 1) & (size <= FEW)]):
        begin = lo[size == m]
        a, b = np.triu_indices(int(m), 1)
        step = max(1, AT_ONCE // len(a))
        for at in range(0, len(begin), step):
            rows = begin[at : at + step, None]
            p, q = (rows + a).ravel(), (rows + b).ravel()
            good = (room[p] >= wants[q]) & (room[q] >= wants[p]) & ((sides[p] < 0) | (sides[p] != sides[q]))
            yield likely(p[good], q[good])
    for begin, m in zip(lo[size > FEW], size[size > FEW]):
        end = begin + m
        if sides[begin] < 0:
            first, second = (begin, end), (begin, end)
        else:  # the entries of one block stand before those of the other
            middle = begin + int(np.searchsorted(sides[begin:end], 1))
            first, second = (begin, middle), (middle, end)
        step = max(1, AT_ONCE // max(1, second[1] - second[0]))
        for at in range(*first, step):
            upto = min(at + step, first[1])
            start = max(at, second[0])
            good = (room[at:upto, None] >= wants[None, start : second[1]]) & (wants[at:upto, None] <= room[None, start : second[1]])
            k = np.flatnonzero(good)
            p, q = at + k // (second[1] - start), start + k % (second[1] - start)
            if sides[begin] < 0:
                p, q = p[p < q], q[p < q]
            yield likely(p, q)


PAIRS = "x string, y string, shared_tags string, common long, n_all long"


def _pairs_of_cells(num: int, den: int):
    """Over rows sorted by cell: the pairs of each cell whose first shared tag it stands for."""

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        column = lambda c: t[c].combine_chunks() if t.num_rows else None
        cell, side = column("cell").to_numpy(zero_copy_only=False), column("side").to_numpy(zero_copy_only=False).astype(np.int64)
        (ranks, n_ranks), (others, n_others) = _lists(column("common")), _lists(column("other"))
        rows, sizes = len(cell), n_ranks + n_others
        owner = np.concatenate([np.repeat(np.arange(rows), n_ranks), np.repeat(np.arange(rows), n_others)])
        _, code, df = np.unique(np.concatenate([ranks.view(np.uint16).astype(np.int64), others]), return_inverse=True, return_counts=True)
        rank = np.empty(len(df), np.int64)
        rank[np.argsort(df, kind="stable")] = np.arange(len(df))
        held = np.sort((owner << 32) | rank[code])
        owner, values = (held >> 32).astype(np.int32), (held & 0xFFFFFFFF).astype(np.int32)
        n_values = len(df)
        del held, code, df, rank, ranks, others
        starts = np.cumsum(sizes) - sizes
        bit = ((values + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        word, flag = bit % np.uint64(WORDS), np.uint64(1) << ((bit // np.uint64(WORDS)) % np.uint64(64))
        sketch = np.stack([np.bitwise_xor.reduceat(np.where(word == k, flag, np.uint64(0)), starts) for k in range(WORDS)])
        del bit, word, flag
        need = (sizes * num).astype(np.int32)
        pos = (np.arange(len(owner)) - starts[owner]).astype(np.int32)
        mine = np.flatnonzero(pos < (sizes - (sizes * num + den - 1) // den + 1)[owner])
        _, at_cell = np.unique(cell, return_inverse=True)
        group = at_cell[owner[mine]] * n_values + values[mine]
        order = np.lexsort((side[owner[mine]], group))
        mine, group = mine[order], group[order]
        entry = owner[mine]
        room = ((sizes[entry] - pos[mine]) * (den + num) - need[entry]).astype(np.int32)
        del pos, mine, order
        met, some = np.zeros(0, np.int64), []
        for i, j in _met(entry, group, room, need, side, sketch, np.array([num, den - num, den + num])):
            some.append(i.astype(np.int64) * rows + j)
            if sum(map(len, some)) > AT_ONCE:
                met, some = np.unique(np.concatenate([met, *some])), []
        met = np.unique(np.concatenate([met, *some]))
        names = column("tags")
        tag_lists, n_tags = names.flatten().dictionary_encode(), names.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ordered = sorted(tag_lists.dictionary.to_pylist())
        place = {tag: k for k, tag in enumerate(ordered)}
        tags = np.array([place[x] for x in tag_lists.dictionary.to_pylist()], np.int64)[tag_lists.indices.to_numpy()]
        tag_starts, texts, keys = np.cumsum(n_tags) - n_tags, pa.array(ordered), column("key")
        own = tags[tag_starts + column("nth").to_numpy(zero_copy_only=False)]
        for at in range(0, len(met), AT_ONCE // 16):
            i, j = np.divmod(met[at : at + AT_ONCE // 16], rows)
            k, shared = _shared(i, j, tags, tag_starts, n_tags)
            first = shared[np.searchsorted(k, np.arange(len(i)))] == own[i]
            i, j = i[first], j[first]
            common = np.bincount(_shared(i, j, values, starts, sizes)[0], minlength=len(i))
            every = sizes[i] + sizes[j] - common
            good = common * den >= every * num
            i, j, common, every = i[good], j[good], common[good], every[good]
            k, shared = _shared(i, j, tags, tag_starts, n_tags)
            ends = pa.array(np.append(0, np.cumsum(np.bincount(k, minlength=len(i)))).astype(np.int32))
            joined = pc.binary_join(pa.ListArray.from_arrays(ends, texts.take(pa.array(shared))), ",")
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(i)), keys.take(pa.array(j)), joined, pa.array(common.astype(np.int64)), pa.array(every)], names=["x", "y", "shared_tags", "common", "n_all"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # whole cells up to BLOCK rows, and the last one, which may go on
        many = 0
        for b in batches:
            if not b.num_rows:
                continue
            cell = b["cell"].to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0] if not held or held[-1]["cell"][-1].as_py() != cell[0] else np.zeros(0, np.int64), np.flatnonzero(np.diff(cell)) + 1]).astype(np.int64)
            begin = 0
            for edge in edges:  # a cell begins here
                if many + edge - begin >= BLOCK:
                    yield from solve(pa.Table.from_batches([*held, b.slice(begin, edge - begin)]))
                    held, many, begin = [], 0, int(edge)
            held.append(b.slice(begin))
            many += b.num_rows - begin
        if many:
            yield from solve(pa.Table.from_batches(held))

    return run


def candidate_pairs(claims: DataFrame, *, num: int = NUM, den: int = DEN) -> DataFrame:
    """(claim_id_a, claim_id_b, shared_tags, token_overlap): different claims that share a tag and whose token sets overlap.

    Claims without a text match nothing; tags are compared as they are written; rows that repeat count once.
    """
    hashes: Column = F.array_sort(F.transform(tokens(F.col("claim_text")), lambda w: F.xxhash64(w)))
    rows = claims.where(F.col("claim_id").isNotNull())
    tags = F.filter("topic_tags", lambda x: x.isNotNull())
    rows = rows.select(F.col("claim_id").alias("key"), F.xxhash64("claim_text").alias("t0"), F.xxhash64(F.lit(1), F.reverse("claim_text")).alias("t1"), tags.alias("tags"), hashes.alias("e"))
    coded = rows.mapInArrow(_coded(frequent_elements(rows), ["key", "t0", "t1", "tags"]), "key string, t0 long, t1 long, tags array<string>, common array<smallint>, other array<bigint>")
    whole = coded.groupBy("key").agg(F.collect_set(F.struct("t0", "t1", "common", "other")).alias("sets"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))
    whole = whole.where(F.size("tags") > 0).select("key", "tags", F.explode("sets").alias("s")).where(F.size("s.common") + F.size("s.other") > 0)
    # tags of more than a block, a bounded share of the rows each
    counts = rows.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1").collect()
    spark = claims.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(r["blocks"] * (r["blocks"] + 1) // 2 for r in counts))
    blocks = spark.createDataFrame([(r["tag"], r["blocks"]) for r in counts], "tag string, blocks int")
    each = whole.select("key", "tags", "s.*", F.posexplode("tags").alias("nth", "tag")).join(F.broadcast(blocks), "tag", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    each = each.withColumn("mine", F.pmod(F.xxhash64("key", "t0"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = each.select(
        F.xxhash64("tag", F.least("mine", "with"), F.greatest("mine", "with")).alias("cell"),
        F.when(F.col("mine") == F.col("with"), -1).otherwise(F.when(F.col("mine") < F.col("with"), 0).otherwise(1)).cast("tinyint").alias("side"),
        "nth", "key", "tags", "common", "other")
    found = cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(_pairs_of_cells(num, den), PAIRS).where("x <> y")
    return found.select(F.least("x", "y").alias("claim_id_a"), F.greatest("x", "y").alias("claim_id_b"), "shared_tags", round3(F.col("common") / F.col("n_all")).alias("token_overlap"))


def numbered(pairs: DataFrame) -> DataFrame:
    """Candidates P001, P002... in order of their claims.

    The pairs are counted by their first claim; the claims are sorted in ranges, and a claim's first number is what stands in the ranges
    and claims before. So nothing but counts is kept, and no task holds more than a range of claims or the pairs of one.
    """
    counts = pairs.groupBy("claim_id_a").agg(F.count(F.lit(1)).alias("n"))
    ranges = cut(cut(counts).sort("claim_id_a").withColumn("part", F.spark_partition_id()))
    sums = {r[0]: r[1] for r in ranges.groupBy("part").agg(F.sum("n")).collect()}  # a row a task
    before, begins = 0, []
    for part in sorted(sums):
        begins += [F.lit(part), F.lit(before)]
        before += sums[part]
    begin = F.create_map(*begins)[F.col("part")] if begins else F.lit(0)
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("claim_id_a"))
    first = ranges.select("claim_id_a", (begin + upto - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("claim_id_a").orderBy("claim_id_b"))
    n = (F.col("before") + F.col("nth")).cast("string")
    out = pairs.withColumn("nth", nth).join(first, "claim_id_a")
    return out.select(F.concat(F.lit("P"), F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n)).alias("candidate_id"), *pairs.columns)
