"""Filling containers of fixed capacity with items of varying length (problem 8).

Method: bounded-space online packing. Each partition keeps at most ``open_bins`` windows; an item goes into the fullest one
it fits, and when none has room the fullest window is emitted and a fresh one opened. What is still open at the end of a
partition (at most ``open_bins`` windows) is merged: the leftovers of ``fan_in`` partitions are packed together as whole
windows by the same rule, round by round, until one group is left. Windows that a round closes are final; only those still open go
on, and each group has a task of its own, so no task ever sees more than ``fan_in * open_bins``.

Defined results: items of no size take no room and do not come out; an item longer than the capacity is cut into full pieces
and a rest, and no other item is cut; repeated rows are items of their own; an empty table gives no containers.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.tokens import _encoding, safe
from sparkloom.plans.lineage import cut

CAPACITY = 2_048
OPEN_BINS = 64
FAN_IN = 32
PLACED = "bin string, still_open boolean, doc_id long, piece_no int, start_token int, n_tokens int"


class BestFit:
    """At most ``limit`` open windows; ``place`` gives the window an item goes to and closes the fullest when none fits."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit = capacity, limit
        self.room: list[tuple[int, int]] = []  # (room left, window), ascending
        self.made = 0
        self.closed: list[int] = []

    def place(self, size: int) -> int:
        at = bisect.bisect_left(self.room, (size, -1))
        if at < len(self.room):
            room, window = self.room.pop(at)
        else:
            if len(self.room) >= self.limit:
                self.closed.append(self.room.pop(0)[1])
            room, window = self.capacity, self.made
            self.made += 1
        if room == size:
            self.closed.append(window)
        else:
            bisect.insort(self.room, (room - size, window))
        return window


def _pack(ranks: bytes, capacity: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, fit = _encoding(ranks), TaskContext.get().partitionId(), BestFit(capacity, limit)
        held: dict[int, list[tuple]] = {}

        def rows(windows: list[int], still_open: bool) -> pa.RecordBatch:
            out = [(f"{part}-{w}", still_open, *x) for w in windows for x in held.pop(w)]
            columns = list(zip(*out)) or [()] * 6
            kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bin", "still_open", "doc_id", "piece_no", "start_token", "n_tokens"])

        for b in batches:
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                n = len(enc.encode_ordinary(safe(text))) if text else 0
                for piece, start in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - start)
                    held.setdefault(fit.place(size), []).append((doc, piece, start, size))
            yield rows(fit.closed, False)
            fit.closed = []
        yield rows([w for _, w in fit.room], True)

    return run


def _merge(capacity: int, limit: int):
    def run(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        items = [x for b in groups for x in zip(b["bin"].to_pylist(), b["size"].to_pylist(), b["grp"].to_pylist())]
        by_group: dict[int, list] = {}
        for name, size, grp in items:
            by_group.setdefault(grp, []).append((size, name))
        for grp, members in by_group.items():
            fit = BestFit(capacity, limit)
            into: dict[int, str] = {}
            sizes: dict[str, int] = {}
            mine = []
            for size, name in sorted(members, key=lambda x: (-x[0], x[1])):
                target = into.setdefault(fit.place(size), name)
                sizes[target] = sizes.get(target, 0) + size
                mine.append((name, target))
            windows = {w for _, w in fit.room}
            live = {into[w] for w in windows}
            out += [(name, target, sizes[target], target in live, grp) for name, target in mine]
        columns = list(zip(*out)) or [()] * 5
        kinds = (pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bin", "target", "size", "still_open", "grp"])

    return run


def pack_documents(docs: DataFrame, key: str, text: str, ranks: bytes, *, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, fan_in: int = FAN_IN) -> DataFrame:
    """(container, doc_id, piece_no, start_token, n_tokens): what each container holds."""
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    placed = cut(source.mapInArrow(_pack(ranks, capacity, open_bins), PLACED))
    done = placed.where(~F.col("still_open")).withColumn("container", F.col("bin"))
    parts = placed.where("still_open").select("bin").agg(F.max(F.split("bin", "-")[0].cast("int"))).first()[0]
    merged = placed.where("still_open").groupBy("bin").agg(F.sum("n_tokens").cast("int").alias("size"))
    merged = merged.select("bin", F.col("bin").alias("target"), "size", F.split("bin", "-")[0].cast("int").alias("grp"))
    closed = merged.select("bin", "target").limit(0)
    groups = (parts or 0) + 1
    while True:
        heads = merged.select(F.col("target").alias("bin"), "size", F.expr(f"cast(grp div {fan_in} as int)").alias("grp")).dropDuplicates(["bin"])
        groups = -(-groups // fan_in)
        step = heads.repartitionById(max(1, min(groups, 200_000)), F.col("grp") % 200_000).mapInArrow(_merge(capacity, open_bins), "bin string, target string, size int, still_open boolean, grp int")
        step = cut(step)
        moved = merged.select("bin", F.col("target").alias("was")).join(step.withColumnRenamed("bin", "was"), "was")
        if groups <= 1:
            closed = closed.unionByName(moved.select("bin", "target"))
            break
        moved = cut(moved)
        closed = closed.unionByName(moved.where(~F.col("still_open")).select("bin", "target"))
        merged = moved.where("still_open").select("bin", "target", "size", "grp")
    rest = placed.where("still_open").join(closed.select("bin", F.col("target").alias("container")), "bin")
    columns = ["container", "doc_id", "piece_no", "start_token", "n_tokens"]
    return done.select(columns).unionByName(rest.select(columns))
