"""Encoding of a whole corpus with a public tokenizer (problem 7).

Method: overlapping chunk encoding. A text longer than ``chunk_chars`` becomes overlapping chunks, which are pre-tokenised in
parallel; where two neighbours share a pre-token boundary within their overlap they have resynchronised, and the text is cut
there; the pieces between cuts are encoded in parallel and their ids put together in order. A stretch in which neighbours
never agree (one run of letters longer than a chunk) stays one piece, so the ids are always those of the whole text. Decoding
concatenates the raw bytes of the ids. Shorter texts are one piece and need no shuffle.

Defined results: null and empty texts give an empty list; strings that look like special tokens are ordinary text; rows that
repeat come out as often; extra columns are left out; an empty table gives an empty table. Positions are in code points.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("SPARKLOOM_TOKENIZERS", "/opt/tokenizers")
# Fixed value: how the public byte-level vocabulary splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK_CHARS = 8_192
OVERLAP_CHARS = 256


@functools.lru_cache(maxsize=4)
def _encoding(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


@functools.lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def vocabulary(name: str = "byte_bpe_50k", folder: str | None = None) -> bytes:
    """The rank file's bytes (under a megabyte), which travel with the plan: executors need not have the file."""
    with open(os.path.join(folder or TOKENIZER_DIR, f"{name}.tiktoken"), "rb") as f:
        return f.read()


def decode(ids: list[int], ranks: bytes) -> bytes:
    enc = _encoding(ranks)
    return b"".join(enc.decode_single_token_bytes(i) for i in ids)


def boundaries(text: str) -> list[int]:
    """Starts of the pre-tokens of ``text``."""
    return [m.start() for m in _pattern().finditer(text)]


def safe(text: str) -> str:
    """Text as the encoder takes it: lone surrogates, which UTF-8 cannot hold, become U+FFFD."""
    return text.encode("utf-8", "replace").decode("utf-8") if any("\ud800" <= c <= "\udfff" for c in text) else text


def _zones(overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        for b in batches:
            own, after, sure = [], [], []
            for text, lo, hi in zip(b["piece"].to_pylist(), b["core_lo"].to_pylist(), b["core_hi"].to_pylist()):
                # lo, hi: where the chunk's own part starts and ends within the piece. A cut after white space is no cut: what
                # white space becomes depends on what follows it
                starts = [p for p in boundaries(text) if p and not text[p - 1].isspace()]
                own.append([p - lo for p in starts if lo <= p < lo + overlap])
                after.append([p - hi for p in starts if hi <= p < hi + overlap])
                # a single blank between words starts a pre-token whatever came before
                sure.append([p - lo for p in starts if lo <= p < lo + overlap and text[p] == " " and not text[p + 1 : p + 2].isspace() and p + 1 < len(text)])
            yield pa.RecordBatch.from_arrays(
                [b["one"], b["n"], pa.array(own, ints), pa.array(after, ints), pa.array(sure, ints)], names=["one", "n", "own_starts", "next_starts", "sure_starts"]
            )

    return run


def _blocks(long_docs: DataFrame, chunk: int) -> DataFrame:
    """(one, blocks): each text cut into blocks of ``chunk`` characters, in one pass over it."""
    return long_docs.select("one", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}+"), F.lit(0)).alias("blocks"))


def _cuts(blocks: DataFrame, overlap: int) -> DataFrame:
    """(one, n, at, piece, before): where in block n the text may be cut (null: nowhere), the piece that goes on behind it and the one before.

    A piece is numbered by the block it starts in.
    """
    # a chunk starts one overlap early, to get into step, and ends two late: the zone after its end, and what closes the zone's last pre-token
    around = lambda b, i: F.concat(
        F.when(i > 0, F.right(F.get("blocks", F.greatest(i - 1, F.lit(0))), F.lit(overlap))).otherwise(""), b, F.left(F.coalesce(F.get("blocks", i + 1), F.lit("")), F.lit(2 * overlap)))
    chunks = blocks.select("one", F.posexplode(F.transform("blocks", lambda b, i: F.struct(around(b, i).alias("piece"), F.length(b).alias("size")))).alias("n", "c"))
    chunks = chunks.select("one", "n", "c.piece", F.when(F.col("n") == 0, 0).otherwise(overlap).alias("core_lo"), (F.when(F.col("n") == 0, 0).otherwise(overlap) + F.col("c.size")).alias("core_hi"))
    chunks = chunks.repartition("one", "n")  # one long text must not stay in one task
    zones = chunks.mapInArrow(_zones(overlap), "one struct<key:bigint,digest:string>, n int, own_starts array<int>, next_starts array<int>, sure_starts array<int>")
    w = Window.partitionBy("one").orderBy("n")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    agreed = F.array_min(F.array_intersect(F.col("own_starts"), F.lag("next_starts").over(w)))
    # a chunk is in step if it agrees with a neighbour that is; behind one that is not, only sure starts count
    out_of_step = F.max(((F.col("n") > 0) & F.col("agreed").isNull()).cast("int")).over(so_far)
    at = F.when(F.col("n") == 0, 0).when(out_of_step == 0, F.col("agreed")).otherwise(F.array_min("sure_starts"))
    cut = zones.withColumn("agreed", agreed).withColumn("at", at).withColumn("piece", F.max(F.when(F.col("at").isNotNull(), F.col("n"))).over(so_far))
    return cut.select("one", "n", "at", "piece", F.lag("piece").over(w).alias("before"))


def _encode(ranks: bytes, keep: list[str] = ["key", "n"]):  # noqa: B006
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(ranks)
        for b in batches:
            ids = [enc.encode_ordinary(safe(t)) if t else [] for t in b["piece"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keep), pa.array(ids, pa.list_(pa.int32()))], names=[*keep, "ids"])

    return run


def encode_corpus(docs: DataFrame, key: str, text: str, ranks: bytes, *, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """(key, ids ARRAY<INT>) of each row; ``key`` is a BIGINT."""
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    is_long = F.coalesce(F.length("text"), F.lit(0)) > chunk_chars
    kind = "key long, n int, ids array<int>"
    short = docs.where(~is_long).select("key", F.lit(0).alias("n"), F.col("text").alias("piece")).mapInArrow(_encode(ranks), kind).select("key", "ids")
    # each different long text under a key once, with the number of its rows
    long_docs = docs.where(is_long).groupBy("key", F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    long_docs = long_docs.select("key", F.struct("key", "digest").alias("one"), "text", "copies")
    blocks = _blocks(long_docs, chunk_chars)
    halves = blocks.select("one", F.posexplode("blocks").alias("n", "block")).join(_cuts(blocks, overlap_chars), ["one", "n"])
    # what of a block stands before its cut belongs to the piece before, the rest to the piece behind
    at = F.coalesce("at", F.lit(0))
    halves = halves.select("one", "n", F.inline(F.array(
        F.struct(F.coalesce("before", "piece").alias("piece"), F.lit(0).alias("half"), F.expr("left(block, coalesce(at, 0))").alias("part")),
        F.struct(F.col("piece").alias("piece"), F.lit(1).alias("half"), F.substring("block", at + 1, F.length("block")).alias("part")))))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "half", "part"))), lambda x: x["part"]), "")
    pieces = halves.where("part <> ''").groupBy("one", F.col("piece").alias("n")).agg(joined.alias("piece"))
    whole = (
        pieces.select("one", "n", "piece").mapInArrow(_encode(ranks, ["one", "n"]), "one struct<key:bigint,digest:string>, n int, ids array<int>")
        .groupBy("one")
        .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "ids"))), lambda x: x["ids"])).alias("ids"))
        .join(long_docs.select("one", "copies"), "one")
        .select(F.col("one.key").alias("key"), "ids", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("key", "ids")
    )
    return short.unionByName(whole).withColumnRenamed("key", key)
