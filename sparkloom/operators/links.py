"""Links inside sources: finding them, in order, and who mentions each first."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as T

# Fixed value: a markdown destination, a bare address, or a span between backticks, whichever starts first. The possessive
# quantifiers keep the JVM's matcher from recursing on very long destinations.
TARGET = r"\]\((?:[^()\s]++|\([^()]*\))++\)|https?://[^\s<>\"'`\]]+|`[^`\n]+`"


def discover(sources: DataFrame, key: str, body: str, origin: str, files: DataFrame | None = None) -> DataFrame:
    """(key, pos, raw, kind): the targets of each body, in order; repeats within a body leave.

    An address inside backticks is consumed and dropped. Paths count only where ``files`` (path STRING), a listing of what
    exists, has them, as they are or relative to the origin's folder. Null bodies have no targets.
    """
    found = sources.where(F.col(body).isNotNull()).select(F.col(key), F.col(origin).alias("origin"), F.posexplode(F.regexp_extract_all(F.col(body), F.lit(f"({TARGET})"), F.lit(1))).alias("pos", "m"))
    inner = F.when(F.col("m").startswith("]("), F.expr("substring(m, 3, length(m) - 3)")).when(F.col("m").startswith("`"), F.expr("substring(m, 2, length(m) - 2)")).otherwise(F.col("m"))
    form = F.when(F.col("m").startswith("]("), "dest").when(F.col("m").startswith("`"), "span").otherwise("bare")
    rows = found.select(key, "pos", "origin", form.alias("form"), inner.alias("raw"))
    web = rows.where((F.col("form") == "dest") & F.col("raw").rlike("(?i)^https?://")).select(key, "pos", "raw")
    bare = rows.where(F.col("form") == "bare").select(key, "pos", T.strip_url(F.col("raw")).alias("raw")).where("raw <> ''")
    urls = web.unionByName(bare).withColumn("kind", T.classify_target(F.col("raw")))
    if files is not None:
        path = T.strip(F.col("raw"))
        suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
        local = rows.where((F.col("form") != "bare") & suffix.isin(*T.SUFFIXES) & ~path.rlike("(?i)^[a-z][a-z0-9+.-]*://"))
        folder = F.when(F.coalesce("origin", F.lit("")).rlike("(?i)^[a-z][a-z0-9+.-]*://"), F.lit(None)).otherwise(F.regexp_replace(F.coalesce("origin", F.lit("")), r"[^/]*$", ""))
        local = local.select(key, "pos", F.when(path.startswith("/"), path).otherwise(F.concat(folder, path)).alias("raw"))
        urls = urls.unionByName(local.join(files.select(F.col("path").alias("raw")).distinct(), "raw", "left_semi").withColumn("kind", F.lit("local")))
    return urls.groupBy(key, "raw").agg(F.min(F.struct("pos", "kind")).alias("x")).select(key, "x.pos", "raw", "x.kind")


def local_files(sources: DataFrame, body: str, origin: str) -> DataFrame:
    """(path): the existing files that bodies name in destinations or between backticks, as ``discover`` takes them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            there = set()
            for text, home in zip(frame["body"], frame["origin"]):
                folder = None if re.match(r"(?i)[a-z][a-z0-9+.-]*://", home) else re.sub(r"[^/]*$", "", home)
                for m in re.findall(r"\]\((?:[^()\s]|\([^()]*\))+\)|`[^`\n]+`", text):
                    name = (m[2:-1] if m[0] == "]" else m[1:-1]).strip()
                    if Path(name).suffix.lower() in T.SUFFIXES and (name.startswith("/") or folder is not None):
                        path = name if name.startswith("/") else folder + name
                        if os.path.isfile(path):
                            there.add(path)
            yield pd.DataFrame({"path": sorted(there)}, dtype="object")

    rows = sources.where(F.col(body).isNotNull()).select(F.col(body).alias("body"), F.coalesce(F.col(origin), F.lit("")).alias("origin"))
    return rows.mapInPandas(run, "path string").distinct()


def first_mentions(targets: DataFrame, key: str) -> DataFrame:
    """(raw, kind, parent, pos): each target once, under the source that mentions it first (by source, then place)."""
    first = targets.groupBy("raw").agg(F.min(F.struct(F.col(key).alias("parent"), "pos", "kind")).alias("x"))
    return first.select("raw", "x.kind", "x.parent", "x.pos")
