"""References to records that do not exist (problem 3).

Parent and child keys go into one long, tagged relation; one aggregation by parent table and key (partial on the map side,
so a hot key costs one row per task) tells what is known of each key; keys without fault leave, and the references of the
others come out with their reason. Counts by table and month are a second aggregation.

Defined results: ids in references are trimmed and upper-cased; null and blank ones are no references; a reference held by
several rows of one record counts once, at the earliest time; rows without a key of their own refer under a null key; a
reference without any time is never ``late`` and has a null month; an empty parent table makes every reference ``missing``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reference:
    """``ids`` of ``child`` (a column of ids, or of arrays of ids) refer to the records of ``parent``."""

    name: str
    child: DataFrame
    key: str
    ids: str
    parent: str
    time: str = "recorded_at"


@dataclass(frozen=True)
class Parent:
    name: str
    rows: DataFrame
    key: str
    time: str = "recorded_at"
    deleted: str = "deleted_at"


def tidy(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"^\s+|\s+$", ""))


def references(refs: list[Reference]) -> DataFrame:
    """One row per referring table, record and target: (parent_table, target_id, ref_table, ref_key, ref_time)."""
    out = None
    for r in refs:
        many = r.child.schema[r.ids].dataType.typeName() == "array"
        rows = r.child.select(
            F.lit(r.parent).alias("parent_table"), F.lit(r.name).alias("ref_table"), F.col(r.key).cast("string").alias("ref_key"),
            F.col(r.time).alias("ref_time"), (F.explode(r.ids) if many else F.col(r.ids)).alias("raw"))
        rows = rows.select("parent_table", tidy(F.col("raw")).alias("target_id"), "ref_table", "ref_key", "ref_time")
        rows = rows.where(F.col("target_id") != "")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("parent_table", "target_id", "ref_table", "ref_key").agg(F.min("ref_time").alias("ref_time"))


def find_orphans(refs: list[Reference], parents: list[Parent]) -> DataFrame:
    """(ref_table, ref_month, ref_key, target_id, reason) of each faulty reference."""
    children = references(refs)
    kind = children.schema["ref_time"].dataType
    long = children.select(
        "parent_table", "target_id", F.lit(0).alias("is_parent"), F.lit(0).alias("gone"), F.lit(None).cast(kind).alias("born"),
        F.col("ref_time").alias("first_use"))
    for p in parents:
        long = long.unionByName(p.rows.where(F.col(p.key).isNotNull()).select(
            F.lit(p.name).alias("parent_table"), F.col(p.key).alias("target_id"), F.lit(1).alias("is_parent"),
            F.col(p.deleted).isNotNull().cast("int").alias("gone"), F.col(p.time).cast(kind).alias("born"), F.lit(None).cast(kind).alias("first_use")))
    known = (
        long.groupBy("parent_table", "target_id")
        .agg(
            F.max("is_parent").alias("is_parent"),
            F.max("gone").alias("gone"),
            F.min("born").alias("born"),
            F.min("is_parent").alias("unreferenced"),
            F.min("first_use").alias("first_use"),
        )
        .where("unreferenced = 0 and (is_parent = 0 or gone = 1 or born > first_use)")
        .drop("unreferenced", "first_use")
    )
    reason = (
        F.when(F.col("is_parent") == 0, "missing")
        .when(F.col("gone") == 1, "deleted")
        .when(F.col("born") > F.col("ref_time"), "late")
    )
    return (
        children.join(known, ["parent_table", "target_id"])
        .withColumn("reason", reason)
        .where("reason is not null")
        .select("ref_table", F.substring(F.col("ref_time").cast("string"), 1, 7).alias("ref_month"), "ref_key", "target_id", "reason")
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans and referring records per table, month and reason."""
    return found.groupBy("ref_table", "ref_month", "reason").agg(
        F.count(F.lit(1)).alias("n_references"), F.countDistinct("target_id").alias("n_targets"))
