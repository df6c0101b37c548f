"""Sources: registering, folding equal bodies, numbering, drift, migration, and the manifest of resolved links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T

MANIFEST = ("target", "kind", "status", "source_id", "resolved_from", "sha256", "fetched_at", "note")


def first_rows(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """One row a key, the first in the given order (a window in partitions by key; repeated rows are equal, so any order decides)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def register(sources: DataFrame) -> DataFrame:
    """The source register: a row a source, as first recorded. Null fields sort as empty."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    one = first_rows(sources, "source_id", "recorded_at", blank("schema_version"), blank("url"), blank("title"), blank("sha256"))
    return one.select(
        "source_id", "title", F.coalesce(F.col("source_type"), F.lit("report")).alias("source_type"), "url", "authority_tier", "date_authored",
        T.sha256_short(F.col("sha256")).alias("sha256_short"))


def duplicate_bodies(sources: DataFrame) -> DataFrame:
    """(source_id, first_source_id, sha256): sources whose body another, earlier one (by id) already has. Null bodies repeat nothing.

    The least id of a digest comes from a partial aggregation, so a body that a third of all sources share makes no hot task.
    """
    hashed = sources.where("_body is not null").select("source_id", T.sha256_text(F.col("_body")).alias("sha256")).distinct()
    first = hashed.groupBy("sha256").agg(F.min("source_id").alias("first_source_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return hashed.join(first, "sha256").where("source_id <> first_source_id").select("source_id", "first_source_id", "sha256")


def drifted(sources: DataFrame) -> DataFrame:
    """(source_id): those with a row whose stored hash isn't that of its body."""
    return sources.where(~T.sha256_text(F.coalesce(F.col("_body"), F.lit(""))).eqNullSafe(F.col("sha256"))).select("source_id").distinct()


def next_number(ids: DataFrame, key: str, prefix: str) -> DataFrame:
    """(next_number): one more than the largest number behind the prefix; 1 where there is none."""
    number = F.nullif(F.regexp_extract(key, rf"^{prefix}(\d+)", 1), F.lit("")).cast("long")
    return ids.agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_number"))


def number_new(new: DataFrame, order: str, start: int, prefix: str = "S", width: int = 2) -> DataFrame:
    """Ids for new records in arrival order, without sorting them all in one task: counts per range partition give each its offset."""
    ordered = new.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    from sparkloom.plans.lineage import cut

    ordered = cut(ordered)
    sizes = ordered.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offset = sizes.withColumn("_o", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", F.coalesce("_o", F.lit(0)).alias("_o"))
    n = F.col("_o") + F.row_number().over(Window.partitionBy("_p").orderBy("_i")) + F.lit(start - 1)
    out = ordered.join(F.broadcast(offset), "_p").withColumn("n", n)
    digits = F.col("n").cast("string")
    return out.withColumn("new_id", F.concat(F.lit(prefix), F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits))).drop("_p", "_i", "_o")


def migrate(sources: DataFrame, version: Column | None = None) -> DataFrame:
    """Rows of the first schema, which have no version, brought to the second; the others as they are. Running it again changes nothing."""
    old = (F.col("schema_version") if version is None else version).isNull()
    kind = F.when(F.lower("origin").endswith(".pdf"), "pdf").otherwise("report")
    return sources.select(
        "source_id", F.when(old, F.lit(2)).otherwise(F.col("schema_version")).alias("schema_version"),
        F.when(old, kind).otherwise(F.col("source_type")).alias("source_type"), F.when(~old, F.col("url")).alias("url"),
        F.when(~old, F.col("resolved_from")).alias("resolved_from"), F.when(old, "upgraded").otherwise("unchanged").alias("action"))


def resolve_outcomes(targets: DataFrame, prior: DataFrame, fetched: DataFrame, existing: DataFrame, only: str | None = None) -> DataFrame:
    """What resolving does with each target: the outcome, and the manifest row it leaves.

    targets (ord, target, kind, parent); prior: the manifest; fetched (target, body, transcript_status, error): what fetching gave,
    materialised before; existing (source_id, sha256). Known targets are ``cached``; errors ``failed``; a pending stub stays
    ``transcript_pending`` or is ``fetched`` in place under its own id; a new body that another target or source has is a
    ``duplicate`` of the first. Targets are taken in order, so of two equal new bodies the first is the original.
    """
    rows = targets if only is None else targets.where(F.lower("target").contains(only.lower()))
    p = prior.select("target", F.col("status").alias("was"), F.col("source_id").alias("was_id"), F.col("resolved_from").alias("was_from"), F.col("sha256").alias("was_sha"))
    known = existing.groupBy("sha256").agg(F.min("source_id").alias("known_id"))
    f = fetched.select("target", F.col("error"), F.col("transcript_status"), T.sha256_text(F.col("body")).alias("sha256"))
    joined = rows.join(p, "target", "left").join(f, "target", "left").join(known, "sha256", "left")
    pending = F.coalesce(F.col("transcript_status") == "pending", F.lit(False))
    kept = F.col("was_id").isNotNull() & F.col("was").isin("transcript_pending", "failed")
    stage = (
        F.when(F.col("was").isin("fetched", "duplicate"), "cached")
        .when(F.col("error").isNotNull() | F.col("sha256").isNull(), "failed")
        .when(kept & pending, "transcript_pending")
        .when(kept, "fetched")
        .when(F.col("known_id").isNotNull(), "duplicate")
        .otherwise("new")
    )
    staged = joined.withColumn("stage", stage)
    first = staged.where("stage = 'new'").groupBy("sha256").agg(F.min_by("target", "ord").alias("original"))
    done = staged.join(first, "sha256", "left")
    outcome = F.when(F.col("stage") != "new", F.col("stage")).when(F.col("original") != F.col("target"), "duplicate").when(pending, "transcript_pending").otherwise("fetched")
    return done.select(
        "ord", "target", "kind", outcome.alias("outcome"), F.coalesce("was_id", "known_id").alias("source_id"),
        F.when((F.col("stage") == "new") & (F.col("original") != F.col("target")), F.col("original")).alias("same_as"),
        F.when(kept, F.coalesce("was_from", "parent")).otherwise(F.col("parent")).alias("resolved_from"), F.coalesce("error", F.lit(None)).alias("note"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """A row of counts, zero where an outcome did not occur."""
    return outcomes.agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("fetched", "cached", "duplicate", "transcript_pending", "failed")))


def merge_manifest(current: DataFrame, prior: DataFrame) -> DataFrame:
    """This run's records in order, then those of before that this run did not touch, in theirs. Both have ``ord`` and ``target``."""
    rest = prior.join(current.select("target"), "target", "left_anti").select(F.lit(1).alias("part"), *prior.columns)
    return current.select(F.lit(0).alias("part"), *prior.columns).unionByName(rest)
