"""Decisions over claims: coverage, repetition, winners, and the index of claims by tag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as T


def claims_per_source(sources: DataFrame, claims: DataFrame, *, rows_of: str | None = None) -> DataFrame:
    """(source_id, n_claims) of every source, also of those without claims.

    Different ids count, by the source a claim names; with ``rows_of``, a column that says whose file a row stands in, its rows do,
    valid or not, as the gate over files wants it.
    """
    mine = claims.select(F.col(rows_of).alias("source_id")) if rows_of else claims.select("source_id", "claim_id").where("claim_id is not null").distinct()
    counts = mine.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_claims"))
    return sources.select("source_id").distinct().join(counts, "source_id", "left").select("source_id", F.coalesce("n_claims", F.lit(0)).cast("long").alias("n_claims"))


def repeated_claims(claims: DataFrame) -> DataFrame:
    """(claim_id, n_rows, first_recorded): ids that stand in more than one row."""
    return claims.where("claim_id is not null").groupBy("claim_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("recorded_at").alias("first_recorded")).where("n_rows > 1")


def dangling(claims: DataFrame) -> DataFrame:
    """(claim_id, ref): dependencies, as they are written, on ids that no claim has."""
    refs = claims.select("claim_id", F.explode("depends_on").alias("ref")).where("ref is not null").distinct()
    return refs.join(claims.select(F.col("claim_id").alias("ref")).where("ref is not null").distinct(), "ref", "left_anti").select("claim_id", "ref")


def thin_sources(sources: DataFrame, claims: DataFrame, min_bytes: int = 2048, min_claims: int = 3, *, rows_of: str | None = None) -> DataFrame:
    """(source_id, n_bytes, n_claims): sources of more than ``min_bytes`` with fewer than ``min_claims`` claims."""
    size = sources.groupBy("source_id").agg(F.max(F.coalesce(T.utf8_length(F.col("_body")), F.lit(0))).cast("long").alias("n_bytes")).where(F.col("n_bytes") > min_bytes)
    return size.join(claims_per_source(sources, claims, rows_of=rows_of), "source_id").where(F.col("n_claims") < min_claims).select("source_id", "n_bytes", "n_claims")


def locator_warnings(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """(claim_id, warning): video claims without a time, and locators that point elsewhere than their source."""
    kinds = sources.select("source_id", "source_type", F.col("url").alias("source_url")).distinct()
    joined = claims.join(kinds, "source_id")
    loc = F.col("source_locator")
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    late = joined.where((F.col("source_type") == "video-transcript") & ~filled(loc["timestamp"])).select("claim_id", F.lit("video source claim without a timestamp locator").alias("warning"))
    other = joined.where(filled(F.col("source_url")) & filled(loc["url"]) & (loc["url"] != F.col("source_url"))).select("claim_id", F.lit("locator url does not match the source url").alias("warning"))
    return late.unionByName(other).distinct()


def tag_index(claims: DataFrame) -> DataFrame:
    """(tag, claim_id, line): every claim under each of its tags, as the claims index lists it."""
    line = F.concat(
        F.lit("- "), F.col("claim_id"), F.lit(" ("), F.coalesce("source_id", F.lit("None")), F.lit(", "), F.coalesce("claim_type", F.lit("None")), F.lit(", confidence "),
        F.coalesce("confidence_as_stated", F.lit("None")), F.lit(")"), F.coalesce(T.locator_hint(F.col("source_locator")), F.lit("")), F.lit(" "), F.coalesce("claim_text", F.lit("None")))
    return claims.where("claim_id is not null").select(F.explode("topic_tags").alias("tag"), "claim_id", line.alias("line")).where("tag is not null").distinct()


def decided(decisions: DataFrame) -> DataFrame:
    return decisions.select(F.explode("claim_ids").alias("claim_id")).where("claim_id is not null").distinct()


def undecided(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """(claim_id) of claims that no decision names."""
    return claims.select("claim_id").where("claim_id is not null").distinct().join(decided(decisions), "claim_id", "left_anti")


def never_extracted(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """(group_id, claim_id): ids in decisions that no claim has."""
    named = decisions.select("group_id", F.explode("claim_ids").alias("claim_id")).where("claim_id is not null").distinct()
    return named.join(claims.select("claim_id").where("claim_id is not null").distinct(), "claim_id", "left_anti").select("group_id", "claim_id")


def repeated_groups(decisions: DataFrame) -> DataFrame:
    """(group_id, n_rows): ids that several decisions carry."""
    return decisions.where("group_id is not null").groupBy("group_id").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def contested_claims(decisions: DataFrame) -> DataFrame:
    """(claim_id, first_group, n_groups): claims that stand in more than one group; the first is that recorded first."""
    named = decisions.where("group_id is not null").select("group_id", "recorded_at", F.explode("claim_ids").alias("claim_id")).where("claim_id is not null")
    spread = named.groupBy("claim_id").agg(F.countDistinct("group_id").alias("n_groups"), F.min_by("group_id", F.struct("recorded_at", "group_id")).alias("first_group"))
    return spread.where("n_groups > 1").select("claim_id", "first_group", "n_groups")


def winners(decisions: DataFrame) -> DataFrame:
    """(claim_id, group_id) of every claim that must be cited; of several groups the one recorded last counts."""
    accepted = decisions.where(F.col("decision").isin("CORROBORATED", "UNIQUE")).select("group_id", "recorded_at", F.explode("claim_ids").alias("claim_id"))
    won = decisions.where("decision = 'SUPERSEDED'").select("group_id", "recorded_at", F.col("winner").alias("claim_id"))
    both = accepted.unionByName(won).where("claim_id is not null and group_id is not null")
    return both.groupBy("claim_id").agg(F.max_by("group_id", F.struct("recorded_at", "group_id")).alias("group_id"))


def decision_of(decisions: DataFrame) -> DataFrame:
    """(claim_id, group_id, decision, winner): the decision on each claim, the last recorded of several."""
    named = decisions.where("group_id is not null").select("group_id", "decision", "winner", "recorded_at", F.explode("claim_ids").alias("claim_id")).where("claim_id is not null")
    order = F.struct("recorded_at", "group_id", F.coalesce("decision", F.lit("")).alias("d"), F.coalesce("winner", F.lit("")).alias("w"))
    last = named.groupBy("claim_id").agg(F.max_by(F.struct("group_id", "decision", "winner"), order).alias("x"))
    return last.select("claim_id", "x.group_id", "x.decision", "x.winner")


def section_plan(claims: DataFrame, decisions: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_id, section_ord, tag, title, claim_id): the section each winning claim goes to.

    That is the first of the project's order that the claim is tagged with; tags outside the order follow it alphabetically.
    """
    ranks = projects.select("project_id", F.posexplode("section_order").alias("rank", "tag")).where("tag is not null").groupBy("project_id", "tag").agg(F.min("rank").alias("rank"))
    tagged = claims.join(winners(decisions).select("claim_id"), "claim_id").select("project_id", "claim_id", F.explode("topic_tags").alias("tag")).where("tag is not null and project_id is not null").distinct()
    placed = tagged.join(ranks, ["project_id", "tag"], "left").withColumn("place", F.struct(F.coalesce("rank", F.lit(1 << 30)).alias("rank"), F.col("tag").alias("t")))
    best = placed.groupBy("project_id", "claim_id").agg(F.min("place").alias("place"))
    return best.select("project_id", F.when(F.col("place.rank") < (1 << 30), F.col("place.rank")).cast("int").alias("section_rank"), F.col("place.t").alias("tag"), T.section_title(F.col("place.t")).alias("title"), "claim_id")


def gate_checks(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """(project_id, claims_total, claims_decided, decision_groups)."""
    total = claims.where("claim_id is not null").groupBy("project_id").agg(F.countDistinct("claim_id").alias("claims_total"))
    named = decisions.groupBy("project_id").agg(F.countDistinct("group_id").alias("decision_groups"))
    seen = decisions.select("project_id", F.explode("claim_ids").alias("claim_id")).where("claim_id is not null").groupBy("project_id").agg(F.countDistinct("claim_id").alias("claims_decided"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return total.join(seen, "project_id", "full").join(named, "project_id", "full").select("project_id", *(zero(c) for c in ("claims_total", "claims_decided", "decision_groups")))

