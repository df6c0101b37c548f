"""Tracing every claim to its decision and place, coverage per source, gates and export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.reconcile import decision_of

# The gates, and which one a stage needs.
GATES = ("01-intake", "02-extract", "03-reconcile", "04-synthesis", "05-audit")
BEFORE = dict(zip(GATES[1:], GATES))
FORMAT = "evidence-master/2"


def trace_matrix(claims: DataFrame, decisions: DataFrame, locations: DataFrame) -> DataFrame:
    """(source_id, claim_id, decision, group_id, location, status) of every claim. ``locations``: (claim_id, location), one a claim."""
    rows = claims.select("source_id", "claim_id").where("claim_id is not null").distinct()
    joined = rows.join(decision_of(decisions), "claim_id", "left").join(locations.select("claim_id", "location"), "claim_id", "left")
    decision = F.when(F.col("group_id").isNull(), "UNDECIDED").otherwise(F.coalesce("decision", F.lit("None")))
    status = (
        F.when((decision == "SUPERSEDED") & ~F.col("winner").eqNullSafe(F.col("claim_id")), F.concat(F.lit("superseded by "), F.coalesce("winner", F.lit("None"))))
        .when(decision == "OUT_OF_SCOPE", "excluded")
        .when(decision == "CONFLICT", "logged in Conflicts")
        .when(F.col("location").isNotNull(), "cited")
        .otherwise("NOT CITED")
    )
    return joined.select("source_id", "claim_id", decision.alias("decision"), F.coalesce("group_id", F.lit("")).alias("group_id"), F.coalesce("location", F.lit("")).alias("location"), status.alias("status"))


def coverage(matrix: DataFrame) -> DataFrame:
    """(source_id, accounted, extracted, coverage): how many of a source's claims have a decision, also as ``a/b``."""
    out = matrix.groupBy("source_id").agg(F.count_if(F.col("decision") != "UNDECIDED").alias("accounted"), F.count(F.lit(1)).alias("extracted"))
    return out.withColumn("coverage", F.concat_ws("/", F.col("accounted").cast("string"), F.col("extracted").cast("string")))


def gate(reasons: DataFrame, key: str, every: DataFrame, *order: str) -> DataFrame:
    """(key, status, n_reasons, reasons): PASS where nothing is found, else FAIL with the reasons in order.

    Reasons carry their place (file, line, check), so the list is the same whatever the shuffle did.
    """
    listed = reasons.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, "reason"))).alias("r"))
    out = every.select(key).distinct().join(listed, key, "left")
    return out.select(
        key, F.when(F.coalesce(F.size("r"), F.lit(0)) > 0, "FAIL").otherwise("PASS").alias("status"), F.greatest(F.coalesce(F.size("r"), F.lit(0)), F.lit(0)).cast("long").alias("n_reasons"),
        F.coalesce(F.transform("r", lambda x: x["reason"]), F.array().cast("array<string>")).alias("reasons"))


def gate_counts(reasons: DataFrame, key: str, every: DataFrame) -> DataFrame:
    """(key, status, n_reasons) as ``gate`` has it, by counts alone, so a key with very many reasons stays a number."""
    out = every.select(key).distinct().join(reasons.groupBy(key).agg(F.count("reason").alias("n")), key, "left").withColumn("n_reasons", F.coalesce("n", F.lit(0)).cast("long"))
    return out.select(key, F.when(F.col("n_reasons") > 0, "FAIL").otherwise("PASS").alias("status"), "n_reasons")


def require_previous(status: dict[str, str], stage: str) -> None:
    """Raise unless the gate right before ``stage`` is PASS; earlier and later ones are not looked at."""
    before = BEFORE.get(stage)
    if before and status.get(before, "PENDING") != "PASS":
        raise RuntimeError(f"gate {before} is {status.get(before, 'PENDING')}, this stage cannot run. Resolve the earlier stage first.")


def next_step(status: dict[str, str], *, brief: bool, sources: bool, sealed: bool) -> str:
    """What a project needs next."""
    if not brief:
        return "brief"
    if not sources:
        return "intake"
    for name, step in (("02-extract", "extract"), ("03-reconcile", "reconcile"), ("04-synthesis", "synthesise"), ("05-audit", "audit")):
        if status.get(name) != "PASS":
            return step
    return "done" if sealed else "seal"
