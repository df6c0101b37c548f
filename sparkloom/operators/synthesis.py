"""Master documents: sections, blocks, citations, and what a finished document must not lack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as T

# The sections a master must have, and those that are not body.
MANDATORY = ("Conflicts", "Gaps", "Appendix: Source Register")
APPENDIX = "Appendix: Source Register"
SPECIAL = MANDATORY


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_no, heading, content): a document cut at the lines starting ``## ``; what stands before is section 0 with no heading.

    The cut is a fold over the document's own lines, within the row: no document is exploded and brought together again.
    Null texts have no sections.
    """
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key), T.lines(F.col(text)).alias("ls"))
    heads = F.filter(F.transform("ls", lambda x, i: F.when(x.startswith("## "), i)), lambda x: x.isNotNull())
    cuts = rows.select(key, "ls", heads.alias("hs"))
    starts = F.concat(F.array(F.lit(-1)), F.col("hs"))
    ends = F.concat(F.col("hs"), F.array(F.size("ls")))
    parts = F.transform(
        F.arrays_zip(starts.alias("s"), ends.alias("e")),
        lambda p: F.struct(
            F.when(p["s"] < 0, F.lit("")).otherwise(T.strip(F.substring(F.get(F.col("ls"), p["s"]), 4, 1 << 30))).alias("heading"),
            F.array_join(F.slice("ls", p["s"] + 2, F.greatest(p["e"] - p["s"] - 1, F.lit(0))), "\n").alias("content"),
        ),
    )
    return cuts.select(key, F.posexplode(parts).alias("section_no", "part")).select(key, "section_no", "part.heading", "part.content")


def first_citations(parts: DataFrame, key: str, form: str = T.CITATION) -> DataFrame:
    """(key, claim_id, location): the first section that cites a claim, the appendix apart; before any heading it is ``preamble``."""
    cites = parts.where(F.col("heading") != APPENDIX).select(key, "section_no", "heading", F.explode(F.array_distinct(T.citations(F.col("content"), form))).alias("claim_id"))
    first = cites.groupBy(key, "claim_id").agg(F.min_by("heading", "section_no").alias("heading"))
    return first.select(key, "claim_id", F.when(F.col("heading") == "", "preamble").otherwise(F.col("heading")).alias("location"))


def prose_faults(parts: DataFrame, key: str, form: str = T.CITATION) -> DataFrame:
    """(key, section_no, heading, n_prose, n_unmarked): body sections without prose, or with prose that cites nothing."""
    prose = F.filter(T.blocks(F.col("content")), T.is_prose)
    body = parts.where((F.col("heading") != "") & ~F.col("heading").isin(*SPECIAL))
    counted = body.select(key, "section_no", "heading", F.size(prose).cast("long").alias("n_prose"), F.size(F.filter(prose, lambda b: ~b.rlike(form))).cast("long").alias("n_unmarked"))
    return counted.where("n_prose = 0 or n_unmarked > 0")


def phantom_citations(parts: DataFrame, key: str, claims: DataFrame, form: str = T.CITATION) -> DataFrame:
    """(key, claim_id): cited ids that no claim has."""
    known = claims.select("claim_id").where("claim_id is not null").distinct()
    return first_citations(parts, key, form).select(key, "claim_id").join(known, "claim_id", "left_anti").select(key, "claim_id")


def first_section(parts: DataFrame, key: str, heading: str) -> DataFrame:
    """(key, content): the first of a document's sections of that heading; later ones of the same name don't count."""
    return parts.where(F.col("heading") == heading).groupBy(key).agg(F.min_by("content", "section_no").alias("content"))


def uncited_winners(parts: DataFrame, key: str, winners: DataFrame, form: str = T.CITATION) -> DataFrame:
    """(claim_id, group_id): claims that must be cited and nowhere are."""
    return winners.join(first_citations(parts, key, form).select("claim_id").distinct(), "claim_id", "left_anti").select("claim_id", "group_id")


def absent_conflicts(parts: DataFrame, key: str, decisions: DataFrame, form: str = T.CITATION) -> DataFrame:
    """(group_id, claim_id): claims in conflict that the first Conflicts section doesn't cite."""
    named = decisions.where("decision = 'CONFLICT'").select("group_id", F.explode("claim_ids").alias("claim_id")).where("claim_id is not null").distinct()
    cited = first_section(parts, key, "Conflicts").select(F.explode(T.citations(F.col("content"), form)).alias("claim_id")).distinct()
    return named.join(cited, "claim_id", "left_anti").select("group_id", "claim_id")


def master_faults(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, reason): todo marks left, mandatory sections that lack, an empty first Gaps section."""
    parts = sections(docs, key, text)
    have = parts.groupBy(key).agg(F.collect_set("heading").alias("heads"), F.min_by(F.when(F.col("heading") == "Gaps", F.size(T.blocks(F.col("content")))), F.when(F.col("heading") == "Gaps", F.col("section_no"))).alias("gaps"))
    todo = docs.where(F.col(text).isNotNull()).select(key, F.col(text).contains("[!todo]").alias("todo"))
    checks = F.array(
        F.when(F.col("todo"), F.struct(F.lit(0).alias("ord"), F.lit("operator todo callouts remain in MASTER.md").alias("reason"))),
        *(F.when(~F.array_contains("heads", m), F.struct(F.lit(i).alias("ord"), F.lit(f"mandatory section '{m}' missing").alias("reason"))) for i, m in enumerate(MANDATORY, 1)),
        F.when(F.coalesce(F.col("gaps"), F.lit(0)) == 0, F.struct(F.lit(9).alias("ord"), F.lit("Gaps section is empty").alias("reason"))),
    )
    return todo.join(have, key).select(key, F.inline(F.array_compact(checks)))
