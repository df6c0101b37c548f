"""Validation of claims, decisions and sources: every fault of a record, in the order in which it is looked for.

A record is read in one of two ways, as a JSON line (VARIANT: a missing key, a null and a wrong type are told apart) or as a row
of a table (a null stands for a null). Both give the same named parts, from which one list of checks makes the messages; so a
message has one source. An enum value that is no string, and a list of ids that is no list, are faults, not errors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from sparkloom.functions.text import TIMESTAMP, is_blank

# The fields, enums and formats of the evidence format.
CLAIM_ID = r"^S\d{2}-C\d{3}$"
GROUP_ID = r"^G\d{3}$"
SOURCE_ID = r"^S\d{2}$"
CLAIM_FIELDS = ("claim_id", "source_id", "claim_text", "claim_type", "topic_tags", "supporting_quote_location", "confidence_as_stated", "depends_on")
LOCATOR_KEYS = ("url", "page", "timestamp", "anchor")
# The entries that fields may have; the messages of the checks below are fixed values too, word for word.
CLAIM_TYPES = ("definition", "fact", "finding", "metric", "procedure", "recommendation")
CONFIDENCE = ("high", "low", "medium", "unstated")
DECISION_FIELDS = ("group_id", "claim_ids", "decision", "rule_applied", "decided_by")
DECISIONS = ("CONFLICT", "CORROBORATED", "OUT_OF_SCOPE", "SUPERSEDED", "UNIQUE")
SOURCE_FIELDS = ("source_id", "title", "origin", "author_or_tool", "date_authored", "date_ingested", "authority_tier", "recency_rank", "sha256")
AUTHORITY_TIERS = ("primary", "secondary", "tertiary", "unknown")
SOURCE_TYPES = ("report", "html-article", "pdf", "video-transcript", "webinar", "study-notes", "dataset", "notes", "other")
TRANSCRIPT_STATUSES = ("fetched", "pending")
SCHEMA_VERSION = 2
LONGEST_LOCATION = 240


@dataclass(frozen=True)
class Formats:
    """The shapes of ids; the evidence format's own by default. Wider corpora name wider ones."""

    claim: str = CLAIM_ID
    group: str = GROUP_ID
    source: str = SOURCE_ID


WIDE = Formats(r"^S\d{7}-C\d{3}$", r"^G\d{8}$", r"^S\d{7}$")


def shown(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in sorted(values)) + "]"


def messages(*checks: tuple[Column, Column | str]) -> Column:
    """The messages whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(when, F.lit(False)), F.lit(say) if isinstance(say, str) else say) for when, say in checks)))


def say(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts))


class TableRecord:
    """The parts of a row of a typed table."""

    def __init__(self, df: DataFrame) -> None:
        self.columns = set(df.columns)
        self.kinds = {f.name: f.dataType for f in df.schema.fields}

    def has(self, name: str) -> Column:
        return F.lit(name in self.columns)

    def text(self, name: str) -> Column:
        """The value where it is a string, else null."""
        return F.col(name) if isinstance(self.kinds.get(name), StringType) else F.lit(None).cast("string")

    def repr(self, name: str) -> Column:
        return F.col(name).cast("string") if name in self.columns else F.lit(None).cast("string")

    def strings(self, name: str) -> Column:
        """The value where it is a list; entries that are no strings are null."""
        return F.col(name) if isinstance(self.kinds.get(name), ArrayType) else F.lit(None).cast("array<string>")

    def keys(self) -> Column:
        return F.array(*(F.lit(c) for c in sorted(self.columns)))

    def locator(self) -> Column:
        """The faults of the locator; a null one stands for none."""
        loc = F.col("source_locator")
        full = lambda k: loc[k].isNotNull()
        faults = messages(
            (~(full("url") | full("page") | full("timestamp") | full("anchor")), "source_locator must have at least one of url, page, timestamp, anchor"),
            (full("url") & is_blank(loc["url"]), "source_locator.url must be a non-empty string"),
            (loc["page"] < 1, "source_locator.page must be a positive integer"),
            (full("timestamp") & ~loc["timestamp"].rlike(TIMESTAMP), "source_locator.timestamp must look like H:MM or HH:MM:SS"),
            (full("anchor") & is_blank(loc["anchor"]), "source_locator.anchor must be a non-empty string"),
        )
        return F.when(loc.isNull(), F.array().cast("array<string>")).otherwise(faults)


class JsonRecord:
    """The parts of a VARIANT column that holds a JSON object; ``raw`` has its text."""

    def __init__(self, variant: str = "v", raw: str = "raw") -> None:
        self.v, self.raw = variant, raw

    def keys(self) -> Column:
        return F.json_object_keys(self.raw)

    def has(self, name: str) -> Column:
        return F.array_contains(self.keys(), name)

    def kind(self, name: str) -> Column:
        return F.schema_of_variant(F.expr(f"try_variant_get({self.v}, '$.{name}', 'variant')"))

    def text(self, name: str) -> Column:
        return F.when(self.kind(name) == "STRING", F.try_variant_get(self.v, f"$.{name}", "string"))

    def repr(self, name: str) -> Column:
        return F.try_variant_get(self.v, f"$.{name}", "string")

    def strings(self, name: str) -> Column:
        entries = F.try_variant_get(self.v, f"$.{name}", "array<variant>")
        return F.when(self.kind(name).startswith("ARRAY"), F.transform(entries, lambda e: F.when(F.schema_of_variant(e) == "STRING", F.try_variant_get(e, "$", "string"))))

    def locator(self) -> Column:
        keys = F.json_object_keys(F.get_json_object(self.raw, "$.source_locator"))
        has = lambda k: F.array_contains(keys, k)
        kind = lambda k: F.coalesce(self.kind(f"source_locator.{k}"), F.lit("VOID"))
        value = lambda k, t: F.try_variant_get(self.v, f"$.source_locator.{k}", t)
        bad_text = lambda k: has(k) & ((kind(k) != "STRING") | is_blank(value(k, "string")))
        unknown = F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, LOCATOR_KEYS)))), lambda k: say("unknown source_locator key ", k))
        faults = F.concat(
            messages((F.size(keys) == 0, "source_locator must have at least one of url, page, timestamp, anchor")),
            unknown,
            messages(
                (bad_text("url"), "source_locator.url must be a non-empty string"),
                (has("page") & ((kind("page") != "BIGINT") | (value("page", "bigint") < 1)), "source_locator.page must be a positive integer"),
                (has("timestamp") & ((kind("timestamp") != "STRING") | ~value("timestamp", "string").rlike(TIMESTAMP)), "source_locator.timestamp must look like H:MM or HH:MM:SS"),
                (bad_text("anchor"), "source_locator.anchor must be a non-empty string"),
            ),
        )
        is_object = self.kind("source_locator").startswith("OBJECT")
        return F.when(~self.has("source_locator"), F.array().cast("array<string>")).when(is_object, faults).otherwise(F.array(F.lit("source_locator must be an object")))


Record = TableRecord | JsonRecord


def _shape(r: Record, required: tuple[str, ...], allowed: tuple[str, ...] | None) -> Column:
    wanted = F.array(*map(F.lit, sorted(required)))
    missing = F.transform(F.array_except(wanted, r.keys()), lambda k: say("missing field ", k))
    if allowed is None:
        return missing
    extra = F.array_sort(F.array_except(r.keys(), F.array(*map(F.lit, sorted(allowed)))))
    return F.concat(missing, F.transform(extra, lambda k: say("unknown field ", k)))


def claim_faults(r: Record, source: Column, formats: Formats = Formats()) -> Column:
    """ARRAY<STRING>: what is wrong with a claim that should belong to ``source``."""
    cid, tags, where, deps = r.text("claim_id"), r.strings("topic_tags"), r.text("supporting_quote_location"), r.strings("depends_on")
    shape = _shape(r, CLAIM_FIELDS, (*CLAIM_FIELDS, "source_locator"))
    good_id = F.coalesce(cid.rlike(formats.claim), F.lit(False))
    checks = messages(
        (~good_id, say("claim_id '", r.repr("claim_id"), "' does not match SNN-CNNN format")),
        (good_id & ~F.coalesce(cid.startswith(F.concat(source, F.lit("-"))), F.lit(False)), say("claim_id '", cid, "' does not belong to source ", source)),
        (~r.text("source_id").eqNullSafe(source), say("source_id '", r.repr("source_id"), "' does not match file source ", source)),
        (is_blank(r.text("claim_text")), "claim_text must be a non-empty string"),
        (~F.coalesce(r.text("claim_type").isin(*CLAIM_TYPES), F.lit(False)), say("claim_type '", r.repr("claim_type"), f"' not in {shown(CLAIM_TYPES)}")),
        (tags.isNull() | (F.size(tags) == 0) | F.exists(tags, is_blank), "topic_tags must be a non-empty list of strings"),
        (is_blank(where), "supporting_quote_location must be a non-empty string"),
        (~is_blank(where) & (F.length(where) > LONGEST_LOCATION), "supporting_quote_location too long, use a section reference not a quote"),
        (~F.coalesce(r.text("confidence_as_stated").isin(*CONFIDENCE), F.lit(False)), say("confidence_as_stated '", r.repr("confidence_as_stated"), f"' not in {shown(CONFIDENCE)}")),
        (deps.isNull() | F.exists(deps, lambda x: ~F.coalesce(x.rlike(formats.claim), F.lit(False))), "depends_on must be a list of claim ids in SNN-CNNN format"),
    )
    return F.when(F.size(shape) > 0, shape).otherwise(F.concat(checks, r.locator()))


def decision_faults(r: Record, unknown: Column, rules: Column, formats: Formats = Formats()) -> Column:
    """ARRAY<STRING>: what is wrong with a decision. ``unknown``: its claim ids that were never extracted; ``rules``: those one may apply."""
    shape = _shape(r, DECISION_FIELDS, None)
    ids, decision = r.strings("claim_ids"), r.text("decision")
    known_list = ids.isNotNull() & (F.size(ids) > 0)
    each = F.transform(
        F.coalesce(ids, F.array().cast("array<string>")),
        lambda c: F.when(~F.coalesce(c.rlike(formats.claim), F.lit(False)), say("claim id '", c, "' does not match SNN-CNNN format")).when(
            F.array_contains(unknown, c), say("claim id '", c, "' was never extracted")
        ),
    )
    superseded, rule = decision == "SUPERSEDED", r.text("rule_applied")
    winner, note = (r.repr("winner"), r.repr("note"))
    checks = F.concat(
        messages((~F.coalesce(r.text("group_id").rlike(formats.group), F.lit(False)), say("group_id '", r.repr("group_id"), "' does not match GNNN format")), (~known_list, "claim_ids must be a non-empty list")),
        F.array_compact(each),
        messages(
            (~F.coalesce(decision.isin(*DECISIONS), F.lit(False)), say("decision '", r.repr("decision"), f"' not in {shown(DECISIONS)}")),
            (is_blank(r.text("decided_by")), "decided_by must be a non-empty string"),
            (is_blank(rule), "rule_applied must be a non-empty string"),
            (superseded & ~F.coalesce(F.array_contains(ids, winner), F.lit(False)), "SUPERSEDED decision requires a winner drawn from claim_ids"),
            (superseded & ~F.coalesce(F.array_contains(rules, rule), F.lit(False)), say("SUPERSEDED rule_applied '", r.repr("rule_applied"), "' not in merge-rules.yaml")),
            ((decision == "OUT_OF_SCOPE") & is_blank(note), "OUT_OF_SCOPE decision requires a one line note giving the reason"),
        ),
    )
    return F.when(F.size(shape) > 0, shape).otherwise(checks)


def source_faults(r: TableRecord, parent_known: Column, formats: Formats = Formats(), body: str = "_body") -> Column:
    """ARRAY<STRING>: what is wrong with a source row; a null schema_version stands for the first version's rows."""
    version, kind, ref, status = F.col("schema_version"), r.text("source_type"), r.text("resolved_from"), r.text("transcript_status")
    second = version == SCHEMA_VERSION
    empty = lambda n: F.coalesce(r.repr(n) == "", F.lit(True))
    return messages(
        (version.isNotNull() & (version != SCHEMA_VERSION), say("unsupported schema_version ", version)),
        *((empty(n), f"missing frontmatter field {n}") for n in SOURCE_FIELDS),
        (second & empty("source_type"), "missing frontmatter field source_type"),
        (~empty("authority_tier") & ~r.text("authority_tier").isin(*AUTHORITY_TIERS), say("invalid authority_tier '", r.text("authority_tier"), "'")),
        (second & ~empty("source_type") & ~kind.isin(*SOURCE_TYPES), say("invalid source_type '", kind, "'")),
        (second & ref.isNotNull() & ~ref.rlike(formats.source), say("invalid resolved_from '", ref, "'")),
        (second & ref.isNotNull() & ref.rlike(formats.source) & ~parent_known, say("resolved_from references unknown source ", ref)),
        (second & status.isNotNull() & ~status.isin(*TRANSCRIPT_STATUSES), say("invalid transcript_status '", status, "'")),
        (second & status.isNotNull() & ~kind.eqNullSafe(F.lit("video-transcript")), "transcript_status only allowed for video-transcript sources"),
        (~F.sha2(F.coalesce(F.col(body), F.lit("")), 256).eqNullSafe(F.col("sha256")), "sha256 does not match body content"),
    )


def faulty(df: DataFrame, faults: Callable[[], Column] | Column, *keep: str) -> DataFrame:
    """(keep..., check_ord, problem): a row for each fault."""
    made = faults() if callable(faults) else faults
    return df.select(*keep, F.posexplode(made).alias("check_ord", "problem"))
