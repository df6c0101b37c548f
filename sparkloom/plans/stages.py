"""The stages of a project folder, from files to gates and back: thin plans over the operators.

Only this module and the command line touch a project's files; what a stage decides comes from DataFrames. Reasons carry their
place (phase, file, line, check), so their order does not depend on how the data was partitioned. Their words are fixed values.
"""

from __future__ import annotations

import json
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import audit, intake, reconcile, similarity, synthesis, validate
from sparkloom.plans import ingest
from sparkloom.plans.lineage import cut
from sparkloom.sources import files

CLAIM = (
    "claim_id string, source_id string, claim_text string, claim_type string, topic_tags array<string>, supporting_quote_location string, "
    "confidence_as_stated string, depends_on array<string>, source_locator struct<url:string,page:int,timestamp:string,anchor:string>"
)
DECISION = "group_id string, claim_ids array<string>, decision string, rule_applied string, decided_by string, winner string, note string"


# Lines to copy, as the file formats have them.
CLAIM_LINE = {"claim_type": "fact", "topic_tags": ["example-tag"], "confidence_as_stated": "unstated", "depends_on": []}
DECISION_LINE = {"group_id": "G001", "claim_ids": ["S01-C001"], "decision": "UNIQUE", "rule_applied": "single_source", "decided_by": "operator", "winner": None, "note": ""}
SHOWN = {"02-extract": 30, "03-reconcile": 20, "04-synthesis": 20, "05-audit": 20}  # how many reasons a command names; the gate file has all


def workspace(source_id: str) -> str:
    """An empty claims file: what a line looks like, as a comment."""
    line = {"claim_id": f"{source_id}-C001", "source_id": source_id, "claim_text": "One claim of the source, restated", "supporting_quote_location": "Heading or place"} | CLAIM_LINE
    place = {"source_locator": {"url": "https://...", "page": 12, "timestamp": "00:14:32", "anchor": "section"}}
    return f"# Claims of {source_id}, one JSON object a line; lines that start with # are ignored.\n# {json.dumps(line)}\n# optional: {json.dumps(place)}\n"


def messages(gate: dict) -> list[str]:
    """What a command says of a gate: its status, the first reasons, all warnings."""
    return [f"gate {gate['gate']}: {gate['status']}", *(f"FAIL: {r}" for r in gate["reasons"][: SHOWN.get(gate["gate"])]), *(f"warn: {w}" for w in gate["warnings"])]


def file_name(c: str = "file"):
    return F.regexp_extract(F.col(c), r"([^/]+)$", 1)


class Project:
    """A project folder: sources/S*.md, claims/S*-claims.jsonl, index/, output/, gates/."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, Path(root)

    # --- reading -----------------------------------------------------------------------------------------------------------

    def init(self, title: str) -> list[str]:
        """The skeleton, with default rules; what is there stays."""
        made = []
        for name, content in (("BRIEF.md", f"# {title}\n"), ("merge-rules.yaml", yaml.safe_dump({"rules": ["operator-ruling"], "section_order": []}, sort_keys=False))):
            if not (self.root / name).exists():
                made.append(files.write_text(self.root / name, content, self.root))
        for folder in ("sources", "claims", "index", "output", "gates"):
            (self.root / folder).mkdir(parents=True, exist_ok=True)
        return made

    def brief(self, topic: str, platforms: tuple[str, ...] = ("Platform A", "Platform B"), *, dry_run: bool = False) -> dict[str, str]:
        """The question of the project and where its reports go, and a page with room for a prompt a platform; a blank topic is an error."""
        topic = topic.strip()
        if not topic:
            raise ValueError("a brief needs a topic")
        steps = ("write a prompt for each platform in prompts/RESEARCH-PROMPTS.md and run it there", "save each report as a file and take it in", "extract, reconcile, synthesise and audit", "export output/MASTER.json")
        pages = {
            "BRIEF.md": [f"# Research brief: {self.root.name}", "", "> [!abstract] Question", f"> {topic}", "", "## Steps", "", *(f"{i}. {s}" for i, s in enumerate(steps, 1)), ""],
            "prompts/RESEARCH-PROMPTS.md": [f"# Prompts: {self.root.name}", "", f"Question: {topic}", "", *(x for p in platforms for x in (f"## {p}", "", "> [!todo] The prompt for this platform; ask for headings, stated confidence and cited sources.", "")), "Save each report as its own file, then: intake.", ""],
        }
        return {name: files.write_text(self.root / name, "\n".join(lines), self.root, dry_run=dry_run) for name, lines in pages.items()}

    def heads(self) -> DataFrame:
        """(_file, _body, fields, _error) a source file, fields as read; none where there are no files yet."""
        if not any((self.root / "sources").glob("S*.md")):
            return self.spark.createDataFrame([], "_file string, _body string, fields map<string,string>, _error string")
        texts = files.read_texts(self.spark, str(self.root / "sources" / "S*.md"))
        parts = texts.select(file_name().alias("_file"), files.split_front_matter(F.col("text")).alias("p"))
        read = parts.select("_file", F.col("p.body").alias("_body"), files.parse_head(F.col("p.head")).alias("h"), F.col("p.error").alias("e"))
        return read.select("_file", "_body", F.col("h.fields").alias("fields"), F.coalesce("e", "h.error").alias("_error"))

    def sources(self) -> DataFrame:
        """A row a source file: its fields (missing keys and nulls are both null), ``_body`` and ``_file``."""
        names = (*files.FRONT_MATTER, "transcript_status")
        typed = self.heads().select(*(F.col("fields")[n].alias(n) for n in names), "_body", "_file", "_error")
        return typed.withColumns({n: F.expr(f"try_cast({n} as int)") for n in ("recency_rank", "schema_version")})

    def lines(self, pattern: str) -> DataFrame:
        texts = files.read_texts(self.spark, str(self.root / pattern)) if any(self.root.glob(pattern)) else self.spark.createDataFrame([], "file string, text string")
        return files.json_lines(texts).withColumn("file", file_name())

    def claim_lines(self) -> DataFrame:
        return self.lines("claims/S*-claims.jsonl").withColumn("source", F.regexp_extract("file", r"^([^-]+)-", 1))

    def claims(self, lines: DataFrame | None = None) -> DataFrame:
        """What can be read of the claims, valid or not; ``source`` is the one whose file a claim stands in."""
        good = files.lenient(self.claim_lines() if lines is None else lines)
        return good.select(F.from_json("raw", CLAIM).alias("c"), "file", "lineno", "source").select("c.*", "file", "lineno", "source")

    def valid_claims(self) -> DataFrame:
        """All claims; the first invalid line, by file and place, is an error. Stages after the claims' gate read them so."""
        lines = cut(self.claim_lines())
        unread = lines.where("error is not null").select("file", "lineno", F.lit(0).alias("check_ord"), F.col("error").alias("problem"))
        wrong = validate.faulty(files.lenient(lines), validate.claim_faults(validate.JsonRecord(), F.col("source")), "file", "lineno").select("file", "lineno", "check_ord", "problem")
        first = unread.unionByName(wrong).orderBy("file", "lineno", "check_ord").limit(1).collect()
        if first:
            raise ValueError(f"{first[0].file}:{first[0].lineno}: {first[0].problem}")
        return self.claims(lines)

    def decisions(self) -> DataFrame:
        good = files.lenient(self.lines("index/reconciliation.jsonl"))
        return good.select(F.from_json("raw", DECISION).alias("d"), "lineno").select("d.*", F.col("lineno").alias("recorded_at"))

    def manifest(self) -> DataFrame:
        """What resolving left, a row a target, the last of its lines; ``ord`` is the line."""
        if not (self.root / "index" / "resolution.jsonl").is_file():
            return self.spark.createDataFrame([], f"{ingest.MANIFEST}, ord int")
        good = files.lenient(self.lines("index/resolution.jsonl"))
        rows = good.select(F.from_json("raw", ingest.MANIFEST).alias("m"), F.col("lineno").alias("ord")).select("m.*", "ord")
        return intake.first_rows(rows.where("coalesce(target, '') <> ''"), "target", F.desc("ord"))

    def rules(self) -> dict:
        data = yaml.safe_load((self.root / "merge-rules.yaml").read_text(encoding="utf-8"))
        if not isinstance(data, dict):
            raise ValueError("merge-rules.yaml did not parse as a YAML mapping")
        return data

    # --- gates -------------------------------------------------------------------------------------------------------------

    def statuses(self) -> dict[str, str]:
        out = {}
        for name in audit.GATES:
            f = self.root / "gates" / f"{name}.yaml"
            out[name] = (yaml.safe_load(f.read_text(encoding="utf-8")) or {}).get("status", "PENDING") if f.is_file() else "PENDING"
        return out

    def write_gate(self, name: str, reasons: DataFrame, checks: dict, warnings: list[str] = (), *, dry_run: bool = False) -> dict:
        """``reasons``: (place struct, reason). A gate is a report read by people, so its reasons come to the driver."""
        listed = [r["reason"] for r in reasons.orderBy("place").select("reason").collect()]
        gate = {"gate": name, "status": "FAIL" if listed else "PASS", "reasons": listed, "warnings": list(warnings), "checks": checks}
        files.write_text(self.root / "gates" / f"{name}.yaml", yaml.safe_dump(gate, sort_keys=False, allow_unicode=True), self.root, dry_run=dry_run)
        return gate

    @staticmethod
    def place(phase: int, *columns: object):
        parts = [F.lit(phase), *columns, *[F.lit("")] * (4 - len(columns))]
        return F.struct(*(p.cast("string") if i else p for i, p in enumerate(F.lit(c) if not hasattr(c, "cast") else c for c in parts))).alias("place")

    @staticmethod
    def padded(c) -> object:
        return F.lpad(c.cast("string"), 12, "0")

    def check_intake(self, *, dry_run: bool = False) -> dict:
        sources = self.sources()
        known = sources.select(F.col("source_id").alias("resolved_from"), F.lit(True).alias("_known")).distinct()
        joined = sources.join(known, "resolved_from", "left")
        faults = validate.source_faults(validate.TableRecord(sources), F.coalesce("_known", F.lit(False)))
        found = validate.faulty(joined, faults, "_file", "source_id")
        reasons = found.select(self.place(1, F.col("_file"), self.padded(F.col("check_ord"))), F.concat_ws(": ", F.coalesce("source_id", "_file"), "problem").alias("reason"))
        n, old = sources.agg(F.count(F.lit(1)), F.count_if(F.col("schema_version").isNull())).first()
        if not n:
            reasons = self.spark.createDataFrame([((0, "", "", "", ""), "no sources ingested")], reasons.schema)
        warnings = [f"{old} source(s) use the first schema, run: migrate"] if old else []
        return self.write_gate("01-intake", reasons, {"source_count": n}, warnings, dry_run=dry_run)

    def check_claims(self, *, dry_run: bool = False) -> dict:
        audit.require_previous(self.statuses(), "02-extract")
        lines, sources = cut(self.claim_lines()), self.sources()
        at = F.concat_ws(":", "file", "lineno")
        bad = lines.where("error is not null").select(self.place(1, F.col("file"), self.padded(F.col("lineno"))), F.concat_ws(": ", at, "error").alias("reason"))
        faults = validate.faulty(files.lenient(lines), validate.claim_faults(validate.JsonRecord(), F.col("source")), "file", "lineno")
        wrong = faults.select(self.place(1, F.col("file"), self.padded(F.col("lineno")), self.padded(F.col("check_ord"))), F.concat_ws(": ", at, "problem").alias("reason"))
        claims = self.claims(lines)
        w = Window.partitionBy("claim_id").orderBy("file", "lineno")
        again = claims.where("claim_id is not null").withColumns({"_n": F.row_number().over(w), "_first": F.first(F.concat_ws(":", "file", "lineno")).over(w)}).where("_n > 1")
        twice = again.select(self.place(1, F.col("file"), self.padded(F.col("lineno")), F.lit("~")), F.concat(at, F.lit(": duplicate claim_id "), F.col("claim_id"), F.lit(", first seen "), F.col("_first")).alias("reason"))
        loose = reconcile.dangling(claims).select(self.place(2, F.col("claim_id"), F.col("ref")), F.concat(F.coalesce("claim_id", F.lit("None")), F.lit(": dangling depends_on reference "), F.col("ref")).alias("reason"))
        per = {r["source_id"]: r["n_claims"] for r in reconcile.claims_per_source(sources, claims, rows_of="source").orderBy("source_id").collect()}
        there = self.spark.createDataFrame([(p.name.split("-")[0],) for p in sorted((self.root / "claims").glob("S*-claims.jsonl"))], "source_id string")
        missing = sources.join(there.distinct(), "source_id", "left_anti").select(self.place(0, F.col("source_id")), F.concat(F.col("source_id"), F.lit(": claims file missing")).alias("reason"))
        warnings = [f"{r[0]}: {r[1]}" for r in reconcile.locator_warnings(claims, sources).orderBy("claim_id", "warning").collect()]
        warnings += [f"{r[0]}: source over 2KB yielded only {r[2]} claims, check coverage" for r in reconcile.thin_sources(sources, claims, rows_of="source").orderBy("source_id").collect()]
        reasons = cut(missing.unionByName(bad).unionByName(wrong).unionByName(twice).unionByName(loose))
        if not sum(per.values()) and reasons.isEmpty():
            reasons = self.spark.createDataFrame([((2, "", "", "", ""), "no claims extracted across any source")], reasons.schema)
        return self.write_gate("02-extract", reasons, {"claims_per_source": per, "total_claims": sum(per.values())}, warnings, dry_run=dry_run)

    def candidates(self) -> DataFrame:
        return similarity.numbered(similarity.candidate_pairs(self.valid_claims()))

    def check_decisions(self, *, dry_run: bool = False) -> dict:
        audit.require_previous(self.statuses(), "03-reconcile")
        claims, decisions = self.valid_claims(), cut(self.decisions())
        lines = self.lines("index/reconciliation.jsonl")
        unknown = F.array_sort(F.collect_set("claim_id"))
        lost = reconcile.never_extracted(claims, decisions).groupBy("group_id").agg(unknown.alias("_u"))
        rows = files.lenient(lines).withColumn("group_id", F.try_variant_get("v", "$.group_id", "string")).join(lost, "group_id", "left").withColumn("_u", F.coalesce("_u", F.array().cast("array<string>")))
        rules = F.array(*map(F.lit, self.rules().get("rules") or [])).cast("array<string>")
        faults = validate.faulty(rows, validate.decision_faults(validate.JsonRecord(), F.col("_u"), rules), "lineno")
        at = F.concat(F.lit("reconciliation.jsonl:"), F.col("lineno"))
        reasons = lines.where("error is not null").select(self.place(1, self.padded(F.col("lineno"))), F.concat_ws(": ", at, "error").alias("reason"))
        reasons = reasons.unionByName(faults.select(self.place(1, self.padded(F.col("lineno")), self.padded(F.col("check_ord"))), F.concat_ws(": ", at, "problem").alias("reason")))
        again = decisions.withColumn("_n", F.row_number().over(Window.partitionBy("group_id").orderBy("recorded_at"))).where("_n > 1")
        reasons = reasons.unionByName(again.select(self.place(2, self.padded(F.col("recorded_at"))), F.concat(F.lit("duplicate group_id "), F.coalesce("group_id", F.lit("None"))).alias("reason")))
        named = decisions.select("group_id", "recorded_at", F.posexplode("claim_ids").alias("pos", "claim_id"))
        w = Window.partitionBy("claim_id").orderBy("recorded_at", "pos")
        shared = named.withColumns({"_n": F.row_number().over(w), "_first": F.first("group_id").over(w)}).where("_n > 1")
        reasons = reasons.unionByName(shared.select(self.place(2, self.padded(F.col("recorded_at")), self.padded(F.col("pos") + 1)), F.concat(F.lit("claim "), F.col("claim_id"), F.lit(" appears in "), F.col("_first"), F.lit(" and "), F.col("group_id")).alias("reason")))
        open_ = reconcile.undecided(claims, decisions)
        reasons = reasons.unionByName(open_.select(self.place(3, F.col("claim_id")), F.concat(F.lit("claim "), F.col("claim_id"), F.lit(" has no reconciliation decision")).alias("reason")))
        checks = {"claims_total": claims.select("claim_id").distinct().count(), "claims_decided": reconcile.decided(decisions).count(), "decision_groups": decisions.count()}
        return self.write_gate("03-reconcile", reasons, checks, dry_run=dry_run)

    def master(self) -> DataFrame:
        texts = files.read_texts(self.spark, str(self.root / "output" / "MASTER.md"))
        return texts.select(F.lit(1).alias("doc"), F.col("text").alias("master_text"))

    def check_master(self, *, dry_run: bool = False) -> dict:
        audit.require_previous(self.statuses(), "04-synthesis")
        claims, decisions, master = self.valid_claims(), cut(self.decisions()), self.master()
        parts = cut(synthesis.sections(master, "doc", "master_text"))
        say = lambda df, phase, order, *words: df.select(self.place(phase, *order), F.concat(*(w if hasattr(w, "cast") else F.lit(w) for w in words)).alias("reason"))
        general = synthesis.master_faults(master, "doc", "master_text")
        reasons = say(general.where("ord < 9"), 0, [self.padded(F.col("ord"))], F.col("reason"))
        prose = synthesis.prose_faults(parts, "doc")
        reasons = reasons.unionByName(say(prose.where("n_prose = 0"), 1, [self.padded(F.col("section_no"))], "body section '", F.col("heading"), "' has no prose"))
        unmarked = prose.where("n_unmarked > 0").select("section_no", "heading", F.explode(F.expr("sequence(1, cast(n_unmarked as int))")).alias("i"))
        reasons = reasons.unionByName(say(unmarked, 1, [self.padded(F.col("section_no")), self.padded(F.col("i"))], "body section '", F.col("heading"), "' has prose without provenance markers"))
        winners = reconcile.winners(decisions)
        reasons = reasons.unionByName(say(synthesis.phantom_citations(parts, "doc", claims), 2, [F.col("claim_id")], "cited claim ", F.col("claim_id"), " does not exist"))
        reasons = reasons.unionByName(say(synthesis.uncited_winners(parts, "doc", winners), 3, [F.col("claim_id")], "winning claim ", F.col("claim_id"), " (group ", F.col("group_id"), ") is never cited"))
        reasons = reasons.unionByName(say(synthesis.absent_conflicts(parts, "doc", decisions), 4, [F.col("group_id"), F.col("claim_id")], "conflict claim ", F.col("claim_id"), " (group ", F.col("group_id"), ") absent from Conflicts section"))
        reasons = reasons.unionByName(say(general.where("ord = 9"), 5, [], F.col("reason")))
        cited = synthesis.first_citations(parts, "doc").join(claims.select("claim_id").distinct(), "claim_id", "left_semi").count()
        checks = {"claims_cited": cited, "winning_claims": winners.count(), "conflict_groups": decisions.where("decision = 'CONFLICT'").count()}
        return self.write_gate("04-synthesis", reasons, checks, dry_run=dry_run)

    def check_audit(self, *, dry_run: bool = False) -> dict:
        audit.require_previous(self.statuses(), "05-audit")
        sources, claims, decisions = self.sources(), self.valid_claims(), cut(self.decisions())
        places = synthesis.first_citations(synthesis.sections(self.master(), "doc", "master_text"), "doc").select("claim_id", "location")
        matrix = cut(audit.trace_matrix(claims, decisions, places))
        drift = intake.drifted(sources)
        dropped = reconcile.undecided(claims, decisions)
        reasons = drift.select(self.place(0, F.col("source_id")), F.concat(F.lit("source "), F.col("source_id"), F.lit(" changed since intake, hash mismatch")).alias("reason"))
        reasons = reasons.unionByName(dropped.select(self.place(1, F.col("claim_id")), F.concat(F.lit("claim "), F.col("claim_id"), F.lit(" dropped without an OUT_OF_SCOPE decision")).alias("reason")))
        coverage = {r["source_id"]: r["coverage"] for r in audit.coverage(matrix).orderBy("source_id").collect()}
        rows = matrix.orderBy("claim_id").collect()
        report = ["# Audit", "", "| source | claim | decision | group | location | status |", "| --- | --- | --- | --- | --- | --- |"]
        report += [f"| {r.source_id} | {r.claim_id} | {r.decision} | {r.group_id} | {r.location} | {r.status} |" for r in rows]
        files.write_text(self.root / "output" / "AUDIT-REPORT.md", "\n".join(report) + "\n", self.root, dry_run=dry_run)
        bad = [r[0] for r in drift.collect()]
        checks = {"coverage": coverage, "drift": {r["source_id"]: "DRIFTED" if r["source_id"] in bad else "ok" for r in sources.select("source_id").orderBy("source_id").collect()}, "dropped_claims": [r[0] for r in dropped.orderBy("claim_id").collect()]}
        return self.write_gate("05-audit", reasons, checks, dry_run=dry_run)

    # --- sources -----------------------------------------------------------------------------------------------------------

    def intake(self, paths: list[str], *, convert: ingest.Convert | None = None, dry_run: bool = False) -> dict:
        return ingest.run_intake(self, paths, convert=convert, dry_run=dry_run)

    def resolve(self, get: ingest.Get, **options: object) -> dict:
        return ingest.run_resolve(self, get, **options)

    def migrate(self, *, dry_run: bool = False) -> dict:
        return ingest.run_migrate(self, dry_run=dry_run)

    def extract(self, *, dry_run: bool = False) -> dict[str, str]:
        """A workspace for the claims of each source, with the line to copy; one that is there stays."""
        audit.require_previous(self.statuses(), "02-extract")
        done = {}
        for r in self.sources().select("source_id").where("source_id is not null").distinct().orderBy("source_id").collect():
            path = self.root / "claims" / f"{r[0]}-claims.jsonl"
            done[path.name] = "kept-existing" if path.exists() else files.write_text(path, workspace(r[0]), self.root, dry_run=dry_run)
        told = ["# Extracting claims", "", "One JSON object a line in each source's file; lines that start with # are ignored.", f"Types: {', '.join(validate.CLAIM_TYPES)}.", f"Confidence: {', '.join(validate.CONFIDENCE)}.", ""]
        done["EXTRACTION-INSTRUCTIONS.md"] = files.write_text(self.root / "claims" / "EXTRACTION-INSTRUCTIONS.md", "\n".join(told), self.root, dry_run=dry_run)
        return done

    def reconcile(self, *, dry_run: bool = False) -> dict:
        """The claims index, the numbered candidates, what to do with them, a file for the decisions if there is none, and the gate."""
        audit.require_previous(self.statuses(), "03-reconcile")
        put = lambda name, text: files.write_text(self.root / "index" / name, text, self.root, dry_run=dry_run)
        done = {"claims-index.md": put("claims-index.md", self.index_text())}
        # read by people, who decide on each
        found = self.candidates().select("candidate_id", F.array("claim_id_a", "claim_id_b").alias("claim_ids"), F.split("shared_tags", ",").alias("shared_tags"), "token_overlap")
        found = [r.asDict() for r in found.orderBy(F.length("candidate_id"), "candidate_id").collect()]
        done["candidates.jsonl"] = put("candidates.jsonl", "".join(json.dumps(c) + "\n" for c in found))
        told = [f"# Reconciling claims: {self.root.name}", "", "Every claim must stand in exactly one group of index/reconciliation.jsonl. Conflicts are written down, never resolved in silence.", "", f"Decisions: {', '.join(validate.DECISIONS)}.", ""]
        told += ["## Rules", "", *(f"- {r}" for r in self.rules().get("rules") or []), "", "## Candidates", ""]
        told += [f"- {c['candidate_id']}: {' and '.join(c['claim_ids'])} (shared tags {', '.join(c['shared_tags'])}, overlap {c['token_overlap']})" for c in found] or ["None were found."]
        done["RECONCILIATION-INSTRUCTIONS.md"] = put("RECONCILIATION-INSTRUCTIONS.md", "\n".join([*told, ""]))
        if not (self.root / "index" / "reconciliation.jsonl").exists():
            done["reconciliation.jsonl"] = put("reconciliation.jsonl", f"# Decisions, one JSON object a line; lines that start with # are ignored.\n# {json.dumps(DECISION_LINE)}\n")
        if dry_run and not (self.root / "index" / "reconciliation.jsonl").exists():
            return {"files": done, "candidates": len(found), "gate": {"status": "PENDING", "reasons": []}}
        return {"files": done, "candidates": len(found), "gate": self.check_decisions(dry_run=dry_run)}

    # --- writing -----------------------------------------------------------------------------------------------------------

    def index_text(self) -> str:
        """The claims by tag, as a page."""
        out = [f"# Claims index: {self.root.name}", ""]
        tag = None
        for r in reconcile.tag_index(self.valid_claims()).orderBy("tag", "claim_id").toLocalIterator():
            if r["tag"] != tag:
                out += ([""] if tag is not None else []) + [f"## {r['tag']}", ""]
                tag = r["tag"]
            out.append(r["line"])
        return "\n".join([*out, ""])

    def claims_index(self) -> str:
        text = self.index_text()
        files.write_text(self.root / "index" / "claims-index.md", text, self.root)
        return text

    def plan(self) -> list[dict]:
        """The sections of the master, in order, with the claims each must cite."""
        projects = self.spark.createDataFrame([("p", list(self.rules().get("section_order") or []))], "project_id string, section_order array<string>")
        claims = self.valid_claims().withColumn("project_id", F.lit("p"))
        placed = reconcile.section_plan(claims, self.decisions(), projects)
        grouped = placed.groupBy("section_rank", "tag", "title").agg(F.array_sort(F.collect_list("claim_id")).alias("claim_ids"))
        return [r.asDict() for r in grouped.orderBy(F.asc_nulls_last("section_rank"), "tag").collect()]

    def synthesise(self, *, force: bool = False, dry_run: bool = False) -> str:
        """The scaffold of the master, with what each section must cite; a master that was edited stays unless forced."""
        audit.require_previous(self.statuses(), "04-synthesis")
        sources = self.sources().select("source_id", "title", F.coalesce("source_type", F.lit("report")).alias("kind"), "authority_tier", "date_authored", F.coalesce("url", F.lit("-")).alias("url"), T.sha256_short(F.col("sha256")).alias("sha")).orderBy("source_id").collect()
        out = [f"# Master Document: {self.root.name}", "", "> [!abstract] Methodology", "> Sources: " + ", ".join(f"{s.source_id} ({s.title}, {s.authority_tier}, authored {s.date_authored})" for s in sources) + "."]
        out += [f"> Merge rules: {', '.join(self.rules().get('rules') or [])}.", "> Every paragraph names the claims it rests on; decisions are in index/reconciliation.jsonl.", ""]
        for s in self.plan():
            out += [f"## {s['title']}", "", "> [!todo] Prose required for this section", f"> Claims to cover: [{', '.join(s['claim_ids'])}]", f"> Write paragraphs below, each ending with its markers, as [{s['claim_ids'][0]}]; then delete this note.", ""]
        out += ["## Conflicts", ""]
        conflicts = self.decisions().where("decision = 'CONFLICT'").orderBy("recorded_at").collect()
        for c in conflicts:
            out += [f"> [!todo] Conflict {c.group_id} requires a description", f"> Claims in disagreement: [{', '.join(c.claim_ids)}]", "> Describe it and cite both sides. Do not resolve it.", ""]
        out += [] if conflicts else ["No conflicts were recorded during reconciliation.", ""]
        out += ["## Gaps", "", "> [!todo] List known gaps, or state that none were identified.", "", "## Appendix: Source Register", ""]
        out += ["| Source | Title | Type | Authority | Authored | Link | Content hash |", "| --- | --- | --- | --- | --- | --- | --- |"]
        out += [f"| {s.source_id} | {s.title} | {s.kind} | {s.authority_tier} | {s.date_authored} | {s.url} | {s.sha} |" for s in sources]
        path, text = self.root / "output" / "MASTER.md", "\n".join([*out, ""])
        if path.exists() and path.read_text(encoding="utf-8") != text and not force:
            return "kept-existing"
        return files.write_text(path, text, self.root, dry_run=dry_run)

    def export(self, *, dry_run: bool = False) -> str:
        if self.statuses()["04-synthesis"] != "PASS":
            raise RuntimeError("gate 04-synthesis is not PASS, this stage cannot run.")
        rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
        parts = synthesis.sections(self.master(), "doc", "master_text").where("heading <> ''").orderBy("section_no")
        decisions = self.decisions()
        payload = {
            "project": self.root.name, "format": audit.FORMAT,
            "sections": rows(parts.select("heading", T.strip(F.col("content")).alias("text"))),
            "sources": rows(self.sources().drop("_body", "_file", "_error").orderBy("source_id")),
            "claims": rows(self.valid_claims().drop("file", "lineno", "source").orderBy("claim_id")),
            "decisions": rows(decisions.orderBy("recorded_at").drop("recorded_at")),
            "winning_claims": {r["claim_id"]: r["group_id"] for r in reconcile.winners(decisions).collect()},
            "conflicts": [r["group_id"] for r in decisions.where("decision = 'CONFLICT'").orderBy("recorded_at").collect()],
        }
        return files.write_text(self.root / "output" / "MASTER.json", files.export_json(payload), self.root, dry_run=dry_run)

    def seal(self) -> dict:
        """The hash of every artifact, under the next version."""
        if self.statuses()["05-audit"] != "PASS":
            raise RuntimeError("gate 05-audit is not PASS, this stage cannot run.")
        import hashlib

        path = self.root / "output" / "SEAL.yaml"
        version = (yaml.safe_load(path.read_text(encoding="utf-8")).get("version", 0) if path.is_file() else 0) + 1
        parts = [p for d in ("sources", "claims", "index", "output", "gates") for p in sorted((self.root / d).rglob("*")) if p.is_file() and p != path]
        data = {"project": self.root.name, "version": version, "files": {str(p.relative_to(self.root)): hashlib.sha256(p.read_bytes()).hexdigest() for p in parts}}
        files.write_text(path, yaml.safe_dump(data, sort_keys=False), self.root)
        return data

    def status(self) -> tuple[dict[str, str], str]:
        state = self.statuses()
        step = audit.next_step(state, brief=(self.root / "BRIEF.md").is_file(), sources=any((self.root / "sources").glob("S*.md")), sealed=(self.root / "output" / "SEAL.yaml").is_file())
        return state, step
