import json

import pytest
import yaml

from sparkloom.plans.stages import Project, messages
from sparkloom.sources.files import front_matter_text

MASTER = "# M\n\n## Storage\n\nCompaction halves reads [S01-C001].\n\n## Conflicts\n\nS02-C001 against S02-C002.\n\n## Gaps\n\nNone known.\n\n## Appendix: Source Register\n\n| S01 |\n"


def claim(cid, text, tags, **more):
    return {"claim_id": cid, "source_id": cid[:3], "claim_text": text, "claim_type": "finding", "topic_tags": tags, "supporting_quote_location": "x", "confidence_as_stated": "low", "depends_on": []} | more


@pytest.fixture
def project(spark, tmp_path):
    import hashlib

    p = Project(spark, str(tmp_path))
    p.init("Demo")
    for n, body in ((1, "# One\nbody of one\n"), (2, "# Two\nbody of two\n")):
        head = {"source_id": f"S0{n}", "title": "T", "origin": "o.md", "author_or_tool": "a", "date_authored": "unknown", "date_ingested": "2024-01-01", "authority_tier": "primary", "recency_rank": n,
                "sha256": hashlib.sha256(body.encode()).hexdigest(), "schema_version": 2, "source_type": "report", "url": None, "resolved_from": None}
        (tmp_path / "sources" / f"S0{n}-t.md").write_text(front_matter_text(head, body))
    (tmp_path / "claims" / "S01-claims.jsonl").write_text("# workspace\n" + json.dumps(claim("S01-C001", "Nightly compaction halves read cost", ["storage"])) + "\n")
    two = [claim("S02-C001", "Nightly compaction halves the read cost", ["storage"]), claim("S02-C002", "Compaction does nothing", ["storage"], depends_on=["S01-C001"])]
    (tmp_path / "claims" / "S02-claims.jsonl").write_text("\n".join(map(json.dumps, two)))
    groups = [{"group_id": "G001", "claim_ids": ["S01-C001"], "decision": "UNIQUE", "rule_applied": "r", "decided_by": "op"}, {"group_id": "G002", "claim_ids": ["S02-C001", "S02-C002"], "decision": "CONFLICT", "rule_applied": "r", "decided_by": "op"}]
    (tmp_path / "index" / "reconciliation.jsonl").write_text("\n".join(map(json.dumps, groups)))
    (tmp_path / "output" / "MASTER.md").write_text(MASTER)
    return p


def test_all_gates_pass_and_run_again_alike(project):
    with pytest.raises(RuntimeError, match="gate 01-intake is PENDING"):
        project.check_claims()
    for _ in range(2):
        gates = [f() for f in (project.check_intake, project.check_claims, project.check_decisions, project.check_master, project.check_audit)]
        assert [g["status"] for g in gates] == ["PASS"] * 5, [g["reasons"] for g in gates]
    assert not (project.root / "_trash").exists()
    assert [(r.claim_id_a, r.claim_id_b) for r in project.candidates().collect()] == [("S01-C001", "S02-C001")]
    assert [(s["tag"], s["claim_ids"]) for s in project.plan()] == [("storage", ["S01-C001"])]
    assert project.export() == "created" and json.loads((project.root / "output" / "MASTER.json").read_text())["conflicts"] == ["G002"]
    assert "## storage" in project.claims_index()
    assert project.seal()["version"] == 1 and project.seal()["version"] == 2 and project.status()[1] == "done"


def test_reasons_in_order(project):
    project.check_intake()
    broken = [claim("S02-C001", " ", ["storage"]), claim("S02-C001", "again", ["storage"], depends_on=["S09-C001"])]
    (project.root / "claims" / "S02-claims.jsonl").write_text(json.dumps(broken[0]) + "\nnot json\n" + json.dumps(broken[1]))
    gate = project.check_claims()
    assert gate["reasons"] == [
        "S02-claims.jsonl:1: claim_text must be a non-empty string",
        "S02-claims.jsonl:2: invalid JSON",
        "S02-claims.jsonl:3: duplicate claim_id S02-C001, first seen S02-claims.jsonl:1",
        "S02-C001: dangling depends_on reference S09-C001",
    ]
    assert yaml.safe_load((project.root / "gates" / "02-extract.yaml").read_text())["status"] == "FAIL"
    (project.root / "sources" / "S01-t.md").write_text((project.root / "sources" / "S01-t.md").read_text() + "tampered")
    assert project.check_intake()["reasons"] == ["S01: sha256 does not match body content"]


def test_no_claims_fail_the_gate(project):
    project.check_intake()
    for n in (1, 2):
        (project.root / "claims" / f"S0{n}-claims.jsonl").write_text("# none yet\n")
    gate = project.check_claims()
    assert gate["reasons"] == ["no claims extracted across any source"] and gate["checks"] == {"claims_per_source": {"S01": 0, "S02": 0}, "total_claims": 0}


def test_counts_are_of_the_lines_of_a_sources_file(project):
    project.check_intake()
    rows = [claim("S02-C001", "a", ["t"]), claim("S02-C001", "b", ["t"]), claim("S01-C009", "c", ["t"])]
    (project.root / "claims" / "S02-claims.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert project.check_claims()["checks"]["claims_per_source"] == {"S01": 1, "S02": 3}


def test_later_stages_refuse_invalid_claims(project):
    for f in (project.check_intake, project.check_claims):
        assert f()["status"] == "PASS"
    path = project.root / "claims" / "S02-claims.jsonl"
    path.write_text(path.read_text() + "\n" + json.dumps(claim("S02-C003", "x", [])))
    for stage in (project.check_decisions, project.candidates, project.claims_index, project.plan):
        with pytest.raises(ValueError, match="S02-claims.jsonl:3: topic_tags"):
            stage()


def test_extract_and_reconcile_write_what_people_fill_in(project):
    project.check_intake()
    (project.root / "claims" / "S02-claims.jsonl").unlink()
    assert project.extract()["S02-claims.jsonl"] == "created" and project.extract()["S01-claims.jsonl"] == "kept-existing"
    assert project.check_claims()["status"] == "PASS"
    (project.root / "index" / "reconciliation.jsonl").unlink()
    out = project.reconcile()
    assert out["gate"]["reasons"] == ["claim S01-C001 has no reconciliation decision"] and out["candidates"] == 0
    assert (project.root / "index" / "reconciliation.jsonl").read_text().startswith("# ") and "- operator-ruling" in (project.root / "index" / "RECONCILIATION-INSTRUCTIONS.md").read_text()
    rows = [claim("S02-C001", "Nightly compaction halves the read cost", ["storage"])]
    (project.root / "claims" / "S02-claims.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert project.reconcile()["candidates"] == 1
    found = json.loads((project.root / "index" / "candidates.jsonl").read_text())
    assert found == {"candidate_id": "P001", "claim_ids": ["S01-C001", "S02-C001"], "shared_tags": ["storage"], "token_overlap": 0.833}
    assert messages({"gate": "03-reconcile", "status": "FAIL", "reasons": ["r"] * 50, "warnings": ["w"]})[-2:] == ["FAIL: r", "warn: w"]


def test_brief_has_the_question_and_a_place_for_each_prompt(project):
    with pytest.raises(ValueError, match="topic"):
        project.brief("  ")
    assert project.brief(" What slows compaction? ", ("One", "Two")) == {"BRIEF.md": "replaced", "prompts/RESEARCH-PROMPTS.md": "created"}
    assert "> What slows compaction?" in (project.root / "BRIEF.md").read_text()
    prompts = (project.root / "prompts" / "RESEARCH-PROMPTS.md").read_text()
    assert prompts.count("[!todo]") == 2 and "## Two" in prompts
    assert set(project.brief("What slows compaction?", ("One", "Two")).values()) == {"unchanged"}
