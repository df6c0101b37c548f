import json

import pytest

from sparkloom.plans.stages import Project

LONG = "<html><head><title>Far page</title></head><body><main><p>" + "A sentence of a page that says something. " * 8 + "</p></main></body></html>"


@pytest.fixture
def project(spark, tmp_path):
    p = Project(spark, str(tmp_path / "demo"))
    p.init("Demo")
    return p


def put(folder, **texts):
    folder.mkdir(exist_ok=True)
    for n, t in texts.items():
        (folder / f"{n}.md").write_bytes(t.encode())
    return [str(folder / f"{n}.md") for n in texts]


def test_intake_folds_numbers_and_writes(project, tmp_path):
    paths = put(tmp_path / "in", a="# First one\r\nbody\r\n", b="# First one\nbody\n", c="no heading\n")
    told = [("a.md", "S01"), ("b.md", "S01"), ("c.md", "S02")]
    shown = lambda out: [(e["source"], e.get("source_id") or e["duplicate_of"]) for e in out["events"]]
    dry = project.intake(paths, dry_run=True)
    assert shown(dry) == told and not list((project.root / "sources").iterdir())
    out = project.intake(paths)
    assert shown(out) == told and [e["action"] for e in out["events"]] == ["created", "rejected-duplicate", "created"]
    assert out["gate"]["status"] == "PASS" and sorted(f.name for f in (project.root / "sources").iterdir()) == ["S01-first-one.md", "S02-c.md"]
    assert [e["action"] for e in project.intake(paths)["events"]] == ["rejected-duplicate"] * 3
    assert project.intake(put(tmp_path / "in", d="new\n"))["events"][0]["source_id"] == "S03"
    with pytest.raises(ValueError, match="unsupported source format"):
        project.intake([str(tmp_path / "x.exe")])
    (tmp_path / "in" / "e.pdf").write_bytes(b"%PDF")
    with pytest.raises(ValueError, match="takes a function"):
        project.intake([str(tmp_path / "in" / "e.pdf")])
    assert project.intake([str(tmp_path / "in" / "e.pdf")], convert=lambda n, b: "# Converted\n")["events"][0]["source_id"] == "S04"


def test_migrate_keeps_bodies_and_runs_again_alike(project, tmp_path):
    project.intake(put(tmp_path / "in", a="# One\nbody\n---\nmore\n"))
    f = next((project.root / "sources").glob("S01*"))
    old = "\n".join(x for x in f.read_text().split("\n") if not x.startswith(("schema_version", "source_type", "url", "resolved_from")))
    f.write_text(old)
    assert project.check_intake()["warnings"]
    assert project.migrate(dry_run=True)["events"][0]["action"] == "dry-run" and f.read_text() == old
    out = project.migrate()
    assert out["events"] == [{"source": "S01", "action": "replaced", "source_type": "report"}] and out["gate"]["status"] == "PASS" and not out["gate"]["warnings"]
    assert f.read_text().endswith("# One\nbody\n---\nmore\n") and project.migrate()["events"][0]["action"] == "unchanged"


def test_resolve(project, tmp_path):
    near, = put(tmp_path / "in", near="# Near\nnear text\n")
    body = "# One\n[p](https://h.example/a) and https://h.example/same, [gone](https://h.example/gone), `near.md`, `absent.md`, https://youtu.be/vid1 and https://vimeo.com/77\n"
    project.intake(put(tmp_path / "in", one=body))
    cfg = project.root / "cfg"

    def get(url):
        if "timedtext?type=list" in url:
            return 200, "text/xml", b'<l><track lang_code="de"/><track lang_code="en"/></l>'
        if "timedtext?lang=en" in url:
            return 200, "text/xml", b'<t><text start="1" dur="2">said &amp;amp; done</text><text start="30" dur="1">later</text></t>'
        if "oembed" in url:
            return 200, "application/json", json.dumps({"title": "Talk", "author_name": "Someone"}).encode()
        if "player.vimeo.com" in url:
            return (200, "text/vtt", b"WEBVTT\n\n00:01.000 --> 00:02.000\nhello\n") if url.endswith("x.vtt") else (200, "application/json", cfg.read_bytes())
        return (404, "", b"") if "gone" in url else (200, "text/html; charset=utf-8", LONG.encode())

    cfg.write_text("{}")
    dry = project.resolve(get, dry_run=True)
    assert dry["counts"]["fetched"] == 6 and not (project.root / "index" / "resolution.jsonl").exists()
    out = project.resolve(get, pause=0.0)
    assert out["counts"] == {"fetched": 3, "cached": 0, "duplicate": 1, "transcript_pending": 1, "failed": 1}, out
    assert [(e["action"], e["source_id"]) for e in out["events"]] == [("fetched", "S02"), ("duplicate", "S02"), ("failed", None), ("fetched", "S03"), ("fetched", "S04"), ("transcript_pending", "S05")]
    assert out["gate"]["status"] == "PASS", out["gate"]
    assert "[00:00:01] said & done\n\n[00:00:30] later" in next((project.root / "sources").glob("S04*")).read_text()
    before = (project.root / "index" / "resolution.jsonl").read_text()
    again = project.resolve(get, pause=0.0)
    assert again["counts"] == {"fetched": 0, "cached": 4, "duplicate": 0, "transcript_pending": 1, "failed": 1} and (project.root / "index" / "resolution.jsonl").read_text() == before
    cfg.write_text(json.dumps({"request": {"text_tracks": [{"lang": "en", "url": "/x.vtt"}]}}))
    last = project.resolve(get, only="vimeo", pause=0.0)
    assert [(e["action"], e["source_id"]) for e in last["events"]] == [("fetched", "S05")] and "[00:00:01] hello" in next((project.root / "sources").glob("S05*")).read_text()
    assert last["gate"]["status"] == "PASS" and len((project.root / "index" / "resolution.jsonl").read_text().splitlines()) == 7
    with pytest.raises(ValueError, match="unknown source id"):
        project.resolve(get, source_ids=["S99"])


def test_synthesise_keeps_edited_masters(project, tmp_path):
    project.intake(put(tmp_path / "in", one="# One\nbody\n"))
    claim = {"claim_id": "S01-C001", "source_id": "S01", "claim_text": "t", "claim_type": "fact", "topic_tags": ["cold-storage"], "supporting_quote_location": "x", "confidence_as_stated": "low", "depends_on": []}
    (project.root / "claims" / "S01-claims.jsonl").write_text(json.dumps(claim))
    (project.root / "index" / "reconciliation.jsonl").write_text(json.dumps({"group_id": "G001", "claim_ids": ["S01-C001"], "decision": "UNIQUE", "rule_applied": "r", "decided_by": "op"}))
    with pytest.raises(RuntimeError):
        project.synthesise()
    assert project.check_claims()["status"] == project.check_decisions()["status"] == "PASS"
    assert project.synthesise(dry_run=True) == "dry-run" and project.synthesise() == "created" and project.synthesise() == "unchanged"
    master = project.root / "output" / "MASTER.md"
    assert "## Cold Storage" in master.read_text() and "Claims to cover: [S01-C001]" in master.read_text() and "| S01 | One | report |" in master.read_text()
    assert any("todo" in r for r in project.check_master()["reasons"])
    master.write_text("edited")
    assert project.synthesise() == "kept-existing" and master.read_text() == "edited" and project.synthesise(force=True) == "replaced"
