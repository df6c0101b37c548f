import json

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import audit, intake, links, pages, reconcile, similarity, synthesis
from sparkloom.streaming import control


def test_sections_citations_and_faults(spark):
    text = "intro S01-C001\n## A \nprose S01-C002\n\n- bare\n### deeper\n## Conflicts\nS01-C003\n## Gaps\n\n## Appendix: Source Register\nS01-C009"
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x")], "doc int, body string, heading string")
    parts = synthesis.sections(docs, "doc", "body")
    got = [(r.section_no, r.heading) for r in parts.where("doc = 1").orderBy("section_no").collect()]
    assert got == [(0, ""), (1, "A"), (2, "Conflicts"), (3, "Gaps"), (4, "Appendix: Source Register")]
    cites = {r.claim_id: r.location for r in synthesis.first_citations(parts, "doc").collect()}
    assert cites == {"S01-C001": "preamble", "S01-C002": "A", "S01-C003": "Conflicts"}
    assert [(r.heading, r.n_prose, r.n_unmarked) for r in synthesis.prose_faults(parts, "doc").collect()] == [("A", 2, 1)]
    reasons = {r.reason for r in synthesis.master_faults(docs, "doc", "body").where("doc = 1").collect()}
    assert reasons == {"Gaps section is empty"}
    assert parts.where("doc = 2").count() == 0


def test_links(spark):
    body = "See [a](http://x.example/(1)) and http://y.example/p). `http://hidden.example` [b](notes.md) `data/in.txt` http://y.example/p"
    df = spark.createDataFrame([(1, body, "/docs/a.md"), (2, None, None), (3, "](" + "z" * 20000 + ")", None)], "id int, body string, origin string")
    files = spark.createDataFrame([("/docs/notes.md",)], "path string")
    got = [(r.id, r.raw, r.kind) for r in links.discover(df, "id", "body", "origin", files).orderBy("id", "pos").collect()]
    assert got == [(1, "http://x.example/(1)", "url"), (1, "http://y.example/p", "url"), (1, "/docs/notes.md", "local")]


PAGE = """<html><head><title> T </title><meta property="og:title" content="Og  T"></head><body><nav><p>menu</p></nav>
<main><h2>Head</h2><p>One <a href="/x">link</a></p><div>lost</div><ul><li><p>in</p> item</li></ul><blockquote>q</blockquote><pre>
 a
  b
</pre><table><tr><th>k</th><td>v &amp; w</td><td></td></tr></table><script>var s = "</p>";</script></main><article><p>second</p></article></body></html>"""


def test_page_text():
    text, title = pages.page_text(PAGE, "https://h.example/d/")
    assert title == "Og T"
    assert text == "## Head\n\nOne link (https://h.example/x)\n\n- in item\n\n> q\n\n```\n a\n  b\n```\n\nk | v & w\n"
    assert pages.page_text("<p>a<br>b</p>") == ("a b\n", None)
    assert pages.page_text("") == ("", None)


def test_captions(spark):
    vtt = "WEBVTT\n\nNOTE x\ny\n\n1\n00:01.000 --> 00:02.000\n<v A>hi &amp; bye</v>\nmore\n\n00:00:11.000 --> 00:00:12.000\n \n\n00:00:12.500 --> 00:00:13.000\nlate"
    assert pages.vtt_cues(vtt) == [(0, 1.0, 2.0, "hi & bye more"), (1, 11.0, 12.0, ""), (2, 12.5, 13.0, "late")]
    assert pages.timedtext_cues("<t><text start='1' dur='2'>a &amp;amp; b</text></t>") == [(0, 1.0, 3.0, "a & b")]
    assert pages.timedtext_cues("<t>") == []
    df = spark.createDataFrame([(1, vtt)], "k int, v string")
    cues = df.select("k", F.inline(pages.parse_vtt("v")))
    assert [(r.para, r.line) for r in pages.paragraphs(cues, "k").orderBy("start").collect()] == [(0, "[00:00:01] hi & bye more"), (1, "[00:00:12] late")]
    tracks = spark.createDataFrame([(["de", "EN-gb"],), (["de", "fr"],), ([],)], "t array<string>")
    assert [r[0] for r in tracks.select(pages.chosen_track(F.col("t"))).collect()] == ["EN-gb", "de", None]


def test_candidates_equal_brute_force(spark):
    words = "a b c d e f g h i j".split()
    rows = [(f"S01-C{i:03}", " ".join(words[j] for j in range(10) if (i * 37 + j * j) % 5 < 3 or j == i % 7), [f"t{i % 3}", None], "clash") for i in range(60)]
    rows += [("S01-C100", None, ["t1"], "x"), ("S01-C101", "", ["t1"], "x"), ("S01-C102", "a b", None, "x"), rows[0]]
    df = spark.createDataFrame(rows, "claim_id string, claim_text string, topic_tags array<string>, key string")
    got = {(r.claim_id_a, r.claim_id_b): r.token_overlap for r in similarity.candidate_pairs(df).collect()}
    want = {}
    sets = {r[0]: (set((r[1] or "").split()), set(t for t in r[2] or [] if t)) for r in rows}
    for a in sets:
        for b in sets:
            (x, tx), (y, ty) = sets[a], sets[b]
            if a < b and tx & ty and x and y and 20 * len(x & y) >= 7 * len(x | y):
                want[a, b] = round(len(x & y) / len(x | y), 3)
    assert got == want and len(want) > 50
    assert similarity.numbered(similarity.candidate_pairs(df)).agg(F.min("candidate_id")).first()[0] == "P001"


def test_trace_and_gate(spark):
    claims = spark.createDataFrame([("S1", f"c{i}") for i in range(5)], "source_id string, claim_id string")
    groups = spark.createDataFrame(
        [("g1", ["c0"], "UNIQUE", None, 1), ("g2", ["c1", "c2"], "SUPERSEDED", "c1", 1), ("g3", ["c3"], "OUT_OF_SCOPE", None, 1), ("g3", ["c3"], "CONFLICT", None, 2)],
        "group_id string, claim_ids array<string>, decision string, winner string, recorded_at int",
    )
    places = spark.createDataFrame([("c0", "A")], "claim_id string, location string")
    got = {r.claim_id: r.status for r in audit.trace_matrix(claims, groups, places).collect()}
    assert got == {"c0": "cited", "c1": "NOT CITED", "c2": "superseded by c1", "c3": "logged in Conflicts", "c4": "NOT CITED"}
    assert audit.coverage(audit.trace_matrix(claims, groups, places)).first()["coverage"] == "4/5"
    assert {r.claim_id for r in reconcile.undecided(claims, groups).collect()} == {"c4"}
    reasons = spark.createDataFrame([("p", 2, "late"), ("p", 1, "first")], "project string, ord int, reason string")
    every = spark.createDataFrame([("p",), ("q",)], "project string")
    assert {r.project: (r.status, r.reasons) for r in audit.gate(reasons, "project", every, "ord").collect()} == {"p": ("FAIL", ["first", "late"]), "q": ("PASS", [])}


def test_resolve_states(spark):
    targets = spark.createDataFrame([(i, t, "url", "S01") for i, t in enumerate("abcdefg")], "ord int, target string, kind string, parent string")
    prior = spark.createDataFrame([("a", "fetched", "S02", None, None), ("b", "transcript_pending", "S03", "S01", None), ("c", "transcript_pending", "S04", None, None)], "target string, status string, source_id string, resolved_from string, sha256 string")
    got = spark.createDataFrame([("b", "x", "fetched", None), ("c", "stub", "pending", None), ("d", None, None, "HTTP 404"), ("e", "new", None, None), ("f", "new", None, None), ("g", "known", None, None)], "target string, body string, transcript_status string, error string")
    existing = spark.createDataFrame([("S09", "known")], "source_id string, body string").select("source_id", F.sha2("body", 256).alias("sha256"))
    out = intake.resolve_outcomes(targets, prior, got, existing)
    assert {r.target: r.outcome for r in out.collect()} == dict(a="cached", b="fetched", c="transcript_pending", d="failed", e="fetched", f="duplicate", g="duplicate")
    assert intake.outcome_counts(out).first().asDict() == {"fetched": 2, "cached": 1, "duplicate": 2, "transcript_pending": 1, "failed": 1}


def test_numbering_is_gapless_and_ordered(spark):
    new = spark.range(500).select((F.lit(1000) - F.col("id")).alias("ord"))
    got = intake.number_new(new, "ord", 98).orderBy("ord").select("new_id").collect()
    assert [r[0] for r in got[:3]] == ["S98", "S99", "S100"] and len({r[0] for r in got}) == 500


def test_control_stream_equals_batch(spark, tmp_path):
    queue = tmp_path / "queue"
    queue.mkdir()
    line = lambda i, s, d, e="directive": f'{{"id":"{i}","event":"{e}","session":"{s}","directive":"{d}"}}'
    lines = [line(1, "a", "stop"), "broken", line(1, "a", "stop"), line(2, "b", "go"), line(3, "a", " "), line(4, "a", "continue automatically"), line(5, "a", "stop", "queued")]
    (queue / "q.json").write_text("\n".join(lines))
    sessions = spark.createDataFrame([("a", "active"), ("b", "done")], "session string, status string")
    stream = control.consume(control.read_queue(spark, str(queue)), sessions).writeStream.format("memory").queryName("asked").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert {(r.id, r.action) for r in spark.table("asked").collect()} == {("1", "stop"), ("4", "automatic")}


def test_queue_of_a_session(spark, tmp_path):
    queue = control.Queue(tmp_path / "c")
    with pytest.raises(ValueError, match="no guided session"):
        queue.put("go")
    one = queue.start()
    with pytest.raises(ValueError, match="cannot be empty"):
        queue.put("  ")
    queue.put(" stop now ")
    queue.put("look at the tables")
    assert [(t["directive"], t["action"]) for t in queue.follow(spark)] == [("stop now", "stop"), ("look at the tables", "guidance")]
    queue.put("run automatically")
    assert [t["action"] for t in queue.follow(spark)] == ["automatic"] and queue.follow(spark) == []
    queue.finish(one)
    with pytest.raises(ValueError, match="no guided session"):
        queue.put("go")
    kinds = [json.loads(x)["event"] for x in queue.log.read_text().splitlines()]
    assert kinds == ["session_started", "queued", "queued", "received", "interpreted", "received", "interpreted", "queued", "received", "interpreted", "session_finished"]


def test_first_section_of_a_name_counts(spark):
    docs = spark.createDataFrame([(1, "## Gaps\n\n## Gaps\nsome\n## Conflicts\nnone\n## Conflicts\nS01-C001")], "doc int, body string")
    parts = synthesis.sections(docs, "doc", "body")
    groups = spark.createDataFrame([("g", ["S01-C001"], "CONFLICT")], "group_id string, claim_ids array<string>, decision string")
    assert [tuple(r) for r in synthesis.absent_conflicts(parts, "doc", groups).collect()] == [("g", "S01-C001")]
    assert "Gaps section is empty" in {r.reason for r in synthesis.master_faults(docs, "doc", "body").collect()}
    winners = spark.createDataFrame([("S01-C001", "g"), ("S01-C002", "h")], "claim_id string, group_id string")
    assert [tuple(r) for r in synthesis.uncited_winners(parts, "doc", winners).collect()] == [("S01-C002", "h")]


def test_candidates_are_numbered_over_all_ranges(spark):
    pairs = spark.range(0, 1200, 1, 7).selectExpr("format_string('a%05d', (id * 7) % 1200) claim_id_a", "'b' claim_id_b")
    got = [tuple(r) for r in similarity.numbered(pairs).orderBy(F.length("candidate_id"), "candidate_id").select("candidate_id", "claim_id_a").collect()]
    assert got[:2] == [("P001", "a00000"), ("P002", "a00001")] and got[-1] == ("P1200", "a01199")
    assert similarity.numbered(pairs.limit(0)).count() == 0
