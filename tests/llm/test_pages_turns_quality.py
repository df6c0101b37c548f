import re

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import boilerplate, quality, turns
from sparkloom.llm.boosting import BoostedTrees, softmax
from sparkloom.llm.peg import Grammar, choice, many, ref, sequence, token

PAGE = """Quoril  Home  Contact  Blog

Home | Docs | Careers

# The zelbek ledger

Share on Loopwire

The ledger of zelbek was tested for nine weeks by two teams. It held, and the numbers were good enough to plan with.

Advertisement

## Results

- readers were faster than writers in most runs
> What they did not say is that one node had been off.

Zelbek | 14 | low
Mornat | 15 | high

The cookie banner of Hatrin was accepted by half of the visitors, which changed what could be counted.

## References

- [Other ledger](https://elsewhere.example/a)

### You may also like
- [Zimbol broker](https://docs.quoril.test/b)
Another teaser sentence stands here alone.

(c) 2024 Quoril. All rights reserved.
"""


def test_page():
    gone = boilerplate.foreign_lines(PAGE, "https://docs.quoril.test/x", "docs.quoril.test")
    lines = PAGE.split("\n")
    assert [lines[i - 1][:18] for i in gone] == ["Quoril  Home  Cont", "Home | Docs | Care", "Share on Loopwire", "Advertisement", "### You may also l", "- [Zimbol broker](", "Another teaser sen", "(c) 2024 Quoril. A"]
    crlf = boilerplate.foreign_lines(PAGE.replace("\n", "\r\n"), "https://docs.quoril.test/x", "docs.quoril.test")
    assert crlf == gone


def test_the_selected_subtree_decides_for_sentences_and_lists():
    outside = ["- [An unknown wording one](https://a.elsewhere.example/1)", "- [An unknown wording two](https://a.elsewhere.example/2)", "", "[Our partners have written down many good stories for their readers this week.](https://b.elsewhere.example/)", ""]
    inside = ["# The zelbek ledger", "", "The ledger of zelbek was tested for nine weeks by two teams, and it held.", "", "## References", "", "- [Other ledger](https://c.elsewhere.example/a)", "- [One more](https://c.elsewhere.example/b)"]
    assert boilerplate.foreign_lines("\n".join(outside + inside), "https://docs.quoril.test/x") == [1, 2, 4]
    assert boilerplate.foreign_lines("\n".join(inside), "https://docs.quoril.test/x") == []
    assert boilerplate.foreign_lines("\n".join(["A lead that stands before the title and has no links at all.", "", *inside]), None) == []
    several = ["## One", "", "A long sentence about the zelbek ledger, which held for nine weeks in a row.", "", "## Links", "", "- [Other ledger](https://c.elsewhere.example/a)"]
    assert boilerplate.foreign_lines("\n".join(several)) == []


def test_page_edges(spark):
    assert boilerplate.foreign_lines(None) == boilerplate.foreign_lines("") == boilerplate.foreign_lines(" \n\r\n") == []
    assert boilerplate.foreign_lines("x" * 200_000 + " is a word. And that was a sentence of its own.") == []
    rows = [(1, PAGE, "https://docs.quoril.test/x", None, 0), (1, PAGE, "https://docs.quoril.test/x", None, 0), (2, None, None, None, 0), (3, "", None, None, 0)]
    df = spark.createDataFrame(rows, "fetch_id long, body_markdown string, url string, origin string, line_no int")
    assert boilerplate.lines_outside_articles(df).count() == 8
    assert "All rights" not in boilerplate.articles(df).where("fetch_id = 1").first()["article"]
    assert boilerplate.lines_outside_articles(df.limit(0)).count() == 0


def test_density_prefers_text_over_links():
    body = boilerplate.read_tree(["# T", "", "A long paragraph of running text that says a thing or two.", "", "[a](http://x.example) [b](http://x.example)"], set())
    body.total()
    body.measure(body)
    text, links = body.children[0].children[1], body.children[0].children[2]
    assert text.density > links.density


PEOPLE = turns.Speakers([(1, "Anna Bekor"), (2, "Carl Dumas-Eltz"), (3, "Anton Bekrin"), (4, "Gero Hanft")])


def spoken(text):
    return [(t[1], t[3]) for t in turns.turns(text, PEOPLE)]


def test_layouts():
    vtt = "# T\n\n## Transcript\n\nWEBVTT\n\n00:00:01.000 --> 00:00:02.000\n<v Dr. Anna Bekor>Uh, one two [laughs] three\n\n00:00:04.000 --> 00:00:05.000\nfour (roughly 5 um of them)\n\n00:00:06.000 --> 00:00:07.000\n<v C.D.>er,\n\n00:00:08.000 --> 00:00:09.000\n<v ANNA BEKOR>six\n"
    assert spoken(vtt) == [(1, 9)]
    srt = "1\n00:00:01,000 --> 00:00:02,000\n>> Dumas-Eltz, Carl: hello there\n\n2\n00:00:03,000 --> 00:00:04,000\n>> ANNA: yes\n"
    assert spoken(srt) == [(2, 2), (1, 1)]
    bracket = "With Anna Bekor, Gero Hanft\n\n[00:00:01] Anna Bekor: One thing: yes\n[00:00:09] GH: late\n[00:00:04]  Gero Hnaft : early\n[00:00:09] GH: late\n\n(recording stops)\n"
    assert spoken(bracket) == [(1, 3), (4, 2)]
    paragraph = "Participants: Anna Bekor\n\nAnna Bekor (moderator) (0:03)\nhello *sighs* world\n\nGERO HANFT (1:02:03)\nok <noise> then\n"
    assert spoken(paragraph) == [(1, 2), (4, 2)]
    bold = "Speaker 1 = Anna Bekor; Speaker 2 = Gero Hanft\n\n00:00:01\n**SPEAKER 2:** first\nsecond part [00:00:05]\n00:00:09\n**Speaker 1:** third ♪ ♪\n"
    assert spoken(bold) == [(4, 3), (1, 1)]


def test_two_people_may_say_the_same_in_one_second():
    both = "[00:00:01] Anna Bekor: Yes\n[00:00:01] Gero Hanft: Yes\n[00:00:01] Anna Bekor: Yes\n[00:00:01] GERO HANFT: Yes\n[00:00:02] Anna Bekor: good\n"
    assert spoken(both) == [(1, 1), (4, 1), (1, 1)]
    assert spoken("[00:00:01] Anna Bekor: Yes\n[00:00:01] Gero Hanft: no\n[00:00:01] Yes\n") == [(1, 1), (4, 1)]


def test_turn_edges(spark):
    assert turns.turns(None, PEOPLE) == turns.turns("", PEOPLE) == turns.turns("no cues\nat all", PEOPLE) == []
    assert spoken("[00:00:01] nobody yet\n[00:00:02] Anna Bekor: now [nested [sound] here] words\n") == [(1, 2)]
    df = spark.createDataFrame([(7, "[00:00:01] Anna Bekor: hi\n", 1), (7, "[00:00:01] Anna Bekor: hi\n", 2), (8, None, 1)], "fetch_id long, body_markdown string, turn_no int")
    people = spark.createDataFrame([(1, "Anna Bekor", "x"), (2, None, None)], "speaker_id int, full_name string, text string")
    assert [(r.fetch_id, r.turn_no, r.n_words) for r in turns.speaker_turns(df, people).collect()] == [(7, 1, 1)]
    assert turns.speaker_turns(df.limit(0), people).count() == 0


def test_slips():
    assert turns.slips("hanft", "hnaft", 2) == 1 and turns.slips("abc", "abc", 1) == 0 and turns.slips("abc", "xyzzy", 1) == 2


def test_grammar_is_ordered_and_nested():
    g = Grammar(s=many(choice(ref("p"), token("[a-z]+", "w"))), p=sequence(token(r"\("), ref("s"), token(r"\)")))
    assert g.parse("s", "a(b(c))d") is not None and g.parse("s", "a(b") is None


COMMON = frozenset("the of and to in is that was for it with as be on not by at this they from had were which but".split())
PROSE = "This was the first of the two that they had to test, and it was not in the plan for the week. They were not told of it by the desk. "


def test_weak_labels():
    junk = "x9Kd" * 80
    for text, want in ((PROSE * 3, "prose"), ("\n".join(f"- zorba {i} melk" for i in range(9)), "list"), ("\n".join(f"| ab{i} | {i} | 3 |" for i in range(9)), "table"), (junk, "junk"), ("buy zorba melk " * 40, "junk"), ("#### $$$$ ----\n" * 9, "junk")):
        values, label = quality.statistics(text, COMMON)
        assert label == want and len(values) == len(quality.NAMES), (text[:30], label)
    assert quality.statistics("", COMMON)[1] is None


def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] > 0).astype(int) + 2 * (x[:, 1] > 0.5)
    model = BoostedTrees(rounds=20).fit(x[:400], y[:400], 4)
    before = model.probabilities(x[400:])
    assert (before.argmax(1) == y[400:]).mean() > 0.9
    noisy = np.where(rng.random(200) < 0.2, rng.integers(0, 4, 200), y[400:])
    loss = lambda p: -np.log(p[np.arange(200), noisy] + 1e-12).mean()
    assert loss(model.calibrate(x[400:], noisy).probabilities(x[400:])) < loss(before)


def test_held_out_accuracy(spark, sf):
    from sparkloom.llm.queries import QUERIES

    folder = sf.replace("0.001", "0.01")
    found = {r.doc_id: r.kind for r in QUERIES["p9_found"](spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/doc_labels.parquet").select("doc_id", "label").distinct().collect()
    right = [found.get(r.doc_id, "prose") == r.label for r in labels]
    assert np.mean(right) > 0.9


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, " \n", "k")], "doc_id long, text string, kind string")
    labels = spark.createDataFrame([], "doc_id long, label string")
    words = spark.createDataFrame([("the",), (None,)], "word string")
    assert quality.document_kinds(docs, labels, words).count() == 0
    got = quality.document_statistics(docs, words).collect()
    assert len(got) == 3 and all(r.n_words == 0 and r.common_share == 0.0 for r in got)
    more = spark.createDataFrame([(i, PROSE * (1 + i % 3) if i % 2 else "- ab cd\n" * 9, "k") for i in range(40)], "doc_id long, text string, kind string")
    kinds = {r.doc_id: r.kind for r in quality.document_kinds(more, labels, words).collect()}
    assert len(kinds) == 40


def test_checked_documents_are_set_aside_before_training(spark, monkeypatch):
    fits, counts = [], []
    fit, calibrate = BoostedTrees.fit, BoostedTrees.calibrate
    monkeypatch.setattr(BoostedTrees, "fit", lambda self, x, y, n: (fits.append(len(x)), fit(self, x, y, n))[1])
    monkeypatch.setattr(BoostedTrees, "calibrate", lambda self, x, y, **more: (counts.append(len(y)), calibrate(self, x, y, **more))[1])
    docs = spark.createDataFrame([(i, PROSE * (1 + i % 3) if i % 2 else "- ab cd\n" * 9) for i in range(40)], "doc_id long, text string")
    words = spark.createDataFrame([("the",)], "word string")
    for n, trained, calibrated in ((0, 40, []), (12, 28, [12]), (40, 40, [])):
        labels = spark.createDataFrame([(i, "prose" if i % 2 else "list") for i in range(n)], "doc_id long, label string")
        fits.clear(), counts.clear()
        kinds = {r.doc_id: r.kind for r in quality.document_kinds(docs, labels, words).collect()}
        assert counts == calibrated and fits == [trained] and all(kinds[i] == ("prose" if i % 2 else "list") for i in range(40))


def test_all_common_words_count(spark, monkeypatch):
    monkeypatch.setattr(quality, "MOST_COMMON_WORDS", 2)
    docs = spark.createDataFrame([(1, "the of and to in")], "doc_id long, text string")
    words = spark.createDataFrame([(w,) for w in ("the", "The", "of", "and", "to", "in", None)], "word string")
    assert quality.document_statistics(docs, words).first()["common_share"] == 1.0


def test_the_holdout_is_there_and_calibration_helps_what_it_has_not_seen(spark, sf):
    folder = sf.replace("0.001", "0.1")
    common = quality._word_list(spark.read.parquet(f"{folder}/common_words.parquet"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").where("text is not null").select("doc_id", "text").collect()}
    measured = {i: quality.statistics(t, common) for i, t in sorted(texts.items()) if t.strip()}
    assert not any(name in k for k in quality.KINDS for name in quality.NAMES)  # no share of a kind is a statistic
    names = {r.doc_id: r.label for r in spark.read.parquet(f"{folder}/doc_labels.parquet").where("label in ('prose', 'list', 'table', 'junk')").groupBy("doc_id").agg(F.min("label").alias("label"), F.countDistinct("label").alias("n")).where("n = 1").collect()}
    train = [(x, w) for i, (x, w) in measured.items() if w and i not in names]
    hold = [(measured[i][0], k) for i, k in sorted(names.items()) if i in measured]
    assert len(hold) > 1000
    model = BoostedTrees().fit(np.array([x for x, _ in train]), np.array([quality.KINDS.index(w) for _, w in train]), 4)
    scores, truth = model.score(np.array([x for x, _ in hold])), np.array([quality.KINDS.index(k) for _, k in hold])
    even = np.arange(len(truth)) % 2 == 0
    loss = lambda p: -np.log(np.clip(p[np.arange((~even).sum()), truth[~even]], 1e-9, 1)).mean()
    before = softmax(np.clip(scores[~even], -8, 8))
    model.calibrate(None, truth[even], scores=scores[even])
    assert loss(softmax(np.clip(scores[~even], -8, 8) * model.scale + model.shift)) < loss(before)
    assert (before.argmax(1) == truth[~even]).mean() > 0.9


def test_tree_links_and_density_find_most_without_the_phrase_lists(spark, sf, monkeypatch):
    pages = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/fetched_docs.parquet").where("source_type = 'html-article' and body_markdown is not null")
    rows = [tuple(r) for r in pages.select("body_markdown", "url", "origin").distinct().collect()]
    every = [set(boilerplate.foreign_lines(*r)) for r in rows]
    monkeypatch.setattr(boilerplate, "ELSEWHERE", ())
    monkeypatch.setattr(boilerplate, "LABELS", frozenset())
    monkeypatch.setattr(boilerplate, "SPEAKS", re.compile(r"(?!x)x"))
    without = [set(boilerplate.foreign_lines(*r)) for r in rows]
    assert all(a >= b for a, b in zip(every, without))
    assert sum(map(len, without)) > 0.6 * sum(map(len, every))
