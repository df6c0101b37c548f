"""Clean speaker turns out of raw transcripts (problem 5).

Method: three parsing-expression grammars. LINES reads what a line of a transcript is: a cue's time, alone or with a label, a cue
number, a heading, or speech with a time behind it. LABELS reads the ways a label stands before speech: as a voice tag, in bold,
after chevrons, before a colon. SPEECH reads nested annotations, times, hesitations and words within what was said. The trees become cues (time, label, words); cues are put in order of time, labels are resolved
to speakers, and the cues of one speaker in a row become a turn.

A label names a speaker by the full name, either order, by first or last name, by initials, as ``Speaker N`` of the
transcript's own list, with titles, roles, any case and small slips; the speakers the transcript itself names go first.

A transcript is read by itself, in Arrow batches; the speakers (bounded by MOST_SPEAKERS, checked) travel with the plan.

Defined results: null, empty and blank bodies and those without cues have no turns; a cue before any label has no speaker and
is left out; a label nobody answers to is ordinary text; rows that repeat count once, and of several bodies of one fetch_id the
one whose turns sort last counts; empty tables give none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.peg import Grammar, Tree, choice, many, maybe, ref, sequence, token, unless

MOST_SPEAKERS = 100_000
CLOCK = r"(?:\d{1,3}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?"
# Sounds of hesitation, and words by which an annotation tells of a sound.
HESITATION = r"(?:u+h+m*|u+m+|e+r+m*|h+m+|m+-?h+m+|mm+|uh-huh|uh-uh|mm-mm)(?![\w'’-])"
SOUND = re.compile(
    r"\b(?:applau\w*|applaus|laugh\w*|chuckl\w*|giggl\w*|cough\w*|sigh\w*|sneez\w*|gasp\w*|sniff\w*|groan\w*|cheer\w*|boo\w*|crosstalk|cross-talk|overlapping|inaudible|unintelligible|indistinct|"
    r"noise|static|silence|pause\w*|music|singing|sings|hum\w*|door\w*|phone\w*|bell\w*|ring\w*|knock\w*|beep\w*|typing|clears? throat|throat|background|recording|audio|video|tape|sound\w*|whisper\w*|"
    r"off mic|microphone|break|end of)\b",
    re.IGNORECASE,
)

LINES = Grammar(
    line=choice(
        sequence(ref("range"), token(r".*$")), sequence(ref("framed"), token(r"\s*"), ref("rest")), sequence(ref("stamp"), token(r"\s*$")), ref("named"),
        sequence(ref("rest"), ref("trailing")), token(r"\s*(?:#{1,6}\s.*|WEBVTT.*|NOTE\b.*|STYLE\s*|REGION\s*)$", "matter"), token(r"\s*\d+\s*$", "number"), ref("rest")),
    range=sequence(token(r"\s*"), ref("time"), token(r"\s*-->\s*"), ref("time")),
    framed=sequence(token(r"\s*[\[(]\s*"), ref("time"), token(r"\s*[\])]")),
    stamp=sequence(token(r"\s*"), ref("time")),
    named=sequence(token(r"\s*[^()\[\]]*?(?=\s*(?:\([^()\d]*\))?\s*\()", "label"), token(r"\s*(?:\([^()\d]*\)\s*)?\(\s*"), ref("time"), token(r"\s*\)\s*$")),
    trailing=sequence(token(r"\s*\[\s*"), ref("time"), token(r"\s*\]\s*$")),
    time=token(CLOCK),
    rest=many(choice(sequence(unless(ref("trailing")), token(r"[^\[]+|\[")))),
)
SPEECH = Grammar(
    speech=many(choice(token(rf"(?:(?!(?i:{HESITATION}))[^\s\[\](<>*♪♫]++[)\]]*+\s*+)+"), ref("annotation"), ref("hesitation"), ref("word"), token(r"\s+"))),
    annotation=choice(
        sequence(token(r"\["), many(choice(ref("annotation"), token(r"[^\[\]]+"))), token(r"\]")),
        sequence(token(r"<"), many(choice(ref("annotation"), token(r"[^<>]+"))), token(r">")),
        sequence(token(r"\((?=[^()]*\))"), ref("told"), token(r"\)")),
        sequence(token(r"\*(?=[^*\s][^*\n]*\*)"), ref("told"), token(r"\*")),
        token(r"[♪♫][^♪♫\n]*[♪♫]?")),
    told=many(choice(token(r"[^()*\[\]<>]+"))),
    hesitation=token(HESITATION + r"[,.…]*", "", re.IGNORECASE),
    word=token(r"[\[(<*]?[^\s\[\](<>*♪♫]+[)\]]*|\S"),
)
LABELS = Grammar(
    voice=sequence(token(r"\s*<v(?:\.[\w.]+)?\s+"), token(r"[^>]*", "label"), token(r">"), token(r"[\s\S]*?(?=(?:</v>)?\s*\Z)", "said"), token(r"(?:</v>)?\s*")),
    bold=sequence(token(r"\s*(?:\*\*|__)\s*"), token(r"[^*_\n]{1,80}?(?=\s*:?\s*(?:\*\*|__))", "label"), token(r"\s*:?\s*(?:\*\*|__)\s*:?"), ref("all")),
    chevron=sequence(token(r"\s*>>+\s*"), token(r"[^:\n]{1,80}?(?=\s*:)", "label"), token(r"\s*:"), ref("all")),
    colon=sequence(token(r"\s*(?:[-–]\s*)?"), token(r"[^:\[\]<>\n*]{1,80}?(?=\s*:(?:\s|\Z))", "label"), token(r"\s*:(?:\s|\Z)"), ref("all")),
    all=token(r"[\s\S]*", "said"),
)
FORMS = ("voice", "bold", "chevron", "colon")  # most marked first
FRAMED = re.compile(rf"[\[(]?{CLOCK}[\])]?")
TITLES = re.compile(r"^(?:dr|prof|mr|mrs|ms|sir|dame|herr|frau|m|mme|sr|sra)\.?\s+(?=\S{2,})", re.IGNORECASE)
NUMBERED = re.compile(r"speaker\s*#?\s*(\d+)$", re.IGNORECASE)


@dataclass
class Cue:
    time: float
    text: str
    label: str | None = None


def seconds(clock: str) -> float:
    total = 0.0
    for part in clock.replace(",", ".").split(":"):
        total = total * 60 + float(part)
    return total


def deep(t: Tree, rule: str) -> Tree | None:
    """The first subtree of a rule, in order."""
    for p in t.parts:
        if p.rule == rule:
            return p
        if found := deep(p, rule):
            return found
    return None


def read_cues(body: str) -> tuple[list[Cue], list[str]]:
    """The cues in the order they stand, and the lines before the first one."""
    cues: list[Cue] = []
    head: list[str] = []
    current: Cue | None = None
    for line in re.split(r"\r\n|\r|\n", body):
        tree = LINES.parse("line", line) if line.strip() else None
        if tree is None:
            continue
        kinds = {p.rule for p in tree.parts} | {q.rule for p in tree.parts for q in p.parts}
        clock = deep(tree, "time")
        if "range" in kinds or "stamp" in kinds:
            current = Cue(seconds(clock.text(line)), "")
            cues.append(current)
        elif "framed" in kinds:
            current = Cue(seconds(clock.text(line)), deep(tree, "rest").text(line))
            cues.append(current)
        elif "named" in kinds:
            label = deep(tree, "label").text(line).strip()
            current = Cue(seconds(clock.text(line)), "", label or None)
            cues.append(current)
        elif "trailing" in kinds:
            cues.append(Cue(seconds(deep(deep(tree, "trailing"), "time").text(line)), deep(tree, "rest").text(line)))
        elif "matter" in kinds or "number" in kinds:
            if current is None:
                head.append(line)
        elif current is None:
            head.append(line)
        else:
            current.text = f"{current.text}\n{line}" if current.text else line
    return cues, head


def words_of(text: str) -> list[str]:
    """What was said: the strings with a letter or digit, without times, annotations and hesitations."""
    tree = SPEECH.parse("speech", text)
    if tree is None:
        return [w for w in text.split() if any(map(str.isalnum, w))]
    pieces: list[str] = []
    for p in tree.parts:
        if p.rule == "annotation":
            inside = p.text(text)
            told = inside[1:-1].strip() if inside[0] in "(*" else None
            heard = told is None or SOUND.search(told) and len(told.split()) <= 4 or not re.search(r"[^\W_]", told)
            pieces.append(" " if heard else f"{inside[0]}{' '.join(words_of(told))}{inside[-1]}")
        elif p.rule == "hesitation":
            before = text[p.start - 1 : p.start]
            pieces.append(p.text(text) if before and not before.isspace() and before not in "([<*>])\"“—–-,." else " ")
        else:
            pieces.append(p.text(text))
    return [w for w in "".join(pieces).split() if any(map(str.isalnum, w)) and not (":" in w and FRAMED.fullmatch(w))]


def slips(a: str, b: str, most: int) -> int:
    """Edits between two strings, a swap of neighbours being one; ``most + 1`` when there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if two and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


class Speakers:
    """Who may be meant by a label."""

    def __init__(self, people: list[tuple[int, str]]) -> None:
        self.people = [(i, " ".join(n.lower().split())) for i, n in people if n and n.strip()]
        self.full = {n: i for i, n in reversed(self.people)}
        self.misspelt: dict[str, int | None] = {}  # labels compared with everyone's name before

    def in_text(self, text: str) -> set[int]:
        low = " ".join(re.sub(r"[^\w\s-]", " ", text.lower()).split())
        return {i for n, i in self.full.items() if n in low and re.search(rf"(?<![\w-]){re.escape(n)}(?![\w-])", low)}

    @staticmethod
    def clean(label: str) -> str:
        label = re.sub(r"\([^()]*\)", " ", label.strip().strip("*_>").strip())
        label = " ".join(label.strip(" :;-–").split())
        while (shorter := TITLES.sub("", label)) != label:
            label = shorter
        if label.count(",") == 1:
            last, first = (x.strip() for x in label.split(","))
            label = f"{first} {last}" if first and last else first or last
        return label.lower()

    def resolve(self, label: str, numbered: dict[int, int], here: set[int]) -> int | None:
        name = self.clean(label)
        if not name or len(name) > 80:
            return None
        if m := NUMBERED.match(name):
            return numbered.get(int(m[1]))
        if name in self.full:
            return self.full[name]
        near = [p for p in self.people if p[0] in here]
        letters = name.replace(".", "").replace(" ", "")
        for group in (near, self.people):
            if " " not in name:
                found = {i for i, n in group if name in (n.split()[0], n.split()[-1], n)}
                if len(found) == 1:
                    return found.pop()
            if 2 <= len(letters) <= 4 and letters.isalpha():
                found = {i for i, n in group if letters in ("".join(w[0] for w in n.split()), "".join(w[0] for w in re.split(r"[\s-]", n)))}
                if len(found) == 1:
                    return found.pop()
        if len(name) < 5:
            return None
        if (found := self.closest(name, near)) is not None:
            return found
        if name not in self.misspelt:
            if len(self.misspelt) >= MOST_SPEAKERS:
                self.misspelt.clear()
            self.misspelt[name] = self.closest(name, self.people)
        return self.misspelt[name]

    @staticmethod
    def closest(name: str, group: list[tuple[int, str]]) -> int | None:
        """The one person of the group whose name is at most two slips away, and nearer than any other's."""
        scored = sorted((min([slips(name, n, 2), *(slips(name, w, 1) for w in n.split() if " " not in name and len(w) >= 5)]), i) for i, n in group)
        return scored[0][1] if scored and scored[0][0] <= 2 and (len(scored) == 1 or scored[1][0] > scored[0][0]) else None


def split_label(cue: Cue) -> list[tuple[str, str]]:
    """The readings (label, speech) a cue's text allows, most marked first."""
    if ":" not in cue.text and ">" not in cue.text and "__" not in cue.text and "**" not in cue.text:
        return []
    trees = (LABELS.parse(form, cue.text) for form in FORMS)
    return [(deep(t, "label").text(cue.text), deep(t, "said").text(cue.text)) for t in trees if t is not None]


def turns(body: str | None, people: Speakers) -> list[tuple[int, int, float, int, str]]:
    """(turn_no, speaker_id, start, n_words, text) of one transcript."""
    if not body or not body.strip():
        return []
    cues, head = read_cues(body)
    top = "\n".join(head)
    numbered: dict[int, int] = {}
    for n, name in re.findall(r"speaker\s*#?\s*(\d+)\s*[=:]\s*([^;\n]+)", top, re.IGNORECASE):
        found = people.resolve(name, {}, set())
        if found is not None:
            numbered[int(n)] = found
    here = people.in_text(top) | set(numbered.values())
    for c in cues:
        for label, _ in [(c.label, "")] if c.label else split_label(c)[:1]:
            who = people.full.get(people.clean(label))
            if who is not None:
                here.add(who)
    known: dict[str, int | None] = {}

    def who_is(label: str) -> int | None:
        if label not in known:
            known[label] = people.resolve(label, numbered, here)
        return known[label]

    said: list[tuple[float, int | None, list[str]]] = []
    for c in cues:
        text, speaker = c.text, who_is(c.label) if c.label else None
        if not c.label:
            for label, speech in split_label(c):
                if (found := who_is(label)) is not None:
                    text, speaker = speech, found
                    break
        said.append((c.time, speaker, words_of(text)))
    said.sort(key=lambda x: x[0])
    out: list[list] = []
    seen: dict[tuple, set[int]] = {}
    speaker: int | None = None
    for time, named, words in said:
        speaker = named if named is not None else speaker
        if not words or speaker is None:
            continue
        by = seen.setdefault((time, tuple(words)), set())
        if by if named is None else named in by:  # a cue without label repeats whoever said the same then
            continue
        by.add(speaker)
        if out and out[-1][0] == speaker:
            out[-1][2].extend(words)
        else:
            out.append([speaker, time, list(words)])
    return [(k, s, t, len(w), " ".join(w)) for k, (s, t, w) in enumerate(out, 1)]


TURN = "array<struct<turn_no:int,speaker_id:int,start:double,n_words:int,text:string>>"


def _read(people: Speakers):
    kind = pa.list_(pa.struct([("turn_no", pa.int32()), ("speaker_id", pa.int32()), ("start", pa.float64()), ("n_words", pa.int32()), ("text", pa.string())]))
    names = ("turn_no", "speaker_id", "start", "n_words", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(names, t)) for t in turns(x, people)] for x in b["body"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["fetch_id"], pa.array(found, kind)], names=["fetch_id", "turns"])

    return run


def speaker_turns(docs: DataFrame, speakers: DataFrame, key: str = "fetch_id", body: str = "body_markdown") -> DataFrame:
    """(fetch_id, turn_no, speaker_id, start, n_words, text) of the given transcripts."""
    rows = speakers.select("speaker_id", "full_name").where("full_name is not null").limit(MOST_SPEAKERS + 1).collect()
    if len(rows) > MOST_SPEAKERS:
        raise ValueError(f"more than {MOST_SPEAKERS} speakers")
    people = Speakers(sorted((r[0], r[1]) for r in rows))
    source = docs.select(F.col(key).alias("fetch_id"), F.col(body).alias("body")).where("body is not null")
    read = source.mapInArrow(_read(people), f"fetch_id {source.schema['fetch_id'].dataType.simpleString()}, turns {TURN}")
    return read.groupBy("fetch_id").agg(F.max("turns").alias("turns")).select("fetch_id", F.inline("turns"))
