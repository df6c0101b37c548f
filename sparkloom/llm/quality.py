"""Statistics of each document's text, and telling prose from lists, tables and junk (problem 9).

Method: gradient-boosted trees on the statistics. The trees learn from weak labels, which name what most of a text's characters
stand in (sentences, items, rows of fields, unreadable or merely repeated matter) and abstain where that is close. What the labels
are taken from, the shares of those kinds, is no statistic the trees see, so they have to find it out from counts of words, marks,
line shapes and repetition. The probabilities are calibrated on the hand-checked documents, which are set aside before training, at
any size of input. Training takes at most ``TRAIN_ROWS`` weakly labelled and calibration at most ``HOLDOUT_ROWS`` hand-checked
documents, those of the smallest hash, so any executor or rerun picks the same; the statistics and the decision cover every document
in full.

Defined results: null, empty and blank texts have no statistics (zeros) and no kind; every row counts as a document of its own,
so rows of one doc_id each come out; without hand-checked labels the probabilities stay as trained; where all documents
with a weak label are hand-checked the trees train on those and stay uncalibrated; without documents there is no result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.boosting import BoostedTrees
from sparkloom.plans.lineage import cut

TRAIN_ROWS = 6_000
HOLDOUT_ROWS = 6_000
KINDS = ("prose", "list", "table", "junk")
ROUNDS, SHARE = 60, 0.25  # each tree splits by a quarter of the statistics, so that none of several alike decides alone
MARGIN = 0.1
MOST_COMMON_WORDS = 100_000

MARKED = re.compile(r"\s*(?:[-*+•·–—▪◦‣]|\[[ xX]\]|\(?\d{1,4}[.):]|\(?[a-zA-Z][.)]|\(?[ivxIVX]{1,5}[.)]|#\d+)\s+\S")
RULE_ROW = re.compile(r"[\s|:+=-]*-[\s|:+=-]*$")
SPACED = re.compile(r"\S {2,}\S|\S {2,}$")
WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
ENCODED = re.compile(r"(?:%[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2}|&#x?[0-9A-Fa-f]+;|\\u[0-9A-Fa-f]{4})")
BROKEN = re.compile(r"[\ufffd¬¢€ÃÂ\x80-\x9f]|[^\W\d_][$^~|<>%=*+#?!]+[^\W\d_]")
MIXED = re.compile(r"[a-z][A-Z]")
PACKED = re.compile(r"\b[A-Za-z0-9+/]{32,}={0,2}")
ODD = frozenset("\ufffd¬¢€ÃÂ$^~|<>%=*+#") | frozenset(map(chr, range(0x80, 0xA0)))
VOWELS = frozenset("aeiouyäöüáéíóúàèùâêîôûœæëïAEIOUYÄÖÜÁÉÍÓÚÀÈÙÂÊÎÔÛ")
ENDS = frozenset(".!?…:\"”»")
SEPARATORS = "|\t;,"
CITED = re.compile(r"(?:\s*\[[^\[\]\s]{3,20}\])+\s*$")
NAMES = (
    "n_words mean_word n_lines mean_line ends_in_point common letters digits symbols blanks upper_inside vowels broken encoded long_words numbers "
    "distinct_words distinct_lines distinct_threes packed marked piped fielded short_lines in_marked in_fielded in_pointed in_wordy in_unknown"
).split()


def statistics(text: str, common: frozenset[str]) -> tuple[list[float], str | None]:
    """The numbers of NAMES for one text, and its weak label (None: too close to call)."""
    if not text or not text.strip():
        return [0.0] * len(NAMES), None
    lines = [x for x in text.splitlines() if x.strip()]
    n, n_lines = len(text), len(lines)
    lowered = [WORD.findall(x.lower()) for x in lines]
    known_of = [sum(map(common.__contains__, ws)) for ws in lowered]
    lower = list(chain.from_iterable(lowered))
    chars_of = Counter(text)
    letters = sum(c for x, c in chars_of.items() if x.isalpha())
    digits = sum(c for x, c in chars_of.items() if x.isdigit())
    blanks = sum(c for x, c in chars_of.items() if x.isspace())
    vowels = sum(c for x, c in chars_of.items() if x in VOWELS)
    hits, n_words = sum(known_of), len(lower)
    size = max(1, n - blanks)
    coded = ENCODED.search(text) is not None
    torn = (not ODD.isdisjoint(chars_of) or chars_of["?"] + chars_of["!"] > 0.01 * n) and BROKEN.search(text) is not None
    bulky = PACKED.search(text) is not None
    encoded = sum(map(len, ENCODED.findall(text))) if coded else 0
    broken_all = len(BROKEN.findall(text)) if torn else 0
    long_chars = sum(map(len, PACKED.findall(text))) if bulky else 0
    threes = set(zip(lower, lower[1:], lower[2:])) if len(lower) > 8 else ()
    separate = [tuple(x.count(c) for c in SEPARATORS) for x in lines]
    even = [0, 0, 0, 0]
    for k, c in enumerate(SEPARATORS):
        if c in chars_of:
            top, times = Counter(r[k] for r in separate if r[k]).most_common(1)[0]
            even[k] = top if times >= max(2, 0.6 * sum(1 for r in separate if r[k])) else 0
    aligned = [bool(SPACED.search(x.strip())) for x in lines] if "  " in text else [False] * n_lines
    spaced = sum(aligned) >= 3
    mass = dict.fromkeys(KINDS, 0.0)
    marked = piped = fielded = short = points = 0
    in_marked = in_fielded = in_pointed = in_wordy = in_unknown = 0  # characters in lines of a shape
    for line, found, known, (pipes, tabs, semis, commas), lined_up in zip(lines, lowered, known_of, separate, aligned):
        body = line.strip()
        if body[-1] == "]":
            body = CITED.sub("", body) or body
        k = len(found)
        ends = body[-1] in ENDS
        points += ends
        inked = sum(map(len, found))
        is_marked = bool(MARKED.match(line))
        marked += is_marked
        few = known < 0.15 * k or k == 0
        is_row = (
            (pipes >= 2 and even[0] == pipes)
            or (tabs and tabs == even[1])
            or (few and semis and semis == even[2])
            or (few and commas >= 2 and commas == even[3] and ", " not in body)
            or (few and spaced and lined_up)
        )
        piped += pipes >= 2
        fielded += bool(is_row)
        if is_row and (inked or RULE_ROW.match(body)):
            kind = "table"
        elif inked < 0.35 * len(body.replace(" ", "")) or torn and len(BROKEN.findall(body)) > 0.04 * len(body):
            kind = "junk"
        elif coded and sum(map(len, ENCODED.findall(body))) > 0.4 * len(body) or bulky and sum(map(len, PACKED.findall(body))) > 0.5 * len(body):
            kind = "junk"
        elif is_marked and not (body[0] in "–—" and k >= 10 and known >= 0.16 * k):
            kind = "list"
        elif k >= 4 and known >= 0.16 * k or body[0] == "#":
            kind = "prose"
        elif inked >= 8 and sum(c in VOWELS for c in body) < 0.2 * inked:
            kind = "junk"
        elif body.count(", ") >= 2 and few:
            kind = "list"
        elif k <= 9 and known < 0.3 * max(1, k) and body[-1] not in ".!?":
            kind, short = "list", short + 1
        else:
            kind = "prose"
        size_of = len(line)
        mass[kind] += size_of
        in_marked += size_of if is_marked else 0
        in_fielded += size_of if is_row else 0
        in_pointed += size_of if ends else 0
        in_wordy += size_of if k >= 8 else 0
        in_unknown += size_of if few else 0
    distinct_threes = len(threes) / max(1, len(lower) - 2) if len(lower) > 8 else 1.0
    packed = len(zlib.compress(text.encode("utf-8", "replace"), 1)) / max(1, len(text.encode("utf-8", "replace"))) if n > 60 else 0.8
    total = sum(mass.values()) or 1.0
    shares = {k: v / total for k, v in mass.items()}
    values = [
        n_words, sum(map(len, lower)) / max(1, n_words), n_lines, n / max(1, n_lines), points / max(1, n_lines), hits / max(1, n_words),
        letters / size, digits / size, (size - letters - digits) / size, blanks / n,
        sum(1 for w in WORD.findall(text) if len(w) > 3 and w[1:] != w[1:].lower() and w != w.upper()) / max(1, n_words) if MIXED.search(text) else 0.0,
        vowels / max(1, letters), broken_all / n, encoded / n, long_chars / size,
        sum(map(str.isdigit, lower)) / max(1, n_words), len(set(lower)) / max(1, n_words), len(set(lines)) / max(1, n_lines), distinct_threes, packed,
        marked / max(1, n_lines), piped / max(1, n_lines), fielded / max(1, n_lines), short / max(1, n_lines), *(x / total for x in (in_marked, in_fielded, in_pointed, in_wordy, in_unknown)),
    ]
    repeated = len(lower) > 20 and distinct_threes < 0.34
    if repeated or len(lower) < 2 and letters < 0.5 * size:
        label = "junk"
    else:
        first, second = sorted(shares.values(), reverse=True)[:2]
        label = max(shares, key=shares.get) if first - second >= MARGIN else None
    return [float(v) for v in values], label


def _measure(common: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [statistics(t, common) if t and t.strip() else (None, None) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([x for x, _ in out], pa.list_(pa.float32())), pa.array([y for _, y in out], pa.string())], names=["doc_id", "x", "weak"])

    return run


def _decide(model: BoostedTrees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            p = model.probabilities(np.array(b["x"].to_pylist(), dtype=float))
            kinds = [KINDS[k] for k in p.argmax(1)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(kinds), pa.array(p[:, 0])], names=["doc_id", "kind", "p_prose"])

    return run


def _word_list(common_words: DataFrame) -> frozenset[str]:
    """The frequent words, which travel with the plan; a list beyond MOST_COMMON_WORDS is an error, not a cut."""
    rows = common_words.select(F.lower("word")).where("word is not null").distinct().limit(MOST_COMMON_WORDS + 1).collect()
    if len(rows) > MOST_COMMON_WORDS:
        raise ValueError(f"more than {MOST_COMMON_WORDS} common words")
    return frozenset(r[0] for r in rows)


def document_statistics(docs: DataFrame, common_words: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and shares of each row's text, in the JVM throughout; ``key`` is unique. Null and blank texts have zeros.

    All common words count, however many; the join itself decides whether they are sent to every task.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    words = F.regexp_extract_all(body, F.lit(r"([\p{L}\p{N}]+)"), 1)
    lines = F.filter(F.split(body, "\r\n|\r|\n"), lambda x: ~x.rlike(r"^[ \t]*$"))
    one = rows.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.regexp_replace(body, r"[^\p{L}\p{N}]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(body, r"[\p{L}\p{N} \t\r\n]+", "")).cast("long").alias("symbol_chars"),
        F.length(body).cast("long").alias("n_chars"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(lines, lambda x: x.rlike(r"[.!?:;][ \t]*$"))).cast("long").alias("n_point_lines"),
    )
    frequent = common_words.select(F.lower("word").alias("word")).where("word is not null").distinct()
    hits = rows.select("doc_id", F.explode(words).alias("word")).select("doc_id", F.lower("word").alias("word")).join(frequent, "word").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_common"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return one.join(hits, "doc_id", "left").select(
        "doc_id", "n_words", "n_lines",
        share("word_chars", "n_words").alias("mean_word"), share("symbol_chars", "n_chars").alias("symbol_share"),
        share("n_point_lines", "n_lines").alias("point_line_share"), share("n_common", "n_words").alias("common_share"),
    )


def _bounded(rows: DataFrame, limit: int) -> list:
    """At most ``limit`` rows, those of the smallest hash of their id."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()


def document_kinds(docs: DataFrame, labels: DataFrame, common_words: DataFrame, *, key: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS, holdout_rows: int = HOLDOUT_ROWS) -> DataFrame:
    """(doc_id, kind, p_prose) of every document with a non-blank text."""
    common = _word_list(common_words)
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind_of_id = source.schema["doc_id"].dataType.simpleString()
    measured = cut(source.mapInArrow(_measure(common), f"doc_id {kind_of_id}, x array<float>, weak string").where("x is not null"))
    checked = labels.where(F.col("label").isin(*KINDS)).groupBy("doc_id").agg(F.min("label").alias("label"), F.countDistinct("label").alias("n")).where("n = 1").select("doc_id", "label")
    weakly = measured.where("weak is not null")
    hold = _bounded(measured.join(checked, "doc_id").select("doc_id", "x", "label"), holdout_rows)
    train = _bounded(weakly.join(checked, "doc_id", "left_anti"), train_rows)
    if not train:
        train, hold = _bounded(weakly, train_rows), []
    if not train:
        return measured.select("doc_id", F.lit("junk").alias("kind"), F.lit(0.0).alias("p_prose"))
    model = BoostedTrees(rounds=ROUNDS, share=SHARE).fit(np.array([r["x"] for r in train], dtype=float), np.array([KINDS.index(r["weak"]) for r in train]), len(KINDS))
    if hold:
        model.calibrate(np.array([r["x"] for r in hold], dtype=float), np.array([KINDS.index(r["label"]) for r in hold]))
    return measured.select("doc_id", "x").mapInArrow(_decide(model), f"doc_id {kind_of_id}, kind string, p_prose double")
