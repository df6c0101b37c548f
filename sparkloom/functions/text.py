"""Scalar functions on text, as column expressions; Python only where a loop or a library is needed.

Null in, null out, unless a function says otherwise.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# What a line break, a citation, a claim id and a time look like in the evidence format.
LINE_BREAK = r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085  ]"
CITATION = r"S\d{2}-C\d{3}"
WIDE_CITATION = r"S\d{7}-C\d{3}"
TIMESTAMP = r"^\d{1,2}:\d{2}(:\d{2})?$"
VIDEO_HOSTS = {"youtube": ("youtube.com", "www.youtube.com", "m.youtube.com", "youtu.be"), "vimeo": ("vimeo.com", "www.vimeo.com", "player.vimeo.com")}
SUFFIXES = (".md", ".txt", ".docx", ".pdf")


def strip(c: Column) -> Column:
    """Without white space at either end, any kind of it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; none at either end."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def normal_lines(c: Column) -> Column:
    """Text with every line end a ``\\n``, as text files are read."""
    return F.regexp_replace(c, r"\r\n?", "\n")


def sha256_text(c: Column) -> Column:
    return F.sha2(c, 256)


def sha256_short(c: Column) -> Column:
    return F.substring(c, 1, 12)


def slugify(c: Column) -> Column:
    """Lower-case words joined by hyphens, at most 48 characters; ``source`` where nothing is left."""
    joined = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    slug = F.substring(F.regexp_replace(joined, "^-+|-+$", ""), 1, 48)
    return F.when(slug == "", F.lit("source")).otherwise(slug)


def lines(c: Column) -> Column:
    return F.split(c, LINE_BREAK)


def title_of(body: Column, fallback: Column) -> Column:
    """The first line starting ``# ``, or the fallback; an empty heading counts as a title."""
    heads = F.filter(lines(body), lambda x: x.startswith("# "))
    return F.when(F.size(heads) > 0, strip(F.substring(F.get(heads, F.lit(0)), 3, 1 << 30))).otherwise(fallback)


def tokens(c: Column) -> Column:
    """The set of runs of a-z and 0-9 in the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1))


def round3(c: Column) -> Column:
    """Half to even, at three places."""
    return F.bround(c, 3)


def locator_hint(locator: Column) -> Column:
    """`` @ time``, `` p. page`` or `` #anchor``, the first that is there; else empty."""
    return (
        F.when(F.coalesce(locator["timestamp"], F.lit("")) != "", F.concat(F.lit(" @ "), locator["timestamp"]))
        .when(F.coalesce(locator["page"], F.lit(0)) != 0, F.concat(F.lit(" p. "), locator["page"].cast("string")))
        .when(F.coalesce(locator["anchor"], F.lit("")) != "", F.concat(F.lit(" #"), locator["anchor"]))
        .otherwise("")
    )


def section_title(tag: Column) -> Column:
    """Words between hyphens, each capitalised, joined by blanks."""
    return F.array_join(F.transform(F.split(tag, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), " ")


def citations(c: Column, form: str = CITATION) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({form})"), 1)


def blocks(c: Column) -> Column:
    """Parts between blank lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(c, r"\n(?U)\s*\n"), strip), lambda b: b != "")


def is_prose(block: Column) -> Column:
    """Neither quote, comment, table nor heading; list items are prose."""
    return ~block.rlike(r"^(?U)\s*(>|<!--|\||#)")


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(strip(url), F.lit("HOST")))


def classify_target(target: Column, exists: Column | None = None) -> Column:
    """``youtube``, ``vimeo``, ``url`` or ``local`` (a path for which ``exists`` holds); anything else counts as ``url``."""
    host = host_of(target)
    web = target.rlike("(?i)^https?://")
    kind = F.when(web & host.isin(*VIDEO_HOSTS["youtube"]), "youtube").when(web & host.isin(*VIDEO_HOSTS["vimeo"]), "vimeo").when(web, "url")
    if exists is not None:
        kind = kind.when(F.coalesce(exists, F.lit(False)), "local")
    return kind.otherwise("url")


def youtube_id(url: Column) -> Column:
    """The video's id out of a short, watch, shorts, embed or live address, or null."""
    path = F.try_parse_url(url, F.lit("PATH"))
    short = F.filter(F.split(F.regexp_replace(path, "^/+|/+$", ""), "/"), lambda x: x != "")
    asked = F.try_parse_url(url, F.lit("QUERY"), F.lit("v"))
    named = F.regexp_extract(path, r"^/(?:shorts|embed|live)/([^/?#]+)", 1)
    return F.when(host_of(url) == "youtu.be", F.get(short, F.lit(0))).when(F.coalesce(asked, F.lit("")) != "", asked).otherwise(F.nullif(named, F.lit("")))


def vimeo_id(url: Column) -> Column:
    """The first part of the path that is all digits, or null."""
    parts = F.split(F.try_parse_url(url, F.lit("PATH")), "/")
    return F.get(F.filter(parts, lambda x: x.rlike(r"^\d+$")), F.lit(0))


def clock(seconds: Column) -> Column:
    """HH:MM:SS, cut to whole seconds; hours go beyond 99."""
    s = F.floor(seconds).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.floor(s / 3600).cast("long")
    hour = F.when(hours < 10, two(hours)).otherwise(hours.cast("string"))
    return F.concat_ws(":", hour, two(F.floor((s % 3600) / 60).cast("long")), two(s % 60))


def vtt_seconds(c: Column) -> Column:
    """``[hh:]mm:ss.mmm`` (or a comma) as seconds, null where it is no such time."""
    part = lambda i: F.regexp_extract(c, r"^(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{3})$", i)
    number = lambda i: F.coalesce(F.nullif(part(i), F.lit("")).cast("double"), F.lit(0.0))
    return F.when(part(2) != "", number(1) * 3600 + number(2) * 60 + number(3) + number(4) / 1000)


def utf8_length(c: Column) -> Column:
    return F.octet_length(c)


def is_timestamp(c: Column) -> Column:
    return c.rlike(TIMESTAMP)


def directive_action(c: Column) -> Column:
    """``stop``, ``automatic`` or ``guidance``."""
    low = F.lower(strip(c))
    return F.when(low.isin("stop", "stop now", "pause", "pause now"), "stop").when(low.contains("auto"), "automatic").otherwise("guidance")


# How a tool says that its context is full.
EXHAUSTED = ("context window", "context limit", "maximum context", "maximum prompt", "prompt token", "too many tokens", "context_length_exceeded")


def context_exhausted(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike("|".join(EXHAUSTED)), F.lit(False))


def is_material(overall: Column, concerns: Column) -> Column:
    """Whether a review bears on the result: below 75 overall, or a concern that names an artifact or claims."""
    return F.coalesce(overall < 75, F.lit(False)) | F.coalesce(F.exists(concerns, lambda c: (F.coalesce(c["artifact"], F.lit("")) != "") | (F.size(c["claim_ids"]) > 0)), F.lit(False))


@pandas_udf(StringType())
def strip_url(urls: pd.Series) -> pd.Series:
    """An address without the punctuation behind it; a closing bracket stays where it has its opening one."""

    def one(u: str | None) -> str | None:
        if u is None:
            return None
        end, opened, closed = len(u), u.count("("), u.count(")")
        while end and u[end - 1] in ")>,.;:]\"'":
            if u[end - 1] == ")":
                if opened >= closed:
                    break
                closed -= 1
            end -= 1
        return u[:end]

    return urls.map(one, na_action="ignore")


@pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """HTML entities as characters."""
    return texts.map(html.unescape, na_action="ignore")


@pandas_udf(StringType())
def decode_page(bodies: pd.Series, content_types: pd.Series) -> pd.Series:
    """Bytes as text: the header's charset, else one named in the first 2,048 bytes, else UTF-8; bad bytes become U+FFFD."""
    import re

    def one(body: bytes | None, kind: str | None) -> str | None:
        if body is None:
            return None
        head = re.search(r"charset=[\"']?([\w.-]+)", kind or "", re.IGNORECASE)
        sniffed = re.search(rb"charset=[\"']?([\w.-]+)", bytes(body[:2048]), re.IGNORECASE)
        for name in (head and head[1], sniffed and sniffed[1].decode("ascii")):
            if name:
                try:
                    return bytes(body).decode(name, errors="replace")
                except LookupError:
                    continue
        return bytes(body).decode("utf-8", errors="replace")

    return pd.Series([one(b, k) for b, k in zip(bodies, content_types)], dtype="object")
