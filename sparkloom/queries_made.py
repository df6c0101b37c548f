"""Queries over inputs that are made of the driver's tables within the query, so that every outcome of an operator occurs.

Masters are written of each source's claims, links and captions of events and claims. The SQL twins make the same inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import queries as core
from sparkloom.functions import text
from sparkloom.operators import audit, intake, links, pages, reconcile, similarity, synthesis, validate
from sparkloom.plans.lineage import table
from sparkloom.queries import query
from sparkloom.sources import files
from sparkloom.streaming import control

WIDE = text.WIDE_CITATION

# --- masters: a document a source, of what its claims say ---------------------------------------------------------------------

MASTERS_SQL = r"""
mc as (select claim_id, min(source_id) source_id, min(claim_text) t, min(topic_tags[1]) tag, min(depends_on[1]) ref from claims where claim_id is not null and source_id is not null group by 1),
mk as (select distinct unnest(claim_ids) claim_id from reconciliation where decision = 'CONFLICT'),
mj as (select mc.*, mk.claim_id is not null conf, right(mc.claim_id, 1) n, right(source_id, 1) s, chr(10) || chr(10) nn from mc left join mk using (claim_id)),
md as (select source_id doc_id, '# ' || source_id || any_value(nn) || case when s in ('1', '4') then 'Opening words on ' || min(claim_id) || '.' || any_value(nn) else '' end
  || string_agg('## ' || coalesce(tag, 'misc') || nn || coalesce(t, '') || case when n = '3' then '' else ' [' || claim_id || ']' || coalesce(' after ' || ref, '') end || nn, '' order by claim_id)
  || case when s = '5' then '> [!todo] write' || any_value(nn) else '' end
  || case when s = '6' then '' else '## Conflicts' || any_value(nn) || coalesce(string_agg(case when conf and n <> '2' then claim_id || ' disagrees.' || nn end, '' order by claim_id), '') end
  || case when s = '7' then '' else '## Gaps' || any_value(nn) || case when s in ('0', '2') then 'None known.' || any_value(nn) else '' end end
  || case when s = '8' then '' else '## Appendix: Source Register' || any_value(nn) || min(claim_id) || any_value(nn) end "text"
  from mj group by source_id, s),
""" + core.SECTIONS_SQL.replace("documents", "md")
CITED_SQL = rf"""{MASTERS_SQL},
c as (select doc_id, section_no, heading, unnest(list_distinct(regexp_extract_all(content, 'S\d{{7}}-C\d{{3}}'))) claim_id from s where heading <> 'Appendix: Source Register'),
f as (select doc_id, claim_id, arg_min(heading, section_no) h from c group by 1, 2)
"""


def _masters(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "claims").where("claim_id is not null and source_id is not null")
    one = claims.groupBy("claim_id").agg(F.min("source_id").alias("source_id"), F.min("claim_text").alias("t"), F.min(F.get("topic_tags", F.lit(0))).alias("tag"), F.min(F.get("depends_on", F.lit(0))).alias("ref"))
    named = table(spark, d, "reconciliation").where("decision = 'CONFLICT'").select(F.explode("claim_ids").alias("claim_id")).distinct().withColumn("conf", F.lit(True))
    gap, n, s = F.lit("\n\n"), F.substring("claim_id", -1, 1), F.substring("source_id", -1, 1)
    cite = F.when(n == "3", "").otherwise(F.concat(F.lit(" ["), "claim_id", F.lit("]"), F.coalesce(F.concat(F.lit(" after "), "ref"), F.lit(""))))
    part = F.concat(F.lit("## "), F.coalesce("tag", F.lit("misc")), gap, F.coalesce("t", F.lit("")), cite, gap).alias("part")
    conflict = F.when(F.coalesce("conf", F.lit(False)) & (n != "2"), F.concat("claim_id", F.lit(" disagrees."), gap)).alias("conflict")
    # a source has some dozen claims
    docs = one.join(named, "claim_id", "left").select("source_id", "claim_id", part, conflict).groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("claim_id", "part", "conflict"))).alias("c"))
    first, joined = F.get("c", F.lit(0))["claim_id"], lambda f: F.array_join(F.transform("c", lambda x: x[f]), "")
    unless = lambda digits, *what: F.when(s.isin(*digits), "").otherwise(F.concat(*what))
    whole = F.concat(
        F.lit("# "), "source_id", gap, F.when(s.isin("1", "4"), F.concat(F.lit("Opening words on "), first, F.lit("."), gap)).otherwise(""), joined("part"), F.when(s == "5", F.concat(F.lit("> [!todo] write"), gap)).otherwise(""),
        unless("6", F.lit("## Conflicts"), gap, joined("conflict")), unless("7", F.lit("## Gaps"), gap, F.when(s.isin("0", "2"), F.concat(F.lit("None known."), gap)).otherwise("")), unless("8", F.lit("## Appendix: Source Register"), gap, first, gap))
    return docs.select(F.col("source_id").alias("doc_id"), whole.alias("text"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return synthesis.sections(_masters(spark, d), "doc_id", "text")


@query(f"with {CITED_SQL} select doc_id, claim_id, case when h = '' then 'preamble' else h end location from f")
def master_citations(spark: SparkSession, d: str) -> DataFrame:
    return synthesis.first_citations(_parts(spark, d), "doc_id", WIDE)


@query(f"with {CITED_SQL} select doc_id, claim_id from f where claim_id not in (select claim_id from claims where claim_id is not null)")
def phantom_citations(spark: SparkSession, d: str) -> DataFrame:
    return synthesis.phantom_citations(_parts(spark, d), "doc_id", table(spark, d, "claims"), WIDE)


@query(f"with {CITED_SQL}, {core.WINNERS_SQL} select claim_id, group_id from w where claim_id not in (select claim_id from f)")
def uncited_winners(spark: SparkSession, d: str) -> DataFrame:
    return synthesis.uncited_winners(_parts(spark, d), "doc_id", reconcile.winners(table(spark, d, "reconciliation")), WIDE)


@query(rf"""
with {MASTERS_SQL},
kc as (select distinct group_id, claim_id from (select group_id, unnest(claim_ids) claim_id from reconciliation where decision = 'CONFLICT') where claim_id is not null),
x as (select distinct unnest(regexp_extract_all(content, 'S\d{{7}}-C\d{{3}}')) claim_id from s where heading = 'Conflicts')
select group_id, claim_id from kc where claim_id not in (select claim_id from x)
""")
def absent_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return synthesis.absent_conflicts(_parts(spark, d), "doc_id", table(spark, d, "reconciliation"), WIDE)


@query(rf"""
with {MASTERS_SQL},
b as (select doc_id, section_no, heading, list_filter(list_transform(regexp_split_to_array(content, '\n[\s\x0b\x{{85}}\p{{Z}}]*\n'), lambda x: regexp_replace(x, '^[\s\x0b\x{{85}}\p{{Z}}]+|[\s\x0b\x{{85}}\p{{Z}}]+$', '', 'g')), lambda x: x <> '' and not regexp_matches(x, '^(>|<!--|\||#)')) p
  from s where heading not in ('', 'Conflicts', 'Gaps', 'Appendix: Source Register')),
n as (select doc_id, section_no::int section_no, heading, len(p) n_prose, len(list_filter(p, lambda x: not regexp_matches(x, 'S\d{{7}}-C\d{{3}}'))) n_unmarked from b)
select * from n where n_prose = 0 or n_unmarked > 0
""")
def prose_without_markers(spark: SparkSession, d: str) -> DataFrame:
    return synthesis.prose_faults(_parts(spark, d), "doc_id", WIDE)


@query(rf"""
with {MASTERS_SQL}, h as (select doc_id, list(heading) hs, arg_min(content, section_no) filter (heading = 'Gaps') gaps from s group by 1),
r as (select doc_id, unnest([case when contains("text", '[!todo]') then 'operator todo callouts remain in MASTER.md' end,
  case when not list_contains(hs, 'Conflicts') then 'mandatory section ''Conflicts'' missing' end, case when not list_contains(hs, 'Gaps') then 'mandatory section ''Gaps'' missing' end,
  case when not list_contains(hs, 'Appendix: Source Register') then 'mandatory section ''Appendix: Source Register'' missing' end,
  case when not regexp_matches(coalesce(gaps, ''), '\S') then 'Gaps section is empty' end]) reason from md join h using (doc_id))
select * from r where reason is not null
""")
def master_faults(spark: SparkSession, d: str) -> DataFrame:
    return synthesis.master_faults(_masters(spark, d), "doc_id", "text").select("doc_id", "reason")


MATRIX_SQL = f"""with {CITED_SQL},
loc as (select claim_id, arg_min(case when h = '' then 'preamble' else h end, doc_id) "location" from f group by 1),
d as (select claim_id, arg_max({{'g': group_id, 'd': decision, 'w': winner}}, {{'a': recorded_at, 'b': group_id, 'c': coalesce(decision, ''), 'e': coalesce(winner, '')}}) x
  from (select *, unnest(claim_ids) claim_id from reconciliation where group_id is not null) where claim_id is not null group by 1),
m as (select source_id, claim_id, case when x is null then 'UNDECIDED' else coalesce(x.d, 'None') end decision, coalesce(x.g, '') group_id, coalesce("location", '') "location", x.w w, "location" is not null cited
  from (select distinct source_id, claim_id from claims where claim_id is not null) left join d using (claim_id) left join loc using (claim_id)),
t as (select source_id, claim_id, decision, group_id, "location", case when decision = 'SUPERSEDED' and w is distinct from claim_id then 'superseded by ' || coalesce(w, 'None')
  when decision = 'OUT_OF_SCOPE' then 'excluded' when decision = 'CONFLICT' then 'logged in Conflicts' when cited then 'cited' else 'NOT CITED' end status from m)
"""


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    places = synthesis.first_citations(_parts(spark, d), "doc_id", WIDE).groupBy("claim_id").agg(F.min_by("location", "doc_id").alias("location"))
    return audit.trace_matrix(table(spark, d, "claims"), table(spark, d, "reconciliation"), places)


@query(MATRIX_SQL + "select * from t")
def trace_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d)


@query(MATRIX_SQL + "select source_id, count(*) filter (decision <> 'UNDECIDED') accounted, count(*) extracted, count(*) filter (decision <> 'UNDECIDED') || '/' || count(*) coverage from t group by 1")
def coverage_by_source(spark: SparkSession, d: str) -> DataFrame:
    return audit.coverage(_matrix(spark, d))


# --- sources and claims -------------------------------------------------------------------------------------------------------

@query("""
with n as (select s.source_id, count(distinct claim_id) n_claims from (select distinct source_id from sources) s left join claims c using (source_id) group by 1)
select source_id, max(strlen(coalesce("_body", ''))) n_bytes, any_value(n_claims) n_claims from sources join n using (source_id) group by 1 having max(strlen(coalesce("_body", ''))) > 400 and any_value(n_claims) < 12
""")
def thin_sources(spark: SparkSession, d: str) -> DataFrame:
    """With bounds that fit these tables, whose sources have more claims and shorter bodies than the default expects."""
    return reconcile.thin_sources(table(spark, d, "sources"), table(spark, d, "claims"), 400, 12)


@query("select count(*) n_sources, count(*) filter (schema_version is null) n_first_schema from (select distinct source_id, schema_version from sources)")
def first_schema_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").select("source_id", "schema_version").distinct().agg(F.count(F.lit(1)).alias("n_sources"), F.count_if(F.col("schema_version").isNull()).alias("n_first_schema"))


@query("select source_id, 'N' || case when length(n::varchar) < 3 then lpad(n::varchar, 3, '0') else n::varchar end new_id, n from (select source_id, row_number() over (order by source_id) + 97 n from (select distinct source_id from sources))")
def new_source_ids(spark: SparkSession, d: str) -> DataFrame:
    """Sources numbered anew, from 98 on, so the width grows on the way."""
    return intake.number_new(table(spark, d, "sources").select("source_id").distinct(), "source_id", 98, "N", 3).select("source_id", "new_id", F.col("n").cast("long").alias("n"))


@query(f"""
select 'P' || case when n < 1000 then lpad(n::varchar, 3, '0') else n::varchar end candidate_id, claim_id_a, claim_id_b from (select *, row_number() over (order by claim_id_a, claim_id_b) n from ({core.SQL['candidate_pairs']}))
""")
def candidate_numbers(spark: SparkSession, d: str) -> DataFrame:
    return similarity.numbered(similarity.candidate_pairs(table(spark, d, "claims")).select("claim_id_a", "claim_id_b"))


@query(core.SQL["claim_problems"])
def claim_problems_of_lines(spark: SparkSession, d: str) -> DataFrame:
    """Claims written as JSON lines, comments and blank lines between them, read back and validated: what the table's rows lack."""
    claims = table(spark, d, "claims").drop("project_id", "recorded_at", "deleted_at")
    # an absent locator is no key, and so are its absent parts; all other keys stand even where they are null
    always = F.to_json(F.struct(*(c for c in claims.columns if c != "source_locator")), {"ignoreNullFields": "false"})
    locator = F.to_json("source_locator", {"ignoreNullFields": "true"})
    raw = F.when(F.col("source_locator").isNull(), always).otherwise(F.concat(F.regexp_replace(always, r"\}$", ""), F.lit(', "source_locator": '), locator, F.lit("}")))
    texts = claims.select(F.concat_ws("/", "source_id", F.coalesce("claim_id", F.lit("none"))).alias("file"), F.concat(F.lit("# claims\n\n"), raw, F.lit("\n")).alias("text"))
    lines = files.lenient(files.json_lines(texts)).withColumn("claim_id", F.try_variant_get("v", "$.claim_id", "string")).withColumn("source", F.try_variant_get("v", "$.source_id", "string"))
    faults = validate.claim_faults(validate.JsonRecord(), F.col("source"), validate.WIDE)
    return validate.faulty(lines, faults, "claim_id").groupBy("claim_id", "problem").agg(F.count(F.lit(1)).alias("n_rows"))


# --- scalars over events ------------------------------------------------------------------------------------------------------

def _by(n: Column, *choices: Column | str | None) -> Column:
    """The choice that ``n`` modulo their number names."""
    out = F.lit(None)
    for i, c in reversed(list(enumerate(choices))):
        out = F.when(n % len(choices) == i, c if isinstance(c, Column) else F.lit(c)).otherwise(out)
    return out


@query("""
select event_id, case when event_id % 8 < 5 then 'v' || event_id end youtube, case when event_id % 8 = 6 then event_id::varchar end vimeo, case when event_id % 8 < 6 then 'youtube' else 'vimeo' end kind from events
""")
def video_ids(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    v = F.concat(F.lit("v"), n.cast("string"))
    forms = ("https://youtu.be/{}?t=3", "https://www.youtube.com/watch?x=1&v={}", "https://m.youtube.com/shorts/{}/more", "https://youtube.com/embed/{}", "https://www.youtube.com/live/{}?x", "https://www.youtube.com/channel/{}")
    url = _by(n, *(F.concat(F.lit(f.split("{}")[0]), v, F.lit(f.split("{}")[1])) for f in forms), F.concat(F.lit("https://vimeo.com/channels/staff/"), n.cast("string")), "https://player.vimeo.com/about")
    e = table(spark, d, "events").select("event_id", url.alias("url")).withColumn("kind", text.classify_target(F.col("url")))
    return e.select("event_id", F.when(F.col("kind") == "youtube", text.youtube_id(F.col("url"))).alias("youtube"), F.when(F.col("kind") == "vimeo", text.vimeo_id(F.col("url"))).alias("vimeo"), "kind")


@query("""
with e as (select event_id, floor("value" * 1000)::bigint s, event_id % 60 a, event_id % 7 b, event_id % 1000 ms from events)
select event_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) clock,
  round(case event_id % 3 when 0 then b * 3600 + a * 60 + b + ms / 1000.0 when 1 then a * 60 + b + ms / 1000.0 end, 3)::double "seconds" from e
""")
def clock_times(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    two, ms = lambda c: F.lpad(c.cast("string"), 2, "0"), F.lpad((n % 1000).cast("string"), 3, "0")
    short = F.concat(two(n % 60), F.lit(":"), two(n % 7))
    written = _by(n, F.concat((n % 7).cast("string"), F.lit(":"), short, F.lit(","), ms), F.concat(short, F.lit("."), ms), F.concat(short, F.lit(" and "), ms))
    return table(spark, d, "events").select("event_id", text.clock(F.floor(F.col("value") * 1000)).alias("clock"), F.round(text.vtt_seconds(written), 3).alias("seconds"))


@query(r"""
select distinct source_id, sha256(regexp_replace(regexp_replace("_body", '[\t-\r \x{85}\p{Z}]+', ' ', 'g'), '^ | $', '', 'g')) collapsed, sha256("_body") unescaped from sources where "_body" is not null
""")
def plain_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Bodies with their white space collapsed; and written with entities of every kind and read back."""
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("_body", "&", "&amp;"), "<", "&lt;"), "e", "&#101;"), "s", "&#x73;")
    rows = table(spark, d, "sources").where("_body is not null").select("source_id", "_body", body.alias("coded")).distinct()
    return rows.select("source_id", F.sha2(text.collapse(F.col("_body")), 256).alias("collapsed"), F.sha2(text.unescape(F.col("coded")), 256).alias("unescaped"))


@query("""
select event_id, event_id % 9 < 7 exhausted, "value" / 4 < 75 or event_id % 4 in (1, 2) material from events
""")
def review_signals(spark: SparkSession, d: str) -> DataFrame:
    """What a tool says when its context is full, and which reviews bear on the result."""
    n = F.col("event_id")
    said = _by(n, *(F.concat(F.lit("Error: "), F.upper(F.lit(x)), F.lit(" reached")) for x in text.EXHAUSTED), "all well", None)
    concern = lambda artifact, *ids: F.array(F.struct(F.lit(artifact).cast("string").alias("artifact"), F.array(*map(F.lit, ids)).cast("array<string>").alias("claim_ids")))
    concerns = _by(n, concern(None), concern("MASTER.md"), concern("", "S01-C001"), concern(""))
    return table(spark, d, "events").select("event_id", text.context_exhausted(said).alias("exhausted"), text.is_material(F.col("value") / 4, concerns).alias("material"))


@query("""
with e as (select event_id, user_id, "value", case event_type when 'view' then '  Stop now ' when 'signup' then 'Run automatically please' when 'click' then 'look at ' || event_id when 'error' then ' ' else 'PAUSE' end t from events)
select event_id::varchar id, user_id::varchar "session", t directive, case when lower(trim(t)) in ('stop', 'stop now', 'pause', 'pause now') then 'stop' when contains(lower(t), 'auto') then 'automatic' else 'guidance' end "action"
from e where trim(t) <> '' and user_id % 3 <> 0 and "value" <= 300
""")
def control_consumed(spark: SparkSession, d: str) -> DataFrame:
    """Events as directives of their users' sessions: a third of them finished, some lines of another kind, clicks queued twice."""
    e = table(spark, d, "events")
    kind = F.col("event_type")
    said = F.when(kind == "view", "  Stop now ").when(kind == "signup", "Run automatically please").when(kind == "click", F.concat(F.lit("look at "), F.col("event_id").cast("string"))).when(kind == "error", " ").otherwise("PAUSE")
    events = e.select(F.col("event_id").cast("string").alias("id"), F.when(F.col("value") <= 300, control.DIRECTIVE).otherwise(control.QUEUED).alias("event"), F.col("user_id").cast("string").alias("session"), said.alias("directive"), "event_type")
    sessions = e.select("user_id").distinct().select(F.col("user_id").cast("string").alias("session"), F.when(F.col("user_id") % 3 == 0, "finished").otherwise("active").alias("status"))
    return control.consume(events.unionByName(events.where("event_type = 'click'")), sessions)


# --- links and captions -------------------------------------------------------------------------------------------------------

@query("""
with s as (select distinct source_id from sources), f as (select '/docs/' || source_id || '.md' path from s where right(source_id, 1) < '6')
select source_id, '/docs/' || source_id || '.md' raw, 1 pos, 'local' kind from s where '/docs/' || source_id || '.md' in (select path from f)
union all select source_id, 'https://h.example/' || source_id, 0, 'url' from s
""")
def local_targets(spark: SparkSession, d: str) -> DataFrame:
    """A note a source, naming a file beside it, of which six in ten exist, an address, and one between backticks."""
    s = table(spark, d, "sources").select("source_id").distinct()
    body = F.concat(F.lit("See https://h.example/"), "source_id", F.lit(", [its file]("), "source_id", F.lit(".md) or `"), F.lit("/docs/"), "source_id", F.lit(".md`, not `https://hidden.example` nor [x](none.exe)"))
    notes = s.select("source_id", body.alias("body"), F.lit("/docs/index.md").alias("origin"))
    there = s.where(F.substring("source_id", -1, 1) < "6").select(F.concat(F.lit("/docs/"), "source_id", F.lit(".md")).alias("path"))
    return links.discover(notes, "source_id", "body", "origin", there).select("source_id", "raw", "pos", "kind")


@query(f"with {core.RESOLVE_SQL} select target, outcome from o where contains(target, 'a')")
def resolve_only(spark: SparkSession, d: str) -> DataFrame:
    """Resolving only the targets that contain a word, in any case; none of these bodies has its original outside of them."""
    docs, sources = table(spark, d, "fetched_docs").where("url is not null"), table(spark, d, "sources")
    return core.outcomes(docs, sources, only="A").select("target", "outcome")


CAPTIONS_SQL = r"""
with c as (select claim_id, min(claim_text) t from claims where claim_id is not null group by 1 having min(claim_text) is not null and regexp_matches(min(claim_text), '\S')),
q as (select claim_id, regexp_replace(regexp_replace(t, '[\t-\r \x{85}\p{Z}]+', ' ', 'g'), '^ | $', '', 'g') t, right(claim_id, 2)::int n from c)
select claim_id, unnest([n + 0.5, n + 3.5, n + 14])::double "start", unnest([0, 0, case when n % 2 = 0 then 1 else 0 end])::bigint para,
  unnest([printf('[00:%02d:%02d] ', n // 60, n % 60) || t || ' & more', printf('[00:%02d:%02d] ', (n + 3) // 60, (n + 3) % 60) || 'two lines', printf('[00:%02d:%02d] ', (n + 14) // 60, (n + 14) % 60) || 'end']) line from q
"""


def _cue_texts(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "claims").where("claim_id is not null").groupBy("claim_id").agg(F.min("claim_text").alias("t")).where("t is not null").withColumn("t", text.collapse(F.col("t"))).where("t <> ''")
    return one.withColumn("n", F.expr("try_cast(substring(claim_id, -2, 2) as int)"))


def _escaped(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;")


@query(CAPTIONS_SQL)
def caption_parse(spark: SparkSession, d: str) -> DataFrame:
    """A claim a WebVTT file: notes, styles, cue ids, tags, entities, two lines of text, a blank cue, and a gap for even numbers."""
    n = F.col("n")
    at = lambda s, ms, sep=".": F.concat(F.format_string("%02d:%02d", F.floor((n + s) / 60).cast("int"), ((n + s) % 60).cast("int")), F.lit(f"{sep}{ms}"))
    stop = F.when(n % 2 == 0, at(4, "500")).otherwise(at(7, "000"))
    vtt = F.concat(
        F.lit("WEBVTT - made\n\nNOTE of no use\n00:01.000 --> 00:02.000\n\nSTYLE\n::cue {}\n\n1\n"), at(0, "500"), F.lit(" --> "), at(3, "000"), F.lit(" align:start\n<v Someone><b>"), _escaped(F.col("t")), F.lit("</b> &amp; more\n\n00:"),
        at(3, "500", ","), F.lit(" --> 00:"), stop, F.lit("\ntwo\n  lines\n\n"), at(14, "000"), F.lit(" --> "), at(14, "200"), F.lit("\nend\n"))
    cues = _cue_texts(spark, d).select("claim_id", F.inline(pages.parse_vtt(vtt)))
    return pages.paragraphs(cues, "claim_id")


@query(r"""
with c as (select claim_id, min(claim_text) t from claims where claim_id is not null group by 1 having min(claim_text) is not null and regexp_matches(min(claim_text), '\S')),
q as (select claim_id, regexp_replace(regexp_replace(t, '[\t-\r \x{85}\p{Z}]+', ' ', 'g'), '^ | $', '', 'g') t, right(claim_id, 2)::int n from c)
select claim_id, unnest([0, 1])::int n, unnest([n + 0.5, n + 2])::double "start", unnest([n + 2.0, n + 2])::double stop, unnest([t || ' & <b>', 'end']) "text" from q where n % 7 <> 0
""")
def timed_text(spark: SparkSession, d: str) -> DataFrame:
    """A claim a file of timed text, written with entities twice over; of numbers that seven divides the file is torn and has no cues."""
    twice = _escaped(_escaped(F.concat("t", F.lit(" & <b>"))))
    body = F.concat(F.lit('<transcript><text start="'), (F.col("n") + 0.5).cast("string"), F.lit('" dur="1.5">'), twice, F.lit('</text><text start="'), (F.col("n") + 2).cast("string"), F.lit('">end</text>'), F.when(F.col("n") % 7 == 0, "").otherwise("</transcript>"))
    rows = _cue_texts(spark, d).select("claim_id", F.inline(pages.parse_timedtext(body)).alias("n", "start", "stop", "text"))
    return rows


@query("""
select event_id, case event_id % 4 when 0 then 'EN-gb' when 1 then 'de' when 2 then 'en' end track from events
""")
def caption_tracks(spark: SparkSession, d: str) -> DataFrame:
    lists = _by(F.col("event_id"), *(F.array(*map(F.lit, x)).cast("array<string>") for x in (("de", "EN-gb", "en"), ("de", "fr"), ("en",), ())))
    return table(spark, d, "events").select("event_id", pages.chosen_track(lists).alias("track"))
