"""The core's queries over the driver's tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.operators import audit, intake, links, orphans, pages, reconcile, similarity, synthesis, validate
from sparkloom.plans.lineage import cut, table
from sparkloom.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# --- problem 3: references to records that do not exist -----------------------------------------------------------------

ORPHANS_SQL = """
with r as (
  select 'claims' parent, 'claims' ref_table, claim_id ref_key, recorded_at t, unnest(depends_on) raw from claims
  union all select 'claims', 'reconciliation', group_id, recorded_at, unnest(claim_ids) from reconciliation
  union all select 'sources', 'sources', source_id, recorded_at, resolved_from from sources
), c as (
  select parent, ref_table, ref_key, upper(regexp_replace(raw, '^\\s+|\\s+$', '', 'g')) target_id, min(t) t from r
  where regexp_replace(raw, '^\\s+|\\s+$', '', 'g') <> '' group by 1, 2, 3, 4
), p as (
  select 'claims' parent, claim_id id, count(deleted_at) gone, min(recorded_at) born from claims group by 2
  union all select 'sources', source_id, count(deleted_at), min(recorded_at) from sources group by 2
), f as (
  select ref_table, strftime(t, '%Y-%m') ref_month, ref_key, target_id,
    case when id is null then 'missing' when gone > 0 then 'deleted' when born > t then 'late' end reason
  from c left join p on p.parent = c.parent and p.id = c.target_id
)
"""


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    claims, sources, groups = (table(spark, d, t) for t in ("claims", "sources", "reconciliation"))
    return orphans.find_orphans(
        [
            orphans.Reference("claims", claims, "claim_id", "depends_on", "claims"),
            orphans.Reference("reconciliation", groups, "group_id", "claim_ids", "claims"),
            orphans.Reference("sources", sources, "source_id", "resolved_from", "sources"),
        ],
        [orphans.Parent("claims", claims, "claim_id"), orphans.Parent("sources", sources, "source_id")],
    )


@query(ORPHANS_SQL + "select * from f where reason is not null")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


@query(ORPHANS_SQL + "select ref_table, ref_month, reason, count(*) n_references, count(distinct target_id) n_targets from f where reason is not null group by 1, 2, 3")
def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


# --- sources ---------------------------------------------------------------------------------------------------------------

REGISTER_SQL = """
select source_id, title, coalesce(source_type, 'report') source_type, url, authority_tier, date_authored, substr(sha256, 1, 12) sha256_short
from (select *, row_number() over (partition by source_id order by recorded_at, coalesce(schema_version::varchar, ''), coalesce(url, ''), coalesce(title, ''), coalesce(sha256, '')) rn from sources)
where rn = 1
"""


@query(REGISTER_SQL)
def source_register(spark: SparkSession, d: str) -> DataFrame:
    return intake.register(table(spark, d, "sources"))


@query("""
with h as (select distinct source_id, sha256("_body") sha256 from sources where "_body" is not null),
f as (select sha256, min(source_id) first_source_id from h group by 1)
select source_id, first_source_id, sha256 from h join f using (sha256) where source_id <> first_source_id
""")
def duplicate_sources(spark: SparkSession, d: str) -> DataFrame:
    return intake.duplicate_bodies(table(spark, d, "sources"))


@query("""select distinct source_id from sources where sha256(coalesce("_body", '')) is distinct from sha256""")
def hash_drift(spark: SparkSession, d: str) -> DataFrame:
    return intake.drifted(table(spark, d, "sources"))


@query("""
select source_id, coalesce(title, '') title, case when s = '' then 'source' else s end slug from (
  select distinct source_id, title, substr(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) s from sources)
""")
def slug_titles(spark: SparkSession, d: str) -> DataFrame:
    title = F.coalesce(F.col("title"), F.lit(""))
    return table(spark, d, "sources").select("source_id", title.alias("title"), text.slugify(title).alias("slug")).distinct()


@query("""
with l as (select distinct source_id, title, list_filter(regexp_split_to_array("_body", '\\r\\n|[\\n\\r]'), lambda x: starts_with(x, '# ')) h from sources where "_body" is not null)
select distinct source_id, case when len(h) > 0 then regexp_replace(substr(h[1], 3), '^\\s+|\\s+$', '', 'g') else title end body_title from l
""")
def body_titles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sources").where("_body is not null")
    return rows.select("source_id", text.title_of(F.col("_body"), F.col("title")).alias("body_title")).distinct()


@query("""
select source_id, strlen(coalesce("_body", '')) n_bytes, length(coalesce("_body", '')) n_chars, count(*) n_rows from sources group by 1, 2, 3
""")
def body_sizes(spark: SparkSession, d: str) -> DataFrame:
    body = F.coalesce(F.col("_body"), F.lit(""))
    rows = table(spark, d, "sources").select("source_id", text.utf8_length(body).cast("long").alias("n_bytes"), F.length(body).cast("long").alias("n_chars"))
    return rows.groupBy("source_id", "n_bytes", "n_chars").agg(F.count(F.lit(1)).alias("n_rows"))


@query("select coalesce(max(try_cast(regexp_extract(source_id, '^S(\\d+)', 1) as bigint)), 0) + 1 next_number from sources")
def next_source_number(spark: SparkSession, d: str) -> DataFrame:
    return intake.next_number(table(spark, d, "sources"), "source_id", "S")


@query("""
select distinct source_id, coalesce(schema_version, 2) schema_version,
  case when schema_version is null then case when lower(origin) like '%.pdf' then 'pdf' else 'report' end else source_type end source_type,
  case when schema_version is not null then url end url, case when schema_version is not null then resolved_from end resolved_from,
  case when schema_version is null then 'upgraded' else 'unchanged' end "action"
from sources
""")
def migrate_v2(spark: SparkSession, d: str) -> DataFrame:
    return intake.migrate(table(spark, d, "sources")).distinct()


TIERS = "('primary', 'secondary', 'tertiary', 'unknown')"
TYPES = "('report', 'html-article', 'pdf', 'video-transcript', 'webinar', 'study-notes', 'dataset', 'notes', 'other')"
SOURCE_PROBLEMS_SQL = (
    "with k as (select distinct source_id from sources), s as (select s.*, k.source_id is not null parent_known from sources s left join k on k.source_id = s.resolved_from), p as (select source_id, project_id, unnest(list_filter(["
    "case when schema_version <> 2 then 'unsupported schema_version ' || schema_version end, "
    + ", ".join(f"case when coalesce({c}::varchar, '') = '' then 'missing frontmatter field {c}' end" for c in validate.SOURCE_FIELDS)
    + f""", case when schema_version = 2 and coalesce(source_type, '') = '' then 'missing frontmatter field source_type' end,
  case when coalesce(authority_tier, '') <> '' and authority_tier not in {TIERS} then 'invalid authority_tier ''' || authority_tier || '''' end,
  case when schema_version = 2 and coalesce(source_type, '') <> '' and source_type not in {TYPES} then 'invalid source_type ''' || source_type || '''' end,
  case when schema_version = 2 and not regexp_matches(resolved_from, '^S\\d{{7}}$') then 'invalid resolved_from ''' || resolved_from || '''' end,
  case when schema_version = 2 and regexp_matches(resolved_from, '^S\\d{{7}}$') and not parent_known then 'resolved_from references unknown source ' || resolved_from end,
  case when schema_version = 2 and transcript_status not in ('fetched', 'pending') then 'invalid transcript_status ''' || transcript_status || '''' end,
  case when schema_version = 2 and transcript_status is not null and source_type is distinct from 'video-transcript' then 'transcript_status only allowed for video-transcript sources' end,
  case when sha256(coalesce("_body", '')) is distinct from sha256 then 'sha256 does not match body content' end
  ], lambda x: x is not null)) problem from s)
"""
)


def _source_problems(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "sources")
    parents = sources.select(F.col("source_id").alias("resolved_from")).distinct().withColumn("_known", F.lit(True))
    joined = sources.join(parents, "resolved_from", "left")
    faults = validate.source_faults(validate.TableRecord(sources), F.coalesce(F.col("_known"), F.lit(False)), validate.WIDE)
    return validate.faulty(joined, faults, "project_id", "source_id")


@query(SOURCE_PROBLEMS_SQL + "select source_id, problem, count(*) n_rows from p group by 1, 2")
def source_problems(spark: SparkSession, d: str) -> DataFrame:
    return _source_problems(spark, d).groupBy("source_id", "problem").agg(F.count(F.lit(1)).alias("n_rows"))


@query(SOURCE_PROBLEMS_SQL + ", n as (select project_id, count(distinct source_id || ': ' || problem) n from p group by 1) select q.project_id, case when n > 0 then 'FAIL' else 'PASS' end status, coalesce(n, 0) n_reasons from (select distinct project_id from sources) q left join n using (project_id)")
def gate_intake(spark: SparkSession, d: str) -> DataFrame:
    reasons = _source_problems(spark, d).select("project_id", F.concat_ws(": ", "source_id", "problem").alias("reason"))
    # rows delivered again repeat their reasons
    return audit.gate_counts(reasons.select("project_id", "reason").distinct(), "project_id", table(spark, d, "sources"))


# --- claims ----------------------------------------------------------------------------------------------------------------

@query("select claim_id, len(list_distinct(regexp_extract_all(lower(claim_text), '[a-z0-9]+'))) n_tokens from (select distinct claim_id, claim_text from claims where claim_text is not null)")
def token_set_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "claims").where("claim_text is not null").select("claim_id", "claim_text").distinct()
    return rows.select("claim_id", F.size(text.tokens(F.col("claim_text"))).cast("long").alias("n_tokens"))


@query("select s.source_id, count(distinct claim_id) n_claims from (select distinct source_id from sources) s left join claims c using (source_id) group by 1")
def claims_per_source(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.claims_per_source(table(spark, d, "sources"), table(spark, d, "claims"))


@query("select claim_id, count(*) n_rows, min(recorded_at) first_recorded from claims where claim_id is not null group by 1 having count(*) > 1")
def duplicate_claim_ids(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.repeated_claims(table(spark, d, "claims"))


@query("select distinct claim_id, ref from (select claim_id, unnest(depends_on) ref from claims) where ref is not null and ref not in (select claim_id from claims where claim_id is not null)")
def dangling_refs(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.dangling(table(spark, d, "claims"))


@query("""
with j as (select c.claim_id, source_locator l, source_type, s.url from claims c join (select distinct source_id, source_type, url from sources) s using (source_id))
select distinct claim_id, 'video source claim without a timestamp locator' warning from j where source_type = 'video-transcript' and coalesce(l.timestamp, '') = ''
union all select distinct claim_id, 'locator url does not match the source url' from j where coalesce(url, '') <> '' and coalesce(l.url, '') <> '' and l.url <> url
""")
def locator_warnings(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.locator_warnings(table(spark, d, "claims"), table(spark, d, "sources"))


@query("""
with c as (select distinct claim_id, claim_text from claims where claim_id is not null and claim_text is not null),
t as (select claim_id, list_distinct(regexp_extract_all(lower(claim_text), '[a-z0-9]+')) w from c),
g as (select claim_id, list_distinct(flatten(list(list_filter(topic_tags, lambda x: x is not null)))) tags from claims where topic_tags is not null group by 1),
x as (select t.claim_id, w, tags from t join g using (claim_id) where len(w) > 0 and len(tags) > 0),
p as (select a.claim_id claim_id_a, b.claim_id claim_id_b, list_sort(list_intersect(a.tags, b.tags)) sh, len(list_intersect(a.w, b.w)) common, len(a.w) + len(b.w) total
  from x a join x b on a.claim_id < b.claim_id and list_has_any(a.tags, b.tags) and len(a.w) * 20 >= len(b.w) * 7 and len(b.w) * 20 >= len(a.w) * 7)
select claim_id_a, claim_id_b, array_to_string(sh, ',') shared_tags, round_even(common::double / (total - common), 3) token_overlap from p where common * 20 >= (total - common) * 7
""")
def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similarity.candidate_pairs(table(spark, d, "claims"))


@query("""
select distinct tag, claim_id, '- ' || claim_id || ' (' || coalesce(source_id, 'None') || ', ' || coalesce(claim_type, 'None') || ', confidence ' || coalesce(confidence_as_stated, 'None') || ')'
  || case when coalesce(source_locator.timestamp, '') <> '' then ' @ ' || source_locator.timestamp when coalesce(source_locator.page, 0) <> 0 then ' p. ' || source_locator.page
     when coalesce(source_locator.anchor, '') <> '' then ' #' || source_locator.anchor else '' end || ' ' || coalesce(claim_text, 'None') line
from (select *, unnest(topic_tags) tag from claims where claim_id is not null) where tag is not null
""")
def tag_index(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.tag_index(table(spark, d, "claims"))


CLAIM_CHECKS = [
    "case when not coalesce(regexp_matches(claim_id, '^S\\d{7}-C\\d{3}$'), false) then 'claim_id ''' || coalesce(claim_id, 'None') || ''' does not match SNN-CNNN format' end",
    "case when regexp_matches(claim_id, '^S\\d{7}-C\\d{3}$') and not coalesce(starts_with(claim_id, source_id || '-'), false) then 'claim_id ''' || claim_id || ''' does not belong to source ' || coalesce(source_id, 'None') end",
    "case when trim(coalesce(claim_text, ''), E' \\t\\n\\r') = '' then 'claim_text must be a non-empty string' end",
    f"case when coalesce(claim_type, '') not in {validate.CLAIM_TYPES} then 'claim_type ''' || coalesce(claim_type, 'None') || ''' not in {validate.shown(validate.CLAIM_TYPES).replace(chr(39), chr(39) * 2)}' end",
    "case when topic_tags is null or len(topic_tags) = 0 or len(list_filter(topic_tags, lambda x: trim(coalesce(x, ''), E' \\t\\n\\r') = '')) > 0 then 'topic_tags must be a non-empty list of strings' end",
    "case when trim(coalesce(supporting_quote_location, ''), E' \\t\\n\\r') = '' then 'supporting_quote_location must be a non-empty string' end",
    "case when trim(supporting_quote_location, E' \\t\\n\\r') <> '' and length(supporting_quote_location) > 240 then 'supporting_quote_location too long, use a section reference not a quote' end",
    f"case when coalesce(confidence_as_stated, '') not in {validate.CONFIDENCE} then 'confidence_as_stated ''' || coalesce(confidence_as_stated, 'None') || ''' not in {validate.shown(validate.CONFIDENCE).replace(chr(39), chr(39) * 2)}' end",
    "case when depends_on is null or len(list_filter(depends_on, lambda x: not coalesce(regexp_matches(x, '^S\\d{7}-C\\d{3}$'), false))) > 0 then 'depends_on must be a list of claim ids in SNN-CNNN format' end",
    "case when source_locator is not null and source_locator.url is null and source_locator.page is null and source_locator.timestamp is null and source_locator.anchor is null then 'source_locator must have at least one of url, page, timestamp, anchor' end",
    "case when trim(source_locator.url, E' \\t\\n\\r') = '' then 'source_locator.url must be a non-empty string' end",
    "case when source_locator.page < 1 then 'source_locator.page must be a positive integer' end",
    "case when not regexp_matches(source_locator.timestamp, '^\\d{1,2}:\\d{2}(:\\d{2})?$') then 'source_locator.timestamp must look like H:MM or HH:MM:SS' end",
    "case when trim(source_locator.anchor, E' \\t\\n\\r') = '' then 'source_locator.anchor must be a non-empty string' end",
]


@query(f"select claim_id, problem, count(*) n_rows from (select claim_id, unnest(list_filter([{', '.join(CLAIM_CHECKS)}], lambda x: x is not null)) problem from claims) group by 1, 2")
def claim_problems(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "claims").drop("project_id", "recorded_at", "deleted_at")
    faults = validate.claim_faults(validate.TableRecord(claims), F.col("source_id"), validate.WIDE)
    return validate.faulty(claims, faults, "claim_id").groupBy("claim_id", "problem").agg(F.count(F.lit(1)).alias("n_rows"))


# --- decisions -------------------------------------------------------------------------------------------------------------

@query("select distinct claim_id from claims where claim_id is not null and claim_id not in (select x from (select unnest(claim_ids) x from reconciliation) where x is not null)")
def undecided_claims(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.undecided(table(spark, d, "claims"), table(spark, d, "reconciliation"))


@query("select distinct group_id, claim_id from (select group_id, unnest(claim_ids) claim_id from reconciliation) where claim_id is not null and claim_id not in (select claim_id from claims where claim_id is not null)")
def never_extracted(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.never_extracted(table(spark, d, "claims"), table(spark, d, "reconciliation"))


@query("select group_id, count(*) n_rows from reconciliation where group_id is not null group by 1 having count(*) > 1")
def duplicate_group_ids(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.repeated_groups(table(spark, d, "reconciliation"))


@query("""
select claim_id, arg_min(group_id, {'a': recorded_at, 'b': group_id}) first_group, count(distinct group_id) n_groups
from (select group_id, recorded_at, unnest(claim_ids) claim_id from reconciliation where group_id is not null) where claim_id is not null group by 1 having count(distinct group_id) > 1
""")
def contested_claims(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.contested_claims(table(spark, d, "reconciliation"))


DECISION_CHECKS = [
    "case when not coalesce(regexp_matches(group_id, '^G\\d{8}$'), false) then ['group_id ''' || coalesce(group_id, 'None') || ''' does not match GNNN format'] end",
    "case when claim_ids is null or len(claim_ids) = 0 then ['claim_ids must be a non-empty list'] end",
    "list_filter(list_transform(coalesce(claim_ids, []), lambda c: case when not coalesce(regexp_matches(c, '^S\\d{7}-C\\d{3}$'), false) then 'claim id ''' || coalesce(c, 'None') || ''' does not match SNN-CNNN format' when list_contains(unknown, c) then 'claim id ''' || c || ''' was never extracted' end), lambda x: x is not null)",
    f"case when coalesce(decision, '') not in {validate.DECISIONS} then ['decision ''' || coalesce(decision, 'None') || ''' not in {validate.shown(validate.DECISIONS).replace(chr(39), chr(39) * 2)}'] end",
    "case when trim(coalesce(decided_by, '')) = '' then ['decided_by must be a non-empty string'] end",
    "case when trim(coalesce(rule_applied, '')) = '' then ['rule_applied must be a non-empty string'] end",
    "case when decision = 'SUPERSEDED' and not coalesce(list_contains(claim_ids, winner), false) then ['SUPERSEDED decision requires a winner drawn from claim_ids'] end",
    "case when decision = 'SUPERSEDED' and not coalesce(list_contains(rules, rule_applied), false) then ['SUPERSEDED rule_applied ''' || coalesce(rule_applied, 'None') || ''' not in merge-rules.yaml'] end",
    "case when decision = 'OUT_OF_SCOPE' and trim(coalesce(note, '')) = '' then ['OUT_OF_SCOPE decision requires a one line note giving the reason'] end",
]


@query(f"""
with u as (select distinct x from (select unnest(claim_ids) x from reconciliation) where x is not null and x not in (select claim_id from claims where claim_id is not null)),
r as (select r.*, p.rules, coalesce((select list(u.x) from u where list_contains(r.claim_ids, u.x)), []) unknown from reconciliation r left join projects p using (project_id)),
e as (select group_id, unnest(flatten(list_filter([{', '.join(DECISION_CHECKS)}], lambda x: x is not null))) problem from r)
select group_id, problem, count(*) n from e group by 1, 2
""".replace("count(*) n from", "count(*) n_rows from"))
def decision_problems(spark: SparkSession, d: str) -> DataFrame:
    groups = table(spark, d, "reconciliation")
    unknown = reconcile.never_extracted(table(spark, d, "claims"), groups).select("claim_id").distinct().withColumn("_u", F.lit(1))
    rows = cut(groups.withColumn("_row", F.monotonically_increasing_id()))  # so that both sides see the same numbers
    # which of a row's ids are unknown, gathered per row (a row's list is short); hot ids are spread by the row they stand in
    mine = rows.select("_row", F.explode("claim_ids").alias("claim_id")).join(unknown, "claim_id").groupBy("_row").agg(F.collect_set("claim_id").alias("_unknown"))
    rules = table(spark, d, "projects").select("project_id", F.col("rules").alias("_rules"))
    joined = rows.join(mine, "_row", "left").join(rules, "project_id", "left").withColumn("_unknown", F.coalesce("_unknown", F.array().cast("array<string>")))
    faults = validate.decision_faults(validate.TableRecord(groups), F.col("_unknown"), F.col("_rules"), validate.WIDE)
    return validate.faulty(joined, faults, "group_id").groupBy("group_id", "problem").agg(F.count(F.lit(1)).alias("n_rows"))


WINNERS_SQL = """
w as (select claim_id, arg_max(group_id, {'a': recorded_at, 'b': group_id}) group_id from (
  select group_id, recorded_at, unnest(claim_ids) claim_id from reconciliation where decision in ('CORROBORATED', 'UNIQUE')
  union all select group_id, recorded_at, winner from reconciliation where decision = 'SUPERSEDED') where claim_id is not null and group_id is not null group by 1)
"""


@query(f"with {WINNERS_SQL} select * from w")
def winning_claims(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.winners(table(spark, d, "reconciliation"))


@query("select project_id, count(distinct group_id) n_conflicts from reconciliation where decision = 'CONFLICT' group by 1")
def conflict_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reconciliation").where("decision = 'CONFLICT'").groupBy("project_id").agg(F.countDistinct("group_id").alias("n_conflicts"))


@query("""
with t as (select project_id, count(distinct claim_id) a from claims where claim_id is not null group by 1),
s as (select project_id, count(distinct x) b from (select project_id, unnest(claim_ids) x from reconciliation) where x is not null group by 1),
g as (select project_id, count(distinct group_id) c from reconciliation group by 1)
select project_id, coalesce(a, 0) claims_total, coalesce(b, 0) claims_decided, coalesce(c, 0) decision_groups from t full join s using (project_id) full join g using (project_id)
""")
def gate_reconcile_checks(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.gate_checks(table(spark, d, "claims"), table(spark, d, "reconciliation"))


@query(f"""
with {WINNERS_SQL},
r as (select project_id, tag, min(i) rk from (select project_id, unnest(section_order) tag, generate_subscripts(section_order, 1) - 1 i from projects) where tag is not null group by 1, 2),
t as (select distinct project_id, claim_id, tag from (select project_id, claim_id, unnest(topic_tags) tag from claims where project_id is not null) join w using (claim_id) where tag is not null),
p as (select project_id, claim_id, tag, rk, row_number() over (partition by project_id, claim_id order by coalesce(rk, 1073741824), tag) n from t left join r using (project_id, tag))
select project_id, rk::int section_rank, tag, array_to_string(list_transform(string_split(tag, '-'), lambda x: upper(x[1:1]) || lower(x[2:])), ' ') title, claim_id from p where n = 1
""")
def section_plan(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.section_plan(table(spark, d, "claims"), table(spark, d, "reconciliation"), table(spark, d, "projects"))


# --- master documents: the documents table stands in for them ----------------------------------------------------------------

SECTIONS_SQL = r"""
l as (select doc_id, regexp_split_to_array("text", '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') ls from documents where "text" is not null),
e as (select doc_id, unnest(ls) x, generate_subscripts(ls, 1) i from l),
k as (select *, sum(starts_with(x, '## ')::int) over (partition by doc_id order by i) section_no from e),
s as (select doc_id, section_no, coalesce(max(case when starts_with(x, '## ') then regexp_replace(substr(x, 4), '^\s+|\s+$', '', 'g') end), '') heading,
  coalesce(string_agg(case when not starts_with(x, '## ') then x end, chr(10) order by i), '') content from k group by 1, 2)
"""


def _sections(spark: SparkSession, d: str) -> DataFrame:
    return synthesis.sections(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@query(f"with {SECTIONS_SQL} select doc_id, section_no::int section_no, heading, length(content) n_chars from s union all select doc_id, 0, '', 0 from documents where starts_with(\"text\", '## ')")
def section_split(spark: SparkSession, d: str) -> DataFrame:
    return _sections(spark, d).select("doc_id", "section_no", "heading", F.length("content").cast("long").alias("n_chars"))


CITED_SQL = f"""{SECTIONS_SQL},
c as (select doc_id, section_no, heading, unnest(list_distinct(regexp_extract_all(content, 'S\\d{{2}}-C\\d{{3}}'))) claim_id from s where heading <> 'Appendix: Source Register'),
f as (select doc_id, claim_id, arg_min(heading, section_no) h from c group by 1, 2)
"""


@query(f"with {CITED_SQL} select doc_id, claim_id, case when h = '' then 'preamble' else h end location from f")
def citations_first_location(spark: SparkSession, d: str) -> DataFrame:
    return synthesis.first_citations(_sections(spark, d), "doc_id")


# --- links, pages, captions, control ---------------------------------------------------------------------------------------

HOSTS = "case when h in ('youtube.com', 'www.youtube.com', 'm.youtube.com', 'youtu.be') then 'youtube' when h in ('vimeo.com', 'www.vimeo.com', 'player.vimeo.com') then 'vimeo' else 'url' end"


@query(f"select host, kind, count(*) n from (select h host, {HOSTS} kind from (select lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) h from fetched_docs where url is not null)) group by 1, 2")
def classify_hosts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "fetched_docs").where("url is not null")
    return rows.select(text.host_of(F.col("url")).alias("host"), text.classify_target(F.col("url")).alias("kind")).groupBy("host", "kind").agg(F.count(F.lit(1)).alias("n"))


def _targets(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "fetched_docs").select("fetch_id", "body_markdown", "origin").distinct()
    return links.discover(pages, "fetch_id", "body_markdown", "origin")


TARGETS_SQL = r"""
m as (select fetch_id, unnest(x) m, generate_subscripts(x, 1) - 1 pos from (
  select distinct fetch_id, body_markdown, regexp_extract_all(body_markdown, '\]\((?:[^()\s]|\([^()]*\))+\)|https?://[^\s<>"''`\]]+|`[^`\n]+`') x from fetched_docs where body_markdown is not null)),
u as (select fetch_id, pos, substr(m, 3, length(m) - 3) raw from m where regexp_matches(m, '^\]\((?i:https?)://')
  union all select fetch_id, pos, regexp_replace(m, '[>,.;:\]"'']+$', '') from m where regexp_matches(m, '^https?://')),
t as (select fetch_id, raw, min(pos) pos from u where raw <> '' group by 1, 2)
"""


@query(f"with {TARGETS_SQL} select fetch_id, raw, pos::int pos, {HOSTS} kind from (select *, lower(regexp_extract(raw, '^(?i:https?)://([^/:?#]+)', 1)) h from t)")
def discovered_targets(spark: SparkSession, d: str) -> DataFrame:
    return _targets(spark, d)


@query(f"with {TARGETS_SQL} select raw, parent, pos::int pos from (select raw, fetch_id parent, pos, row_number() over (partition by raw order by fetch_id, pos) n from t) where n = 1")
def first_mention_targets(spark: SparkSession, d: str) -> DataFrame:
    return links.first_mentions(_targets(spark, d), "fetch_id").select("raw", "parent", "pos")


RESOLVE_SQL = """
t as (select url target, min(fetch_id) ord, arg_min(source_id, fetch_id) parent from fetched_docs where url is not null group by 1),
b as (select url target, arg_min(body_markdown, fetch_id) body, arg_min(lower(trim(transcript_status)), fetch_id) st from fetched_docs where url is not null and body_markdown is not null group by 1),
p as (select url target, case when transcript_status = 'pending' then 'transcript_pending' else 'fetched' end was, min(source_id) sid from sources where url is not null group by 1, 2),
p1 as (select target, max(was) was, min(sid) sid from p group by 1),
e as (select sha256, min(source_id) known from sources group by 1),
j as (select t.*, was, sid, body, st, sha256(body) sha, known from t left join p1 using (target) left join b using (target) left join e on e.sha256 = sha256(body)),
s as (select *, case when was in ('fetched', 'duplicate') then 'cached' when body is null then 'failed' when sid is not null and coalesce(st = 'pending', false) then 'transcript_pending'
  when sid is not null then 'fetched' when known is not null then 'duplicate' else 'new' end stage from j),
f as (select sha, arg_min(target, ord) original from s where stage = 'new' group by 1),
o as (select target, case when stage <> 'new' then stage when original <> target then 'duplicate' when coalesce(st = 'pending', false) then 'transcript_pending' else 'fetched' end outcome from s left join f using (sha))
"""


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    return outcomes(table(spark, d, "fetched_docs").where("url is not null"), table(spark, d, "sources"))


def outcomes(docs: DataFrame, sources: DataFrame, only: str | None = None) -> DataFrame:
    targets = docs.groupBy(F.col("url").alias("target")).agg(F.min("fetch_id").alias("ord"), F.min_by("source_id", "fetch_id").alias("parent")).withColumn("kind", text.classify_target(F.col("target")))
    got = docs.where("body_markdown is not null").groupBy(F.col("url").alias("target")).agg(
        F.min_by("body_markdown", "fetch_id").alias("body"), F.min_by(F.lower(F.trim("transcript_status")), "fetch_id").alias("transcript_status"))
    status = F.when(F.col("transcript_status") == "pending", "transcript_pending").otherwise("fetched")
    prior = sources.where("url is not null").groupBy(F.col("url").alias("target")).agg(
        F.max(status).alias("status"), F.min("source_id").alias("source_id"), F.min("resolved_from").alias("resolved_from"), F.min("sha256").alias("sha256"))
    return intake.resolve_outcomes(targets, prior, got.withColumn("error", F.lit(None).cast("string")), sources.select("source_id", "sha256"), only)


@query(f"with {RESOLVE_SQL} select target, outcome from o")
def resolve_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d).select("target", "outcome")


@query(f"with {RESOLVE_SQL} select " + ", ".join(f"count(*) filter (outcome = '{o}') {o}" for o in ("fetched", "cached", "duplicate", "transcript_pending", "failed")) + " from o")
def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    return intake.outcome_counts(_outcomes(spark, d))


@query("""
with c as (select min(fetch_id) ord, url target from fetched_docs where url is not null group by 2), p as (select min(recency_rank) ord, url target from sources where url is not null group by 2)
select 0 part, ord::bigint ord, target from c union all select 1, ord::bigint, target from p where target not in (select target from c)
""")
def manifest_merge(spark: SparkSession, d: str) -> DataFrame:
    current = table(spark, d, "fetched_docs").where("url is not null").groupBy(F.col("url").alias("target")).agg(F.min("fetch_id").alias("ord"))
    prior = table(spark, d, "sources").where("url is not null").groupBy(F.col("url").alias("target")).agg(F.min("recency_rank").cast("long").alias("ord"))
    return intake.merge_manifest(current, prior)


@query("""
with e as (select user_id, event_id n, epoch(ts) s, epoch(ts) + value z, event_type x from events where event_type <> 'error'),
g as (select *, case when s - lag(z) over (partition by user_id order by n) > 8 then 1 else 0 end f from e)
select user_id, n, sum(f) over (partition by user_id order by n) para from g
""")
def cue_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Events as the cues of their user; errors stand for blank cues."""
    e = table(spark, d, "events")
    seconds = F.expr("unix_micros(cast(ts as timestamp)) / 1000000.0d")
    cues = e.select("user_id", F.col("event_id").alias("n"), seconds.alias("start"), (seconds + F.col("value")).alias("stop"), F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("text"))
    return pages.paragraphs(cues, "user_id", keep=("n",)).select("user_id", "n", "para")


@query(r"""
select distinct source_id, source_id read_id, length("_body") n_chars, null::varchar error from (select distinct source_id, title, "_body" from sources where "_body" is not null)
""")
def frontmatter_parse(spark: SparkSession, d: str) -> DataFrame:
    """Sources written as files with front matter and read back: their fields and the length of the body."""
    s = table(spark, d, "sources").where("_body is not null").select("source_id", "title", "_body").distinct()
    whole = F.concat(F.lit("---\nsource_id: "), "source_id", F.lit("\ntitle: "), F.to_json(F.struct("title")), F.lit("\n---\n"), "_body")
    parts = s.select("source_id", files.split_front_matter(whole).alias("p"))
    read = parts.select("source_id", files.parse_head(F.col("p.head")).alias("h"), F.length("p.body").alias("n_chars"))
    return read.select("source_id", F.col("h.fields")["source_id"].alias("read_id"), "n_chars", F.col("h.error").alias("error"))


@query(r"""
with d as (select distinct fetch_id, url, coalesce(title, '') title, body_markdown from fetched_docs where body_markdown is not null),
b as (select *, list_filter(list_transform(regexp_split_to_array(body_markdown, '\n[ \t\r\n\x0b\x0c]*\n'), lambda x: regexp_replace(regexp_replace(x, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'), '^ | $', '', 'g')), lambda x: x <> '') p from d)
select fetch_id, nullif(regexp_replace(regexp_replace(title, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'), '^ | $', '', 'g'), '') title,
  case when len(p) = 0 then 0 else list_sum(list_transform(p, lambda x: length(x)))::bigint + 2 * len(p) - 1 end n_chars from b
""")
def page_text(spark: SparkSession, d: str) -> DataFrame:
    """Fetched bodies wrapped as HTML pages and reduced again: text lengths and titles."""
    docs = table(spark, d, "fetched_docs").where("body_markdown is not null").select("fetch_id", "url", "title", "body_markdown").distinct()
    safe = lambda c: F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;")
    page = F.concat(F.lit("<html><head><title>"), safe(F.coalesce("title", F.lit(""))), F.lit("</title></head><body><nav><p>menu</p></nav><article><p>"),
                    F.regexp_replace(safe(F.col("body_markdown")), r"\n\s*\n", "</p><p>"), F.lit("</p></article></body></html>"))
    read = docs.select("fetch_id", pages.reduce_html(page, F.col("url")).alias("r"))
    return read.select("fetch_id", F.col("r.title").alias("title"), F.length("r.body").cast("long").alias("n_chars"))
