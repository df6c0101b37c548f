"""Queries of the training-data operators over the driver's tables, and their SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import boilerplate, components, neardup, packing, quality, setjoin, tokens, turns
from sparkloom.operators.orphans import tidy
from sparkloom.plans.lineage import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query()
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"), "doc_id", "text", tokens.vocabulary())


@query()
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), "doc_id", "text", tokens.vocabulary())


def _links(spark: SparkSession, d: str) -> DataFrame:
    """(a, b): what candidates and reconciliation say of existing claims; ids without a claim link nothing, so they leave first."""
    known = table(spark, d, "claims").select(F.col("claim_id").alias("id")).distinct()
    pairs = table(spark, d, "candidates").select("claim_ids").withColumn("g", F.monotonically_increasing_id()).select("g", F.explode("claim_ids").alias("id"))
    groups = table(spark, d, "reconciliation").where("group_id is not null").select(F.col("group_id").alias("g"), F.explode("claim_ids").alias("id"))
    members = (
        pairs.select(F.concat(F.lit("row "), F.col("g").cast("string")).alias("g"), "id")
        .unionByName(groups.select(F.concat(F.lit("group "), F.col("g")).alias("g"), "id"))
        .select("g", tidy(F.col("id")).alias("id"))
        .where("id <> ''")
        .join(known, "id", "left_semi")
    )
    members = components.cut(members.distinct())
    least = members.groupBy("g").agg(F.min("id").alias("a"))
    return members.join(least, "g").select("a", F.col("id").alias("b")).where("a <> b")


@query()
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return components.connected_groups(_links(spark, d)).select(F.col("group").alias("group_claim_id"), F.col("vertex").alias("claim_id"))


@query()
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    kinds = quality.document_kinds(table(spark, d, "documents"), table(spark, d, "doc_labels"), table(spark, d, "common_words"))
    return kinds.where("kind <> 'prose'").select("doc_id", "kind").distinct()


@query(r"""
with w as (select distinct lower(word) word from common_words where word is not null),
t as (select doc_id, coalesce("text", '') b from documents),
l as (select doc_id, b, regexp_extract_all(b, '[\p{L}\p{N}]+') ws, list_filter(regexp_split_to_array(b, '\r\n|\r|\n'), lambda x: not regexp_matches(x, '^[ \t]*$')) ls from t),
h as (select doc_id, count(*) n from (select doc_id, unnest(ws) x from l) join w on lower(x) = word group by 1)
select l.doc_id, len(ws) n_words, len(ls) n_lines,
  case when len(ws) = 0 then 0 else length(regexp_replace(b, '[^\p{L}\p{N}]+', '', 'g'))::double / len(ws) end mean_word,
  case when length(b) = 0 then 0 else length(regexp_replace(b, '[\p{L}\p{N} \t\r\n]+', '', 'g'))::double / length(b) end symbol_share,
  case when len(ls) = 0 then 0 else len(list_filter(ls, lambda x: regexp_matches(x, '[.!?:;][ \t]*$')))::double / len(ls) end point_line_share,
  case when len(ws) = 0 then 0 else coalesce(n, 0)::double / len(ws) end common_share
from l left join h using (doc_id)
""")
def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.document_statistics(table(spark, d, "documents"), table(spark, d, "common_words"))


@query()
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    claims = neardup.similar_pairs(table(spark, d, "claims"), "claim_id", "claim_text", run=2)
    sources = neardup.similar_pairs(table(spark, d, "sources"), "source_id", "_body", run=3)
    return claims.select(F.lit("claims").alias("rec_table"), "key_a", "key_b").unionByName(sources.select(F.lit("sources").alias("rec_table"), "key_a", "key_b"))


@query()
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = setjoin.similar_records(table(spark, d, "claims"), "claim_id", "claim_text", "topic_tags")
    return pairs.select(F.col("key_a").alias("claim_id_a"), F.col("key_b").alias("claim_id_b"))


@query()
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.lines_outside_articles(table(spark, d, "fetched_docs").where("source_type = 'html-article'"))


@query()
def p1_articles(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.articles(table(spark, d, "fetched_docs").where("source_type = 'html-article'"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    fetched = table(spark, d, "fetched_docs").where(F.lower(F.regexp_replace("transcript_status", r"^\s+|\s+$", "")) == "fetched")
    return turns.speaker_turns(fetched, table(spark, d, "speakers"))


@query()
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).select("fetch_id", "turn_no", "speaker_id", "n_words")


@query()
def p5_turns(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d)
