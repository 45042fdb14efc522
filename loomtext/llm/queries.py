"""Queries of the training-text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.bitext import align
from loomtext.llm.leakage import leaks
from loomtext.llm.lookalike import forms, look_links, looking_equal
from loomtext.llm.pii import find_pii, redact
from loomtext.llm.scan import noise, paragraphs
from loomtext.llm.sentences import sentence_spans
from loomtext.llm.spans import shared_spans
from loomtext.llm.tokenize import decode_corpus, encode_corpus
from loomtext.sources.tables import read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "checked_readings", "reading_id", "text", "reading_layer").where("reading_layer = 'checked'")
    r = r.select(F.lit("reading").alias("record_kind"), F.col("reading_id").alias("record_key"), "text")
    p = read(spark, d, "semantic_plans", "plan_id", "note").select(F.lit("plan").alias("record_kind"), F.col("plan_id").alias("record_key"), F.col("note").alias("text"))
    return sentence_spans(r.unionByName(p), "record_kind", "record_key", "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "alignments", "unit_id", "targets").select("unit_id", F.explode("targets").alias("w", "text"))
    a = a.select(F.lit("alignment").alias("record_kind"), F.concat_ws("/", "unit_id", "w").alias("record_key"), "text")
    r = read(spark, d, "checked_readings", "reading_id", "text").select(F.lit("reading").alias("record_kind"), F.col("reading_id").alias("record_key"), "text")
    return shared_spans(a.unionByName(r), "record_kind", "record_key", "text")


def _look_rows(spark: SparkSession, d: str) -> DataFrame:
    """Line-map lines and checked readings, one row per key and text."""
    lines = read(spark, d, "opening_lines", "line_id", "text").select(F.lit("line").alias("record_kind"), F.col("line_id").alias("record_key"), "text")
    rd = read(spark, d, "checked_readings", "reading_id", "text", "reading_layer").where("reading_layer = 'checked'")
    return lines.unionByName(rd.select(F.lit("reading").alias("record_kind"), F.col("reading_id").alias("record_key"), "text")).distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return looking_equal(_look_rows(spark, d), "record_kind", "record_key", "text")


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    return look_links(_look_rows(spark, d), "record_kind", "record_key", "text")


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    return forms(_look_rows(spark, d), ["record_kind", "record_key"], "text").select("record_kind", "record_key", "form")


def _readings(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "checked_readings", "reading_id", "document_id", "pdf_page", "raw_block_ids", "text", "reading_layer", "received_at")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return noise(_readings(spark, d))


def p7_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return paragraphs(_readings(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(read(spark, d, "documents", "doc_id", "text"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return decode_corpus(p8_ids(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(read(spark, d, "documents", "doc_id", "text"), "doc_id", "text", read(spark, d, "eval_items", "item_id", "text"), "item_id", "text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    units = read(spark, d, "alignments", "unit_id", "bitext_id", "unit_number", "unit_order", "unit_status", "targets", "received_at")
    return align(units, read(spark, d, "semantic_plans", "bitext_id", "source_id", "passages"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return find_pii(read(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redact(read(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


QUERIES = {"p10_found": p10_found, "p10_redacted": p10_redacted, "p5_found": p5_found, "p7_found": p7_found, "p7_paragraphs": p7_paragraphs, "p9_found": p9_found, "p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p3_forms": p3_forms, "p3_links": p3_links, "p8_ids": p8_ids, "p8_decoded": p8_decoded}
SQL = {
    "p2_found": """
with r as (
  select distinct 'alignment' as record_kind, unit_id || '/' || e.key as record_key, e.value as text
  from (select unit_id, unnest(map_entries(targets)) as e from alignments)
  union select distinct 'reading', reading_id, text from checked_readings),
w as (select record_kind, record_key, unnest(generate_series(1, length(text) - 99)) as s, text from r where length(text) >= 100),
h as (select record_kind, record_key, s, substr(text, s, 100) as g from w),
m as (select g from h group by g having min(record_kind || record_key) <> max(record_kind || record_key)),
c as (select record_kind, record_key, s, lag(s) over (partition by record_kind, record_key order by s) as p from h semi join m using (g))
select record_kind, record_key, cast(sum(least(100, s - coalesce(p, s - 100))) as bigint) as shared_chars from c group by all""",
    "p8_decoded": "select doc_id, coalesce(text, '') as text from documents"}
