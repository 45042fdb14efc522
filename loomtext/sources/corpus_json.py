"""Corpus, witness and edit files in JSON: explicit schemas, long tables, checks, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = "struct<id:string,text:string,start:int,end:int,type:string,originVerse:int>"
WITNESS = f"struct<text:string,tokens:array<{TOKEN}>,status:string,note:string,segmentationMethod:string>"
CORPUS = (
    "schemaVersion string, sources array<struct<id:string,label:string,language:string,languageCode:string,script:string,role:string,citation:string,rights:string>>, "
    f"passages array<struct<id:string,number:int,label:string,root:string,texts:map<string,{WITNESS}>>>, "
    "alignments array<struct<id:string,verse:int,number:string,order:int,level:string,status:string,confidence:string,method:string,note:string,"
    "targets:map<string,string>,targetTokenIds:map<string,array<string>>,mappingMethods:map<string,string>>>"
)
SEGMENTED = "verse int, text string, status string, note string, method string"
SOURCE = "id string, label string, language string, languageCode string, script string, role string, citation string, rights string"


def read_corpus(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables sources, passages, witnesses, tokens and units of a corpus file.

    A corpus may be stored compactly: a token's text and type are then taken
    from its offsets and default to 'word'.
    """
    root = spark.read.schema(CORPUS).json(path, multiLine=True)
    p = root.select(F.posexplode("passages").alias("ord", "p")).select("ord", "p.*")
    w = p.select(F.col("id").alias("passage_id"), F.explode("texts").alias("source_id", "w"))
    t = w.select("passage_id", "source_id", F.col("w.text").alias("body"), F.posexplode("w.tokens").alias("idx", "t"))
    cut = F.substring(F.col("body"), F.col("t.start") + 1, F.col("t.end") - F.col("t.start"))
    return {
        "sources": root.select(F.inline("sources")),
        "passages": p.select("id", "number", "label", "root", "ord"),
        "witnesses": w.select("passage_id", "source_id", "w.text", "w.status", "w.note", F.col("w.segmentationMethod").alias("method")),
        "tokens": t.select("passage_id", "source_id", F.col("t.id").alias("token_id"), "idx", F.col("t.start").alias("start_pos"), F.col("t.end").alias("end_pos"),
                           F.coalesce("t.text", cut).alias("surface"), F.coalesce("t.type", F.lit("word")).alias("type"), F.col("t.originVerse").alias("origin")),
        "units": root.select(F.inline("alignments")),
    }


def read_segmented(spark: SparkSession, path: str) -> DataFrame:
    """Segmented witness records (verse, text, status, note, method), one per array element."""
    return spark.read.schema(SEGMENTED).json(path, multiLine=True)


def missing_verses(records: DataFrame, first: int = 1, last: int = 22, require_text: bool = True) -> DataFrame:
    """verse: those of first..last without a record (or without text)."""
    have = records.where(F.length(F.trim("text")) > 0) if require_text else records
    return records.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("verse")).join(have.select("verse"), "verse", "left_anti")


def discover_sources(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(sources with their file, ids that occur in several files) of ``*/source.json`` files."""
    s = spark.read.schema(SOURCE).json(pattern, multiLine=True).withColumn("file", F.col("_metadata.file_path"))
    return s, s.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def import_units(units: DataFrame) -> DataFrame:
    """Authorised units with the defaults for what a file leaves out."""
    lacks = {"level": "sentence", "status": "reviewed", "confidence": "high", "method": "imported"}
    for c, v in lacks.items():
        units = units.withColumn(c, F.coalesce(c, F.lit(v)))
    return units.where("id is not null")


def locate_targets(units: DataFrame, tokens: DataFrame) -> DataFrame:
    """unit_id, source_id, token_ids of units given by text: first case-insensitive find, then overlap.

    ``units``: unit_id, passage_id, source_id, target, text (the witness text);
    ``tokens``: passage_id, source_id, token_id, idx, start_pos, end_pos.
    """
    u = units.where("length(target) > 0").withColumn("a", F.expr("locate(lower(target), lower(text)) - 1")).where("a >= 0").withColumn("b", F.expr("a + length(target)"))
    j = u.alias("u").join(tokens.alias("t"), F.expr("u.passage_id = t.passage_id and u.source_id = t.source_id and t.start_pos < u.b and t.end_pos > u.a"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("t.idx", "t.token_id"))), lambda x: x.token_id)
    return j.groupBy("u.unit_id", "u.source_id").agg(ids.alias("token_ids"))


def compact_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens without what can be derived again (text, and the default type)."""
    return tokens.drop("surface").withColumn("type", F.when(F.col("type") != "word", F.col("type")))


def write_corpus(tables: dict[str, DataFrame], path: str) -> None:
    """Parquet tables below ``path``; tokens compact and partitioned by source."""
    for name, df in tables.items():
        if name == "tokens":
            compact_tokens(df).write.mode("overwrite").partitionBy("source_id").parquet(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def export_edits(edits: DataFrame, schema_version: str) -> DataFrame:
    """One JSON document per kind of edit: kind, json."""
    rest = [c for c in edits.columns if c != "kind"]
    g = edits.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("records"))
    return g.select("kind", F.to_json(F.struct(F.lit(schema_version).alias("schemaVersion"), "kind", "records")).alias("json"))


def dehyphenate(text: str):
    """Extracted page text: words joined over line ends, blanks squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(\p{L})-\s*\n\s*(\p{Ll})", "$1$2"), r"[ \t]+", " "))
