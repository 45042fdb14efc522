"""Longest-match multiword lexicon lookup and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.session import small


def entry_forms(lexicon: DataFrame) -> DataFrame:
    """entry_id, form, form_ord: lemma first, then forms, deduplicated; a lemma with '/' is no form."""
    forms = F.array_distinct(F.concat(
        F.when(F.col("lemma").contains("/") | F.col("lemma").isNull(), F.array().cast("array<string>")).otherwise(F.array("lemma")),
        F.coalesce("forms", F.array().cast("array<string>"))))
    return lexicon.select("entry_id", F.posexplode(forms).alias("form_ord", "form")).where("form is not null")


def entry_parts(lexicon: DataFrame) -> DataFrame:
    """entry_id, form, form_ord, parts: forms cut at blanks, lower-cased, empty parts dropped."""
    parts = F.filter(F.split(F.lower("form"), r"\s+"), lambda p: p != "")
    return entry_forms(lexicon).withColumn("parts", parts).where(F.size("parts") > 0)


def longest_matches(tokens: DataFrame, lexicon: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, idx, entry_id, form, start_idx, n_parts: the winning entry of every covered token.

    ``tokens``: key, idx, norm (idx consecutive from 0).  A form matches where
    all its parts equal consecutive tokens of the same key.  Of several matches
    over a token the longest wins, then the smaller entry id, form order and
    position.  The join is on a form's first part, so a match is proposed once.
    """
    p = entry_parts(lexicon).withColumn("first", F.col("parts")[0]).withColumn("n", F.size("parts"))
    longest = p.agg(F.max("n")).first()[0] or 1
    w = Window.partitionBy(key).orderBy("idx").rowsBetween(0, int(longest) - 1)
    t = tokens.select(key, "idx", "norm", F.collect_list("norm").over(w).alias("ahead")) if longest > 1 else tokens.select(key, "idx", "norm", F.array("norm").alias("ahead"))
    hits = t.join(small(p), F.col("norm") == F.col("first")).where(F.slice("ahead", 1, F.col("n")) == F.col("parts"))
    hits = hits.select(key, F.col("idx").alias("start_idx"), "entry_id", "form", "form_ord", "n", F.explode(F.sequence(F.col("idx"), F.col("idx") + F.col("n") - 1)).alias("idx"))
    best = hits.groupBy(key, "idx").agg(F.min(F.struct(-F.col("n"), "entry_id", "form_ord", -F.col("start_idx"), "form")).alias("m"))
    return best.select(key, "idx", "m.entry_id", "m.form", F.expr("-m.col4").alias("start_idx"), F.expr("-m.col1").alias("n_parts"))


def coverage(tokens: DataFrame, matches: DataFrame, group: str, key: str = "doc_id") -> DataFrame:
    """group, tokens, covered_tokens, types, covered_types, token_coverage, type_coverage (per cent).

    Only tokens with a letter count; a type is covered if any of its tokens is.
    """
    t = tokens.where(F.col("norm").rlike(r"\p{L}")).select(group, key, "idx", "norm")
    t = t.join(matches.select(key, "idx", F.lit(1).alias("hit")), [key, "idx"], "left")
    types = t.groupBy(group, "norm").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("h"))
    per = types.groupBy(group).agg(
        F.sum("n").alias("tokens"), F.sum("h").alias("covered_tokens"), F.count(F.lit(1)).alias("types"), F.sum(F.when(F.col("h") > 0, 1).otherwise(0)).alias("covered_types"))
    pc = lambda a, b: F.round(100.0 * F.col(a) / F.col(b), 6)
    return per.select("*", pc("covered_tokens", "tokens").alias("token_coverage"), pc("covered_types", "types").alias("type_coverage"))
