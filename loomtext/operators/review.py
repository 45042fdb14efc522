"""Drafts, imports and proposals of manuscript changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "id string, kind string, target_id string, base_revision int, value string, author string, created_at timestamp"
#: A draft holds at most so many records (rule of the format, checked, not applied).
MOST_RECORDS = 1000


def empty_draft(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RECORD)


def draft_problems(draft: DataFrame) -> DataFrame:
    """problem, key: repeated ids, several changes of one target, missing provenance, too many records."""
    d = draft
    ids = d.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("repeated id").alias("problem"), F.col("id").alias("key"))
    targets = d.groupBy("kind", "target_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("repeated target"), "target_id")
    who = d.where("author is null or created_at is null").select(F.lit("no provenance"), "id")
    many = d.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_RECORDS).select(F.lit("too many records"), F.col("n").cast("string"))
    return ids.union(targets).union(who).union(many)


def reorder(lines: DataFrame, order: DataFrame) -> DataFrame:
    """line_id, ord after a permutation (line_id, ord); fails unless it names exactly the lines, once each."""
    j = lines.select("line_id", F.lit(1).alias("l")).join(order.groupBy("line_id").agg(F.max("ord").alias("ord"), F.count(F.lit(1)).alias("n")), "line_id", "full")
    ok = F.col("l").isNotNull() & (F.col("n") == 1)
    return j.select("line_id", F.when(F.coalesce(ok, F.lit(False)), F.col("ord")).otherwise(F.raise_error(F.lit("not a permutation of the lines"))).alias("ord"))


def resolve_conflicts(base: DataFrame, draft: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(draft after decisions, conflicts left open).

    ``decisions``: target_id, choice ('base' drops the record, 'draft' keeps it
    on the current revision).
    """
    j = draft.join(base.select("target_id", "revision"), "target_id", "left").join(decisions, "target_id", "left")
    now = F.coalesce("revision", F.lit(0))
    clash = F.col("base_revision") != now
    solved = j.where(~clash | F.col("choice").isin("draft")).select("target_id", F.when(clash, now).otherwise(F.col("base_revision")).alias("base_revision"), "value")
    return solved, j.where(clash & F.col("choice").isNull()).select("target_id")


def resolve_import(local: DataFrame, incoming: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged draft, targets without a decision); equal records merge, different ones need 'local' or 'incoming'."""
    a, b = local.select("target_id", F.struct("base_revision", "value").alias("l")), incoming.select("target_id", F.struct("base_revision", "value").alias("r"))
    j = a.join(b, "target_id", "full").join(decisions, "target_id", "left")
    same = F.col("l").isNull() | F.col("r").isNull() | F.col("l").eqNullSafe(F.col("r"))
    pick = F.when(F.col("l").isNull() | (~same & (F.col("choice") == "incoming")), F.col("r")).otherwise(F.col("l"))
    return j.where(same | F.col("choice").isNotNull()).select("target_id", pick.alias("x")).select("target_id", "x.*"), j.where(~same & F.col("choice").isNull()).select("target_id")


def proposal_diff(base: DataFrame, draft: DataFrame) -> DataFrame:
    """target_id, before, after, ok: a change is sound if it is based on the current revision."""
    j = draft.join(base.select("target_id", "revision", F.col("value").alias("before")), "target_id", "left")
    return j.select("target_id", "before", F.col("value").alias("after"), (F.col("base_revision") == F.coalesce("revision", F.lit(0))).alias("ok")).where("not (before <=> after)")


def new_line(lines: DataFrame, surface: str, line_id: str) -> DataFrame:
    """Lines with a new last line on a surface."""
    top = lines.where(F.col("surface_id") == surface).agg(F.coalesce(F.max("ord"), F.lit(0)).alias("m"))
    return lines.unionByName(top.select(F.lit(line_id).alias("line_id"), F.lit(surface).alias("surface_id"), (F.col("m") + 1).alias("ord")))


def locate_reading(layers: DataFrame, readings: DataFrame) -> DataFrame:
    """line_id, reading, start_pos, end_pos, problem: a variant must be a unique exact span of its line."""
    j = readings.join(layers.select("line_id", "text"), "line_id", "left")
    n = F.expr("case when length(reading) > 0 then (length(text) - length(replace(text, reading, ''))) div length(reading) end")
    j = j.withColumn("n", n).withColumn("a", F.expr("locate(reading, text) - 1"))
    problem = F.when(F.col("text").isNull(), "no line").when(F.col("n").isNull(), "empty").when(F.col("n") == 0, "not found").when(F.col("n") > 1, "not unique")
    return j.select("line_id", "reading", F.when(F.col("n") == 1, F.col("a")).alias("start_pos"), F.when(F.col("n") == 1, F.col("a") + F.length("reading")).alias("end_pos"), problem.alias("problem"))


def same_snapshot(saved: DataFrame, opened_hash: str) -> DataFrame:
    """One row, same: is the saved draft still what was opened?"""
    return saved.agg((F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(*saved.columns)))), 256) == opened_hash).alias("same"))


def bookmark(marks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last mark per composite key."""
    from loomtext.operators.edits import last_wins

    return last_wins(marks, keys, [order]).drop("first_seen")
