"""References to records that do not exist: signed counts from change deltas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.operators.windows import running_before
from loomtext.session import small, table


#: Rows of one key that one task may run through.
HOT = 1_000_000


def existence_deltas(target: DataFrame, key: str, created: str = "created_at", deleted: str = "deleted_at") -> DataFrame:
    """(ref_key, ts, d, made): +1 at each creation, -1 at each deletion, summed per (key, ts); creations alone in ``made``.

    A row without a creation time never exists and gives no delta; a deletion
    at or before the creation leaves no time of existence but still counts as
    a creation (+1 and -1 at the same instant).  Repeated rows raise the count
    consistently and so do not change where it is positive.
    """
    return (
        target.select(F.col(key).alias("ref_key"), F.col(created).alias("c"), F.col(deleted).alias("x"))
        .where("ref_key is not null and c is not null")
        .select("ref_key", F.inline(F.array(
            F.struct(F.col("c").alias("ts"), F.lit(1).alias("d"), F.lit(1).alias("made")),
            F.struct(F.greatest("c", "x").alias("ts"), F.lit(-1).alias("d"), F.lit(0).alias("made")),
        )), F.col("x").isNotNull().alias("ended"))
        .where("made = 1 or ended")
        .groupBy("ref_key", "ts").agg(F.sum("d").alias("d"), F.sum("made").alias("made"))
    )


def existence_periods(deltas: DataFrame) -> DataFrame:
    """(ref_key, since, until): maximal periods in which the signed count is positive.

    Running count and next change are taken per (key, day) with what the other
    days add, so a key with very many changes is spread over tasks.
    """
    r = running_before(
        deltas.withColumn("day", F.to_date("ts")), ["ref_key"], "day", "ts", "d", F.sum, lambda a, b: a + b, "before"
    ).select("ref_key", "day", "ts", F.coalesce("before", F.lit(0)).alias("b"), (F.coalesce("before", F.lit(0)) + F.col("d")).alias("a"))
    turns = r.where("(a > 0) <> (b > 0)")
    days = turns.groupBy("ref_key", "day").agg(F.min("ts").alias("first"))
    after = Window.partitionBy("ref_key").orderBy("day")
    days = days.select("ref_key", "day", F.lead("first").over(after).alias("later"))
    w = Window.partitionBy("ref_key", "day").orderBy("ts")
    turns = turns.withColumn("until", F.lead("ts").over(w)).where("a > 0").join(days, ["ref_key", "day"])
    return turns.select("ref_key", F.col("ts").alias("since"), F.coalesce("until", "later").alias("until"))


def orphan_references(
    refs: DataFrame, ref_id: str, at: str, targets: dict[str, tuple[str, DataFrame, str]], hot: int = HOT
) -> DataFrame:
    """References whose target had no existing row at the time of the reference.

    ``targets``: ref_table -> (column of ``refs``, target frame, its key column).
    Result: ``ref_id``, ``ref_table``, ``period`` (yyyy-MM of ``at``), ``reason``
    ('missing' no row with the key at all | 'deleted' a row was created before |
    'late' rows were created only later).

    Null keys are no references, the empty string is a key.  A null ``at`` can
    satisfy no existence, so it is an orphan with a null period ('missing' or
    'late').  Repeated reference rows give one row.  Empty targets make every
    reference 'missing'.

    References and the existence of targets (+1 at creation, -1 at deletion) form one stream of signed deltas
    per key.  Running counts over it say at every reference how many rows exist and how many were ever created.
    A key with more than ``hot`` rows is cut by hours, and the counts of earlier hours are carried, so that it
    spreads over tasks.
    """
    names = list(targets)
    code = lambda t: F.lit(names.index(t)).cast("tinyint")
    long = refs.select(
        F.col(ref_id).alias("id"), F.col(at).alias("ts"),
        F.inline(F.array(*[F.struct(code(t).alias("ref_table"), F.col(c).alias("ref_key")) for t, (c, _, _) in targets.items()])),
    ).where("ref_key is not null")
    known = reduce(DataFrame.unionByName, [f.select(code(t).alias("ref_table"), F.col(k).alias("ref_key")) for t, (_, f, k) in targets.items()])
    known = known.where("ref_key is not null").distinct().withColumn("known", F.lit(True))
    steps = reduce(DataFrame.unionByName, [
        existence_deltas(f, k).select(code(t).alias("ref_table"), "ref_key", "ts", "d", "made") for t, (_, f, k) in targets.items()])

    keys = ["ref_table", "ref_key"]
    flow = long.where("ts is not null").select(*keys, "ts", "id", F.lit(None).cast("bigint").alias("d"), F.lit(None).cast("bigint").alias("made"))
    flow = flow.unionByName(steps.select(*keys, "ts", F.lit(None).cast(long.schema["id"].dataType).alias("id"), "d", "made"))
    large = table(flow.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select(*keys), "hot-keys")
    every = Window.partitionBy(*keys).orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cold = flow.join(small(large), keys, "left_anti") if large.loom_rows else flow
    run = cold.select(*keys, "ts", "id", F.col("d").isNull().alias("ref"), *[F.coalesce(F.sum(c).over(every), F.lit(0)).alias(c) for c in ("d", "made")])
    if large.loom_rows:
        run = run.unionByName(_by_hours(flow.join(small(large), keys, "left_semi"), keys))
    dead = run.where("ref and d <= 0").select("id", *keys, "ts", (F.col("made") > 0).alias("made"))
    dead = dead.unionByName(long.where("ts is null").select("id", *keys, "ts", F.lit(False).alias("made")))
    reason = F.when(F.col("made"), "deleted").when(F.col("known"), "late").otherwise("missing")
    name = F.element_at(F.array(*map(F.lit, names)), F.col("ref_table").cast("int") + 1)
    return dead.join(known, keys, "left").select(
        F.col("id").alias(ref_id), name.alias("ref_table"), F.date_format("ts", "yyyy-MM").alias("period"), reason.alias("reason")).distinct()


def _by_hours(flow: DataFrame, keys: list[str]) -> DataFrame:
    """``flow`` with running counts, the hours of a key in different tasks."""
    hour = F.unix_date(F.to_date("ts")) * 24 + F.hour("ts")
    flow = flow.withColumn("bucket", hour).repartition(*keys, "bucket")
    tops = flow.groupBy(*keys, "bucket").agg(F.sum("d").alias("d"), F.sum("made").alias("made"))
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, "bucket", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("d", "made")])
    inside = Window.partitionBy(*keys, "bucket").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    run = flow.select(*keys, "bucket", "ts", "id", F.col("d").isNull().alias("ref"), *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(c) for c in ("d", "made")])
    run = run.join(tops.hint("merge"), [*keys, "bucket"])
    return run.select(*keys, "ts", "id", "ref", *[(F.col(c) + F.col(f"{c}_before")).alias(c) for c in ("d", "made")])


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references per table, period and reason."""
    return orphans.groupBy("ref_table", "period", "reason").agg(F.count(F.lit(1)).alias("n_refs"))


def apply_changes(state: DataFrame, changes: DataFrame) -> DataFrame:
    """New signed counts after a batch of change deltas.

    Both frames: (ref_table, ref_key, n_refs, n_rows) with signed counts; keys
    whose counts are both zero leave the state.  Null keys are dropped.
    """
    cols = ["ref_table", "ref_key", "n_refs", "n_rows"]
    return (
        state.select(*cols).unionByName(changes.select(*cols)).where("ref_key is not null")
        .groupBy("ref_table", "ref_key").agg(F.sum("n_refs").alias("n_refs"), F.sum("n_rows").alias("n_rows"))
        .where("n_refs <> 0 or n_rows <> 0")
    )


def current_orphans(state: DataFrame) -> DataFrame:
    """Keys with positive references and no existing row."""
    return state.where("n_refs > 0 and coalesce(n_rows, 0) <= 0").select("ref_table", "ref_key", "n_refs")
