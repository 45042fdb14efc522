"""Overlapping and gapped intervals: continuous periods and their gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.operators.windows import running_before

#: Positions per bucket at least, and buckets per key at most.  Wider ranges (times in microseconds) get wider buckets.
BUCKET_WIDTH, BUCKETS = 4096, 1 << 20


def merge_intervals(df: DataFrame, key: str, start: str, end: str, bucket_width: int | None = None) -> DataFrame:
    """Covered stretches and gaps of half-open integer intervals per key.

    Result columns: ``key``, ``span_kind`` ('covered' | 'gap'), ``start_pos``,
    ``end_pos`` (BIGINT).  Touching intervals are joined.

    Rows with a null key or position, or with start >= end, cover nothing.
    Repeated rows change nothing.  A key without any covering row has no result
    row, an empty table gives an empty result.  Other columns are ignored.

    Equal starts are pre-aggregated to their largest end before the shuffle, so
    a key holding a third of all rows shrinks to its distinct starts; the
    running maximum of previous ends is then taken per position bucket with a
    carry from earlier buckets, never over a whole key in one task.  Without a
    ``bucket_width`` it is taken from the range of all starts.
    """
    s = (
        df.select(F.col(key).alias("_k"), F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_e"))
        .where("_k is not null and _s < _e")
    )
    if bucket_width is None:
        lo, hi = s.agg(F.min("_s"), F.max("_s")).first()
        bucket_width = max(BUCKET_WIDTH, ((hi or 0) - (lo or 0)) // BUCKETS + 1)
    s = (
        s.withColumn("_b", F.floor(F.col("_s") / bucket_width))
        .groupBy("_k", "_b", "_s")
        .agg(F.max("_e").alias("_e"))
    )
    r = running_before(s, ["_k"], "_b", "_s", "_e", F.max, F.greatest, "_prev")
    opens = F.col("_prev").isNull() | (F.col("_s") > F.col("_prev"))

    # The stretch opened at a row ends at the `_prev` of the next opening row.
    # Per bucket: its first opening's _prev and its largest end; per key: carry backwards.
    b = r.groupBy("_k", "_b").agg(
        F.min_by(F.when(opens, F.col("_prev")), F.when(opens, F.col("_s"))).alias("_first_prev"),
        F.max("_e").alias("_top"),
    )
    after = Window.partitionBy("_k").orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy("_k")
    b = b.select(
        "_k", "_b", F.coalesce(F.first("_first_prev", ignorenulls=True).over(after), F.max("_top").over(whole)).alias("_next")
    )
    inside = Window.partitionBy("_k", "_b").orderBy("_s")
    stretches = (
        r.where(opens)
        .join(b, ["_k", "_b"])
        .withColumn("_stop", F.coalesce(F.lead("_prev").over(inside), F.col("_next")))
        .select("_k", F.array(
            F.struct(F.lit("covered").alias("span_kind"), F.col("_s").alias("start_pos"), F.col("_stop").alias("end_pos")),
            F.struct(F.lit("gap").alias("span_kind"), F.col("_prev").alias("start_pos"), F.col("_s").alias("end_pos")),
        ).alias("_spans"))
    )
    return (
        stretches.select(F.col("_k").alias(key), F.inline("_spans"))
        .where("start_pos is not null")
    )
