"""Running aggregates in two levels, so that no key needs one task.

A plain ``Window.partitionBy(key)`` puts all rows of a key in one task.  Here a
key is cut into buckets; each bucket is aggregated first, the (few) bucket
totals of a key are carried forward, and the row-level window runs inside one
(key, bucket) only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(
    df: DataFrame,
    keys: list[str],
    bucket: str,
    value: str,
    agg: Callable[[Column], Column],
    out: str,
) -> DataFrame:
    """``df`` with ``out`` = ``agg(value)`` over all earlier buckets of the key.

    Null where no earlier bucket exists.  ``agg`` must be associative (F.sum,
    F.max, F.min).
    """
    tops = df.groupBy(*keys, bucket).agg(agg(F.col(value)).alias("_top"))
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, bucket, agg(F.col("_top")).over(w).alias(out))
    return df.join(tops, [*keys, bucket])


def running_before(
    df: DataFrame,
    keys: list[str],
    bucket: str,
    order: str,
    value: str,
    agg: Callable[[Column], Column],
    combine: Callable[[Column, Column], Column],
    out: str,
) -> DataFrame:
    """``out`` = ``agg(value)`` over all rows of the key before this one by ``order``.

    ``bucket`` must not decrease in ``order``; (keys, order) must be unique.
    """
    df = carried(df, keys, bucket, value, agg, "_carry")
    w = Window.partitionBy(*keys, bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = agg(F.col(value)).over(w)
    both = F.when(own.isNull(), F.col("_carry")).when(F.col("_carry").isNull(), own).otherwise(combine(own, F.col("_carry")))
    return df.withColumn(out, both).drop("_carry")


def latest(df: DataFrame, key: str, at: str, among: list[str]) -> DataFrame:
    """``among`` of the latest row of each ``key`` by ``at``; of equal times the row with the largest values, null last.

    Null times are the earliest, a missing column ``at`` counts as null.  Null keys are
    one key.  Rows that cannot be the first are dropped before the shuffle, so a
    key repeated in a third of all rows costs one row per partition.  Maps are compared as JSON.
    """
    when = F.col(at) if at in df.columns else F.lit(None).cast("timestamp")
    cols = [c for c in among if c != key]
    d = df.select(key, *cols, when.alias("_at"))
    comparable = lambda c: F.to_json(F.struct(c)) if "map<" in d.schema[c].dataType.simpleString() else F.col(c)
    w = Window.partitionBy(key).orderBy(F.col("_at").desc_nulls_last(), *[comparable(c).desc_nulls_last() for c in cols])
    return d.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(key, *cols)
