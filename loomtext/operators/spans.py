"""Spans over tokens: overlaps, islands, runs, conflict resolution."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from loomtext.functions.text import token_spans_udf
from loomtext.operators.windows import running_before


def span_tokens(spans: DataFrame, tokens: DataFrame, *keys: str) -> DataFrame:
    """Tokens that overlap a character span (t.start < end and t.end > start), per equal keys."""
    s, t = spans.alias("s"), tokens.alias("t")
    on = " and ".join([*(f"s.{k} = t.{k}" for k in keys), "t.start_pos < s.end_pos", "t.end_pos > s.start_pos"])
    return s.join(t, F.expr(on))


_FOUND = StructType([StructField(n, LongType()) for n in ("lo", "hi", "in_lo", "in_hi")])


@F.arrow_udf(ArrayType(_FOUND))
def _ranges(tokens: pa.Array, spans: pa.Array) -> pa.Array:
    """Per span (start_pos, end_pos) the places of the first and last token that overlap it, and of those inside it."""
    def side(x: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = x.flatten()
        n = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        return n, *(flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start_pos", "end_pos"))

    n, start, end = side(tokens)
    k, a, b = side(spans)
    first = np.cumsum(n) - n
    # Every text has positions of its own, so one search serves the batch; spans may reach over the text's ends.
    far = 2 + max([0, *(int(np.abs(x).max()) for x in (start, end, a, b) if len(x))])
    of, off = np.repeat(np.arange(len(n)), n) * 4 * far, np.repeat(np.arange(len(k)), k) * 4 * far
    start, end, a, b, base = start + of, end + of, a + off, b + off, np.repeat(first, k)
    lo, hi = np.searchsorted(end, a, "right") - base, np.searchsorted(start, b, "left") - 1 - base
    in_lo, in_hi = np.searchsorted(start, a, "left") - base, np.searchsorted(end, b, "right") - 1 - base
    found = pa.StructArray.from_arrays([pa.array(x, pa.int64(), mask=y) for x, y in ((lo, hi < lo), (hi, hi < lo), (in_lo, in_hi < in_lo), (in_hi, in_hi < in_lo))], names=_FOUND.names)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(k))), pa.int32()), found)


def text_spans(docs: DataFrame, doc_id: str, text: str, spans: Column) -> DataFrame:
    """doc_id, no, lo, hi, in_lo, in_hi, prev: every span of a text with its tokens, found inside the row.

    ``spans``: a list of (no, start_pos, end_pos), integers, in the order of no.  ``lo`` and ``hi`` are the first and last
    token that overlap the span as in ``span_tokens``, ``in_lo`` and ``in_hi`` those wholly inside it, ``prev`` the
    ``in_hi`` of the span before; null without such a token.  Nothing is shuffled or broadcast, and the work grows
    with tokens plus spans, not with their product.  A row that stands twice gives its spans twice.
    """
    d = docs.select(doc_id, spans.alias("_s"), _ranges(token_spans_udf(text), spans).alias("_r"))
    at = F.transform("_s", lambda s, i: F.struct(s.no.alias("no"), F.get("_r", i).alias("r"), F.get("_r", i - 1).in_hi.alias("prev")))
    return d.select(doc_id, F.explode(at).alias("x")).select(doc_id, "x.no", "x.r.*", "x.prev")


#: Positions per bucket of a key's spans.
WIDTH = 4096


def overlap_components(spans: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """``spans`` with component number per key: spans that overlap, directly or through others.

    ``lo`` and ``hi`` are inclusive.  The largest end so far and the number of components so far are taken per bucket
    of positions with what earlier buckets carry, so a key with very many spans spreads over tasks.
    """
    d = spans.withColumn("_b", F.floor(F.col(lo) / WIDTH)).withColumn("_o", F.struct(lo, hi))
    d = running_before(d, keys, "_b", "_o", hi, F.max, F.greatest, "_before")
    d = d.withColumn("_new", F.when(F.col("_before").isNull() | (F.col(lo) > F.col("_before")), 1).otherwise(0))
    # Of equal spans the one that opens the component stands first.
    d = d.withColumn("_o", F.struct(F.col(lo), F.col(hi), (1 - F.col("_new")).alias("later")))
    d = running_before(d, keys, "_b", "_o", "_new", F.sum, lambda x, y: x + y, "_n")
    return d.withColumn("component", F.coalesce("_n", F.lit(0)) + F.col("_new")).drop("_b", "_o", "_before", "_new", "_n")


def runs(items: DataFrame, keys: list[str], idx: str) -> DataFrame:
    """keys, lo, hi, n: maximal runs of consecutive indices."""
    d = items.select(*keys, idx).distinct()
    w = Window.partitionBy(*keys).orderBy(idx)
    g = d.withColumn("_g", F.col(idx) - F.row_number().over(w))
    return g.groupBy(*keys, "_g").agg(F.min(idx).alias("lo"), F.max(idx).alias("hi"), F.count(F.lit(1)).alias("n")).drop("_g")


# Priority of mapping methods, best first match.
def method_priority(method: str):
    m = F.col(method)
    return (
        F.when(m.startswith("explicit-semantic-"), 4)
        .when(m == "explicit-source-anchor-2026-09-08", 3)
        .when(m.isin("supplied-chinese-parallel-table", "parallel-sanskrit:character-sequence"), 2)
        .otherwise(1)
    )


def resolve_overlaps(spans: DataFrame, provider: str = "dharmanexus-target:") -> DataFrame:
    """Outcome of overlapping spans of units in a witness.

    ``spans``: passage_id, source_id, unit_id, ord (place among the passage's
    units), number, lo, hi (inclusive), method.  Adds lo, hi after resolution,
    ``group_id`` (shared spans) and ``status``: 'kept', 'shared' (identical
    spans, or neighbouring units all from the provider: the union is shared), or
    'withheld' (a worse method, or a tie at the best one).
    """
    keys = ["passage_id", "source_id"]
    c = overlap_components(spans, keys, "lo", "hi")
    g = [*keys, "component"]
    p = method_priority("method")
    c = c.withColumn("_p", p)
    agg = c.groupBy(*g).agg(
        F.count(F.lit(1)).alias("_n"), F.min("lo").alias("_lo"), F.max("hi").alias("_hi"), F.min("ord").alias("_a"), F.max("ord").alias("_b"),
        F.max("lo").alias("_maxlo"), F.min("hi").alias("_minhi"), F.min(F.col("method").startswith(provider)).alias("_prov"),
        F.max("_p").alias("_best"), F.min_by("number", "ord").alias("_first"))
    tops = c.join(agg.select(*g, F.col("_best").alias("_bb")), g).where("_p = _bb").groupBy(*g).agg(F.count(F.lit(1)).alias("_ntop"))
    r = c.join(agg, g).join(tops, g)
    same = (F.col("_lo") == F.col("_maxlo")) & (F.col("_hi") == F.col("_minhi"))
    adjacent = (F.col("_b") - F.col("_a") + 1) == F.col("_n")
    shared = (F.col("_n") > 1) & (same | (adjacent & F.col("_prov")))
    status = F.when(F.col("_n") == 1, "kept").when(shared, "shared").when((F.col("_p") == F.col("_best")) & (F.col("_ntop") == 1), "kept").otherwise("withheld")
    return r.withColumn("status", status).select(
        *keys, "unit_id", "ord", "number", "method", F.when(F.col("status") == "shared", F.col("_lo")).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("status") == "shared", F.col("_hi")).otherwise(F.col("hi")).alias("hi"), "status",
        F.when(F.col("status") == "shared", F.concat(F.lit("shared-"), "source_id", F.lit("-"), "_first")).alias("group_id"))


def shared_groups(targets: DataFrame) -> DataFrame:
    """group_id, tokens, n, first_ord: members of one group with identical token lists, at least two."""
    return targets.groupBy("group_id", "tokens").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord")).where("n > 1 and group_id is not null")
