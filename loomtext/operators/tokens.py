"""Tokens with stable offsets: the base relation of all corpus analytics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import analysis_form_udf, composed_udf, kwic, token_spans_udf, tokens


def token_forms(docs: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, idx, surface, norm: one row per token, without offsets (no shuffle)."""
    return docs.select(*keys, F.posexplode(tokens(F.col(text))).alias("idx", "surface")).withColumn("norm", F.lower("surface"))


def token_offsets(docs: DataFrame, doc_id: str, text: str, *keys: str) -> DataFrame:
    """doc_id, keys, idx, surface, norm, start_pos, end_pos, label.

    Positions are found inside the row, so nothing is shuffled.  ``label`` marks
    tokens of a number label at a line's start.  Null and empty texts have no token.
    """
    t = docs.select(doc_id, *keys, F.posexplode(token_spans_udf(F.col(text))).alias("idx", "t"))
    return t.select(doc_id, *keys, F.col("idx").cast("bigint").alias("idx"), "t.surface", F.lower("t.surface").alias("norm"), "t.start_pos", "t.end_pos", "t.label")


def token_id(passage: str, source: str, idx: str):
    """'{passage}-{source}-t00001', counted from 1."""
    return F.format_string("%s-%s-t%05d", F.col(passage), F.col(source), F.col(idx) + 1)


def form_frequency(docs: DataFrame, text: str, passage: str) -> DataFrame:
    """form, n, n_passages, surface, first_passage: every form in compatibility normalisation, lower case, trimmed.

    ``surface`` is the first spelling met, in the order of passages (null first) and spellings.  Spellings
    are counted first and each distinct one is normalised once.  Empty forms are dropped.
    """
    per = token_forms(docs, text, passage).groupBy(F.col("surface"), F.col(passage).alias("passage")).agg(F.count(F.lit(1)).alias("k"))
    per = per.withColumn("form", analysis_form_udf("surface")).where("form <> ''")
    return per.groupBy("form").agg(
        F.sum("k").alias("n"), F.count_distinct("passage").alias("n_passages"),
        F.min_by("surface", F.struct("passage", "surface")).alias("surface"), F.min_by("passage", F.struct("passage", "surface")).alias("first_passage"))


def witness_statistics(docs: DataFrame, source: str, unit: str, text: str) -> DataFrame:
    """Per source: tokens, unique forms, units with a token, type-token ratio, tokens per unit.

    Sources without any token are kept with zeros.
    """
    t = token_forms(docs, text, source, unit)
    # Partial counts per form and unit travel, not tokens.
    per = t.groupBy(source, unit, "norm").agg(F.count(F.lit(1)).alias("k"))
    forms = per.groupBy(source, "norm").agg(F.sum("k").alias("k")).groupBy(source).agg(F.sum("k").alias("tokens"), F.count(F.lit(1)).alias("unique_forms"))
    units = per.select(source, unit).distinct().where(F.col(unit).isNotNull()).groupBy(source).agg(F.count(F.lit(1)).alias("units"))
    base = docs.select(source).distinct()
    j = base.join(forms, source, "left").join(units, source, "left").na.fill(0, ["tokens", "unique_forms", "units"])
    ratio = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.round(F.col(a) / F.col(b), 6))
    return j.select(source, "tokens", "unique_forms", "units", ratio("unique_forms", "tokens").alias("ttr"), ratio("tokens", "units").alias("tokens_per_unit"))


def concordance(docs: DataFrame, doc_id: str, text: str, form: str) -> DataFrame:
    """Every occurrence of a form with its left and right context."""
    hit = docs.where(F.lower(text).contains(form))  # cheap filter at the scan
    t = token_offsets(hit, doc_id, text).where(F.col("norm") == form)
    left, right = kwic(F.col(text), F.col("start_pos"), F.col("end_pos"))
    return t.join(hit.select(doc_id, text), doc_id).select(doc_id, "idx", "start_pos", left.alias("left_context"), "surface", right.alias("right_context"))


SIZES = (1, 3, 5, 9, 17)


def unique_context_pairs(old: DataFrame, new: DataFrame, key: str, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """key, old_idx, new_idx: tokens re-anchored by n-grams unique on both sides.

    ``old`` and ``new``: key, idx, norm.  Pairs voted for by any window size are
    kept only where neither side has another partner.
    """
    side = lambda d, n: d.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "norm"))).alias(n))
    j = side(old, "o").join(side(new, "n"), key)
    words = lambda c: F.transform(c, lambda x: x.norm)
    at = lambda c: F.transform(c, lambda x: x.idx)
    p = context_pairs(j.select(key, words("o").alias("before"), words("n").alias("after")), key, sizes)
    p = p.join(j.select(key, at("o").alias("oi"), at("n").alias("ni")), key)
    return p.select(key, F.get("oi", F.col("old_idx").cast("int")).alias("old_idx"), F.get("ni", F.col("new_idx").cast("int")).alias("new_idx"))


def _windows(ids: np.ndarray, doc: np.ndarray, size: int, made: dict[int, np.ndarray]) -> np.ndarray:
    """A number for the window of ``size`` words at each place (equal numbers: equal windows); -1 over a text's end.

    Windows are put together from two shorter ones, so numbers are exact.
    """
    if size not in made:
        half = size // 2 if size % 2 == 0 else size - 1
        a, b = _windows(ids, doc, half, made), _windows(ids, doc, size - half, made)
        out = np.full(len(ids), -1, np.int64)
        n = len(ids) - half
        if n > 0:
            ok = np.flatnonzero((a[:n] >= 0) & (b[half:] >= 0) & (doc[:n] == doc[half:]))
            if len(ok):
                out[ok] = np.unique(a[ok] * (int(b.max()) + 1) + b[ok + half], return_inverse=True)[1]
        made[size] = out
    return made[size]


def match_contexts(before: list[list[str]], after: list[list[str]], sizes: tuple[int, ...] = SIZES) -> list[tuple[int, int, int]]:
    """(text, old place, new place) of the words of all texts that unique windows pair one to one."""
    texts = [*before, *after]
    vocab: dict[tuple[int, str], int] = {}
    n = sum(map(len, texts))
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    # A text and its new version share their numbers, no other text does.
    ids = np.fromiter((vocab.setdefault((k % max(1, len(before)), w), len(vocab)) for k, t in enumerate(texts) for w in t), np.int64, n)
    doc = np.repeat(np.arange(len(texts)), size)
    first = np.concatenate(([0], np.cumsum(size)))
    half = int(first[len(before)])
    made, votes = {1: ids}, []
    for s in sizes:
        w = _windows(ids, doc, s, made)
        live = np.flatnonzero(w >= 0)
        if not len(live):
            continue
        old, new = live[live < half], live[live >= half]
        top = int(w.max()) + 1
        c = np.bincount(w[old], minlength=top) == 1
        c &= np.bincount(w[new], minlength=top) == 1
        to = np.full(top, -1, np.int64)
        to[w[new]] = new
        at = old[c[w[old]]]
        for o in range(s):
            votes.append((at + o) * n + to[w[at]] + o)
    pairs = np.unique(np.concatenate(votes)) if votes else np.zeros(0, np.int64)
    a, b = pairs // max(1, n), pairs % max(1, n)
    ok = (np.bincount(a, minlength=n)[a] == 1) & (np.bincount(b, minlength=n)[b] == 1) if len(pairs) else np.zeros(0, bool)
    a, b = a[ok], b[ok]
    return list(zip(doc[a].tolist(), (a - first[doc[a]]).tolist(), (b - first[doc[b]]).tolist()))


def context_pairs(rows: DataFrame, key: str, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """key, old_idx, new_idx for ``rows`` (key, before, after: lists of words), without a shuffle.

    Null lists are empty, and a null word is a word of its own.
    """
    kind = rows.schema[key].dataType

    def run(batches):
        for b in batches:
            keys = b.column(0)
            lists = [[[w or "\0" for w in x or []] for x in b.column(i).to_pylist()] for i in (1, 2)]
            got = match_contexts(*lists, sizes)
            yield pa.record_batch([keys.take(pa.array([d for d, _, _ in got], pa.int64())), pa.array([i for _, i, _ in got], pa.int64()), pa.array([j for _, _, j in got], pa.int64())],
                                  names=[key, "old_idx", "new_idx"])

    return rows.select(key, "before", "after").mapInArrow(run, f"{key} {kind.simpleString()}, old_idx bigint, new_idx bigint")


def reanchor_texts(rows: DataFrame, key: str, before: str, after: str, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """key, old_idx, new_idx: tokens of an edited text found again by unique, exact context.

    Words are compared in composed form (NFC), case included; tokens of number labels take no part.  Repeated
    or conflicting contexts stay unresolved.  Null texts have no tokens.
    """
    plain = lambda c: F.filter(F.transform(token_spans_udf(F.col(c)), lambda t, i: F.struct(i.alias("i"), t.surface.alias("w"), t.label.alias("label"))), lambda t: ~t.label)
    r = rows.select(key, plain(before).alias("o"), plain(after).alias("n"))
    # Words are joined by a control character to be composed in one call, and cut again.
    nfc = lambda c: F.when(F.size(c) > 0, F.split(composed_udf(F.array_join(F.transform(c, lambda t: t.w), "\1")), "\1"))
    at = lambda c: F.transform(c, lambda t: t.i)
    r = r.select(F.struct(key, at("o").alias("oi"), at("n").alias("ni")).alias("k"), nfc("o").alias("before"), nfc("n").alias("after"))
    p = context_pairs(r, "k", sizes)
    return p.select(f"k.{key}", F.get("k.oi", F.col("old_idx").cast("int")).alias("old_idx"), F.get("k.ni", F.col("new_idx").cast("int")).alias("new_idx"))
