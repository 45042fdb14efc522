"""Alignment engines: matching blocks, edition transfer, embeddings, greedy choice, root detection."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.text import letters_key, token_spans_udf


def _stream(words: list[str]) -> tuple[str, list[int]]:
    keys = ["" if k == "vvs" else k for k in map(letters_key, words)]  # verse markers are skipped
    return "".join(keys), [i for i, k in enumerate(keys) for _ in k]


def _mapping(a: str, b: str) -> dict[int, int]:
    to: dict[int, int] = {}
    for x, y, n in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
        to.update((x + i, y + i) for i in range(n))
    return to


def matching_tokens(pairs: DataFrame, key: str) -> DataFrame:
    """key, a_idx, b_idx: tokens of two editions joined by matching blocks of their character streams.

    ``pairs``: key, a_tokens, b_tokens (arrays).  A token pairs if all its
    characters map to consecutive ones and both keys are equal.  Row-wise and
    Arrow-batched; a pair of editions of one passage is compared in memory.
    """
    t = pairs.schema[key].dataType.simpleString()

    def run(batches):
        for df in batches:
            rows = []
            for k, a, b in zip(df[key], df["a_tokens"], df["b_tokens"]):
                if a is None or b is None:
                    continue
                sa, oa = _stream(list(a))
                sb, ob = _stream(list(b))
                to = _mapping(sa, sb)
                first = {}
                for pos, i in enumerate(oa):
                    first.setdefault(i, pos)
                for i, p in first.items():
                    w = letters_key(a[i])
                    at = [to.get(p + j) for j in range(len(w))]
                    if None in at or at != list(range(at[0], at[0] + len(w))):
                        continue
                    j = ob[at[0]]
                    if letters_key(b[j]) == w:
                        rows.append((k, i, j))
            yield pd.DataFrame(rows, columns=[key, "a_idx", "b_idx"])

    return pairs.select(key, "a_tokens", "b_tokens").mapInPandas(run, f"{key} {t}, a_idx bigint, b_idx bigint")


def transfer_ratio(pairs: DataFrame, key: str) -> DataFrame:
    """key, ratio, density, accepted: how much of a's characters b holds, and how densely.

    Accepted at .90 matched, both ends mapped, .85 of the target span matched.
    """
    t = pairs.schema[key].dataType.simpleString()

    def run(batches):
        for df in batches:
            rows = []
            for k, a, b in zip(df[key], df["a_tokens"], df["b_tokens"]):
                sa, _ = _stream(list(a) if a is not None else [])
                sb, _ = _stream(list(b) if b is not None else [])
                to = _mapping(sa, sb)
                ratio = len(to) / len(sa) if sa else 0.0
                ends = bool(sa) and 0 in to and len(sa) - 1 in to
                density = len(to) / (to[len(sa) - 1] - to[0] + 1) if ends else 0.0
                rows.append((k, round(ratio, 4), round(density, 4), ratio >= 0.90 and ends and density >= 0.85))
            yield pd.DataFrame(rows, columns=[key, "ratio", "density", "accepted"])

    return pairs.select(key, "a_tokens", "b_tokens").mapInPandas(run, f"{key} {t}, ratio double, density double, accepted boolean")


def edition_transfer(pairs: DataFrame, key: str) -> DataFrame:
    """key, unit_id, lo, hi, ratio: spans of one edition carried to another of the same language.

    ``pairs``: key, a_tokens, b_tokens, units (array of struct unit_id, idxs over a_tokens).  At least .90 of a
    unit's characters are mapped, its first and last among them, they fill .85 of the target span, and the
    span's ends cut no token.  ``lo`` and ``hi`` (inclusive) count b_tokens.
    """
    t = pairs.schema[key].dataType.simpleString()

    def run(batches):
        for df in batches:
            rows = []
            for k, a, b, units in zip(df[key], df["a_tokens"], df["b_tokens"], df["units"]):
                if a is None or b is None or units is None:
                    continue
                (sa, oa), (sb, ob) = _stream(list(a)), _stream(list(b))
                to = _mapping(sa, sb)
                for u in units:
                    own = set(u["idxs"]) if u["idxs"] is not None else set()
                    at = [i for i, o in enumerate(oa) if o in own]
                    hit = [to[i] for i in at if i in to]
                    if not hit or len(hit) / len(at) < 0.90 or at[0] not in to or at[-1] not in to:
                        continue
                    lo, hi = min(hit), max(hit)
                    whole = not (lo and ob[lo - 1] == ob[lo]) and not (hi + 1 < len(ob) and ob[hi + 1] == ob[hi])
                    if len(hit) / (hi - lo + 1) >= 0.85 and whole:
                        rows.append((k, u["unit_id"], ob[lo], ob[hi], round(len(hit) / len(at), 4)))
            yield pd.DataFrame(rows, columns=[key, "unit_id", "lo", "hi", "ratio"])

    return pairs.select(key, "a_tokens", "b_tokens", "units").mapInPandas(run, f"{key} {t}, unit_id string, lo bigint, hi bigint, ratio double")


def token_candidates(pairs: DataFrame, key: str, source: str) -> DataFrame:
    """key, idx, targets: tokens of a base edition with the equal tokens of other editions.

    ``pairs``: key, source, a_tokens (the base), b_tokens (the other source).  All characters of a base token
    must map to consecutive ones, and the tokens they fill must spell the same.  ``targets``: map of source to
    the first and last token.  A token that no other source holds is no candidate.
    """
    t, u = pairs.schema[key].dataType.simpleString(), pairs.schema[source].dataType.simpleString()

    def run(batches):
        for df in batches:
            rows = []
            for k, src, a, b in zip(df[key], df[source], df["a_tokens"], df["b_tokens"]):
                if a is None or b is None:
                    continue
                (sa, oa), (sb, ob) = _stream(list(a)), _stream(list(b))
                to, first = _mapping(sa, sb), {}
                for pos, i in enumerate(oa):
                    first.setdefault(i, pos)
                for i, p in first.items():
                    w = letters_key(a[i])
                    at = [to.get(p + j) for j in range(len(w))]
                    if None in at or at != list(range(at[0], at[0] + len(w))):
                        continue
                    lo, hi = ob[at[0]], ob[at[-1]]
                    if "".join(letters_key(x) for x in b[lo:hi + 1]) == w:
                        rows.append((k, src, i, lo, hi))
            yield pd.DataFrame(rows, columns=[key, source, "idx", "lo", "hi"])

    m = pairs.select(key, source, "a_tokens", "b_tokens").mapInPandas(run, f"{key} {t}, {source} {u}, idx bigint, lo bigint, hi bigint")
    return m.groupBy(key, "idx").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(source, F.struct("lo", "hi"))))).alias("targets"))


def best_disjoint_pivot(targets: DataFrame, pivots: DataFrame, group: str, least: float = 0.80, margin: float = 0.08, shrink: float = 0.04) -> DataFrame:
    """id, pivot, units, score, margin: the suggestion for each target that a pivot of its group clearly renders.

    ``targets``: id, group, vec; ``pivots``: id, group, units (array), vec.  The best pivot by cosine needs ``least``,
    and ``margin`` over the best one that shares no unit with it (an overlapping group is another boundary, no
    other meaning).  Then the smallest pivot within its units and ``shrink`` of its score is taken; ties go to
    the higher score, then the smaller id.
    """
    dot = "aggregate(zip_with({0}, {1}, (x, y) -> cast(x as double) * y), 0D, (s, v) -> s + v)"
    norm = lambda d, *c: d.select("id", group, *c, "vec", F.expr("sqrt(" + dot.format("vec", "vec") + ")").alias("len"))
    x, y = norm(targets).alias("x"), norm(pivots, "units").alias("y")
    s = x.join(y, F.expr(f"x.{group} = y.{group}")).select(
        F.col("x.id").alias("id"), F.col("y.id").alias("pivot"), "y.units", F.expr(dot.format("x.vec", "y.vec") + " / (x.len * y.len)").alias("score"))
    best = s.groupBy("id").agg(F.max_by(F.struct("pivot", "units", "score"), F.struct("score", -F.col("pivot"))).alias("b")).where(F.col("b.score") >= least)
    j = s.join(best, "id")
    apart = ~F.arrays_overlap("units", "b.units")
    inside = (F.col("score") >= F.col("b.score") - shrink) & (F.size(F.array_except("units", "b.units")) == 0)
    g = j.groupBy("id").agg(
        F.first("b").alias("b"), F.coalesce(F.max(F.when(apart, F.col("score"))), F.lit(0.0)).alias("other"),
        F.min(F.when(inside, F.struct(F.size("units").alias("n"), (-F.col("score")).alias("s"), "pivot", "units"))).alias("m"))
    gap = F.col("b.score") - F.col("other")
    return g.where(gap >= margin).select("id", "m.pivot", "m.units", F.round("b.score", 6).alias("score"), F.round(gap, 6).alias("margin"))


def choose_suggestions(proposals: DataFrame, anchors: DataFrame, group: str) -> DataFrame:
    """Proposals chosen by falling score inside each group (a passage in one witness).

    ``proposals``: group, id, lo, hi (tokens, inclusive), units (array of places), score; ``anchors``: group, unit
    (place), lo, hi of what is assigned already.  No token and no unit is used twice, and a proposal must
    not cross an anchor: an earlier unit's tokens stand before it, a later one's behind it.  Ties go to the smaller id.
    """
    kind = proposals.schema[group].dataType.simpleString()

    def run(key, p: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        tokens, units, keep = set(), set(), []
        fixed = list(zip(a["unit"], a["lo"], a["hi"]))
        for r in p.sort_values(["score", "id"], ascending=[False, True]).itertuples():
            own, at = set(range(r.lo, r.hi + 1)), set(r.units)
            if own & tokens or at & units:
                continue
            if any((u < min(at) and lo > r.hi) or (u > max(at) and hi < r.lo) for u, lo, hi in fixed):
                continue
            tokens |= own
            units |= at
            keep.append((getattr(r, group), r.id))
        return pd.DataFrame(keep, columns=[group, "id"])

    p = proposals.select(group, "id", "lo", "hi", "units", "score")
    chosen = p.groupBy(group).cogroup(anchors.select(group, "unit", "lo", "hi").groupBy(group)).applyInPandas(run, f"{group} {kind}, id {p.schema['id'].dataType.simpleString()}")
    return proposals.join(chosen, [group, "id"], "left_semi")


def best_match_margin(a: DataFrame, b: DataFrame, group: str, least: float = 0.80, margin: float = 0.08) -> DataFrame:
    """a_id, b_id, score, margin, accepted: best partner by cosine within an equal group.

    ``a``, ``b``: id, group, vec.  The margin is over the second best; ties go to
    the smaller id.  Only vectors of one group are compared.
    """
    dot = "aggregate(zip_with({0}, {1}, (x, y) -> cast(x as double) * y), 0D, (s, v) -> s + v)"
    norm = lambda d: d.select("id", group, "vec", F.expr("sqrt(" + dot.format("vec", "vec") + ")").alias("len"))
    x, y = norm(a).alias("x"), norm(b).alias("y")
    s = x.join(y, F.expr(f"x.{group} = y.{group} and x.id <> y.id")).select(
        F.col("x.id").alias("a_id"), F.col("y.id").alias("b_id"), F.expr(dot.format("x.vec", "y.vec") + " / (x.len * y.len)").alias("score"))
    w = Window.partitionBy("a_id").orderBy(F.desc("score"), "b_id")
    r = s.withColumn("rank", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).where("rank = 1")
    m = F.col("score") - F.coalesce("second", F.lit(0.0))
    return r.select("a_id", "b_id", F.round("score", 6).alias("score"), F.round(m, 6).alias("margin"), ((F.col("score") >= least) & (m >= margin)).alias("accepted"))


def greedy_pairs(scores: DataFrame, group: str) -> DataFrame:
    """One-to-one choice by falling score inside each group; neither side is used twice.

    ``scores``: group, a_id, b_id, score.  Order: score, then ids.
    """
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "a_id", "b_id"], ascending=[False, True, True])
        used_a, used_b, keep = set(), set(), []
        for r in g.itertuples(index=False):
            d = r._asdict()
            if d["a_id"] not in used_a and d["b_id"] not in used_b:
                used_a.add(d["a_id"])
                used_b.add(d["b_id"])
                keep.append(r)
        return pd.DataFrame(keep, columns=g.columns)

    return scores.groupBy(group).applyInPandas(run, scores.schema)


def _common(root: list[str], wit: list[str]) -> list[int]:
    """Places of ``wit`` on a longest common subsequence; on a tie the root's word is skipped."""
    number: dict[str, int] = {}
    r = np.array([number.setdefault(w, len(number)) for w in root], np.int64)
    w = np.array([number.setdefault(x, len(number)) for x in wit], np.int64)
    m = np.zeros((len(r) + 1, len(w) + 1), np.int32)
    for i, x in enumerate(r, 1):  # one vector step per word of the root
        m[i, 1:] = np.maximum.accumulate(np.where(w == x, m[i - 1, :-1] + 1, m[i - 1, 1:]))
    i, j, got = len(r), len(w), []
    while i and j:
        if r[i - 1] == w[j - 1]:
            got.append(j - 1)
            i, j = i - 1, j - 1
        elif m[i - 1, j] >= m[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return got[::-1]


def lcs_tokens(pairs: DataFrame, key: str) -> DataFrame:
    """key, witness_idx: witness tokens that hold the root's wording.

    ``pairs``: key, root, witness (arrays of normalised forms), and, if verses are marked, verse (its number as
    text) and marker (place of the first token that is this number before a '||', null without one).  Only the
    tokens before the marker are searched, the number at the root's end is left out, and the marker's token is
    added.  On a tie the root token is skipped.  A root and a witness of one passage are compared in memory.
    """
    t = pairs.schema[key].dataType.simpleString()
    marked = "marker" in pairs.columns

    def run(batches):
        for df in batches:
            rows = []
            for n, (k, root, wit) in enumerate(zip(df[key], df["root"], df["witness"])):
                root, wit = list(root) if root is not None else [], list(wit) if wit is not None else []
                marker = df["marker"].iloc[n] if marked else None
                verse = df["verse"].iloc[n] if marked else None
                if verse is not None and root and root[-1] == verse:
                    root = root[:-1]
                at = int(marker) if marker is not None and marker == marker else None
                rows += [(k, j) for j in _common(root, wit if at is None else wit[:at])] + ([(k, at)] if at is not None else [])
            yield pd.DataFrame(rows, columns=[key, "witness_idx"])

    return pairs.select(key, "root", "witness", *(["verse", "marker"] if marked else [])).mapInPandas(run, f"{key} {t}, witness_idx bigint")


def verse_marker(text: str, verse: str):
    """0-based place of the first token that is the verse's number and stands before '||', or null."""
    t = F.transform(token_spans_udf(F.col(text)), lambda x, i: F.struct(i.alias("i"), x.surface.alias("w"), x.end_pos.alias("e")))
    hit = F.filter(t, lambda x: (x.w == F.col(verse)) & F.substring(F.col(text), (x.e + 1).cast("int"), F.lit(8)).rlike(r"^\s*\|\|"))
    return F.get(hit, 0).i
