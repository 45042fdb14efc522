"""Anchoring units in witnesses: assigning spans, carrying them over, and the whole repair of an alignment.

Targets are rows (passage, unit_id, number, ord, source, token_ids, text, method, ratio, group_id, review); a
witness is a row with its tokens as in ``effective.witnesses``.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from loomtext.operators.align import edition_transfer
from loomtext.operators.effective import gathered
from loomtext.operators.spans import resolve_overlaps
from loomtext.operators.transfer import parallel_spans, table_spans
from loomtext.session import cut

TARGET = "passage string, unit_id string, number string, ord bigint, source string, token_ids array<string>, text string, method string, ratio double, group_id string, review string"
COLUMNS = [c.split()[0] for c in TARGET.split(", ")]
_KEY = ["passage", "unit_id", "source"]
PHRASE = "explicit-source-anchor-2026-09-08"

_AT = ["passage", "source"]
_RANGE = StructType([StructField("lo", IntegerType()), StructField("hi", IntegerType())])


@F.arrow_udf(ArrayType(ArrayType(IntegerType())))
def _positions(lists: pa.Array, known: pa.Array) -> pa.Array:
    """Places of each list's ids among the known ones, in order; unknown ids are passed over."""
    out = []
    for ids, tokens in zip(lists.to_pylist(), known.to_pylist()):
        at = {t: i for i, t in enumerate(tokens or [])}
        out.append([sorted({at[x] for x in n or () if x in at}) for n in ids or ()])
    return pa.array(out, pa.list_(pa.list_(pa.int32())))


@F.arrow_udf(ArrayType(_RANGE))
def _touched(wanted: pa.Array, text: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    """First and last token that the only place of each wording in the text touches; nulls if there is none or a second."""
    out = []
    for needles, t, start, end in zip(wanted.to_pylist(), text.to_pylist(), starts.to_pylist(), ends.to_pylist()):
        places = []
        for n in needles or ():
            lo, hi = 0, -1
            if n and t and t.count(n) == 1:
                a = t.index(n)
                lo, hi = bisect_right(end, a), bisect_left(start, a + len(n)) - 1
            places.append({"lo": lo, "hi": hi} if lo <= hi else {"lo": None, "hi": None})
        out.append(places)
    return pa.array(out, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))


def _beside(rows: DataFrame, witnesses: DataFrame) -> DataFrame:
    """One row per witness: passage, source, rows (a list), and _t, _ids, _a, _b: the text, its tokens' ids, starts and ends."""
    w = witnesses.select(*_AT, F.col("text").alias("_t"), F.col("tokens.id").alias("_ids"), F.col("tokens.start_pos").alias("_a"), F.col("tokens.end_pos").alias("_b"))
    return gathered(rows, _AT).join(w, _AT, "left")


def _each(beside: DataFrame, columns: list[str], **more) -> DataFrame:
    """The rows again, with ``more`` (functions of a row and its place) taken before the list is exploded, so that a witness stands once."""
    x = F.transform("rows", lambda r, i: F.struct(r.alias("r"), *[f(r, i).alias(n) for n, f in more.items()]))
    return beside.select(*_AT, F.explode(x).alias("x")).select(*[f"x.r.{c}" if c not in _AT else c for c in columns], *[f"x.{n}" for n in more])


def _text_between(lo: Column, hi: Column) -> Column:
    a, b = F.get("_a", lo), F.get("_b", hi)
    return F.substring(F.col("_t"), (a + 1).cast("int"), (b - a).cast("int"))


def _placed(rows: DataFrame, witnesses: DataFrame) -> DataFrame:
    """``rows`` (passage, source, token_ids, and more) with _at (places of its tokens in the witness, in order), _own (their ids)
    and _text (from the first to the last); without any known token the lists are empty."""
    j = _beside(rows, witnesses)
    j = j.withColumn("_p", _positions(F.transform("rows", lambda r: r.token_ids), F.col("_ids")))
    return _each(j, rows.columns, _at=lambda r, i: F.get("_p", i), _own=lambda r, i: F.transform(F.get("_p", i), lambda k: F.get("_ids", k)),
                 _text=lambda r, i: _text_between(F.array_min(F.get("_p", i)), F.array_max(F.get("_p", i))))


def found_spans(wanted: DataFrame, witnesses: DataFrame) -> DataFrame:
    """``wanted`` (passage, source, wanted, and more) with token_ids of the only place where the text stands.

    Every token that the place touches counts.  A text that is empty, missing or stands several times has none.
    """
    j = _beside(wanted, witnesses)
    j = j.withColumn("_p", _touched(F.transform("rows", lambda r: r.wanted), F.col("_t"), F.col("_a"), F.col("_b")))
    lo, hi = lambda i: F.get("_p", i).lo, lambda i: F.get("_p", i).hi
    ids = lambda r, i: F.when(lo(i).isNotNull(), F.slice("_ids", lo(i) + 1, hi(i) - lo(i) + 1)).otherwise(F.array().cast("array<string>"))
    return _each(j, [*_AT, *[c for c in wanted.columns if c not in _AT]], token_ids=ids)


def assigned(targets: DataFrame, new: DataFrame, witnesses: DataFrame, strict: bool = True) -> DataFrame:
    """``targets`` with the spans of ``new`` (passage, unit_id, number, ord, source, token_ids, method, ratio, group_id,
    review) in place of what their units had in the source.

    Tokens are put in the witness's order and the text runs from the first to the last.  A span without any known
    token is an error, or left out if not ``strict``.  Ratios have four places.  Of several new spans of a unit and
    source the last by method and tokens counts.
    """
    j = _placed(new, witnesses)
    known = F.size("_at") > 0
    if strict:
        name = F.concat_ws(" ", F.lit("empty anchor:"), "number", "source")
        j = j.where(F.when(known, F.lit(True)).otherwise(F.raise_error(name).cast("boolean")))
    else:
        j = j.where(known)
    j = _last(j)
    return targets.join(j.select(*_KEY), _KEY, "left_anti").select(*COLUMNS).unionByName(j.select(*COLUMNS))


def _last(placed: DataFrame) -> DataFrame:
    """Rows of ``_placed`` as targets of these tokens, of several of a unit and source the last."""
    j = placed.select("passage", "unit_id", "number", "ord", "source", F.col("_own").alias("token_ids"), F.col("_text").alias("text"), "method", F.round("ratio", 4).alias("ratio"), "group_id", "review")
    rest = [c for c in COLUMNS if c not in _KEY]
    return j.groupBy(*_KEY).agg(F.max_by(F.struct(*rest), F.struct("method", "token_ids")).alias("v")).select(*_KEY, "v.*")


def removed(targets: DataFrame, rejected: DataFrame) -> DataFrame:
    """``targets`` without those named by ``rejected`` (passage, number, source), with all they carried."""
    return targets.join(rejected.select("passage", "number", "source").distinct(), ["passage", "number", "source"], "left_anti")


def purged(targets: DataFrame, base: str, explicit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): spans that only a projection put there are dropped.

    The base witness stays, a span of a method that is no projection stays, and so does one named by ``explicit``
    (passage, number, source), which is marked as an explicit anchor.
    """
    e = explicit.select("passage", "number", "source").distinct().withColumn("_explicit", F.lit(True))
    j = targets.join(e, ["passage", "number", "source"], "left")
    named = F.coalesce("_explicit", F.lit(False))
    method = F.coalesce("method", F.lit(""))
    keep = (F.col("source") == base) | ((method != "") & ~method.contains("projection")) | named
    j = j.withColumn("method", F.when(named, "explicit-source-anchor-2026-09-07").otherwise(F.col("method")))
    return j.where(keep).select(*COLUMNS), j.where(~keep).select(*_KEY)


def _words() -> Column:
    return F.transform("tokens", lambda t: t.surface)


def _units_of(targets: DataFrame, source: str) -> DataFrame:
    return targets.where(F.col("source") == source).select("passage", "unit_id", "number", "ord", "token_ids")


def _ids_between(df: DataFrame, lo: str = "lo", hi: str = "hi") -> Column:
    return F.transform(F.slice("tokens", F.col(lo).cast("int") + 1, (F.col(hi) - F.col(lo) + 1).cast("int")), lambda t: t.id)


def carried_editions(targets: DataFrame, witnesses: DataFrame, base: str, editions: list[str], method: str = "parallel-sanskrit:character-sequence") -> DataFrame:
    """Spans of the base witness carried to other editions of the same language, as rows for ``assigned``."""
    b = witnesses.where(F.col("source") == base).select("passage", F.col("tokens").alias("bt"), _words().alias("a_tokens"))
    units = _units_of(targets, base).join(b.select("passage", "bt"), "passage")
    at = F.filter(F.transform("bt", lambda t, i: F.when(F.array_contains("token_ids", t.id), i)), lambda i: i.isNotNull())
    units = units.select("passage", "unit_id", "number", "ord", at.alias("idxs"))
    grouped = units.groupBy("passage").agg(F.collect_list(F.struct("unit_id", "idxs")).alias("units"))
    o = witnesses.where(F.col("source").isin(editions)).select("passage", "source", "tokens", _words().alias("b_tokens"))
    pairs = o.join(b, "passage").join(grouped, "passage").select(F.struct("passage", "source").alias("k"), "a_tokens", "b_tokens", "units")
    got = edition_transfer(pairs, "k").select("k.*", "unit_id", "lo", "hi", "ratio").join(o.select("passage", "source", "tokens"), ["passage", "source"])
    got = got.join(units.select("passage", "unit_id", "number", "ord"), ["passage", "unit_id"])
    return got.select("passage", "unit_id", "number", "ord", "source", _ids_between(got).alias("token_ids"), F.lit(method).alias("method"), "ratio", F.lit(None).cast("string").alias("group_id"), F.lit(None).cast("string").alias("review"))


def table_targets(targets: DataFrame, witnesses: DataFrame, cells: DataFrame, base: str, method: str = "supplied-chinese-parallel-table") -> DataFrame:
    """Spans that a supplied parallel table gives, as rows for ``assigned``.

    ``cells``: passage, cell, needle (wording of the base), texts (map source to text).  A cell's needle of at least 8 letters
    must be found in the base at .90 with both ends, filling .85 of its place.  Units of whose tokens the place
    holds .80 take the cell's span, if together they cover .85 of it; several units share it.  Where all of several
    units have explicit anchors, these finer ones stay.
    """
    b = witnesses.where(F.col("source") == base)
    place = table_spans(cells.select("passage", "cell", "needle").join(b.select("passage", _words().alias("words")), "passage"))
    place = place.join(b.select("passage", "tokens"), "passage")
    place = place.select("passage", "cell", "ratio", _ids_between(place).alias("c"))
    u = _units_of(targets, base).withColumnRenamed("token_ids", "u")
    j = place.join(u, "passage").withColumn("both", F.size(F.array_intersect("c", "u"))).where("both > 0 and both >= 0.80 * size(array_distinct(u))")
    cover = j.groupBy("passage", "cell").agg(F.size(F.array_intersect(F.flatten(F.collect_list("u")), F.first("c"))).alias("n"), F.first("c").alias("c"), F.count(F.lit(1)).alias("units"), F.min_by("number", "ord").alias("first"))
    ok = cover.where("n >= 0.85 * size(c)").select("passage", "cell", "units", "first")
    j = j.join(ok, ["passage", "cell"])
    wanted = cells.select("passage", "cell", F.explode("texts").alias("source", "wanted"))
    got = found_spans(wanted, witnesses).where(F.size("token_ids") > 0).join(j.select("passage", "cell", "unit_id", "number", "ord", "ratio", "units", "first"), ["passage", "cell"])
    had = targets.where(F.col("method").startswith("explicit-")).select(*_KEY, F.lit(1).alias("_finer"))
    got = got.join(had, _KEY, "left")
    finer = got.groupBy("passage", "cell", "source").agg(F.min(F.coalesce("_finer", F.lit(0))).alias("_all"))
    got = got.join(finer, ["passage", "cell", "source"]).where("not (units > 1 and _all = 1)")
    group = F.when(F.col("units") > 1, F.concat(F.lit("table-"), F.col("cell").cast("string"), F.lit("-"), "source"))
    return got.select("passage", "unit_id", "number", "ord", "source", "token_ids", F.lit(method).alias("method"), "ratio", group.alias("group_id"), F.lit(None).cast("string").alias("review"))


def _units(targets: DataFrame, units: DataFrame | None) -> DataFrame:
    """passage, unit_id, number, ord of ``units``, or if there are none given of the targets."""
    return (targets if units is None else units).select("passage", "unit_id", "number", "ord").distinct()


def _phrase_spans(targets: DataFrame, witnesses: DataFrame, anchors: DataFrame, units: DataFrame | None) -> DataFrame:
    """A row for every number of every phrase anchor: its columns, token_ids, group_id, unit_id, ord and problem (null if there is none)."""
    a = found_spans(anchors.withColumn("wanted", F.col("phrase")), witnesses)
    group = F.when(F.size("numbers") > 1, F.concat(F.lit("explicit-"), "source", F.lit("-"), F.col("numbers")[0]))
    a = a.withColumn("group_id", group).withColumn("number", F.explode("numbers")).join(_units(targets, units), ["passage", "number"], "left")
    return a.withColumn("problem", F.when(F.size("token_ids") == 0, "ambiguous or missing phrase").when(F.col("unit_id").isNull(), "unknown unit"))


def phrase_targets(targets: DataFrame, witnesses: DataFrame, anchors: DataFrame, method: str = PHRASE, units: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """Spans of explicit phrase anchors, as rows for ``assigned``.

    ``anchors``: passage, source, numbers (list), phrase, and seq where they have an order.  The phrase must stand exactly once
    and its numbers name units (else an error, or left out if not ``strict``, see ``phrase_problems``); several numbers share the
    span.  Of several anchors of a unit and source the last by seq and tokens counts.  ``units`` (passage, unit_id, number,
    ord) are those that may be named, else those that have a target.
    """
    a = _phrase_spans(targets, witnesses, anchors, units)
    if strict:
        a = a.where(F.when(F.col("problem").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat_ws(" ", F.concat("problem", F.lit(":")), "source", "number", "phrase")).cast("boolean")))
    else:
        a = a.where("problem is null")
    order = F.struct(*[c for c in ("seq", "token_ids") if c in a.columns])
    a = a.groupBy(*_KEY).agg(F.max_by(F.struct("number", "ord", "token_ids", "group_id"), order).alias("v")).select(*_KEY, "v.*")
    none = F.lit(None)
    return a.select("passage", "unit_id", "number", "ord", "source", "token_ids", F.lit(method).alias("method"), none.cast("double").alias("ratio"), "group_id", none.cast("string").alias("review"))


def phrase_problems(targets: DataFrame, witnesses: DataFrame, anchors: DataFrame, method: str = PHRASE, units: DataFrame | None = None) -> DataFrame:
    """passage, unit_id, source, method, reason of the numbers that ``phrase_targets`` leaves out; an unknown unit is null."""
    return _phrase_spans(targets, witnesses, anchors, units).where("problem is not null").select(*_KEY, F.lit(method).alias("method"), F.col("problem").alias("reason"))


def semantic_targets(targets: DataFrame, anchors: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Spans of semantic anchors (passage, source, numbers, token_ids, method), as drafts, as rows for ``assigned``."""
    a = anchors.select("passage", "source", "token_ids", "method", F.explode("numbers").alias("number")).join(_units(targets, units), ["passage", "number"])
    none = F.lit(None)
    return a.select("passage", "unit_id", "number", "ord", "source", "token_ids", "method", none.cast("double").alias("ratio"), none.cast("string").alias("group_id"), F.lit("draft-semantic-selection").alias("review"))


def without_overlaps(targets: DataFrame, witnesses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets, withheld) after overlapping spans of one witness are shared or withheld; see ``resolve_overlaps``.

    Groups are those of shared spans, earlier ones are given up.
    """
    j = _placed(targets, witnesses).where(F.size("_at") > 0)
    j = j.select(*COLUMNS, F.array_min("_at").alias("_lo"), F.array_max("_at").alias("_hi"))
    s = j.select(F.col("passage").alias("passage_id"), F.col("source").alias("source_id"), "unit_id", "ord", "number", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.coalesce("method", F.lit("")).alias("method"))
    r = resolve_overlaps(cut(s)).select(F.col("passage_id").alias("passage"), F.col("source_id").alias("source"), "unit_id", "lo", "hi", "status", F.col("group_id").alias("_group"))
    k = j.drop("_lo", "_hi").join(r, _KEY)
    kept = k.where("status <> 'withheld'").withColumn("group_id", F.when(F.col("status") == "shared", F.col("_group")))
    # Only places travel so far; the words of the outcome are taken from the witness again.
    rest = [c for c in COLUMNS if c not in ("token_ids", "text")]
    kept = _each(_beside(kept.select(*rest, "lo", "hi"), witnesses), rest, token_ids=lambda r, i: F.slice("_ids", r.lo + 1, r.hi - r.lo + 1), text=lambda r, i: _text_between(r.lo, r.hi))
    return kept.select(*COLUMNS), k.where("status = 'withheld'").select(*_KEY, "method", F.lit("overlap").alias("reason"))


def carried_translations(targets: DataFrame, witnesses: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """Spans carried between editions of one translation, as rows for ``assigned``.

    ``pairs``: (reference source, other source, 'Chinese' or other).  Chinese is compared by ideographs (.90, at
    least 5), others by letters (.94, at least 15).  A group of units with one span takes the other's span together,
    unless one of them has a span there already or the span overlaps any.
    """
    out = []
    units = targets.select("passage", "unit_id", "number", "ord")
    for ref, other, language in pairs:
        b = witnesses.where(F.col("source") == ref).select("passage", F.col("tokens").alias("bt"), F.col("text").alias("a_text"))
        o = witnesses.where(F.col("source") == other).select("passage", "tokens", F.col("text").alias("b_text"))
        t = _units_of(targets, ref).join(b, "passage")
        at = F.filter(F.transform("bt", lambda x, i: F.when(F.array_contains("token_ids", x.id), i)), lambda i: i.isNotNull())
        t = t.select("passage", "unit_id", "ord", at.alias("idxs")).where(F.size("idxs") > 0)
        g = t.groupBy("passage", "idxs").agg(F.collect_list("unit_id").alias("units"), F.min("ord").alias("ord"))
        there = targets.where(F.col("source") == other).select("passage", "unit_id", F.col("token_ids").alias("taken_ids"))
        busy = t.join(there.select("passage", "unit_id"), ["passage", "unit_id"], "left_semi").select("passage", "idxs").distinct()
        g = g.join(busy, ["passage", "idxs"], "left_anti")
        spans = g.groupBy("passage").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat_ws("\u0001", "units").alias("unit_id"), "idxs"))), lambda x: F.struct(x.unit_id.alias("unit_id"), x.idxs.alias("idxs"))).alias("spans"))
        taken = there.groupBy("passage").agg(F.flatten(F.collect_list("taken_ids")).alias("taken"))
        none = F.array().cast("array<string>")
        j = o.join(b, "passage").join(spans, "passage").join(taken, "passage", "left").withColumn("taken", F.coalesce("taken", none))
        occupied = F.filter(F.transform("tokens", lambda x, i: F.when(F.array_contains("taken", x.id), i)), lambda i: i.isNotNull())
        words = lambda c: F.transform(c, lambda x: x.surface)
        starts = lambda c: F.transform(c, lambda x: x.start_pos)
        p = j.select(F.col("passage").alias("key"), words("bt").alias("a_tokens"), words("tokens").alias("b_tokens"), "a_text", "b_text", starts("bt").alias("a_starts"), starts("tokens").alias("b_starts"), "spans", occupied.alias("occupied"))
        got = parallel_spans(p, language).select(F.col("key").alias("passage"), F.explode(F.split("unit_id", "\u0001")).alias("unit_id"), "lo", "hi", "ratio").join(o.select("passage", "tokens"), "passage")
        got = got.join(units.distinct(), ["passage", "unit_id"])
        out.append(got.select("passage", "unit_id", "number", "ord", F.lit(other).alias("source"), _ids_between(got).alias("token_ids"), F.lit("parallel-witness:character-sequence").alias("method"), "ratio",
                              F.lit(None).cast("string").alias("group_id"), F.lit("unreviewed-textual-match").alias("review")))
    return reduce(DataFrame.unionByName, out) if out else None


def suggested_targets(targets: DataFrame, witnesses: DataFrame, suggestions: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Spans of inspected, frozen suggestions, as rows for ``assigned``; one that does not fit any more is an error.

    ``suggestions``: passage, source, numbers, phrase, token_ids, method, score.  It must not overwrite a span, must still
    be found at exactly these tokens, and must overlap no other span.
    """
    s = suggestions.withColumnRenamed("token_ids", "_given").withColumn("_no", F.monotonically_increasing_id())
    s = found_spans(s.withColumn("wanted", F.col("phrase")), witnesses)
    there = targets.select("passage", "source", "number").distinct().withColumn("_there", F.lit(True))
    used = targets.select("passage", "source", F.explode("token_ids").alias("t")).distinct().withColumn("_used", F.lit(True))
    n = s.select("_no", "passage", "source", F.explode("numbers").alias("number")).join(there, ["passage", "source", "number"]).select("_no", "_there").distinct()
    o = s.select("_no", "passage", "source", F.explode("_given").alias("t")).join(used, ["passage", "source", "t"]).select("_no", "_used").distinct()
    s = s.join(n, "_no", "left").join(o, "_no", "left")
    problem = F.when(F.col("_there"), "overwrites an anchor").when(~F.col("token_ids").eqNullSafe(F.col("_given")), "stale").when(F.col("_used"), "overlaps another anchor")
    s = s.where(F.when(problem.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat_ws(" ", F.lit("suggestion"), problem, F.lit(":"), "source")).cast("boolean")))
    s = s.select("passage", "source", "token_ids", "method", "score", F.explode("numbers").alias("number")).join(_units(targets, units), ["passage", "number"])
    return s.select("passage", "unit_id", "number", "ord", "source", "token_ids", "method", F.col("score").alias("ratio"), F.lit(None).cast("string").alias("group_id"), F.lit("unreviewed-machine-suggestion").alias("review"))


def stamped(targets: DataFrame, witnesses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets, sources): texts taken anew from the tokens, and the sorted sources of every unit.

    A target without tokens, or with one that the witness does not have, is an error.
    """
    j = _placed(targets, witnesses)
    fits = F.coalesce((F.size("token_ids") > 0) & (F.size(F.array_distinct("token_ids")) == F.size("_at")), F.lit(False))
    j = j.where(F.when(fits, F.lit(True)).otherwise(F.raise_error(F.concat_ws(" ", F.lit("obsolete token ids:"), "number", "source")).cast("boolean")))
    out = _last(j).select(*COLUMNS)
    return out, out.groupBy("passage", "unit_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def repaired(targets: DataFrame, witnesses: DataFrame, base: str, *, editions: list[str] = (), cells: DataFrame | None = None, phrases: DataFrame | None = None, semantic: DataFrame | None = None,
             rejected: DataFrame | None = None, explicit: DataFrame | None = None, parallels: list[tuple[str, str, str]] = (), suggestions: DataFrame | None = None,
             units: DataFrame | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(targets, withheld, dropped): an alignment rebuilt from its source anchors.

    In this order: projected spans are dropped; related editions, the parallel table, phrase anchors and semantic
    anchors are assigned; rejected ones removed; overlaps resolved; parallel translations carried over; frozen
    suggestions imported; overlaps resolved again; everything stamped.  Steps without data are left out.
    Anchors may name any of ``units`` (passage, unit_id, number, ord), else any that had a target at first, even if all
    it had was dropped.  A phrase without its only place or its unit is an error, or withheld if not ``strict``.
    """
    spark = targets.sparkSession
    none = spark.createDataFrame([], "passage string, number string, source string")
    units = _units(targets, units)
    t, dropped = purged(targets.select(*COLUMNS), base, explicit if explicit is not None else none)
    steps = [
        lambda t: carried_editions(t, witnesses, base, list(editions)) if editions else None,
        lambda t: table_targets(t, witnesses, cells, base) if cells is not None else None,
        lambda t: phrase_targets(t, witnesses, phrases, units=units, strict=strict) if phrases is not None else None,
        lambda t: semantic_targets(t, semantic, units) if semantic is not None else None,
    ]
    for step in steps:
        new = step(t)
        if new is not None:
            t = cut(assigned(t, new, witnesses))
    if rejected is not None:
        t = removed(t, rejected)
    t, withheld = without_overlaps(cut(t), witnesses)
    t = cut(t)
    new = carried_translations(t, witnesses, list(parallels))
    if new is not None:
        t = cut(assigned(t, new, witnesses))
    if suggestions is not None:
        t = cut(assigned(t, suggested_targets(t, witnesses, suggestions, units), witnesses))
    t, again = without_overlaps(t, witnesses)
    out, _ = stamped(cut(t), witnesses)
    withheld = withheld.unionByName(again)
    if phrases is not None and not strict:
        withheld = phrase_problems(t, witnesses, phrases, units=units).unionByName(withheld)
    return out, withheld, dropped


def target_violations(targets: DataFrame, witnesses: DataFrame, candidates: DataFrame | None = None, language: int = 3) -> DataFrame:
    """unit_id, source, problem of every target that breaks a rule.

    'invalid token ids' (none, or unknown), 'duplicate token ids', 'noncontiguous' (a token between first and last is
    missing or out of order), 'text mismatch', 'projection retained', 'inconsistent group' (members with other tokens),
    'unmarked overlap' (a token of two units that do not share a group), and for candidates 'too few sources' (less than
    two, or of several languages by the first letters).
    """
    j = targets.join(witnesses.select("passage", "source", F.col("text").alias("_t"), "tokens"), ["passage", "source"], "left")
    ids = F.coalesce("token_ids", F.array().cast("array<string>"))
    known = F.coalesce(F.transform("tokens", lambda t: t.id), F.array().cast("array<string>"))
    j = j.withColumn("_ids", ids).withColumn("_known", known)
    valid = (F.size("_ids") > 0) & F.forall("_ids", lambda x: F.array_contains("_known", x))
    a = F.filter("tokens", lambda t: t.id == F.get("_ids", 0))[0].start_pos
    b = F.filter("tokens", lambda t: t.id == F.element_at("_ids", -1))[0].end_pos
    j = j.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    j = j.withColumn("_a", F.when(F.col("_valid"), a)).withColumn("_b", F.when(F.col("_valid"), b))
    run = F.transform(F.filter("tokens", lambda t: (t.start_pos >= F.col("_a")) & (t.end_pos <= F.col("_b"))), lambda t: t.id)
    text = F.substring(F.col("_t"), (F.col("_a") + 1).cast("int"), F.greatest(F.col("_b") - F.col("_a"), F.lit(0)).cast("int"))
    ok = F.col("_valid")
    problems = F.array(
        F.when(~ok, "invalid token ids"), F.when(ok & (F.size(F.array_distinct("_ids")) < F.size("_ids")), "duplicate token ids"), F.when(ok & (run != F.col("_ids")), "noncontiguous"),
        F.when(ok & ~F.col("text").eqNullSafe(text), "text mismatch"), F.when(F.coalesce("method", F.lit("")).contains("projection"), "projection retained"))
    one = j.select("unit_id", "source", F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))
    g = targets.where("group_id is not null").groupBy("passage", "source", "group_id").agg(F.count_distinct("token_ids").alias("n")).where("n > 1")
    groups = targets.join(g, ["passage", "source", "group_id"], "left_semi").select("unit_id", "source", F.lit("inconsistent group").alias("problem"))
    k = targets.select("passage", "source", "unit_id", "group_id", F.explode("token_ids").alias("t")).distinct()
    # A token is free of fault if one unit has it, or all that have it share one group.
    bad = k.groupBy("passage", "source", "t").agg(F.count_distinct("unit_id").alias("n"), F.count_distinct("group_id").alias("g"), F.count(F.when(F.col("group_id").isNull(), 1)).alias("free")).where("n > 1 and (free > 0 or g > 1)")
    over = k.join(bad.select("passage", "source", "t"), ["passage", "source", "t"], "left_semi").select("unit_id", "source", F.lit("unmarked overlap").alias("problem"))
    out = one.unionByName(groups).unionByName(over)
    if candidates is not None:
        c = candidates.groupBy("unit_id").agg(F.count_distinct("source").alias("n"), F.count_distinct(F.substring("source", 1, language)).alias("langs"), F.min("source").alias("source"))
        out = out.unionByName(c.where("n < 2 or langs > 1").select("unit_id", "source", F.lit("too few sources").alias("problem")))
    return out.distinct()


def inventory_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """source, token_id, change of words that differ between two releases' witnesses: 'lost', 'new', 'changed', 'duplicate'."""
    def words(d: DataFrame, name: str) -> DataFrame:
        t = d.select("source", "text", F.explode("tokens").alias("t"))
        t = t.select("source", F.col("t.id").alias("token_id"), F.expr("substring(text, cast(t.start_pos + 1 as int), cast(t.end_pos - t.start_pos as int))").alias("w"))
        return t.groupBy("source", "token_id").agg(F.min("w").alias(name), F.count(F.lit(1)).alias("n_" + name))

    j = words(before, "old").join(words(after, "now"), ["source", "token_id"], "full")
    change = F.when(F.coalesce("n_old", F.lit(0)) > 1, "duplicate").when(F.coalesce("n_now", F.lit(0)) > 1, "duplicate").when(F.col("now").isNull(), "lost").when(F.col("old").isNull(), "new").when(F.col("old") != F.col("now"), "changed")
    return j.select("source", "token_id", change.alias("change")).where("change is not null")


# Review status that targets of these methods must keep.
DRAFTS = {"multilingual-semantic-suggestion-v1": "unreviewed-machine-suggestion", "parallel-witness:character-sequence": "unreviewed-textual-match"}


def undeclared_drafts(targets: DataFrame) -> DataFrame:
    """unit_id, source, method of machine targets that do not say so."""
    due = F.lit(None).cast("string")
    for m, r in DRAFTS.items():
        due = F.when(F.col("method") == m, r).otherwise(due)
    return targets.where(due.isNotNull() & ~F.col("review").eqNullSafe(due)).select("unit_id", "source", "method")


def integration_changes(before: DataFrame, after: DataFrame, targets_before: DataFrame, targets_after: DataFrame) -> DataFrame:
    """passage, source, problem where an integration changed what was there: 'text', 'tokens' or 'targets' of known witnesses.

    Run on the result of integrating twice against once it shows whether the integration is idempotent (then any
    new witness is 'added').
    """
    def plain(d: DataFrame, n: str) -> DataFrame:
        return d.select("passage", "source", F.coalesce("text", F.lit("")).alias("t" + n), F.to_json("tokens").alias("k" + n))

    j = plain(before, "0").join(plain(after, "1"), ["passage", "source"], "full")
    p = F.when(F.col("t0").isNull(), "added").when(F.col("t1").isNull(), "lost").when(F.col("t0") != F.col("t1"), "text").when(F.col("k0") != F.col("k1"), "tokens")
    w = j.select("passage", "source", p.alias("problem")).where("problem is not null")
    a, b = targets_before.select(*_KEY, F.col("token_ids").alias("i0")), targets_after.select(*_KEY, F.col("token_ids").alias("i1"))
    t = a.join(b, _KEY, "left").where(~F.col("i0").eqNullSafe(F.col("i1"))).select("passage", "source", F.lit("targets").alias("problem")).distinct()
    return w.unionByName(t)
