"""The edited state of a corpus: witnesses, units and phrase alignments after all edits.

A witness is one row: passage, source, text and its tokens as a list, so that
whatever concerns one text needs no shuffle.  Units and their targets are frames
of rows.  Edits arrive as frames in the order of ``seq``.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from loomtext.functions.text import canonical_unit, token_spans, token_spans_udf
from loomtext.operators.tokens import reanchor_texts
from loomtext.session import table

KEY = ["passage", "source"]
_IDS = "array<string>"


def _ids(c: str | Column) -> Column:
    return F.coalesce(c if isinstance(c, Column) else F.col(c), F.array().cast(_IDS))


def witnesses(texts: DataFrame) -> DataFrame:
    """passage, source, text, tokens (id, surface, start_pos, end_pos, label) of ``texts`` (passage, source, text).

    Token ids are '{passage}-{source}-t00001' and so on.  A null or empty text has no tokens.
    """
    return texts.select(*KEY, "text", witness_tokens().alias("tokens"))


def witness_tokens() -> Column:
    """The tokens of ``witnesses`` from a row's passage, source and text."""
    return F.transform(token_spans_udf("text"), lambda t, i: F.struct(
        F.format_string("%s-%s-t%05d", F.col("passage"), F.col("source"), i + 1).alias("id"), t.surface.alias("surface"), t.start_pos.alias("start_pos"), t.end_pos.alias("end_pos"), t.label.alias("label")))


def effective_witnesses(base: DataFrame, published: DataFrame, local: DataFrame) -> DataFrame:
    """Witnesses with the text edits applied: local before published before the base text.

    All three: passage, source, text.  Adds ``edited`` and ``token_map`` (base token id to the id of the same
    word in the edited text, by unique context; empty where nothing was edited).  An edit of an unknown witness
    makes one, whose base text is empty.
    """
    def named(d: DataFrame, name: str) -> DataFrame:
        return d.select(*KEY, F.col("text").alias(name), F.lit(True).alias("has_" + name))

    j = named(base, "base").join(named(published, "pub"), KEY, "full").join(named(local, "loc"), KEY, "full")
    edited = F.coalesce("has_loc", "has_pub", F.lit(False))
    j = j.select(*KEY, "base", F.when(F.col("has_loc"), F.col("loc")).when(F.col("has_pub"), F.col("pub")).otherwise(F.col("base")).alias("text"), edited.alias("edited"))
    p = reanchor_texts(j.where("edited").select(F.struct(*KEY).alias("k"), F.coalesce("base", F.lit("")).alias("base"), "text"), "k", "base", "text")
    name = lambda i: F.format_string("%s-%s-t%05d", F.col("k.passage"), F.col("k.source"), F.col(i) + 1)
    m = p.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct(name("old_idx"), name("new_idx")))).alias("token_map")).select("k.*", "token_map")
    w = witnesses(j.select(*KEY, "text")).join(j.select(*KEY, "edited"), KEY).join(m, KEY, "left")
    return w.withColumn("token_map", F.coalesce("token_map", F.create_map().cast("map<string,string>")))


def span_text(tokens: Column, text: Column, ids: Column) -> Column:
    """Text of the tokens ``ids`` of a witness; separate runs are joined by ' … '."""
    own = F.filter(F.transform(tokens, lambda t, i: F.struct(i.alias("i"), t.id.alias("id"), t.start_pos.alias("a"), t.end_pos.alias("b"))), lambda t: F.array_contains(ids, t.id))
    empty = F.array().cast("array<struct<a:bigint,b:bigint,i:int>>")
    step = lambda acc, t: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1).i == t.i - 1),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1).a.alias("a"), t.b.alias("b"), t.i.alias("i"))))
    ).otherwise(F.concat(acc, F.array(F.struct(t.a.alias("a"), t.b.alias("b"), t.i.alias("i")))))
    runs = F.aggregate(own, empty, step)
    return F.array_join(F.transform(runs, lambda r: F.substring(text, (r.a + 1).cast("int"), (r.b - r.a).cast("int"))), " … ")


def exact_spans(wanted: DataFrame, effective: DataFrame) -> DataFrame:
    """``wanted`` (passage, source, wanted, and more) with token_ids of the only place of the wording.

    Words are compared in composed form; number labels on either side are passed over, but labels inside the
    place belong to it.  No place, several places, no wording and unknown witnesses give an empty list.
    """
    return exact_spans_of(gathered(wanted, KEY).join(effective.select(*KEY, "tokens"), KEY, "left"), KEY)


def gathered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rows: the other columns of a key's rows as one list, so that what is joined to them travels and stands once.

    Rows with a null key, which no join meets, are spread over several lists.
    """
    lone = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    d = rows.withColumn("_part", F.when(lone, F.monotonically_increasing_id() % 1024))
    return d.groupBy(*keys, "_part").agg(F.collect_list(F.struct(*[c for c in rows.columns if c not in keys])).alias("rows")).drop("_part")


def exact_spans_of(witnesses: DataFrame, keys: list[str]) -> DataFrame:
    """``exact_spans`` of witnesses whose row holds what is wanted: keys, tokens, rows (a list of structs with ``wanted``)."""
    at = witnesses.withColumn("_at", _only_places(F.transform("rows", lambda r: r.wanted), F.col("tokens.surface"), F.col("tokens.label"))).withColumn("_ids", F.col("tokens.id"))
    ids = lambda p: F.when(p.lo.isNotNull(), F.slice("_ids", p.lo + 1, p.hi - p.lo + 1)).otherwise(F.array().cast(_IDS))
    return at.select(*keys, F.explode(F.transform("rows", lambda r, i: F.struct(r.alias("r"), ids(F.get("_at", i)).alias("token_ids")))).alias("x")).select(*keys, "x.r.*", "x.token_ids")


def _plain_words(text: str | None) -> str:
    return "\1" + unicodedata.normalize("NFC", "\1".join(w for w, _, _, label in token_spans(text) if not label)) + "\1"


@F.arrow_udf(ArrayType(StructType([StructField("lo", IntegerType()), StructField("hi", IntegerType())])))
def _only_places(wanted: pa.Array, words: pa.Array, labels: pa.Array) -> pa.Array:
    """First and last token of the only occurrence of each wording's words in the witness's; nulls if there is none or a second."""
    out = []
    for needles, w, label in zip(wanted.to_pylist(), words.to_pylist(), labels.to_pylist()):
        plain = [i for i, x in enumerate(label or []) if not x]
        text = "\1" + unicodedata.normalize("NFC", "\1".join(w[i] for i in plain)) + "\1"
        places = []
        for n in needles or []:
            part = _plain_words(n)
            at = text.find(part) if plain and len(part) > 2 else -1
            if at >= 0 and text.find(part, at + 1) < 0:
                k = text.count("\1", 0, at)
                places.append({"lo": plain[k], "hi": plain[k + part.count("\1") - 2]})
            else:
                places.append({"lo": None, "hi": None})
        out.append(places)
    return pa.array(out, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))


def reanchor_alignments(targets: DataFrame, effective: DataFrame, from_corpus: bool) -> DataFrame:
    """``targets`` (passage, unit_id, source, token_ids, text) with their token ids in the edited texts.

    Corpus alignments are carried by the token map, all tokens or none; others by the only place of their
    wording.  Targets of texts that were not edited stay.
    """
    if not from_corpus:
        now = exact_spans(targets.withColumn("wanted", F.col("text")).withColumnRenamed("token_ids", "_old"), effective)
        now = now.join(effective.select(*KEY, "edited"), KEY, "left")
        return now.withColumn("token_ids", F.when(F.coalesce("edited", F.lit(False)), F.col("token_ids")).otherwise(F.col("_old"))).select(*targets.columns)
    j = targets.join(effective.select(*KEY, "edited", "token_map"), KEY, "left")
    moved = F.transform("token_ids", lambda t: F.try_element_at("token_map", t))
    whole = F.when(F.forall(moved, lambda t: t.isNotNull()), moved).otherwise(F.array().cast(_IDS))
    return j.withColumn("token_ids", F.when(F.coalesce("edited", F.lit(False)), whole).otherwise(F.col("token_ids"))).select(*targets.columns)


def section_texts(edits: DataFrame) -> DataFrame:
    """passage, unit_id, source, literal, seq of section edits' target texts.

    A blank text suppresses what is there only from version 1 on; older forms saved every field they showed.
    """
    t = edits.select("passage", "unit_id", "version", "seq", F.explode("target_texts").alias("source", "literal"))
    return t.where((F.col("version") == 1) | (F.trim(F.coalesce("literal", F.lit(""))) != "")).select("passage", "unit_id", "source", F.coalesce("literal", F.lit("")).alias("literal"), "seq")


def _known(edit_unit: str, units: DataFrame) -> DataFrame:
    return units.select("passage", F.col("unit_id").alias(edit_unit)).distinct()


def effective_units(units: DataFrame, targets: DataFrame, effective: DataFrame, moves: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, targets) after text edits, boundary moves and section edits.

    ``units``: passage, unit_id, number, label, ord, level, note, status; ``targets``: passage, unit_id, source,
    token_ids, text; ``moves``: passage, source, token_ids, selected_text, to_unit, seq; ``sections``: passage,
    unit_id, number, label, ord, level, note, target_texts (map), version, deleted, seq (one edit per unit: the
    last one counts).  Old unit ids 'sentence-…' stand for 'dharmanexus-…' where only those exist.

    1. Targets in edited texts are found again by their exact wording.
    2. A token moved belongs to the unit it was moved to last.  Moves without tokens or to unknown units do nothing.
    3. Section edits hide units, override their fields, or make new ones; their literal texts are found in the
       witness if they stand there once, and suppress what is there otherwise.
    4. A blank of an old section form gets its tokens back if no visible unit has any of them (in order of edits).

    Results: units with ``literal`` (they have a section edit) and status 'editorial-boundary' or
    'editorial-section' where edited, ordered fields as they are; targets with ``literal`` text (null if none).
    """
    def canonical(d: DataFrame, c: str) -> DataFrame:
        known = _known("_known", units)
        d = d.join(known, (d["passage"] == known["passage"]) & (d[c] == known["_known"]), "left").drop(known["passage"])
        return d.withColumn(c, F.when(F.col("_known").isNull(), canonical_unit(F.col(c))).otherwise(F.col(c))).drop("_known")

    t = reanchor_alignments(targets.select("passage", "unit_id", "source", _ids("token_ids").alias("token_ids"), "text"), effective, from_corpus=False)
    t = table(t, "anchored")
    anchored = t.select("passage", "source", "unit_id", F.explode("token_ids").alias("token_id"))

    # Moves: the last one of every token.
    mv = canonical(moves.withColumnRenamed("to_unit", "unit_id"), "unit_id").join(_known("unit_id", units), ["passage", "unit_id"], "left_semi")
    mv = exact_spans(mv.select("passage", "source", "unit_id", "seq", _ids("token_ids").alias("_given"), F.col("selected_text").alias("wanted")), effective)
    mv = mv.join(effective.select(*KEY, "edited"), KEY, "left")
    mv = mv.select(*KEY, "unit_id", "seq", F.explode(F.when(F.coalesce("edited", F.lit(False)), F.col("token_ids")).otherwise(F.col("_given"))).alias("token_id"))
    mv = table(mv.groupBy(*KEY, "token_id").agg(F.max_by("unit_id", "seq").alias("to_unit")), "moves")
    own = anchored.join(mv, [*KEY, "token_id"], "full")
    moved = F.col("to_unit").isNotNull()
    touched = own.where(moved & ~F.col("unit_id").eqNullSafe(F.col("to_unit"))).select("passage", F.explode(F.array("unit_id", "to_unit")).alias("unit_id")).where("unit_id is not null").distinct()
    touched = table(touched, "touched")
    own = own.select(*KEY, F.coalesce("to_unit", "unit_id").alias("unit_id"), "token_id").distinct()

    # Section edits.
    sec = canonical(sections, "unit_id").where("unit_id is not null")
    rest = [c for c in sec.columns if c not in ("passage", "unit_id")]
    sec = sec.groupBy("passage", "unit_id").agg(F.max_by(F.struct(*rest), "seq").alias("e")).select("passage", "unit_id", "e.*")
    sec = table(sec, "sections")
    hidden = sec.where("deleted").select("passage", "unit_id")
    live = sec.where("not coalesce(deleted, false)")
    lit = section_texts(live)
    found = exact_spans(lit.select(*KEY, "unit_id", F.col("literal").alias("wanted"), "literal"), effective).where(F.size("token_ids") > 0)
    found = table(found.select(*KEY, "unit_id", "token_ids"), "literal-places")
    hit = found.select(*KEY, "unit_id")
    own = own.join(hit, [*KEY, "unit_id"], "left_anti").unionByName(found.select(*KEY, "unit_id", F.explode("token_ids").alias("token_id")))
    own = table(own.join(hidden, ["passage", "unit_id"], "left_anti"), "owned")

    # Orphans of old blanks.
    blank = live.where("coalesce(version, 0) <> 1").select("passage", "unit_id", "seq", F.explode("target_texts").alias("source", "literal")).where("trim(coalesce(literal, '')) = ''")
    blank = blank.join(own.select(*KEY, "unit_id").distinct(), [*KEY, "unit_id"], "left_anti").join(anchored, [*KEY, "unit_id"])
    taken = own.select(*KEY, "token_id").distinct().withColumn("_taken", F.lit(True))
    claims = blank.join(taken, [*KEY, "token_id"], "left").groupBy(*KEY, "unit_id", "seq").agg(F.collect_list("token_id").alias("token_ids"), F.max("_taken").alias("_taken")).where("_taken is null")
    own = table(own.unionByName(_first_claims(claims)), "owned")

    fields = live.select("passage", "unit_id", *[F.col(c).alias("_" + c) for c in ("number", "label", "ord", "level", "note")], F.lit(True).alias("literal"))
    u = units.join(fields, ["passage", "unit_id"], "full").join(touched.withColumn("_touched", F.lit(True)), ["passage", "unit_id"], "left").join(hidden, ["passage", "unit_id"], "left_anti")
    filled = lambda c: F.coalesce(F.when(F.col("_" + c) != "", F.col("_" + c)), F.col(c))
    u = u.withColumn("number", filled("number"))
    last = F.element_at(F.split("number", r"\."), -1).try_cast("bigint")
    section = F.coalesce("literal", F.lit(False))
    u = u.select(
        "passage", "unit_id", "number",
        F.when(section, F.coalesce(F.when(F.col("_label") != "", F.col("_label")), "label", F.concat(F.lit("Section "), F.coalesce("number", F.lit(""))))).otherwise(F.col("label")).alias("label"),
        F.when(section, F.coalesce("_ord", "ord", last, F.lit(2**53 - 1))).otherwise(F.col("ord")).cast("bigint").alias("ord"),
        F.coalesce(filled("level"), F.lit("sentence")).alias("level"), F.when(section, F.coalesce("_note", "note", F.lit(""))).otherwise(F.col("note")).alias("note"),
        F.when(section, "editorial-section").when(F.col("_touched"), "editorial-boundary").otherwise(F.col("status")).alias("status"), section.alias("literal"))
    g = own.groupBy(*KEY, "unit_id").agg(F.collect_set("token_id").alias("token_ids"))
    u = table(u, "units")
    g = g.join(lit.select(*KEY, "unit_id", "literal"), [*KEY, "unit_id"], "full").join(u.select("passage", "unit_id"), ["passage", "unit_id"], "left_semi")
    g = g.join(effective.select(*KEY, F.col("text").alias("_text"), "tokens"), KEY, "left")
    order = F.transform("tokens", lambda x: x.id)
    ids = F.when(F.col("tokens").isNull(), F.array_sort(_ids("token_ids"))).otherwise(F.filter(order, lambda x: F.array_contains(_ids("token_ids"), x)))
    g = g.withColumn("token_ids", ids)
    return u, g.select("passage", "unit_id", "source", "token_ids", F.coalesce(span_text(F.col("tokens"), F.col("_text"), F.col("token_ids")), F.lit("")).alias("text"), "literal")


def _first_claims(claims: DataFrame) -> DataFrame:
    """Tokens given back, claim by claim in order; a claim on a token given back already fails as a whole.

    Claims are what a blank of an old form once held, so those of one witness are few.
    """
    def run(g: pd.DataFrame) -> pd.DataFrame:
        given, out = set(), []
        for r in g.sort_values(["seq", "unit_id"]).itertuples():
            if not given & set(r.token_ids):
                given |= set(r.token_ids)
                out += [(r.passage, r.source, r.unit_id, t) for t in r.token_ids]
        return pd.DataFrame(out, columns=[*KEY, "unit_id", "token_id"])

    ddl = "passage string, source string, unit_id string, token_id string"
    return claims.groupBy(*KEY).applyInPandas(run, ddl)


def target_text(targets: DataFrame, effective: DataFrame) -> DataFrame:
    """``targets`` with ``shown``: the literal text; else a machine segment's stored text while nothing was edited; else the
    tokens' text; else the stored text.

    ``targets``: passage, unit_id, source, literal, status, sentence_edited, token_ids, text.
    """
    j = targets.join(effective.select(*KEY, F.col("text").alias("_w"), "tokens", "edited"), KEY, "left")
    now = span_text(F.col("tokens"), F.col("_w"), _ids("token_ids"))
    machine = (F.col("status") == "machine-segmented") & ~F.coalesce("sentence_edited", F.lit(False)) & (F.length("text") > 0) & ~F.coalesce("edited", F.lit(False))
    shown = F.when(F.col("literal").isNotNull(), F.col("literal")).when(machine, F.col("text")).otherwise(F.coalesce(F.when(F.length(now) > 0, now), F.col("text"), F.lit("")))
    return j.withColumn("shown", shown).drop("_w", "tokens", "edited")


def literal_tokens(targets: DataFrame, effective: DataFrame) -> DataFrame:
    """passage, unit_id, source, idx, surface, token_id: words of literal section texts and the witness tokens they repeat.

    ``targets``: passage, unit_id, source, literal, token_ids.  Only the unit's own tokens are candidates; a word
    without a unique counterpart has a null token_id.
    """
    j = targets.where("literal is not null").join(effective.select(*KEY, "tokens"), KEY, "left")
    own = F.filter("tokens", lambda t: F.array_contains(_ids("token_ids"), t.id) & ~t.label)
    j = j.withColumn("_own", own).withColumn("k", F.struct("passage", "unit_id", "source"))
    lit = F.transform(token_spans_udf("literal"), lambda t, i: F.struct(i.cast("bigint").alias("idx"), t.surface.alias("surface"), t.label.alias("label")))
    j = j.withColumn("_lit", lit)
    # The words are compared as texts of their own, one a line, so that positions are places in the lists.
    words = lambda c: F.array_join(F.transform(c, lambda t: t.surface), "\n")
    p = reanchor_texts(j.select("k", words("_own").alias("o"), words(F.filter("_lit", lambda t: ~t.label)).alias("n")), "k", "o", "n")
    flat = j.select("k", F.posexplode(F.filter("_lit", lambda t: ~t.label)).alias("new_idx", "t"), "_own").join(p, ["k", "new_idx"], "left")
    found = flat.select("k.*", "t.idx", F.get("_own", F.col("old_idx").cast("int")).id.alias("token_id"))
    every = j.select("k", F.explode("_lit").alias("t")).select("k.*", "t.idx", "t.surface")
    return every.join(found, ["passage", "unit_id", "source", "idx"], "left")


def fill_targets(units: DataFrame, targets: DataFrame, base: DataFrame, base_targets: DataFrame, pivot: str) -> DataFrame:
    """``targets`` (passage, unit_id, source, token_ids, text, literal) with missing ones taken from base units.

    ``units`` and ``base``: passage, unit_id, number, ord (and policy in ``units``).  A base unit matches by id, by number,
    or by a shared token of the ``pivot`` source; of several the first by order that has the source counts.
    Units of the policies 'attested-only' and 'source-anchors-and-labelled-suggestions' are not filled, and a
    target with tokens or a literal text stays.
    """
    closed = ("attested-only", "source-anchors-and-labelled-suggestions")
    open_ = units.where(~F.coalesce(F.col("policy").isin(*closed), F.lit(False))).select("passage", "unit_id", "number")
    b = base.select("passage", F.col("unit_id").alias("base_id"), F.col("number").alias("base_number"), "ord")
    cols = ["passage", "unit_id", "base_id", "ord"]
    by_id = open_.join(b, (open_["passage"] == b["passage"]) & (open_["unit_id"] == b["base_id"])).select(open_["passage"], "unit_id", "base_id", "ord")
    by_number = open_.where("number <> ''").join(b, (open_["passage"] == b["passage"]) & (open_["number"] == b["base_number"])).select(open_["passage"], "unit_id", "base_id", "ord")
    tok = lambda d, name: d.where(F.col("source") == pivot).select("passage", F.col("unit_id").alias(name), F.explode(_ids("token_ids")).alias("token_id"))
    shared = tok(targets, "unit_id").join(tok(base_targets, "base_id"), ["passage", "token_id"]).select("passage", "unit_id", "base_id").distinct()
    shared = shared.join(open_.select("passage", "unit_id"), ["passage", "unit_id"], "left_semi").join(b.select("passage", "base_id", "ord"), ["passage", "base_id"]).select(*cols)
    match = by_id.unionByName(by_number).unionByName(shared).distinct()
    has = base_targets.where((F.size(_ids("token_ids")) > 0) | (F.length("text") > 0) | F.col("literal").isNotNull())
    offer = match.join(has.select("passage", F.col("unit_id").alias("base_id"), "source", F.struct("token_ids", "text", "literal").alias("t")), ["passage", "base_id"])
    offer = offer.groupBy("passage", "unit_id", "source").agg(F.min_by("t", F.struct("ord", "base_id")).alias("offer"))
    j = targets.join(offer, ["passage", "unit_id", "source"], "full")
    keep = F.col("literal").isNotNull() | (F.size(_ids("token_ids")) > 0) | F.col("offer").isNull()
    # A literal text replaces tokens; otherwise what the base has is added to what is there.
    given = F.col("offer.literal").isNotNull()
    return j.select("passage", "unit_id", "source",
                    F.when(keep | given, _ids("token_ids")).otherwise(_ids("offer.token_ids")).alias("token_ids"),
                    F.when(keep | given, F.col("text")).otherwise(F.coalesce(F.when(F.length("offer.text") > 0, F.col("offer.text")), "text")).alias("text"),
                    F.when(keep, F.col("literal")).otherwise(F.col("offer.literal")).alias("literal"))


def phrase_alignments(alignments: DataFrame, targets: DataFrame, base: DataFrame, base_targets: DataFrame, sections: DataFrame, pivot: str, provider: str = "dharmanexus-authorized") -> tuple[DataFrame, DataFrame]:
    """(units, targets) of the sentence and phrase alignments that are shown.

    ``alignments``: passage, unit_id, number, label, ord, level, note, status, policy; ``base`` and ``base_targets``: the
    effective units; ``sections`` as in ``effective_units``.

    1. Of the alignments of level sentence or phrase (null: phrase) a provider's gives way to a human sentence that shares a
       token of ``pivot``.
    2. One with a deleting section edit goes; one that is an effective unit too is shown as that; another with a
       section edit takes its fields and texts.
    3. Missing targets are filled from the effective units.
    4. The other effective units follow unless a sentence above has their id or shares a ``pivot`` token.

    Order: see ``ordered_phrases``.
    """
    a = alignments.where(F.coalesce("level", F.lit("phrase")).isin("sentence", "phrase"))
    pv = lambda d: d.where(F.col("source") == pivot).select("passage", "unit_id", F.explode(_ids("token_ids")).alias("token_id"))
    human = a.where(~F.col("status").eqNullSafe(F.lit(provider)) & (F.col("level") == "sentence")).select("passage", "unit_id")
    ht = pv(targets).join(human, ["passage", "unit_id"], "left_semi").select("passage", "token_id").distinct()
    beaten = pv(targets).join(a.where(F.col("status") == provider).select("passage", "unit_id"), ["passage", "unit_id"], "left_semi").join(ht, ["passage", "token_id"], "left_semi").select("passage", "unit_id").distinct()
    a = table(a.join(beaten, ["passage", "unit_id"], "left_anti"), "alignments")

    sec = sections.withColumn("unit_id", canonical_unit(F.col("unit_id")))
    rest = [c for c in sec.columns if c not in ("passage", "unit_id")]
    sec = sec.groupBy("passage", "unit_id").agg(F.max_by(F.struct(*rest), "seq").alias("e")).select("passage", "unit_id", "e.*")
    a = a.join(sec.where("deleted").select("passage", "unit_id"), ["passage", "unit_id"], "left_anti")
    there = base.select("passage", "unit_id")
    is_base = a.join(there, ["passage", "unit_id"], "left_semi").select("passage", "unit_id")
    other = a.join(there, ["passage", "unit_id"], "left_anti")
    e = sec.where("not coalesce(deleted, false)").select("passage", "unit_id", *[F.col(c).alias("_" + c) for c in ("number", "label", "ord", "level", "note")], F.lit(True).alias("_edited"))
    o = other.join(e, ["passage", "unit_id"], "left")
    pick = lambda c: F.coalesce(F.when(F.col("_" + c).cast("string") != "", F.col("_" + c)), F.col(c)).alias(c)
    o = o.select("passage", "unit_id", pick("number"), pick("label"), pick("ord"), pick("level"), F.coalesce("_note", "note").alias("note"),
                 F.when(F.col("_edited"), "editorial-section").otherwise(F.col("status")).alias("status"), "policy")
    lit = section_texts(sec.where("not coalesce(deleted, false)")).select("passage", "unit_id", "source", F.col("literal").alias("_lit"))
    ot = targets.join(other.select("passage", "unit_id"), ["passage", "unit_id"], "left_semi")
    lit = lit.join(other.select("passage", "unit_id"), ["passage", "unit_id"], "left_semi")
    ot = ot.join(lit, ["passage", "unit_id", "source"], "full").select("passage", "unit_id", "source", _ids("token_ids").alias("token_ids"), "text", F.col("_lit").alias("literal"))
    fields = ["passage", "unit_id", "number", "label", "ord", "level", "note", "status"]
    none = F.lit(None).cast("string")
    shown = o.select(*fields, "policy").unionByName(base.join(is_base, ["passage", "unit_id"], "left_semi").select(*fields, none.alias("policy")))
    tcols = ["passage", "unit_id", "source", "token_ids", "text", "literal"]
    st = ot.select(*tcols).unionByName(base_targets.join(is_base, ["passage", "unit_id"], "left_semi").select(*tcols))
    shown, st = table(shown, "shown"), table(st, "shown-targets")
    st = table(fill_targets(shown, st, base, base_targets, pivot), "filled")

    sentences = shown.where("level = 'sentence'").select("passage", "unit_id")
    held = pv(st).join(sentences, ["passage", "unit_id"], "left_semi").select("passage", "token_id").distinct()
    gone = pv(base_targets).join(held, ["passage", "token_id"], "left_semi").select("passage", "unit_id").unionByName(sentences).distinct()
    more = base.join(gone, ["passage", "unit_id"], "left_anti").join(shown.select("passage", "unit_id"), ["passage", "unit_id"], "left_anti").select(*fields)
    mt = base_targets.join(more.select("passage", "unit_id"), ["passage", "unit_id"], "left_semi").select(*tcols)
    return shown.select(*fields).unionByName(more), st.unionByName(mt)


def ordered_phrases(units: DataFrame, targets: DataFrame, effective: DataFrame, pivot: str) -> DataFrame:
    """``units`` with ``place``: their rank in the passage.

    Sentences stand by order and number; what is no sentence stands by the first token it has in the pivot
    witness, then by order.  To be one total order for both kinds, every unit is placed by that token first,
    and by order, number and id among equals; a unit without tokens there comes last.
    """
    w = effective.where(F.col("source") == pivot).select("passage", F.posexplode(F.transform("tokens", lambda t: t.id)).alias("i", "token_id"))
    first = targets.where(F.col("source") == pivot).select("passage", "unit_id", F.explode(_ids("token_ids")).alias("token_id")).join(w, ["passage", "token_id"]).groupBy("passage", "unit_id").agg(F.min("i").alias("_at"))
    j = units.join(first, ["passage", "unit_id"], "left")
    order = Window.partitionBy("passage").orderBy(F.coalesce("_at", F.lit(2**31 - 1)), F.coalesce("ord", F.lit(0)), F.coalesce("number", F.lit("")), "unit_id")
    return j.withColumn("place", F.row_number().over(order).cast("bigint")).drop("_at")
