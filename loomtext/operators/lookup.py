"""Lexical records of tokens, searches over them, and what is aligned with a selection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from loomtext.functions.text import analysis_form_udf, fold, fold_udf, iast_udf, lexical_form, lexical_form_udf, lexical_parts, token_spans
from loomtext.operators.edits import last_wins
from loomtext.operators.effective import span_text
from loomtext.operators.lexicon import entry_forms
from loomtext.session import small, table

#: Priority of an entry of the curated glossary that states none; others have 0.
CURATED = 1000


@F.pandas_udf(ArrayType(StringType()))
def parts_udf(form: pd.Series, lang: pd.Series) -> pd.Series:
    return pd.Series([lexical_parts(f, g or "") if f else [] for f, g in zip(form, lang)])


_FORMS = StructType([StructField("norms", ArrayType(StringType())), StructField("surfaces", ArrayType(StringType()))])


@F.pandas_udf(_FORMS)
def _norms(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    known: dict[str, str] = {}

    def norm(w: str) -> str:
        if w not in known:
            if len(known) > 500_000:
                known.clear()
            known[w] = lexical_form(w)
        return known[w]

    for s in batches:
        words = [[w for w, *_ in token_spans(t)] for t in s]
        yield pd.DataFrame({"norms": [[norm(w) for w in ws] for ws in words], "surfaces": words})


def glossary_forms(lexicon: DataFrame) -> DataFrame:
    """entry_id, lang, form_ord, parts, priority, ord of all forms of a lexicon.

    ``lexicon``: entry_id, language (null: san), lemma, forms, curated, priority, ord.  Parts are single
    characters in Chinese and blank-separated words elsewhere, folded; a form without parts is left out.
    """
    f = entry_forms(lexicon).join(lexicon.select(
        "entry_id", F.coalesce("language", F.lit("san")).alias("lang"), F.coalesce("priority", F.when(F.col("curated"), CURATED).otherwise(0)).alias("priority"), "ord"), "entry_id")
    return f.withColumn("parts", parts_udf("form", "lang")).where(F.size("parts") > 0)


def glossary_matches(docs: DataFrame, key: str, lang: str, text: str, lexicon: DataFrame) -> DataFrame:
    """key, idx, surface, entry_id, start_idx, n_parts, matched_text: the glossary entry of every covered token.

    A form matches where its folded parts are consecutive tokens of one text in the form's language.  Of several
    matches over a token the one with most parts wins, then the higher priority, the entry's order, the form's,
    and the later start.  A token of several Chinese characters that no span covers matches a form of just these.
    Tokens without folded letters have no match; null texts and languages none either.  ``lexicon`` as for
    ``glossary_forms``.  Each text is cut and folded once, inside its row.
    """
    forms = table(glossary_forms(lexicon).select("entry_id", "lang", "form_ord", "parts", "priority", "ord"), "glossary")
    f = forms.withColumn("first", F.col("parts")[0]).withColumn("n", F.size("parts"))
    longest = int(forms.agg(F.max(F.size("parts"))).first()[0] or 1)
    d = docs.select(F.col(key).alias("k"), F.col(lang).alias("lang"), _norms(F.col(text)).alias("t")).where("lang is not null")
    t = d.select("k", "lang", F.posexplode("t.norms").alias("idx", "first"), "t").where("first <> ''")
    f.loom_bytes = forms.loom_bytes
    hit = t.join(small(f), ["lang", "first"]).where((F.col("n") <= longest) & (F.slice("t.norms", F.col("idx") + 1, F.col("n")) == F.col("parts")))
    words = F.slice("t.surfaces", F.col("idx") + 1, F.col("n"))
    hit = hit.select("k", F.col("idx").alias("start_idx"), "entry_id", "form_ord", "priority", "ord", "n", F.call_function("array_join", words, F.when(F.col("lang") == "zho", "").otherwise(" ")).alias("matched"),
                     F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.struct((F.col("idx") + o).alias("idx"), F.get("t.surfaces", F.col("idx") + o).alias("surface")))).alias("c"))
    best = hit.groupBy("k", "c.idx", "c.surface").agg(F.min(F.struct(
        (-F.col("n")).alias("n"), (-F.col("priority")).alias("p"), F.col("ord").alias("o"), F.col("form_ord").alias("f"), (-F.col("start_idx")).alias("s"), "entry_id", "matched")).alias("m"))
    span = best.select("k", "idx", "surface", "m.entry_id", (-F.col("m.s")).alias("start_idx"), (-F.col("m.n")).alias("n_parts"), F.col("m.matched").alias("matched_text"))
    # Tokens of several characters that are a form by themselves.
    whole = d.where("lang = 'zho'").select("k", "lang", F.posexplode("t.surfaces").alias("idx", "surface")).where(F.length("surface") > 1)
    whole = whole.withColumn("parts", parts_udf("surface", "lang")).where(F.size("parts") > 1).join(small(forms), ["lang", "parts"])
    whole = whole.groupBy("k", "idx", "surface").agg(F.min(F.struct((-F.col("priority")).alias("p"), "ord", "form_ord", "entry_id")).alias("m"))
    whole = whole.join(span.select("k", "idx"), ["k", "idx"], "left_anti").select("k", "idx", "surface", "m.entry_id", F.col("idx").alias("start_idx"), F.lit(1).alias("n_parts"), F.col("surface").alias("matched_text"))
    return span.unionByName(whole).withColumnRenamed("k", key)


def editorial_records(tokens: DataFrame, entries: DataFrame) -> DataFrame:
    """source, token_id, surface, record_id: the editorial lexicon record of every token.

    ``tokens``: source, token_id, surface; ``entries``: id, source, token_id, surface, normalized_surface, seq; a
    repeated id counts as its last row.  A record of this very token with the same form comes first, then any record
    of the form in the source; the latest of each.  Tokens without a record are left out.
    """
    e = last_wins(entries, ["id"], ["seq"]).select("id", "source", "token_id", analysis_form_udf("surface").alias("own"), analysis_form_udf(F.coalesce("normalized_surface", "surface")).alias("form"), "seq")
    t = tokens.select("source", "token_id", "surface").distinct().withColumn("norm", analysis_form_udf("surface"))
    here = e.where("token_id is not null").select("source", "token_id", F.col("own").alias("norm"), "id", "seq")
    here = here.groupBy("source", "token_id", "norm").agg(F.max_by("id", "seq").alias("here"))
    form = e.select("source", F.col("form").alias("norm"), "id", "seq").groupBy("source", "norm").agg(F.max_by("id", "seq").alias("any"))
    j = t.join(here, ["source", "token_id", "norm"], "left").join(form, ["source", "norm"], "left")
    return j.select("source", "token_id", "surface", F.coalesce("here", "any").alias("record_id")).where("record_id is not null")


FIELDS = {"lemma": ("lemma",), "part_of_speech": ("part_of_speech",), "reading": ("reading",), "gloss": ("gloss",), "notes": ("notes", "note")}


def resolved_records(tokens: DataFrame) -> DataFrame:
    """``tokens`` with lemma, part_of_speech, reading, gloss, notes, morphology and status of the resolved record.

    ``tokens``: surface, editorial (struct lemma, part_of_speech, morphology, reading, gloss, notes) and glossary
    (struct lemma, part_of_speech, reading, gloss, note, analysis, morphology map, status, curated); both may be null.
    An editorial field that is not empty comes before the glossary's; nothing gives the empty text.  The glossary's
    morphology is that of the surface's folded form, then its general analysis.
    """
    val = lambda c: F.when(F.length(c) > 0, F.col(c))
    out = tokens
    for name, sources in FIELDS.items():
        out = out.withColumn(name, F.coalesce(val(f"editorial.{sources[0]}"), val(f"glossary.{sources[-1]}"), F.lit("")))
    norm = lexical_form_udf("surface")
    keys = F.map_keys("glossary.morphology")
    out = out.withColumn("_norm", norm).withColumn("_keys", keys)
    # The map's keys are folded in one call, joined by a control character.
    out = out.withColumn("_folded", F.split(_folded_keys(F.array_join("_keys", "\u0001")), "\u0001"))
    at = F.array_position("_folded", F.col("_norm"))
    own = F.when((at > 0) & (F.size("_keys") > 0), F.try_element_at(F.col("glossary.morphology"), F.get("_keys", (at - 1).cast("int"))))
    out = out.withColumn("morphology", F.coalesce(val("editorial.morphology"), F.when(F.length(own) > 0, own), val("glossary.analysis"), F.lit("")))
    status = F.coalesce(val("glossary.status"), F.when(F.coalesce(F.col("glossary.curated"), F.lit(False)), "draft"), F.lit(""))
    return out.withColumn("status", status).drop("_norm", "_keys", "_folded")


@F.pandas_udf(StringType())
def _folded_keys(joined: pd.Series) -> pd.Series:
    return pd.Series([None if j is None else "\u0001".join(map(lexical_form, j.split("\u0001"))) for j in joined])


SEARCHED = ("surface", "matched_text", "editorial.lemma", "editorial.gloss", "editorial.notes", "glossary.lemma", "glossary.reading", "glossary.gloss", "glossary.analysis", "glossary.note")


def lexical_search(records: DataFrame, query: str) -> DataFrame:
    """``records`` in whose wording, transliteration or lexical fields the folded ``query`` stands.

    ``records``: surface, matched_text, editorial and glossary as in ``resolved_records``, and glossary.equivalents
    (map to lists).  A query that folds to nothing matches everything; null fields are passed over.
    """
    wanted = fold(query)
    if not wanted:
        return records
    lists = F.coalesce(F.flatten(F.filter(F.map_values("glossary.equivalents"), lambda x: x.isNotNull())), F.array().cast("array<string>"))
    text = F.concat_ws(" ", *[F.when(F.length(c) > 0, F.col(c)) for c in SEARCHED[:1]], iast_udf("surface"), *[F.when(F.length(c) > 0, F.col(c)) for c in SEARCHED[1:]], F.array_join(lists, " "))
    return records.where(fold_udf(text).contains(wanted))


def selection_alignments(selections: DataFrame, reviewed: DataFrame, candidates: DataFrame, provider: str = "dharmanexus-authorized") -> DataFrame:
    """sel_id, alignment_id, tier: what is aligned with the selected tokens.

    ``selections``: sel_id, token_id; ``reviewed`` and ``candidates``: alignment_id, token_ids, and status in ``reviewed``.
    Reviewed alignments (none of the provider's) come with any shared token; candidates only for tokens that no
    reviewed alignment of the selection covers.
    """
    s = selections.select("sel_id", "token_id").distinct()
    r = reviewed.where(~F.col("status").eqNullSafe(F.lit(provider))).select("alignment_id", F.explode("token_ids").alias("token_id"))
    hit = s.join(r, "token_id").select("sel_id", "alignment_id").distinct()
    covered = hit.join(r, "alignment_id").select("sel_id", "token_id").distinct()
    rest = s.join(covered, ["sel_id", "token_id"], "left_anti")
    c = rest.join(candidates.select("alignment_id", F.explode("token_ids").alias("token_id")), "token_id").select("sel_id", "alignment_id").distinct()
    return hit.withColumn("tier", F.lit("reviewed")).unionByName(c.withColumn("tier", F.lit("candidate")))


def linked_terms(tokens: DataFrame, reviewed: DataFrame, candidates: DataFrame, effective: DataFrame) -> DataFrame:
    """passage, token_id, alignment_id, source, text: the other witnesses' wording for a token.

    ``tokens``: passage, source, token_id; ``reviewed``: passage, alignment_id, level, source, token_ids, ord; ``candidates``
    without level.  A token's alignment is the reviewed one of level 'token-span' whose span in the token's source is
    shortest (then the first), else the first candidate.  Witnesses without wording are left out.
    """
    t = tokens.select("passage", "source", "token_id").distinct()

    def offer(a: DataFrame, tier: int, n: Column) -> DataFrame:
        x = a.select("passage", "source", "alignment_id", "ord", n.alias("n"), F.explode("token_ids").alias("token_id"))
        return t.join(x, ["passage", "source", "token_id"]).select("passage", "token_id", F.struct(F.lit(tier).alias("tier"), "n", "ord", "alignment_id").alias("o"))

    o = offer(reviewed.where("level = 'token-span'"), 0, F.size("token_ids")).unionByName(offer(candidates, 1, F.lit(0)))
    best = o.groupBy("passage", "token_id").agg(F.min("o").alias("o")).select("passage", "token_id", F.col("o.alignment_id").alias("alignment_id"), F.col("o.tier").alias("tier"))
    every = reviewed.select("passage", "alignment_id", "source", "token_ids", F.lit(0).alias("tier")).unionByName(candidates.select("passage", "alignment_id", "source", "token_ids", F.lit(1).alias("tier")))
    own = t.select("passage", "token_id", F.col("source").alias("own"))
    j = best.join(every, ["passage", "alignment_id", "tier"]).join(own, ["passage", "token_id"]).where("source <> own")
    j = j.join(effective.select("passage", "source", F.col("text").alias("_t"), "tokens"), ["passage", "source"])
    return j.select("passage", "token_id", "alignment_id", "source", span_text(F.col("tokens"), F.col("_t"), F.col("token_ids")).alias("text")).where("text <> ''")


def latest_annotations(annotations: DataFrame) -> DataFrame:
    """The last syntax annotation of every (source, passage, sentence) by seq; of a repeated id only its last row counts."""
    a = last_wins(annotations, ["id"], ["seq"]).drop("first_seen")
    return last_wins(a, ["source", "passage", "sentence"], ["seq"]).drop("first_seen")


def with_candidate_defaults(candidates: DataFrame) -> DataFrame:
    """Candidates with level, status and confidence where they state none (null or empty)."""
    given = lambda c, v: F.coalesce(F.when(F.length(c) > 0, F.col(c)), F.lit(v))
    return candidates.withColumn("level", given("level", "token-span")).withColumn("status", given("status", "machine-suggested")).withColumn("confidence", given("confidence", "low"))


def record_or_fallback(records: DataFrame, group: str, selected: Column, matches: Column, order: str) -> DataFrame:
    """One record per ``group``: the selected one, else the first that matches, else the first by ``order``."""
    rank = F.when(F.coalesce(selected, F.lit(False)), 0).when(F.coalesce(matches, F.lit(False)), 1).otherwise(2)
    w = Window.partitionBy(group).orderBy("_rank", order)
    return records.withColumn("_rank", rank).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_rank")


def entry_origin(entry: Column, tier: Column) -> Column:
    """Where an editorial record comes from: ``tier`` 2 local, 1 published, else imported; no entry: unannotated."""
    return F.when(entry.isNull(), "Unannotated").when(tier == 2, "Local draft").when(tier == 1, "Published editorial record").otherwise("Imported corpus record")


def glossary_origin(entry: Column, status: Column, curated: Column) -> Column:
    """Where a glossary entry comes from, by its status first."""
    return (F.when(entry.isNull(), "Unannotated").when(status == "dictionary-extract", "Dictionary extract").when(status == "text-critical", "Text-critical working note")
            .when(F.coalesce(curated, F.lit(False)), "Curated working glossary · draft").otherwise("Corpus working entry · draft"))


# Labels of the review status of a suggested target, and policies of anchored drafts.
SUGGESTIONS = {"unreviewed-machine-suggestion": "suggested · check span", "unreviewed-textual-match": "text match · draft",
               "partial-source-reading": "partial source reading · draft", "draft-source-reading": "source reading · draft"}
ANCHORED = ("attested-only", "source-anchors-and-labelled-suggestions")


def status_label(status: Column, policy: Column, edited: Column, literal: Column, review: Column, root: Column) -> Column:
    """Label of an alignment's target: its suggestion, else root, edited, provider, projected or reviewed, in this order.

    ``edited``: the unit was edited; ``literal``: the target has a literal text (null if not); ``review``: review status
    of the target's provenance; ``root``: the unit holds the root verse.
    """
    is_edited = F.coalesce(edited, F.lit(False))
    hint = F.lit(None).cast("string")
    for k, v in reversed(SUGGESTIONS.items()):
        hint = F.when(review == k, v).otherwise(hint)
    hint = F.when(is_edited | literal.isNotNull(), None).otherwise(hint)
    is_root = F.coalesce(root, F.lit(False))
    provider = F.coalesce(status == "dharmanexus-authorized", F.lit(False))
    return (
        F.when(hint.isNotNull(), hint)
        .when(F.coalesce(policy.isin(*ANCHORED), F.lit(False)) & ~is_edited, F.when(is_root, "root · draft").otherwise("anchored draft"))
        .when(is_root, F.when(provider, "root · DharmaNexus").otherwise("root verse"))
        .when(is_edited | F.coalesce(status == "editorial-boundary", F.lit(False)), "edited")
        .when(provider, "DharmaNexus base").when(F.coalesce(status == "machine-segmented", F.lit(False)), "projected").otherwise("reviewed"))
