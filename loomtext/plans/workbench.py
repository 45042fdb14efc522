"""Queries of edits, lookups and alignment repair over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import align, anchors, edits, effective, lookup, manuscripts, tokens
from loomtext.operators.windows import latest
from loomtext.plans.units import _U
from loomtext.session import table
from loomtext.sources import conllu, library
from loomtext.sources.tables import read

_COLS = ["bitext_id", "passage_id", "unit_number", "unit_order", "unit_status", "confidence", "targets", "target_token_ids", "mapping_methods"]


def _units(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "alignments", "unit_id", *_COLS).where("unit_id is not null").dropDuplicates(["unit_id"])


def _cells(s: SparkSession, d: str) -> DataFrame:
    """One row per unit and witness with a text."""
    return _units(s, d).select("unit_id", "bitext_id", "unit_number", "unit_order", "unit_status", "confidence", F.explode("targets").alias("source", "text")).where("length(text) > 0")


def _lines(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "opening_lines", "line_id", "revision", "line_scope", "text", "map_source").where("line_id is not null").distinct()


def _first_and_last(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Texts of the lines (of several the smallest, null first), and edits of two thirds of them.

    By the length of the text modulo three an edit changes a letter throughout, cuts the beginning, or there is none.
    """
    g = _lines(s, d).groupBy(F.col("line_id").alias("passage"), F.lit("map").alias("source")).agg(F.min_by("text", F.coalesce("text", F.lit(""))).alias("text"))
    k = F.length("text") % 3
    edit = F.when(k == 0, F.replace(F.col("text"), F.lit("a"), F.lit("e"))).when(k == 1, F.substring("text", 11, 1_000_000))
    return g, g.withColumn("text", edit).where("text is not null")


def effective_lines(s, d):
    first, last = _first_and_last(s, d)
    e = effective.effective_witnesses(first, last, last.limit(0))
    return e.select("passage", F.length("text").alias("n_chars"), "edited", F.size("tokens").cast("bigint").alias("n_tokens"))


def reanchored_lines(s, d):
    """How many words of each line's first revision are found again in its last."""
    first, last = _first_and_last(s, d)
    e = effective.effective_witnesses(first, last, last.limit(0)).where("edited")
    return e.select("passage", F.size("tokens").cast("bigint").alias("n_tokens"), F.size("token_map").cast("bigint").alias("n_found"))


def _sentences(s: SparkSession, d: str) -> DataFrame:
    """passage (bitext), source, rows (unit_order, unit_id, text, in order), text: the witness's sentences of a bitext, one a line."""
    c = _cells(s, d).where("bitext_id is not null")
    g = c.groupBy(F.col("bitext_id").cast("string").alias("passage"), "source").agg(F.array_sort(F.collect_list(F.struct("unit_order", "unit_id", "text"))).alias("rows"))
    return g.withColumn("text", F.array_join(F.transform("rows", lambda x: x.text), "\n"))


def _whole(s: SparkSession, d: str) -> DataFrame:
    """passage (bitext), source, text: the witness's sentences of a bitext, in order, one a line."""
    return _sentences(s, d).select("passage", "source", "text")


def _effective(s: SparkSession, d: str) -> DataFrame:
    w = _whole(s, d)
    return effective.witnesses(w).withColumn("edited", F.lit(False)).withColumn("token_map", F.create_map().cast("map<string,string>"))


def exact_unit_spans(s, d):
    """Units found by their exact words in their witness."""
    w = _sentences(s, d)
    # The witness is made of its units, so they are looked for in its row.
    w = w.select("passage", "source", effective.witness_tokens().alias("tokens"), F.transform("rows", lambda x: F.struct(x.unit_id.alias("unit_id"), x.text.alias("wanted"))).alias("rows"))
    e = effective.exact_spans_of(w, effective.KEY).where(F.size("token_ids") > 0)
    return e.select("unit_id", "source", F.size("token_ids").cast("bigint").alias("n"), F.element_at("token_ids", 1).alias("first"))


def _edited_state(s, d):
    """Units of the bitexts with their words, moves of first words to the unit before, and section edits."""
    eff = table(_effective(s, d), "effective")
    c = _cells(s, d).where("bitext_id is not null").select(F.col("bitext_id").cast("string").alias("passage"), "source", "unit_id", "unit_number", "unit_order", "text")
    t = effective.exact_spans(c.withColumn("wanted", F.col("text")), eff)
    t = table(t.select("passage", "unit_id", "source", "token_ids", "text", "unit_order", "unit_number"), "unit-words")
    none = F.lit(None).cast("string")
    u = t.groupBy("passage", "unit_id").agg(F.max("unit_number").alias("number"), F.max("unit_order").cast("bigint").alias("ord"))
    units = u.select("passage", "unit_id", "number", none.alias("label"), "ord", F.lit("sentence").alias("level"), none.alias("note"), F.lit("machine-segmented").alias("status"))
    w = Window.partitionBy("passage", "source").orderBy("unit_order", "unit_id")
    m = t.withColumn("to_unit", F.lag("unit_id").over(w)).where("to_unit is not null and size(token_ids) > 1 and unit_order % 3 = 0")
    moves = m.select("passage", "source", F.slice("token_ids", 1, 1).alias("token_ids"), none.alias("selected_text"), "to_unit", F.col("unit_order").alias("seq"))
    sec = t.where("unit_order % 7 = 0 or unit_order % 5 = 0").groupBy("passage", "unit_id").agg(F.max("unit_order").alias("seq"), F.map_from_entries(F.collect_list(F.struct("source", "text"))).alias("target_texts"))
    sections = sec.select("passage", "unit_id", none.alias("number"), F.concat(F.lit("L"), "seq").alias("label"), F.lit(None).cast("bigint").alias("ord"), none.alias("level"), none.alias("note"),
                          F.transform_values("target_texts", lambda k, v: F.when(F.col("seq") % 2 == 0, v).otherwise("")).alias("target_texts"), F.when(F.col("seq") % 3 == 0, 1).alias("version"), (F.col("seq") % 7 == 0).alias("deleted"), "seq")
    return eff, units, t.select("passage", "unit_id", "source", "token_ids", "text"), moves, sections


def effective_units_and_targets(s, d):
    """Units after moves and section edits, with the words of each witness."""
    eff, units, targets, moves, sections = _edited_state(s, d)
    u, t = effective.effective_units(units, targets, eff, moves, sections)
    return u.join(t, ["passage", "unit_id"], "left").select("passage", "unit_id", "label", "ord", "status", "source", F.size("token_ids").cast("bigint").alias("n_tokens"), F.length("text").alias("n_chars"))


def shown_phrases(s, d):
    """The phrase alignments that are shown, in order: human sentences before effective units."""
    eff, units, targets, moves, sections = _edited_state(s, d)
    u, t = effective.effective_units(units, targets, eff, moves, sections)
    u, t = table(u, "units"), table(t, "targets")
    al = units.where("ord % 4 = 0").withColumn("status", F.when(F.col("ord") % 8 == 0, "dharmanexus-authorized").otherwise("editorial")).withColumn("policy", F.lit(None).cast("string"))
    src = targets.agg(F.min("source")).first()[0] or ""
    ru, rt = effective.phrase_alignments(al, targets.withColumn("literal", F.lit(None).cast("string")), u.drop("literal"), t, sections, src)
    return effective.ordered_phrases(ru, rt, eff, src).select("passage", "unit_id", "status", "place")


def shown_target_texts(s, d):
    """Which text of a target is shown: literal, stored or of the tokens."""
    eff, units, targets, _, _ = _edited_state(s, d)
    t = targets.join(units.select("passage", "unit_id", "ord"), ["passage", "unit_id"])
    t = t.withColumn("literal", F.when(F.col("ord") % 5 == 0, F.concat(F.lit("literal "), "ord"))).withColumn("status", F.when(F.col("ord") % 2 == 0, "machine-segmented").otherwise("reviewed"))
    t = t.withColumn("sentence_edited", F.col("ord") % 3 == 0).withColumn("text", F.concat(F.lit("stored "), "text"))
    return effective.target_text(t, eff).select("unit_id", "source", "shown")


def section_target_texts(s, d):
    u = _units(s, d).select(F.col("bitext_id").alias("passage"), "unit_id", F.when(F.col("unit_order") % 2 == 0, 1).alias("version"), F.col("unit_order").alias("seq"),
                            F.transform_values("targets", lambda k, v: F.when(F.col("unit_order") % 3 == 0, " ").otherwise(v)).alias("target_texts"))
    return effective.section_texts(u).select("unit_id", "source", F.length("literal").alias("n_chars"))


def glossary_lookup(s, d):
    """Glossary entries of the documents' tokens in all languages: folded forms, English ones and their equivalents."""
    lx = read(s, d, "lexicon", "entry_id", "lemma", "forms", "equivalents").where("entry_id is not null")
    en = lx.select("entry_id", F.lit("eng").alias("language"), "lemma", "forms")
    eq = lx.select("entry_id", F.explode("equivalents").alias("language", "forms")).select("entry_id", "language", F.lit(None).cast("string").alias("lemma"), "forms")
    every = en.unionByName(eq).withColumn("entry_id", F.concat_ws(":", "entry_id", "language")).withColumn("curated", F.col("lemma").isNotNull()).withColumn("priority", F.lit(None).cast("int")).withColumn("ord", F.regexp_extract("entry_id", r"(\d+)", 1).try_cast("int"))
    docs = read(s, d, "documents", "doc_id", "source", "text").select("doc_id", F.substring("source", 1, 3).alias("lang"), "text")
    return lookup.glossary_matches(docs, "doc_id", "lang", "text", every).groupBy("doc_id", "entry_id").agg(F.count(F.lit(1)).alias("n"), F.min("start_idx").alias("first"))


def selection_overlaps(s, d):
    k = _units(s, d).select("unit_id", "unit_status", "confidence", F.explode("target_token_ids").alias("source", "token_ids")).where("size(token_ids) > 0")
    a = k.select(F.col("unit_id").alias("alignment_id"), "token_ids", F.col("unit_status").alias("status"))
    sel = k.where("confidence = 'low' or confidence is null").select(F.col("unit_id").alias("sel_id"), F.explode("token_ids").alias("token_id"))
    return lookup.selection_alignments(sel, a.where("status = 'reviewed'"), a.where("status <> 'reviewed'").drop("status"))


def linked_unit_terms(s, d):
    """For every word of a reviewed unit the wording of the other witness: the first word's own, else the whole unit's."""
    c = _cells(s, d).where("unit_status = 'reviewed'").select(F.col("unit_id").alias("passage"), "source", "text")
    w = effective.witnesses(c).where(F.size("tokens") > 0)
    ids = F.transform("tokens", lambda t: t.id)
    a = w.select("passage", "source", F.explode(F.array(
        F.struct(F.lit("whole").alias("alignment_id"), F.lit(1).alias("ord"), ids.alias("token_ids")), F.struct(F.lit("first").alias("alignment_id"), F.lit(2).alias("ord"), F.slice(ids, 1, 1).alias("token_ids")))).alias("a"))
    a = a.select("passage", "a.alignment_id", F.lit("token-span").alias("level"), "source", "a.token_ids", "a.ord")
    t = w.select("passage", "source", F.explode(ids).alias("token_id"))
    return lookup.linked_terms(t, a, a.drop("level").limit(0), w).select("passage", "token_id", "source", "text")


def candidate_defaults(s, d):
    u = _units(s, d).where("unit_status <> 'reviewed' or unit_status is null").select("unit_id", F.lit(None).cast("string").alias("level"), F.when(F.col("unit_order") % 2 == 0, F.col("unit_status")).alias("status"), "confidence")
    return lookup.with_candidate_defaults(u)


def status_precedence(s, d):
    u = _cells(s, d)
    root = F.col("unit_order") == 1
    policy = F.when(F.col("unit_order") % 4 == 0, "attested-only")
    edited, literal = F.col("unit_order") % 3 == 0, F.when(F.col("unit_order") % 5 == 0, "x")
    review = F.when(F.col("confidence") == "low", "unreviewed-machine-suggestion").when(F.col("confidence") == "medium", "unreviewed-textual-match")
    status = F.when(F.col("unit_status") == "reviewed", "dharmanexus-authorized").otherwise("machine-segmented")
    return u.select("unit_id", "source", lookup.status_label(status, policy, edited, literal, review, root).alias("label"))


def entry_origins(s, d):
    lx = read(s, d, "lexicon", "entry_id", "note", "gloss").where("entry_id is not null")
    n = F.regexp_extract("entry_id", r"(\d+)", 1).try_cast("int")
    status = F.when(n % 5 == 0, "dictionary-extract").when(n % 7 == 0, "text-critical")
    return lx.select("entry_id", lookup.glossary_origin(F.col("gloss"), status, n % 2 == 0).alias("glossary"), lookup.entry_origin(F.col("note"), n % 3).alias("record"))


def fallback_records(s, d):
    """Per bitext the unit that is selected, else the first that holds the term, else the first."""
    c = _cells(s, d).where("bitext_id is not null and unit_order is not null").groupBy("bitext_id", "unit_id").agg(F.min("unit_order").alias("unit_order"), F.max(F.lower("text").contains("lamp")).alias("hit"))
    c = c.withColumn("ord", F.struct("unit_order", "unit_id"))
    return lookup.record_or_fallback(c, "bitext_id", (F.col("bitext_id") % 3 == 0) & (F.col("unit_order") == 2), F.col("hit"), "ord").select("bitext_id", "unit_id")


def checked_new_alignments(s, d):
    u = _units(s, d).select(F.col("unit_id").alias("id"), F.transform_keys(F.coalesce("target_token_ids", F.create_map().cast("map<string,array<string>>")), lambda k, v: F.substring(k, 1, 3)).alias("targets"))
    ok, bad = edits.checked_alignments(u, "eng")
    return ok.select("id", F.lit("accepted").alias("outcome")).unionByName(bad.select("id", F.col("reason").alias("outcome")))


def published_lines(s, d):
    """Line texts after local ones are published: those of the last revision replace the first's."""
    r = _lines(s, d).select(F.col("line_id").alias("id"), F.col("revision").cast("bigint").alias("seq"), "text")
    out, _ = edits.publish({"units": r.where("seq = 1")}, {"units": r.where("seq > 1")})
    return out["units"].select("id", "seq", F.coalesce(F.length("text"), F.lit(-1)).alias("n_chars"))


def text_drafts(s, d):
    """Drafts after every line's last revision was entered: only those that differ from the first stay."""
    first, last = _first_and_last(s, d)
    new = last.withColumn("id", F.concat(F.lit("n-"), "passage"))
    old = last.where(F.length("text") % 2 == 0).withColumn("id", F.concat(F.lit("d-"), "passage"))
    return edits.text_edit_drafts(old, first, first.limit(0), new.select("passage", "source", "id", "text")).select("passage", "id")


def folded_ledgers(s, d):
    """Review histories of the users' events, with chains that break: what is published in the end."""
    e = read(s, d, "events", "event_id", "ts", "user_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("seq", F.row_number().over(w))
    # The version before an event, if all before were sound: the last accepted one.
    acc = F.col("seq") % 3 != 0
    before = F.last(F.when(acc, F.concat(F.lit("1+review.e"), "event_id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    broken = (F.col("user_id") % 5 == 0) & (F.col("seq") == 4)
    ev = e.select(F.col("user_id").cast("string").alias("manuscript_id"), "seq", F.concat(F.lit("e"), "event_id").alias("event_id"), F.concat(F.lit("p"), "event_id").alias("proposal_id"), F.lit("1").alias("base_version"),
                  F.when(broken, "x").otherwise(F.coalesce(before, F.lit("1"))).alias("previous_version"), F.when(acc, "accepted").otherwise("rejected").alias("decision"), F.lit("r").alias("reviewer"), F.col("event_type").alias("note"))
    k = F.count(F.when(acc, 1)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ch = e.select(F.col("user_id").cast("string").alias("manuscript_id"), F.concat(F.lit("e"), "event_id").alias("event_id"), F.lit("l").alias("target_id"), k.cast("int").alias("base_revision"), "event_type").withColumnRenamed("event_type", "value")
    base = e.select(F.col("user_id").cast("string").alias("manuscript_id")).distinct().select("manuscript_id", F.lit("1").alias("version"), F.lit("l").alias("target_id"), F.lit(0).alias("revision"), F.lit("none").alias("value"))
    return edits.apply_ledger(base, ev, ch).select("manuscript_id", "version", "problem", "revision", "value")


def component_tree(s, d):
    c = read(s, d, "library_components", "component_id", "document_id").where("component_id is not null").distinct()
    b = read(s, d, "library_blocks", "block_id", "component_id").where("block_id is not null").distinct()
    n = b.groupBy("block_id").agg(F.max("component_id").alias("component_id")).select(F.concat(F.lit("b:"), "block_id").alias("id"), F.concat(F.lit("c:"), "component_id").alias("parent_id"))
    n = n.unionByName(c.groupBy("component_id").agg(F.max("document_id").alias("document_id")).select(F.concat(F.lit("c:"), "component_id").alias("id"), F.concat(F.lit("d:"), "document_id").alias("parent_id")))
    n = n.unionByName(c.select(F.concat(F.lit("d:"), "document_id").alias("id"), F.lit(None).cast("string").alias("parent_id")).where("id is not null").distinct())
    return edits.unit_tree(n.withColumn("ord", F.length("id")), "ord").select("id", F.col("depth").cast("bigint").alias("depth"), "path")


def latest_syntax(s, d):
    e = read(s, d, "events", "event_id", "ts", "user_id", "event_type", "value").select(F.pmod("event_id", F.lit(97)).alias("id"), F.lit("s").alias("source"), F.col("user_id").alias("passage"), F.col("event_type").alias("sentence"), F.col("event_id").alias("seq"), "value")
    return lookup.latest_annotations(e).select("passage", "sentence", "seq", "value")


def word_inventory(s, d):
    """Words that differ between the lines' first and last revisions."""
    first, last = _first_and_last(s, d)
    now = last.unionByName(first.join(last.select("passage"), "passage", "left_anti"))
    named = lambda x: effective.witnesses(x.where("text is not null").select("passage", "source", "text"))
    return anchors.inventory_changes(named(first), named(now)).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def violated_targets(s, d):
    """Faults planted in the reviewed targets: a word left out, a word twice, another text, no words, a shared one."""
    c = _cells(s, d).where("unit_status = 'reviewed' and unit_order is not null").select(F.col("unit_id").alias("passage"), "source", "text", "unit_order")
    w = effective.witnesses(c.select("passage", "source", "text"))
    ids = F.transform("tokens", lambda t: t.id)
    n = F.size("tokens")
    own = F.when(F.col("unit_order") % 5 == 0, F.concat(F.slice(ids, 1, 1), F.slice(ids, 3, n))).when(F.col("unit_order") % 7 == 0, F.concat(ids, F.slice(ids, n, 1))).when(F.col("unit_order") % 11 == 0, F.slice(ids, 1, 0)).otherwise(ids)
    a, b = F.element_at("tokens", 1).start_pos, F.element_at("tokens", -1).end_pos
    t = w.where(n > 3).join(c.select("passage", "source", "unit_order"), ["passage", "source"])
    text = F.substring("text", (a + 1).cast("int"), (b - a).cast("int"))
    t = t.select("passage", F.col("passage").alias("unit_id"), "source", own.alias("token_ids"), F.when(F.col("unit_order") % 3 == 0, F.lit("other")).otherwise(text).alias("text"),
                 F.when(F.col("unit_order") % 4 == 0, "a-projection").otherwise("m").alias("method"), F.lit(None).cast("string").alias("group_id"), "unit_order")
    more = t.where("unit_order % 6 = 1").withColumn("unit_id", F.concat(F.lit("again-"), "unit_id"))
    t = t.unionByName(more)
    return anchors.target_violations(t, w)


def disjoint_pivots(s, d):
    e = read(s, d, "embeddings", "vec_id", "embedding", "label").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"))
    third = F.floor(F.col("id") / 3).cast("bigint")
    p = e.where("id % 20 <> 0").withColumn("units", F.array(third, third + 1))
    return align.best_disjoint_pivot(e.where("id % 20 = 0"), p, "label", least=0.2, margin=0.0).select("id", "pivot", "score", "margin")  # searches: every row divisible by 20, against all


def chosen_suggestions(s, d):
    """Greedy choice among the plans' pivots as spans of ten tokens, not crossing what stands at label's first unit."""
    e = read(s, d, "embeddings", "vec_id", "embedding", "label").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"))
    third = F.floor(F.col("id") / 3).cast("bigint")
    p = e.where("id % 20 <> 0").withColumn("units", F.array(third, third + 1))
    m = align.best_disjoint_pivot(e.where("id % 20 = 0"), p, "label", least=0.2, margin=0.0).join(e.select("id", "label"), "id")
    m = m.select("label", "id", (F.col("id") % 50).alias("lo"), (F.col("id") % 50 + 9).alias("hi"), "units", "score")
    a = e.groupBy("label").agg(F.min(third).alias("unit")).select("label", "unit", F.lit(0).alias("lo"), F.lit(3).alias("hi"))
    return align.choose_suggestions(m, a, "label").select("label", "id", "lo", "hi")


def _plan_phrases(s: SparkSession, d: str) -> DataFrame:
    """passage (bitext), source, numbers, phrase, seq: the start phrases of the plans that name units, in the plans' order."""
    p = latest(read(s, d, "semantic_plans", "plan_id", "bitext_id", "source_id", "passages", "drafted_at").where("plan_id is not null and bitext_id is not null and source_id is not null"), "plan_id", "drafted_at", ["bitext_id", "source_id", "passages"])
    p = p.select(F.col("bitext_id").cast("string").alias("passage"), F.col("source_id").alias("source"), "plan_id", F.explode("passages").alias("k", "items"))
    p = p.select("passage", "source", "plan_id", "k", F.posexplode("items").alias("ord", "i")).where(F.get("i", 0) != "_")
    return p.select("passage", "source", F.split(F.get("i", 0), ",").alias("numbers"), F.get("i", 1).alias("phrase"), F.struct("plan_id", "k", "ord").alias("seq"))


def repaired_alignment(s, d):
    """The alignment of the bitexts rebuilt: projections dropped, plan phrases anchored, overlaps resolved, all stamped.

    A start phrase that does not stand exactly once in its witness anchors nothing; ``anchors.repaired`` names it among the withheld.
    """
    eff = table(_effective(s, d), "witnesses")
    number, ord_ = F.coalesce("unit_number", "unit_id").alias("number"), F.col("unit_order").cast("bigint").alias("ord")
    c = _cells(s, d).where("bitext_id is not null").select(F.col("bitext_id").cast("string").alias("passage"), "unit_id", number, ord_, "source", F.col("text").alias("wanted"), "unit_status")
    u = _units(s, d).where("bitext_id is not null").select(F.col("bitext_id").cast("string").alias("passage"), "unit_id", number, ord_)
    t = anchors.found_spans(c, eff).where(F.size("token_ids") > 0)
    none = F.lit(None).cast("string")
    method = F.when(F.col("unit_status") == "reviewed", "supplied").when(F.col("ord") % 4 == 0, "positional-projection").otherwise("found")
    t = t.select("passage", "unit_id", "number", "ord", "source", "token_ids", F.col("wanted").alias("text"), method.alias("method"), F.lit(None).cast("double").alias("ratio"), none.alias("group_id"), none.alias("review"))
    low = read(s, d, "alignments", "unit_id", "bitext_id", "unit_number", "confidence", "targets").where("confidence = 'low'").select(F.col("bitext_id").cast("string").alias("passage"), F.coalesce("unit_number", "unit_id").alias("number"), F.explode(F.map_keys("targets")).alias("source"))
    base = t.agg(F.min("source")).first()[0] or ""
    out, withheld, dropped = anchors.repaired(table(t, "found"), eff, base, phrases=_plan_phrases(s, d), rejected=low, units=u, strict=False)
    return out.groupBy("source", "method").agg(F.count(F.lit(1)).alias("targets"), F.sum(F.size("token_ids")).alias("tokens"), F.count("group_id").alias("shared"))


def carried_revisions(s, d):
    """Thirds of every line's first revision found in its last, as spans of an edition."""
    first, last = _first_and_last(s, d)
    p = first.join(last.withColumnRenamed("text", "b"), ["passage", "source"]).select("passage", T.tokens(F.col("text")).alias("a_tokens"), T.tokens(F.col("b")).alias("b_tokens")).where("size(a_tokens) > 5")
    n = (F.size("a_tokens") / 3).cast("int")
    u = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(i.cast("string").alias("unit_id"), F.sequence(i * n, (i + 1) * n - 1).alias("idxs")))
    return align.edition_transfer(p.withColumn("units", u), "passage")


def line_citations(s, d):
    r = latest(read(s, d, "opening_lines", "line_id", "revision", "map_source", "line_scope", "text").where("line_id is not null"), "line_id", "received_at", ["revision", "map_source", "line_scope"])
    r = r.select(F.lit("Archive").alias("institution"), F.coalesce("map_source", F.lit("?")).alias("shelfmark"), F.regexp_extract("line_id", "^(.*)-l", 1).alias("surface"), "line_id", F.when(F.col("revision") > 1, F.col("line_id")).alias("line"),
                 F.lit("diplomatic").alias("layer"), F.col("revision").cast("string").alias("version"), F.lit(None).cast("string").alias("editor"), F.lit(None).cast("string").alias("annotation_id"), F.lit("u").alias("url"))
    return manuscripts.citation(r).select("line_id", "citation")


def tei_manuscripts(s, d):
    """Every map source as a TEI document of its lines."""
    r = _lines(s, d).where("text is not null").withColumn("m", F.coalesce("map_source", F.lit("none")))
    r = r.groupBy("m", "line_id").agg(F.max_by("text", F.struct("revision", "text")).alias("text"))
    r = r.select(F.col("m").alias("manuscript_id"), "line_id", F.regexp_extract("line_id", "^(.*)-l", 1).alias("surface_id"), F.coalesce(F.regexp_extract("line_id", r"-l(\d+)$", 1).try_cast("int"), F.lit(0)).alias("ord"), "text")
    r = table(r, "tei-lines")
    m = r.select("manuscript_id").distinct().select("manuscript_id", F.col("manuscript_id").alias("title"), F.lit("e").alias("editor"), F.lit("s").alias("source"))
    su = r.select("manuscript_id", "surface_id").distinct().select("manuscript_id", "surface_id", F.lit(1).alias("ord"), F.col("surface_id").alias("label"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.lit("u").alias("url"))
    empty = s.createDataFrame([], "manuscript_id string, region_id string, surface_id string, x int, y int, w int, h int")
    li = r.select("manuscript_id", "line_id", "surface_id", "ord", F.col("line_id").alias("label"), F.lit("draft").alias("status"), F.array().cast("array<string>").alias("region_ids"))
    mark = F.array(F.struct(F.lit("unclear").alias("type"), F.lit(0).alias("start"), F.least(F.lit(3), F.length("text")).alias("end"), F.lit("worn").alias("reason")))
    la = r.select("manuscript_id", "line_id", F.lit("diplomatic").alias("layer"), "text", F.lit(None).cast("string").alias("note"), mark.alias("marks"))
    an = r.groupBy("manuscript_id", "surface_id").agg(F.array_sort(F.collect_set("line_id")).alias("line_ids")).select("manuscript_id", F.concat(F.lit("a-"), "surface_id").alias("anchor_id"), F.lit("shows").alias("relation"), "line_ids", F.array().cast("array<string>").alias("passage_ids"))
    no = s.createDataFrame([], "manuscript_id string, annotation_id string, type string, target string, text string")
    ev = s.createDataFrame([], "manuscript_id string, seq int, decision string, decided_at string, reviewer string, note string")
    return conllu.tei_documents(m, su, empty, li, la, an, no, ev).select("manuscript_id", F.length("tei").alias("n_chars"), F.md5("tei").alias("h"))


def plan_clauses(s, d):
    """Clauses of the bitexts' second-language witnesses by the plans' start phrases."""
    p = read(s, d, "semantic_plans", "plan_id", "bitext_id", "source_id", "passages").where("plan_id is not null").dropDuplicates(["plan_id"]).groupBy("bitext_id", "source_id").agg(F.min_by("passages", "plan_id").alias("passages"))
    p = p.select(F.col("bitext_id").cast("string").alias("passage"), F.col("source_id").alias("source"), F.posexplode(F.try_element_at("passages", F.lit("1"))).alias("ord", "i"))
    c = p.select("source", "passage", "ord", F.array("ord").alias("units"), F.col("i")[1].alias("marker"), F.lit(None).cast("string").alias("end_marker"))
    ok, bad = library.clause_mappings(_whole(s, d), c)
    ok = ok.select("source", "passage", F.col("unit").alias("ord"), F.lit(None).cast("string").alias("problem"), F.col("end_pos").cast("bigint").alias("end_pos"))
    return ok.unionByName(bad.select("source", "passage", "ord", "problem", F.lit(None).cast("bigint").alias("end_pos")))


NAMES = """effective_lines reanchored_lines exact_unit_spans effective_units_and_targets shown_phrases shown_target_texts section_target_texts glossary_lookup selection_overlaps
linked_unit_terms candidate_defaults status_precedence entry_origins fallback_records checked_new_alignments published_lines text_drafts folded_ledgers component_tree
latest_syntax word_inventory violated_targets disjoint_pivots chosen_suggestions repaired_alignment carried_revisions line_citations tei_manuscripts plan_clauses""".split()
QUERIES = {n: globals()[n] for n in NAMES}


_TOK = T.TOKEN.replace("'", "''")
_L = (
    "g as (select line_id, arg_min(text, coalesce(text, '')) as a from (select distinct line_id, text from opening_lines where line_id is not null and text is not null) group by line_id"
    " union all select distinct line_id, null from opening_lines o where line_id is not null and not exists (select 1 from opening_lines p where p.line_id = o.line_id and p.text is not null)),"
    " l as (select *, case when length(a) % 3 = 0 then replace(a, 'a', 'e') when length(a) % 3 = 1 then substr(a, 11) end as b, b is not null as e, coalesce(b, a) as now from g)"
)
_C = _U + ", c as (select * from t where length(text) > 0)"
_W = (
    f"{_C}, cw as (select * from c where bitext_id is not null), ws as (select bitext_id, witness, string_agg(text, chr(10) order by unit_order, unit_id) as body from cw group by all),"
    f" wt as (select bitext_id, witness, body, [nfc_normalize(x) for x in regexp_extract_all(body, '{_TOK}')] as ws from ws)"
)
_SPAN = f"{_W}, x as (select cw.*, wt.ws, [nfc_normalize(y) for y in regexp_extract_all(cw.text, '{_TOK}')] as nd from cw join wt using (bitext_id, witness)), y as (select *, len(nd) as k, [i for i in generate_series(1, len(ws) - len(nd) + 1) if ws[i:i + len(nd) - 1] = nd] as found from x where len(nd) > 0)"
SQL = {
    "effective_lines": f"with {_L} select line_id as passage, length(now) as n_chars, e as edited, coalesce(len(regexp_extract_all(now, '{_TOK}')), 0) as n_tokens from l",
    "exact_unit_spans": f"with {_SPAN} select unit_id, witness as source, k as n, bitext_id || '-' || witness || '-t' || lpad(cast(found[1] as varchar), 5, '0') as first from y where len(found) = 1",
    "section_target_texts": f"with {_U}, e as (select unit_id, unit_order, unnest(map_entries(targets)) as m from u), s as (select unit_id, m.key as source, unit_order, case when unit_order % 3 = 0 then ' ' else m.value end as x from e) select unit_id, source, length(coalesce(x, '')) as n_chars from s where coalesce(unit_order % 2 = 0, false) or trim(coalesce(x, '')) <> ''",
    "selection_overlaps": f"with {_U}, s as (select distinct unit_id as sel_id, token_id from k where confidence = 'low' or confidence is null), r as (select distinct sel_id, unit_id from s join k using (token_id) where unit_status = 'reviewed'),"
        " cov as (select distinct r.sel_id, k.token_id from r join k on k.unit_id = r.unit_id), rest as (select * from s anti join cov using (sel_id, token_id))"
        " select sel_id, unit_id as alignment_id, 'reviewed' as tier from r union all select distinct sel_id, k.unit_id, 'candidate' from rest join k using (token_id) where k.unit_status <> 'reviewed'",
    "linked_unit_terms": f"with {_C}, r as (select unit_id, witness, text, regexp_extract_all(text, '{_TOK}') as ws from c where unit_status = 'reviewed'), g as (select *, instr(text, ws[1]) as a, length(text) - instr(reverse(text), reverse(ws[-1])) + 1 as b from r where len(ws) > 0),"
        " e as (select unit_id, witness, unnest(range(1, len(ws) + 1)) as i from g)"
        " select e.unit_id as passage, e.unit_id || '-' || e.witness || '-t' || lpad(cast(i as varchar), 5, '0') as token_id, g.witness as source, case when i = 1 then g.ws[1] else substr(g.text, g.a, g.b - g.a + 1) end as text from e join g on g.unit_id = e.unit_id and g.witness <> e.witness",
    "candidate_defaults": f"with {_U} select unit_id, 'token-span' as level, coalesce(case when unit_order % 2 = 0 and length(unit_status) > 0 then unit_status end, 'machine-suggested') as status, coalesce(case when length(confidence) > 0 then confidence end, 'low') as confidence from u where unit_status <> 'reviewed' or unit_status is null",
    "status_precedence": f"with {_C}, h as (select *, coalesce(unit_order % 3 = 0, false) as e, case when coalesce(unit_order % 3 = 0, false) or unit_order % 5 = 0 then null when confidence = 'low' then 'suggested · check span' when confidence = 'medium' then 'text match · draft' end as hint from c)"
        " select unit_id, witness as source, case when hint is not null then hint when unit_order % 4 = 0 and not e then case when unit_order = 1 then 'root · draft' else 'anchored draft' end"
        " when unit_order = 1 then case when unit_status = 'reviewed' then 'root · DharmaNexus' else 'root verse' end when e then 'edited' when unit_status = 'reviewed' then 'DharmaNexus base' else 'projected' end as label from h",
    "entry_origins": "with x as (select entry_id, note, gloss, try_cast(regexp_extract(entry_id, '(\\d+)', 1) as int) as n from lexicon where entry_id is not null)"
        " select entry_id, case when gloss is null then 'Unannotated' when n % 5 = 0 then 'Dictionary extract' when n % 7 = 0 then 'Text-critical working note' when n % 2 = 0 then 'Curated working glossary · draft' else 'Corpus working entry · draft' end as glossary,"
        " case when note is null then 'Unannotated' when n % 3 = 2 then 'Local draft' when n % 3 = 1 then 'Published editorial record' else 'Imported corpus record' end as record from x",
    "fallback_records": f"with {_C}, g as (select bitext_id, unit_id, min(unit_order) as o, bool_or(contains(lower(text), 'lamp')) as hit from c where bitext_id is not null and unit_order is not null group by all)"
        " select bitext_id, unit_id from g qualify row_number() over (partition by bitext_id order by case when bitext_id % 3 = 0 and o = 2 then 0 when hit then 1 else 2 end, o, unit_id) = 1",
    "checked_new_alignments": f"with {_U}, f as (select unit_id, count(*) filter (n_tokens > 0) as n, count(*) filter (n_tokens > 0 and witness like 'eng%') as e from n group by 1)"
        " select u.unit_id as id, case when coalesce(e, 0) = 0 then 'no base token' when f.n < 2 then 'one source only' else 'accepted' end as outcome from u left join f using (unit_id)",
    "published_lines": "with q as (select distinct line_id as id, cast(revision as bigint) as seq, text from opening_lines where line_id is not null) select id, seq, coalesce(length(text), -1) as n_chars from q qualify row_number() over (partition by id order by case when seq > 1 then 1 else 0 end desc, seq desc) = 1",
    "text_drafts": f"with {_L} select line_id as passage, case when length(b) % 2 = 0 then 'd-' else 'n-' end || line_id as id from l where e and b <> coalesce(a, '')",
    "component_tree": "with recursive b as (select 'b:' || block_id as id, 'c:' || max(component_id) as p from library_blocks where block_id is not null group by block_id), c as (select 'c:' || component_id as id, 'd:' || max(document_id) as p from library_components where component_id is not null group by component_id),"
        " d as (select distinct 'd:' || document_id as id, cast(null as varchar) as p from library_components where component_id is not null and document_id is not null), a as (select * from b union all select * from c union all select * from d),"
        " m as (select a.id, z.id as p from a left join (select id from a) z on a.p = z.id), o as (select *, lpad(cast(row_number() over (partition by p order by length(id), id) as varchar), 6, '0') as n from m),"
        " r(id, depth, path) as (select id, 0, n from o where p is null union all select o.id, r.depth + 1, r.path || '.' || o.n from o join r on o.p = r.id) select id, cast(depth as bigint) as depth, path from r",
    "latest_syntax": "with i as (select event_id, user_id, event_type, value from events qualify row_number() over (partition by event_id % 97 order by event_id desc) = 1) select user_id as passage, event_type as sentence, event_id as seq, value from i qualify row_number() over (partition by user_id, event_type order by event_id desc) = 1",
    "word_inventory": f"with {_L}, o as (select line_id, regexp_extract_all(a, '{_TOK}') as x from l where a is not null), w as (select line_id, regexp_extract_all(now, '{_TOK}') as x from l where now is not null),"
        " p as (select line_id, unnest(x) as s, generate_subscripts(x, 1) as i from o), q2 as (select line_id, unnest(x) as s, generate_subscripts(x, 1) as i from w),"
        " j as (select case when q2.s is null then 'lost' when p.s is null then 'new' when p.s <> q2.s then 'changed' end as change from p full join q2 using (line_id, i)) select change, count(*) as n from j where change is not null group by 1",
    "violated_targets": f"with {_C}, r as (select unit_id, witness, unit_order as o, len(regexp_extract_all(text, '{_TOK}')) as n from c where unit_status = 'reviewed' and unit_order is not null), g as (select * from r where n > 3),"
        " e as (select unit_id, witness, o, n, false as again from g union all select 'again-' || unit_id, witness, o, n, true from g where o % 6 = 1), f as (select *, o % 5 = 0 as gap, o % 5 <> 0 and o % 7 = 0 as twice, o % 5 <> 0 and o % 7 <> 0 and o % 11 = 0 as none from e)"
        " select unit_id, witness as source, 'invalid token ids' as problem from f where none union all select unit_id, witness, 'duplicate token ids' from f where twice union all select unit_id, witness, 'noncontiguous' from f where gap or twice"
        " union all select unit_id, witness, 'text mismatch' from f where o % 3 = 0 and not none union all select unit_id, witness, 'projection retained' from f where o % 4 = 0 union all select unit_id, witness, 'unmarked overlap' from f where o % 6 = 1 and not none",
    "disjoint_pivots": "with x as (select a.vec_id as id, b.vec_id as p, b.vec_id // 3 as u, list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])) / (sqrt(list_dot_product(cast(a.embedding as double[]), cast(a.embedding as double[]))) * sqrt(list_dot_product(cast(b.embedding as double[]), cast(b.embedding as double[])))) as s"
        " from embeddings a join embeddings b on a.label = b.label where a.vec_id % 20 = 0 and b.vec_id % 20 <> 0), b as (select id, p as bp, u as bu, s as bs from x qualify row_number() over (partition by id order by s desc, p) = 1),"
        " j as (select * from x join b using (id)), g as (select id, any_value(bs) as bs, coalesce(max(s) filter (abs(u - bu) > 1), 0) as other from j group by id), m as (select id, p from j where u = bu and s >= bs - 0.04 qualify row_number() over (partition by id order by s desc, p) = 1)"
        " select id, p as pivot, round(bs, 6) as score, round(bs - other, 6) as margin from g join m using (id) where bs >= 0.2 and bs - other >= 0",
    "line_citations": "with q as (select line_id, revision, map_source, line_scope from opening_lines where line_id is not null)"
        " select distinct line_id, 'Archive, ' || coalesce(map_source, '?') || ', ' || regexp_extract(line_id, '^(.*)-l', 1) || ', ' || case when revision > 1 then line_id else 'surface' end || '; diplomatic, ' || revision || '. u' as citation from q",
}
