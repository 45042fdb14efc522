"""Queries of the corpus operators over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import align, edits, lexicon, manuscripts, spans, tokens
from loomtext.operators.windows import running_before
from loomtext.sources import conllu
from loomtext.sources.tables import read

QUERY_TERM = "mirror"


def _docs(s: SparkSession, d: str, *cols: str) -> DataFrame:
    return read(s, d, "documents", *cols)


def token_frequency(s, d):
    return tokens.form_frequency(_docs(s, d, "passage_id", "text"), "text", "passage_id")


def token_offsets(s, d):
    return tokens.token_offsets(_docs(s, d, "doc_id", "text"), "doc_id", "text").select("doc_id", "idx", "surface", "start_pos", "end_pos")


def kwic_concordance(s, d):
    c = tokens.concordance(_docs(s, d, "doc_id", "text"), "doc_id", "text", QUERY_TERM)
    return c.orderBy("doc_id", "idx").limit(120)  # the reference lists at most 120 hits


def witness_statistics(s, d):
    return tokens.witness_statistics(_docs(s, d, "source", "passage_id", "text"), "source", "passage_id", "text")


def type_token_rollup(s, d):
    t = tokens.token_forms(_docs(s, d, "lang", "source", "text"), "text", "lang", "source")
    per = t.groupBy("lang", "source", "norm").agg(F.count(F.lit(1)).alias("k"))
    return per.rollup("lang", "source").agg(F.sum("k").alias("tokens"), F.count_distinct("norm").alias("types"), F.grouping_id().alias("level"))


def top_forms_per_source(s, d):
    t = tokens.token_forms(_docs(s, d, "source", "text"), "text", "source").groupBy("source", "norm").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source").orderBy(F.desc("n"), "norm")
    return t.withColumn("rank", F.row_number().over(w)).where("rank <= 20").select("source", F.col("norm").alias("form"), "n", F.col("rank").cast("bigint").alias("rank"))


def forms_shared_across_langs(s, d):
    t = tokens.token_forms(_docs(s, d, "lang", "text").where("lang is not null"), "text", "lang").select("lang", "norm").distinct()
    return t.groupBy(F.col("norm").alias("form")).agg(F.count(F.lit(1)).alias("langs")).where("langs > 1")


def search_documents(s, d):
    return _docs(s, d, "doc_id", "source", "text").where(F.lower("text").contains(QUERY_TERM)).select("doc_id", "source", F.length("text").alias("n_chars"))


def library_language_filter(s, d):
    row = F.lower(F.to_json(F.struct("*")))
    return _docs(s, d).where((F.col("lang") == "de") & row.contains("cata")).select("doc_id", "doc_kind")


def corpus_summary(s, d):
    def count(name, df):
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")

    a = read(s, d, "alignments", "unit_id", "unit_status").distinct()
    out = count("documents", _docs(s, d, "doc_id"))
    out = out.unionByName(count("reviewed units", a.where("unit_status = 'reviewed'"))).unionByName(count("unassigned units", a.where("unit_status = 'unassigned'")))
    return out.unionByName(count("tokens", tokens.token_forms(_docs(s, d, "text"), "text")))


def documents_per_source(s, d):
    return _docs(s, d, "source", "lang", "n_chars").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count_distinct("lang").alias("langs"), F.sum("n_chars").alias("chars"))


def clean_texts(s, d):
    return _docs(s, d, "doc_id", "text").where("text is not null").select("doc_id", F.length(T.clean_text(F.col("text"))).alias("n"), F.md5(T.clean_text(F.col("text"))).alias("h"))


def paragraph_snippets(s, d):
    t = tokens.token_offsets(_docs(s, d, "doc_id", "text").where(F.lower("text").contains(QUERY_TERM)), "doc_id", "text").where(F.col("norm") == QUERY_TERM)
    first = t.groupBy("doc_id").agg(F.min_by("start_pos", "idx").alias("a"), F.min_by("end_pos", "idx").alias("b"))
    return first.join(_docs(s, d, "doc_id", "text"), "doc_id").select("doc_id", T.snippet(F.col("text"), F.col("a"), F.col("b")).alias("snippet"))


def unit_sort_keys(s, d):
    a = read(s, d, "alignments", "unit_id", "unit_number", "unit_order").distinct()
    return a.select(T.canonical_unit(F.col("unit_id")).alias("unit"), T.unit_order(F.when(F.col("unit_order") % 2 == 0, F.col("unit_order")), F.col("unit_number")).alias("sort_key"))


def lexicon_forms(s, d):
    return lexicon.entry_forms(read(s, d, "lexicon", "entry_id", "lemma", "forms")).select("entry_id", F.col("form_ord").cast("bigint").alias("form_ord"), "form")


def _lex_tokens(s, d):
    t = tokens.token_offsets(_docs(s, d, "doc_id", "lang", "text"), "doc_id", "text", "lang")
    return t.select("doc_id", "lang", "idx", "norm")


def lexicon_matches(s, d):
    m = lexicon.longest_matches(_lex_tokens(s, d), read(s, d, "lexicon", "entry_id", "lemma", "forms"))
    return m.select("doc_id", "idx", "entry_id", "start_idx", F.col("n_parts").cast("bigint").alias("n_parts"))


def glossary_coverage(s, d):
    t = _lex_tokens(s, d)
    return lexicon.coverage(t, lexicon.longest_matches(t, read(s, d, "lexicon", "entry_id", "lemma", "forms")), "lang")


def cross_language_evidence(s, d):
    order = F.create_map(*[F.lit(x) for kv in {"deu": 0, "hin": 1, "zho": 2, "bod": 3}.items() for x in kv])
    e = read(s, d, "lexicon", "entry_id", "equivalents").select("entry_id", F.explode("equivalents").alias("lang", "v")).where("size(v) > 0")
    w = Window.partitionBy("entry_id").orderBy(order[F.col("lang")])
    return e.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("entry_id", "lang", F.col("v")[0].alias("evidence"))


def span_token_overlap(s, d):
    t = tokens.token_offsets(_docs(s, d, "doc_id", "text"), "doc_id", "text")
    sp = _docs(s, d, "doc_id", "n_chars").where("n_chars >= 200").select("doc_id", F.lit(50).alias("start_pos"), F.lit(120).alias("end_pos"))
    return spans.span_tokens(sp, t, "doc_id").groupBy("s.doc_id").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count(F.lit(1)).alias("n"))


def _fragments(s, d):
    return read(s, d, "passage_mappings", "fragment_id", "block_id", "start_pos", "end_pos").where("block_id is not null and start_pos < end_pos").distinct()


def overlap_islands(s, d):
    f = _fragments(s, d).withColumn("hi", F.col("end_pos") - 1)
    c = spans.overlap_components(f, ["block_id"], "start_pos", "hi")
    return c.groupBy("block_id", "component").agg(F.min("start_pos").alias("lo"), F.max("end_pos").alias("hi"), F.count(F.lit(1)).alias("n")).drop("component")


def unassigned_runs(s, d):
    a = read(s, d, "alignments", "bitext_id", "unit_status", "unit_order", "targets").where("unit_status = 'unassigned'")
    return spans.runs(a.select("bitext_id", F.explode(F.map_keys("targets")).alias("witness"), "unit_order"), ["bitext_id", "witness"], "unit_order")


def method_histogram(s, d):
    a = read(s, d, "alignments", "unit_id", "mapping_methods").dropDuplicates(["unit_id"])
    return a.select("unit_id", F.explode("mapping_methods").alias("witness", "method")).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("unit_id").alias("units"))


def coverage_by_witness(s, d):
    a = read(s, d, "alignments", "unit_id", "unit_status", "targets").dropDuplicates(["unit_id"]).select("unit_id", "unit_status", F.explode(F.map_keys("targets")).alias("witness"))
    done = F.sum(F.when(F.col("unit_status") == "reviewed", 1).otherwise(0))
    return a.groupBy("witness").agg(done.alias("assigned"), F.count(F.lit(1)).alias("total")).withColumn("per_cent", F.round(100.0 * F.col("assigned") / F.col("total"), 6))


def effective_target_text(s, d):
    a = read(s, d, "alignments", "unit_id", "targets", "target_token_ids").dropDuplicates(["unit_id"]).select("unit_id", "target_token_ids", F.explode("targets").alias("witness", "text"))
    ids = F.try_element_at("target_token_ids", F.col("witness"))
    state = F.when(F.coalesce(F.length("text"), F.lit(0)) > 0, "literal").when(F.coalesce(F.size(ids), F.lit(0)) > 0, "tokens").otherwise("none")
    return a.select("unit_id", "witness", state.alias("text_from"), F.greatest(F.coalesce(F.size(ids), F.lit(0)), F.lit(0)).cast("bigint").alias("n_tokens"))


def comparison_grid(s, d):
    a = read(s, d, "alignments", "unit_id", "unit_status", "targets").where("unit_status = 'reviewed'").dropDuplicates(["unit_id"])
    a = a.select("unit_id", F.explode("targets").alias("witness", "text")).withColumn("lang", F.substring("witness", 1, 3))
    return a.groupBy("unit_id").pivot("lang", ["eng", "deu", "hin", "zho", "bod"]).agg(F.min("text"))


def alignment_overlaps(s, d):
    a = read(s, d, "alignments", "unit_id", "passage_id", "target_token_ids").dropDuplicates(["unit_id"]).select("unit_id", F.explode("target_token_ids").alias("witness", "ids")).select("unit_id", F.explode("ids").alias("token"))
    shared = a.groupBy("token").agg(F.count_distinct("unit_id").alias("c")).where("c > 1")
    return a.join(shared, "token", "left_semi").groupBy("unit_id").agg(F.count_distinct("token").alias("shared_tokens"))


def fragment_bounds(s, d):
    b = read(s, d, "library_blocks", "block_id", "n_chars").where("block_id is not null").groupBy("block_id").agg(F.max("n_chars").alias("n_chars"))
    f = read(s, d, "passage_mappings", "fragment_id", "block_id", "start_pos", "end_pos").distinct()
    return f.join(b, "block_id").where("start_pos < 0 or start_pos >= end_pos or end_pos > n_chars").select("fragment_id", "block_id", "start_pos", "end_pos", "n_chars")


def latest_edit_wins(s, d):
    e = read(s, d, "events", "event_id", "ts", "user_id", "event_type", "value")
    return edits.last_wins(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def tiered_union_merge(s, d):
    e = read(s, d, "events", "event_id", "user_id", "event_type", "value").withColumn("key", F.col("user_id"))
    layers = [e.where(F.pmod("event_id", F.lit(3)) == i).select("key", "event_id", "value") for i in range(3)]
    return edits.tiered_union(layers, ["key"], "event_id").select("key", "event_id", "value", F.col("tier").cast("bigint").alias("tier"))


def descendant_closure(s, d):
    c = read(s, d, "library_components", "component_id", "document_id").distinct()
    b = read(s, d, "library_blocks", "block_id", "component_id").where("block_id is not null").distinct()
    n = b.select(F.concat(F.lit("b:"), "block_id").alias("id"), F.concat(F.lit("c:"), "component_id").alias("parent_id"))
    n = n.unionByName(c.select(F.concat(F.lit("c:"), "component_id").alias("id"), F.concat(F.lit("d:"), "document_id").alias("parent_id")))
    n = n.unionByName(c.select(F.concat(F.lit("d:"), "document_id").alias("id"), F.lit("root").alias("parent_id")).distinct())
    n = n.unionByName(s.range(1).select(F.lit("root").alias("id"), F.lit(None).cast("string").alias("parent_id")))
    return edits.descendants(n, "root").select("id", F.col("depth").cast("bigint").alias("depth"))


def embedding_best_match_margin(s, d):
    e = read(s, d, "embeddings", "vec_id", "embedding", "label").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"))
    return align.best_match_margin(e.where("id % 20 = 0"), e, "label").select("a_id", "b_id", "score", "margin", "accepted")  # searches: every row divisible by 20, against all


def greedy_suggestions(s, d):
    m = embedding_best_match_margin(s, d).join(read(s, d, "embeddings", "vec_id", "label").withColumnRenamed("vec_id", "a_id"), "a_id").select("label", "a_id", "b_id", "score")
    return align.greedy_pairs(m, "label")


def _editions(s, d):
    t = _docs(s, d, "doc_id", "text").where("length(text) > 0")
    return t.select("doc_id", T.tokens(F.col("text")).alias("a_tokens"), T.tokens(F.regexp_replace("text", r"\b(the|der|die|das)\b ", "")).alias("b_tokens"))


def matching_blocks_transfer(s, d):
    r = read(s, d, "opening_lines", "line_id", "text").where("length(text) > 0").dropDuplicates(["line_id"])
    p = r.select("line_id", T.tokens(F.col("text")).alias("a_tokens"), T.tokens(F.regexp_replace("text", r"\b(the|der|die|das|ni|gyi)\b ", "")).alias("b_tokens"))
    return align.transfer_ratio(p, "line_id")


def edition_token_pairs(s, d):
    r = read(s, d, "opening_lines", "line_id", "text").where("length(text) > 0").dropDuplicates(["line_id"])
    p = r.select("line_id", T.tokens(F.col("text")).alias("a_tokens"), T.tokens(F.regexp_replace("text", r"\b(the|der|die|das|ni|gyi)\b ", "")).alias("b_tokens"))
    return align.matching_tokens(p, "line_id")


def lcs_root_tokens(s, d):
    r = read(s, d, "opening_lines", "line_id", "text").where("length(text) > 0").dropDuplicates(["line_id"])
    p = r.select("line_id", T.tokens(F.lower(F.regexp_replace("text", r"[aeiou]+ ", " "))).alias("root"), T.tokens(F.lower("text")).alias("witness"))
    return align.lcs_tokens(p, "line_id")


def reanchor_tokens(s, d):
    e = _editions(s, d).select("doc_id", F.transform("a_tokens", F.lower).alias("a"), F.transform("b_tokens", F.lower).alias("b"))
    return tokens.context_pairs(e.select("doc_id", F.col("a").alias("before"), F.col("b").alias("after")), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("new_idx").cast("bigint")).alias("new_sum"))


def fold_search(s, d):
    r = _docs(s, d, "doc_id", "text").where("text is not null")
    return r.where(T.fold_udf(F.col("text")).contains("mirror")).select("doc_id")


def line_terms(s, d):
    r = read(s, d, "opening_lines", "line_id", "text").where("text is not null").distinct()
    return manuscripts.line_concordance(r, "line_id", "text")


def line_search(s, d):
    r = read(s, d, "checked_readings", "reading_id", "reading_layer", "review_status", "text").distinct()
    r = r.select("reading_id", F.col("reading_layer").alias("layer"), F.col("review_status").alias("status"), "text")
    return manuscripts.line_search(r, QUERY_TERM, layer="checked").select("reading_id", "status")


def conllu_export(s, d):
    a = read(s, d, "alignments", "unit_id", "unit_status", "targets").where("unit_status = 'reviewed'").dropDuplicates(["unit_id"])
    t = a.select("unit_id", F.explode("targets").alias("witness", "text")).where("text is not null")
    t = t.select(F.concat_ws("/", "unit_id", "witness").alias("unit_id"), "text")
    k = t.select("unit_id", "text", F.posexplode(T.tokens(F.col("text"))).alias("idx", "form"))
    k = k.select("unit_id", "text", "idx", "form", F.lower("form").alias("lemma"), F.lit(None).cast("string").alias("upos"), F.format_string("%s-t%05d", "unit_id", F.col("idx") + 1).alias("token_id"))
    return conllu.to_conllu(k, "unit_id", "text")


def conllu_round_trip(s, d):
    return conllu.parse_conllu(conllu_export(s, d), "unit_id", "conllu").select("unit_id", "id", "form", "misc")


def tei_export(s, d):
    r = read(s, d, "opening_lines", "line_id", "text").where("text is not null").distinct()
    r = r.select(F.regexp_extract("line_id", "^(.*)-l", 1).alias("surface"), F.regexp_extract("line_id", r"-l(\d+)$", 1).cast("int").alias("n"), "text")
    return conllu.to_tei(r.groupBy("surface", "n").agg(F.min("text").alias("text")), "surface", "n", "text")


def duplicate_text_groups(s, d):
    t = _docs(s, d, "doc_id", "text").where("text is not null")
    return t.groupBy(F.md5("text").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1").select("first_id", "n")


def duplicate_unit_ids(s, d):
    a = read(s, d, "alignments", "unit_id")
    return a.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def revised_lines(s, d):
    r = read(s, d, "opening_lines", "line_id", "revision", "text").distinct()
    return edits.last_wins(r, ["line_id"], ["revision"]).select("line_id", "revision", F.coalesce(F.length("text"), F.lit(-1)).alias("n_chars"))


def passage_next_start(s, d):
    f = read(s, d, "text_selections", "selection_id", "block_id", "start_pos", "end_pos").where("block_id is not null and start_pos is not null").distinct()
    # Buckets of positions: the next start of a bucket's last row is the first start of the next bucket.
    f = f.withColumn("b", F.floor(F.col("start_pos") / 4096))
    w = Window.partitionBy("block_id", "b").orderBy("start_pos", "selection_id")
    tops = f.groupBy("block_id", "b").agg(F.min("start_pos").alias("first"))
    tops = tops.select("block_id", "b", F.lead("first").over(Window.partitionBy("block_id").orderBy("b")).alias("later"))
    g = f.withColumn("own", F.lead("start_pos").over(w)).join(tops, ["block_id", "b"]).withColumn("next_start", F.coalesce("own", "later"))
    return g.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("next_start").cast("bigint")).alias("next_sum"))


def forward_filled_pages(s, d):
    r = read(s, d, "checked_readings", "reading_id", "document_id", "pdf_page").dropDuplicates(["reading_id"])
    # The last page so far is the largest (reading, page); ids of one length sort by their first signs, which are the bucket.
    r = r.withColumn("b", F.expr("substring(reading_id, 1, length(reading_id) - 3)")).withColumn("seen", F.when(F.col("pdf_page").isNotNull(), F.struct("reading_id", "pdf_page")))
    r = running_before(r.withColumn("document_id", F.coalesce("document_id", F.lit(""))), ["document_id"], "b", "reading_id", "seen", F.max, F.greatest, "before")
    return r.select("reading_id", F.coalesce("pdf_page", "before.pdf_page", F.lit(-1)).alias("page"))


NAMES = """token_frequency token_offsets kwic_concordance witness_statistics type_token_rollup top_forms_per_source forms_shared_across_langs
search_documents library_language_filter corpus_summary documents_per_source clean_texts paragraph_snippets unit_sort_keys lexicon_forms lexicon_matches
glossary_coverage cross_language_evidence span_token_overlap overlap_islands unassigned_runs method_histogram coverage_by_witness effective_target_text
comparison_grid alignment_overlaps fragment_bounds latest_edit_wins tiered_union_merge descendant_closure embedding_best_match_margin greedy_suggestions
matching_blocks_transfer edition_token_pairs lcs_root_tokens reanchor_tokens fold_search line_terms line_search conllu_export conllu_round_trip tei_export
duplicate_text_groups duplicate_unit_ids revised_lines passage_next_start forward_filled_pages""".split()
QUERIES = {n: globals()[n] for n in NAMES}

_TOK = T.TOKEN.replace("'", "''")
_PIECE = T.PIECE.replace("'", "''")
_MS = T.MS_TOKEN.replace("'", "''")
_T = f"t as (select *, unnest(regexp_extract_all(text, '{_TOK}')) as surface from documents where text is not null), k as (select *, lower(surface) as norm from t)"
_FROM, _TO = T.compatible()
_F = f"{_T}, fs as (select surface, trim(lower(nfc_normalize(case when regexp_matches(surface, '[{_FROM}]') then translate(surface, '{_FROM}', '{_TO}') else surface end))) as form from (select distinct surface from k)), f as (select * from k join fs using (surface))"
_O = (
    f"p as (select doc_id, lang, text, unnest(regexp_extract_all(text, '{_PIECE}')) as surface, generate_subscripts(regexp_extract_all(text, '{_PIECE}'), 1) as pos from documents where text is not null),"
    " q as (select *, sum(length(surface)) over (partition by doc_id order by pos) as end_pos from p),"
    " o as (select doc_id, lang, text, surface, lower(surface) as norm, cast(end_pos - length(surface) as bigint) as start_pos, cast(end_pos as bigint) as end_pos,"
    " row_number() over (partition by doc_id order by pos) - 1 as idx from q where regexp_matches(surface, '^[\\p{L}\\p{M}\\p{N}]'))"
)
_UNITS = "u as (select unit_id, any_value(unit_status) as unit_status, any_value(targets) as targets, any_value(target_token_ids) as ids, any_value(mapping_methods) as methods from alignments group by unit_id)"
_UT = _UNITS + ", ut as (select unit_id, unit_status, e.key as witness, e.value as text, ids from (select unit_id, unit_status, ids, unnest(map_entries(targets)) as e from u))"
_LEX = (
    "f as (select entry_id, list_distinct([x for x in list_concat(case when lemma is null or contains(lemma, '/') then [] else [lemma] end, coalesce(forms, [])) if x is not null]) as raw_forms,"
    " list_concat(case when lemma is null or contains(lemma, '/') then [] else [lemma] end, coalesce(forms, [])) as ordered from lexicon),"
    " f1 as (select entry_id, unnest(ordered) as form, generate_subscripts(ordered, 1) as g from f), f2 as (select entry_id, form, min(g) as g from f1 where form is not null group by all),"
    " forms as (select entry_id, form, row_number() over (partition by entry_id order by g) - 1 as form_ord from f2)"
)
_MATCH = (
    f"with {_O}, {_LEX}, parts as (select entry_id, form, form_ord, [x for x in regexp_split_to_array(lower(form), '\\s+') if x <> ''] as ps from forms),"
    " tk as (select doc_id, lang, idx, norm from o),"
    " e as (select entry_id, form_ord, len(ps) as n, unnest(ps) as part, generate_subscripts(ps, 1) - 1 as k from parts where len(ps) > 0),"
    " c as (select tk.doc_id, tk.idx - e.k as start_idx, e.entry_id, e.form_ord, e.n, count(*) as got from tk join e on tk.norm = e.part group by all having count(*) = e.n),"
    " h as (select doc_id, start_idx, entry_id, form_ord, n, unnest(generate_series(start_idx, start_idx + n - 1)) as idx from c),"
    " b as (select * from h qualify row_number() over (partition by doc_id, idx order by n desc, entry_id, form_ord, start_idx desc) = 1)"
)

SQL = {
    "token_frequency": f"with {_F} select form, count(*) as n, count(distinct passage_id) as n_passages, arg_min(surface, (passage_id is not null, coalesce(passage_id, ''), surface)) as surface,"
        " case when bool_or(passage_id is null) then null else min(passage_id) end as first_passage from f where form <> '' group by form",
    "token_offsets": f"with {_O} select doc_id, idx, surface, start_pos, end_pos from o",
    "kwic_concordance": f"with {_O} select doc_id, idx, start_pos, case when start_pos > 72 then '…' else '' end || substr(text, greatest(start_pos - 72, 0) + 1, start_pos - greatest(start_pos - 72, 0)) as left_context, surface,"
        f" substr(text, end_pos + 1, 100) || case when end_pos + 100 < length(text) then '…' else '' end as right_context from o where norm = '{QUERY_TERM}' order by doc_id, idx limit 120",
    "witness_statistics": f"with {_T}, a as (select source, count(*) as tokens, count(distinct norm) as unique_forms, count(distinct passage_id) as units from k group by source)"
        " select d.source, coalesce(tokens, 0) as tokens, coalesce(unique_forms, 0) as unique_forms, coalesce(units, 0) as units,"
        " case when coalesce(tokens, 0) = 0 then 0.0 else round(unique_forms / tokens, 6) end as ttr, case when coalesce(units, 0) = 0 then 0.0 else round(tokens / units, 6) end as tokens_per_unit"
        " from (select distinct source from documents) d left join a using (source)",
    "type_token_rollup": f"with {_T} select lang, source, cast(count(*) as bigint) as tokens, count(distinct norm) as types, cast(grouping(lang, source) as bigint) as level from k group by rollup(lang, source)",
    "top_forms_per_source": f"with {_T}, c as (select source, norm as form, count(*) as n from k group by all) select source, form, n, row_number() over (partition by source order by n desc, form) as rank from c qualify rank <= 20",
    "forms_shared_across_langs": f"with {_T} select norm as form, count(distinct lang) as langs from k where lang is not null group by norm having count(distinct lang) > 1",
    "search_documents": f"select doc_id, source, length(text) as n_chars from documents where contains(lower(text), '{QUERY_TERM}')",
    "library_language_filter": "select doc_id, doc_kind from documents where lang = 'de' and (contains(lower(coalesce(doc_kind, '')), 'cata') or contains(lower(coalesce(text, '')), 'cata') or contains(lower(coalesce(source, '')), 'cata') or contains(lower(coalesce(passage_id, '')), 'cata'))",
    "corpus_summary": f"with {_T}, {_UNITS} select 'documents' as what, count(*) as n from documents union all select 'reviewed units', count(*) from u where unit_status = 'reviewed'"
        " union all select 'unassigned units', count(*) from u where unit_status = 'unassigned' union all select 'tokens', count(*) from k",
    "documents_per_source": "select source, count(*) as docs, count(distinct lang) as langs, cast(sum(n_chars) as bigint) as chars from documents group by source",
    "clean_texts": r"with c as (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') as t from documents where text is not null)"
        " select doc_id, length(t) as n, md5(t) as h from c",
    "paragraph_snippets": f"with {_O}, f as (select doc_id, any_value(text) as text, arg_min(start_pos, idx) as a, arg_min(end_pos, idx) as b from o where norm = '{QUERY_TERM}' group by doc_id),"
        " g as (select *, case when contains(substr(text, 1, a + 2), chr(10) || chr(10)) then length(substr(text, 1, a + 2)) - instr(reverse(substr(text, 1, a + 2)), chr(10) || chr(10)) - 1 else -1 end as p, instr(substr(text, b + 1), chr(10) || chr(10)) - 1 as q from f),"
        " h as (select *, case when p >= 0 and a - p < 220 then p + 2 else greatest(a - 110, 0) end as x, case when q >= 0 and q < 280 then b + q else least(b + 150, length(text)) end as y from g)"
        " select doc_id, case when x > 0 then '… ' else '' end || substr(text, x + 1, a - x) || '<mark>' || substr(text, a + 1, b - a) || '</mark>' || substr(text, b + 1, y - b) || case when y < length(text) then ' …' else '' end as snippet from h",
    "unit_sort_keys": "select unit_id as unit, coalesce(case when unit_order % 2 = 0 then unit_order end, try_cast(split_part(unit_number, '.', -1) as bigint), 9007199254740991) as sort_key from (select distinct unit_id, unit_number, unit_order from alignments)",
    "lexicon_forms": f"with {_LEX} select entry_id, form_ord, form from forms",
    "lexicon_matches": _MATCH + " select doc_id, idx, entry_id, start_idx, cast(n as bigint) as n_parts from b",
    "glossary_coverage": _MATCH + ", j as (select tk.lang, tk.norm, count(*) as n, count(b.entry_id) as h from tk left join b using (doc_id, idx) where regexp_matches(tk.norm, '\\p{L}') group by all)"
        " select lang, cast(sum(n) as bigint) as tokens, cast(sum(h) as bigint) as covered_tokens, count(*) as types, count(*) filter (h > 0) as covered_types,"
        " round(100.0 * sum(h) / sum(n), 6) as token_coverage, round(100.0 * count(*) filter (h > 0) / count(*), 6) as type_coverage from j group by lang",
    "cross_language_evidence": "with e as (select entry_id, unnest(map_entries(equivalents)) as m from lexicon) select entry_id, m.key as lang, m.value[1] as evidence from e where len(m.value) > 0"
        " qualify row_number() over (partition by entry_id order by list_position(['deu','hin','zho','bod'], m.key)) = 1",
    "span_token_overlap": f"with {_O} select doc_id, min(idx) as lo, max(idx) as hi, count(*) as n from o join (select doc_id from documents where n_chars >= 200) using (doc_id) where start_pos < 120 and end_pos > 50 group by doc_id",
    "overlap_islands": "with f as (select distinct fragment_id, block_id, start_pos, end_pos from passage_mappings where block_id is not null and start_pos < end_pos),"
        " g as (select *, case when start_pos > max(end_pos - 1) over (partition by block_id order by start_pos, end_pos rows between unbounded preceding and 1 preceding) then 1 else 0 end as b from f),"
        " h as (select *, sum(b) over (partition by block_id order by start_pos, end_pos rows unbounded preceding) as c from g) select block_id, min(start_pos) as lo, max(end_pos) as hi, count(*) as n from h group by block_id, c",
    "unassigned_runs": "with a as (select distinct bitext_id, unnest(map_keys(targets)) as witness, unit_order from alignments where unit_status = 'unassigned'),"
        " g as (select *, unit_order - row_number() over (partition by bitext_id, witness order by unit_order) as r from a) select bitext_id, witness, min(unit_order) as lo, max(unit_order) as hi, count(*) as n from g group by bitext_id, witness, r",
    "method_histogram": f"with {_UNITS}, m as (select unit_id, unnest(map_values(methods)) as method from u) select method, count(*) as n, count(distinct unit_id) as units from m group by method",
    "coverage_by_witness": f"with {_UT} select witness, count(*) filter (unit_status = 'reviewed') as assigned, count(*) as total, round(100.0 * count(*) filter (unit_status = 'reviewed') / count(*), 6) as per_cent from ut group by witness",
    "effective_target_text": f"with {_UT} select unit_id, witness, case when length(text) > 0 then 'literal' when len(ids[witness]) > 0 then 'tokens' else 'none' end as text_from, coalesce(len(ids[witness]), 0) as n_tokens from ut",
    "comparison_grid": f"with {_UT}, l as (select unit_id, substr(witness, 1, 3) as lang, text from ut where unit_status = 'reviewed') select unit_id, " + ", ".join(
        f"min(text) filter (lang = '{x}') as {x}" for x in ("eng", "deu", "hin", "zho", "bod")) + " from l group by unit_id",
    "alignment_overlaps": f"with {_UNITS}, i as (select unit_id, unnest(flatten(map_values(ids))) as token from u), s as (select token from i group by token having count(distinct unit_id) > 1) select unit_id, count(distinct token) as shared_tokens from i semi join s using (token) group by unit_id",
    "fragment_bounds": "with b as (select block_id, max(n_chars) as n_chars from library_blocks where block_id is not null group by 1), f as (select distinct fragment_id, block_id, start_pos, end_pos from passage_mappings)"
        " select fragment_id, block_id, start_pos, end_pos, n_chars from f join b using (block_id) where start_pos < 0 or start_pos >= end_pos or end_pos > n_chars",
    "latest_edit_wins": "select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1",
    "tiered_union_merge": "select user_id as key, event_id, value, event_id % 3 as tier from events qualify row_number() over (partition by user_id order by event_id % 3 desc, event_id desc) = 1",
    "descendant_closure": "with recursive n as (select distinct 'b:' || block_id as id, 'c:' || component_id as parent_id from library_blocks where block_id is not null"
        " union select 'c:' || component_id, 'd:' || document_id from library_components union select 'd:' || document_id, 'root' from library_components),"
        " r(id, depth) as (select 'root', 0 union all select n.id, r.depth + 1 from n join r on n.parent_id = r.id) select id, cast(min(depth) as bigint) as depth from r where id is not null group by id",
    "embedding_best_match_margin": "with x as (select a.vec_id as a_id, b.vec_id as b_id, list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])) / sqrt(list_dot_product(cast(a.embedding as double[]), cast(a.embedding as double[]))) / sqrt(list_dot_product(cast(b.embedding as double[]), cast(b.embedding as double[]))) as score"
        " from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 20 = 0), r as (select *, row_number() over w as rank, lead(score) over w as second from x window w as (partition by a_id order by score desc, b_id))"
        " select a_id, b_id, round(score, 6) as score, round(score - coalesce(second, 0), 6) as margin, score >= 0.8 and score - coalesce(second, 0) >= 0.08 as accepted from r where rank = 1",
    "line_terms": f"with l as (select distinct line_id, text from opening_lines where text is not null), t as (select line_id, unnest(regexp_extract_all(lower(text), '{_MS}')) as term from l) select term, count(*) as n, count(distinct line_id) as lines from t group by term",
    "line_search": f"select distinct reading_id, review_status as status from checked_readings where reading_layer = 'checked' and contains(lower(text), '{QUERY_TERM}')",
    "conllu_export": f"with {_UT}, e as (select unit_id || '/' || witness as unit_id, text from ut where unit_status = 'reviewed' and text is not null),"
        f" k as (select unit_id, text, unnest(regexp_extract_all(text, '{_TOK}')) as form, generate_subscripts(regexp_extract_all(text, '{_TOK}'), 1) as i from e)"
        r" select unit_id, '# sent_id = ' || unit_id || chr(10) || '# text = ' || regexp_replace(any_value(text), '[ \t\n\r\f\x0B]+', ' ', 'g') || chr(10) || string_agg(i || chr(9) || form || chr(9) || lower(form) || chr(9) || '_' || chr(9) || '_' || chr(9) || '_' || chr(9) || '_' || chr(9) || '_' || chr(9) || '_' || chr(9) || 'TokenId=' || unit_id || '-t' || lpad(cast(i as varchar), 5, '0'), chr(10) order by i) || chr(10) as conllu from k group by unit_id",
    "conllu_round_trip": f"with {_UT}, e as (select unit_id || '/' || witness as unit_id, text from ut where unit_status = 'reviewed' and text is not null),"
        f" k as (select unit_id, unnest(regexp_extract_all(text, '{_TOK}')) as form, generate_subscripts(regexp_extract_all(text, '{_TOK}'), 1) as i from e)"
        " select unit_id, cast(i as varchar) as id, form, 'TokenId=' || unit_id || '-t' || lpad(cast(i as varchar), 5, '0') as misc from k",
    "tei_export": "with l as (select regexp_extract(line_id, '^(.*)-l', 1) as surface, cast(regexp_extract(line_id, '-l(\\d+)$', 1) as int) as n, min(text) as text from opening_lines where text is not null group by all)"
        " select surface, '<div n=\"' || surface || '\">' || string_agg('<l n=\"' || n || '\">' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') || '</l>', '' order by n) || '</div>' as tei from l group by surface",
    "duplicate_text_groups": "select min(doc_id) as first_id, count(*) as n from documents where text is not null group by text having count(*) > 1",
    "duplicate_unit_ids": "select unit_id, count(*) as n from alignments group by unit_id having count(*) > 1",
    "revised_lines": "select line_id, max(revision) as revision, length(arg_max(text, revision)) as n_chars from (select distinct line_id, revision, text from opening_lines where text is not null) group by line_id"
        " union all select distinct line_id, revision, -1 from opening_lines o where not exists (select 1 from opening_lines p where p.line_id = o.line_id and p.text is not null)",
    "passage_next_start": "with f as (select distinct selection_id, block_id, start_pos, end_pos from text_selections where block_id is not null and start_pos is not null),"
        " g as (select block_id, lead(start_pos) over (partition by block_id order by start_pos, selection_id) as nx from f) select block_id, count(*) as n, cast(sum(nx) as bigint) as next_sum from g group by block_id",
    "forward_filled_pages": "with r as (select reading_id, any_value(document_id) as document_id, max(pdf_page) as pdf_page from checked_readings group by reading_id)"
        " select reading_id, coalesce(last_value(pdf_page ignore nulls) over (partition by document_id order by reading_id rows unbounded preceding), -1) as page from r",
}
