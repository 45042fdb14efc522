"""Queries of units, edits and validators over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import edits, lexicon, manuscripts, tokens, units
from loomtext.sources.tables import read


def _targets(s: SparkSession, d: str) -> DataFrame:
    return units.unit_targets(read(s, d, "alignments", "unit_id", "bitext_id", "passage_id", "unit_number", "unit_order", "unit_status", "targets", "target_token_ids", "mapping_methods"))


def unit_target_ranges(s, d):
    return _targets(s, d).select("unit_id", "witness", "n_tokens", F.coalesce("lo", F.lit(-1)).alias("lo"), F.coalesce("hi", F.lit(-1)).alias("hi"))


def target_problems(s, d):
    return units.target_problems(_targets(s, d))


def token_last_unit(s, d):
    return units.token_units(_targets(s, d))


def token_shortest_unit(s, d):
    return units.token_alignment(_targets(s, d))


def token_records(s, d):
    t = _targets(s, d).select("passage_id", "witness", F.explode("token_ids").alias("token_id")).distinct()
    return t.join(units.token_units(_targets(s, d)), "token_id")


def unassigned_tokens_by_witness(s, d):
    t = _targets(s, d).select("witness", "unit_status", F.explode("token_ids").alias("token_id")).distinct()
    done = t.where("unit_status = 'reviewed'").select("witness", "token_id")
    return t.join(done, ["witness", "token_id"], "left_anti").groupBy("witness").agg(F.count_distinct("token_id").alias("unassigned"))


def unique_plan_phrases(s, d):
    p = read(s, d, "semantic_plans", "bitext_id", "source_id", "passages").select("bitext_id", F.col("source_id").alias("witness"), F.explode("passages").alias("k", "items"))
    p = p.select("bitext_id", "witness", F.explode("items").alias("i")).select("bitext_id", "witness", F.col("i")[1].alias("phrase"))
    t = _targets(s, d).where("unit_status = 'unassigned'").select("bitext_id", "witness", "text")
    return units.unique_phrases(t, p, ["bitext_id", "witness"]).select("bitext_id", "witness", "phrase")


def danda_sentence_spans(s, d):
    return units.danda_sentences(read(s, d, "documents", "doc_id", "text"), "doc_id", "text").select("doc_id", "start_pos", "end_pos")


def label_token_counts(s, d):
    r = read(s, d, "checked_readings", "reading_id", "text").where("text is not null").distinct()
    return units.label_tokens(r, "reading_id", "text").where("n_labels > 0")


def filtered_frequency(s, d):
    docs = read(s, d, "documents", "passage_id", "text")
    f = tokens.form_frequency(docs, "text", "passage_id").where(F.col("form").contains("ma"))
    return f.orderBy(F.desc("n"), "form").limit(80)  # the reference lists at most 80 forms


def witness_availability(s, d):
    x = read(s, d, "documents", "source", "passage_id", "text").where("passage_id is not null")
    label = F.when(F.sum(F.coalesce(F.length("text"), F.lit(0))) > 0, "available").when(F.count("text") > 0, "empty").otherwise("missing")
    return x.groupBy("source", "passage_id").agg(label.alias("coverage"))


def status_labels(s, d):
    a = read(s, d, "alignments", "unit_id", "unit_status", "confidence").dropDuplicates(["unit_id"])
    label = F.when(F.col("unit_status") == "reviewed", "reviewed").when(F.col("confidence") == "high", "suggested").when(F.col("confidence").isNull(), "unrated").otherwise("candidate")
    return a.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def morphology_table(s, d):
    t = _targets(s, d).where("unit_status = 'reviewed'").select("unit_id", "witness", F.posexplode(T.tokens(F.col("text"))).alias("pos", "form"))
    lx = lexicon.entry_forms(read(s, d, "lexicon", "entry_id", "lemma", "forms")).select("entry_id", F.lower("form").alias("norm"))
    first = lx.groupBy("norm").agg(F.min("entry_id").alias("entry_id")).join(read(s, d, "lexicon", "entry_id", "lemma", "part_of_speech", "gloss"), "entry_id")
    j = t.withColumn("norm", F.lower("form")).join(first, "norm", "left")
    return j.select("unit_id", "witness", (F.col("pos") + 1).cast("bigint").alias("no"), "form", F.coalesce("lemma", F.lit("_")).alias("lemma"), F.coalesce("part_of_speech", F.lit("_")).alias("upos"), F.coalesce("gloss", F.lit("_")).alias("gloss"))


def token_range_selection(s, d):
    t = _targets(s, d).select("unit_id", "witness", F.posexplode("token_ids").alias("idx", "token_id"))
    return t.where(F.col("idx").between(F.least(F.lit(5), F.lit(2)), F.greatest(F.lit(5), F.lit(2)))).select("unit_id", "witness", "token_id")


def reading_list(s, d):
    t = _targets(s, d)
    return t.where("length(text) > 0").groupBy("passage_id").agg(F.count(F.when(F.col("unit_status") == "reviewed", 1)).alias("sentences"), F.count(F.lit(1)).alias("cells"))


def correspondence_frame(s, d):
    t = _targets(s, d).where("unit_status = 'reviewed'")
    a = t.select("unit_id", F.col("witness").alias("from_witness"), F.explode("token_ids").alias("token_id"))
    b = t.select("unit_id", F.col("witness").alias("to_witness"), "text")
    return a.join(b, "unit_id").where("from_witness <> to_witness").groupBy("token_id", "to_witness").agg(F.min("text").alias("text"))


def filled_targets(s, d):
    t = _targets(s, d).where("unit_number is not null").select("unit_id", "bitext_id", "unit_number", "witness", F.when(F.col("unit_status") == "reviewed", F.col("text")).alias("text"))
    base = _targets(s, d).where("unit_number is not null and unit_status <> 'reviewed'").groupBy("bitext_id", "unit_number", "witness").agg(F.min("text").alias("base_text"))
    return units.fill_missing(t, base).select("unit_id", "witness", F.length("text").alias("n_chars"))


def block_passages(s, d):
    f = read(s, d, "passage_mappings", "block_id", "passage_id").where("block_id is not null and passage_id is not null")
    return f.groupBy("block_id").agg(F.count_distinct("passage_id").alias("passages"))


def fragment_block_slices(s, d):
    b = read(s, d, "library_blocks", "block_id", "block_label", "n_chars", "created_at").where("block_id is not null").groupBy("block_id").agg(F.max_by("block_label", "created_at").alias("block_label"), F.max("n_chars").alias("n_chars"))
    f = read(s, d, "passage_mappings", "fragment_id", "block_id", "start_pos", "end_pos").distinct()
    j = f.join(b, "block_id")
    a, e = F.greatest("start_pos", F.lit(0)), F.least("end_pos", "n_chars")
    return j.select("fragment_id", "block_id", a.alias("start_pos"), e.alias("end_pos"), F.greatest(e - a, F.lit(0)).alias("n"))


def contained_units(s, d):
    t = _targets(s, d).where("length(text) > 0").select("bitext_id", "witness", "unit_id", "text")
    x, y = t.alias("x"), t.alias("y")
    on = "x.bitext_id = y.bitext_id and x.witness = y.witness and x.unit_id <> y.unit_id and length(x.text) < length(y.text) and contains(lower(y.text), lower(x.text))"
    return x.join(y, F.expr(on)).select(F.col("x.unit_id").alias("unit_id"), F.col("y.unit_id").alias("inside"))


def unit_context_groups(s, d):
    t = _targets(s, d).where("unit_status = 'unassigned' and length(text) > 0").groupBy("bitext_id", "witness", "unit_order").agg(F.min("text").alias("text"))
    return units.context_groups(t, ["bitext_id", "witness"], "unit_order").select("bitext_id", "witness", "first", "size", F.length("text").alias("n_chars"))


def clause_chunks(s, d):
    return units.chunk_runs(units.gaps_after(read(s, d, "documents", "doc_id", "text"), "doc_id", "text"), "doc_id")


def unit_positions(s, d):
    return _targets(s, d).where("lo is not null").groupBy("unit_id").agg(F.min("lo").alias("position"))


def proposal_page(s, d):
    return read(s, d, "events", "event_id", "user_id", "event_type").where("event_id > 100").orderBy("event_id").limit(100)  # pages of 100 behind a cursor


def section_edit_merge(s, d):
    e = read(s, d, "events", "event_id", "ts", "user_id", "event_type", "value").withColumn("unit", F.pmod("user_id", F.lit(7)))
    return edits.last_wins(e.select("unit", "event_id", "ts", "value"), ["unit"], ["ts", "event_id"]).select("unit", "event_id", "value")


def edit_counts(s, d):
    return read(s, d, "events", "event_type", "user_id").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("authors"))


def append_conflicts(s, d):
    r = read(s, d, "checked_readings", "reading_id", "text", "review_status")
    return r.groupBy("reading_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("text", "review_status").alias("versions"), F.count_distinct("text").alias("texts")).where("rows > 1")


def token_set_algebra(s, d):
    t = _targets(s, d).where("n_tokens > 0").select("bitext_id", "witness", "unit_order", "unit_id", "token_ids")
    w = Window.partitionBy("bitext_id", "witness").orderBy("unit_order", "unit_id")
    t = t.withColumn("prev", F.lag("token_ids").over(w)).where("prev is not null")
    return t.select("unit_id", "witness", F.size(F.array_union("token_ids", "prev")).cast("bigint").alias("either"), F.size(F.array_intersect("token_ids", "prev")).cast("bigint").alias("both"), F.size(F.array_except("token_ids", "prev")).cast("bigint").alias("own"))


def effective_unit_tokens(s, d):
    t = _targets(s, d).select("unit_id", F.posexplode("token_ids").alias("idx", "token_id"))
    u = t.groupBy("token_id").agg(F.min("unit_id").alias("unit_id"), F.min("idx").alias("idx"))
    a = read(s, d, "alignments", "unit_id", "unit_order", "confidence").distinct()
    moves = u.where(F.col("idx") == 0).select("token_id", F.concat(F.lit("moved-"), "unit_id").alias("to_unit"), F.lit(1).alias("seq"))
    sections = a.where("confidence is null").select("unit_id", F.lit(True).alias("deleted"), F.lit(1).alias("seq"))
    return units.effective_units(u, moves, sections).groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"))


def human_over_machine(s, d):
    t = _targets(s, d).where("n_tokens > 0").select("unit_id", "witness", "token_ids", "unit_status")
    human, machine = t.where("unit_status = 'reviewed'"), t.where("unit_status <> 'reviewed'")
    return units.override(human, machine).groupBy("unit_status").agg(F.count_distinct("unit_id").alias("units"))


def coverage_ratios(s, d):
    t = _targets(s, d).where("n_tokens > 0")
    return t.select("unit_id", "witness", F.round(F.col("n_tokens") / (F.col("hi") - F.col("lo") + 1), 4).alias("ratio"))


def rejected_anchors(s, d):
    t = _targets(s, d).select("unit_id", "witness", "method")
    bad = read(s, d, "alignments", "unit_id", "confidence").where("confidence = 'low'").select("unit_id").distinct()
    return t.join(bad, "unit_id", "left_anti").groupBy("witness").agg(F.count(F.lit(1)).alias("kept"))


def mapping_conflicts(s, d):
    f = read(s, d, "passage_mappings", "source_id", "passage_id", "map_level", "document_id").where("passage_id is not null").distinct()
    return f.groupBy("source_id", "passage_id").agg(F.count_distinct("document_id").alias("documents")).where("documents > 1")


def component_references(s, d):
    b = read(s, d, "library_blocks", "block_id", "component_id").where("component_id is not null").distinct()
    return b.join(read(s, d, "library_components", "component_id"), "component_id", "left_anti")


def ledger_chain_check(s, d):
    e = read(s, d, "events", "event_id", "ts", "user_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("prev", F.lag("event_id").over(w))
    return e.groupBy("user_id").agg(F.count(F.when(F.col("prev") > F.col("event_id"), 1)).alias("out_of_order"), F.count(F.lit(1)).alias("n"))


def regroup_conservation(s, d):
    t = _targets(s, d).select("unit_id", "unit_status", F.explode("token_ids").alias("token_id"))
    return t.groupBy("unit_status").agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct("token_id").alias("distinct_tokens"))


def spans_of_units(s, d):
    a = read(s, d, "documents", "doc_id", "text").where("length(text) >= 40")
    t = tokens.token_offsets(a, "doc_id", "text").where("start_pos < 40 and idx <> 2")
    return units.span_text(t, a, "doc_id")


def bookmarks_available(s, d):
    b = read(s, d, "text_selections", "selection_id", "block_id", "document_id").distinct()
    live = read(s, d, "library_blocks", "block_id", "deleted_at").where("deleted_at is null").select("block_id").distinct()
    return b.join(live.withColumn("ok", F.lit(1)), "block_id", "left").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.count("ok").alias("available"))


def line_passages(s, d):
    lines = read(s, d, "opening_lines", "line_id", "text").where("text is not null").groupBy("line_id").agg(F.min("text").alias("text"))
    anchors = lines.groupBy(F.regexp_extract("line_id", "^(.*)-l", 1).alias("anchor_id")).agg(F.collect_list("line_id").alias("line_ids"))
    return manuscripts.missing_references(lines.where("length(text) > 60"), anchors).groupBy("anchor_id").agg(F.count(F.lit(1)).alias("missing"))


NAMES = """unit_target_ranges target_problems token_last_unit token_shortest_unit token_records unassigned_tokens_by_witness unique_plan_phrases danda_sentence_spans
label_token_counts filtered_frequency witness_availability status_labels morphology_table token_range_selection reading_list correspondence_frame filled_targets block_passages
fragment_block_slices contained_units unit_context_groups clause_chunks unit_positions proposal_page section_edit_merge edit_counts append_conflicts token_set_algebra
effective_unit_tokens human_over_machine coverage_ratios rejected_anchors mapping_conflicts component_references ledger_chain_check regroup_conservation spans_of_units
bookmarks_available line_passages""".split()
QUERIES = {n: globals()[n] for n in NAMES}

_U = (
    "u as (select unit_id, any_value(bitext_id) as bitext_id, any_value(passage_id) as passage_id, any_value(unit_number) as unit_number, any_value(unit_order) as unit_order, any_value(unit_status) as unit_status,"
    " any_value(confidence) as confidence, any_value(targets) as targets, any_value(target_token_ids) as ids, any_value(mapping_methods) as methods from alignments group by unit_id),"
    " w as (select *, unnest(list_distinct(list_concat(coalesce(map_keys(targets), []), coalesce(map_keys(ids), [])))) as witness from u),"
    " t as (select unit_id, bitext_id, passage_id, unit_number, unit_order, unit_status, confidence, witness, targets[witness] as text, coalesce(ids[witness], []) as token_ids, methods[witness] as method from w),"
    " n as (select *, len(token_ids) as n_tokens, list_min([try_cast(regexp_extract(x, '-t(\\d+)$', 1) as int) for x in token_ids]) as lo, list_max([try_cast(regexp_extract(x, '-t(\\d+)$', 1) as int) for x in token_ids]) as hi from t),"
    " k as (select *, unnest(token_ids) as token_id, unnest(range(len(token_ids))) as idx from n)"
)
_TOK = T.TOKEN.replace("'", "''")
_PIECE = T.PIECE.replace("'", "''")
_FROM, _TO = T.compatible()
SQL = {
    "unit_target_ranges": f"with {_U} select unit_id, witness, n_tokens, coalesce(lo, -1) as lo, coalesce(hi, -1) as hi from n",
    "target_problems": f"with {_U}, p as (select unit_id, witness, case when len(list_distinct(token_ids)) < n_tokens then 'repeated' when hi - lo + 1 <> n_tokens then 'not contiguous' end as problem from n where n_tokens > 0) select * from p where problem is not null",
    "token_last_unit": f"with {_U} select token_id, unit_id from k qualify row_number() over (partition by token_id order by unit_order desc, unit_id desc) = 1",
    "token_shortest_unit": f"with {_U} select token_id, unit_id from k qualify row_number() over (partition by token_id order by n_tokens, unit_id) = 1",
    "token_records": f"with {_U}, l as (select token_id, unit_id from k qualify row_number() over (partition by token_id order by unit_order desc, unit_id desc) = 1) select distinct token_id, passage_id, witness, l.unit_id from k join l using (token_id)",
    "unassigned_tokens_by_witness": f"with {_U} select witness, count(distinct token_id) as unassigned from k a where not exists (select 1 from k b where b.witness = a.witness and b.token_id = a.token_id and b.unit_status = 'reviewed') group by witness",
    "unique_plan_phrases": f"with {_U}, i as (select bitext_id, source_id as witness, unnest(flatten(map_values(passages))) as i from semantic_plans),"
        " p as (select distinct bitext_id, witness, trim(regexp_replace(i[2], '\\s+', ' ', 'g')) as phrase from i), x as (select distinct bitext_id, witness, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text from t where unit_status = 'unassigned')"
        " select bitext_id, witness, phrase from x join p using (bitext_id, witness) where phrase <> '' and contains(text, phrase) group by all having sum((length(text) - length(replace(text, phrase, ''))) // length(phrase)) = 1",
    "label_token_counts": "with r as (select distinct reading_id, text from checked_readings where text is not null) select reading_id, len(regexp_extract_all(text, '(?m)^[ \\t]*\\d+(?:\\.\\d+)+\\.[ \\t]+')) as n_labels from r where n_labels > 0",
    "filtered_frequency": f"with y as (select passage_id, unnest(regexp_extract_all(text, '{_TOK}')) as surface from documents), fs as (select surface, trim(lower(nfc_normalize(case when regexp_matches(surface, '[{_FROM}]') then translate(surface, '{_FROM}', '{_TO}') else surface end))) as form from (select distinct surface from y)), x as (select * from y join fs using (surface)) select form, count(*) as n, count(distinct passage_id) as n_passages, arg_min(surface, (passage_id is not null, coalesce(passage_id, ''), surface)) as surface, case when bool_or(passage_id is null) then null else min(passage_id) end as first_passage from x where contains(form, 'ma') group by form order by n desc, form limit 80",
    "witness_availability": "select source, passage_id, case when sum(coalesce(length(text), 0)) > 0 then 'available' when count(text) > 0 then 'empty' else 'missing' end as coverage from documents where passage_id is not null group by all",
    "status_labels": f"with {_U} select case when unit_status = 'reviewed' then 'reviewed' when confidence = 'high' then 'suggested' when confidence is null then 'unrated' else 'candidate' end as label, count(*) as n from u group by 1",
    "morphology_table": f"with {_U}, f as (select entry_id, lower(unnest(list_concat(case when lemma is null or contains(lemma, '/') then [] else [lemma] end, coalesce(forms, [])))) as norm from lexicon), b as (select norm, min(entry_id) as entry_id from f group by norm),"
        f" x as (select unit_id, witness, unnest(regexp_extract_all(text, '{_TOK}')) as form, generate_subscripts(regexp_extract_all(text, '{_TOK}'), 1) as no from t where unit_status = 'reviewed')"
        " select unit_id, witness, no, form, coalesce(lemma, '_') as lemma, coalesce(part_of_speech, '_') as upos, coalesce(gloss, '_') as gloss from x left join b on b.norm = lower(form) left join lexicon l on l.entry_id = b.entry_id",
    "token_range_selection": f"with {_U} select unit_id, witness, token_id from k where idx between 2 and 5",
    "reading_list": f"with {_U} select passage_id, count(*) filter (unit_status = 'reviewed') as sentences, count(*) as cells from t where length(text) > 0 group by passage_id",
    "correspondence_frame": f"with {_U} select k.token_id, t.witness as to_witness, min(t.text) as text from k join t on t.unit_id = k.unit_id and t.witness <> k.witness where k.unit_status = 'reviewed' group by all",
    "filled_targets": f"with {_U}, b as (select bitext_id, unit_number, witness, min(text) as base_text from t where unit_number is not null and unit_status <> 'reviewed' group by all)"
        " select t.unit_id, t.witness, length(coalesce(case when t.unit_status = 'reviewed' and length(t.text) > 0 then t.text end, b.base_text)) as n_chars from t left join b using (bitext_id, unit_number, witness) where t.unit_number is not null",
    "block_passages": "select block_id, count(distinct passage_id) as passages from passage_mappings where block_id is not null and passage_id is not null group by 1",
    "fragment_block_slices": "with b as (select block_id, max(n_chars) as n_chars from library_blocks where block_id is not null group by 1), f as (select distinct fragment_id, block_id, start_pos, end_pos from passage_mappings)"
        " select fragment_id, block_id, greatest(start_pos, 0) as start_pos, least(end_pos, n_chars) as end_pos, greatest(least(end_pos, n_chars) - greatest(start_pos, 0), 0) as n from f join b using (block_id)",
    "contained_units": f"with {_U}, x as (select bitext_id, witness, unit_id, lower(text) as text, length(text) as l from t where length(text) > 0) select a.unit_id, b.unit_id as inside from x a join x b on a.bitext_id = b.bitext_id and a.witness = b.witness and a.unit_id <> b.unit_id and a.l < b.l and contains(b.text, a.text)",
    "unit_context_groups": f"with {_U}, g as (select bitext_id, witness, unit_order, min(text) as text from t where unit_status = 'unassigned' and length(text) > 0 group by all),"
        " r as (select *, row_number() over (partition by bitext_id, witness order by unit_order) as r from g)"
        " select a.bitext_id, a.witness, a.unit_order as first, s.size, cast(sum(length(b.text)) + max(s.size) - 1 as bigint) as n_chars from r a cross join (select unnest([1, 2, 3, 4]) as size) s join r b on b.bitext_id = a.bitext_id and b.witness = a.witness and b.r between a.r and a.r + s.size - 1 group by all having count(*) = s.size",
    "unit_positions": f"with {_U} select unit_id, min(lo) as position from n where lo is not null group by unit_id",
    "proposal_page": "select event_id, user_id, event_type from events where event_id > 100 order by event_id limit 100",
    "section_edit_merge": "select user_id % 7 as unit, event_id, value from events qualify row_number() over (partition by user_id % 7 order by ts desc, event_id desc) = 1",
    "edit_counts": "select event_type, count(*) as n, count(distinct user_id) as authors from events group by 1",
    "append_conflicts": "select reading_id, count(*) as rows, count(distinct case when text is not null and review_status is not null then (text, review_status) end) as versions, count(distinct text) as texts from checked_readings group by 1 having count(*) > 1",
    "token_set_algebra": f"with {_U}, p as (select *, lag(token_ids) over (partition by bitext_id, witness order by unit_order, unit_id) as prev from n where n_tokens > 0)"
        " select unit_id, witness, len(list_distinct(list_concat(token_ids, prev))) as either, len(list_intersect(token_ids, prev)) as both, len(list_distinct([x for x in token_ids if not list_contains(prev, x)])) as own from p where prev is not null",
    "effective_unit_tokens": f"with {_U}, x as (select token_id, min(unit_id) as unit_id, min(idx) as idx from k group by 1), y as (select token_id, case when idx = 0 then 'moved-' || unit_id else unit_id end as unit_id from x)"
        " select unit_id, count(*) as n from y where unit_id not in (select unit_id from alignments where confidence is null) group by 1",
    "human_over_machine": f"with {_U}, h as (select distinct token_id from k where unit_status = 'reviewed'), hit as (select distinct unit_id from k semi join h using (token_id) where unit_status <> 'reviewed')"
        " select unit_status, count(distinct unit_id) as units from n where n_tokens > 0 and (unit_status = 'reviewed' or unit_id not in (select unit_id from hit)) group by 1",
    "coverage_ratios": f"with {_U} select unit_id, witness, round(n_tokens / (hi - lo + 1), 4) as ratio from n where n_tokens > 0",
    "rejected_anchors": f"with {_U} select witness, count(*) as kept from n where unit_id not in (select unit_id from alignments where confidence = 'low') group by witness",
    "mapping_conflicts": "select source_id, passage_id, count(distinct document_id) as documents from passage_mappings where passage_id is not null group by all having count(distinct document_id) > 1",
    "component_references": "select distinct component_id, block_id from library_blocks where component_id is not null and component_id not in (select component_id from library_components where component_id is not null)",
    "ledger_chain_check": "with e as (select *, lag(event_id) over (partition by user_id order by ts, event_id) as prev from events) select user_id, count(*) filter (prev > event_id) as out_of_order, count(*) as n from e group by 1",
    "regroup_conservation": f"with {_U} select unit_status, count(*) as tokens, count(distinct token_id) as distinct_tokens from k group by 1",
    "spans_of_units": f"with p as (select doc_id, text, unnest(regexp_extract_all(text, '{_PIECE}')) as surface, generate_subscripts(regexp_extract_all(text, '{_PIECE}'), 1) as pos from documents where length(text) >= 40),"
        " q as (select *, sum(length(surface)) over (partition by doc_id order by pos) as e from p), o as (select doc_id, text, e - length(surface) as a, e as b, row_number() over (partition by doc_id order by pos) - 1 as idx from q where regexp_matches(surface, '^[\\p{L}\\p{M}\\p{N}]')),"
        " g as (select *, idx - row_number() over (partition by doc_id order by idx) as g from o where a < 40 and idx <> 2), s as (select doc_id, min(a) as a, substr(any_value(text), cast(min(a) as bigint) + 1, cast(max(b) - min(a) as bigint)) as s from g group by doc_id, g)"
        " select doc_id, string_agg(s, ' … ' order by a) as span_text from s group by doc_id",
    "bookmarks_available": "with b as (select distinct selection_id, block_id, document_id from text_selections) select document_id, count(*) as n, count(*) filter (block_id in (select block_id from library_blocks where deleted_at is null and block_id is not null)) as available from b group by 1",
    "line_passages": "with l as (select line_id, min(text) as text from opening_lines where text is not null group by 1) select regexp_extract(line_id, '^(.*)-l', 1) as anchor_id, count(*) as missing from l where length(text) <= 60 group by 1",
}
