"""Manuscript lines: search, concordance, apparatus, bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.text import MS_TOKEN


def line_search(lines: DataFrame, query: str, layer: str | None = None, status: str | None = None) -> DataFrame:
    """Lines whose layer text holds the query (lower case); optional layer and status."""
    c = F.lower("text").contains(query.lower())
    if layer is not None:
        c = c & (F.col("layer") == layer)
    if status is not None:
        c = c & (F.col("status") == status)
    return lines.where(c)


def line_concordance(lines: DataFrame, line_id: str, text: str) -> DataFrame:
    """term, n, lines: occurrences of every term of the normalised layer."""
    t = lines.select(line_id, F.explode(F.regexp_extract_all(F.lower(text), F.lit(MS_TOKEN), F.lit(0))).alias("term"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(line_id).alias("lines"))


# Categories of transcription marks.
CATEGORIES = {"add": "addition", "del": "deletion", "unclear": "uncertain", "supplied": "restoration", "damage": "damage"}


def apparatus(layers: DataFrame, variants: DataFrame) -> DataFrame:
    """line_id, layer, category, start_pos, end_pos, reading, stale.

    ``layers``: line_id, layer, text, marks (array of type, start, end);
    ``variants``: line_id, layer, category, start_pos, end_pos, basis, reading.
    A variant is stale if the layer's text is no longer its basis.
    """
    cat = F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv]), F.col("m.type"))
    marks = layers.select("line_id", "layer", "text", F.explode("marks").alias("m")).select(
        "line_id", "layer", cat.alias("category"), F.col("m.start").alias("start_pos"), F.col("m.end").alias("end_pos"),
        F.expr("substring(text, m.start + 1, m.end - m.start)").alias("reading"), F.lit(False).alias("stale")).where("category is not null")
    v = variants.join(layers.select("line_id", "layer", "text"), ["line_id", "layer"], "left").select(
        "line_id", "layer", "category", "start_pos", "end_pos", "reading", (~F.col("text").eqNullSafe(F.col("basis"))).alias("stale"))
    return marks.unionByName(v)


def bundle(passage_id: str, lines: DataFrame, anchors: DataFrame) -> DataFrame:
    """Lines anchored to a passage, with the surfaces they stand on."""
    ids = anchors.where(F.array_contains("passage_ids", passage_id)).select(F.explode("line_ids").alias("line_id")).distinct()
    return lines.join(ids, "line_id", "left_semi")


def missing_references(lines: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchors that name lines which do not exist."""
    a = anchors.select("anchor_id", F.explode("line_ids").alias("line_id"))
    return a.join(lines.select("line_id"), "line_id", "left_anti")


def notes_of_lines(lines: DataFrame, annotations: DataFrame) -> DataFrame:
    """line_id, annotation_id, type, status, text: notes on a line or on one of its regions.

    ``lines``: line_id, region_ids; ``annotations``: annotation_id, type, status,
    text, targets (array of line_id, region_id).
    """
    a = annotations.select("annotation_id", "type", "status", "text", F.explode("targets").alias("t"))
    direct = a.where("t.line_id is not null").select(F.col("t.line_id").alias("line_id"), "annotation_id", "type", "status", "text")
    regions = lines.select("line_id", F.explode("region_ids").alias("region_id"))
    by_region = a.where("t.region_id is not null").withColumn("region_id", F.col("t.region_id")).join(regions, "region_id").select("line_id", "annotation_id", "type", "status", "text")
    return direct.join(lines.select("line_id"), "line_id", "left_semi").unionByName(by_region).distinct()


def search_package(
    lines: DataFrame, layers: DataFrame, annotations: DataFrame, query: str = "", field: str = "transliteration",
    surface: str | None = None, hand: str | None = None, script: str | None = None, status: str | None = None, note_type: str | None = None,
) -> DataFrame:
    """line_id, surface_id, text: lines whose layer ``field`` (or notes) holds the query, with all filters.

    With ``note_type`` a line needs a note of that type, and of the status if
    one is asked for; the layer must have the status, too.  The query is folded
    to NFC lower case; an empty one matches every text.
    """
    from loomtext.functions.text import manuscript_fold_udf

    for col, want in (("surface_id", surface), ("hand", hand), ("script", script)):
        if want:
            lines = lines.where(F.col(col) == want)
    import unicodedata

    q = unicodedata.normalize("NFC", query).lower()
    notes = notes_of_lines(lines, annotations)
    if note_type:
        notes = notes.where(F.col("type") == note_type)
    if status:
        notes = notes.where(F.col("status") == status)
    if field == "notes":
        hit = notes.where(manuscript_fold_udf(F.col("text")).contains(q)).groupBy("line_id").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
        return lines.select("line_id", "surface_id").join(hit, "line_id")
    if note_type:
        lines = lines.join(notes, "line_id", "left_semi")
    lay = layers.where((F.col("layer") == field) & F.col("text").isNotNull())
    if status:
        lay = lay.where(F.col("status") == status)
    lay = lay.where(manuscript_fold_udf(F.col("text")).contains(q))
    return lines.select("line_id", "surface_id").join(lay.select("line_id", "text"), "line_id")


def occurrences(layers: DataFrame, line_id: str, text: str, around: int = 36) -> DataFrame:
    """term, line_id, form, context: every occurrence of every term of a layer."""
    piece = rf"{MS_TOKEN}|[^\p{{L}}\p{{M}}\p{{N}}]+"
    p = layers.select(line_id, text, F.posexplode(F.regexp_extract_all(text, F.lit(piece), F.lit(0))).alias("pos", "form"))
    w = Window.partitionBy(line_id).orderBy("pos")
    p = p.withColumn("b", F.sum(F.length("form")).over(w)).withColumn("a", F.col("b") - F.length("form")).where(F.col("form").rlike(r"^[\p{L}\p{M}\p{N}]"))
    start = F.greatest(F.col("a") - around, F.lit(0))
    return p.select(F.lower("form").alias("term"), line_id, "form", F.substring(F.col(text), (start + 1).cast("int"), (F.col("b") + around - start).cast("int")).alias("context"))


def nested_bundle(lines: DataFrame, surfaces: DataFrame, anchors: DataFrame, annotations: DataFrame, line_ids: list[str]) -> DataFrame:
    """One row: the chosen lines with only the surfaces, anchors and notes that touch them; no line is an error."""
    chosen = lines.where(F.col("line_id").isin(line_ids))
    pack = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
    s = surfaces.join(chosen.select("surface_id").distinct(), "surface_id", "left_semi")
    a = anchors.where(F.arrays_overlap("line_ids", F.array(*map(F.lit, line_ids))))
    ids = notes_of_lines(chosen, annotations).select("annotation_id").distinct()
    n = annotations.select("annotation_id", "type", "status", "text").join(ids, "annotation_id", "left_semi")
    out = pack(chosen, "lines")
    for df, name in ((s, "surfaces"), (a, "anchors"), (n, "annotations")):
        out = out.join(pack(df, name), F.lit(True))  # single rows
    return out.withColumn("lines", F.when(F.size("lines") > 0, F.col("lines")).otherwise(F.raise_error(F.lit("no recorded line matches"))))


def package_problems(surfaces: DataFrame, regions: DataFrame, lines: DataFrame, layers: DataFrame, anchors: DataFrame) -> DataFrame:
    """problem, id: broken ids, geometry, references, reading order and mark spans of a package."""
    bad_id = lambda df, c: df.where(~F.coalesce(F.col(c).rlike(r"^[A-Za-z0-9][A-Za-z0-9._:-]*$"), F.lit(False))).select(F.lit("id format").alias("problem"), F.col(c).alias("id"))
    twice = lambda df, c: df.groupBy(c).count().where("count > 1").select(F.lit("repeated id"), F.col(c))
    out = bad_id(surfaces, "surface_id").union(bad_id(lines, "line_id")).union(twice(surfaces, "surface_id")).union(twice(lines, "line_id")).union(twice(regions, "region_id"))
    r = regions.join(surfaces.select("surface_id", "width", "height"), "surface_id", "left")
    x, y, w, h = (F.col("xywh")[i] for i in range(4))
    out = out.union(r.where("width is null").select(F.lit("region without surface"), "region_id"))
    inside = (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= F.col("width")) & (y + h <= F.col("height"))
    out = out.union(r.where("width is not null").where(~F.coalesce(inside, F.lit(False))).select(F.lit("region out of bounds"), "region_id"))
    refs = lines.select("line_id", F.explode("region_ids").alias("region_id"))
    out = out.union(refs.join(regions, "region_id", "left_anti").select(F.lit("line names no region"), "line_id"))
    out = out.union(lines.join(surfaces, "surface_id", "left_anti").select(F.lit("line names no surface"), "line_id"))
    out = out.union(lines.groupBy("surface_id", "ord").agg(F.count(F.lit(1)).alias("n"), F.min("line_id").alias("line_id")).where("n > 1").select(F.lit("reading order"), "line_id"))
    m = layers.select("line_id", F.length("text").alias("len"), F.explode("marks").alias("m"))
    out = out.union(m.where("m.start < 0 or m.start > m.end or m.end > len").select(F.lit("mark span"), "line_id"))
    return out.union(missing_references(lines, anchors).select(F.lit("anchor names no line"), "anchor_id"))


def citation(record: DataFrame) -> DataFrame:
    """``record`` with ``citation``: '{institution}, {shelfmark}, {surface}, {line}; {layer}, {version}, {editor}[; annotation {id}]. {url}'.

    Without a line the surface itself is cited; other fields that are null are left out with their comma.
    """
    place = F.concat_ws(", ", "institution", "shelfmark", "surface", F.coalesce("line", F.lit("surface")))
    note = F.when(F.length("annotation_id") > 0, F.concat(F.lit("; annotation "), "annotation_id")).otherwise("")
    return record.withColumn("citation", F.concat(place, F.lit("; "), F.concat_ws(", ", "layer", "version", "editor"), note, F.lit(". "), F.coalesce("url", F.lit(""))))


def linked_anchors(lines: DataFrame, anchors: DataFrame) -> DataFrame:
    """line_id, anchor_id of every anchor that names the line."""
    a = anchors.select("anchor_id", F.explode("line_ids").alias("line_id")).distinct()
    return lines.select("line_id").distinct().join(a, "line_id")
