"""CoNLL-U and TEI, as DataFrame sinks and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import xml_escape

COLUMNS = ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")


def to_conllu(tokens: DataFrame, sent: str, text: str) -> DataFrame:
    """sent, conllu: one sentence per key with headers; blank values become '_'.

    ``tokens``: sent, text, idx, token_id, form, lemma, upos.
    """
    val = lambda c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", "_").otherwise(F.regexp_replace(F.trim(c), r"\s+", " "))
    row = F.concat_ws("\t", (F.col("idx") + 1).cast("string"), val("form"), val("lemma"), val("upos"), *[F.lit("_")] * 5, F.concat(F.lit("TokenId="), "token_id"))
    g = tokens.select(sent, text, F.struct("idx", row.alias("row")).alias("r")).groupBy(sent).agg(F.max(text).alias("t"), F.array_sort(F.collect_list("r")).alias("rs"))
    body = F.array_join(F.transform("rs", lambda r: r.row), "\n")
    return g.select(sent, F.concat(F.lit("# sent_id = "), F.col(sent).cast("string"), F.lit("\n# text = "), F.regexp_replace("t", r"\s+", " "), F.lit("\n"), body, F.lit("\n")).alias("conllu"))


def parse_conllu(sentences: DataFrame, sent: str, conllu: str) -> DataFrame:
    """sent, line_no and the ten columns; blank and comment lines skipped, rows padded or cut to ten."""
    s = sentences.select(sent, F.posexplode(F.split(conllu, "\n")).alias("line_no", "row")).where("trim(row) <> '' and not row like '#%'")
    f = F.slice(F.concat(F.split("row", "\t"), F.array_repeat(F.lit("_"), 10)), 1, 10)
    return s.select(sent, "line_no", *[f[i].alias(c) for i, c in enumerate(COLUMNS)])


#: A character that XML 1.0 does not allow.
FORBIDDEN = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"


def escaped(c) -> Column:
    """Text for XML, null as nothing; a character XML forbids makes the row fail."""
    c = F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    return F.when(c.rlike(FORBIDDEN), F.raise_error(F.lit("text holds a character XML forbids"))).otherwise(xml_escape(c))


def _marked(text: Column, marks: Column, prefix: Column) -> Column:
    """Text with its marks as elements; a mark with a reason gets an id that a note refers to."""
    cut = lambda a, b: escaped(F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    n = F.sequence(F.lit(1), F.size(marks))
    one = lambda i: F.concat(
        cut(F.when(i > 1, F.element_at(marks, i - 1).end).otherwise(0), F.element_at(marks, i).start), F.lit("<"), F.element_at(marks, i).type,
        F.when(F.length(F.element_at(marks, i).reason) > 0, F.concat(F.lit(' xml:id="'), escaped(prefix), F.lit("-mark-"), i.cast("string"), F.lit('"'))).otherwise(""), F.lit(">"),
        cut(F.element_at(marks, i).start, F.element_at(marks, i).end), F.lit("</"), F.element_at(marks, i).type, F.lit(">"))
    notes = lambda i: F.when(F.length(F.element_at(marks, i).reason) > 0, F.concat(
        F.lit('<note type="reading-mark" target="#'), escaped(prefix), F.lit("-mark-"), i.cast("string"), F.lit('">'), escaped(F.element_at(marks, i).reason), F.lit("</note>"))).otherwise("")
    some = F.size(marks) > 0
    rest = cut(F.when(some, F.element_at(marks, -1).end).otherwise(0), F.length(text))
    seg = F.concat(F.when(some, F.array_join(F.transform(n, one), "")).otherwise(""), rest)
    return F.concat(F.lit("<seg>"), seg, F.lit("</seg>"), F.when(some, F.array_join(F.transform(n, notes), "")).otherwise(""))


def tei_documents(manuscripts: DataFrame, surfaces: DataFrame, regions: DataFrame, lines: DataFrame, layers: DataFrame, anchors: DataFrame, annotations: DataFrame, events: DataFrame) -> DataFrame:
    """manuscript_id, tei: a whole TEI document for every manuscript.

    ``manuscripts``: manuscript_id, title, editor, source; ``surfaces``: manuscript_id, surface_id, ord, label, width, height,
    url; ``regions``: manuscript_id, region_id, surface_id, x, y, w, h; ``lines``: manuscript_id, line_id, surface_id, ord,
    label, status, region_ids; ``layers``: manuscript_id, line_id, layer, text, note, marks (array of type, start, end,
    reason, in order); ``anchors``: manuscript_id, anchor_id, relation, line_ids, passage_ids; ``annotations``: manuscript_id,
    annotation_id, type, target, text; ``events``: manuscript_id, seq, decision, decided_at, reviewer, note.

    Surfaces and lines stand in their order, one division per layer that has a text, links for anchors, notes for
    annotations, and the revision history.  Everything is escaped; a character XML forbids makes the document fail.
    """
    m = "manuscript_id"
    q = lambda name, c: F.concat(F.lit(f' {name}="'), escaped(c), F.lit('"'))

    def joined(d: DataFrame, order: list[str], xml: Column, name: str) -> DataFrame:
        g = d.groupBy(m).agg(F.array_sort(F.collect_list(F.struct(*order, xml.alias("_x")))).alias("_l"))
        return g.select(m, F.array_join(F.transform("_l", lambda x: x._x), "").alias(name))

    refs = lambda c: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit("#"), escaped(x))), " ")
    zone = F.concat(F.lit("<zone"), q("xml:id", "region_id"), q("ulx", "x"), q("uly", "y"), q("lrx", F.col("x") + F.col("w")), q("lry", F.col("y") + F.col("h")), F.lit("/>"))
    z = regions.groupBy(m, "surface_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("region_id", zone.alias("_x")))), lambda x: x._x), "").alias("_z"))
    s = surfaces.join(z, [m, "surface_id"], "left")
    s = joined(s, ["ord", "surface_id"], F.concat(F.lit("<surface"), q("xml:id", "surface_id"), q("n", "label"), q("lrx", "width"), q("lry", "height"), F.lit("><graphic"), q("url", "url"), F.lit("/>"), F.coalesce("_z", F.lit("")), F.lit("</surface>")), "_surfaces")
    li = lines.join(surfaces.select(m, "surface_id", F.col("ord").alias("_so")), [m, "surface_id"], "left").withColumn("_facs", refs(F.col("region_ids")))
    place = ["_so", "ord", "line_id"]
    physical = joined(li, place, F.concat(F.lit("<ab"), q("xml:id", "line_id"), F.lit(' facs="'), F.col("_facs"), F.lit('"><note>'), escaped(F.concat_ws("; ", "label", "status")), F.lit("</note></ab>")), "_physical")
    t = layers.where("text is not null").withColumn("marks", F.coalesce("marks", F.array().cast(layers.schema["marks"].dataType))).join(li.select(m, *place, "_facs"), [m, "line_id"])
    key = F.concat_ws("-", "line_id", "layer")
    ab = F.concat(F.lit("<ab"), q("xml:id", key), F.lit("><lb"), q("n", "ord"), F.lit(' facs="'), F.col("_facs"), F.lit('"/>'), _marked(F.col("text"), F.col("marks"), key), F.lit("<note>"), escaped("note"), F.lit("</note></ab>"))
    d = t.groupBy(m, "layer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*place, ab.alias("_x")))), lambda x: x._x), "").alias("_d"))
    d = joined(d, ["layer"], F.concat(F.lit('<div type="transcription"'), q("subtype", "layer"), F.lit(">"), F.col("_d"), F.lit("</div>")), "_layers")
    both = F.concat_ws(" ", F.when(F.size("line_ids") > 0, refs(F.col("line_ids"))), F.when(F.size("passage_ids") > 0, refs(F.col("passage_ids"))))
    a = joined(anchors, ["anchor_id"], F.concat(F.lit("<link"), q("xml:id", "anchor_id"), q("type", "relation"), F.lit(' target="'), both, F.lit('"/>')), "_links")
    n = joined(annotations, ["annotation_id"], F.concat(F.lit("<note"), q("xml:id", "annotation_id"), q("type", "type"), F.lit(' target="#'), escaped("target"), F.lit('">'), escaped("text"), F.lit("</note>")), "_notes")
    e = joined(events, ["seq"], F.concat(F.lit("<change"), q("when", "decided_at"), q("who", "reviewer"), q("type", "decision"), F.lit(">"), escaped("note"), F.lit("</change>")), "_changes")
    out = manuscripts
    for x in (s, physical, d, a, n, e):
        out = out.join(x, m, "left")
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    tei = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>'), escaped("title"), F.lit("</title><editor>"), escaped("editor"),
        F.lit("</editor></titleStmt><publicationStmt><p/></publicationStmt><sourceDesc><p>"), escaped("source"), F.lit("</p></sourceDesc></fileDesc>"),
        F.when(part("_changes") != "", F.concat(F.lit("<revisionDesc>"), F.col("_changes"), F.lit("</revisionDesc>"))).otherwise(""), F.lit("</teiHeader><facsimile>"), part("_surfaces"),
        F.lit('</facsimile><text><body><div type="physical-lines">'), part("_physical"), F.lit("</div>"), part("_layers"), F.lit('</body><back><div type="annotations">'), part("_notes"), F.lit('</div><div type="correspondence">'),
        F.when(part("_links") != "", F.concat(F.lit("<linkGrp>"), F.col("_links"), F.lit("</linkGrp>"))).otherwise("<p/>"), F.lit("</div></back></text></TEI>"))
    return out.select(m, tei.alias("tei"))


def to_tei(lines: DataFrame, surface: str, line_no: str, text: str) -> DataFrame:
    """surface, tei: a <div> of <l> elements in line order with escaped text.

    Characters XML forbids make the row fail.
    """
    bad = F.col(text).rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]")
    safe = F.when(bad, F.raise_error(F.lit("text holds a character XML forbids"))).otherwise(xml_escape(F.col(text)))
    row = F.concat(F.lit('<l n="'), F.col(line_no).cast("string"), F.lit('">'), safe, F.lit("</l>"))
    g = lines.where(F.col(text).isNotNull()).select(surface, F.struct(line_no, row.alias("x")).alias("r")).groupBy(surface).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return g.select(surface, F.concat(F.lit('<div n="'), xml_escape(F.col(surface).cast("string")), F.lit('">'), F.array_join(F.transform("rs", lambda r: r.x), ""), F.lit("</div>")).alias("tei"))
