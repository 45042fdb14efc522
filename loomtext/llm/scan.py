"""Repair of text from scanned pages.

Words are grouped by a skeleton of confusable glyphs; a rare form gives way to
the frequent form of its group that the words beside it support, and stays where
they support itself.  Running headers are found by masking digits and comparing
short lines across pages; lines are reflowed to paragraphs with SQL windows.
All statistics are taken over the whole table, per language of the witness.

One table of lines with their words is written first; everything else reads it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.operators.windows import latest
from loomtext.session import small, table

# Glyphs a scanner confuses, each drawn as its simplest parts.
GLYPHS = {
    "w": "vv", "d": "cl", "m": "rn", "n": "ri", "h": "li", "u": "ii",
    "c": "e", "i": "l", "1": "l", "|": "l", "0": "o", "5": "s", "9": "g", "6": "b", "8": "b", "2": "z", "4": "a",
    "स": "र", "ष": "प", "त": "न", "ब": "व", "घ": "ध", "भ": "म", "ठ": "ट", "ढ": "द", "थ": "य",
}
#: A rare form has at most this share of the frequent form's count.
RARE = 0.1
#: A frequent form has at least this share of its language's words, and this count.
FREQUENT, FREQUENT_LEAST = 5e-5, 8
#: A header word stands in at least so many short lines, and mostly there.
HEADER_LINES, HEADER_SHARE = 4, 0.7
#: Words beside the page's own number that are a header where nothing else marks them as one.
NEAR_WORDS = 3
#: A header is at most so wide, measured by the widest line of its reading.
HEADER_WIDTH = 0.8

_LETTER = r"[\p{L}\p{M}]"
_WORD = r"[\p{L}\p{M}\p{N}]+"
_ROMAN = r"(?=[ivxlcdm])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
PAGE_NUMBER = rf"^[\s\[(\-–—]*(?:(?:p|pp|S|s|pag|पृ)\.|पृष्ठ)?\s*(?:[0-9]{{1,4}}|[०-९]{{1,4}}|{_ROMAN}|(?i:{_ROMAN}))[\s\])\-–—.]*$"
DIVIDED = r"[\p{L}\p{M}][-‐‑¬­]\s*$"


def skeleton(w: Column) -> Column:
    """The word drawn in simplest parts; words a scanner confuses share it."""
    s = F.lower(w)
    for glyph in ("w", "d", "m", "n", "h", "u"):  # two strokes each; their parts are reduced below
        s = F.replace(s, F.lit(glyph), F.lit(GLYPHS[glyph]))
    one = {k: v for k, v in GLYPHS.items() if len(v) == 1}
    # parts that are glyphs themselves (m = r + n, n = r + i)
    s = F.replace(F.replace(s, F.lit("n"), F.lit("ri")), F.lit("c"), F.lit("e"))
    return F.translate(s, "".join(one), "".join(one.values()))


@dataclass
class Scan:
    """Lines of scanned pages with what was found on them."""

    lines: DataFrame  # reading_id, line_no, s, kind (null | header | page_number | blank), hyphen
    misread: DataFrame  # reading_id, line_no, surface, form, word_line, divided


def _lang(doc: str) -> Column:
    return F.coalesce(F.substring(doc, 1, 3), F.lit("?"))


def _number(c: Column) -> Column:
    return F.translate(c, "०१२३४५६७८९", "0123456789").try_cast("int")


def _pieces(c: str | Column) -> Column:
    """Words of a text in lower case; null has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(_WORD), F.lit(0)), F.array().cast("array<string>"))


def _latest(readings: DataFrame, raw_layer: str) -> DataFrame:
    """One row per reading id with a text: the latest delivery, see ``latest``."""
    r = latest(readings.where("reading_id is not null and length(text) > 0"), "reading_id", "received_at", ["document_id", "pdf_page", "text", "reading_layer"])
    return r.select("reading_id", _lang("document_id").alias("lang"), F.col("pdf_page").alias("page"), "text", (F.coalesce("reading_layer", F.lit("")) == raw_layer).alias("raw"))


def _lines(r: DataFrame) -> DataFrame:
    """Every line of every reading with its words; ``short`` lines may be headers."""
    plain = F.transform(F.split("text", "\r?\n"), lambda x: F.struct(x.alias("line"), F.trim(F.regexp_replace(x, r"[\s ​﻿]+", " ")).alias("s")))
    d = r.select("reading_id", "lang", "page", "raw", plain.alias("ls"))
    wide = F.array_max(F.transform("ls", lambda x: F.length(x.s)))
    d = d.select("reading_id", "lang", "page", "raw", wide.alias("wide"), F.posexplode("ls").alias("pos", "l"))
    s = F.col("s")
    d = d.select("reading_id", "lang", "page", "raw", (F.col("pos") + 1).alias("line_no"), F.col("l.s").alias("s"), "wide",
                 F.when(F.col("raw"), F.regexp_extract(F.col("l.line"), r"(?:\s{3,}|\s*\|\s*)([0-9०-९]{1,4})\s*$", 1) != "").alias("trail"))
    d = d.withColumn("number", F.col("raw") & s.rlike(PAGE_NUMBER)).withColumn("divided", F.col("raw") & s.rlike(DIVIDED))
    short = F.col("raw") & (s != "") & (F.length(s) <= HEADER_WIDTH * F.col("wide")) & ~s.rlike(r"[.!?।॥,;:]$") & ~F.col("number") & ~F.col("divided")
    return d.select("reading_id", "lang", "page", "raw", "line_no", "s", "trail", "number", "divided", short.alias("short"), _pieces("s").alias("words"))


def _headers(lines: DataFrame, counts: DataFrame) -> DataFrame:
    """(reading_id, hs): numbers of the lines that are running headers."""
    c = lines.where("short")
    lead = _number(F.regexp_extract("s", r"^\[?([0-9०-९]{1,4})\]?\s", 1))
    core = F.trim(F.regexp_replace(F.regexp_replace("s", r"^\[?[0-9०-९]{1,4}\]?\s+", ""), r"\s*\|?\s*[0-9०-९]{1,4}$", ""))
    core = F.regexp_replace(F.lower(core), "[0-9०-९]+", "#")
    # Words that live in short unmarked lines only.
    own = counts.where((F.col("short") >= HEADER_LINES) & (F.col("short") >= HEADER_SHARE * F.col("raw")) & ~F.col("word").rlike("^[0-9०-९]+$"))
    own = table(own.select("lang", "word"), "header-words")
    hits = c.select("reading_id", "line_no", "lang", F.explode(F.array_distinct("words")).alias("word")).join(small(own), ["lang", "word"], "left_semi")
    hits = hits.groupBy("reading_id", "line_no").agg(F.collect_list("word").alias("own"))
    c = c.select("reading_id", "line_no", "lang", lead.alias("lead"), "page", "trail", F.split(core, " ").alias("ts")).where("ts[0] <> ''")
    c = c.join(hits.hint("merge"), ["reading_id", "line_no"], "left")
    mine = F.coalesce("own", F.array().cast("array<string>"))
    shape = F.transform("ts", lambda x: F.when(~x.rlike(_LETTER) | (F.length(x) <= 3) | F.arrays_overlap(_pieces(x), mine), x).otherwise("X"))
    c = c.select("reading_id", "line_no", "lang", "lead", "page", "trail", F.col("own").isNotNull().alias("known"), shape.alias("p"))
    # A header with one garbled word matches a known shape in all other words.  A shape is the combined
    # hash of its words by place, so that the shapes with one word left out cost one step each.
    n, firm = F.size("p"), lambda x: (~x.isin("X", "#")).cast("int")
    c = c.withColumn("n", n).withColumn("all", F.aggregate(F.transform("p", lambda x, i: F.xxhash64(i, x)), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x)))
    c = c.withColumn("firm", F.aggregate("p", F.lit(0), lambda a, x: a + firm(x)))
    left_out = F.transform("p", lambda x, i: F.struct(F.col("all").bitwiseXOR(F.xxhash64(i, x)).bitwiseXOR(F.xxhash64(i, F.lit("*"))).alias("v"), (F.col("firm") - firm(x)).alias("f")))
    v = c.where("n >= 2").select("reading_id", "line_no", "lang", "known", "n", F.inline(left_out))
    known = v.where("known and f >= 2").groupBy("lang", "n", "v").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= HEADER_LINES).select("lang", "n", "v")
    known = table(known, "header-shapes")
    alike = v.where("not known").join(small(known), ["lang", "n", "v"], "left_semi").select("reading_id", "line_no")
    sure = c.where("known or trail").select("reading_id", "line_no")
    # A few words beside the page's own number are a header even if they stand nowhere else.
    near = c.where((F.abs(F.col("lead") - F.col("page")) <= 1) & (F.col("n") <= NEAR_WORDS)).select("reading_id", "line_no")
    return sure.unionByName(alike).unionByName(near).groupBy("reading_id").agg(F.collect_set("line_no").alias("hs"))


def _next(what: str, out: str, back: bool = False) -> Column:
    """``what`` of the next (or previous) line of the text proper."""
    f = "lag" if back else "lead"
    return F.expr(f"{f}(if(kind is null, {what}, null)) ignore nulls over (partition by reading_id order by line_no)").alias(out)


def _text_lines(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """Raw lines with their kind, and what a division at the line's end takes from them.

    ``first`` and ``last``: words of the line that belong to a division at its beginning and end.
    """
    kind = F.when(F.col("s") == "", "blank").when(F.col("number"), "page_number").when(F.array_contains("hs", F.col("line_no")), "header")
    b = lines.where("raw").join(heads.hint("merge"), "reading_id", "left")
    b = b.select("reading_id", "lang", "line_no", "s", "words", "divided", kind.alias("kind"))
    b = b.select("*", _next("struct(s as s, line_no as line_no)", "nx"))
    ends = F.col("kind").isNull() & F.col("divided") & (F.col("nx").isNull() | F.col("nx.s").rlike(r"^[\p{L}\p{M}&&[^\p{Lu}]]"))
    b = b.withColumn("ends", F.coalesce(ends, F.lit(False)))
    b = b.withColumn("part1", F.when(F.col("ends"), F.regexp_extract("s", r"([\p{L}\p{M}\p{N}'’\-‐‑]*[\p{L}\p{M}])[-‐‑¬\u00ad]\s*$", 1)))
    b = b.withColumn("part2", F.when(F.col("ends"), F.regexp_extract("nx.s", r"^([\p{L}\p{M}\p{N}'’]+)", 1)))
    b = b.withColumn("taken", F.size(_pieces("part2")))
    b = b.select("reading_id", "lang", "line_no", "s", "words", "kind", "ends", "part1", "part2", F.col("nx.line_no").alias("next_no"),
                 F.size(_pieces("part1")).alias("last"), F.coalesce(_next("if(ends, taken, 0)", "first", back=True), F.lit(0)).alias("first"))
    return b.withColumn("first", F.when(F.col("kind").isNull(), F.col("first")).otherwise(0))


def scan(readings: DataFrame, raw_layer: str = "raw") -> Scan:
    """Noise of all raw readings.

    ``readings``: reading_id, document_id, pdf_page, raw_block_ids, text,
    reading_layer, and received_at if there is one.  Repeated reading ids count
    once (the latest delivery); null and empty texts have no noise; null pages,
    documents and layers are allowed (no page to compare with, one common
    language, not raw).  All layers support the word counts.
    """
    lines = table(_lines(_latest(readings, raw_layer)), "lines")
    one = F.lit(1).cast("bigint")
    first = lines.select("lang", F.explode("words").alias("word"), "raw", "short").groupBy("lang", "word").agg(
        F.count(one).alias("n"), F.count_if("raw").alias("raw"), F.count_if("short").alias("short"))
    first = table(first, "words")
    body = table(_text_lines(lines, _headers(lines, first)), "text-lines")

    # What lines outside the text hold is taken from the counts; divided words count whole.
    joined = F.concat("part1", F.coalesce("part2", F.lit("")))
    cuts = body.where("ends").select("reading_id", "lang", "line_no", "next_no", "part1", "part2", "words", "last", joined.alias("joined"), F.regexp_extract("s", r"([-‐‑¬\u00ad])\s*$", 1).alias("mark"))
    change = body.where("kind in ('header', 'page_number')").select("lang", F.explode("words").alias("word"), F.lit(-1).alias("d"))
    change = change.unionByName(cuts.select("lang", F.explode(F.concat(_pieces("part1"), _pieces("part2"))).alias("word"), F.lit(-1).alias("d")))
    change = change.unionByName(cuts.select("lang", F.explode(_pieces("joined")).alias("word"), F.lit(1).alias("d")))
    counts = first.select("lang", "word", "n").unionByName(change.groupBy("lang", "word").agg(F.sum("d").alias("n")))
    counts = table(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")).where("n > 0"), "counts")
    hyphen = table(_divided(lines, cuts, counts), "divided")
    return Scan(
        body.join(hyphen.select("reading_id", "line_no", F.lit(True).alias("hyphen")).hint("merge"), ["reading_id", "line_no"], "left")
        .select("reading_id", "line_no", "s", "kind", F.coalesce("hyphen", F.lit(False)).alias("hyphen")),
        _misread(lines, body, hyphen, counts))


def _divided(lines: DataFrame, cuts: DataFrame, counts: DataFrame) -> DataFrame:
    """Divisions made only for the line; a compound keeps the hyphen it has elsewhere."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[‐‑]", "-")
    compound = rf"{_WORD}(?:[-‐‑]{_WORD})+"
    whole = lines.where(F.col("s").rlike(r"[\p{L}\p{M}\p{N}][-‐‑][\p{L}\p{M}\p{N}]")).select("lang", F.explode(F.regexp_extract_all(plain("s"), F.lit(compound), F.lit(0))).alias("hyph"))
    whole = whole.groupBy("lang", "hyph").agg(F.count(F.lit(1)).alias("nh"))
    h = cuts.withColumn("hyph", plain(F.concat_ws("-", "part1", "part2"))).withColumn("word", F.lower("joined"))
    h = h.join(whole.hint("merge"), ["lang", "hyph"], "left").join(counts.select("lang", "word", "n").hint("merge"), ["lang", "word"], "left")
    only = F.col("mark").isin("¬", "\u00ad") | F.col("part2").isNull() | (F.coalesce("nh", F.lit(0)) < F.coalesce("n", F.lit(1)))
    return h.where(only).select("reading_id", "line_no", "lang", "next_no", "part1", "joined", F.get("words", F.size("words") - F.col("last") - 1).alias("prev"))


def _misread(lines: DataFrame, body: DataFrame, hyphen: DataFrame, counts: DataFrame) -> DataFrame:
    """Occurrences of misread words and the forms chosen for them.

    A candidate is rare beside a frequent form of its skeleton.  Each occurrence
    is decided by the words before and after it: of several forms the one seen
    most beside them, then the most frequent; and where its own spelling is seen
    beside them more often (elsewhere) than the form, it is right as it stands.
    """
    # At most 1 / FREQUENT forms of a language are frequent, so this side is bounded.
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    letters = F.length(F.regexp_replace("word", r"[^\p{L}]", ""))
    single = counts.where((letters >= 2) | ((letters == 1) & F.col("word").rlike("[0-9]")))
    g = single.join(F.broadcast(total), "lang").withColumn("sk", skeleton(F.col("word")))  # total: one row per language
    forms = table(g.where((letters >= 2) & (F.col("n") >= FREQUENT_LEAST) & (F.col("n") >= FREQUENT * F.col("total"))).select("lang", "sk", F.col("word").alias("form"), F.col("n").alias("nf")), "forms")
    bad = g.join(F.broadcast(forms), ["lang", "sk"]).where((F.col("word") != F.col("form")) & (F.col("n") <= RARE * F.col("nf"))).select("lang", "word", "form", "nf", (letters < 2).alias("needs"))
    bad = table(bad, "candidates")
    mixed = single.where(F.col("word").rlike(r"\p{L}[0-9]+\p{L}|^[0-9]\p{L}{2}|\p{L}{3}[0-9]$")).select("lang", "word")
    mixed = mixed.join(small(bad, columns=["lang", "word"]), ["lang", "word"], "left_anti")
    bad = table(bad.unionByName(mixed.select("lang", "word", F.lit(None).cast("string").alias("form"), F.lit(0).cast("bigint").alias("nf"), F.lit(False).alias("needs"))), "misread-words")

    none = F.lit(None).cast("string")
    toks = body.where("kind is null").select("reading_id", "lang", "line_no", "s", "words", "first", "last", F.posexplode("words").alias("k", "word"))
    toks = toks.where("k >= first and k < size(words) - last").join(small(bad), ["lang", "word"])
    # The surface is the k-th word of the line as it stands.
    surface = F.element_at(F.regexp_extract_all("s", F.lit(_WORD), F.lit(0)), F.col("k") + 1)
    toks = toks.select("reading_id", "lang", "line_no", "k", "word", "form", "nf", "needs", surface.alias("surface"), F.get("words", F.col("k") - 1).alias("prev"), F.get("words", F.col("k") + 1).alias("follow"),
                       F.lit(None).cast("int").alias("next_no"), F.lit("").alias("part1"))
    cut = hyphen.withColumn("word", F.lower("joined")).join(small(bad), ["lang", "word"]).select(
        "reading_id", "lang", "line_no", F.lit(-1).alias("k"), "word", "form", "nf", "needs", F.col("joined").alias("surface"), "prev", none.alias("follow"), "next_no", "part1")
    occ = table(toks.unionByName(cut), "occurrences")

    # How often the word and each form stand beside these words, over all texts.
    asked = F.array(*[F.struct(a.alias("a"), b.alias("b")) for c in ("word", "form") for a, b in ((F.col("prev"), F.col(c)), (F.col(c), F.col("follow")))])
    asked = table(occ.where("form is not null").select("lang", F.inline(asked)).where("a is not null and b is not null").distinct(), "asked")
    beside = lines.select("lang", "words", F.posexplode("words").alias("k", "b")).where("k > 0").select("lang", F.get("words", F.col("k") - 1).alias("a"), "b")
    beside = table(beside.join(small(asked), ["lang", "a", "b"], "left_semi").groupBy("lang", "a", "b").agg(F.count(F.lit(1)).alias("c")), "beside")
    for what, a, b in (("wp", "prev", "word"), ("wf", "word", "follow"), ("fp", "prev", "form"), ("ff", "form", "follow")):
        occ = occ.join(_seen(beside, a, b, what), ["lang", a, b], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    own = F.greatest(zero("wp") - 1, F.lit(0)) + F.greatest(zero("wf") - 1, F.lit(0))  # without this occurrence
    occ = occ.withColumn("own", own).withColumn("np", zero("fp") + zero("ff"))
    # A digit among letters is never right; a single letter with digits may be a reference and needs support.
    supported = F.when(F.col("needs"), F.col("np") > F.col("own")).otherwise((F.col("np") >= F.col("own")) | F.col("word").rlike("[0-9]"))
    kept = F.col("form").isNull() | supported
    occ = occ.where(kept).groupBy("reading_id", "line_no", "k", "next_no", "part1", "surface").agg(F.max_by("form", F.struct("np", "nf", "form")).alias("form"))
    # The line of a divided word is the one that holds the first differing sign.
    k = F.length("part1")
    lead_ok = F.lower(F.substring("surface", F.lit(1), k)) == F.substring("form", F.lit(1), k)
    at = F.when((k > 0) & F.coalesce(lead_ok, F.lit(False)), F.coalesce("next_no", "line_no")).otherwise(F.col("line_no"))
    cased = F.when(F.substring("surface", 1, 1) != F.lower(F.substring("surface", 1, 1)), F.initcap("form")).otherwise(F.col("form"))
    return occ.select("reading_id", at.alias("line_no"), "surface", cased.alias("form"), F.col("line_no").alias("word_line"), (F.col("k") < 0).alias("divided"))


def _seen(beside: DataFrame, a: str, b: str, what: str) -> DataFrame:
    out = beside.select("lang", F.col("a").alias(a), F.col("b").alias(b), F.col("c").alias(what))
    out.loom_bytes = beside.loom_bytes
    return small(out)


def noise(readings: DataFrame) -> DataFrame:
    """(reading_id, line_no, noise_kind): lines of raw readings with each kind of noise."""
    s = scan(readings)
    kinds = s.lines.where("kind in ('header', 'page_number')").select("reading_id", "line_no", F.col("kind").alias("noise_kind"))
    hy = s.lines.where("hyphen").select("reading_id", "line_no", F.lit("hyphen").alias("noise_kind"))
    mis = s.misread.select("reading_id", "line_no", F.lit("misread").alias("noise_kind"))
    return kinds.unionByName(hy).unionByName(mis).select("reading_id", F.col("line_no").cast("bigint").alias("line_no"), "noise_kind").distinct()


def _replaced(text: Column, fixes: Column) -> Column:
    """``text`` with the surface of every fix, where it is a whole word, replaced by its form."""
    edge = r"[\p{L}\p{M}\p{N}]"
    return F.aggregate(F.array_distinct(fixes), text, lambda a, f: F.regexp_replace(a, F.concat(F.lit(f"(?<!{edge})"), f.surface, F.lit(f"(?!{edge})")), f.form))


def paragraphs(readings: DataFrame) -> DataFrame:
    """(reading_id, paragraph_no, text): continuous paragraphs of raw readings.

    Headers and page numbers are left out, misread words replaced by the form
    chosen for them (kept where there is none), divided words joined, and lines
    between blank lines reflowed.
    """
    s = scan(readings)
    fix = F.struct("surface", "form")
    fixes = s.misread.where("form is not null").groupBy("reading_id", F.col("word_line").alias("line_no")).agg(
        F.collect_set(F.when(~F.col("divided"), fix)).alias("fixes"), F.collect_set(F.when(F.col("divided"), fix)).alias("joined"))
    w = Window.partitionBy("reading_id").orderBy("line_no")
    body = s.lines.where("kind is null or kind = 'blank'").withColumn("paragraph_no", F.sum(F.when(F.col("kind") == "blank", 1).otherwise(0)).over(w) + 1)
    body = body.where("kind is null").join(fixes.hint("merge"), ["reading_id", "line_no"], "left")
    body = body.withColumn("s", _replaced(F.col("s"), F.coalesce("fixes", F.array().cast(fixes.schema["fixes"].dataType))))
    own = F.col("s").rlike(r"[\p{L}\p{M}][-‐‑]$")
    glue = F.when(own & ~F.col("hyphen"), F.concat("s", F.lit("\u0000"))).when(F.col("hyphen"), F.concat(F.regexp_replace("s", r"[-‐‑¬\u00ad]\s*$", ""), F.lit("\u0000"))).otherwise(F.concat("s", F.lit(" ")))
    p = body.groupBy("reading_id", "paragraph_no").agg(
        F.array_sort(F.collect_list(F.struct("line_no", glue.alias("t")))).alias("ls"), F.flatten(F.collect_list(F.coalesce("joined", F.array().cast(fixes.schema["joined"].dataType)))).alias("fixes"))
    text = F.trim(F.replace(F.concat_ws("", F.transform("ls", lambda x: x.t)), F.lit("\u0000"), F.lit("")))
    return p.select("reading_id", F.col("paragraph_no").cast("bigint").alias("paragraph_no"), _replaced(text, F.col("fixes")).alias("text"))
