"""Scalar text functions.  JVM expressions where Spark has them, pandas UDFs for Unicode forms."""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_left
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

#: A token: one CJK character, or a run of letters, marks and digits with single joiners inside.
WORD_CHARS = r"[\p{L}\p{M}\p{N}]"
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
TOKEN = rf"{CJK}|{WORD_CHARS}+(?:['’\-‐‑]{WORD_CHARS}+)*"
#: Tokens and the gaps between them; together they cover every character.
PIECE = rf"{TOKEN}|[^\p{{L}}\p{{M}}\p{{N}}]+"
#: Tokens of the manuscript concordance: apostrophes join, hyphens do not.
MS_TOKEN = rf"{WORD_CHARS}+(?:['’]{WORD_CHARS}+)*"

# Devanagari letters in IAST.
_CONSONANTS = (
    "क k ख kh ग g घ gh ङ ṅ च c छ ch ज j झ jh ञ ñ ट ṭ ठ ṭh ड ḍ ढ ḍh ण ṇ त t थ th द d ध dh न n "
    "प p फ ph ब b भ bh म m य y र r ल l व v श ś ष ṣ स s ह h"
)
_VOWELS = "अ a आ ā इ i ई ī उ u ऊ ū ऋ ṛ ॠ ṝ ऌ ḷ ॡ ḹ ए e ऐ ai ओ o औ au"
_SIGNS = "ा ā ि i ी ī ु u ू ū ृ ṛ ॄ ṝ ॢ ḷ ॣ ḹ े e ै ai ो o ौ au"


def _pairs(s: str) -> dict[str, str]:
    parts = s.split()
    return dict(zip(parts[::2], parts[1::2]))


CONSONANTS, VOWELS, SIGNS = _pairs(_CONSONANTS), _pairs(_VOWELS), _pairs(_SIGNS)
_VIRAMA = "्"


def _roman(s: str, consonants: dict[str, str], other: dict[str, str]) -> str:
    out = []
    for ch, after in zip(s, s[1:] + " "):
        if ch in consonants:
            out.append(consonants[ch] if after == _VIRAMA or after in SIGNS else consonants[ch] + "a")
        else:
            out.append(other.get(ch, ch))
    return "".join(out)


_IAST_OTHER = {**VOWELS, **SIGNS, "ं": "ṃ", "ँ": "m̐", "ः": "ḥ", _VIRAMA: "", "़": ""}
_KEY_OTHER = {**VOWELS, **SIGNS, "ं": "m", "ँ": "m", "ः": "h", _VIRAMA: "", "ऽ": ""}


def iast(s: str) -> str:
    """Devanagari to IAST; other characters stay (NFKC)."""
    return _roman(unicodedata.normalize("NFKC", s), {**CONSONANTS, "ळ": "ḷ"}, _IAST_OTHER)


def letters_key(s: str) -> str:
    """Alignment key: romanised, case-folded, only a-z."""
    return "".join(c for c in unicodedata.normalize("NFD", _roman(s, CONSONANTS, _KEY_OTHER).casefold()) if "a" <= c <= "z")


def fold(s: str) -> str:
    """NFKD without marks, lower case, trimmed."""
    return "".join(c for c in unicodedata.normalize("NFKD", s) if unicodedata.category(c)[0] != "M").lower().strip()


def lexical_form(s: str) -> str:
    """Folded IAST with only a-z, 0-9 and Han characters."""
    return "".join(c for c in fold(iast(s)) if c in "abcdefghijklmnopqrstuvwxyz0123456789" or unicodedata.name(c, "").startswith("CJK "))


def _udf(f):
    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        codes, values = pd.factorize(s, use_na_sentinel=True)
        made = [f(v) for v in values] + [None]
        return pd.Series([made[c] for c in codes], dtype=object)

    return run


iast_udf, letters_key_udf, fold_udf, lexical_form_udf = _udf(iast), _udf(letters_key), _udf(fold), _udf(lexical_form)
analysis_form_udf = _udf(lambda s: unicodedata.normalize("NFKC", s).lower().strip())
root_form_udf = _udf(lambda s: unicodedata.normalize("NFKC", s).lower())
composed_udf = _udf(lambda s: unicodedata.normalize("NFC", s))
manuscript_fold_udf = _udf(lambda s: unicodedata.normalize("NFC", s).lower())


def tokens(text: Column) -> Column:
    """Array of the tokens of a text."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


@lru_cache(1)
def _token_pattern():
    import regex

    return regex.compile(re.sub(r"\\x\{([0-9A-F]{4})\}", r"\\u\1", TOKEN))


#: Number labels ('1.2. ') at line starts.
NUMBER_LABEL = re.compile(r"^\s*\d+(?:\.\d+)+\.\s+", re.MULTILINE)
_SPAN = StructType([StructField("surface", StringType()), StructField("start_pos", LongType()), StructField("end_pos", LongType()), StructField("label", BooleanType())])


def token_spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(surface, start, end, label) of every token; ``label``: it belongs to a number label at a line's start."""
    if not text:
        return []
    labels = [m.span() for m in NUMBER_LABEL.finditer(text)]
    return [(m[0], m.start(), m.end(), any(a <= m.start() and m.end() <= b for a, b in labels)) for m in _token_pattern().finditer(text)]


@F.arrow_udf(ArrayType(_SPAN))
def token_spans_udf(text: pa.Array) -> pa.Array:
    """``token_spans`` of a column, put together as flat Arrow arrays."""
    words, starts, ends, labels, offsets = [], [], [], [], [0]
    find = _token_pattern().finditer
    for t in text.to_pylist():
        if t:
            n = len(words)
            for m in find(t):
                words.append(m[0])
                starts.append(m.start())
                ends.append(m.end())
            marks = [False] * (len(words) - n)
            for m in NUMBER_LABEL.finditer(t):
                for i in range(bisect_left(starts, m.start(), n), len(words)):
                    if ends[i] > m.end():
                        break
                    marks[i - n] = True
            labels += marks
        offsets.append(len(words))
    flat = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(labels, pa.bool_())], names=["surface", "start_pos", "end_pos", "label"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


def clean_text(text: Column) -> Column:
    """Line feeds only, no blanks at line ends, at most one blank line, trimmed."""
    s = F.regexp_replace(text, "\r\n?", "\n")
    s = F.regexp_replace(s, "[ \t]+\n", "\n")
    return F.regexp_replace(F.regexp_replace(s, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Every run of white space as one blank."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def kwic(text: Column, start: Column, end: Column, left: int = 72, right: int = 100) -> tuple[Column, Column]:
    """Left and right context of [start, end), with ellipses where text is cut."""
    a = F.greatest(start - left, F.lit(0))
    b = F.least(end + right, F.length(text))
    return (
        F.concat(F.when(a > 0, "…").otherwise(""), F.substring(text, a.cast("int") + 1, (start - a).cast("int"))),
        F.concat(F.substring(text, end.cast("int") + 1, (b - end).cast("int")), F.when(b < F.length(text), "…").otherwise("")),
    )


def snippet(text: Column, start: Column, end: Column) -> Column:
    """110 characters before and 150 after the span, snapped to a near paragraph break."""
    before = F.substring(text, F.lit(1), (start + 2).cast("int"))
    p = F.length(before) - F.instr(F.reverse(before), "\n\n") - 1  # 0-based place of the last break
    p = F.when(F.instr(before, "\n\n") > 0, p).otherwise(-1)
    q = F.locate("\n\n", F.substring(text, (end + 1).cast("int"), F.length(text))) - 1
    a = F.when((p >= 0) & (start - p < 220), p + 2).otherwise(F.greatest(start - 110, F.lit(0)))
    b = F.when((q >= 0) & (q < 280), end + q).otherwise(F.least(end + 150, F.length(text)))
    return F.concat(
        F.when(a > 0, "… ").otherwise(""), F.substring(text, (a + 1).cast("int"), (start - a).cast("int")), F.lit("<mark>"),
        F.substring(text, (start + 1).cast("int"), (end - start).cast("int")), F.lit("</mark>"),
        F.substring(text, (end + 1).cast("int"), (b - end).cast("int")), F.when(b < F.length(text), " …").otherwise(""))


def highlight(text: Column, terms: list[str]) -> Column:
    """Marks all terms, longest first, whatever their case."""
    alts = "|".join(re.escape(t) for t in sorted({t for t in terms if t}, key=lambda t: (-len(t), t)))
    return F.regexp_replace(text, f"(?i)({alts})", "<mark>$1</mark>") if alts else text


def unit_order(order: Column, number: Column) -> Column:
    """Explicit order, else the last part of a dotted number, else the largest value."""
    return F.coalesce(order.cast("bigint"), F.element_at(F.split(number, r"\."), -1).try_cast("bigint"), F.lit(2**53 - 1))


def canonical_unit(unit_id: Column) -> Column:
    return F.regexp_replace(unit_id, "^sentence-", "dharmanexus-")


def number_list(spec: Column) -> Column:
    """'_' and null give no numbers; otherwise the comma-separated list, trimmed."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(spec.isNull() | (F.trim(spec) == "_"), F.array().cast("array<string>")).otherwise(parts)


def xml_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def lexical_parts(text: str, lang: str) -> list[str]:
    """Folded parts of a form: single characters in Chinese, blank-separated words elsewhere."""
    raw = list(text) if lang == "zho" else text.split()
    return [p for p in map(lexical_form, raw) if p]


def alignable(token: Column) -> Column:
    """Tokens worth aligning: with a letter or mark, no verse marker, no lone or Roman ASCII capital."""
    return token.rlike(r"[\p{L}\p{M}]") & (F.lower(token) != "vvs") & ~token.rlike("^(?:[A-Z]|[IVXLCDM]+)$")


def lexically_eligible(token: Column, lang: Column) -> Column:
    """Tokens a glossary can cover, by language."""
    base = token.rlike(r"\p{L}")
    return (
        F.when(lang == "san", base & (token != "Vvs"))
        .when(lang == "bod", base & ~token.rlike(r"^(?:[A-Z]|[IVXLCDM]+|\d+[A-Za-z]+|(?i:colophon|ef))$"))
        .when(lang == "zho", token.rlike(r"\p{IsHan}")).otherwise(base)
    )


#: Speakers whose bracketed label is no part of the wording; verse labels such as '[12a]' neither.
SPEAKERS = ("Vasubandhu", "Objection", "Opponent", "Reply")


def without_labels(text: Column, speakers: tuple[str, ...] = SPEAKERS) -> Column:
    """Text without bracketed speaker and verse labels ('[Objection:]', '[12a]'), squeezed.

    Other bracketed words stay.  The label may end in a colon or full stop.
    """
    names = "|".join(re.escape(x) for x in speakers)
    return squeeze(F.regexp_replace(text, rf"(?i)\[(?:{names}|\d+[a-d]*)[:.]?\]", " "))


@lru_cache(1)
def compatible() -> tuple[str, str]:
    """Characters whose compatibility form is one other character, and these forms, by rule (for ``translate``)."""
    every = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if not 0xD800 <= ord(c) < 0xE000]
    pairs = [(c, unicodedata.normalize("NFKC", c)) for c in every]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b and b != "'" and unicodedata.normalize("NFC", a) != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def loose_pattern(marker: str) -> str:
    """Regular expression for a marker in which white space does not matter."""
    return r"\s*".join(re.escape(c) for c in marker if not c.isspace())


def locate_loosely(text: Column, marker: str) -> Column:
    """0-based place of a marker found exactly once, whatever its white space; else null."""
    p = F.lit(loose_pattern(marker))
    return F.when(F.regexp_count(text, p) == 1, F.regexp_instr(text, p) - 1)


def https_url(url: Column, hosts: list[str] | None = None) -> Column:
    """Is it an https address (of one of the hosts)?"""
    ok = F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")) == "https", F.lit(False)) & F.try_parse_url(url, F.lit("HOST")).isNotNull()
    return ok & F.coalesce(F.try_parse_url(url, F.lit("HOST")).isin(hosts), F.lit(False)) if hosts else ok
