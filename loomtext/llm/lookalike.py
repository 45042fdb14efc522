"""One consistent form for text that looks the same in different characters."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomtext.session import small, table

# Letters and marks of other scripts drawn like a Latin one.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    # Greek
    "ν": "v", "ο": "o", "α": "a", "ι": "i", "ρ": "p", "υ": "u", "ϳ": "j", "κ": "k", "χ": "x", "γ": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    # Cherokee and Lisu
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Latin and Armenian
    "ɑ": "a", "ɡ": "g", "ո": "n", "օ": "o", "ս": "u", "ց": "g", "հ": "h",
    # marks
    "ʼ": "’", "＇": "'", "‐": "-", "‑": "-", "﹣": "-", "−": "–", "ǀ": "|", "∣": "|", "ⅼ": "l", "՚": "’", "꞉": ":", "׃": ":", "⁄": "/", "∕": "/",
}
#: Compatibility kinds whose plain form looks different.
VISIBLE_KINDS = {"super", "sub", "circle", "square", "fraction", "font", "vertical"}
BLANKS = re.compile("[\\u00a0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000]")


@lru_cache(1)
def _ignorable() -> dict[int, None]:
    """Default-ignorable code points, by rule: format characters, fillers, selectors."""
    extra = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), *range(0x180B, 0x1810)}
    shown = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x08E2, 0x110BD, 0x110CD}  # format characters that are drawn
    return {c: None for c in range(sys.maxunicode + 1) if c in extra or (unicodedata.category(chr(c)) == "Cf" and c not in shown)}


@lru_cache(1)
def _kept() -> dict[str, str]:
    """Characters with a compatibility form of another look, kept apart from it."""
    out = {"ſ": "ſ"}
    for c in range(sys.maxunicode + 1):
        d = unicodedata.decomposition(chr(c))
        if d.startswith("<") and d[1:d.index(">")] in VISIBLE_KINDS:
            out[chr(c)] = chr(c)
    return out


_MAP = str.maketrans(LOOKALIKES)


class _Table(dict):
    """Translation of one code point, worked out at its first use."""

    def __init__(self, kept: dict[str, str]):
        super().__init__()
        self.kept = kept

    def __missing__(self, c: int) -> str:
        ch = chr(c)
        if c in _ignorable():
            out = ""
        elif BLANKS.match(ch):
            out = " "
        else:
            out = (unicodedata.normalize("NFD", ch) if ch in self.kept else unicodedata.normalize("NFKD", ch)).translate(_ignorable()).translate(_MAP)
        self[c] = out
        return out


@lru_cache(2)
def _table(visible: bool) -> _Table:
    return _Table(_kept() if visible else {})


def canonical(text: str | None) -> str | None:
    """NFKC, full case folding, mapped blanks, no ignorables, one letter per look."""
    if text is None:
        return None
    s = text.replace("\r\n", "\n").translate(_table(False)).casefold().translate(_MAP)
    return unicodedata.normalize("NFKC", s)


def look(text: str | None) -> str | None:
    """Like ``canonical``, but case, superscripts and the like stay distinct."""
    if text is None:
        return None
    return unicodedata.normalize("NFC", text.replace("\r\n", "\n").translate(_table(True)))


def _each_distinct(f):
    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        codes, values = pd.factorize(s, use_na_sentinel=True)
        made = [f(v) for v in values] + [None]
        return pd.Series([made[c] for c in codes], dtype=object)

    return run


canonical_udf = _each_distinct(canonical)
look_udf = _each_distinct(look)


def forms(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys, ``text_col``, ``form`` and ``look``; each distinct text is normalised once.

    A null text has null forms; an empty one, or one of ignorable characters
    only, has the empty form.  Repeated rows stay.  Extra columns are dropped.
    """
    d = rows.select(F.col(text_col).alias("_t")).where("_t is not null").distinct()
    d = d.select("_t", canonical_udf("_t").alias("form"), look_udf("_t").alias("look"))
    return rows.select(*keys, text_col).join(d, F.col(text_col) == F.col("_t"), "left").drop("_t")


def look_classes(rows: DataFrame, kind: str, key: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Classes of texts that look the same in different characters: their texts, and their rows.

    The distinct texts of each kind are normalised once, whatever number of rows holds them.  Texts: ``kind``,
    ``look``, ``t``, ``form``; rows: ``kind``, ``key``, ``t``, ``look`` of the rows that hold one of them.
    Classes of a single text are left out.
    """
    r = rows.select(F.col(kind).alias("kind"), F.col(key).alias("key"), F.col(text_col).alias("t")).where("key is not null and t is not null")
    texts = r.select("kind", "t").distinct()
    texts = texts.select("kind", "t", canonical_udf("t").alias("form"), look_udf("t").alias("look"))
    # Candidates share the canonical form; the exact look decides.
    texts = table(texts.select("*", F.xxhash64("form").alias("f"), F.xxhash64("look").alias("h")), "looks")
    live = table(texts.groupBy("kind", "f", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "shared-looks")
    texts = texts.join(small(live), ["kind", "f", "h"], "left_semi")
    live = texts.groupBy("kind", "form", "look").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", "form", "look")
    texts = table(texts.select("kind", "look", "t", "form").join(live.hint("merge"), ["kind", "form", "look"], "left_semi"), "equal-looks")  # few rows are left here
    return texts, table(r.join(small(texts, columns=["kind", "t", "look", "form"]), ["kind", "t"]).distinct(), "equal-rows")


def looking_equal(rows: DataFrame, kind: str, key: str, text_col: str) -> DataFrame:
    """Pairs (``kind``, key_a, key_b) whose texts look the same but are not the same.

    Only within one kind.  Null kinds, texts and keys take part in no pair; a
    repeated (kind, key, text) counts once; extra columns are dropped; empty in,
    empty out.  Pairs are formed between the different texts of a class first and
    expanded to rows last, so exact copies, however many, are never compared
    with each other.
    """
    texts, members = look_classes(rows, kind, key, text_col)
    a, b = texts.alias("a"), texts.alias("b")
    unlike = a.join(b, F.expr("a.kind = b.kind and a.look = b.look and a.form = b.form and a.t < b.t")).select(
        F.col("a.kind").alias("kind"), F.col("a.t").alias("ta"), F.col("b.t").alias("tb"))
    m = members.select("kind", "key", "t")
    pairs = unlike.join(m.toDF("kind", "ka", "ta"), ["kind", "ta"]).join(m.toDF("kind", "kb", "tb"), ["kind", "tb"]).where("ka <> kb")
    return pairs.select(F.col("kind").alias(kind), F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()


def look_links(rows: DataFrame, kind: str, key: str, text_col: str) -> DataFrame:
    """(``kind``, ``key``, class_id, n_links): every row with an equal-looking one, its class, and how many it has.

    ``class_id`` is the least key of the class, a link a row of another key whose text looks the same in
    other characters.  The pairs of ``looking_equal`` are not formed: links are counted from the sizes of a
    class's texts.  A key of several texts has the links of all of them.
    """
    _, m = look_classes(rows, kind, key, text_col)
    per = m.groupBy("kind", "form", "look", "t").agg(F.count(F.lit(1)).alias("n"))
    every = per.groupBy("kind", "form", "look").agg(F.sum("n").alias("all"))
    least = m.groupBy("kind", "form", "look").agg(F.min("key").alias("class_id"))
    # Rows of the same key under another text of the class are no links.
    own = m.groupBy("kind", "form", "look", "key").agg(F.count(F.lit(1)).alias("mine"))
    on = ["kind", "form", "look"]
    r = m.join(per, [*on, "t"]).join(every, on).join(least, on).join(own, [*on, "key"])
    r = r.groupBy("kind", "key").agg(F.min("class_id").alias("class_id"), F.sum(F.col("all") - F.col("n") - (F.col("mine") - 1)).alias("n_links"))
    return r.where("n_links > 0").select(F.col("kind").alias(kind), F.col("key").alias(key), "class_id", "n_links")
