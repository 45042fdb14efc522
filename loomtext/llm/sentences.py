"""Sentence boundaries across languages and scripts.

The default sentence-break rules by character property (terminators of all
scripts, closing marks, separators, from the public property tables), with
suppression after the abbreviations of the text's own language, after initials,
numbers and omission dots, and with quotations kept together with their
introduction or reporting clause.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.lookalike import LOOKALIKES, _ignorable

# Fixed values, by language: its commonest words; abbreviations that never end a sentence; abbreviations that
# stand before a number (elsewhere the word ends a sentence as any other); abbreviations after which a sentence
# may end if a new one plainly begins; words before an ordinal; lower-case words that carry a sentence on.
LANGUAGES = {
    "en": {
        "common": "the of and to in is that it for as with was on are by this be from not which or at but his have an they one who",
        "never": "prof dr mr mrs ms mss st rev vs cf ed eds transl approx esp viz e.g i.e resp incl sc jr sr hon gen col capt lt gov dept univ assn",
        "number": "no nos p pp v vv l ll fol fols vol vols fig figs ch chap sec art ms mss t sp",
        "may_end": "etc f ff al ibid",
        "goes_on": "he she it they we i you is are was were be has have had do does did and or but nor yet so in on of to by at as with from for that "
        "which who whom says said asks asked replies replied answers answered writes wrote thinks holds adds added cries cried stands reads means "
        "also can could will would may might not the a an",
    },
    "de": {
        "common": "der die das und ist nicht von zu den mit sich des auf für im dem ein eine als auch es an werden aus er hat dass sie nach wird bei oder",
        "never": "prof dr vgl bzw bearb hrsg ca sog evtl ggf z.b d.h u.a s.o s.u o.ä i.d.r hl inkl zzgl lat gr dt jh übers geb gest allg bes",
        "number": "nr bd s z kap abs anm sp bl abb taf aufl ms mss t v vv l p",
        "may_end": "usw usf f ff u.a dgl ebd",
        "ordinal": "am an im vom zum zur der die das dem den des jeder jede",
        "goes_on": "er sie es ist sind war waren hat haben und oder aber doch denn in im an am auf zu zum von vom mit bei steht heißt sagt sagte fragt fragte "
        "antwortet schreibt ruft meint denkt fügt also usf",
    },
    "fr": {
        "common": "le la les de des du et est un une en que qui dans pour pas sur au aux avec ce cette il elle sont par ne se plus",
        "never": "m mm mme mlle dr pr st ste cf éd env p.ex c.-à-d av apr",
        "number": "n no p pp vol t chap art fig fol ms ch",
        "may_end": "etc ibid",
        "goes_on": "il elle ils elles et ou mais est sont dit répond demande écrit ajoute",
    },
    "es": {
        "common": "el la los las de del y es un una en que por para con no se su al lo como más pero sus le ha o",
        "never": "sr sra srta dr dra d ud uds vd vds p.ej ed eds aprox",
        "number": "núm pág págs vol cap art fig fol t",
        "may_end": "etc ibíd",
        "goes_on": "él ella ellos y o pero es son dice dijo pregunta responde escribe",
    },
    "it": {
        "common": "il lo la i gli le di del della e è un una in che per non con si da al sono come più ma anche nel",
        "never": "sig sigg dott prof cfr ed ca p.es",
        "number": "n p pp pag vol cap art fig f t",
        "may_end": "ecc ibid",
        "goes_on": "egli lui lei e o ma è sono dice disse chiede risponde scrive",
    },
    "ru": {
        "common": "и в не на что я он с как это по но из у за от так же для то все она",
        "never": "проф др т.е т.к т.н им гр св ред см ср",
        "number": "с стр т гл рис ст п №",
        "may_end": "др пр т.д т.п",
        "goes_on": "он она они и или но сказал сказала говорит спросил ответил пишет",
    },
    "hi": {
        "common": "के का की है में से को और यह पर ने हैं भी कि नहीं एक इस था थे तो",
        "never": "डॉ प्रो पृ पं सं श्री क्र अनु ई",
    },
    "bo": {"common": "dang las kyi gi ni la yin du na ba pa"},
    "zh": {},
}
#: Quotation marks and what closes them.
PAIRS = {"“": "”", "‘": "’", "«": "»", "「": "」", "『": "』", "„": "“”", "‚": "‘’"}
_LETTERS = re.compile(r"(?:[^\W\d_]|[ऀ-ःऺ-ॏ])+")
_WORD_BEFORE = re.compile(r"(?:[^\W\d_]|[्ऀ-ःऺ-ॏ]|\.(?=[^\W\d_]))+$")


def _plain(word: str) -> str:
    """A listed word in the plain characters that texts are compared in."""
    return "".join(_shadow[ord(c)] for c in word)


@lru_cache(64)
def _rules(langs: tuple[str, ...]) -> dict[str, frozenset[str]]:
    """The word lists of these languages, joined."""
    return {k: frozenset(_plain(w) for g in langs for w in LANGUAGES[g].get(k, "").split()) for k in ("never", "number", "may_end", "ordinal", "goes_on")}


@lru_cache(1)
def _common() -> dict[str, tuple[str, ...]]:
    out: dict[str, tuple[str, ...]] = {}
    for g, x in LANGUAGES.items():
        for w in map(_plain, x.get("common", "").split()):
            out[w] = (*out.get(w, ()), g)
    return out


def languages(text: str) -> tuple[str, ...]:
    """Languages of a text by its commonest words: the leading one, and any that comes near it.

    A text without such words may be in any of them.
    """
    n: dict[str, int] = {}
    common = _common()
    for w in _LETTERS.findall(text.lower()):
        for g in common.get(w, ()):
            n[g] = n.get(g, 0) + 1
    most = max(n.values(), default=0)
    return tuple(g for g in LANGUAGES if 2 * n.get(g, 0) >= most) if most else tuple(LANGUAGES)


def _with(prop: str) -> set[str]:
    """All characters of a sentence-break class or property, from the public property tables."""
    import regex

    find = regex.compile(rf"\p{{{prop}}}")
    return {c for c in map(chr, range(sys.maxunicode + 1)) if find.match(c)}


@lru_cache(1)
def closing() -> frozenset[str]:
    """Closing punctuation: what the sentence-break rules let stand behind a terminator and opens nothing."""
    return frozenset(c for c in _with("Sentence_Break=Close") if unicodedata.category(c) in ("Pe", "Pf") or c in "'\"")


@lru_cache(1)
def terminators() -> str:
    """Characters with the sentence-terminal property."""
    return "".join(sorted(_with("Sentence_Terminal") | {"｡"}))


class _Shadow(dict):
    """One character for one: full-width, look-alike letters and blanks made plain; ignorables dropped."""

    def __missing__(self, c: int) -> str:
        ch = chr(c)
        if c in _ignorable():
            out = ""
        elif ch in "　\n\r‑":
            out = ch
        else:
            n = unicodedata.normalize("NFKC", ch)
            out = n if len(n) == 1 else ch
            out = LOOKALIKES.get(out, out)
            out = " " if len(out) == 1 and out.isspace() else out[:1]
        self[c] = out
        return out


_shadow = _Shadow()
_PARAGRAPH = re.compile(r"(?:\r\n|[\n\r\x0b\x0c\x85 ])(?:[^\S\n\r])*(?:\r\n|[\n\r\x0b\x0c\x85 ])\s*|[\x0c ]\s*")


@lru_cache(1)
def _mark() -> re.Pattern:
    return re.compile(r"\.(?:\s?\.)+|…+|[.%s]+|\|{2,}|/{2,}|༎|༏|༑" % re.escape(terminators()))


_VERSE = re.compile(r"\s*[0-9०-९༠-༩]{1,3}\s*(?:\|{2,}|/{2,}|॥|।।)|\s*(?:\|{2,}|/{2,}|॥)(?!\S)")


def _quotes(s: str) -> list[tuple[int, int]]:
    """Paired quotations [open, close] of a paragraph; unpaired marks quote nothing."""
    out, stack = [], []
    straight = None
    for i, ch in enumerate(s):
        if stack and ch in stack[-1][1] and not (ch == "’" and i + 1 < len(s) and s[i + 1].isalpha() and i and s[i - 1].isalpha()):
            out.append((stack.pop()[0], i))
        elif ch in PAIRS:
            if ch == "‘" and i and s[i - 1].isalnum():
                continue
            stack.append((i, PAIRS[ch]))
        elif ch == '"':
            if straight is None:
                straight = i
            else:
                out.append((straight, i))
                straight = None
        elif ch in "”’" and len(stack) > 1 and ch in stack[-2][1]:  # the inner one was never closed
            stack.pop()
            out.append((stack.pop()[0], i))
    return out


def _goes_on(rest: str, rules: dict) -> bool:
    """Does what follows a closing mark carry the sentence on?"""
    r = rest.lstrip()
    if not r:
        return False
    if r[0] in ",;:，；：、" or (r[0] in "–—" and rest[:1].isspace()):
        return True
    if r[0] in "者曰言道" or (r[0] == "云" and r[1:2] != "何") or r.startswith(("問曰", "答曰")):
        return rest[:1] == r[0]
    m = re.match(r"[^\W\d_]+", r)
    if m and m[0][0].islower():
        return m[0] in rules["goes_on"]
    return bool(re.match(r"(?:ऐसा|यह|इति|कहकर)\s", r)) and "कह" in r[:30]


def _paragraph(s: str, rules: dict) -> list[tuple[int, int]]:
    """Sentences of one paragraph (shadow text without ignorables)."""
    cjk = len(re.findall("[㐀-鿿豈-﫿]", s))
    if cjk and cjk * 2 >= sum(c.isalpha() for c in s) and not re.search("[。!?｡]", s):
        return [(m.start(), m.end()) for m in re.finditer(r"[^　\n\r]+", s)]
    quotes = _quotes(s)
    guarded = []  # quotations inside which nothing ends
    after_close = {}
    for a, b in quotes:
        lead = s[:a].rstrip()
        intro = lead[-1:] in (":", "：") or lead[-1:] in (",", "，")
        follow = _goes_on(s[b + 1 :], rules)
        after_close[b] = follow
        if intro or follow:
            guarded.append((a, b))
    brackets = []
    depth = []
    for i, ch in enumerate(s):
        if ch in "([（［":
            depth.append(i)
        elif ch in ")]）］" and depth:
            brackets.append((depth.pop(), i))

    out, start, done = [], 0, 0
    start = len(s) - len(s.lstrip())
    for m in _mark().finditer(s):
        i, j = m.span()
        if i < max(done, start):
            continue
        mark = m[0]
        if "…" in mark or (mark.replace(" ", "").startswith("..") and set(mark) <= {".", " "}):
            continue
        # closing quotes and brackets behind the mark
        e = j
        while e < len(s) and (s[e] in closing() or (s[e] == "“" and any(b == e for _, b in quotes))):
            if s[e] in "'\"’" and e + 1 < len(s) and s[e + 1].isalpha() and not any(b == e for _, b in quotes):
                break
            e += 1
        if any(a < i and b >= e for a, b in guarded):
            continue
        if any(start < a < i and b >= e for a, b in brackets):  # a bracket inside the sentence
            continue
        inner = [(a, b) for a, b in brackets if start < a < i and j <= b < e]
        closed = [b for _, b in quotes if j <= b < e]
        if closed and any(after_close[b] for b in closed):
            continue
        if mark == "." and not _full_stop(s, start, i, e, rules):
            continue
        if inner and not closed and s[inner[-1][1] + 1 : inner[-1][1] + 2] in {".", "।", "。", ",", ";"}:
            continue
        rest = s[e:]
        if mark[0] in "!?" or closed:
            if _goes_on(rest, rules):
                continue
        if mark == "//" and i and s[i - 1] == ":":
            continue
        v = _VERSE.match(s, e) if mark[0] in "|/।॥༎" else None
        if v:
            e = v.end()
        else:
            f = re.match(r"(?:[0-9०-९](?![\w.])|[¹²³⁰-⁹]+|\[\d{1,3}\]|[0-9]{1,2}$)", s[e:])
            if f:
                e += f.end()
        out.append((start, e))
        start = done = e
        while start < len(s) and s[start].isspace():
            start += 1
    if start < len(s.rstrip()):
        out.append((start, len(s.rstrip())))
    merged: list[tuple[int, int]] = []
    for a, b in out:
        if not any(c.isalnum() for c in s[a:b]):
            if merged:
                merged[-1] = (merged[-1][0], b)
            continue
        merged.append((a, b))
    return merged


def _full_stop(s: str, start: int, i: int, e: int, rules: dict) -> bool:
    """Does the single full stop at ``i`` (closing marks up to ``e``) end a sentence?"""
    before, after = s[start:i], s[i + 1 :]
    nxt = s[e : e + 1]
    tail = s[e:].lstrip()
    first = tail[:1]
    if not before.strip(" ([\"“‘„"):
        return False
    if re.fullmatch(r"\W*(?:\d+|[०-९]+)(?:\.\d+)*", before) and tail:  # a list number
        return False
    if e == i + 1 and nxt and (nxt in ",;:，；：-–" or (nxt.isdigit() and before[-1:].isdigit())):
        return False
    if first and first in ",;":
        return False
    new = bool(first) and (first.isupper() or first in "“‘„(«[「『" or (first.isalpha() and not first.islower()))
    w = _WORD_BEFORE.search(before)
    word = w[0] if w else ""
    low = word.lower()
    tight = before[: len(before) - len(word)] if word else before
    if word:
        spaced = re.search(r"\b([^\W\d_])\.\s$", tight)  # z. B., d. h.
        pair = (spaced[1].lower() + "." + low) if spaced else ""
        if low in rules["may_end"] or pair in rules["may_end"]:
            if not tail:
                return True
            return new or first.isdigit() or (first.islower() and re.match(r"\w+", tail)[0] not in rules["goes_on"] and e > i) if e == i + 1 else new
        if low in rules["never"] or pair in rules["never"]:
            return not tail
        if low in rules["number"] and (not tail or re.match(r"[\d०-९_“\"(]|[ivxlcm]+\b|[A-Z]\.?\d", tail)):
            return not tail
        letters = [c for c in word if not unicodedata.combining(c) and unicodedata.category(c) != "Mc"]
        if "." in word and all(len(x) == 1 for x in word.split(".")):
            return not tail
        if len(letters) == 1 and letters[0].isalpha() and not re.search(r"[㐀-鿿]", word):
            if re.search(r"\b(?:Mss?|Hs|Hss|Cod|Witness|Zeuge|Text)\.?\s+$", tight):  # a siglum may end a sentence
                return not tail or (nxt.isspace() and new and not re.match(r"[A-Z]\.", tail))
            return not tail
        if re.search("[ऀ-ॿ]", word) and len(letters) <= 2 and tail:
            return False
    elif before[-1:].isdigit():
        lead = re.search(r"([^\W\d_]+)\s+\d{1,2}$", before)
        if lead and lead[1].lower() in rules["ordinal"] and tail and lead[1] not in ("in",):
            return False
        if nxt and not nxt.isspace() and nxt.isalnum():
            return nxt.isupper()
    if not tail:
        return True
    if nxt.isspace():
        return True
    if e > i + 1:
        return True
    if nxt.isdigit():  # a note number, or a sentence that begins with a number
        return len(word) > 1
    return nxt in "“‘„([«「『" or (nxt.isalpha() and (nxt.isupper() or not nxt.islower()) and len(word) > 1)


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Half-open [start, end) code point positions of the sentences of ``text``."""
    if not text:
        return []
    shadow, at = [], []
    for i, ch in enumerate(text):
        c = _shadow[ord(ch)]
        if c:
            shadow.append(c)
            at.append(i)
    s = "".join(shadow)
    rules = _rules(languages(s))
    out = []
    p = 0
    for m in [*_PARAGRAPH.finditer(s), None]:
        q = m.start() if m else len(s)
        for a, b in _paragraph(s[p:q], rules):
            x = s[p + a : p + b]
            a += len(x) - len(x.lstrip())
            b -= len(x) - len(x.rstrip())
            if a < b:
                out.append((at[p + a], at[p + b - 1] + 1))
        p = m.end() if m else q
    return out


def sentence_spans(rows: DataFrame, kind: str, key: str, text: str) -> DataFrame:
    """(kind, key, start_pos, end_pos): one row per sentence, positions in the stored text.

    Null and empty texts, blanks and bare punctuation have no sentence.  Repeated
    rows count once, a null key is kept.  Extra columns are ignored.  Every
    distinct text is cut once; a text is never split over tasks, whatever its length.
    """
    from pyspark.sql.types import ArrayType, LongType, StructField, StructType

    kinds = ArrayType(StructType([StructField("start_pos", LongType()), StructField("end_pos", LongType())]))

    @F.pandas_udf(kinds)
    def cut(s: pd.Series) -> pd.Series:
        codes, values = pd.factorize(s, use_na_sentinel=True)
        made = [[{"start_pos": a, "end_pos": b} for a, b in sentences(v)] for v in values] + [[]]
        return pd.Series([made[c] for c in codes])

    return (
        rows.select(F.col(kind), F.col(key), F.col(text).alias("_t")).where("_t is not null").distinct()
        .select(kind, key, F.inline(cut("_t")))
        .distinct()
    )
