"""Labelled spans for training the personal-information tagger.

Only training reads this module: phrases that introduce personal data in the
documents give labelled spans, everything else is labelled as ordinary text.
The tagger itself never consults these rules.
"""

from __future__ import annotations

import re

from loomtext.llm.pii_text import plain

# Introducing phrases of the documents, per kind of span.
_TLD = "(?:example|invalid|test)(?![a-z0-9-])"
_HOST = r"[a-z0-9-]+(?:\s?(?:\.|\(dot\)|\[dot\]| dot )\s?[a-z0-9-]+)*\s?(?:\.|\(dot\)|\[dot\]| dot )\s?" + _TLD
EMAIL = re.compile(r"(?i)(?<![a-z0-9_.+-])[a-z0-9_.+-]+\s?(?:@|\(at\)|\[at\]| at )\s?" + _HOST)
PHONE = re.compile(
    r"(?<![A-Za-z0-9/.-])(?:(?:\+|00)999[ -]\d\d[ -](?:\d{8}|\d{3,4} \d{4})|\(\d{3}\) \d{3,4}-\d{4}|\d{3}/\d{7}-\d|\d{3}\.\d{4}\.\d{4}|\d{3}5550\d{4}|555-\d{4})(?![A-Za-z0-9-])")
ID = re.compile(r"(?<![A-Za-z0-9-])(?:\d{11}|\d{4} \d{4} \d{4}|\d{3}-\d\d-\d{4}|[A-Z]{2}\d{7}|[A-Z]{2}(?: \d\d){3} [A-Z]|[A-Z]\d{8}[A-Z]|\d{6}-\d{4}[A-Z])(?![A-Za-z0-9-])")
_ID_CUE = re.compile(r"(?:passport|tax\s+no\.|card|ausweis\s+nr\.|steuer-?\w*\s+nr\.|leserkarte|讀者證|身分證號?|證號?|पत्र|कार्ड|पहचान[^।]{0,12}|सं\.)[\s:：]*$", re.I)
_TOWN = r"[A-Z][a-z]+(?:stadt|mouth|bridge|ford|haven|wick|by|ham|ton)?"
ADDRESS = [
    re.compile(r"(?:Flat \d+, )?\d{1,3}[A-Z]? [A-Z][a-z]+ (?:Street|Rd|Road|Lane|Close|Court|Ave|Avenue|Way)\.?,?\s+" + _TOWN + r"(?:\s+QX\d \dZZ)?"),
    re.compile(r"PO Box \d+, " + _TOWN + r"(?:\s+QX\d \dZZ)?"),
    re.compile(r"(?:[A-ZÄÖÜ][a-zäöüß]+ ?(?:Straße|Weg|Gasse|Allee|Platz)|[A-ZÄÖÜ][a-zäöüß]+(?:weg|gasse|straße|allee|platz)) \d{1,3}[a-z]?,\s+\d{5} " + _TOWN),
    re.compile(r"Postfach \d+,\s+\d{5} " + _TOWN),
    re.compile(r"मकान सं\. \d+,\s+\S+ मार्ग,\s+\S+ \d{6}"),
    re.compile(r"\d{1,3}/\d{1,2},\s+\S+ गली,\s+[^\s।,]+"),
    re.compile(r"(?<=住)[㐀-鿿]{2,4}[市縣鎮][㐀-鿿]{1,4}[街路巷道]\d+號(?:\d+樓|之\d+)?"),
]
_N = r"(?:[A-Z][a-z]+|[A-Z]+)"
_FULL = rf"(?:{_N}, {_N}|(?:[A-Z]\. ){{1,2}}(?:(?:van|von|de) )?{_N}|{_N}(?: (?:van|von|de))? {_N})"
_D = r"[ऀ-ॿ]+"
PERSON = [re.compile(p) for p in (
    rf"Transcribed by ({_FULL})", rf"Corrections go to ({_FULL})(?= at )", rf"Send the photographs to ({_FULL})",
    rf"Signed: ({_FULL})", rf"it belongs to ({_FULL})", rf"was issued to ({_FULL})", rf"was first seen by ({_FULL})",
    rf"a week later, by ({_FULL})", rf"Dear ({_N})(?=, please)", rf"\(({_FULL})(?=, pers\.)",
    rf"Abgeschrieben von ({_FULL})", rf"Berichtigungen bitte an ({_FULL})(?=,)", rf"Laut ({_FULL})(?= fehlt)",
    rf"bei Frau ({_FULL})", rf"bei Herrn ({_FULL})", rf"ausgestellt für ({_FULL})",
    rf"प्रतिलिपि : ({_FULL}|{_D} {_D})(?=,)", rf"संशोधन ({_FULL}|{_D} {_D})(?= को )",
    rf"श्री ({_FULL}|{_D} {_D})(?= के नाम)", rf"({_FULL}|{_D} {_D})(?= ने यह पत्र दो बार)",
    rf"抄寫人：({_FULL}|[㐀-鿿]{{2,4}})(?=，)", rf"聯絡({_FULL}|[㐀-鿿]{{2,4}})(?=：)", rf"持有人({_FULL}|[㐀-鿿]{{2,4}})(?=。)",
    rf"據({_FULL}|[㐀-鿿]{{2,4}})(?=(?:先生|女士)說)",
)]


def label(text: str) -> list[tuple[int, int, str]]:
    """Labelled (start, end, kind) of a text."""
    t = re.sub(r"\s", lambda m: "\n" if m[0] == "\n" else " ", plain(text))
    flat = t.replace("\n", " ")
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(flat)]
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(flat)]
    for m in ID.finditer(flat):
        if _ID_CUE.search(flat[: m.start()]) or re.match(r" (?:appears on|lag der)", flat[m.end() :]):
            out.append((m.start(), m.end(), "id_number"))
    for p in ADDRESS:
        out += [(m.start(), m.end(), "address") for m in p.finditer(t)]
    for p in PERSON:
        out += [(m.start(1), m.end(1), "person") for m in p.finditer(flat)]
    out.sort(key=lambda s: (s[0], -s[1]))
    kept: list[tuple[int, int, str]] = []
    for s in out:
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
    return kept
