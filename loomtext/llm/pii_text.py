"""Plain characters for the tagger: one character for one, so positions stay."""

from __future__ import annotations

import unicodedata

import numpy as np

from loomtext.llm.lookalike import LOOKALIKES, _ignorable
from loomtext.llm.pii_model import code_points


#: Stands for every default-ignorable character.
HIDDEN = "\u200b"


class _Plain(dict):
    def __missing__(self, c: int) -> str:
        ch = chr(c)
        n = unicodedata.normalize("NFKC", ch)
        out = n if len(n) == 1 else ch
        out = LOOKALIKES.get(out, out)
        if c in _ignorable():
            out = HIDDEN
        elif out in "：，。（）；" or ch in "：，。（）；":
            out = ch
        elif unicodedata.category(out[0]) == "Nd":
            out = str(unicodedata.digit(out[0]))
        elif out.isspace() and out != "\n":
            out = " "
        self[c] = out
        return out


_plain = _Plain()


#: Plain code points of those seen so far; 0: not looked up yet.
_seen = np.zeros(0x110000, np.uint32)


def plain(text: str) -> str:
    """Full-width, look-alike and blank characters made plain; digits of all scripts as 0-9."""
    c = code_points(text)
    p = _seen[c]
    new = np.unique(c[p == 0]).tolist()
    if new:
        _seen[new] = [ord(_plain[u]) for u in new]
        p = _seen[c]
    return p.tobytes().decode("utf-32-le", "surrogatepass")
