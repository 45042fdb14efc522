"""Held-out test passages inside a training corpus, by spaced-seed hashing.

Both sides are cut into words (single characters for Han), folded so that case,
punctuation, line breaks and look-alike characters do not matter.  Fixed masks
over the word positions, some of them ignored, give seed hashes; equal seeds of
a document and an item propose a diagonal (document position minus item
position).  Along it, matches count for and exchanged words against a stretch;
the best one or two stretches decide.

The corpus is read once per block of items and nothing of it is shuffled but
the findings.  A block holds at most BLOCK_CHARS characters of items, so what is
sent to the executors is bounded; more items mean more blocks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.lookalike import canonical

#: Fixed masks; a 0 is a word position that is ignored.
MASKS = ("11011011011", "11101011101", "101110101111")
BLOCK_CHARS = 4_000_000
#: What an exchanged word costs a stretch, and the least score of a stretch.
EXCHANGE_COST, LEAST_SCORE = 4, 10
#: Items below this many words cannot hold half of themselves in stretches that the masks and the least
#: score see; they are searched by every run of two words, with a stretch of a quarter of their words.
SHORT, SHORT_MASKS = 24, ("11", "101")
#: Share of an item's words that its stretches must hold.
SHARE = 0.5
#: Characters of documents hashed at once.
BATCH_CHARS = 1_000_000
#: Seed hits expanded at once.
STEP = 1_000_000

_MARKS = "̀-ͯऀ-ःऺ-ॏ॑-ॗॢॣ"
_PLAIN = re.compile("[^\\x09-\\x7eāīūśṣṭṇḍĀĪŪŚṢṬṆḌäöüÄÖÜऀ-ॿ㐀-鿿，。；：、！？「」『』（）“”‘’„–—…]")
_TOKEN = re.compile(f"[㐀-鿿豈-﫿]|(?:[^\\W_㐀-鿿]|[{_MARKS}])+")


def words(text: str) -> list[str]:
    """Folded words of a text; every Han character is one word."""
    return _TOKEN.findall(canonical(text) if _PLAIN.search(text) else text.lower())


def _hashes(tokens: list[list[str]]) -> np.ndarray:
    """64-bit hashes of the words of all lists, one after another."""
    import xxhash

    vocab: dict[str, int] = {}
    n = sum(map(len, tokens))
    at = np.fromiter((vocab.setdefault(w, len(vocab)) for t in tokens for w in t), np.int64, n)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocab), np.uint64, len(vocab))
    return h[at] if n else np.zeros(0, np.uint64)


def _seeds(h: np.ndarray, mask: str) -> np.ndarray:
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for o, on in enumerate(mask):
        if on == "1":
            out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[o : o + n]
    return out


class Index:
    """Seeds of a block of items; items of any lengths lie one behind the other."""

    def __init__(self, texts: list[str]):
        tokens = [words(t) for t in texts]
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.flat = _hashes(tokens)
        self.first = np.concatenate(([0], np.cumsum(self.size)))
        self.least = np.where(self.size < SHORT, np.maximum(1, -(-self.size // 4)), LEAST_SCORE)
        self.tables = []
        item = np.repeat(np.arange(len(texts)), self.size)
        short = self.size[item] < SHORT
        for m in (*MASKS, *SHORT_MASKS):
            h = _seeds(self.flat, m)
            at = np.flatnonzero((item[: len(h)] == item[len(m) - 1 :]) & (short[: len(h)] == (m in SHORT_MASKS))) if len(h) else np.zeros(0, np.int64)
            at = at[np.argsort(h[at], kind="stable")]
            if len(at):
                self.tables.append((m, h[at], item[at], at - self.first[item[at]]))

    def find(self, texts: list[str]) -> list[tuple[int, int]]:
        """(text, item) numbers of the leaks."""
        tokens = [words(t) for t in texts]
        size = np.array([len(t) for t in tokens], np.int64)
        end = np.cumsum(size)
        x = _hashes(tokens)
        doc = np.repeat(np.arange(len(texts)), size)
        longest = int(self.size.max()) if len(self.size) else 0
        wide = len(x) + longest + 1
        seen = np.zeros(0, np.int64)
        for m, h, item, pos in self.tables:
            s = _seeds(x, m)
            if not len(s):
                continue
            a = np.searchsorted(h, s, "left")
            p = np.flatnonzero(h[np.minimum(a, len(h) - 1)] == s)
            r = np.searchsorted(h, s[p], "right") - a[p]
            ends = np.cumsum(r)
            lo = 0
            while lo < len(p):  # a formula that stands in many items is looked up in steps
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP, "right")))
                q, k = p[lo:hi], r[lo:hi]
                rep = np.repeat(q, k)
                at = np.repeat(a[q] - np.concatenate(([0], np.cumsum(k)[:-1])), k) + np.arange(len(rep))
                # The pair of text and item, and the diagonal, as one number.
                seen = np.union1d(seen, (doc[rep] * len(self.size) + item[at]) * wide + rep - pos[at] + longest)
                lo = hi
        pair, g = seen // wide, seen % wide - longest
        return self._verified(x, size, end, pair // len(self.size), pair % len(self.size), g) if len(seen) else []

    def _verified(self, x: np.ndarray, size: np.ndarray, end: np.ndarray, d: np.ndarray, i: np.ndarray, g: np.ndarray) -> list[tuple[int, int]]:
        """Of the diagonals (text, item, position) the pairs whose best stretches hold enough of the item."""
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        order = np.argsort(self.size[i], kind="stable")  # items of one length together, so that little is padded
        d, i, g = d[order], i[order], g[order]
        at = 0
        while at < len(d):
            to = at + max(1, 400_000 // int(self.size[i[at]]))
            to = min(len(d), at + max(1, 400_000 // int(self.size[i[min(to, len(d)) - 1]])))
            dk, ik, gk = d[at:to], i[at:to], g[at:to]
            width = int(self.size[ik].max())
            steps = np.arange(width)
            where = gk[:, None] + steps
            inside = (where >= (end - size)[dk][:, None]) & (where < end[dk][:, None]) & (steps < self.size[ik][:, None])
            own = self.flat[np.minimum(self.first[ik][:, None] + steps, len(self.flat) - 1)]
            match = inside & (x[np.clip(where, 0, len(x) - 1)] == own)
            c = np.zeros((len(dk), width + 1), np.int32)
            np.cumsum(np.where(match, np.int32(1), np.int32(-EXCHANGE_COST)), axis=1, out=c[:, 1:])
            top = (c - np.minimum.accumulate(c, axis=1)).max(axis=1)
            for q in np.flatnonzero(top >= self.least[ik]):
                n = int(self.size[ik[q]])
                found.setdefault((int(dk[q]), int(ik[q])), []).extend(stretches(match[q, :n], int(self.least[ik[q]])))
            at = to
        return [k for k, s in found.items() if covered(s, int(min(2, self.size[k[1]] // 8))) >= SHARE * self.size[k[1]]]


def stretches(match: np.ndarray, least: int = LEAST_SCORE) -> list[tuple[int, int]]:
    """Disjoint best-scoring stretches [start, end) of one diagonal."""
    out, todo = [], [(0, len(match))]
    while todo:
        a, b = todo.pop()
        if b - a < least:
            continue
        c = np.concatenate(([0], np.cumsum(np.where(match[a:b], 1, -EXCHANGE_COST))))
        gain = c - np.minimum.accumulate(c)
        j = int(gain.argmax())
        if gain[j] < least:
            continue
        i = int(c[: j + 1].argmin())
        out.append((a + i, a + j))
        todo += [(a, a + i), (a + j, b)]
    return out


def covered(s: list[tuple[int, int]], overlap: int = 2) -> int:
    """Most words that one stretch, or two that overlap by no more than ``overlap``, hold together."""
    s = sorted(set(s))
    best = max((b - a for a, b in s), default=0)
    # For two: prefix maximum over stretches that end before the other begins.
    ends = sorted(s, key=lambda t: t[1])
    k, left = 0, 0
    for a, b in s:
        while k < len(ends) and ends[k][1] <= a + overlap:
            left = max(left, ends[k][1] - ends[k][0])
            k += 1
        if left:
            best = max(best, left + b - a)
    return best


def _search(shared, ids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, keys = shared.value

        def flush(rows):
            hits = index.find([t for _, t in rows])
            return pa.record_batch(
                [pa.array([rows[a][0] for a, _ in hits], ids[0]), pa.array([keys[b] for _, b in hits], ids[1])], names=["doc", "item"])

        rows, chars = [], 0
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text:
                    rows.append((key, text))
                    chars += len(text)
                    if chars >= BATCH_CHARS:
                        yield flush(rows)
                        rows, chars = [], 0
        if rows:
            yield flush(rows)

    return run


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(doc_id, item_id): documents that hold at least half of an item in one or two stretches.

    Null and empty texts on either side leak nothing, nor does an item of a single
    word.  Items under SHORT words are searched exactly, by runs of two words.  Repeated rows count once.  Extra columns, also of the
    same names on both sides, are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    it = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).where("length(text) > 0").distinct()
    ids = to_arrow_type(d.schema["doc"].dataType), to_arrow_type(it.schema["item"].dataType)
    ddl = f"doc {d.schema['doc'].dataType.simpleString()}, item {it.schema['item'].dataType.simpleString()}"
    total = it.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_CHARS))
    parts = []
    for b in range(blocks):
        rows = it.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()
        shared = spark.sparkContext.broadcast((Index([r.text for r in rows]), [r.item for r in rows]))
        parts.append(d.mapInArrow(_search(shared, ids), ddl))
    return reduce(DataFrame.unionByName, parts).distinct().select(F.col("doc").alias(doc_id), F.col("item").alias(item_id))
