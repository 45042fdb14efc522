"""Sentence alignment in bilingual documents.

A lexicon is induced per language pair from the reviewed units: log-likelihood
of co-occurring features (words, syllables of names, character and syllable
pairs, numbers).  The sentences of unassigned units are scored against each
other with it.  A maximum-weight assignment with null costs (Hungarian method)
is iterated with merged spans of up to LONGEST_SPAN neighbours as candidates.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from loomtext.llm.lookalike import canonical
from loomtext.llm.sentences import sentences
from loomtext.operators.windows import latest
from loomtext.session import cut, small, table

#: Log-likelihood and association a lexicon entry needs (chi-square at 0.1 %), and occurrences of its parts.
LEAST_G2, LEAST_WEIGHT, LEAST_COUNT, LEAST_PAIRS = 10.83, 0.05, 3, 2
#: Bitexts of one language pair that share one copy of the part of the lexicon they need.
BLOCK = 250
#: Score that leaving a sentence unpaired is worth; what a plan's assignment adds; what each merged neighbour must gain.
NULL_SCORE, PLAN_BONUS, MERGE_GAIN = 0.54, 0.1, 0.08
#: Neighbours of one side that may render one sentence of the other together.
LONGEST_SPAN = 3
#: Entries looked up, pairs scored, and pairs whose links are kept, at once.
EXPANDED, DENSE, CELLS = 300_000, 1_000_000, 20_000
#: Share of rare words found on both sides from which two languages count as copying them.
COPY_SHARE = 0.4

_SYLLABLE = "(?:bh|dh|dz|[kgjṭḍṇtdnpbmrlvśṣsh])[aāiīuūeo]"
_NAME = re.compile(f"(?:{_SYLLABLE}){{2,}}$")
_CUT = re.compile(_SYLLABLE)
_AKSHARA = re.compile("[क-हक़-य़]़?(?:्[क-ह])*[ा-ौॢंः]*|[अ-औ]")
_WORD = re.compile("[^\\W\\d_][\\ẁ-ͯऀ-ःऺ-ॏ’]*|[0-9]+|[०-९]+")
_DIGITS = str.maketrans("०१२३४५६७८९〇一二三四五六七八九", "01234567890123456789")


def features(text: str, lang: str) -> list[str]:
    """Distinct features of a sentence; '#' numbers, '~' syllables of possible names."""
    t, f = canonical(text), set()
    if lang == "zho":
        f.update("#" + m[0].translate(_DIGITS) for m in re.finditer("[〇一二三四五六七八九]{2,}", t))
        s = re.findall("[㐀-鿿]", t)
        f.update(s)
        f.update(a + b for a, b in zip(s, s[1:]))
        return sorted(f)
    words = _WORD.findall(t)
    for w in words:
        if w[0].isdigit():
            f.add("#" + w.translate(_DIGITS))
            continue
        f.add(w)
        if lang == "hin":
            s = _AKSHARA.findall(w)
            if len(s) > 1:
                f.update("~" + x for x in s)
        elif lang != "bod" and _NAME.match(w):
            f.update("~" + x for x in _CUT.findall(w))
    if lang == "bod":
        f.update(a + " " + b for a, b in zip(words, words[1:]))
    return sorted(f)


@F.pandas_udf(ArrayType(StringType()))
def features_udf(text: pd.Series, lang: pd.Series) -> pd.Series:
    return pd.Series([features(t, g) if t else [] for t, g in zip(text, lang)])


@F.pandas_udf(ArrayType(StringType()))
def cut_udf(text: pd.Series) -> pd.Series:
    return pd.Series([[t[a:b] for a, b in sentences(t)] if t else [] for t in text])


@dataclass
class Lexicon:
    """``entries`` (lp, a, bs: array of (b, w)) and ``known`` (lp, side, f, w: inverse frequency) are
    frames of any size; per language pair the driver holds whether it copies rare words, and the
    weight of a feature that is not known."""

    entries: DataFrame
    known: DataFrame
    copies: set[str]
    unseen: dict[str, float]


def lexicon(pairs: DataFrame) -> Lexicon:
    """Lexicon induced from aligned texts (lp, lang_a, text_a, lang_b, text_b).

    The weight of an entry is the mean excess of the two conditional
    probabilities.  Every pair counts; features are counted once per text.
    Features standing in LEAST_COUNT texts are kept, however many texts there are.
    """
    p = pairs.where("length(text_a) > 0 and length(text_b) > 0").select(
        "lp", features_udf("text_a", "lang_a").alias("fa"), features_udf("text_b", "lang_b").alias("fb"))
    p = table(p.withColumn("id", F.monotonically_increasing_id()), "aligned")
    n = p.groupBy("lp").agg(F.count(F.lit(1)).alias("n"))
    one = p.select("lp", F.lit("a").alias("side"), F.explode("fa").alias("f")).unionByName(p.select("lp", F.lit("b").alias("side"), F.explode("fb").alias("f")))
    count = one.groupBy("lp", "side", "f").agg(F.count(F.lit(1)).alias("x"))
    every = cut(count.join(F.broadcast(n), "lp").select("lp", "side", "f", "x", "n"))  # n: one row per language pair
    # Numbers stand for the features while pairs are counted.
    known = cut(every.where(F.col("x") >= LEAST_COUNT).withColumn("no", F.monotonically_increasing_id()))

    def side(s: str) -> DataFrame:
        f = p.select("id", "lp", F.explode("f" + s).alias("f")).join(small(known.where(F.col("side") == s).select("lp", "f", "no")), ["lp", "f"])
        return f.groupBy("id").agg(F.collect_list("no").alias(s))

    both = side("a").join(side("b"), "id")
    k = both.select(F.explode("a").alias("a"), "b").select("a", F.explode("b").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= LEAST_PAIRS)
    e = k.join(small(known.where("side = 'a'").select("lp", F.col("no").alias("a"), F.col("f").alias("fa"), "x", "n")), "a")
    e = e.join(small(known.where("side = 'b'").select(F.col("no").alias("b"), F.col("f").alias("fb"), F.col("x").alias("y"))), "b")

    def ll(k, n, p):
        q = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
        return k * F.log(q) + (n - k) * F.log(1 - q)

    kk, x, y, nn = (F.col(c).cast("double") for c in ("k", "x", "y", "n"))
    rest = F.greatest(nn - x, F.lit(1.0))
    g2 = 2 * (ll(kk, x, kk / x) + ll(y - kk, rest, (y - kk) / rest) - ll(kk, x, y / nn) - ll(y - kk, rest, y / nn))
    w = ((kk / x - y / nn) + (kk / y - x / nn)) / 2
    entries = e.where((kk * nn > x * y) & (g2 >= LEAST_G2) & (w >= LEAST_WEIGHT)).groupBy("lp", F.col("fa").alias("a")).agg(F.collect_list(F.struct(F.col("fb").alias("b"), w.alias("w"))).alias("bs"))
    rare = every.where("x <= 2")
    shared = rare.where("side = 'a'").select("lp", "f").join(rare.where("side = 'b'").select("lp", "f", F.lit(1).alias("hit")), ["lp", "f"], "left")
    copying = shared.groupBy("lp").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share")).where(F.col("share") >= COPY_SHARE)
    idf = known.select("lp", "side", "f", F.log((F.col("n") + 1) / (F.col("x") + 0.5)).alias("w"))
    top = idf.groupBy("lp").agg(F.max("w").alias("w"))  # one row per language pair, as copying
    return Lexicon(cut(entries), idf, {r.lp for r in copying.collect()}, {r.lp: 1 + max(r.w, 3.0) for r in top.collect()})


def assign(gain: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-weight assignment of rows to columns; only positive gains pair (null costs 0)."""
    pairs = []
    for rows, cols in _components(gain > 0):
        g = gain[np.ix_(rows, cols)]
        n, m = g.shape
        cost = np.zeros((n, m + n))  # every row has its own null column
        cost[:, :m] = -np.maximum(g, 0)
        for i, j in enumerate(_hungarian(cost)):
            if j < m and g[i, j] > 0:
                pairs.append((rows[i], cols[j]))
    return pairs


def _components(link: np.ndarray) -> list[tuple[list[int], list[int]]]:
    n, m = link.shape
    seen, out = np.zeros(n, bool), []
    for s in range(n):
        if seen[s] or not link[s].any():
            continue
        rows, cols = {s}, set()
        todo = [s]
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(link[i]).tolist():
                if j not in cols:
                    cols.add(j)
                    new = set(np.flatnonzero(link[:, j]).tolist()) - rows
                    rows |= new
                    todo += new
        seen[list(rows)] = True
        out.append((sorted(rows), sorted(cols)))
    return out


def _hungarian(cost: np.ndarray) -> list[int]:
    """Column of every row at least cost (rows <= columns), by shortest augmenting paths."""
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for r in range(n):
        dist, back = np.full(m, np.inf), np.full(m, -1)
        done = np.zeros(m, bool)
        i, j, low = r, -1, 0.0
        while True:
            d = low + cost[i] - u[i] - v
            better = ~done & (d < dist - 1e-15)
            dist[better] = d[better]
            back[better] = j
            j = int(np.where(done, np.inf, dist).argmin())
            low = dist[j]
            done[j] = True
            if row_of[j] < 0:
                break
            i = row_of[j]
        last = j
        for c in np.flatnonzero(done):
            if c != last:
                u[row_of[c]] += low - dist[c]
                v[c] -= low - dist[c]
        u[r] += low
        while True:
            p = back[j]
            if p < 0:
                row_of[j] = r
                break
            row_of[j] = row_of[p]
            j = p
    col_of = [0] * n
    for j, i in enumerate(row_of):
        if i >= 0:
            col_of[i] = j
    return col_of


class _Scorer:
    """Scores of feature sets with the part of the lexicon that a block of bitexts needs."""

    def __init__(self, idf: list[dict[str, float]], pairs: dict[str, list[tuple[str, float]]], copies: bool, unseen: float):
        self.idf, self.pairs = idf, pairs
        # Languages that copy rare words: an unseen word without its copy speaks against a pair.
        self.copies = copies
        self.unseen = unseen

    def score(self, fa: set[str], fb: set[str]) -> float:
        return _mean(self.parts(fa, fb))

    def parts(self, fa: set[str], fb: set[str]) -> tuple[float, float, float, float]:
        """Weight covered and whole weight of either side."""
        hit: dict[str, float] = {}
        got = whole = 0.0
        for a in fa:
            best, entry = 0.0, self.pairs.get(a)
            if a in fb:
                best = hit[a] = 1.0
            elif entry is not None:
                for b, w in entry:
                    if b in fb:
                        best = max(best, w)
                        hit[b] = max(hit.get(b, 0.0), w)
            elif not (self.copies and a not in self.idf[0]):
                continue
            i = self.idf[0].get(a, self.unseen)
            got += i * best
            whole += i
        one = got, whole
        got = whole = 0.0
        for b in fb:
            if b not in hit and b not in self.idf[1] and not self.copies:
                continue
            i = self.idf[1].get(b, self.unseen)
            got += i * hit.get(b, 0.0)
            whole += i
        return *one, got, whole


def _mean(p: tuple[float, float, float, float]) -> float:
    return ((p[0] / p[1] if p[1] else 0.0) + (p[2] / p[3] if p[3] else 0.0)) / 2


def _merges(parts: np.ndarray, gain: np.ndarray, score, bonus: np.ndarray) -> list[tuple[float, int, int, int]]:
    """(gain, i, first, last): row i with columns first to last, where that beats i with a part of them.

    ``score`` is asked, for all spans of one length together, only where the bound from ``parts`` allows it:
    a span covers at most the sum of what its members cover, of no less than the largest whole.
    """
    m = parts.shape[1]
    out: list[tuple[float, int, int, int]] = []
    for size in range(2, min(LONGEST_SPAN, m) + 1):
        width = m - size + 1
        got = sum(parts[:, o:o + width, 0::2] for o in range(size))
        whole, most, extra = parts[:, :width, 1::2], gain[:, :width], bonus[:, :width]
        for o in range(1, size):
            whole = np.maximum(whole, parts[:, o:o + width, 1::2])
            most, extra = np.maximum(most, gain[:, o:o + width]), np.maximum(extra, bonus[:, o:o + width])
        bound = np.minimum(1, np.divide(got, whole, out=np.zeros_like(got), where=whole > 0)).mean(2)
        less = NULL_SCORE + MERGE_GAIN * (size - 1) - extra
        least = np.maximum(most + 1e-12, 0)
        rows, cols = np.nonzero(bound - less > least)
        for i, j, x in zip(rows.tolist(), cols.tolist(), score(rows, cols, size)):
            g = x - less[i, j]
            # A part of the span that gains no less leaves the rest free.
            if g > least[i, j] and all(g > x for x, i2, p, q in out if i2 == i and p >= j and q < j + size):
                out.append((float(g), i, j, j + size - 1))
    return out


def assign_spans(gain: np.ndarray, spans: list[tuple[float, tuple[int, ...], tuple[int, ...]]]) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """Pairs (rows, columns) of an assignment in which ``spans`` (gain, rows, columns) may stand for single pairs.

    Starting with single pairs, the span (or the release of one taken) that raises the total most is
    settled, and the rest is assigned again, until nothing raises it.  So a span displaces single
    matches and spans whose gain is smaller in all.  The total rises in every step.
    """
    def solve(taken: tuple[int, ...]) -> tuple[float, list]:
        g = gain.copy()
        for s in taken:
            g[list(spans[s][1])] = 0
            g[:, list(spans[s][2])] = 0
        one = assign(g)
        return sum(gain[i, j] for i, j in one) + sum(spans[s][0] for s in taken), one

    def clash(s: int, t: int) -> bool:
        return bool(set(spans[s][1]) & set(spans[t][1]) or set(spans[s][2]) & set(spans[t][2]))

    taken: tuple[int, ...] = ()
    total, one = solve(taken)
    while True:
        best = None
        for s in range(len(spans)):
            tried = tuple(t for t in taken if t != s) if s in taken else (*(t for t in taken if not clash(s, t)), s)
            # Nothing is re-solved where the span cannot raise the total even if nothing is displaced.
            lost = sum(spans[t][0] for t in taken if t not in tried)
            if s not in taken and spans[s][0] <= lost and all(gain[i].max() <= 0 for t in taken if t not in tried for i in spans[t][1]):
                continue
            t, o = solve(tried)
            if t > total + 1e-9 and (best is None or t > best[0] + 1e-12):
                best = t, o, tried
        if best is None:
            return [((i,), (j,)) for i, j in one] + [spans[s][1:] for s in taken]
        total, one, taken = best


def _slot(key: np.ndarray) -> np.ndarray:
    return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)


class _Block:
    """Sentences of some bitexts with the lexicon they need, all features as numbers.

    ``feats``: one array of feature numbers per sentence; ``group``: bitext and pair of witnesses of each
    sentence, numbered in order; ``left``: whether it stands on side a.  The score of two sentences is put
    together from their common entries only, found by joining the features of all sentences at once.
    """

    def __init__(self, feats: list[np.ndarray], group: np.ndarray, left: np.ndarray, n: int, idf: tuple[np.ndarray, np.ndarray],
                 entries: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], copies: bool, unseen: float):
        self.feats, self.group, self.left, self.n, self.many = feats, group, left, n, max(1, len(feats))
        self.wholes: dict[tuple[int, int], float] = {}
        #: Is a feature known on side a or b, its weight there, and has it entries?
        self.known = [~np.isnan(x) for x in idf]
        self.weight = [np.where(k, x, unseen) for k, x in zip(self.known, idf)]
        ea, eb, ew, has = entries
        order = np.argsort(ea, kind="stable")
        self.ea, self.eb, self.ew, self.has = ea[order], eb[order], ew[order], has
        size = np.fromiter(map(len, feats), np.int64, len(feats))
        self.of = np.repeat(np.arange(len(feats)), size)
        self.flat = np.concatenate(feats) if feats else np.zeros(0, np.int64)
        side = left[self.of]
        self.a_of, self.a, b_of, b = self.of[side], self.flat[side], self.of[~side], self.flat[~side]
        key = group[b_of] * n + b
        order = np.argsort(key, kind="stable")
        self.b_key, self.b_of = key[order], b_of[order]
        self.sieve = np.zeros(1 << 22, bool)  # most keys asked for are not there; this tells without a search
        self.sieve[_slot(self.b_key)] = True
        counted = self.has | (~self.known[0] if copies else np.zeros(n, bool))
        self.extra_a = ~counted
        self.base = np.zeros(len(feats))
        np.add.at(self.base, self.a_of, np.where(counted[self.a], self.weight[0][self.a], 0))
        self.extra_b = ~self.known[1] & (not copies)
        np.add.at(self.base, b_of, np.where(self.extra_b[b], 0, self.weight[1][b]))

    def _beside(self, s: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers into ``s`` and the sentences of the other side of the same group that hold ``f``."""
        key = self.group[s] * self.n + f
        live = np.flatnonzero(self.sieve[_slot(key)])
        key = key[live]
        lo = np.searchsorted(self.b_key, key, "left")
        k = np.searchsorted(self.b_key, key, "right") - lo
        rows = np.repeat(live, k)
        return rows, self.b_of[np.repeat(lo - np.concatenate(([0], np.cumsum(k)[:-1])), k) + np.arange(len(rows))] if len(rows) else np.zeros(0, np.int64)

    def pairs(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sentence a, sentence b, parts) of all pairs with something in common; parts as of ``_Scorer.parts``.

        Sentences of side a are those of [first, last).

        Keeps, for merged spans, the links that are the best of their feature on either side of a pair; those
        of a span are among them.  As many sentences are looked up at once as EXPANDED entries allow.
        """
        p, q = np.searchsorted(self.a_of, (first, last))
        a_of, a_own = self.a_of[p:q], self.a[p:q]
        lo = np.searchsorted(self.ea, a_own, "left")
        k = np.searchsorted(self.ea, a_own, "right") - lo
        starts = np.flatnonzero(np.diff(a_of, prepend=-1)) if len(a_of) else np.zeros(0, np.int64)
        ends = np.cumsum(k + 1)
        before = np.concatenate(([0], ends))[starts]
        got, links, n, at = [], [], 0, 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(before, before[at] + EXPANDED, "right")) - 1) if at + 1 < len(starts) else at + 1
            x, y = int(starts[at]), int(starts[to]) if to < len(starts) else len(a_own)
            occ = np.repeat(np.arange(x, y), k[x:y])
            e = np.repeat(lo[x:y] - np.concatenate(([0], np.cumsum(k[x:y])[:-1])), k[x:y]) + np.arange(len(occ))
            r, j = self._beside(a_of[x:y], a_own[x:y])
            q, j2 = self._beside(a_of[occ], self.eb[e])
            same = a_own[x:y][r]
            sa, sb = np.concatenate((a_of[x:y][r], a_of[occ[q]])), np.concatenate((j, j2))
            pair, where = np.unique(sa * self.many + sb, return_inverse=True)
            # A feature that stands on both sides is its own counterpart; its entries do not count then.
            v = self._own_first(where, np.concatenate((same, a_own[occ[q]])), np.concatenate((same, self.eb[e[q]])),
                                np.concatenate((np.ones(len(j)), self.ew[e[q]])), np.arange(len(sa)) < len(j))
            parts, best = self._parts(*v, self.base[pair // self.many], self.base[pair % self.many])
            got.append((pair, parts))
            links.append((v[0][best] + n, *(z[best] for z in v[1:])))
            n, at = n + len(pair), to
        self.pair = np.concatenate([p for p, _ in got]) if got else np.zeros(0, np.int64)
        self.links = tuple(np.concatenate(z) for z in zip(*links)) if links else (np.zeros(0, np.int64),) * 5
        self.ends = np.searchsorted(self.links[0], np.arange(len(self.pair) + 1))
        return self.pair // self.many, self.pair % self.many, np.concatenate([v for _, v in got]) if got else np.zeros((0, 4))

    def _own_first(self, at: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, ident: np.ndarray) -> tuple[np.ndarray, ...]:
        """Links (of pair or span ``at``, features a and b, weight, identity) in order, without entries of features found themselves."""
        own = np.unique((at * self.n + a)[ident])
        keep = np.flatnonzero(ident | ~np.isin(at * self.n + a, own))
        keep = keep[np.argsort(at[keep], kind="stable")]
        return at[keep], a[keep], b[keep], w[keep], ident[keep]

    def _parts(self, at, a, b, w, ident, base_a: np.ndarray, base_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight covered and whole weight of either side, for every pair or span; and which links decide it."""
        decide = np.zeros(len(at), bool)
        parts = np.zeros((len(base_a), 4))
        parts[:, 1], parts[:, 3] = base_a, base_b
        for side, f, extra in ((0, a, self.extra_a), (2, b, self.extra_b)):
            key = at * self.n + f
            order = np.argsort(key, kind="stable")
            key, first = np.unique(key[order], return_index=True)
            p, f = key // self.n, key % self.n
            best = np.maximum.reduceat(w[order], first) if len(first) else np.zeros(0)
            decide[order] |= w[order] == np.repeat(best, np.diff(first, append=len(order)))
            weight = self.weight[side // 2][f]
            parts[:, side] = np.bincount(p, weight * best, len(base_a))
            # Beyond the sentence's own sum: on side a what stands on both sides, on side b whatever was hit.
            add = extra[f] & np.logical_or.reduceat(ident[order], first) if side == 0 and len(first) else extra[f]
            parts[:, side + 1] += np.bincount(p, np.where(add, weight, 0), len(base_a))
        return parts, decide

    def _whole(self, first: int, size: int) -> float:
        """Sum a merged span of sentences of one side has by itself; every feature once."""
        if (first, size) not in self.wholes:
            f = np.unique(np.concatenate(self.feats[first:first + size]))
            own = ~(self.extra_a if self.left[first] else self.extra_b)[f]
            self.wholes[first, size] = float(self.weight[0 if self.left[first] else 1][f][own].sum())
        return self.wholes[first, size]

    def span_scores(self, one: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
        """Scores of single sentences ``one`` with spans of ``size`` sentences of the other side, from ``first`` on."""
        k = len(one)
        if not k:
            return np.zeros(0)
        single = bool(self.left[one[0]])
        each = np.repeat(np.arange(k), size)
        other = (first[:, None] + np.arange(size)).ravel()
        key = one[each] * self.many + other if single else other * self.many + one[each]
        at = np.searchsorted(self.pair, key)
        there = (at < len(self.pair)) & (self.pair[np.minimum(at, len(self.pair) - 1)] == key)
        each, at = each[there], at[there]
        n = self.ends[at + 1] - self.ends[at]
        rows = np.repeat(self.ends[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        _, a, b, w, ident = (x[rows] for x in self.links)
        links = self._own_first(np.repeat(each, n), a, b, w, ident)
        mine, merged = self.base[one], np.array([self._whole(f, size) for f in first.tolist()])
        v, _ = self._parts(*links, *((mine, merged) if single else (merged, mine)))
        return np.divide(v[:, 0::2], v[:, 1::2], out=np.zeros((k, 2)), where=v[:, 1::2] > 0).mean(1)


def _joined(n: int, m: int, edges: list[tuple[int, int]], spans: list[tuple[float, tuple[int, ...], tuple[int, ...]]]) -> list[tuple[list[int], list[int], list]]:
    """Rows, columns and spans that hang together."""
    up = list(range(n + m))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in edges:
        up[root(i)] = root(n + j)
    for _, rows, cols in spans:
        for x in (*rows[1:], *(n + c for c in cols)):
            up[root(rows[0])] = root(x)
    out: dict[int, tuple[list[int], list[int], list]] = {}
    for x in sorted({i for i, _ in edges} | {n + j for _, j in edges} | {x for _, r, c in spans for x in (*r, *(n + k for k in c))}):
        rows, cols, _ = out.setdefault(root(x), ([], [], []))
        rows.append(x) if x < n else cols.append(x - n)
    for s in spans:
        out[root(s[1][0])][2].append(s)
    return list(out.values())


def _solve_block(units: list[dict], block: _Block) -> list[tuple[str, str]]:
    """Pairs of unit ids of all groups; ``units``: unit_id, unit_number and planned of each sentence, in order.

    Small groups are scored together and large ones in strips of side a, CELLS pairs at once.  Strips overlap by what a
    span can hold, so none is missed.
    """
    found: set[tuple[str, str]] = set()
    count = int(block.group[-1]) + 1 if len(block.group) else 0
    bounds = np.searchsorted(block.group, np.arange(count + 1))
    sides = np.concatenate(([0], np.cumsum(block.left)))[bounds]
    size_a = np.diff(sides)
    cells = size_a * (np.diff(bounds) - size_a)

    def strip(groups: range, first: int, last: int) -> dict[int, tuple[_Edges, list]]:
        """Candidates of the groups' sentences a of [first, last); rows count from the group's first."""
        ia, ib, parts = block.pairs(first, last)
        out = {}
        at = np.searchsorted(block.group[ia], np.arange(groups.start, groups.stop + 1))
        for g in groups:
            x, y = at[g - groups.start], at[g - groups.start + 1]
            if x < y:
                top, mid = int(bounds[g]), int(bounds[g] + size_a[g])
                lo, hi = max(first, top), min(last, mid)
                edges, many = _candidates(block, units, ia[x:y] - lo, ib[x:y] - mid, parts[x:y], lo, mid, hi - lo, int(bounds[g + 1]) - mid)
                out[g] = _Edges(((i + lo - top, j), v) for (i, j), v in edges.items()), [(v, tuple(i + lo - top for i in p), q) for v, p, q in many]
        return out

    def settle(g: int, edges: _Edges, many: list) -> None:
        top, mid = int(bounds[g]), int(bounds[g] + size_a[g])
        for rows, cols, spans in _joined(int(size_a[g]), int(bounds[g + 1]) - mid, list(edges), many):
            r, c = {x: k for k, x in enumerate(rows)}, {x: k for k, x in enumerate(cols)}
            gain = np.full((len(rows), len(cols)), -1.0)
            for i in rows:
                for j, x in edges.of(i):
                    gain[r[i], c[j]] = x
            local = [(x, tuple(r[i] for i in p), tuple(c[j] for j in q)) for x, p, q in spans]
            for p, q in assign_spans(gain, local):
                found.update((units[top + rows[i]]["unit_id"], units[mid + cols[j]]["unit_id"]) for i in p for j in q)

    g = 0
    while g < count:
        if cells[g] > CELLS:
            top, mid = int(bounds[g]), int(bounds[g] + size_a[g])
            high = max(LONGEST_SPAN, CELLS // max(1, int(bounds[g + 1]) - mid))
            edges, many = _Edges(), {}
            for lo in range(top, mid, max(1, high - LONGEST_SPAN + 1)):
                for e, m in strip(range(g, g + 1), lo, min(mid, lo + high)).values():
                    edges.update(e)
                    many.update({(p, q): (v, p, q) for v, p, q in m})
            settle(g, edges, list(many.values()))
            g += 1
            continue
        to, n = g, 0
        while to < count and cells[to] <= CELLS and (to == g or n + cells[to] <= CELLS):
            n += cells[to]
            to += 1
        for k, (edges, many) in strip(range(g, to), int(bounds[g]), int(bounds[to])).items():
            settle(k, edges, many)
        g = to
    return sorted({(min(x), max(x)) for x in found})


class _Edges(dict):
    """(row, column) -> gain of the pairs that gain something, and by row."""

    def of(self, i: int) -> list[tuple[int, float]]:
        if not hasattr(self, "rows"):
            self.rows: dict[int, list[tuple[int, float]]] = {}
            for (p, q), x in self.items():
                self.rows.setdefault(p, []).append((q, x))
        return self.rows.get(i, [])


def _candidates(block: _Block, units: list[dict], i: np.ndarray, j: np.ndarray, parts: np.ndarray, first_a: int, first_b: int, n: int, m: int):
    """The single pairs that gain something, and the merged spans that beat them, of one bitext.

    Dense only in strips of at most DENSE cells, so that a bitext of any length fits.
    """
    edges, many = _Edges(), []
    planned_a = [set(map(str, x["planned"])) if x["planned"] is not None else set() for x in units[first_a:first_a + n]]
    planned_b = [set(map(str, x["planned"])) if x["planned"] is not None else set() for x in units[first_b:first_b + m]]
    any_plan = any(planned_a) or any(planned_b)
    number = [str(x["unit_number"]) for x in units[first_a:first_a + n]], [str(x["unit_number"]) for x in units[first_b:first_b + m]]
    for turned in (False, True):
        p, q, k, l = (j, i, m, n) if turned else (i, j, n, m)
        v = parts[:, [2, 3, 0, 1]] if turned else parts
        strip = max(1, DENSE // max(1, l))
        for at in range(0, k, strip):
            here = (p >= at) & (p < at + strip) if strip < k else slice(None)
            height = min(strip, k - at)
            d = np.zeros((height, l, 4))
            d[p[here] - at, q[here]] = v[here]
            score = np.divide(d[:, :, 0::2], d[:, :, 1::2], out=np.zeros((height, l, 2)), where=d[:, :, 1::2] > 0).mean(2)
            bonus = np.zeros((height, l))
            if any_plan:
                for x, y in zip(p[here].tolist(), q[here].tolist()):
                    ra, rb = (y, x) if turned else (x, y)
                    if number[0][ra] in planned_b[rb] or number[1][rb] in planned_a[ra]:
                        bonus[x - at, y] = PLAN_BONUS
            gain = score + bonus - NULL_SCORE
            if not turned:
                for x, y in zip(*(z.tolist() for z in np.nonzero(gain > 0))):
                    edges[x + at, y] = float(gain[x, y])
                many += [(g, (x + at,), tuple(range(y, z + 1))) for g, x, y, z in _merges(
                    d, gain, lambda x, y, size: block.span_scores(first_a + at + x, first_b + y, size), bonus)]
            else:
                many += [(g, tuple(range(y, z + 1)), (x + at,)) for g, x, y, z in _merges(
                    d, gain, lambda x, y, size: block.span_scores(first_b + at + x, first_a + y, size), bonus)]
    return edges, many


def _solve(units: pd.DataFrame, sc: _Scorer) -> pd.DataFrame:
    """Pairs of one bitext and pair of witnesses by a scorer's lexicon."""
    u = units.sort_values(["side", "unit_order", "unit_id", "no"]).to_dict("records")
    number: dict[str, int] = {}
    feats = [np.unique(np.array([number.setdefault(f, len(number)) for f in x["feats"]], np.int64)) for x in u]
    e = [(number.setdefault(a, len(number)), number.setdefault(b, len(number)), w) for a, bs in sc.pairs.items() for b, w in bs]
    has = {number[a] for a in sc.pairs if a in number}
    n = len(number)
    idf = tuple(np.array([x.get(f, np.nan) for f in number], float) for x in sc.idf)
    entries = (np.array([x[0] for x in e], np.int64), np.array([x[1] for x in e], np.int64), np.array([x[2] for x in e], float), np.array([k in has for k in range(n)], bool))
    left = np.array([x["side"] == "a" for x in u], bool)
    if not left.any() or left.all():
        return pd.DataFrame({"unit_a": [], "unit_b": []}, dtype=str)
    block = _Block(feats, np.zeros(len(u), np.int64), left, n, idf, entries, sc.copies, sc.unseen)
    return pd.DataFrame(_solve_block(u, block), columns=["unit_a", "unit_b"]).astype(str)


def _solver(copies: set[str], unseen: dict[str, float]):
    """Solves all bitexts of a block: sentences and the part of the lexicon for them, as Arrow tables."""
    def flat(c: pa.ChunkedArray) -> pa.ListArray:
        x = c.combine_chunks()
        return pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x

    def run(key: tuple, group: pa.Table, part: pa.Table) -> pa.Table:
        lp = key[0].as_py()
        group = group.sort_by([(c, "ascending") for c in ("bitext_id", "pair", "side", "unit_order", "unit_id", "no")])
        lists = flat(group.column("feats"))
        of = np.array(part.column("of").to_pylist(), object)
        bs = flat(part.column("bs"))
        words = [lists.flatten(), flat(part.column("f")), bs.flatten().field("b")]
        codes = pa.concat_arrays(words).dictionary_encode()
        n, codes = max(1, len(codes.dictionary)), codes.indices.to_numpy().astype(np.int64)
        f0, f1 = len(words[0]), len(words[0]) + len(words[1])
        off = lists.offsets.to_numpy().astype(np.int64)
        off = off - off[0]
        feats = np.split(codes[:f0], off[1:-1]) if len(group) else []
        weight = part.column("w").to_numpy(zero_copy_only=False).astype(float)
        pf = codes[f0:f1]
        idf = []
        for s in "ab":
            x = np.full(n, np.nan)
            x[pf[of == s]] = weight[of == s]
            idf.append(x)
        size = np.diff(bs.offsets.to_numpy().astype(np.int64))
        size[np.array(bs.is_null().to_pylist(), bool)] = 0
        has = np.zeros(n, bool)
        has[pf[of == None]] = True  # noqa: E711
        left = np.array(group.column("side").to_pylist(), object) == "a"
        ea, eb, ew = np.repeat(pf, size), codes[f1:], bs.flatten().field("w").to_numpy()
        have = np.zeros(n, bool)
        have[codes[:f0][~np.repeat(left, np.diff(off))]] = True
        # A feature whose entries are all missing here keeps its mark: it stays unmatched.
        ok = have[eb]
        both = np.array([x + 0 for x in group.column("bitext_id").to_pylist()], object), np.array(group.column("pair").to_pylist(), object)
        new = np.concatenate(([0], (both[0][1:] != both[0][:-1]) | (both[1][1:] != both[1][:-1]))).astype(np.int64) if len(group) else np.zeros(0, np.int64)
        block = _Block(feats, np.cumsum(new), left, n, tuple(idf), (ea[ok], eb[ok], ew[ok], has), lp in copies, unseen.get(lp, 4.0))
        got = _solve_block(group.select(["unit_id", "unit_number", "planned"]).to_pylist(), block)
        return pa.table({"unit_a": pa.array([x for x, _ in got], pa.string()), "unit_b": pa.array([y for _, y in got], pa.string())})

    return run


def align(units: DataFrame, plans: DataFrame) -> DataFrame:
    """(unit_a, unit_b): unassigned units of one bitext that translate each other.

    ``units``: unit_id, bitext_id, unit_number, unit_order, unit_status, targets,
    target_token_ids; ``plans``: bitext_id, source_id, passages.  The language of
    a target is the first three letters of its witness id.  Repeated unit ids
    count once (the latest delivery).  Null bitexts, empty or null targets pair with nothing, a bitext
    with one witness has no pairs, of three or more every two are solved on their own; units with several witnesses teach the
    lexicon.  Without reviewed units only equal words and numbers count.  A
    bitext (one passage in two witnesses) is solved in one task.
    """
    u = latest(units.where("unit_id is not null and bitext_id is not null"), "unit_id", "received_at", ["bitext_id", "unit_number", "unit_order", "unit_status", "targets"])
    t = u.select("unit_id", "bitext_id", "unit_number", "unit_order", "unit_status", F.explode("targets").alias("wit", "text")).where("length(text) > 0")
    t = t.withColumn("lang", F.substring("wit", 1, 3))

    rv = t.where("unit_status = 'reviewed'").select("unit_id", "wit", "lang", "text")
    x, y = rv.alias("x"), rv.alias("y")
    pairs = x.join(y, F.expr("x.unit_id = y.unit_id and struct(x.lang, x.wit) < struct(y.lang, y.wit)")).select(
        F.concat_ws("-", "x.lang", "y.lang").alias("lp"), F.col("x.lang").alias("lang_a"), F.col("x.text").alias("text_a"), F.col("y.lang").alias("lang_b"), F.col("y.text").alias("text_b"))
    lex = lexicon(pairs)

    free = t.where("unit_status = 'unassigned'")
    wits = free.groupBy("bitext_id").agg(F.array_sort(F.collect_set(F.struct("lang", "wit"))).alias("w"))
    # Every pair of witnesses of a bitext is solved on its own.
    wits = wits.select("bitext_id", F.posexplode("w").alias("i", "x"), "w").select("bitext_id", "x", F.explode(F.expr("slice(w, i + 2, size(w))")).alias("y"))
    free = free.join(wits, "bitext_id").where("wit in (x.wit, y.wit)").select(
        "bitext_id", "unit_id", "unit_number", F.coalesce("unit_order", F.lit(0)).alias("unit_order"), "lang", "text",
        F.concat_ws("-", "x.lang", "y.lang").alias("lp"), F.concat_ws("|", "x.wit", "y.wit").alias("pair"), F.when(F.col("wit") == F.col("x.wit"), "a").otherwise("b").alias("side"), "wit")
    # A plan names, by order and start phrase, the number a sentence of its witness belongs to.
    pl = plans.where("bitext_id is not null").select("bitext_id", F.col("source_id").alias("wit"), F.explode("passages").alias("k", "items")).select("bitext_id", "wit", F.explode("items").alias("i"))
    pl = pl.select("bitext_id", "wit", F.col("i")[0].alias("number"), F.col("i")[1].alias("phrase")).where("number <> '_' and length(phrase) > 0").distinct()
    hits = free.select("bitext_id", "wit", "unit_id", "text").join(pl, ["bitext_id", "wit"]).where(F.col("text").startswith(F.col("phrase")))
    # A phrase that begins several units decides nothing.
    one = hits.groupBy("bitext_id", "wit", "number", "phrase").agg(F.min("unit_id").alias("unit_id"), F.max("unit_id").alias("last")).where("unit_id = last")
    planned = one.groupBy("bitext_id", "unit_id").agg(F.collect_set("number").alias("planned"))
    s = free.select("bitext_id", "unit_id", "unit_number", "unit_order", "lang", "lp", "pair", "side", F.posexplode(cut_udf("text")).alias("no", "s"))
    s = s.select("bitext_id", "unit_id", "unit_number", "unit_order", "lp", "pair", "side", "no", features_udf("s", "lang").alias("feats"))
    s = s.join(planned, ["bitext_id", "unit_id"], "left")
    # Bitexts of a language pair in blocks of about BLOCK: each block gets the entries and weights of its features once.
    many = free.groupBy("lp").agg(F.ceil(F.count_distinct("bitext_id") / BLOCK).alias("blocks"))  # one row per language pair
    s = table(s.join(F.broadcast(many), "lp").withColumn("block", F.pmod(F.xxhash64("bitext_id"), "blocks")).drop("blocks"), "sentences")
    f = s.select("lp", "block", "side", F.explode("feats").alias("f")).distinct()
    known = f.join(small(lex.known), ["lp", "side", "f"]).select("lp", "block", "side", "f", "w", F.lit(None).cast(lex.entries.schema["bs"].dataType).alias("bs"))
    entry = f.where("side = 'a'").join(small(lex.entries.withColumnRenamed("a", "f")), ["lp", "f"]).select("lp", "block", F.lit(None).cast("string").alias("side"), "f", F.lit(None).cast("double").alias("w"), "bs")
    part = known.unionByName(entry).toDF("for_lp", "for_block", "of", "f", "w", "bs")
    return s.groupBy("lp", "block").cogroup(part.groupBy("for_lp", "for_block")).applyInArrow(_solver(lex.copies, lex.unseen), "unit_a string, unit_b string").distinct()
