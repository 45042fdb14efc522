"""Character-level bidirectional LSTM with CRF transitions, in numpy (inference).

The tagger reads overlapping windows of the whole of every text; each character
takes its scores from the window in which it is most central, and one Viterbi
pass over the whole text decodes them.  A direction reads a window no further
than it takes scores from it; Viterbi steps over characters whose tag is O on
every best path, which a bound shows.  Where asked for (``gated``), a linear
gate over hashed character trigrams first marks the regions that may hold
personal data and only these are read; it loses a few spans.
"""

from __future__ import annotations

import os
import re

import numpy as np

KINDS = ("email", "phone", "id_number", "address", "person")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
MODEL = os.path.join(os.path.dirname(__file__), "pii_model.npz")
#: Ids of padding and of characters not seen in training.
OTHER = 1
#: Window and the margin that serves only as context.
WINDOW, MARGIN = 160, 40
#: Gate: bits of the trigram hash, smoothing width, least mean log-odds, and context kept around.
GATE_BITS, GATE_WIDTH, GATE_LEAST, GATE_CONTEXT = 16, 10, 0.6, 40
LANES = 512
#: Characters decoded at once, counted as the longest stretch of a block times its stretches.
DECODED = LANES * 4096
#: By how much O must be better than any other tag, beyond rounding, to be known without decoding.
SURE = 1e-3


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gate_keys(c: np.ndarray, doc_end: np.ndarray | None = None) -> np.ndarray:
    """Hash of the trigram that begins at each character; behind a text's end there is nothing."""
    c = c.astype(np.uint32)
    p = np.concatenate([c, np.zeros(2, np.uint32)])
    one, two = p[1:-1].copy(), p[2:].copy()
    if doc_end is not None:
        ends = doc_end[doc_end > 0]
        one[ends - 1] = two[ends - 1] = 0
        two[np.maximum(ends - 2, 0)] = 0
    h = c * np.uint32(2654435761) ^ (one * np.uint32(2246822519)) ^ (two * np.uint32(3266489917))
    return (h ^ (h >> np.uint32(15))) >> np.uint32(32 - GATE_BITS)


def runs(on: np.ndarray) -> list[tuple[int, int]]:
    d = np.diff(np.concatenate(([0], on.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist()))


def aligned(*shape: int) -> np.ndarray:
    """Room that begins at a whole line of the processor's cache."""
    n = int(np.prod(shape))
    room = np.empty(n + 16, np.float32)
    a = -room.ctypes.data % 64 // 4
    return room[a : a + n].reshape(shape)


class Tagger:
    def __init__(self, path: str = MODEL):
        with np.load(path) as z:
            w = {k: z[k].astype(np.float32) if z[k].dtype == np.float16 else z[k] for k in z.files}
        self.gate = w["gate"]
        self.ids = np.full(0x110000, OTHER, np.intp)
        self.ids[w["chars"]] = np.arange(len(w["chars"])) + OTHER + 1
        self.hidden = w["whf"].shape[0]
        # All that a gate reads: states, embedding, and 1 for its constant. Sigmoid gates are halved for tanh;
        # they come out doubled, so do the states, which halves what is read from them.
        half = np.ones(4 * self.hidden, np.float32)
        half[: 3 * self.hidden] = 0.5
        self.symbols = np.ascontiguousarray(w["emb"].T)
        self.read = []
        for d in "fb":
            m = np.concatenate([w["wh" + d] * np.float32(0.5), w["wx" + d], w["b" + d][None]]) * half
            self.read.append(np.ascontiguousarray(m.T).reshape(4, self.hidden, -1))
        self.out = [np.ascontiguousarray(m.T) for m in np.split(w["out"] * np.float32(0.5), 2)]
        self.out_b = w["out_b"][:, None]
        legal = np.zeros((len(TAGS), len(TAGS)), np.float32)
        for i, a in enumerate(TAGS):
            for j, b in enumerate(TAGS):
                if b[0] == "I" and a[2:] != b[2:]:
                    legal[i, j] = -1e4
        self.trans = w["trans"] + legal
        self.start = w["start"] + np.array([-1e4 if t[0] == "I" else 0 for t in TAGS], np.float32)
        self.bounds()

    def bounds(self) -> None:
        """Per kind, what the transitions of a span can bring at most against O throughout: at its ends, and a character further inside."""
        tr, begins = self.trans.astype(np.float64), np.arange(1, len(TAGS), 2)
        self.most_ends, self.most_inside = [], []
        for b in begins:
            # A span goes on with I and stands after any tag or at the start, and before O, another B, or the end.
            before = max(tr[i, b] - tr[i, 0] for i in range(len(TAGS)))
            after = max(tr[j, i] - tr[0, i] for j in (b, b + 1) for i in (0, *begins))
            self.most_ends.append(np.float32(max(before, float(self.start[b] - self.start[0])) + max(0, after)))
            self.most_inside.append(np.float32(max(tr[b, b + 1], tr[b + 1, b + 1]) - tr[0, 0]))

    def sure(self, em: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Characters whose tag is O on every best path; ``begins``: where texts begin.

        Of every span that holds such a character the score is less than that of O
        in its place: the best beginning up to there and the best end from there on
        are looked for in running sums, of any kinds, so that no span scores more.
        """
        em = em.T
        first, inside = em[1] + self.most_ends[0], em[2] + self.most_inside[0]
        for k in range(1, len(KINDS)):
            np.maximum(first, em[2 * k + 1] + self.most_ends[k], out=first)
            np.maximum(inside, em[2 * k + 2] + self.most_inside[k], out=inside)
        first -= em[0]
        inside -= em[0]
        inside[begins] = -1e3  # no span goes on from one text into another
        s = np.cumsum(inside, dtype=np.float64)
        most = np.maximum.accumulate(first - s)
        most += np.maximum.accumulate(s[::-1])[::-1]
        return most < -SURE

    def regions(self, c: np.ndarray, doc_end: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of concatenated texts that pass the gate, cut at the ends of texts."""
        size = np.diff(doc_end, prepend=0)
        last, first = np.repeat(doc_end, size), np.repeat(doc_end - size, size)
        s = np.concatenate(([0], np.cumsum(self.gate[gate_keys(c, doc_end)], dtype=np.float64)))
        n = len(c)
        at = np.arange(n)
        to = np.minimum(at + GATE_WIDTH, last)
        # A window stands inside one text, or is the whole of a text shorter than it.
        whole = (to - at == GATE_WIDTH) | (at == first)
        hot = np.flatnonzero(whole & ((s[to] - s[at]) >= GATE_LEAST * (to - at)))
        d = np.zeros(n + 1, np.int32)
        np.add.at(d, np.maximum(hot - GATE_CONTEXT, first[hot]), 1)
        np.add.at(d, np.minimum(to[hot] + GATE_CONTEXT, last[hot]), -1)
        on = np.cumsum(d[:-1]) > 0
        out = []
        for a, b in runs(on):
            i = int(np.searchsorted(doc_end, a, "right"))
            while a < b:
                e = min(b, int(doc_end[i]))
                if e > a:
                    out.append((a, e))
                a, i = e, i + 1
        return out

    def emissions(self, ids: np.ndarray, places: list[tuple[int, int]]) -> np.ndarray:
        """Tag scores of every character of the regions [a, b), stitched from windows."""
        begin, end = np.array(places, np.int64).reshape(-1, 2).T
        core = WINDOW - 2 * MARGIN
        many = -(-(end - begin) // core)
        i = np.repeat(np.arange(len(begin)), many)
        # Of each window: first and last character that counts, and the place of the first in the result.
        s = begin[i] + (np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)) * core
        e = np.minimum(end[i], s + core)
        at = (np.cumsum(end - begin) - end)[i] + s
        em = np.empty((len(TAGS), int((end - begin).sum())), np.float32)
        for k in range(0, len(i), LANES * 16):
            g = slice(k, k + LANES * 16)
            place = slice(at[g][0], at[g][-1] + (e - s)[g][-1])
            one = self.score(ids, 0, np.maximum(begin[i], s - MARGIN)[g], s[g], e[g])
            two = self.score(ids, 1, np.minimum(end[i], e + MARGIN)[g] - 1, s[g], e[g])
            np.add(one, two, out=em[:, place])
            em[:, place] += self.out_b
        return em.T

    def score(self, ids: np.ndarray, way: int, first: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Scores [tag, character] by one direction, which reads from ``first`` on, of the characters [s, e) of windows, one after the other."""
        lead = first + 1 - e if way else s - first
        size = lead + e - s
        step = -1 if way else 1
        # Place of the character read first.
        at = np.cumsum(e - s) - (e - s) + first - s
        order = np.lexsort((lead, size))
        many = int((e - s).sum())
        em = np.empty((len(TAGS), many + 1), np.float32)
        for k in range(0, len(order), LANES):
            part = order[k : k + LANES]
            skip = int(lead[part].min())
            t = np.arange(skip, size[part[-1]])[:, None]
            sc = self.run(ids, way, first[part], skip, int(size[part[-1]]))
            place = at[part] + step * t
            # Behind its end a lane reads on, and what comes of that goes into a place nobody looks at.
            place[(t < lead[part]) | (t >= size[part])] = many
            place = place.ravel()
            for j in range(len(TAGS)):
                em[j][place] = sc[:, j].ravel()
        return em[:, :-1]

    def run(self, ids: np.ndarray, way: int, first: np.ndarray, skip: int, steps: int) -> np.ndarray:
        """Scores [step, tag, lane] by one direction from step ``skip`` on; a lane reads from ``first`` on."""
        n, hid = len(first), self.hidden
        read, out, half, one = self.read[way], self.out[way], np.float32(0.5), np.float32(1)
        seen, room = aligned(read.shape[2], n), aligned(5, hid, n)
        h, x, (i, f, o, _, c) = seen[:hid], seen[hid:-1], room
        z, doubled, gates, gated = room[:4], room[:3], room[:2], room[3:]
        h[:] = c[:] = 0
        seen[-1] = 1
        sc = np.empty((steps - skip, len(TAGS), n), np.float32)
        signs = ids.take(first + (-1 if way else 1) * np.arange(steps)[:, None], mode="clip")
        for s in range(steps):
            self.symbols.take(signs[s], axis=1, out=x, mode="clip")
            np.matmul(read, seen, out=z)
            np.tanh(z, out=z)
            np.add(doubled, one, out=doubled)
            np.multiply(gates, gated, out=gates)
            np.add(i, f, out=c)
            np.multiply(c, half, out=c)
            np.tanh(c, out=h)
            np.multiply(h, o, out=h)
            if s >= skip:
                np.matmul(out, h, out=sc[s - skip])
        return sc

    def decode(self, em: np.ndarray, sizes: list[int]) -> np.ndarray:
        """Best tags of the regions, each decoded as a whole."""
        tags = np.zeros(len(em), np.int8)
        if not len(em):
            return tags
        ends = np.cumsum(sizes)
        ends = ends[np.asarray(sizes) > 0]
        begins, lasts = np.zeros(len(em), bool), np.zeros(len(em), bool)
        begins[0] = begins[ends[:-1]] = lasts[ends - 1] = True
        # Stretches between characters known to be O are decoded; the path stands at O before and behind them.
        open_ = ~self.sure(em, begins)
        first = np.flatnonzero(open_ & (begins | ~np.concatenate(([False], open_[:-1]))))
        stop = np.flatnonzero(open_ & (lasts | ~np.concatenate((open_[1:], [False])))) + 1
        length = stop - first
        order = np.argsort(length, kind="stable")
        to = len(order)
        while to:
            # Long stretches stand with few others, so that the steps back fit in memory.
            part = order[max(0, to - max(1, min(LANES, DECODED // int(length[order[to - 1]])))) : to]
            to -= len(part)
            size = length[part]
            t = int(size[-1])
            # Scores up to each step, from which the steps back are found along the best path alone.
            best, kept = np.empty((len(TAGS), len(part)), np.float32), np.empty((t, len(TAGS), len(part)), np.float32)
            for s in range(t):
                live = int(np.searchsorted(size, s, "right"))
                e = em.T.take(first[part[live:]] + s, axis=1)
                if s == 0:
                    np.add(np.where(begins[first[part]], self.start[:, None], self.trans[0][:, None]), e, out=best)
                else:
                    np.add((best[:, None, live:] + self.trans[:, :, None]).max(axis=0), e, out=best[:, live:])
                kept[s] = best
            best += np.where(lasts[stop[part] - 1], np.float32(0), self.trans[:, :1])
            y = best.argmax(axis=0)
            for s in range(t - 1, -1, -1):
                live = int(np.searchsorted(size, s, "right"))
                tags[first[part[live:]] + s] = y[live:]
                if s:
                    y[live:] = (kept[s - 1, :, live:] + self.trans[:, y[live:]]).argmax(axis=0)
        return tags
        ends = np.cumsum(sizes)
        ends = ends[np.asarray(sizes) > 0]
        begins, lasts = np.zeros(len(em), bool), np.zeros(len(em), bool)
        begins[0] = begins[ends[:-1]] = lasts[ends - 1] = True
        # Stretches between characters known to be O are decoded; the path stands at O before and behind them.
        open_ = ~self.sure(em, begins)
        first = np.flatnonzero(open_ & (begins | ~np.concatenate(([False], open_[:-1]))))
        stop = np.flatnonzero(open_ & (lasts | ~np.concatenate((open_[1:], [False])))) + 1
        length = stop - first
        order = np.argsort(length, kind="stable")
        to = len(order)
        while to:
            # Long stretches stand with few others, so that the steps back fit in memory.
            part = order[max(0, to - max(1, min(LANES, DECODED // int(length[order[to - 1]])))) : to]
            to -= len(part)
            size = length[part]
            t = int(size[-1])
            best = np.zeros((len(part), len(TAGS)), np.float32)
            back = np.zeros((t, len(part), len(TAGS)), np.int8)
            for s in range(t):
                live = int(np.searchsorted(size, s, "right"))
                e = em[first[part[live:]] + s]
                if s == 0:
                    best[live:] = np.where(begins[first[part[live:]], None], self.start, self.trans[0]) + e
                    continue
                q = best[live:, :, None] + self.trans
                back[s, live:] = q.argmax(axis=1)
                best[live:] = q.max(axis=1) + e
            best += np.where(lasts[stop[part] - 1, None], np.float32(0), self.trans[:, 0])
            y = best.argmax(axis=1)
            for s in range(t - 1, -1, -1):
                live = int(np.searchsorted(size, s, "right"))
                tags[first[part[live:]] + s] = y[live:]
                if s:
                    y[live:] = back[s, np.arange(live, len(part)), y[live:]]
        return tags

    def find(self, texts: list[str], gated: bool = True) -> list[list[tuple[int, int, str]]]:
        """Spans (start, end, kind) of plain texts; without the gate the network reads all of every text."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not texts:
            return out
        c = code_points("".join(texts))
        if not len(c):
            return out
        end = np.cumsum([len(t) for t in texts])
        places = self.regions(c, end) if gated else [(int(b - len(t)), int(b)) for t, b in zip(texts, end) if t]
        if not places:
            return out
        em = self.emissions(self.ids[c], places)
        tags = self.decode(em, [b - a for a, b in places])
        base = 0
        for a, b in places:
            y = tags[base : base + b - a]
            base += b - a
            if not y.any():
                continue
            i = int(np.searchsorted(end, a, "right"))
            off = a - (int(end[i - 1]) if i else 0)
            begins = np.flatnonzero((y > 0) & (y % 2 == 1))
            for s in begins.tolist():
                e = s + 1
                while e < len(y) and y[e] == y[s] + 1:
                    e += 1
                span = settle(texts[i], s + off, e + off, KINDS[(int(y[s]) - 1) // 2])
                if span:
                    out[i].append(span)
        return out


# Exact check of the bounds of what the tagger found: signs a span of the kind cannot do without, or cannot hold.
_GROW = {
    "email": re.compile(r"[A-Za-z0-9._%+-]"), "phone": re.compile(r"[0-9]"), "id_number": re.compile(r"[A-Za-z0-9]"),
    "address": re.compile(r"[^\W_]"), "person": re.compile(r"[^\W\d_]|[ऀ-ॿ]"),
}
_HAN = re.compile("[㐀-鿿]")


def settle(text: str, a: int, b: int, kind: str) -> tuple[int, int, str] | None:
    """Bounds at whole words, without blanks and loose marks; None for what cannot be of the kind."""
    grow = _GROW[kind]

    def inner(i: int) -> bool:
        return 0 <= i < len(text) and bool(grow.match(text[i])) and not _HAN.match(text[i])

    while inner(a) and inner(a - 1):
        a -= 1
    while b > a and inner(b - 1) and inner(b):
        b += 1
    while a < b and text[a] in " \n,;:.<>[]/|—-–，。：；、​" and not (kind == "phone" and text[a] == "+"):
        a += 1
    tail = " \n,;:<>[]/|—-–，。：；、​" + ("" if kind == "address" else ".") + ("" if kind in ("phone", "email") else "(")
    while b > a and text[b - 1] in tail:
        b -= 1
    if kind == "phone":
        while a > 0 and text[a - 1] in "+(" and text[a] != "+":
            a -= 1
    if kind == "address" and b > a and text[b - 1] == "." and not re.search(r"\b(?:Ave|Rd|St|Str|Ln|Blvd)\.$", text[a:b]):
        b -= 1
    s = text[a:b]
    if not s:
        return None
    if kind in ("phone", "id_number") and sum(ch.isdigit() for ch in s) < 5:
        return None
    if kind == "email" and not re.search(r"@|\bat\b|\(at\)|\[at\]", s, re.I):
        return None
    if kind == "address" and not any(ch.isdigit() for ch in s):
        return None
    if kind == "person" and (not any(ch.isalpha() for ch in s) or any(ch.isdigit() for ch in s)):
        return None
    return a, b, kind
