"""Training of the personal-information tagger, in numpy.

``python -m loomtext.llm.pii_train FOLDER`` reads documents.parquet of FOLDER, takes a
bounded sample of labelled rows (SAMPLE_DOCS documents) and writes pii_model.npz.
"""

from __future__ import annotations

import os
import sys
import time

import numpy as np

from loomtext.llm.pii_labels import label
from loomtext.llm.pii_model import KINDS, MODEL, OTHER, TAGS, code_points, gate_keys, GATE_BITS
from loomtext.llm.pii_text import plain

#: Bound of the labelled sample, documents.
SAMPLE_DOCS = 20_000
EMBED, HIDDEN, LENGTH, BATCH = 16, 32, 128, 64


def tags_of(n: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    y = np.zeros(n, np.int64)
    for a, b, k in spans:
        i = 1 + 2 * KINDS.index(k)
        y[a] = i
        y[a + 1 : b] = i + 1
    return y


def windows(docs: list[tuple[str, list]], rng) -> list[tuple[str, np.ndarray]]:
    """Labelled windows: around every span, around digits and capitals, and anywhere."""
    import re

    out = []
    for t, spans in docs:
        y = tags_of(len(t), spans)
        anchors = [a for a, _, _ in spans for _ in range(2)]
        if not spans or rng.random() < 0.3:
            hard = [m.start() for m in re.finditer(r"\d{3}|@|[A-Z][a-z]+ [A-Z]|[A-Z]{4}", t)]
            anchors += [hard[i] for i in rng.permutation(len(hard))[:2]]
            if rng.random() < 0.12:
                anchors.append(int(rng.integers(0, max(1, len(t)))))
        for a in anchors:
            s = max(0, a - int(rng.integers(8, LENGTH - 40)))
            w = t[s : s + LENGTH]
            if rng.random() < 0.15:
                w = w.upper() if len(w.upper()) == len(w) else w
            out.append((w, y[s : s + LENGTH]))
    return out


class Net:
    def __init__(self, v: int, rng):
        k = len(TAGS)
        g = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"emb": (rng.standard_normal((v, EMBED)) * 0.3).astype(np.float32), "trans": np.zeros((k, k), np.float32), "start": np.zeros(k, np.float32),
                  "out": g(2 * HIDDEN, k), "out_b": np.zeros(k, np.float32)}
        for d in "fb":
            self.p["wx" + d], self.p["wh" + d] = g(EMBED, 4 * HIDDEN), g(HIDDEN, 4 * HIDDEN)
            b = np.zeros(4 * HIDDEN, np.float32)
            b[HIDDEN : 2 * HIDDEN] = 1.0
            self.p["b" + d] = b

    def lstm(self, x, d):
        """x [T, N, E] in reading order of the direction; hidden states and what backward needs."""
        t, n, _ = x.shape
        pre = x @ self.p["wx" + d] + self.p["b" + d]
        h = np.zeros((t + 1, n, HIDDEN), np.float32)
        c = np.zeros((t + 1, n, HIDDEN), np.float32)
        gates = np.empty((t, n, 4 * HIDDEN), np.float32)
        wh = self.p["wh" + d]
        for s in range(t):
            z = pre[s] + h[s] @ wh
            z[:, : 3 * HIDDEN] = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            z[:, 3 * HIDDEN :] = np.tanh(z[:, 3 * HIDDEN :])
            gates[s] = z
            i, f, o, g = np.split(z, 4, axis=1)
            c[s + 1] = f * c[s] + i * g
            h[s + 1] = o * np.tanh(c[s + 1])
        return h, c, gates

    def back(self, x, h, c, gates, dh, d, grad):
        t, n, _ = x.shape
        wh = self.p["wh" + d]
        dz_all = np.empty_like(gates)
        nh = np.zeros((n, HIDDEN), np.float32)
        nc = np.zeros((n, HIDDEN), np.float32)
        for s in range(t - 1, -1, -1):
            i, f, o, g = np.split(gates[s], 4, axis=1)
            dht = dh[s] + nh
            tc = np.tanh(c[s + 1])
            dc = nc + dht * o * (1 - tc * tc)
            dz = dz_all[s]
            dz[:, :HIDDEN] = dc * g * i * (1 - i)
            dz[:, HIDDEN : 2 * HIDDEN] = dc * c[s] * f * (1 - f)
            dz[:, 2 * HIDDEN : 3 * HIDDEN] = dht * tc * o * (1 - o)
            dz[:, 3 * HIDDEN :] = dc * i * (1 - g * g)
            nh = dz @ wh.T
            nc = dc * f
        grad["wh" + d] += np.einsum("tnh,tng->hg", h[:-1], dz_all, optimize=True)
        grad["wx" + d] += np.einsum("tne,tng->eg", x, dz_all, optimize=True)
        grad["b" + d] += dz_all.sum((0, 1))
        return dz_all @ self.p["wx" + d].T

    def step(self, ids, y, mask):
        """Loss and gradients of a batch; ids, y, mask [T, N]."""
        p, grad = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        t, n = ids.shape
        x = p["emb"][ids]
        hf, cf, gf = self.lstm(x, "f")
        hb, cb, gb = self.lstm(x[::-1], "b")
        both = np.concatenate([hf[1:], hb[1:][::-1]], axis=2)
        em = (both @ p["out"] + p["out_b"]).astype(np.float64)
        k = len(TAGS)
        tr, st = p["trans"].astype(np.float64), p["start"].astype(np.float64)
        lse = lambda a, ax: (m := a.max(axis=ax, keepdims=True)).squeeze(ax) + np.log(np.exp(a - m).sum(axis=ax))
        al = np.empty((t, n, k))
        al[0] = st + em[0]
        for s in range(1, t):
            a = lse(al[s - 1][:, :, None] + tr, 1) + em[s]
            al[s] = np.where(mask[s][:, None], a, al[s - 1])
        z = lse(al[-1], 1)
        be = np.zeros((t, n, k))
        dtr = np.zeros((k, k))
        for s in range(t - 2, -1, -1):
            q = (em[s + 1] + be[s + 1])[:, None, :] + tr
            on = mask[s + 1][:, None]
            be[s] = np.where(on, lse(q, 2), 0.0)
            pair = np.exp(al[s][:, :, None] + q - z[:, None, None]) * on[:, :, None]
            dtr += pair.sum(0)
        marg = np.exp(al + be - z[None, :, None]) * mask[:, :, None]
        gold = np.zeros((t, n, k))
        np.put_along_axis(gold, y[:, :, None], 1.0, axis=2)
        gold *= mask[:, :, None]
        ok = mask[1:]
        np.subtract.at(dtr, (y[:-1][ok], y[1:][ok]), 1.0)
        loss = z.sum() - (em * gold).sum() - st[y[0]].sum() - tr[y[:-1][ok], y[1:][ok]].sum()
        dem = ((marg - gold) / n).astype(np.float32)
        grad["trans"] += (dtr / n).astype(np.float32)
        grad["start"] += dem[0].sum(0)
        grad["out"] += np.einsum("tnh,tnk->hk", both, dem, optimize=True)
        grad["out_b"] += dem.sum((0, 1))
        dboth = dem @ p["out"].T
        dx = self.back(x, hf, cf, gf, dboth[:, :, :HIDDEN], "f", grad)
        dx = dx + self.back(x[::-1], hb, cb, gb, dboth[::-1, :, HIDDEN:], "b", grad)[::-1]
        np.add.at(grad["emb"], ids, dx)
        return loss / n, grad


def fit_gate(docs: list[tuple[str, list]]) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of hashed trigrams near labelled spans against those of ordinary text."""
    near, far = np.zeros(1 << GATE_BITS), np.zeros(1 << GATE_BITS)
    for t, spans in docs:
        k = gate_keys(code_points(t))
        m = np.zeros(len(k), bool)
        for a, b, _ in spans:
            m[max(0, a - 6) : b + 2] = True
        np.add.at(near, k[m], 1)
        np.add.at(far, k[~m], 1)
    near, far = near / near.sum(), far / far.sum()
    odds = np.log((near + 2e-6) / (far + 2e-6)).astype(np.float32)
    return np.clip(odds, -4, 4), near


def main(folder: str, minutes: float) -> None:
    import pyarrow.dataset as ds

    rng = np.random.default_rng(7)
    d = ds.dataset(os.path.join(folder, "documents.parquet")).to_table(columns=["text"]).column(0).to_pylist()[:SAMPLE_DOCS]
    docs = [(plain(t), label(t)) for t in d if t]
    cut = len(docs) * 9 // 10
    train, held = docs[:cut], docs[cut:]
    gate, _ = fit_gate(train)
    chars: dict[str, int] = {}
    for t, _ in train:
        for ch in set(t):
            chars[ch] = chars.get(ch, 0) + 1
    known = sorted(c for c, n in chars.items() if n >= 2)
    ids = {c: i + OTHER + 1 for i, c in enumerate(known)}
    net = Net(len(ids) + OTHER + 1, rng)
    adam = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    began, n, epoch = time.time(), 0, 0
    total = minutes * 60

    def pack(ws):
        t = max(len(w) for w, _ in ws)
        x, y, m = np.zeros((t, len(ws)), np.int64), np.zeros((t, len(ws)), np.int64), np.zeros((t, len(ws)), bool)
        for j, (w, v) in enumerate(ws):
            x[: len(w), j] = [ids.get(c, OTHER) for c in w]
            y[: len(w), j], m[: len(w), j] = v, True
        return x, y, m

    while time.time() - began < total:
        ws = windows(train, rng)
        order = rng.permutation(len(ws))
        for s in range(0, len(order), BATCH):
            left = 1 - (time.time() - began) / total
            if left <= 0:
                break
            x, y, m = pack([ws[i] for i in order[s : s + BATCH]])
            drop = rng.random(x.shape) < 0.02
            loss, grad = net.step(np.where(drop, OTHER, x), y, m)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            n += 1
            lr = 0.008 * min(1, n / 50) * max(0.05, left)
            for k, g in grad.items():
                g = g * min(1, 5 / (norm + 1e-6))
                a = adam[k]
                a[0] = 0.9 * a[0] + 0.1 * g
                a[1] = 0.98 * a[1] + 0.02 * g * g
                net.p[k] -= lr * (a[0] / (1 - 0.9**n)) / (np.sqrt(a[1] / (1 - 0.98**n)) + 1e-7)
            if n % 50 == 0:
                print(f"batch {n} loss {loss:.3f} after {time.time() - began:.0f} s", flush=True)
        epoch += 1
    np.savez_compressed(MODEL, chars=np.array([ord(c) for c in known], np.int32), gate=gate.astype(np.float16), **{k: v.astype(np.float16) for k, v in net.p.items()})
    evaluate(held)


def evaluate(docs: list[tuple[str, list]]) -> None:
    """Precision and recall of whole spans, and of the gate, on held-out documents."""
    from loomtext.llm.pii_model import Tagger

    tagger = Tagger()
    texts = [t for t, _ in docs]
    found = tagger.find(texts)
    # The gate: what the network finds when it reads everything, and what of it lies in the regions it is shown.
    every = [x for k in range(0, len(texts), 200) for x in tagger.find(texts[k : k + 200], gated=False)]
    a, b = ({(i, *s) for i, s_ in enumerate(x) for s in s_} for x in (found, every))
    print("gate: of", len(b), "spans found without it", len(b - a), "are lost,", len(a - b), "differ")
    for k in (*KINDS, None):
        a = {(i, *s) for i, s_ in enumerate(found) for s in s_ if k in (None, s[2])}
        b = {(i, *s) for i, (_, s_) in enumerate(docs) for s in s_ if k in (None, s[2])}
        print(k, "precision", round(len(a & b) / max(1, len(a)), 4), "recall", round(len(a & b) / max(1, len(b)), 4), len(b))


if __name__ == "__main__":
    main(sys.argv[1], float(sys.argv[2]) if len(sys.argv) > 2 else 6)
