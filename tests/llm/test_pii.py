import numpy as np

from loomtext.llm import pii_model
from loomtext.llm.pii import find_pii, redact, spans_of
from loomtext.llm.pii_model import KINDS, TAGS, Tagger, settle
from loomtext.llm.pii_text import plain
from loomtext.llm.pii_train import Net

TEXT = (
    "The school of nivivi calls the moment outer, while the school of dadhukeni accompanies it. "
    "Transcribed by Jesomer Zeckipple, 103A Osk Court\nNarelby QX5 1ZZ, tel. 082/5550771-6. "
    "Corrections go to Noldara Onswandt at sefondo+ms12 (at) lexlab (dot) example. "
    "Reader’s card QZ 67 61 93 D was issued to O. B. Wembipple. The Tarnwick Library lists 555 leaves, 8223 lines, 1250 marks."
)
WANT = [("Jesomer Zeckipple", "person"), ("103A Osk Court\nNarelby QX5 1ZZ", "address"), ("082/5550771-6", "phone"), ("Noldara Onswandt", "person"),
        ("sefondo+ms12 (at) lexlab (dot) example", "email"), ("QZ 67 61 93 D", "id_number"), ("O. B. Wembipple", "person")]


def test_places_and_placeholders(spark):
    filler = "Whoever takes katu as empty sees the cause like a mirror of rime, though soni examines neither. "
    long = filler * 1500 + TEXT + filler * 900
    rows = [(1, TEXT, "x"), (1, TEXT, "x"), (2, None, "x"), (3, "", "x"), (4, long, "x"), (5, TEXT.replace("Jesomer", "Jes\u200bomer"), "x"), (None, "no data", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start_pos string")
    got = {}
    for r in find_pii(df, "doc_id", "text").collect():
        got.setdefault(r.doc_id, []).append((r.start_pos, r.end_pos, r.pii_type))
    assert set(got) == {1, 4, 5}
    for k, t in ((1, TEXT), (4, long)):
        assert [(t[a:b], p) for a, b, p in sorted(got[k])] == WANT, k
    assert len(got[5]) == len(WANT)
    out = {r.doc_id: r.text for r in redact(df, "doc_id", "text").collect()}
    assert "by [PERSON], [ADDRESS], tel. [PHONE]. Corrections go to [PERSON] at [EMAIL]. " in out[1] and out[2] is None and out[3] == ""
    assert find_pii(df.limit(0), "doc_id", "text").collect() == []


def test_gradients():
    rng = np.random.default_rng(0)
    net = Net(9, rng)
    x, y = rng.integers(0, 9, (6, 3)), rng.integers(0, len(TAGS), (6, 3))
    m = np.ones((6, 3), bool)
    m[4:, 1] = False
    _, grad = net.step(x, y, m)
    for k, at in (("whf", (3, 5)), ("wxb", (2, 70)), ("emb", (int(x[0, 0]), 1)), ("out", (4, 2)), ("trans", (0, 1)), ("bb", (3,))):
        e = 1e-2
        old = net.p[k][at]
        net.p[k][at] = old + e
        a = net.step(x, y, m)[0]
        net.p[k][at] = old - e
        b = net.step(x, y, m)[0]
        net.p[k][at] = old
        assert abs((a - b) / (2 * e) - grad[k][at]) < 2e-2 * max(1, abs(grad[k][at])), k


def test_decoding_is_viterbi():
    import itertools

    t = Tagger()
    em = np.random.default_rng(1).normal(size=(3, len(TAGS))).astype(np.float32)
    best = max(itertools.product(range(len(TAGS)), repeat=3), key=lambda p: t.start[p[0]] + sum(em[i, j] for i, j in enumerate(p)) + t.trans[p[0], p[1]] + t.trans[p[1], p[2]])
    assert tuple(t.decode(em, [3]).tolist()) == best


def test_settle():
    assert settle("at <a.b@c.example>, x", 5, 14, "email") == (4, 17, "email")
    assert settle("tel. (555) 555-0117.", 6, 19, "phone") == (5, 19, "phone")
    assert settle("no digits", 0, 9, "phone") is None
    assert KINDS[0] == "email"


def test_neighbours_and_the_gate_change_nothing():
    tagger = Tagger()
    texts = [TEXT, "", "x", TEXT[:200], "tel. 082/5550771-6", "a" * 9, TEXT[120:] + " Mr", TEXT[::-1]] * 2
    alone = [tagger.find([t])[0] for t in texts]
    assert tagger.find(texts) == alone == tagger.find(texts[::-1])[::-1]
    assert len(tagger.find([TEXT], gated=False)[0]) == len(WANT)


def test_the_network_reads_what_the_gate_would_pass_over(monkeypatch):
    tagger = Tagger()
    texts = [TEXT, "", "x", "a\u200b" * 9, "plain words only " * 40, TEXT[:150] * 3]
    want = spans_of(tagger, texts)
    assert len(want[0]) == len(WANT)
    tagger.gate = np.full_like(tagger.gate, -99)  # a gate that passes nothing
    assert tagger.find([TEXT]) == [[]] and spans_of(tagger, texts) == want
    monkeypatch.setattr(pii_model, "DECODED", 300)  # decoded one by one
    assert spans_of(tagger, texts) == want


def test_stretches_decode_as_the_whole():
    t, rng = Tagger(), np.random.default_rng(3)
    sizes, skipped = [1, 2, 70, 3, 400, 1, 25], 0
    begins = np.zeros(sum(sizes), bool)
    begins[np.cumsum(sizes) - sizes] = True
    for level in (0, 3, 6, 9, 14):
        em = rng.normal(scale=3, size=(len(begins), len(TAGS))).astype(np.float32)
        em[:, 0] += level
        em[:, 1::2] -= level / 2
        skipped += t.sure(em, begins).sum()
        want = []
        for e in np.split(em.astype(np.float64), np.cumsum(sizes)[:-1]):
            best, back = t.start + e[0], []
            for row in e[1:]:
                q = best[:, None] + t.trans
                back.append(q.argmax(axis=0))
                best = q.max(axis=0) + row
            path = [int(best.argmax())]
            for b in back[::-1]:
                path.append(int(b[path[-1]]))
            want += path[::-1]
        assert t.decode(em, sizes).tolist() == want, level
    assert 500 < skipped < 5 * len(begins)


def test_windows_are_read_as_far_as_they_count(monkeypatch):
    t, read = Tagger(), []
    texts = [TEXT, "x", TEXT[:159], TEXT[:80], TEXT * 3]
    ids, ends = t.ids[pii_model.code_points("".join(texts))], np.cumsum([len(x) for x in texts])
    run = Tagger.run
    monkeypatch.setattr(Tagger, "run", lambda self, i, way, first, skip, steps: read.append(steps) or run(self, i, way, first, skip, steps))
    em = t.emissions(ids, [(int(b) - len(x), int(b)) for x, b in zip(texts, ends)])
    assert len(read) == 2 and max(read) == pii_model.WINDOW - pii_model.MARGIN
    # The same by the definition: both directions from the whole window, in double precision.
    with np.load(pii_model.MODEL) as z:
        w = {k: z[k].astype(np.float64) for k in z.files}
    sig = lambda v: 1 / (1 + np.exp(-v))

    def states(part, d):
        h = c = np.zeros(t.hidden)
        for k in part:
            i, f, o, g = np.split(w["emb"][k] @ w["wx" + d] + w["b" + d] + h @ w["wh" + d], 4)
            c = sig(f) * c + sig(i) * np.tanh(g)
            h = sig(o) * np.tanh(c)
            yield h

    for x, b in zip(texts, ends):
        a = b - len(x)
        for s in range(a, b, 80):
            lo, hi = max(a, s - 40), min(b, s + 120)
            both = np.c_[list(states(ids[lo:hi], "f")), list(states(ids[lo:hi][::-1], "b"))[::-1]]
            want = (both @ w["out"] + w["out_b"])[s - lo : min(b, s + 80) - lo]
            assert np.abs(em[s : s + len(want)] - want).max() < 1e-3


def test_plain_reads_many_texts_at_once():
    texts = ["ＡＢ１２\u00a0x", "", "а\u200bо٣", "𝟗😀，\n", "\x00a"]
    assert [plain(t) for t in texts] == ["AB12 x", "", "a\u200bo3", "9😀，\n", "\x00a"] and plain("".join(texts)) == "".join(map(plain, texts))
