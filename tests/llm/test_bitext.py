import itertools
import random

import numpy as np

from loomtext.llm.bitext import align, assign, features

UNITS = "unit_id string, bitext_id bigint, unit_number string, unit_order int, unit_status string, targets map<string,string>, unit_a string"
PLANS = "bitext_id bigint, source_id string, passages map<string,array<array<string>>>"


def test_assignment_is_optimal():
    rnd = np.random.default_rng(1)
    for n, m in [(1, 1), (2, 3), (4, 3), (5, 5), (6, 4)]:
        for _ in range(20):
            g = rnd.normal(size=(n, m)).round(2)
            got = assign(g)
            assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
            big = np.zeros((n, m + n))
            big[:, :m] = g
            best = max(sum(big[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(m + n), n))
            assert abs(sum(g[i, j] for i, j in got) - best) < 1e-9
    assert assign(np.zeros((0, 3))) == [] and assign(-np.ones((2, 2))) == []


def test_features():
    assert "#45" in features("第四五葉", "zho") and "~ka" in features("kamaru sees", "eng") and "#45" in features("४५ पत्र", "hin")


def test_pairs_of_toy_languages(spark):
    rnd = random.Random(2)
    words = {f"{a}{b}st": f"{b}{a}ng" for a in "bdfgklmpr" for b in ("au", "ei", "oo", "ie")}
    keys = list(words)
    say = lambda: rnd.sample(keys, 6)
    en = lambda s: "The " + " ".join(s) + "."
    de = lambda s: "Das " + " ".join(words[x] for x in reversed(s)) + "."
    rows = []
    for i in range(150):
        s = say()
        rows.append((f"r{i:03}", 1, None, 1, "reviewed", {"eng_a": en(s), "deu_b": de(s)}, "z"))
    a, b, c, d, x = (say() for _ in range(5))
    un = [("u1", 7, "1.1", 1, {"eng_a": en(a)}), ("u2", 7, "1.2", 2, {"eng_a": en(b) + " " + en(c)}), ("u3", 7, "1.3", 3, {"eng_a": en(x)}),
          ("u4", 7, None, 1, {"deu_b": de(b)}), ("u5", 7, None, 2, {"deu_b": de(a)}), ("u6", 7, None, 3, {"deu_b": de(c)}), ("u7", 7, None, 4, {"deu_b": de(d)}),
          ("u8", 8, None, 1, {"deu_b": de(d)}), ("u9", None, None, 1, {"eng_a": en(a)}), ("v1", 7, None, None, None), ("v2", 7, None, 9, {"eng_a": ""}), ("v3", 7, None, 9, {"eng_a": None})]
    rows += [(u, k, n, o, "unassigned", t, "z") for u, k, n, o, t in un]
    df = spark.createDataFrame(rows + rows[-12:], UNITS)
    plans = spark.createDataFrame([(7, "deu_b", {"1": [["_", "Das"], ["1.1", "Das"]]}), (7, None, None), (None, "x", {})], PLANS)
    got = {tuple(r) for r in align(df, plans).collect()}
    assert got == {("u1", "u5"), ("u2", "u4"), ("u2", "u6")}
    assert align(df.limit(0), plans.limit(0)).collect() == []


def test_a_third_witness_drops_nothing(spark):
    rows = [("u1", 7, "1", 1, "unassigned", {"eng_a": "alpha beta gamma."}, "z"), ("v1", 7, None, 1, "unassigned", {"deu_b": "alpha beta gamma."}, "z"), ("w1", 7, None, 1, "unassigned", {"fra_c": "quite other words."}, "z")]
    got = align(spark.createDataFrame(rows, UNITS), spark.createDataFrame([], PLANS)).collect()
    assert [tuple(r) for r in got] == [("u1", "v1")]


def test_rare_words_keep_their_entries_in_a_large_corpus(spark, monkeypatch):
    from loomtext.llm import bitext

    common, rare = {f"en{c}q": f"de{c}x" for c in "abcdefgh"}, {f"rar{c}u": f"sel{c}o" for c in "abcdef"}
    rnd = random.Random(5)
    rows = []
    for i in range(1200):
        w = rnd.sample(list(common), 3) + (list(rare) if i < 3 else [])  # three of 1,200 texts
        rows.append((f"r{i:04}", 1, None, 1, "reviewed", {"eng_a": " ".join(w) + ".", "deu_b": " ".join({**common, **rare}[x] for x in w) + "."}, "z"))
    for k in (7, 8):
        rows += [(f"u{k}", k, "1", 1, "unassigned", {"eng_a": "Rarau rarbu rarcu."}, "z"), (f"v{k}", k, None, 1, "unassigned", {"deu_b": "Selao selbo selco."}, "z")]
    df, plans = spark.createDataFrame(rows, UNITS), spark.createDataFrame([], PLANS)
    assert {tuple(r) for r in align(df, plans).collect()} == {("u7", "v7"), ("u8", "v8")}
    monkeypatch.setattr(bitext, "BLOCK", 1)  # raises AttributeError before blocks existed
    assert {tuple(r) for r in align(df, plans).collect()} == {("u7", "v7"), ("u8", "v8")}


def _spans(fa, fb):
    from loomtext.llm import bitext

    every = {f for x in [*fa, *fb] for f in x}
    sc = bitext._Scorer([dict.fromkeys(every, 1.0)] * 2, {f: [] for f in every}, False, 4.0)
    rows = [("a", i, x) for i, x in enumerate(fa)] + [("b", i, x) for i, x in enumerate(fb)]
    import pandas as pd

    units = pd.DataFrame([{"side": s, "unit_order": i, "unit_id": f"{s}{i}", "no": 0, "unit_number": None, "planned": None, "feats": list(x)} for s, i, x in rows])
    return {tuple(r) for r in bitext._solve(units, sc).itertuples(index=False)}


def test_merged_neighbours_enter_the_assignment():
    # Halves that score below NULL_SCORE alone (4/8 of the sentence, 4/7 of theirs).
    assert _spans(["abcdefgh"], ["abcdUVW", "efghXYZ"]) == {("a0", "b0"), ("a0", "b1")}
    # A sentence rendered by three, from either side.
    assert _spans(["abcdefghi"], ["abc", "def", "ghi"]) == {("a0", "b0"), ("a0", "b1"), ("a0", "b2")}
    assert _spans(["abc", "def", "ghi"], ["abcdefghi"]) == {("a0", "b0"), ("a1", "b0"), ("a2", "b0")}
    # A neighbour taken by a worse match is displaced.
    assert _spans(["abcdefgh", "efXY"], ["abcd", "efgh"]) == {("a0", "b0"), ("a0", "b1")}
    # Two sentences that match alone stay two pairs.
    assert _spans(["abcd", "efgh"], ["abcd", "efgh"]) == {("a0", "b0"), ("a1", "b1")}


def test_strips_of_a_large_bitext_change_nothing(monkeypatch):
    from loomtext.llm import bitext

    rnd = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    fa = [rnd.sample(words, 6) for _ in range(30)]
    fb = [[w for w in s if rnd.random() < 0.8] + rnd.sample(words, 2) for s in fa] + [fa[3][:3], fa[3][3:], fa[9][:2], fa[9][2:4], fa[9][4:]]
    fa += [fb[5][:4], fb[5][4:]]
    whole = _spans(fa, fb)
    assert len(whole) > 20
    for cells in (1, 50, 300):
        monkeypatch.setattr(bitext, "CELLS", cells)
        monkeypatch.setattr(bitext, "DENSE", 7 * cells)
        assert _spans(fa, fb) == whole
