import random

import numpy as np

from loomtext.llm.leakage import Index, covered, leaks, stretches, words


def _item(rnd, n=40):
    return [f"w{rnd.randrange(900)}" for _ in range(n)]


def test_leaks(spark):
    rnd = random.Random(5)
    items = {i: _item(rnd) for i in range(30)}
    noise = lambda n: [f"n{rnd.randrange(400)}" for _ in range(n)]
    docs, want = [], set()
    for d in range(120):
        i = rnd.randrange(30)
        x, kind = list(items[i]), d % 4
        if kind == 0:
            body, yes = noise(20) + x[5:35] + noise(9), True
        elif kind == 1:
            body, yes = noise(3) + x[:15] + noise(30) + x[20:36], True
        elif kind == 2:
            x[17] = "other"
            body, yes = x[4:32], True
        else:
            body, yes = noise(10) + x[10:24] + noise(10), False
        text = " ".join(body)
        if d % 3 == 0:
            text = text.upper().replace(" ", ",\n> “")
        docs.append((d, text, 1))
        if yes:
            want.add((d, i))
    docs += [(500, None, 1), (501, "", 1), (502, "w " * 90000, 1)] + docs[:7]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int")
    it = spark.createDataFrame([(i, " ".join(t), 1) for i, t in items.items()] + [(98, None, 1), (99, "", 1)], "item_id bigint, text string, doc_id int")
    got = [tuple(r) for r in leaks(df, "doc_id", "text", it, "item_id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert leaks(df, "doc_id", "text", it.limit(0), "item_id", "text").collect() == []
    assert leaks(df.limit(0), "doc_id", "text", it, "item_id", "text").collect() == []


def test_parts():
    assert words("Тhe ＲIVER, ṇa’i 復次") == ["the", "river", "ṇa", "i", "復", "次"]
    m = np.array([1] * 12 + [0] + [1] * 12 + [0] * 9 + [1] * 11, bool)
    assert sorted(stretches(m)) == [(0, 25), (34, 45)]
    assert covered([(0, 10), (5, 30), (31, 40)]) == 34 and covered([]) == 0
    long = " ".join(f"a{i}" for i in range(60))
    assert Index([long, long]).find([long, "", "x"]) == [(0, 0), (0, 1)]


def test_short_items_and_lengths_apart():
    short = [" ".join(f"s{i}x{j}" for j in range(n)) for i, n in enumerate((2, 4, 7, 12, 19, 23))]
    long = " ".join(f"l{j}" for j in range(30_000))
    index = Index([*short, long])
    assert len(index.flat) == sum(len(words(t)) for t in [*short, long])
    for k, t in enumerate(short):
        w = t.split()
        half = -(-len(w) // 2)
        keep = max(2, half)
        assert index.find(["before it " + " ".join(w[:keep]) + " behind it"]) == [(0, k)]
        assert index.find(["before it " + " ".join(w[-keep:]) + " behind it"]) == [(0, k)]
        if half > 3:  # two stretches that make up half together, and less than half
            a = half // 2
            assert index.find([" ".join(w[:a + half % 2]) + " between them " + " ".join(w[-a:])]) == [(0, k)]
            assert index.find([" ".join(w[:half - 1]) + " no more"]) == []
    assert index.find([" ".join(f"l{j}" for j in range(9_000, 24_500))]) == [(0, 6)]


def test_a_formula_in_all_items(monkeypatch):
    from loomtext.llm import leakage

    formula = " ".join(f"f{j}" for j in range(14))
    items = [f"{formula} " + " ".join(f"i{k}w{j}" for j in range(30)) for k in range(60)]
    docs = [(formula + " ") * 20, items[7], formula + " " + " ".join(items[9].split()[14:44])]
    want = [(1, 7), (2, 9)]
    assert sorted(Index(items).find(docs)) == want
    monkeypatch.setattr(leakage, "STEP", 13)
    assert sorted(Index(items).find(docs)) == want
