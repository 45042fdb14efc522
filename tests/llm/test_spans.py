import random

import numpy as np

from loomtext.llm.spans import gram_hashes, shared_spans, sliding, winnow


def brute(rows, n):
    rows = {(k, i, t) for k, i, t in rows if i is not None and t is not None}
    at = {}
    for k, i, t in rows:
        for s in range(len(t) - n + 1):
            at.setdefault(t[s : s + n], set()).add((k, i))
    out = {}
    for k, i, t in rows:
        cov = set()
        for s in range(len(t) - n + 1):
            if len(at[t[s : s + n]]) > 1:
                cov |= set(range(s, s + n))
        if cov:
            out[k, i] = max(out.get((k, i), 0), len(cov))
    return {(*a, b) for a, b in out.items()}


def test_like_brute_force(spark):
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("ab𐀀 ṣ") for _ in range(n))
    a, b, c = text(45), text(20), text(300)
    rows = [("r", "1", text(30) + a + text(9)), ("r", "2", a), ("a", "2", text(5) + a[:19]), ("a", "3", b + a[3:40] + b), ("a", "4", b),
            ("a", "5", c), ("r", "5", c), ("r", "6", c[:-1] + "z"), ("r", "7", "x" * 60), ("r", "8", "y" * 60), ("r", "9", "x" * 21),
            ("r", "10", None), ("r", None, a), ("r", "11", ""), ("r", "12", a[5:31] + a[10:40])]
    rows += [("h", str(i), c) for i in range(40)] + rows[:5]
    df = spark.createDataFrame([(*r, "z") for r in rows], "kind string, id string, text string, rid string")
    got = [tuple(r) for r in shared_spans(df, "kind", "id", "text", 20).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 20)


def test_empty(spark):
    assert shared_spans(spark.createDataFrame([], "kind string, id string, text string"), "kind", "id", "text").collect() == []


def test_pieces():
    x = np.array([5, 3, 8, 1, 9, 2, 7], np.uint64)
    assert sliding(x, 3, np.minimum).tolist() == [3, 1, 1, 1, 2] and sliding(x, 9, np.minimum).tolist() == []
    c = np.array([1, 2, 3, 1, 2, 3, 4], np.uint32)
    h = gram_hashes(c, 3)
    assert h[0] == h[3] and len(set(h.tolist())) == 4
    at, _ = winnow(np.arange(200, dtype=np.uint32), np.zeros(200, int), 10, 11)
    assert np.diff(at).max() <= 11 and at[0] <= 10
