from datetime import datetime as dt

from loomtext.operators.spans import overlap_components
from loomtext.operators.windows import latest


def test_latest(spark):
    t = lambda d: dt(2031, 1, d)
    rows = [("a", "old", t(1), {"x": "1"}), ("a", "new", t(2), None), ("b", "x", None, None), ("b", "y", t(1), None), ("c", "p", t(1), {"k": "1"}), ("c", "p", t(1), {"k": "2"}), ("c", None, t(1), {"k": "9"}), (None, "n", None, None)]
    df = spark.createDataFrame(rows, "id string, v string, received_at timestamp, m map<string,string>")
    got = {r.id: (r.v, r.m) for r in latest(df, "id", "received_at", ["v", "m"]).collect()}
    assert got == {"a": ("new", None), "b": ("y", None), "c": ("p", {"k": "2"}), None: ("n", None)}
    assert {r.id for r in latest(df.drop("received_at"), "id", "received_at", ["v"]).collect()} == {"a", "b", "c", None}


def test_components_over_buckets_like_brute_force(spark, monkeypatch):
    import random

    from loomtext.operators import spans

    monkeypatch.setattr(spans, "WIDTH", 7)
    rnd = random.Random(3)
    rows = [(k, i, a, a + rnd.randrange(4)) for k in "xy" for i, a in enumerate(rnd.choices(range(120), k=40))]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "k string, i int, lo int, hi int")
    got = {}
    for r in overlap_components(df, ["k"], "lo", "hi").collect():
        got.setdefault((r.k, r.component), []).append((r.lo, r.hi))
    want = []
    for k in "xy":
        top = None
        for _, _, lo, hi in sorted((r for r in rows if r[0] == k), key=lambda r: r[2:]):
            if top is None or lo > top:
                want.append([])
            want[-1].append((lo, hi))
            top = hi if top is None else max(top, hi)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
