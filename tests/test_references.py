from datetime import datetime as dt

from loomtext.operators.references import apply_changes, current_orphans, existence_deltas, existence_periods, orphan_references

T = [None, *(dt(2031, m, 1) for m in range(1, 13))]
TARGET = "k string, created_at timestamp, deleted_at timestamp, reason string"
REFS = "id bigint, k string, at timestamp, period string"


def orphans(spark, refs, target, **more):
    r = spark.createDataFrame(refs, REFS)
    t = spark.createDataFrame(target, TARGET)
    return {tuple(x) for x in orphan_references(r, "id", "at", {"t": ("k", t, "k")}, **more).collect()}


def test_reasons(spark):
    target = [("a", T[2], T[4], None), ("a", T[2], T[4], None), ("a", T[6], None, None), ("b", None, None, None),
              ("c", T[5], T[3], None), ("", T[1], None, None), (None, T[1], None, None)]
    refs = [(1, "a", T[1], ""), (2, "a", T[2], ""), (3, "a", T[4], ""), (3, "a", T[4], ""), (4, "a", T[7], ""), (5, "b", T[3], ""),
            (6, "zz", T[3], ""), (7, "", T[3], ""), (8, None, T[3], ""), (9, "c", T[6], ""), (10, "a", None, "")]
    assert orphans(spark, refs, target) == {
        (1, "t", "2031-01", "late"), (3, "t", "2031-04", "deleted"), (5, "t", "2031-03", "late"),
        (6, "t", "2031-03", "missing"), (9, "t", "2031-06", "deleted"), (10, "t", None, "late")}


def test_empty_tables(spark):
    assert orphans(spark, [], []) == set()
    assert orphans(spark, [(1, "a", T[1], "")], []) == {(1, "t", "2031-01", "missing")}


def test_periods_merge_overlaps(spark):
    t = spark.createDataFrame([("a", T[1], T[3], None), ("a", T[2], T[5], None), ("a", T[7], None, None)], TARGET)
    got = {tuple(r) for r in existence_periods(existence_deltas(t, "k")).collect()}
    assert got == {("a", T[1], T[5]), ("a", T[7], None)}


def test_signed_state(spark):
    s = "ref_table string, ref_key string, n_refs bigint, n_rows bigint"
    a = spark.createDataFrame([("t", "x", 1, 0), ("t", "x", 1, 1), ("t", "y", 1, 0), ("t", None, 1, 0)], s)
    state = apply_changes(a.limit(0), a)
    assert {tuple(r) for r in current_orphans(state).collect()} == {("t", "y", 1)}
    b = spark.createDataFrame([("t", "x", 0, -1), ("t", "y", -1, 0)], s)
    assert {tuple(r) for r in current_orphans(apply_changes(state, b)).collect()} == {("t", "x", 2)}


def test_hot_keys_are_cut_by_hours(spark):
    import random

    rnd = random.Random(9)
    at = lambda: dt(2031, 1, rnd.randrange(1, 4), rnd.randrange(24), rnd.randrange(3))
    target = [(k, at(), at() if rnd.random() < 0.7 else None, None) for k in "abc" for _ in range(12)]
    refs = [(i, rnd.choice("abcd"), at(), "") for i in range(400)]
    got = orphans(spark, refs, target)
    assert got and got == orphans(spark, refs, target, hot=90) == orphans(spark, refs, target, hot=1)
    live = {(i, k, t) for i, k, t, _ in refs if any(k == x and c <= t and (d is None or d > t) for x, c, d, _ in target)}
    assert {i for i, *_ in got} == {i for i, *_ in refs} - {i for i, *_ in live}
