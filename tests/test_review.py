import pytest

from loomtext.operators import review, transfer

DRAFT = "target_id string, base_revision int, value string"


def test_drafts(spark):
    assert review.empty_draft(spark).count() == 0
    d = spark.createDataFrame([("1", "line", "a", 0, "x", "me", None), ("1", "line", "a", 0, "y", None, None)], review.RECORD)
    assert {r[0] for r in review.draft_problems(d).collect()} == {"repeated id", "repeated target", "no provenance"}
    assert review.draft_problems(d.limit(0)).collect() == []
    lines = spark.createDataFrame([("a",), ("b",)], "line_id string")
    good = spark.createDataFrame([("b", 1), ("a", 2)], "line_id string, ord int")
    assert {tuple(r) for r in review.reorder(lines, good).collect()} == {("b", 1), ("a", 2)}
    with pytest.raises(Exception):
        review.reorder(lines, good.limit(1)).collect()


def test_conflicts(spark):
    base = spark.createDataFrame([("l1", 2, "x"), ("l2", 1, "y")], "target_id string, revision int, value string")
    d = spark.createDataFrame([("l1", 1, "A"), ("l2", 0, "B"), ("l3", 0, "C")], DRAFT)
    dec = spark.createDataFrame([("l1", "draft")], "target_id string, choice string")
    done, left = review.resolve_conflicts(base, d, dec)
    assert {tuple(r) for r in done.collect()} == {("l1", 2, "A"), ("l3", 0, "C")} and [r.target_id for r in left.collect()] == ["l2"]
    inc = spark.createDataFrame([("l1", 1, "A"), ("l2", 0, "Z"), ("l4", 0, "D")], DRAFT)
    m, left = review.resolve_import(d, inc, spark.createDataFrame([("l2", "incoming")], "target_id string, choice string"))
    assert {(r.target_id, r.value) for r in m.collect()} == {("l1", "A"), ("l2", "Z"), ("l3", "C"), ("l4", "D")} and left.collect() == []
    assert {(r.target_id, r.ok) for r in review.proposal_diff(base, d).collect()} == {("l1", False), ("l2", False), ("l3", True)}


def test_lines_and_readings(spark):
    lines = spark.createDataFrame([("a", "s", 1), ("b", "s", 5)], "line_id string, surface_id string, ord int")
    assert [r.ord for r in review.new_line(lines, "s", "n").where("line_id = 'n'").collect()] == [6]
    lay = spark.createDataFrame([("a", "xyx𐀀"), ("b", None)], "line_id string, text string")
    rd = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "q"), ("a", ""), ("b", "x"), ("a", "𐀀")], "line_id string, reading string")
    got = {(r.line_id, r.reading): (r.start_pos, r.end_pos, r.problem) for r in review.locate_reading(lay, rd).collect()}
    assert got == {("a", "y"): (1, 2, None), ("a", "x"): (None, None, "not unique"), ("a", "q"): (None, None, "not found"), ("a", ""): (None, None, "empty"), ("b", "x"): (None, None, "no line"), ("a", "𐀀"): (3, 4, None)}
    assert review.same_snapshot(lay, "no").first().same is False
    marks = spark.createDataFrame([("s", "l", 1, "a"), ("s", "l", 2, "b")], "surface string, line string, seq int, note string")
    assert review.bookmark(marks, ["surface", "line"], "seq").first().note == "b"


def test_transfer(spark):
    t = spark.createDataFrame([("k", i, w) for i, w in enumerate("a b a b c".split())], "key string, idx int, norm string")
    s = spark.createDataFrame([("u1", "k", ["b", "c"]), ("u2", "k", ["a", "b"]), ("u3", "k", [])], "unit_id string, key string, forms array<string>")
    assert [tuple(r) for r in transfer.exact_sequence(s, t).collect()] == [("u1", 3, 4)]
    u = spark.createDataFrame([("u1", "k", [0, 1]), ("u2", "k", [1, 2])], "unit_id string, key string, token_idxs array<int>")
    p = spark.createDataFrame([("k", 0, 5), ("k", 1, 6)], "key string, old_idx int, new_idx int")
    assert [(r.unit_id, r.token_idxs) for r in transfer.reanchor(u, p).collect()] == [("u1", [5, 6])]
    un = spark.createDataFrame([("u1", ["t1", "t2"]), ("u2", ["t3"])], "unit_id string, token_ids array<string>")
    assert {r.token_id for r in transfer.propagate_root(un, spark.createDataFrame([("t1",)], "token_id string")).collect()} == {"t1", "t2"}
    w = spark.createDataFrame([("k", "One two  three four"), ("m", "a a")], "key string, text string")
    pl = spark.createDataFrame([("k", 1, "1.1", "One two three"), ("k", 2, "1.2", "four"), ("m", 1, "1", "a"), ("m", 2, "2", "z")], "key string, ord int, number string, phrase string")
    ok, bad = transfer.plan_pieces(w, pl)
    assert {(r.number, r.start_pos, r.end_pos) for r in ok.collect()} == {("1.1", 0, 14), ("1.2", 14, 18)} and {(r.ord, r.problem) for r in bad.collect()} == {(1, "not unique"), (2, "not found")}
    tk = spark.createDataFrame([("t1", "a"), ("t2", "b"), ("t3", "c")], "token_id string, surface string")
    fz = spark.createDataFrame([("u1", "s", ["t1", "t2"], "a b"), ("u2", "s", ["t2"], "x"), ("u3", "s", ["t3"], "c"), ("u4", "s", ["t1"], "a")], "unit_id string, source_id string, token_ids array<string>, text string")
    tn = spark.createDataFrame([("u3", "s", "t9"), ("u9", "s", "t1")], "unit_id string, source_id string, token_id string")
    ok, bad = transfer.frozen_suggestions(fz, tk, tn)
    assert ok.collect() == [] and {(r.unit_id, r.reason) for r in bad.collect()} == {("u1", "overlaps"), ("u2", "changed"), ("u3", "overwrites"), ("u4", "overlaps")}
    words = "theg pa chen po dam chos rgyal po".split()
    pr = spark.createDataFrame([("k", words, ["x", *words], [("u1", 0, 4), ("u2", 3, 5), ("u3", 7, 7)])], "key string, a_tokens array<string>, b_tokens array<string>, spans array<struct<unit_id:string,lo:int,hi:int>>")
    assert [tuple(r) for r in transfer.parallel_transfer(pr, 10).collect()] == [("k", "u1", 1, 5)]
    mp = spark.createDataFrame([("c1", "k", [0, 1, 2, 3]), ("c2", "k", list(range(10, 30)))], "cell string, key string, token_idxs array<int>")
    us = spark.createDataFrame([("u1", "k", [0, 1]), ("u2", "k", [2, 3]), ("u3", "k", [10, 11])], "unit_id string, key string, token_idxs array<int>")
    assert {tuple(r) for r in transfer.table_anchors(mp, us).collect()} == {("u1", "c1"), ("u2", "c1")}
