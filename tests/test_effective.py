"""Edited witnesses, units and phrase alignments."""

import pytest

from loomtext.operators import effective as E

UNITS = "passage string, unit_id string, number string, label string, ord bigint, level string, note string, status string"
TARGETS = "passage string, unit_id string, source string, token_ids array<string>, text string"
MOVES = "passage string, source string, token_ids array<string>, selected_text string, to_unit string, seq int"
SECTIONS = "passage string, unit_id string, number string, label string, ord bigint, level string, note string, target_texts map<string,string>, version int, deleted boolean, seq int"
TEXT = "passage string, source string, text string"


def ids(*n, p="v1", s="a"):
    return [f"{p}-{s}-t{i:05d}" for i in n]


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([("v1", "a", "one two three. four five six"), ("v1", "b", "eins zwei drei"), ("v2", "a", None), ("v2", "b", "")], TEXT)


def test_effective_witnesses(spark, base):
    published = spark.createDataFrame([("v1", "a", "published"), ("v1", "b", "Eins 1.1. zwei drei vier")], TEXT)
    local = spark.createDataFrame([("v1", "a", "one new two three, four five six"), ("v3", "a", "made up")], TEXT)
    w = {(r.passage, r.source): r for r in E.effective_witnesses(base, published, local).collect()}
    assert len(w) == 5 and not w["v2", "a"].edited and w["v2", "a"].tokens == [] and w["v3", "a"].token_map == {}
    a = w["v1", "a"]
    assert a.text.startswith("one new") and a.edited and a.token_map == dict(zip(ids(1, 2, 3, 4, 5, 6), ids(1, 3, 4, 5, 6, 7)))
    assert w["v1", "b"].token_map == dict(zip(ids(2, 3, s="b"), ids(4, 5, s="b")))
    wanted = spark.createDataFrame([("v1", "a", "x", "two three, four"), ("v1", "a", "y", "nowhere"), ("v1", "a", "z", None), ("v9", "a", "q", "one"), ("v1", "a", "l", "1.1. six")], "passage string, source string, k string, wanted string")
    got = {r.k: r.token_ids for r in E.exact_spans(wanted, E.effective_witnesses(base, published, local)).collect()}
    assert got == {"x": ids(3, 4, 5), "y": [], "z": [], "q": [], "l": ids(7)}


def test_a_witness_travels_once_for_all_its_wordings(spark, base):
    """Its tokens stood in the row of every wording before, and all of those waited on disk for Python."""
    w = E.witnesses(base)
    rows = [("v1", "a", f"k{i}", x, i) for i, x in enumerate(["one", "two three.", "four five six", "six one", "", None, "one two three four five six"])] + [(None, "a", "n", "one", 7), ("v2", "a", "e", "one", 8), ("v1", None, "m", "one", 9)]
    wanted = spark.createDataFrame(rows, "passage string, source string, k string, wanted string, n int")
    got = E.exact_spans(wanted, w)
    assert got.columns == ["passage", "source", "k", "wanted", "n", "token_ids"] and got.count() == 10
    assert {r.k: r.token_ids for r in got.collect() if r.token_ids} == {"k0": ids(1), "k1": ids(2, 3), "k2": ids(4, 5, 6), "k6": ids(1, 2, 3, 4, 5, 6)}
    seen = E.gathered(wanted, E.KEY)
    assert seen.where("passage = 'v1' and source = 'a'").count() == 1 and seen.count() == 4
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("_only_places") < plan.index("Join")  # the search stands over one row per witness: it is joined after gathering
    assert "collect_list" in plan[plan.index("Join"):]


def test_units_through_all_edits(spark, base):
    none = spark.createDataFrame([], TEXT)
    eff = E.effective_witnesses(base, none, none)
    units = spark.createDataFrame([("v1", f"dharmanexus-{n}", f"1.{n}", None, n, "sentence", None, "dharmanexus-authorized") for n in range(1, 5)], UNITS)
    t = [("v1", "dharmanexus-1", "a", ids(1, 2, 3), "one two three"), ("v1", "dharmanexus-2", "a", ids(4, 5), "four five"), ("v1", "dharmanexus-3", "a", ids(6), "six"),
         ("v1", "dharmanexus-4", "b", ids(1, s="b"), "eins"), ("v1", "dharmanexus-1", "b", ids(2, s="b"), "zwei")]
    targets = spark.createDataFrame(t, TARGETS)
    moves = spark.createDataFrame([("v1", "a", ids(3), "", "sentence-2", 1), ("v1", "a", ids(3, 4), "", "dharmanexus-3", 2), ("v1", "a", ids(4), "", "nowhere", 3), ("v1", "a", None, "", "dharmanexus-1", 4)], MOVES)
    sections = spark.createDataFrame([
        ("v1", "sentence-2", "2.7", "", None, None, "n", {"a": "five"}, 1, False, 1), ("v1", "dharmanexus-4", None, None, None, None, None, None, 1, True, 2),
        ("v1", "new-1", "1.9", None, None, None, None, {"a": "not there", "b": "drei"}, 1, False, 3), ("v1", "dharmanexus-1", None, None, 50, None, None, {"b": "", "a": " "}, None, False, 4)], SECTIONS)
    u, g = E.effective_units(units, targets, eff, moves, sections)
    u = {r.unit_id: r for r in u.collect()}
    assert sorted(u) == ["dharmanexus-1", "dharmanexus-2", "dharmanexus-3", "new-1"]
    assert (u["dharmanexus-2"].number, u["dharmanexus-2"].label, u["dharmanexus-2"].ord, u["dharmanexus-2"].status, u["dharmanexus-2"].note) == ("2.7", "Section 2.7", 2, "editorial-section", "n")
    assert (u["new-1"].ord, u["new-1"].level) == (9, "sentence") and u["dharmanexus-1"].ord == 50 and u["dharmanexus-3"].status == "editorial-boundary"
    g = {(r.unit_id, r.source): (r.token_ids, r.text, r.literal) for r in g.collect()}
    assert g["dharmanexus-1", "a"] == (ids(1, 2), "one two", None)
    assert g["dharmanexus-2", "a"] == (ids(5), "five", "five")  # found again by its literal text
    assert g["dharmanexus-3", "a"] == (ids(3, 4, 6), "three. four … six", None)  # the last move of a token wins
    assert g["new-1", "a"] == ([], "", "not there") and g["new-1", "b"] == (ids(3, s="b"), "drei", "drei")
    assert g["dharmanexus-1", "b"][0] == ids(2, s="b") and not any(k == "dharmanexus-4" for k, _ in g)


def test_old_blanks_get_orphans_back(spark, base):
    none = spark.createDataFrame([], TEXT)
    # Both units lost their words to an edit's literal texts elsewhere or share an anchor: the first claim wins.
    eff = E.effective_witnesses(base, none, none)
    units = spark.createDataFrame([("v1", "u1", "1", None, 1, "sentence", None, "x"), ("v1", "u2", "2", None, 2, "sentence", None, "x"), ("v1", "gone", "3", None, 3, "sentence", None, "x")], UNITS)
    targets = spark.createDataFrame([("v1", "u1", "a", ids(1), "one"), ("v1", "u2", "a", ids(1), "one")], TARGETS)
    moves = spark.createDataFrame([("v1", "a", ids(1), "", "gone", 1)], MOVES)
    sections = spark.createDataFrame([("v1", "u1", None, None, None, None, None, {"a": ""}, None, False, 2), ("v1", "u2", None, None, None, None, None, {"a": ""}, None, False, 1),
                                      ("v1", "gone", None, None, None, None, None, None, None, True, 3)], SECTIONS)
    _, g = E.effective_units(units, targets, eff, moves, sections)
    assert {(r.unit_id, tuple(r.token_ids)) for r in g.collect()} == {("u2", tuple(ids(1)))}


def test_edited_text_moves_targets(spark, base):
    none = spark.createDataFrame([], TEXT)
    eff = E.effective_witnesses(base, none, spark.createDataFrame([("v1", "a", "zero one two three. four six")], TEXT))
    t = spark.createDataFrame([("v1", "u1", "a", ids(1, 2), "one two"), ("v1", "u2", "a", ids(4, 5), "four five"), ("v1", "u3", "b", ids(1, s="b"), "other")], TARGETS)
    by_text = {r.unit_id: r.token_ids for r in E.reanchor_alignments(t, eff, False).collect()}
    by_map = {r.unit_id: r.token_ids for r in E.reanchor_alignments(t, eff, True).collect()}
    assert by_text == by_map == {"u1": ids(2, 3), "u2": [], "u3": ids(1, s="b")}


def test_text_that_is_shown_and_literal_words(spark, base):
    none = spark.createDataFrame([], TEXT)
    eff = E.effective_witnesses(base, none, none)
    s = "passage string, unit_id string, source string, literal string, status string, sentence_edited boolean, token_ids array<string>, text string"
    rows = [("v1", "l", "a", "", "x", None, ids(1), "stored"), ("v1", "m", "a", None, "machine-segmented", None, ids(1), "stored"), ("v1", "e", "a", None, "machine-segmented", True, ids(1), "stored"),
            ("v1", "t", "a", None, "x", None, ids(1, 3), "stored"), ("v1", "s", "a", None, "x", None, None, "stored"), ("v9", "n", "a", None, None, None, None, None)]
    got = {r.unit_id: r.shown for r in E.target_text(spark.createDataFrame(rows, s), eff).collect()}
    assert got == {"l": "", "m": "stored", "e": "one", "t": "one … three", "s": "stored", "n": ""}
    lit = spark.createDataFrame([("v1", "u", "a", "1.1. five new one five.", ids(1, 5), 0), ("v1", "w", "a", None, ids(1), 0), ("v9", "x", "a", "q", None, 0)], "passage string, unit_id string, source string, literal string, token_ids array<string>, idx int")
    got = {(r.unit_id, r.idx): (r.surface, r.token_id) for r in E.literal_tokens(lit.drop("idx"), eff).collect()}
    assert got == {("u", 0): ("1", None), ("u", 1): ("1", None), ("u", 2): ("five", None), ("u", 3): ("new", None), ("u", 4): ("one", ids(1)[0]), ("u", 5): ("five", None), ("x", 0): ("q", None)}


def test_phrase_alignments(spark, base):
    none = spark.createDataFrame([], TEXT)
    eff = E.effective_witnesses(base, none, none)
    fields = UNITS + ", policy string"
    al = [("v1", "h1", None, None, 1, "sentence", None, "editorial", None), ("v1", "p1", None, None, 2, "sentence", None, "dharmanexus-authorized", None),
          ("v1", "p2", "1.4", None, 3, "phrase", None, "dharmanexus-authorized", None), ("v1", "d1", None, None, 4, "phrase", None, "editorial", None),
          ("v1", "tok", None, None, 5, "token-span", None, "editorial", None), ("v1", "shut", "1.4", None, 6, None, None, "x", "attested-only")]
    at = [("v1", "h1", "a", ids(1, 2), "one two", None), ("v1", "p1", "a", ids(2, 3), "two three", None), ("v1", "p2", "a", ids(5), "five", None), ("v1", "d1", "a", ids(6), "six", None), ("v1", "tok", "a", ids(1), "one", None)]
    bu = [("v1", "b1", "1.1", None, 1, "sentence", None, "x"), ("v1", "b2", "1.4", None, 2, "sentence", None, "x"), ("v1", "b3", "1.5", None, 3, "sentence", None, "x")]
    bt = [("v1", "b1", "a", ids(1), "one", None), ("v1", "b1", "b", ids(1, s="b"), "eins", None), ("v1", "b2", "a", ids(4), "four", None), ("v1", "b2", "b", None, None, "vier"), ("v1", "b3", "a", ids(6), "six", None)]
    t = TARGETS + ", literal string"
    sections = spark.createDataFrame([("v1", "d1", None, None, None, None, None, None, 1, True, 1), ("v1", "p2", "1.4", "L", 9, None, None, {"c": "text"}, 1, False, 1)], SECTIONS)
    u, g = E.phrase_alignments(spark.createDataFrame(al, fields), spark.createDataFrame(at, t), spark.createDataFrame(bu, UNITS), spark.createDataFrame(bt, t), sections, "a")
    rows = {r.unit_id: r for r in u.collect()}
    # p1 gives way to the human sentence h1, d1 is deleted, b1 shares a token with h1.
    assert sorted(rows) == ["b2", "b3", "h1", "p2", "shut"] and (rows["p2"].label, rows["p2"].ord, rows["p2"].status) == ("L", 9, "editorial-section")
    got = {(r.unit_id, r.source): (r.token_ids, r.text, r.literal) for r in g.collect()}
    assert got["h1", "b"] == (ids(1, s="b"), "eins", None)  # filled by a shared token
    assert got["p2", "b"] == ([], None, "vier") and got["p2", "c"][2] == "text"  # filled by number
    assert not any(k[0] == "shut" for k in got)
    place = {r.unit_id: r.place for r in E.ordered_phrases(u, g, eff, "a").collect()}
    assert [k for k, _ in sorted(place.items(), key=lambda x: x[1])] == ["h1", "b2", "p2", "b3", "shut"]
    assert E.phrase_alignments(*[d.limit(0) for d in (spark.createDataFrame(al, fields), spark.createDataFrame(at, t), spark.createDataFrame(bu, UNITS), spark.createDataFrame(bt, t), sections)], "a")[0].collect() == []
