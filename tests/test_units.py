from loomtext.operators import units

UNITS = "unit_id string, bitext_id bigint, passage_id string, unit_number string, unit_order int, unit_status string, targets map<string,string>, target_token_ids map<string,array<string>>, mapping_methods map<string,string>"


def _targets(spark):
    rows = [("u1", 1, "v1", "1.1", 1, "reviewed", {"a": "x y"}, {"a": ["v1-a-t00001", "v1-a-t00002"], "b": None}, {"a": "manual"}),
            ("u2", 1, "v1", "1.2", 2, "unassigned", None, {"a": ["v1-a-t00002", "v1-a-t00004"]}, None), ("u3", 1, "v1", None, None, None, None, None, None),
            (None, 1, "v1", None, None, None, {"a": "q"}, None, None), ("u4", 2, "v1", None, 3, "unassigned", {"a": "z"}, {"a": ["odd", "odd"]}, None)]
    return units.unit_targets(spark.createDataFrame(rows + rows, UNITS))


def test_targets_and_problems(spark):
    t = _targets(spark)
    assert {(r.unit_id, r.witness, r.lo, r.hi, r.n_tokens) for r in t.collect()} == {("u1", "a", 1, 2, 2), ("u1", "b", None, None, 0), ("u2", "a", 2, 4, 2), ("u4", "a", None, None, 2)}
    assert {(r.unit_id, r.problem) for r in units.target_problems(t).collect()} == {("u2", "not contiguous"), ("u4", "repeated")}
    assert {(r.token_id, r.unit_id) for r in units.token_units(t).collect()} == {("v1-a-t00001", "u1"), ("v1-a-t00002", "u2"), ("v1-a-t00004", "u2"), ("odd", "u4")}


def test_effective_units(spark):
    u = spark.createDataFrame([("u1", "t1", 0), ("u1", "t2", 1), ("u2", "t3", 2)], "unit_id string, token_id string, idx int")
    m = spark.createDataFrame([("t2", "u9", 1), ("t2", "u2", 2)], "token_id string, to_unit string, seq int")
    s = spark.createDataFrame([("u1", True, 1), ("u2", True, 1), ("u2", False, 2)], "unit_id string, deleted boolean, seq int")
    assert {(r.unit_id, r.token_id) for r in units.effective_units(u, m, s).collect()} == {("u2", "t2"), ("u2", "t3")}


def test_unique_phrases_and_slices(spark):
    t = spark.createDataFrame([(1, "ab  cd ab"), (1, "ef"), (2, None), (3, "")], "k int, text string")
    p = spark.createDataFrame([(1, "b c"), (1, "ab"), (1, "ef"), (1, ""), (2, "x"), (1, None)], "k int, phrase string")
    assert {(r.phrase, r.start_pos) for r in units.unique_phrases(t, p, ["k"]).collect()} == {("b c", 1), ("ef", 0)}
    d = spark.createDataFrame([(1, "intro #1 one #2 two #1")], "k int, text string")
    assert [r.slice for r in units.marker_slices(d, "k", ["#1", "#2"]).orderBy("n").collect()] == ["#1 one ", "#2 two #1"]


def test_danda_sentences(spark):
    text = "(Vvs_3) namo | 12 | evam // x\n\n // 5 y"
    d = spark.createDataFrame([(1, text), (2, ""), (3, None)], "k int, text string")
    got = [text[r.start_pos : r.end_pos] for r in units.danda_sentences(d, "k", "text").orderBy("no").collect()]
    assert got == ["namo | 12 |", "evam //", "x", "5 y"]


def test_text_of_runs_and_groups(spark):
    t = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 3, 5), (1, 4, 9, 11)], "k int, idx int, start_pos int, end_pos int")
    x = spark.createDataFrame([(1, "aa bb ccdee")], "k int, text string")
    assert units.span_text(t, x, "k").first().span_text == "aa bb … ee"
    g = spark.createDataFrame([(1, i, f"s{i}") for i in range(3)], "k int, o int, text string")
    assert {(r.first, r.size, r.text) for r in units.context_groups(g, ["k"], "o", 2).collect()} == {(0, 1, "s0"), (1, 1, "s1"), (2, 1, "s2"), (0, 2, "s0 s1"), (1, 2, "s1 s2")}
    d = spark.createDataFrame([(1, "a b c etc. dd ee. ff gg hh ii! jj")], "k int, text string")
    assert [(r.lo, r.hi) for r in units.chunk_runs(units.gaps_after(d, "k", "text"), "k", 0).collect()] == [(0, 5), (6, 9)]


def test_override(spark):
    h = spark.createDataFrame([("h", ["t1"])], "unit_id string, token_ids array<string>")
    m = spark.createDataFrame([("m1", ["t1", "t2"]), ("m2", ["t3"]), ("m3", None)], "unit_id string, token_ids array<string>")
    assert {r.unit_id for r in units.override(h, m).collect()} == {"h", "m2", "m3"}


def test_chunks_need_eighteen_characters_of_wording(spark):
    rows = [(1, "a b c d q. The long sentence stays in here. x [Vasubandhu:] y z w. [12a] It is a full clause again"), (2, None), (3, "")]
    d = spark.createDataFrame(rows, "k int, text string")
    t = units.gaps_after(d, "k", "text")
    w = {r.idx: r.surface for r in t.where("k = 1").collect()}
    got = [" ".join(w[i] for i in range(r.lo, r.hi + 1)) for r in units.chunk_runs(t, "k").collect()]
    assert got == ["The long sentence stays in here", "12a It is a full clause again"]
