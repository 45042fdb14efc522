"""Assigning, carrying and validating spans; the whole repair."""

import pytest
from pyspark.sql import functions as F

from loomtext.operators import anchors as A
from loomtext.operators.effective import witnesses
from loomtext.plans import workbench

BASE = "san_a"


def ids(s, *n, p="v1"):
    return [f"{p}-{s}-t{i:05d}" for i in n]


def target(unit, source, n, method, text="", number=None, ratio=None, group=None, review=None, p="v1"):
    k = int(unit[1:])
    return (p, unit, number or f"1.{k}", k, source, ids(source, *n, p=p) if n is not None else None, text, method, ratio, group, review)


@pytest.fixture(scope="module")
def wit(spark):
    rows = [("v1", BASE, "vijnapti matram evaidam asad arthavabhasanat yatha taimirikasya"), ("v1", "san_b", "vijnaptimatram evaidam asad arthavabhasanat yatha taimirikasya"),
            ("v1", "zho_x", "唯識無境界。以無塵妄見。如人目有翳"), ("v1", "zho_y", "（一）序\n唯識無境界 以無塵妄見 如人目有翳"), ("v1", "eng_c", "All this is mere appearance. Nothing else is here. It is seen here."), ("v2", BASE, None)]
    return witnesses(spark.createDataFrame(rows, "passage string, source string, text string"))


def frame(spark, rows):
    return spark.createDataFrame(rows, A.TARGET)


def new(spark, rows):
    return frame(spark, rows).drop("text")


def test_assign_and_remove(spark, wit):
    t = frame(spark, [target("u1", BASE, [1, 2], "m"), target("u1", "eng_c", [1], "old", "All")])
    out = A.assigned(t, new(spark, [target("u1", "eng_c", [5, 4, 3], "new", ratio=0.123456), target("u2", "eng_c", [7], "x")]), wit)
    got = {(r.unit_id, r.source): (r.token_ids, r.text, r.method, r.ratio) for r in out.collect()}
    assert got["u1", "eng_c"] == (ids("eng_c", 3, 4, 5), "is mere appearance", "new", 0.1235) and got["u2", "eng_c"][1] == "else" and len(got) == 3
    with pytest.raises(Exception, match="empty anchor"):
        A.assigned(t, new(spark, [target("u1", "eng_c", [99], "x")]), wit).collect()
    assert A.assigned(t, new(spark, [target("u1", "eng_c", [99], "x")]), wit, strict=False).count() == 2
    gone = spark.createDataFrame([("v1", "1.1", "eng_c")], "passage string, number string, source string")
    assert {r.source for r in A.removed(t, gone).collect()} == {BASE}
    want = spark.createDataFrame([("v1", "eng_c", "mere appear"), ("v1", "eng_c", "here"), ("v1", "eng_c", ""), ("v1", "none", "x"), ("v1", "eng_c", None)], "passage string, source string, wanted string")
    assert [r.token_ids for r in A.found_spans(want, wit).collect() if r.token_ids] == [ids("eng_c", 4, 5)]


def test_carried_editions_and_table(spark, wit):
    t = frame(spark, [target("u1", BASE, [1, 2], "m"), target("u2", BASE, [3, 4, 5], "m"), target("u3", BASE, [1], "m"), target("u4", BASE, [6, 7], "m")])
    got = {r.unit_id: (r.token_ids, r.ratio) for r in A.carried_editions(t, wit, BASE, ["san_b"]).collect()}
    assert got == {"u1": (ids("san_b", 1), 1.0), "u2": (ids("san_b", 2, 3, 4), 1.0), "u4": (ids("san_b", 5, 6), 1.0)}  # u3 would cut a token
    cells = spark.createDataFrame([("v1", 1, "vijnapti mātram evaidam asad arthavabhasanat", {"zho_x": "唯識無境界"}), ("v1", 2, "yatha taimirikasya", {"zho_x": "如人目有翳"}), ("v1", 3, "short", {"zho_x": "唯"}), ("v1", 4, None, None)],
                                  "passage string, cell int, needle string, texts map<string,string>")
    t = t.where("unit_id <> 'u3'")
    got = {(r.unit_id, r.source): (len(r.token_ids), r.group_id) for r in A.table_targets(t, wit, cells, BASE).collect()}
    assert got == {("u1", "zho_x"): (5, "table-1-zho_x"), ("u2", "zho_x"): (5, "table-1-zho_x"), ("u4", "zho_x"): (5, None)}
    finer = t.unionByName(frame(spark, [target("u1", "zho_x", [1], "explicit-a"), target("u2", "zho_x", [2], "explicit-a")]))
    assert {r.unit_id for r in A.table_targets(finer, wit, cells, BASE).collect()} == {"u4"}


def test_carried_translations(spark, wit):
    t = frame(spark, [target("u1", "zho_x", range(1, 6), "m"), target("u2", "zho_x", range(1, 6), "m"), target("u3", "zho_x", range(6, 11), "m"), target("u4", "zho_x", range(11, 16), "m"), target("u4", "zho_y", [18], "m")])
    got = {r.unit_id: (r.token_ids, r.review) for r in A.carried_translations(t, wit, [("zho_x", "zho_y", "Chinese")]).collect()}
    # The heading's two characters count as tokens but are not compared; u4 has a span there already.
    assert got == {"u1": (ids("zho_y", 3, 4, 5, 6, 7), "unreviewed-textual-match"), "u2": (ids("zho_y", 3, 4, 5, 6, 7), "unreviewed-textual-match"), "u3": (ids("zho_y", 8, 9, 10, 11, 12), "unreviewed-textual-match")}


def test_repair(spark, wit):
    t = frame(spark, [target("u1", BASE, [1, 2], "m"), target("u2", BASE, [3, 4, 5], "m"), target("u3", BASE, [6, 7], "m"), target("u1", "eng_c", [1, 2], "positional-projection"),
                      target("u2", "eng_c", [3], ""), target("u3", "eng_c", [9], "by-hand"), target("u3", "zho_x", [11, 12], "by-hand")])
    phrases = spark.createDataFrame([("v1", "eng_c", ["1.1"], "All this is mere appearance")], "passage string, source string, numbers array<string>, phrase string")
    semantic = spark.createDataFrame([("v1", "eng_c", ["1.2"], ids("eng_c", 5, 6, 7, 8), "explicit-semantic-1")], "passage string, source string, numbers array<string>, token_ids array<string>, method string")
    rejected = spark.createDataFrame([("v1", "1.3", "zho_x")], "passage string, number string, source string")
    sugg = spark.createDataFrame([("v1", "zho_x", ["1.3"], "如人目有翳", ids("zho_x", *range(11, 16)), "multilingual-semantic-suggestion-v1", 0.87654)], "passage string, source string, numbers array<string>, phrase string, token_ids array<string>, method string, score double")
    out, withheld, dropped = A.repaired(t, wit, BASE, editions=["san_b"], phrases=phrases, semantic=semantic, rejected=rejected, suggestions=sugg)
    got = {(r.unit_id, r.source): (r.text, r.method) for r in out.collect()}
    assert got["u1", "san_b"] == ("vijnaptimatram", "parallel-sanskrit:character-sequence") and got["u3", "zho_x"] == ("如人目有翳", "multilingual-semantic-suggestion-v1")
    # The semantic anchor overlaps the phrase anchor and has priority; the other is withheld.
    assert got["u2", "eng_c"] == ("appearance. Nothing else is", "explicit-semantic-1") and ("u1", "eng_c") not in got
    assert {(r.unit_id, r.source) for r in withheld.collect()} == {("u1", "eng_c")} and {(r.unit_id, r.source) for r in dropped.collect()} == {("u1", "eng_c"), ("u2", "eng_c")}
    assert A.target_violations(out, wit).collect() == [] and A.undeclared_drafts(out).collect() == []
    for bad, what in ((sugg.withColumn("numbers", F.array(F.lit("1.1"))).withColumn("token_ids", F.array()), "stale"), (sugg.withColumn("source", F.lit(BASE)), "overwrites")):
        with pytest.raises(Exception, match=what):
            A.suggested_targets(out.where("source <> 'zho_x'"), wit, bad).collect()
    with pytest.raises(Exception, match="ambiguous"):
        A.phrase_targets(t, wit, phrases.withColumn("phrase", F.lit("here"))).collect()


def test_violations(spark, wit):
    rows = [target("u1", "eng_c", [1, 2], "m", "All this"), target("u2", "eng_c", [2, 3], "m", "this is"), target("u3", "eng_c", [4, 6], "m", "mere"), target("u4", "eng_c", [7, 7], "a-projection-b", "else"),
            target("u5", "eng_c", [], "m"), target("u6", "eng_c", None, None), target("u7", "eng_c", [99], "m"), target("u8", "eng_c", [9], "m", "here", group="g"), target("u9", "eng_c", [10], "m", "It", group="g"),
            target("u1", "zho_x", [1], "m", "唯", group="s"), target("u2", "zho_x", [1], "m", "唯", group="s")]
    cand = spark.createDataFrame([("c1", "san_a"), ("c1", "san_b"), ("c2", "san_a"), ("c3", "san_a"), ("c3", "zho_x")], "unit_id string, source string")
    got = {(r.unit_id, r.problem) for r in A.target_violations(frame(spark, rows), wit, cand).collect()}
    assert got == {("u1", "unmarked overlap"), ("u2", "unmarked overlap"), ("u3", "noncontiguous"), ("u3", "text mismatch"), ("u4", "duplicate token ids"), ("u4", "noncontiguous"), ("u4", "projection retained"),
                   ("u5", "invalid token ids"), ("u6", "invalid token ids"), ("u7", "invalid token ids"), ("u8", "inconsistent group"), ("u9", "inconsistent group"), ("c2", "too few sources"), ("c3", "too few sources")}
    with pytest.raises(Exception, match="obsolete"):
        A.stamped(frame(spark, rows[6:7]), wit)[0].collect()
    drafts = frame(spark, [target("u1", "eng_c", [1], "parallel-witness:character-sequence"), target("u2", "eng_c", [2], "parallel-witness:character-sequence", review="unreviewed-textual-match")])
    assert [r.unit_id for r in A.undeclared_drafts(drafts).collect()] == ["u1"]


def test_inventories(spark, wit):
    text = "passage string, source string, text string"
    after = witnesses(spark.createDataFrame([("v1", "eng_c", "All this is mere illusion."), ("v1", "new", "x")], text))
    before = wit.where("source = 'eng_c'")
    got = {}
    for r in A.inventory_changes(before, after).collect():
        got.setdefault(r.change, set()).add((r.source, int(r.token_id[-2:])))
    assert got == {"changed": {("eng_c", 5)}, "lost": {("eng_c", i) for i in range(6, 14)}, "new": {("new", 1)}}
    assert {r.change for r in A.inventory_changes(before.unionByName(before), before).collect()} == {"duplicate"}
    t = frame(spark, [target("u1", "eng_c", [1], "m")])
    assert {(r.source, r.problem) for r in A.integration_changes(before, after, t, frame(spark, [target("u1", "eng_c", [2], "m")])).collect()} == {("eng_c", "text"), ("new", "added"), ("eng_c", "targets")}
    assert A.integration_changes(before, before, t, t).collect() == []


def test_a_witness_does_not_travel_with_each_of_its_units(spark, wit):
    """Its tokens were shuffled once for every unit when overlaps were resolved."""
    t = frame(spark, [target("u1", "eng_c", [1, 2], "m"), target("u2", "eng_c", [2, 3], "explicit-semantic-x"), target("u3", "eng_c", [5], "m"), target("u4", "none", [1], "m"), target("u5", "eng_c", None, "m")])
    kept, withheld = A.without_overlaps(t, wit)
    assert {r.unit_id: (r.token_ids, r.text) for r in kept.collect()} == {"u2": (ids("eng_c", 2, 3), "this is"), "u3": (ids("eng_c", 5), "appearance")}
    assert [r.unit_id for r in withheld.collect()] == ["u1"]
    want = spark.createDataFrame([("v1", "eng_c", "mere appear", 1), ("v1", "eng_c", "is", 2), ("v1", "eng_c", "All", 3), (None, "eng_c", "All", 4), ("v1", "zho_x", "。", 5)], "passage string, source string, wanted string, n int")
    assert {r.n: r.token_ids for r in A.found_spans(want, wit).collect() if r.token_ids} == {1: ids("eng_c", 4, 5), 3: ids("eng_c", 1)}
    for df in (kept, withheld, A.found_spans(want, wit), A.assigned(t.limit(0), new(spark, []), wit), A.stamped(kept, wit)[0]):
        for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines():
            assert "Join" not in line or "tokens" not in line
    plan = withheld._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") >= 1 and "array_contains" not in plan


def test_phrases_of_units_whose_targets_were_dropped(spark, wit):
    """Such a unit's phrase was lost, as was the order of anchors; a group of one was left over; an unknown number went unseen."""
    t = frame(spark, [target("u1", BASE, [1, 2], "m"), target("u2", "zho_x", [1, 2], "positional-projection")])
    rows = [("v1", "eng_c", ["1.2"], "All this", 1), ("v1", "eng_c", ["1.3", "1.2"], "Nothing else", 2), ("v1", "eng_c", ["1.3"], "All this is", 3), ("v1", "eng_c", ["1.2", "1.9"], "seen", 0)]
    phrases = spark.createDataFrame(rows, "passage string, source string, numbers array<string>, phrase string, seq int")
    units = spark.createDataFrame([("v1", f"u{k}", f"1.{k}", k) for k in (1, 2, 3)], "passage string, unit_id string, number string, ord bigint")
    out, withheld, _ = A.repaired(t, wit, BASE, phrases=phrases.where("seq > 0"), units=units)
    got = {(r.unit_id, r.source): (r.text, r.method, r.group_id) for r in out.collect()}
    assert got == {("u1", BASE): ("vijnapti matram", "m", None), ("u2", "eng_c"): ("Nothing else", A.PHRASE, None), ("u3", "eng_c"): ("All this is", A.PHRASE, None)}
    out, _, _ = A.repaired(t, wit, BASE, phrases=phrases.where("seq = 1"))
    assert {(r.unit_id, r.source) for r in out.collect()} == {("u1", BASE), ("u2", "eng_c")}
    with pytest.raises(Exception, match="unknown unit: eng_c 1.9"):
        A.phrase_targets(t, wit, phrases, units=units).collect()
    bad = phrases.unionByName(phrases.where("seq = 3").withColumn("phrase", F.lit("here")))
    out, withheld, _ = A.repaired(t, wit, BASE, phrases=bad, units=units, strict=False)
    assert {(r.unit_id, r.reason) for r in withheld.collect()} == {(None, "unknown unit"), ("u3", "ambiguous or missing phrase")}
    assert {(r.unit_id, r.text) for r in out.where("source = 'eng_c'").collect()} == {("u2", "Nothing else"), ("u3", "All this is")}


def test_repaired_alignment_anchors_the_plan_phrases(spark, tmp_path):
    """The query took no phrases from the plans."""
    de = ["Das Feuer brennt.", "Der Fluss steigt.", "Ein Vogel ruft.", "Die Lampe scheint."]
    en = ["The fire burns at night.", "The river rises at dawn.", "A bird calls at night.", "Now the lamp shines."]
    rows = [(f"u{i}", 1, f"1.{i}", i, "unassigned", "high", {"deu_a": x}) for i, x in enumerate(de, 1)] + [(f"e{i}", 1, None, i, "unassigned", "high", {"eng_b": x}) for i, x in enumerate(en, 1)]
    a = spark.createDataFrame(rows, "unit_id string, bitext_id bigint, unit_number string, unit_order int, unit_status string, confidence string, targets map<string,string>")
    a = a.withColumn("passage_id", F.lit("p")).withColumn("target_token_ids", F.create_map().cast("map<string,array<string>>")).withColumn("mapping_methods", F.create_map().cast("map<string,string>"))
    a.write.parquet(str(tmp_path / "alignments.parquet"))
    items = [["_", "The fire"], ["1.2", "The river rises"], ["1.3", "at night"], ["1.4", "Now the lamp"]]
    plan = ("p1", 1, "eng_b", {"1": items}, None)
    spark.createDataFrame([plan, plan], "plan_id string, bitext_id bigint, source_id string, passages map<string,array<array<string>>>, drafted_at timestamp").write.parquet(str(tmp_path / "semantic_plans.parquet"))
    got = {(r.source, r.method): (r.targets, r.tokens) for r in workbench.repaired_alignment(spark, str(tmp_path)).collect()}
    # e2 gives way to the phrase of 1.2, e4 was a projection and is dropped; 'at night' stands twice.
    assert got == {("deu_a", "found"): (3, 9), ("deu_a", "positional-projection"): (1, 3), ("eng_b", "found"): (2, 10), ("eng_b", A.PHRASE): (2, 6)}
