"""Publishing, rules of new edits, drafts, ledgers, trees; Word files."""

import zipfile

import pytest
from pyspark.sql import functions as F

from loomtext.operators import edits
from loomtext.sources import office


def test_publish(spark):
    s = "id string, seq int, v string"
    sec = "id string, unit_id string, seq int, v string"
    pub = {"units": spark.createDataFrame([("a", 9, "old"), ("b", 1, "keep")], s), "section_edits": spark.createDataFrame([("1", "u", 1, "old"), ("x", None, 1, "byid")], sec), "text_edits": spark.createDataFrame([("p", "s", 1, "t0")], "passage string, source string, seq int, v string")}
    loc = {"units": spark.createDataFrame([("a", 1, "new"), ("a", 2, "newer"), ("c", 1, "c")], s), "section_edits": spark.createDataFrame([("2", "u", 0, "new")], sec), "alignments": spark.createDataFrame([("z", 1, "z")], s)}
    out, rest = edits.publish(pub, loc)
    rows = lambda n: sorted((r.id, r.v) for r in out[n].collect())
    assert rows("units") == [("a", "newer"), ("b", "keep"), ("c", "c")] and rows("section_edits") == [("2", "new"), ("x", "byid")] and rows("alignments") == [("z", "z")] and out["text_edits"].count() == 1
    assert set(rest) == set(loc) and all(d.count() == 0 for d in rest.values())


def test_rules_of_new_edits(spark):
    a = spark.createDataFrame([("1", {"san": ["t1"], "eng": ["e1"]}), ("2", {"eng": ["e1"], "deu": ["d"]}), ("3", {"san": ["t1"], "eng": []}), ("4", None), ("5", {"san": None, "eng": ["e"]})], "id string, targets map<string,array<string>>")
    ok, bad = edits.checked_alignments(a, "san")
    assert [r.id for r in ok.collect()] == ["1"] and {tuple(r) for r in bad.collect()} == {("2", "no base token"), ("3", "one source only"), ("4", "no base token"), ("5", "no base token")}
    units = spark.createDataFrame([("p", "u1", "s", ["t1", "t2"]), ("p", "u2", "s", ["t3"])], "passage string, unit_id string, source string, token_ids array<string>")
    m = [("1", "p", {"s": ["t1"]}, "u2"), ("2", "p", {"s": ["t1", "t2"]}, "u1"), ("3", "p", {"s": ["t1", "t3"]}, "u1"), ("4", "p", {"s": ["t1"], "x": ["y"]}, "u1"), ("5", "p", {"s": ["t1"]}, "zz"), ("6", "p", {"s": ["free"]}, "u1"), ("7", "p", None, "u1")]
    ok, bad = edits.checked_moves(spark.createDataFrame(m, "id string, passage string, targets map<string,array<string>>, to_unit string"), units)
    assert {(r.id, tuple(r.from_units)) for r in ok.collect()} == {("1", ("u1",)), ("3", ("u1", "u2")), ("6", ())}
    assert {tuple(r) for r in bad.collect()} == {("2", "already there"), ("4", "not one source"), ("5", "unknown unit"), ("7", "not one source")}
    t = "passage string, source string, text string"
    d = "passage string, source string, id string, text string"
    base, pub = spark.createDataFrame([("p", "a", "base"), ("p", "b", "base")], t), spark.createDataFrame([("p", "b", "pub")], t)
    drafts = spark.createDataFrame([("p", "a", "d1", "x"), ("p", "b", "d2", "y"), ("q", "a", "d3", "z")], d)
    new = spark.createDataFrame([("p", "a", "n1", "base"), ("p", "b", "n2", "base"), ("p", "c", "n3", "w"), ("p", "e", "n4", "")], d)
    assert {tuple(r) for r in edits.text_edit_drafts(drafts, base, pub, new).collect()} == {("q", "a", "d3", "z"), ("p", "b", "d2", "base"), ("p", "c", "n3", "w")}
    loc, known = spark.createDataFrame([("l1", "v", None)], "id string, value string, supersedes string"), spark.createDataFrame([("l1",), ("k1",)], "id string")
    n = spark.createDataFrame([("n1", "l1", "v2"), ("n2", "k1", "v3"), ("n3", None, "v4")], "id string, existing_id string, value string")
    assert {tuple(r) for r in edits.entry_drafts(loc, known, n).collect()} == {("l1", "v2", None), ("n2", "v3", "k1"), ("n3", "v4", None)}


def test_append_refuses_another_record(spark):
    s = "id string, v string, w string"
    have = spark.createDataFrame([("1", "a", None)], s)
    assert edits.appended(have, spark.createDataFrame([("1", "a", None), ("2", None, "b"), ("2", None, "b")], s), ["id"]).count() == 2
    with pytest.raises(Exception, match="a different record exists: 1"):
        edits.appended(have, spark.createDataFrame([("1", "a", "x")], s), ["id"]).collect()


def test_draft_history(spark):
    s = "id string, kind string, target_id string, base_revision int, revision int, value string, author string, created_at string, updated_at string, history array<string>"
    d = spark.createDataFrame([], s)
    base = spark.createDataFrame([("l1", 3)], "target_id string, revision int")
    step = lambda d, t, v, at: edits.draft_with(d, base, spark.createDataFrame([("line", t, v, "me", at)], "kind string, target_id string, value string, author string, at string"))
    d = step(step(step(d, "l1", "a", "1"), "l2", "b", "2"), "l1", "c", "3")
    got = {r.target_id: r for r in d.collect()}
    assert (got["l1"].id, got["l1"].base_revision, got["l1"].revision, got["l1"].value, got["l1"].created_at, got["l1"].updated_at, got["l1"].history) == ("draft-l1", 3, 4, "c", "1", "3", ["a"])
    assert (got["l2"].base_revision, got["l2"].revision, got["l2"].history) == (0, 1, [])


BASE = "manuscript_id string, version string, target_id string, revision int, value string"
EVENTS = "manuscript_id string, seq int, event_id string, proposal_id string, base_version string, previous_version string, decision string, reviewer string, note string"
CHANGES = "manuscript_id string, event_id string, target_id string, base_revision int, value string"


def test_ledgers(spark):
    base = spark.createDataFrame([(m, "1", "l1", 2, "x") for m in "abcdefg"], BASE)
    e = lambda m, n, d="accepted", prev="1", pro=None, base="1", note="ok", ev=None: (m, n, ev or f"e{n}", pro or f"p{n}", base, prev, d, "r", note)
    ev = [e("a", 1), e("a", 2, "rejected", "1+review.e1"), e("a", 3, prev="1+review.e1"), e("b", 1), e("b", 2, prev="1"), e("c", 1), e("c", 2, prev="1+review.e1", pro="p1"), e("d", 1), e("e", 1, note=" "), e("f", 1, base="0")]
    ch = [("a", "e1", "l1", 2, "y"), ("a", "e2", "l1", 3, "no"), ("a", "e3", "new", 0, "n"), ("a", "e3", "l1", 3, "z"), ("b", "e1", "l1", 2, "y"), ("b", "e2", "l1", 3, "y"), ("c", "e1", "l1", 2, "y"), ("d", "e1", "l1", 1, "y"), ("e", "e1", "l1", 2, "y"), ("f", "e1", "l1", 2, "y")]
    events, changes = spark.createDataFrame(ev, EVENTS), spark.createDataFrame(ch, CHANGES)
    got = {}
    for r in edits.apply_ledger(base, events, changes).collect():
        got.setdefault(r.manuscript_id, []).append((r.version, r.problem, r.target_id, r.revision, r.value))
    assert got["a"] == [("1+review.e3", None, "l1", 4, "z"), ("1+review.e3", None, "new", 1, "n")]
    assert {m: v[0] for m, v in got.items() if m != "a"} == {m: ("1", p, "l1", 2, "x") for m, p in dict(b="chain", c="second decision", d="conflict", e="provenance", f="base version", g=None).items()}
    new = lambda m, p: spark.createDataFrame([(m, "e9", p, "returned", "r", "n")], "manuscript_id string, event_id string, proposal_id string, decision string, reviewer string, note string")
    after = edits.decide(base, events, changes, new("a", "p9"))
    assert [(r.seq, r.previous_version) for r in after.where("event_id = 'e9'").collect()] == [(4, "1+review.e3")]
    for m, p, what in (("a", "p1", "has a decision"), ("b", "p9", "faulty ledger: chain"), ("zz", "p9", "unknown manuscript")):
        with pytest.raises(Exception, match=what):
            edits.decide(base, events, changes, new(m, p)).collect()


def test_trees(spark):
    n = spark.createDataFrame([("r", None, 1), ("b", "r", 2), ("a", "r", 1), ("c", "a", None), ("x", "y", 1), ("y", "x", 1), ("o", "nowhere", 0)], "id string, parent_id string, ord int")
    assert {tuple(r) for r in edits.descendants(n, "x").collect()} == {("x", 0), ("y", 1)}  # a cycle ends
    assert edits.descendants(n, "none").collect() == []
    assert [(r.id, r.depth) for r in edits.unit_tree(n, "ord").orderBy("path").collect()] == [("o", 0), ("r", 0), ("a", 1), ("c", 2), ("b", 1)]
    assert {r.id for r in edits.without_subtree(n, "a").collect()} == {"r", "b", "x", "y", "o"}
    deep = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(12)], "id string, parent_id string")
    assert edits.descendants(deep, "0").agg(F.max("depth")).first()[0] == 11


def _docx(path, body):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")


def test_word_files(spark, tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr>"
    _docx(tmp_path / "a.docx", p("one") + p(" ") + "<w:p><w:r><w:t>two</w:t><w:tab/><w:t>x</w:t><w:br/></w:r></w:p><w:tbl>" + row("A", "B", "verse") + row("a0", "b0", "x") + row("a1", " ", "(1)") + row("a2", "b2", "( 2ab )") + row("a3", "b3", "(1)") + row("", "b4", "(3)") + "</w:tbl>")
    assert [(r.no, r.text) for r in office.read_docx_paragraphs(spark, str(tmp_path / "*.docx")).collect()] == [(0, "one"), (1, "two\tx\n")]
    t = office.read_docx_tables(spark, str(tmp_path / "*.docx"))
    got = {(r.source, r.verse): r.text for r in office.verse_table(t, {"s": 0, "t": 1}, 2).collect()}
    assert got == {("s", 1): "a0\n\na1", ("t", 1): "b0", ("s", 2): "a2\n\na3", ("t", 2): "b2\n\nb3", ("t", 3): "b4"}
    d = spark.createDataFrame([("a hy-\n phen and - \n dash  x\ny",), (None,)], "t string")
    assert [r.x for r in d.select(office.dehyphenated(F.col("t")).alias("x")).collect()] == ["a hyphen and - \n dash x\ny", None]
