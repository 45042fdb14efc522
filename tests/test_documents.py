"""TEI documents, citations, overrides, drafts, clauses."""

import json
import xml.etree.ElementTree as ET

import pytest

from loomtext.operators import manuscripts as M
from loomtext.sources import conllu, library


def _manuscript(spark, text="a <b> c"):
    f = spark.createDataFrame
    return [
        f([("m", "T & <x>", "ed", "src"), ("n", None, None, None)], "manuscript_id string, title string, editor string, source string"),
        f([("m", "s2", 2, "2r", 10, 20, "u2"), ("m", "s1", 1, "1v", 10, 20, "u1?a=1&b")], "manuscript_id string, surface_id string, ord int, label string, width int, height int, url string"),
        f([("m", "r1", "s1", 1, 2, 3, 4)], "manuscript_id string, region_id string, surface_id string, x int, y int, w int, h int"),
        f([("m", "l3", "s2", 1, "c", "draft", None), ("m", "l2", "s1", 2, "b", "draft", ["r1"]), ("m", "l1", "s1", 1, "a", "draft", ["r1"])], "manuscript_id string, line_id string, surface_id string, ord int, label string, status string, region_ids array<string>"),
        f([("m", "l1", "diplomatic", text, "n", [("add", 0, 1, "r&"), ("del", 2, 5, None)]), ("m", "l2", "diplomatic", "𐀀x", None, None), ("m", "l3", "normalized", None, None, None)],
          "manuscript_id string, line_id string, layer string, text string, note string, marks array<struct<type:string,start:int,end:int,reason:string>>"),
        f([("m", "a1", "translates", ["l1", "l2"], ["v1"])], "manuscript_id string, anchor_id string, relation string, line_ids array<string>, passage_ids array<string>"),
        f([("m", "n1", "comment", "l1", "x < y")], "manuscript_id string, annotation_id string, type string, target string, text string"),
        f([("m", 2, "rejected", "2031", "me", "no"), ("m", 1, "accepted", "2030", "me", "yes")], "manuscript_id string, seq int, decision string, decided_at string, reviewer string, note string"),
    ]


def test_tei_documents(spark):
    got = {r.manuscript_id: r.tei for r in conllu.tei_documents(*_manuscript(spark)).collect()}
    t = "{http://www.tei-c.org/ns/1.0}"
    root = ET.fromstring(got["m"].encode())
    assert root.find(f".//{t}title").text == "T & <x>" and [c.get("type") for c in root.iter(t + "change")] == ["accepted", "rejected"]
    assert [s.get("n") for s in root.iter(t + "surface")] == ["1v", "2r"] and root.find(f".//{t}zone").get("lrx") == "4" and root.find(f".//{t}graphic").get("url") == "u1?a=1&b"
    xml_id = "{http://www.w3.org/XML/1998/namespace}id"
    assert [a.get(xml_id) for a in root.find(f".//{t}div[@type='physical-lines']")] == ["l1", "l2", "l3"]
    assert [d.get("subtype") for d in root.iter(t + "div") if d.get("type") == "transcription"] == ["diplomatic"]
    seg = root.find(f".//{t}seg")
    assert "".join(seg.itertext()) == "a <b> c" and [(x.tag[len(t):], x.text, x.get(xml_id)) for x in seg] == [("add", "a", "l1-diplomatic-mark-1"), ("del", "<b>", None)]
    assert [n.text for n in root.iter(t + "note") if n.get("type") == "reading-mark"] == ["r&"] and root.find(f".//{t}link").get("target") == "#l1 #l2 #v1"
    assert [s.text for s in root.iter(t + "seg")][1] == "𐀀x"
    assert ET.fromstring(got["n"].encode()).find(f".//{t}linkGrp") is None
    with pytest.raises(Exception, match="XML forbids"):
        conllu.tei_documents(*_manuscript(spark, "a\x01bcdef")).collect()


def test_citations(spark):
    s = "institution string, shelfmark string, surface string, line string, layer string, version string, editor string, annotation_id string, url string"
    df = spark.createDataFrame([("I", "S 1", "1v", "line 2", "diplomatic", "1+r", "ed", "n1", "https://x"), ("I", None, "1v", None, "d", "1", None, "", None)], s)
    assert [r.citation for r in M.citation(df).collect()] == ["I, S 1, 1v, line 2; diplomatic, 1+r, ed; annotation n1. https://x", "I, 1v, surface; d, 1. "]
    lines, anchors = spark.createDataFrame([("l1",), ("l1",), ("l2",)], "line_id string"), spark.createDataFrame([("a", ["l1", "l1", "l9"]), ("b", None)], "anchor_id string, line_ids array<string>")
    assert [tuple(r) for r in M.linked_anchors(lines, anchors).collect()] == [("l1", "a")]


def test_overrides_and_drafts(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"textEdits": [{"id": "1", "passageId": "v1", "sourceId": "s", "text": "x"}, {"id": "2", "passageId": "v2"}], "sectionEdits": [{"id": "q", "unitId": "u", "targetTexts": {"s": ""}, "extra": 1}], "units": []}))
    o = library.read_overrides(spark, str(tmp_path / "o.json"))
    assert [(r.seq, r.id, r.passageId) for r in o["textEdits"].collect()] == [(0, "1", "v1"), (1, "2", "v2")] and o["sectionEdits"].first().targetTexts == {"s": ""} and o["lexiconEntries"].count() == 0
    d = spark.createDataFrame([("1", "a")], "id string, v string")
    library.save_drafts({"units": d}, str(tmp_path / "d"))
    library.save_drafts({"units": d.withColumn("v", d.id)}, str(tmp_path / "d"))
    got = library.load_drafts(spark, str(tmp_path / "d"), {"units": "id string, v string", "never": "id string"})
    assert [tuple(r) for r in got["units"].collect()] == [("1", "1")] and got["never"].collect() == []


def test_clauses(spark):
    t = spark.createDataFrame([("s", "1", "One  clause here. Another one ,\n and the end. "), ("s", "2", "x x")], "source string, passage string, text string")
    c = [("s", "1", 1, [1], "One clause", None), ("s", "1", 2, [2, 3], "Another", None), ("s", "1", 3, [4], "and the", " ."), ("s", "2", 1, [1], "x", None), ("s", "3", 1, [1], "x", None)]
    schema = "source string, passage string, ord int, units array<int>, marker string, end_marker string"
    ok, bad = library.clause_mappings(t, spark.createDataFrame(c[:2] + [("s", "1", 3, [4], "and the", "end")] + c[3:], schema))
    text = t.first().text
    got = {(r.unit, r.group_id): text[r.start_pos:r.end_pos] for r in ok.collect()}
    assert got == {(1, None): "One  clause here.", (2, "s-1-2"): "Another one ,", (3, "s-1-2"): "Another one ,", (4, None): "and the"}
    assert {tuple(r) for r in bad.collect()} == {("s", "2", 1, "not unique"), ("s", "3", 1, "no text")}
    _, bad = library.clause_mappings(t, spark.createDataFrame([("s", "1", 1, [1], "Another", None), ("s", "1", 2, [2], "One", None), ("s", "1", 3, [3], "zzz", None), ("s", "1", 4, [4], "end", "One")], schema))
    assert {tuple(r)[2:] for r in bad.collect()} == {(1, "no end"), (2, "order"), (3, "not found"), (4, "no end")}
