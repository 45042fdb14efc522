import json

from loomtext.sources import corpus_json, iiif, library


def test_corpus_round_trip(spark, tmp_path):
    doc = {"schemaVersion": "x", "sources": [{"id": "a", "label": "A"}], "alignments": [{"id": "u1", "number": "1.1"}],
           "passages": [{"id": "v1", "number": 1, "texts": {"a": {"text": "a𐀀b c", "tokens": [{"id": "t1", "start": 0, "end": 3}, {"id": "t2", "start": 4, "end": 5, "type": "syllable"}]}, "b": {"text": None, "tokens": []}}}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    t = corpus_json.read_corpus(spark, str(tmp_path / "c.json"))
    assert [(r.surface, r.type) for r in t["tokens"].orderBy("idx").collect()] == [("a𐀀b", "word"), ("c", "syllable")]
    assert t["witnesses"].count() == 2 and t["sources"].first().id == "a"
    u = corpus_json.import_units(t["units"]).first()
    assert (u.level, u.status) == ("sentence", "reviewed")
    corpus_json.write_corpus(t, str(tmp_path / "out"))
    assert "surface" not in spark.read.parquet(str(tmp_path / "out/tokens")).columns


def test_witness_files(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps([{"verse": 1, "text": "x"}, {"verse": 2, "text": " "}]))
    r = corpus_json.read_segmented(spark, str(tmp_path / "w.json"))
    assert sorted(x.verse for x in corpus_json.missing_verses(r, 1, 3).collect()) == [2, 3]
    assert [x.verse for x in corpus_json.missing_verses(r, 1, 3, require_text=False).collect()] == [3]
    for d in "ab":
        (tmp_path / d).mkdir()
        (tmp_path / d / "source.json").write_text(json.dumps({"id": "same"}))
    s, twice = corpus_json.discover_sources(spark, str(tmp_path / "*/source.json"))
    assert s.count() == 2 and twice.first().id == "same"


def test_located_targets(spark):
    u = spark.createDataFrame([("u1", "v", "a", "B c", "a b C d"), ("u2", "v", "a", "zz", "a b"), ("u3", "v", "a", "", "a")], "unit_id string, passage_id string, source_id string, target string, text string")
    t = spark.createDataFrame([("v", "a", f"t{i}", i, 2 * i, 2 * i + 1) for i in range(4)], "passage_id string, source_id string, token_id string, idx int, start_pos int, end_pos int")
    assert [(r.unit_id, r.token_ids) for r in corpus_json.locate_targets(u, t).collect()] == [("u1", ["t1", "t2"])]


def test_library(spark):
    b = spark.createDataFrame([("c", "b1", "hello"), ("c", "b2", "wide world")], "component_id string, block_id string, text string")
    f = spark.createDataFrame([("v", "s", 2, "c", "b2", 5, 10), ("v", "s", 1, "c", "b1", None, None), ("v", "s", 3, "c", "b1", 3, 99), ("v", "s", 4, "x", "b1", 0, 1)],
                              "passage_id string, source_id string, ord int, component_id string, block_id string, start_pos int, end_pos int")
    assert library.passage_texts(f, b).first().text == "hello\n\nworld"
    assert {r.problem for r in library.fragment_problems(f, b).collect()} == {"bounds", "unknown block"}
    a = spark.createDataFrame([("d", "c1", "x"), ("d", "c2", "y")], "document_id string, component_id string, content string")
    p = spark.createDataFrame([("d", "c1", "x"), ("d", "c2", "z"), ("d", "c3", "n"), ("q", "c1", "n")], "document_id string, component_id string, content string")
    merged, bad = library.merge_plan(a, p)
    assert {r.component_id for r in merged.collect()} == {"c1", "c2", "c3"} and [r.component_id for r in bad.collect()] == ["c2"]
    parts = spark.createDataFrame([("d", 1, "b1", "abcd"), ("d", 2, "b2", "efgh")], "doc string, ord int, block_id string, text string")
    cuts = spark.createDataFrame([("d", 2), ("d", 6)], "doc string, at int")
    assert {tuple(r) for r in library.split_at_markers(parts, cuts).collect()} == {("d", 1, "b1", 0, 2), ("d", 2, "b1", 2, 4), ("d", 2, "b2", 0, 2), ("d", 3, "b2", 2, 4)}
    t = spark.createDataFrame([("k", i, 3 * i, 3 * i + 2) for i in range(5)], "key string, idx int, start_pos int, end_pos int")
    s = spark.createDataFrame([("u", "k", 1, 0, 5), ("u", "k", 2, 9, 11), ("w", "k", 1, 0, 4), ("x", "k", 1, 2, 3), ("y", "k", 1, 0, 2), ("y", "k", 2, 3, 5)], "unit_id string, key string, no int, start_pos int, end_pos int")
    ok, bad = library.token_runs(s, t)
    assert {(r.unit_id, r.no, r.lo, r.hi) for r in ok.collect()} == {("u", 1, 0, 1), ("u", 2, 3, 3), ("y", 1, 0, 0)}
    assert {(r.unit_id, r.problem) for r in bad.collect()} == {("w", "cuts a token"), ("x", "empty"), ("y", "skips no token")}


def test_layout_and_canvases(spark):
    rows = [(1, 100.0, 5.0, 20.0, 5.0, 10.0, 0.0, "left "), (1, 100.0, 22.0, 40.0, 22.0, 12.0, None, "one"), (1, 100.0, 60.0, 80.0, 60.0, 11.0, 0.0, "right"), (1, 100.0, 5.0, 9.0, 5.0, 30.0, 0.0, "two"), (1, 100.0, 5.0, 9.0, 5.0, 60.0, 0.0, None)]
    df = spark.createDataFrame(rows, "page int, width double, x0 double, x1 double, x double, y double, slope double, text string")
    assert {(r.side, r.line, r.text) for r in iiif.layout_lines(df).collect()} == {("left", 1, "left one"), ("left", 2, "two"), ("right", 1, "right")}
    def canvas(k, w=10, url="https://x/i/", target="c", n=1):
        body = {"width": w, "height": 10, "service": [{"id": url, "type": "ImageService2"}]}
        return {"id": k, "width": 10, "height": 10, "label": {"en": ["L"]}, "items": [{"items": [{"target": target, "body": body}] * n}]}
    m = json.dumps({"items": [canvas("ok"), canvas("size", w=9), canvas("http", url="http://x"), canvas("part", target="c#xywh=1"), canvas("two", n=2)]})
    good, bad = iiif.canvases(spark.createDataFrame([(m,)], "j string"), "j")
    assert [(r.canvas_id, r.info, r.label) for r in good.collect()] == [("ok", "https://x/i/info.json", "L")]
    assert {r.canvas_id: r.reason for r in bad.collect()} == {"size": "other size", "http": "no image service", "part": "part of the canvas", "two": "not one image"}
