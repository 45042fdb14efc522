import pytest
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import manuscripts as M


@pytest.fixture(scope="module")
def package(spark):
    return {
        "surfaces": spark.createDataFrame([("s1", 100, 50), ("s2", 10, 10)], "surface_id string, width int, height int"),
        "regions": spark.createDataFrame([("r1", "s1", [0.0, 0.0, 10.0, 5.0]), ("r2", "s1", [95.0, 0.0, 10.0, 5.0]), ("r3", "s9", [0.0, 0.0, 1.0, 1.0])], "region_id string, surface_id string, xywh array<double>"),
        "lines": spark.createDataFrame([("l1", "s1", 1, "h1", ["r1"]), ("l2", "s1", 1, "h2", ["rx"]), ("l 3", "s8", 2, None, None)], "line_id string, surface_id string, ord int, hand string, region_ids array<string>").withColumn("script", F.lit("uchen")),
        "layers": spark.createDataFrame([("l1", "transliteration", "Theg pa ’dir", "draft", [("add", 0, 4), ("del", 3, 99)]), ("l2", "transliteration", "chos theg", "reviewed", None), ("l1", "diplomatic", None, None, None)],
                                        "line_id string, layer string, text string, status string, marks array<struct<type:string,start:int,end:int>>"),
        "anchors": spark.createDataFrame([("a1", ["l1"], ["v2"]), ("a2", ["l7"], ["v3"])], "anchor_id string, line_ids array<string>, passage_ids array<string>"),
        "annotations": spark.createDataFrame([("n1", "codicology", "draft", "Rubricated", [(None, "r1")]), ("n2", "correction", "reviewed", "struck", [("l2", None)])],
                                             "annotation_id string, type string, status string, text string, targets array<struct<line_id:string,region_id:string>>"),
    }


def test_search(package):
    p = {k: package[k] for k in ("lines", "layers", "annotations")}
    ids = lambda **k: sorted(r.line_id for r in M.search_package(**p, **k).collect())
    assert ids(query="THEG") == ["l1", "l2"] and ids(query="theg", hand="h1") == ["l1"] and ids(query="theg", status="reviewed") == ["l2"]
    assert ids(query="theg", field="diplomatic") == [] and ids(query="rubricated", field="notes") == ["l1"]
    assert ids(query="rubricated", field="notes", note_type="correction") == [] and ids(note_type="correction") == ["l2"] and ids(note_type="correction", status="draft") == []


def test_concordance_and_bundle(package):
    o = M.occurrences(package["layers"].where("text is not null"), "line_id", "text", 3)
    assert {(r.term, r.line_id, r.context) for r in o.where("term = 'theg'").collect()} == {("theg", "l1", "Theg pa"), ("theg", "l2", "os theg")}
    b = M.nested_bundle(package["lines"], package["surfaces"], package["anchors"], package["annotations"], ["l1"]).first()
    assert [x.line_id for x in b.lines] == ["l1"] and [x.surface_id for x in b.surfaces] == ["s1"] and [x.anchor_id for x in b.anchors] == ["a1"] and [x.annotation_id for x in b.annotations] == ["n1"]
    with pytest.raises(Exception):
        M.nested_bundle(package["lines"], package["surfaces"], package["anchors"], package["annotations"], ["zz"]).collect()


def test_problems(package):
    got = {tuple(r) for r in M.package_problems(*(package[k] for k in ("surfaces", "regions", "lines", "layers", "anchors"))).collect()}
    assert got == {("id format", "l 3"), ("region out of bounds", "r2"), ("region without surface", "r3"), ("line names no region", "l2"), ("line names no surface", "l 3"),
                   ("reading order", "l1"), ("mark span", "l1"), ("anchor names no line", "a2")}


def test_token_predicates(spark):
    d = spark.createDataFrame([("Vvs",), ("A",), ("XIV",), ("12",), ("dharma",), ("識",), ("12a",), (None,)], "t string")
    assert [r.t for r in d.where(T.alignable(F.col("t"))).collect()] == ["dharma", "識", "12a"]
    assert [r.t for r in d.where(T.lexically_eligible(F.col("t"), F.lit("bod"))).collect()] == ["Vvs", "dharma", "識"]
    assert [r.t for r in d.where(T.lexically_eligible(F.col("t"), F.lit("zho"))).collect()] == ["識"]
    assert T.lexical_parts("Theg pa", "bod") == ["theg", "pa"] and T.lexical_parts("唯識", "zho") == ["唯", "識"]
    x = spark.createDataFrame([("a b\nc",), ("abc abc",), (None,)], "t string")
    assert [r.p for r in x.select(T.locate_loosely(F.col("t"), "a bc").alias("p")).collect()] == [0, None, None]
    assert x.limit(1).select(T.without_labels(F.lit("x [Objection:]  y")).alias("p")).first().p == "x y"
    u = spark.createDataFrame([("https://a.org/x",), ("http://a.org",), ("nope",), (None,)], "u string")
    assert [r.ok for r in u.select(T.https_url(F.col("u"), ["a.org"]).alias("ok")).collect()] == [True, False, False, False]
