import pytest
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import align, edits, lexicon, manuscripts, spans, tokens
from loomtext.sources import conllu
from loomtext.streaming.edits import follow


@pytest.mark.parametrize("text,want", [
    ("rnam-par rig’s-", [("rnam-par", 0, 8), ("rig’s", 9, 14)]), ("abc唯識", [("abc唯識", 0, 5)]), ("唯abc", [("唯", 0, 1), ("abc", 1, 4)]),
    ("の色", [("の色", 0, 2)]), ("a𐀀b", [("a𐀀b", 0, 3)]), ("''x'", [("x", 2, 3)]), ("1.2.", [("1", 0, 1), ("2", 2, 3)]), ("", []), (None, [])])
def test_tokens_and_offsets(spark, text, want):
    df = spark.createDataFrame([(1, text, 9)], "doc_id int, text string, idx int")
    got = [(r.surface, r.start_pos, r.end_pos) for r in tokens.token_offsets(df, "doc_id", "text").orderBy("idx").collect()]
    assert got == want


def test_scalar_functions(spark):
    assert T.iast("संस्कार") == "saṃskāra" and T.letters_key("संस्कार") == "samskara" and T.letters_key("दुःख") == "duhkha"
    assert T.fold("  ÉṢa ") == "esa" and T.lexical_form("विज्ञान 識!") == "vijnana識"
    df = spark.createDataFrame([("a  \r\n\r\n\r\n b\t\n", "1.4", None, "_"), (None, None, 3, " 1.1, 2 "), ("", "x", None, None)], "t string, n string, o int, s string")
    r = df.select(T.clean_text(F.col("t")).alias("c"), T.unit_order(F.col("o"), F.col("n")).alias("k"), T.number_list(F.col("s")).alias("l")).collect()
    assert [x.c for x in r] == ["a\n\n b", None, ""] and [x.k for x in r] == [4, 3, 2**53 - 1] and [x.l for x in r] == [[], ["1.1", "2"], []]
    assert df.limit(1).select(T.highlight(F.lit("An Ant"), ["an", "ant"]).alias("h")).first().h == "<mark>An</mark> <mark>Ant</mark>"


def test_statistics_keep_empty_witnesses(spark):
    df = spark.createDataFrame([("a", "v1", "x y x"), ("a", "v2", ""), ("b", "v1", None), (None, None, "z")], "source string, passage_id string, text string")
    got = {r.source: tuple(r)[1:] for r in tokens.witness_statistics(df, "source", "passage_id", "text").collect()}
    assert got["a"] == (3, 2, 1, 0.666667, 3.0) and got["b"] == (0, 0, 0, 0.0, 0.0)


def test_longest_match_stays_in_passage(spark):
    t = spark.createDataFrame([(1, i, w) for i, w in enumerate("the inner light of the inner".split())] + [(2, 0, "light")], "doc_id int, idx int, norm string")
    lx = spark.createDataFrame([("e1", "inner light", ["light"]), ("e2", "inner", None), ("e3", "a/b", ["inner light"]), ("e4", None, None)], "entry_id string, lemma string, forms array<string>")
    got = {(r.doc_id, r.idx): (r.entry_id, r.n_parts) for r in lexicon.longest_matches(t, lx).collect()}
    assert got == {(1, 1): ("e1", 2), (1, 2): ("e1", 2), (1, 5): ("e2", 1), (2, 0): ("e1", 1)}
    assert lexicon.longest_matches(t.limit(0), lx).collect() == [] and lexicon.longest_matches(t, lx.limit(0)).collect() == []


def test_overlaps(spark):
    rows = [(i, *s) for i, s in enumerate([(0, 5), (3, 8), (9, 10), (10, 12)])]
    c = spans.overlap_components(spark.createDataFrame([("k", *r) for r in rows], "k string, i int, lo int, hi int"), ["k"], "lo", "hi")
    assert {r.i: r.component for r in c.collect()} == {0: 1, 1: 1, 2: 2, 3: 2}
    s = "passage_id string, source_id string, unit_id string, ord int, number string, lo int, hi int, method string"
    p = "dharmanexus-target:x"
    d = [("v", "a", "u1", 1, "1.1", 0, 4, p), ("v", "a", "u2", 2, "1.2", 4, 6, p),  # neighbours of the provider share the union
         ("v", "a", "u3", 3, "1.3", 10, 12, "x"), ("v", "a", "u5", 5, "1.5", 10, 12, "y"),  # identical spans share
         ("v", "a", "u6", 6, "1.6", 20, 25, "explicit-semantic-1"), ("v", "a", "u7", 7, "1.7", 25, 28, p),  # best method stays
         ("v", "a", "u8", 8, "1.8", 30, 35, "x"), ("v", "a", "u9", 9, "1.9", 33, 38, "y"), ("v", "a", "u10", 10, "2.0", 50, 51, "x")]  # a tie withholds all
    got = {r.unit_id: (r.status, r.lo, r.hi) for r in spans.resolve_overlaps(spark.createDataFrame(d, s)).collect()}
    assert got == {"u1": ("shared", 0, 6), "u2": ("shared", 0, 6), "u3": ("shared", 10, 12), "u5": ("shared", 10, 12), "u6": ("kept", 20, 25),
                   "u7": ("withheld", 25, 28), "u8": ("withheld", 30, 35), "u9": ("withheld", 33, 38), "u10": ("kept", 50, 51)}


def test_edits(spark):
    log = spark.createDataFrame([("a", 1, 0), ("b", 1, 1), ("a", 2, 2)], "key string, v int, seq int")
    assert {(r.key, r.v) for r in edits.last_wins(log, ["key"], ["seq"]).collect()} == {("a", 2), ("b", 1)}
    base = spark.createDataFrame([("l1", 2, "x"), ("l2", 0, "y")], "target_id string, revision int, value string")
    ok = spark.createDataFrame([("l1", 2, "X"), ("new", 0, "N")], "target_id string, base_revision int, value string")
    bad = spark.createDataFrame([("l1", 1, "X"), ("l2", 0, "Y")], "target_id string, base_revision int, value string")
    assert {tuple(r) for r in edits.apply_draft(base, ok).collect()} == {("l1", 3, "X"), ("l2", 0, "y"), ("new", 1, "N")}
    assert {tuple(r) for r in edits.apply_draft(base, bad).collect()} == {tuple(r) for r in base.collect()}
    assert [tuple(r) for r in edits.draft_conflicts(base, bad).collect()] == [("l1", 1, 2)]
    assert {(r.target_id, r.status) for r in edits.merge_drafts(ok, bad).collect()} == {("l1", "same"), ("new", "local"), ("l2", "added")}
    ev = spark.createDataFrame([("m", 1, "r1", "1", "1", "accepted"), ("m", 2, "r2", "1", "1+r1", "rejected"), ("m", 3, "r3", "1", "1", "accepted"), ("m", 4, "r1", "1", "1+r1", "accepted")],
                               "manuscript_id string, seq int, event_id string, base_version string, previous_version string, decision string")
    assert [r.problem for r in edits.fold_ledger(ev).collect()] == [None, None, "chain", "duplicate"]
    nodes = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("x", "y")], "id string, parent_id string")
    assert {tuple(r) for r in edits.descendants(nodes, "r").collect()} == {("r", 0), ("a", 1), ("b", 2)}


def test_stream_merge(spark, tmp_path):
    for n, rows in enumerate([[("a", 1, 1), ("b", 1, 1)], [("a", 3, 3), ("b", 0, 0)]]):
        spark.createDataFrame(rows, "key string, v int, seq int").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        q = follow(spark.readStream.schema("key string, v int, seq int").json(str(tmp_path / "in")), str(tmp_path / "state"), ["key"], ["seq"], str(tmp_path / "ck"))
        q.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "state" / "v=1")).select("key", "v").collect()}
    assert got == {("a", 3), ("b", 1)}


def test_alignment(spark):
    p = spark.createDataFrame([(1, "vijnapti matram etad".split(), "vijnapti matram xu etad".split()), (2, None, ["x"]), (3, [], [])], "k int, a_tokens array<string>, b_tokens array<string>")
    assert {(r.a_idx, r.b_idx) for r in align.matching_tokens(p, "k").collect()} == {(0, 0), (1, 1), (2, 3)}
    assert {(r.k, r.accepted) for r in align.transfer_ratio(p, "k").collect()} == {(1, True), (2, False), (3, False)}
    s = spark.createDataFrame([("g", 1, 1, 0.9), ("g", 1, 2, 0.8), ("g", 2, 1, 0.85), ("g", 2, 2, 0.1)], "grp string, a_id int, b_id int, score double")
    assert {(r.a_id, r.b_id) for r in align.greedy_pairs(s, "grp").collect()} == {(1, 1), (2, 2)}
    r = spark.createDataFrame([(1, list("abcd"), list("xaxbxd")), (2, None, None)], "k int, root array<string>, witness array<string>")
    assert [(x.k, x.witness_idx) for x in align.lcs_tokens(r, "k").collect()] == [(1, 1), (1, 3), (1, 5)]
    old = spark.createDataFrame([(1, i, w) for i, w in enumerate("a b c a d".split())], "k int, idx int, norm string")
    new = spark.createDataFrame([(1, i, w) for i, w in enumerate("z a b c a d".split())], "k int, idx int, norm string")
    assert {(x.old_idx, x.new_idx) for x in tokens.unique_context_pairs(old, new, "k").collect()} == {(i, i + 1) for i in range(5)}


def test_manuscripts_and_formats(spark):
    layers = spark.createDataFrame([("l1", "diplomatic", "a𐀀b", [("add", 1, 2), ("odd", 0, 1)])], "line_id string, layer string, text string, marks array<struct<type:string,start:int,end:int>>")
    var = spark.createDataFrame([("l1", "diplomatic", "variant", 0, 1, "old", "r")], "line_id string, layer string, category string, start_pos int, end_pos int, basis string, reading string")
    assert {(r.category, r.reading, r.stale) for r in manuscripts.apparatus(layers, var).collect()} == {("addition", "𐀀", False), ("variant", "r", True)}
    anchors = spark.createDataFrame([("a", ["l1", "l9"], ["v1"])], "anchor_id string, line_ids array<string>, passage_ids array<string>")
    assert [r.line_id for r in manuscripts.bundle("v1", layers, anchors).collect()] == ["l1"]
    assert [r.line_id for r in manuscripts.missing_references(layers, anchors).collect()] == ["l9"]
    t = spark.createDataFrame([("s", "two  words", 0, "t1", "two", "two", None), ("s", "two  words", 1, "t2", "words", "", "N")], "sent string, text string, idx int, token_id string, form string, lemma string, upos string")
    c = conllu.to_conllu(t, "sent", "text")
    assert c.first().conllu.split("\n")[:3] == ["# sent_id = s", "# text = two words", "1\ttwo\ttwo\t_\t_\t_\t_\t_\t_\tTokenId=t1"]
    assert [(r.id, r.form, r.upos) for r in conllu.parse_conllu(c, "sent", "conllu").collect()] == [("1", "two", "_"), ("2", "words", "N")]
    short = spark.createDataFrame([("s", "# x\n\n1\ta\n" + "\t".join("abcdefghijkl"))], "sent string, conllu string")
    assert [r.misc for r in conllu.parse_conllu(short, "sent", "conllu").collect()] == ["_", "j"]
    tei = conllu.to_tei(spark.createDataFrame([("s", 2, "b"), ("s", 1, "<a>&"), ("s", 3, None)], "s string, n int, t string"), "s", "n", "t").first().tei
    assert tei == '<div n="s"><l n="1">&lt;a&gt;&amp;</l><l n="2">b</l></div>'
    with pytest.raises(Exception):
        conllu.to_tei(spark.createDataFrame([("s", 1, "\x01")], "s string, n int, t string"), "s", "n", "t").collect()


def test_every_query_has_a_known_name():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_reanchor_query_uses_long_windows(spark, tmp_path):
    from loomtext.plans import corpus

    # Binary de Bruijn sequence: every window of three repeats, every window of five stands once.
    bits = "00000100011001010011101011011111" + "0000"
    text = " ".join({"0": "xa", "1": "yb"}[b] for b in bits)
    spark.createDataFrame([(1, text)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in corpus.reanchor_tokens(spark, str(tmp_path)).collect()] == [(1, 36, sum(range(36)))]
