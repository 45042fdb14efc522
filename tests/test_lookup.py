"""Lexical records, searches and selections."""

from pyspark.sql import functions as F

from loomtext.operators import effective as E
from loomtext.operators import lookup as L

LEX = "entry_id string, language string, lemma string, forms array<string>, curated boolean, priority int, ord int"


def test_glossary_matches(spark):
    lex = [("e1", "eng", "inner light", ["light"], False, None, 1), ("e2", "eng", "Light", None, True, None, 2), ("e3", "eng", "a/b", ["Ínner"], None, 5, 3), ("e4", None, None, None, None, None, 4),
           ("z1", "zho", "唯識", ["識"], None, None, 5), ("z2", "zho", "識", None, True, None, 6), ("n", "eng", "...", None, None, None, 7)]
    docs = [(1, "eng", "the INNER Light, a light of the inner", "x"), (2, "zho", "唯識 識 abc唯識", "x"), (3, "deu", "light", "x"), (4, "eng", None, "x"), (5, None, "light", "x"), (6, "eng", "", "x")]
    got = {(r.k, r.idx): (r.entry_id, r.start_idx, r.n_parts, r.matched_text) for r in L.glossary_matches(
        spark.createDataFrame(docs, "k int, lang string, text string, idx string"), "k", "lang", "text", spark.createDataFrame(lex, LEX)).collect()}
    assert got[1, 1] == got[1, 2] == ("e1", 1, 2, "INNER Light")  # most parts
    assert got[1, 4] == ("e2", 4, 1, "light")  # curated before the earlier entry
    assert got[1, 7] == ("e3", 7, 1, "inner")
    assert got[2, 0] == got[2, 1] == ("z1", 0, 2, "唯識") and got[2, 2][0] == "z2"
    assert {k for k, _ in got} == {1, 2}
    whole = spark.createDataFrame([("w", "zho", "abc唯識", None, None, None, 1)], LEX)
    one = L.glossary_matches(spark.createDataFrame([(1, "zho", "abc唯識")], "k int, lang string, text string"), "k", "lang", "text", whole).collect()
    assert [(r.idx, r.entry_id, r.matched_text) for r in one] == [(0, "w", "abc唯識")]
    assert L.glossary_matches(spark.createDataFrame([], "k int, lang string, text string"), "k", "lang", "text", spark.createDataFrame([], LEX)).collect() == []


def test_editorial_records(spark):
    e = [("a", "s", None, "Light", None, 1), ("b", "s", "t1", "light", None, 2), ("c", "s", "t9", "other", "light", 3), ("d", "x", None, "light", None, 4), ("b", "s", "t1", "gone", None, 0)]
    entries = spark.createDataFrame(e, "id string, source string, token_id string, surface string, normalized_surface string, seq int")
    t = spark.createDataFrame([("s", "t1", "LIGHT"), ("s", "t2", "ｌight"), ("s", "t3", "none"), ("x", "t1", "light"), ("s", "t4", None)], "source string, token_id string, surface string")
    got = {(r.source, r.token_id): r.record_id for r in L.editorial_records(t, entries).collect()}
    assert got == {("s", "t1"): "b", ("s", "t2"): "c", ("x", "t1"): "d"}


RECORDS = ("surface string, matched_text string, editorial struct<lemma:string,part_of_speech:string,morphology:string,reading:string,gloss:string,notes:string>, "
           "glossary struct<lemma:string,part_of_speech:string,reading:string,gloss:string,note:string,analysis:string,morphology:map<string,string>,status:string,curated:boolean,equivalents:map<string,array<string>>>")


def test_resolved_records_and_search(spark):
    rows = [("Ṣaṣ", "Ṣaṣ", ("", "NOUN", None, None, None, None), ("lem", "VERB", "r", "the Mirrör", "n", "gen", {"x": "no", "saṣ": "loc."}, None, True, {"deu": ["Spiegel"], "hin": None})),
            ("b", None, None, None), ("विज्ञान", None, ("L", None, "M", None, "g", "N"), (None, None, None, None, None, "gen", None, "text-critical", None, None))]
    df = spark.createDataFrame(rows, RECORDS)
    got = [(r.lemma, r.part_of_speech, r.reading, r.gloss, r.notes, r.morphology, r.status) for r in L.resolved_records(df).collect()]
    assert got == [("lem", "NOUN", "r", "the Mirrör", "n", "loc.", "draft"), ("", "", "", "", "", "", ""), ("L", "", "", "g", "N", "M", "text-critical")]
    find = lambda q: [r.surface for r in L.lexical_search(df, q).collect()]
    assert find("MIRROR") == ["Ṣaṣ"] and find("spiegel") == ["Ṣaṣ"] and find("vijñāna") == ["विज्ञान"] and len(find(" ́ ")) == 3 and find("zzz") == []


def test_selection_alignments(spark):
    sel = spark.createDataFrame([("s", "t1"), ("s", "t2"), ("s", "t3"), ("s", "t1"), ("q", "t9")], "sel_id string, token_id string")
    rev = spark.createDataFrame([("r1", ["t1", "t2"], "editorial"), ("r2", ["t3"], "dharmanexus-authorized"), ("r3", None, None)], "alignment_id string, token_ids array<string>, status string")
    cand = spark.createDataFrame([("c1", ["t2"]), ("c2", ["t3", "t4"]), ("c3", ["t9"])], "alignment_id string, token_ids array<string>")
    assert {tuple(r) for r in L.selection_alignments(sel, rev, cand).collect()} == {("s", "r1", "reviewed"), ("s", "c2", "candidate"), ("q", "c3", "candidate")}


def test_linked_terms(spark):
    text = "passage string, source string, text string"
    none = spark.createDataFrame([], text)
    eff = E.effective_witnesses(spark.createDataFrame([("v", "a", "one two three"), ("v", "b", "eins zwei drei")], text), none, none)
    i = lambda s, *n: [f"v-{s}-t{x:05d}" for x in n]
    rev = [("v", "long", "token-span", "a", i("a", 1, 2), 1), ("v", "long", "token-span", "b", i("b", 1, 2), 1), ("v", "short", "token-span", "a", i("a", 1), 2), ("v", "short", "token-span", "b", i("b", 1, 3), 2), ("v", "ph", "phrase", "a", i("a", 3), 3)]
    cand = [("v", "c", "a", i("a", 1, 3), 1), ("v", "c", "b", i("b", 3), 1)]
    r = spark.createDataFrame(rev, "passage string, alignment_id string, level string, source string, token_ids array<string>, ord int")
    c = spark.createDataFrame(cand, "passage string, alignment_id string, source string, token_ids array<string>, ord int")
    t = spark.createDataFrame([("v", "a", x) for x in i("a", 1, 2, 3, 9)], "passage string, source string, token_id string")
    got = {r.token_id: (r.alignment_id, r.source, r.text) for r in L.linked_terms(t, r, c, eff).collect()}
    assert got == {i("a", 1)[0]: ("short", "b", "eins … drei"), i("a", 2)[0]: ("long", "b", "eins zwei"), i("a", 3)[0]: ("c", "b", "drei")}


def test_annotations_defaults_and_fallback(spark):
    a = spark.createDataFrame([("1", "s", "p", "x", 1, "old"), ("2", "s", "p", "x", 2, "new"), ("2", "s", "p", "y", 3, "moved")], "id string, source string, passage string, sentence string, seq int, note string")
    assert {(r.sentence, r.note) for r in L.latest_annotations(a).collect()} == {("x", "old"), ("y", "moved")}
    c = spark.createDataFrame([("1", None, "", None), ("2", "phrase", "s", "high")], "id string, level string, status string, confidence string")
    assert [tuple(r)[1:] for r in L.with_candidate_defaults(c).orderBy("id").collect()] == [("token-span", "machine-suggested", "low"), ("phrase", "s", "high")]
    r = spark.createDataFrame([("g", 1, "ab"), ("g", 2, "b"), ("h", 1, "c"), ("h", 2, "b"), ("i", 1, "x"), ("i", 2, None)], "grp string, ord int, w string")
    got = {x.grp: x.ord for x in L.record_or_fallback(r, "grp", (F.col("grp") == "g") & (F.col("ord") == 2), F.col("w").contains("b"), "ord").collect()}
    assert got == {"g": 2, "h": 2, "i": 1}


def test_labels(spark):
    rows = [("x", None, None, None, "unreviewed-textual-match", None), ("x", None, True, None, "unreviewed-textual-match", None), ("x", "attested-only", None, None, None, True), ("x", "attested-only", True, None, None, None),
            ("dharmanexus-authorized", None, None, None, None, True), ("x", None, None, None, None, True), ("editorial-boundary", None, None, None, None, None), ("dharmanexus-authorized", None, None, "l", "draft-source-reading", None),
            ("machine-segmented", None, None, None, "other", None), (None, None, None, None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, status string, policy string, edited boolean, literal string, review string, root boolean")
    got = [r.x for r in df.orderBy("i").select(L.status_label(*map(F.col, ("status", "policy", "edited", "literal", "review", "root"))).alias("x")).collect()]
    assert got == ["text match · draft", "edited", "root · draft", "edited", "root · DharmaNexus", "root verse", "edited", "DharmaNexus base", "projected", "reviewed"]
    e = spark.createDataFrame([(None, None, None, None), ("e", 2, "dictionary-extract", True), ("e", 1, "text-critical", None), ("e", 0, None, True), ("e", None, "x", None)], "e string, tier int, status string, curated boolean")
    got = [tuple(r) for r in e.select(L.entry_origin(F.col("e"), F.col("tier")), L.glossary_origin(F.col("e"), F.col("status"), F.col("curated"))).collect()]
    assert got == [("Unannotated", "Unannotated"), ("Local draft", "Dictionary extract"), ("Published editorial record", "Text-critical working note"),
                   ("Imported corpus record", "Curated working glossary · draft"), ("Imported corpus record", "Corpus working entry · draft")]
