from loomtext.llm.lookalike import canonical, forms, look, look_links, looking_equal


def test_forms_of_one_look():
    same = ["the cause", "the\u00a0cause", "thе cause", "the cau\u00adse", "ｔｈｅ cause", "the\u202fca\u200buse"]
    assert {look(s) for s in same} == {"the cause"}
    assert look("ṣ") == look("s\u0323") and look("а\u0304") == look("ā") and look("羅") == look("\uf90f") and look("⼼") == look("心")
    for a, b in [("a", "A"), ("x²", "x2"), ("ï", "i"), ("a b", "a  b"), ("a\nb", "a b"), ("ab", "ba"), ("–", "-"), ("①", "1")]:
        assert look(a) != look(b), (a, b)
    assert canonical("ＳTRAẞE x²") == canonical("strasse x2")
    assert canonical(None) is None and look("") == "" == look("\u200b")


def test_pairs_like_brute_force(spark):
    texts = ["the cause", "thе cause", "the cause", "the\u00a0cause", "The cause", None, "", "\u200b", "x" * 20000, "x" * 20000, "other"]
    rows = [("line" if i % 2 else "reading", f"k{i % 7}-{i}", t, "z") for i, t in enumerate(texts * 2)] + [("line", None, "the cause", "z")]
    df = spark.createDataFrame(rows + rows, "record_kind string, record_key string, text string, form string")
    got = [tuple(r) for r in looking_equal(df, "record_kind", "record_key", "text").collect()]
    want = {(k, a, b) for k, a, s, _ in rows for j, b, t, _ in rows
            if k == j and a and b and a < b and s is not None and t is not None and s != t and look(s) == look(t)}
    assert len(got) == len(set(got)) and set(got) == want
    assert forms(df, ["record_key"], "text").count() == df.count()
    links = {(r.record_kind, r.record_key): r.n_links for r in look_links(df, "record_kind", "record_key", "text").collect()}
    n = {}
    for k, a, b in want:
        for x in (a, b):
            n[k, x] = n.get((k, x), 0) + 1
    assert links == n


def test_empty(spark):
    df = spark.createDataFrame([], "record_kind string, record_key string, text string")
    assert looking_equal(df, "record_kind", "record_key", "text").collect() == [] == look_links(df, "record_kind", "record_key", "text").collect()


def test_a_hot_class(spark):
    rows = [("line", f"a{i}", "the cause") for i in range(3000)] + [("line", "b", "thе cause"), ("line", "c", "the\u00a0cause")]
    df = spark.createDataFrame(rows, "record_kind string, record_key string, text string")
    links = {r.record_key: r.n_links for r in look_links(df, "record_kind", "record_key", "text").collect()}
    assert len(links) == 3002 and links["b"] == 3001 and links["a7"] == 2
    assert looking_equal(df, "record_kind", "record_key", "text").count() == 6001
