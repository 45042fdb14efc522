"""Rules of the alignment engines, on small cases where each of them decides."""

from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import align, tokens


def test_labels(spark):
    df = spark.createDataFrame([("[Objection:] a [opponent.] b [12a] c [3] d [note:] e [Reply] f",), (None,), ("",)], "t string")
    got = [r.x for r in df.select(T.without_labels(F.col("t")).alias("x")).collect()]
    assert got == ["a b c d [note:] e f", None, ""]


def test_verse_markers_are_no_part_of_the_stream(spark):
    assert align._stream(["ka", "Vvs", "vvs", "gi"]) == ("kagi", [0, 0, 3, 3])


def test_form_frequency_joins_compatible_spellings(spark):
    rows = [("p2", "Ｌｉｇｈｔ light"), ("p1", "LIGHT, ṣa ṣa"), (None, None), ("p3", "")]
    got = {r.form: (r.n, r.n_passages, r.surface, r.first_passage) for r in tokens.form_frequency(spark.createDataFrame(rows, "p string, t string"), "t", "p").collect()}
    assert got == {"light": (3, 2, "LIGHT", "p1"), "ṣa": (2, 1, "ṣa", "p1")}


def test_reanchor_ignores_labels_and_composes(spark):
    rows = [(1, "1.1. one ṣa two three", "New 1.1. one ṣa two, three One"), (2, None, "x"), (3, "a a a", "a a a a"), (4, "", "")]
    df = spark.createDataFrame(rows, "k int, before string, after string")
    got = {tuple(r) for r in tokens.reanchor_texts(df, "k", "before", "after").collect()}
    # The label's numbers (tokens 0 and 1, and 1 and 2 of the edited text where no line begins with them) take no part.
    assert got == {(1, 2, 3), (1, 3, 4), (1, 4, 5), (1, 5, 6)}


def test_match_contexts_like_brute_force():
    import random

    rnd = random.Random(4)
    texts = [[rnd.choice("abcd") for _ in range(rnd.randrange(40))] for _ in range(30)]
    other = [[w for w in t if rnd.random() < 0.9] + [rnd.choice("abcd")] for t in texts]

    def brute(a, b):
        votes = {}
        for n in tokens.SIZES:
            left, right = {}, {}
            for words, out in ((a, left), (b, right)):
                for i in range(len(words) - n + 1):
                    out.setdefault(tuple(words[i:i + n]), []).append(i)
            for g, at in left.items():
                if len(at) == 1 and len(right.get(g, [])) == 1:
                    for o in range(n):
                        votes.setdefault(at[0] + o, set()).add(right[g][0] + o)
        back = {}
        for i, js in votes.items():
            for j in js:
                back.setdefault(j, set()).add(i)
        return {(i, j) for i, js in votes.items() if len(js) == 1 for j in js if len(back[j]) == 1}

    got = set(tokens.match_contexts(texts, other))
    assert got == {(k, i, j) for k, (a, b) in enumerate(zip(texts, other)) for i, j in brute(a, b)}


def test_edition_transfer_cuts_no_token(spark):
    u = [("u1", [0, 1]), ("u2", [2]), ("u3", []), ("u4", [0, 1, 2])]
    rows = [(1, "vijnapti matram etad".split(), "vijnaptimatram etad".split(), u), (2, None, ["x"], u), (3, ["vvs", "eka"], ["eka", "vvs"], [("v", [1])])]
    df = spark.createDataFrame(rows, "k int, a_tokens array<string>, b_tokens array<string>, units array<struct<unit_id:string,idxs:array<int>>>")
    got = {tuple(r) for r in align.edition_transfer(df, "k").collect()}
    assert got == {(1, "u1", 0, 0, 1.0), (1, "u2", 1, 1, 1.0), (1, "u4", 0, 1, 1.0), (3, "v", 0, 0, 1.0)}
    cut = spark.createDataFrame([(1, "mana etad".split(), "kamana etad".split(), [("u", [0])])], df.schema)
    assert align.edition_transfer(cut, "k").collect() == []


def test_token_candidates_over_sources(spark):
    rows = [(1, "s1", ["vijnapti", "matram"], ["vijnapti", "matram", "x"]), (1, "s2", ["vijnapti", "matram"], ["vij", "napti"]), (1, "s3", ["vijnapti"], None)]
    df = spark.createDataFrame(rows, "k int, source string, a_tokens array<string>, b_tokens array<string>")
    got = {r.idx: {s: tuple(x) for s, x in r.targets.items()} for r in align.token_candidates(df, "k", "source").collect()}
    assert got == {0: {"s1": (0, 0), "s2": (0, 1)}, 1: {"s1": (1, 1)}}


def test_pivot_against_the_best_disjoint_one(spark):
    t = spark.createDataFrame([(1, "g", [1.0, 0.0]), (2, "g", [0.6, 0.8]), (3, "h", [1.0, 0.0])], "id int, grp string, vec array<double>")
    p = [(10, "g", [0, 1], [1.0, 0.02]), (11, "g", [0], [1.0, 0.1]), (12, "g", [1, 2], [0.99, 0.1]), (13, "g", [3], [0.5, 0.86]), (14, "g", [4], [0.62, 0.79])]
    pv = spark.createDataFrame(p, "id int, grp string, units array<int>, vec array<double>")
    got = {r.id: (r.pivot, list(r.units)) for r in align.best_disjoint_pivot(t, pv, "grp").collect()}
    # 12 shares a unit with the best and is no rival; 11 lies inside it and is nearly as good.  Target 2 has two rivals.
    assert got == {1: (11, [0])}


def test_suggestions_cross_no_anchor(spark):
    p = [("g", 1, 0, 3, [0], 0.95), ("g", 2, 3, 5, [1], 0.9), ("g", 3, 10, 12, [1], 0.85), ("g", 4, 20, 22, [5], 0.8), ("g", 5, 30, 31, [3], 0.7), ("h", 6, 0, 1, [0], 0.5)]
    props = spark.createDataFrame(p, "grp string, id int, lo int, hi int, units array<int>, score double")
    anchors = spark.createDataFrame([("g", 4, 25, 27)], "grp string, unit int, lo int, hi int")
    got = {r.id for r in align.choose_suggestions(props, anchors, "grp").collect()}
    # 2 shares a token with 1; 4 stands before the anchor of an earlier unit, 5 behind that of a later one.
    assert got == {1, 3, 6}


def test_root_before_its_verse_marker(spark):
    text = "eka dvi tri 4 || eka dvi"
    df = spark.createDataFrame([(1, "eka tri 4".split(), text, "4"), (2, "eka tri".split(), "eka x tri", "4"), (3, None, None, None)], "k int, root array<string>, text string, verse string")
    df = df.select("k", "root", F.transform(T.token_spans_udf("text"), lambda x: x.surface).alias("witness"), "verse", align.verse_marker("text", "verse").alias("marker"))
    got = {}
    for r in align.lcs_tokens(df, "k").collect():
        got.setdefault(r.k, []).append(r.witness_idx)
    assert got == {1: [0, 2, 3], 2: [0, 2]}
