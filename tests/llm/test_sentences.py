import pytest

from loomtext.llm.sentences import sentence_spans, sentences

CASES = [
    ["Dr. K. Wem read vol. 9, p. 3.5 twice.", "It ends."],
    ["It ended.4", "[Objection:] Why so?", "‘Is it?’ he asks, and goes."],
    ["“One here. Two there,” says the dream.", "Next one."],
    ["“Read again!” is pencilled next to unit 7; no change.", "See no. 66, p. 5."],
    ["It differs at 2.11 ... but only once.", "7.97. Two read it."],
    ["Er fragt: „Ist es so?“", "Am 6. Tag heißt es, d. h. Z. 43, ja (vgl. Bd. 2, S. 65 f.).", "Usw. usf."],
    ["डॉ. ओनलोष ने मिलाया।", "क्या इकाई 8.86 टिप्पणी है?", "पृ. 84 देखें।"],
    ["| ka kha | ga nga || 9 ||", "ca cha //", "ja nya"],
    ["「若甲乙？」", "『丙丁。』者，戊己……庚辛。", "（壬癸（見卷9.42）。）"],
    ["Before that", "there."],
]


@pytest.mark.parametrize("want", CASES[:-1])
def test_cases(want):
    text = (" " if want[0][0] not in "「" else "").join(want)
    assert [text[a:b] for a, b in sentences(text)] == want


def test_breaks():
    cut = lambda t: [t[a:b] for a, b in sentences(t)]
    assert cut(" No mark\n\n next one\nstill. \u200bYes.No ") == ["No mark", "next one\nstill.", "Yes.", "No"]
    assert cut("甲乙丙\u3000丁戊\n己庚") == ["甲乙丙", "丁戊", "己庚"]
    assert cut("") == cut(None) == cut(" \n ") == cut("*** ...") == []
    long = "A word here. " * 20000
    assert len(cut(long)) == 20000


def test_frame(spark):
    rows = [("r", "1", "One. Two.", 1), ("r", "1", "One. Two.", 1), ("r", "2", None, 1), ("r", "3", "", 1), (None, None, "Three.", 2)]
    df = spark.createDataFrame(rows, "kind string, id string, text string, start_pos int")
    assert sorted(map(str, map(tuple, sentence_spans(df, "kind", "id", "text").collect()))) == sorted(map(str, [("r", "1", 0, 4), ("r", "1", 5, 9), (None, None, 0, 6)]))
    assert sentence_spans(df.limit(0), "kind", "id", "text").collect() == []


def test_every_terminator_of_the_property():
    import regex

    marks = [c for c in map(chr, range(0x110000)) if regex.match(r"\p{Sentence_Terminal}", c)]
    assert len(marks) >= 172
    wrong = [hex(ord(c)) for c in marks if len(sentences(f"Here it ends{c} There it goes on{c}")) != 2]
    assert wrong == []
    assert [len(sentences(f"Here it ends{c}{q} There it goes on.")) for c in "!?۔።" for q in "”»)」﴾"] == [2] * 20


def test_abbreviations_of_the_own_language():
    from loomtext.llm.sentences import languages

    cut = lambda t: [t[a:b] for a, b in sentences(t)]
    assert languages("the king and the queen") == ("en",) and languages("der König und die Königin ist nicht") == ("de",)
    # "ca." and "bes." suppress a break in German, in English the words end a sentence.
    assert len(cut("Es ist nicht auf ca. Hundert und bes. Viele zu zählen.")) == 1
    assert len(cut("This is the name of the bes. Many of them are in the house.")) == 2
    assert len(cut("Il est dans la maison de Mme. Durand et pas sur le toit.")) == 1
    assert len(cut("Это не проф. Иванов, и он на месте. Он ушёл.")) == 2
