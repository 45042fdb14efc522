from loomtext.llm.scan import noise, paragraphs, skeleton

COLS = "reading_id string, document_id string, pdf_page int, raw_block_ids array<string>, text string, reading_layer string, line_no int"


def _readings():
    body = "the hand of the king supports the river and the mind-only gloss names the cloud while the city sleeps."
    rows = [(f"c{i}", "eng_a", None, None, body, "checked", 1) for i in range(30)]
    for i in range(6):
        rows.append((f"h{i}", "eng_a", i + 10, ["b"], f"THE TALE OF NAME{'ABCDEF'[i]}    {i + 10}\nthe hand of the king supports the river and\nthe city sleeps.", "raw", 1))
    rows += [
        ("r1", "eng_a", 40, ["b"], "THE TALE OF NAMEX\n[40]\nthe harid of the kirig sup-\nports the river and the mind-\nonly gloss narnes the cl0ud while\n— 41 —\nTHE TALE OF NAMEX | 41\nthe city sleeps.\n\nthe king and the ri-\nvcr.", "raw", 1),
        ("r2", None, None, None, None, "raw", 1), ("r3", None, None, None, "", "raw", 1), ("r4", "eng_a", None, None, "the king", None, 1),
    ]
    return rows + rows[-4:]


def test_noise_and_paragraphs(spark):
    df = spark.createDataFrame(_readings(), COLS)
    got = [tuple(r) for r in noise(df).where("reading_id = 'r1'").collect()]
    assert len(got) == len(set(got))
    assert set(got) == {("r1", 1, "header"), ("r1", 2, "page_number"), ("r1", 3, "misread"), ("r1", 3, "hyphen"), ("r1", 5, "misread"),
                        ("r1", 6, "page_number"), ("r1", 7, "header"), ("r1", 10, "hyphen"), ("r1", 11, "misread")}
    p = {(r.reading_id, r.paragraph_no): r.text for r in paragraphs(df).collect()}
    assert p["r1", 1] == "the hand of the king supports the river and the mind-only gloss names the cloud while the city sleeps."
    assert p["r1", 2] == "the king and the river."


def test_empty(spark):
    df = spark.createDataFrame([], COLS)
    assert noise(df).collect() == [] and paragraphs(df).collect() == []


def test_skeleton(spark):
    pairs = [("hand", "harid"), ("king", "kirig"), ("name", "narne"), ("cloud", "cl0ucl"), ("with", "vvitli"), ("turn", "tum"), ("करता", "कसता")]
    df = spark.createDataFrame(pairs, "a string, b string")
    from pyspark.sql import functions as F
    assert df.where(skeleton(F.col("a")) != skeleton(F.col("b"))).collect() == []


def _pages(lines):
    return [(f"p{i:03}", "eng_a", None, None, t, "raw", 1) for i, t in enumerate(lines)]


def test_context_decides(spark):
    # "born" and "bom" are drawn alike; "born" is rare beside "bom" but right after "was".
    lines = ["the bom of that tree grows tall"] * 40 + ["a king was born here once", "a queen was born here too", "the born of this tree falls down"]
    got = {tuple(r) for r in noise(spark.createDataFrame(_pages(lines), COLS)).collect()}
    assert got == {("p042", 1, "misread")}
    # Without the sentences that support it, the same rare form is a misreading wherever it stands.
    alone = lines[:41]
    assert {tuple(r) for r in noise(spark.createDataFrame(_pages(alone), COLS)).collect()} == {("p040", 1, "misread")}
    # A leaf reference is no misread Roman number, a word of two signs in its usual place is one.
    lines = ["see part iv now in the house and so"] * 30 + ["on leaf 1v it ends there and so", "see part iv now 1n the house and so"]
    got = {tuple(r) for r in noise(spark.createDataFrame(_pages(lines), COLS)).collect()}
    assert got == {("p031", 1, "misread")}


def test_long_headers_and_late_deliveries(spark):
    head = "the long and winding account of all the readings of the great book of names as it was told"
    body = "the hand of the king supports the river and the mind-only gloss names the cloud while the city sleeps and the moon rises over the hill again."
    rows = [(f"h{i}", "eng_a", 1, None, f"{head.upper()} | {i}\n{body}", "raw", 1) for i in range(9)]
    df = spark.createDataFrame([(*r, 1) for r in rows] + [("h0", "eng_a", 1, None, body, "raw", 1, 2)], COLS + ", received_at int")
    df = df.withColumn("received_at", df.received_at.cast("string").cast("int")).selectExpr("* except (received_at)", "timestamp_seconds(received_at) as received_at")
    got = {tuple(r) for r in noise(df).collect()}
    assert got == {(f"h{i}", 1, "header") for i in range(1, 9)}
