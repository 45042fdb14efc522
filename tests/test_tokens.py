from loomtext.functions.text import token_spans, token_spans_udf


def test_spans_in_arrow_like_one_by_one(spark):
    texts = ["1.1. one  two\n 2.3.4. three 1.2. x", None, "", "唯識abc 𐀀b’c-", "1.2.\n3.4. a", " ", "x" * 5000 + " 9.9. y\n9.9. z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: [tuple(x) for x in r.s] for r in df.select("i", token_spans_udf("t").alias("s")).collect()}
    assert got == {i: token_spans(t) for i, t in enumerate(texts)}
