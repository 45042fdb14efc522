from tokenizers import Tokenizer

from loomtext.llm.tokenize import decode_corpus, encode_corpus

TEXTS = ["", None, "Hello  world,\n\n it's 3.5 <|endoftext|>", "a b ​ लक्षण 復次，若 ṭa’i ||", " " * 7 + "x  ", "'s ''s", "word " * 5000, "word " * 5000]


def test_ids_like_the_library_and_back(spark):
    rows = [(i, t, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    enc = encode_corpus(df)
    got = {r.doc_id: r.ids for r in enc.collect()}
    tok = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    tok.encode_special_tokens = True
    assert got == {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    back = {r.doc_id: r.text for r in decode_corpus(enc).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_empty_table(spark):
    assert encode_corpus(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
