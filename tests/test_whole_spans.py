import pytest

from pyspark.sql import functions as F

from loomtext.operators import spans, tokens
from loomtext.plans import editing
from loomtext.sources import library

NAMES = ["passage_slices_whole", "phrase_token_runs_whole", "span_token_overlap_whole", "spans_of_units_whole"]


def test_spans_over_the_whole_text(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    long = " ".join(f"wort{i}," if i % 5 else f"wort{i}      ...          ." for i in range(80))
    rows = [(1, "a", long), (2, "a", "kurz"), (3, "b", ""), (4, "b", None), (5, "c", "é १२ " * 50), (6, "c", "   ")]
    spark.createDataFrame(rows, "doc_id bigint, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in NAMES:
        got = editing.QUERIES[name](spark, str(tmp_path))
        want = con.sql(f"select {', '.join(got.columns)} from ({editing.SQL[name]})").fetchall()
        rows = [tuple(r) for r in got.collect()]
        assert sorted(rows) == sorted(want), name
        of = [r for r in rows if r[0] == 1]
        if "overlap" in name:
            assert max(r[3] for r in of) == 79 and {r[0] for r in rows} == {1, 2, 5}
        elif "runs" in name:
            assert max(r[3] for r in of) > 70
        else:
            assert "wort7" in of[0][1][-60:]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["phrase_token_runs_whole", "span_token_overlap_whole", "phrase_token_runs"])
def test_tokens_and_spans_of_a_text_meet_in_its_row(spark, tmp_path, name):
    """No tokens are broadcast or shuffled: the estimate after an explode is too small by orders of magnitude."""
    spark.range(3).selectExpr("id as doc_id", "'a' as source", "repeat('ein wort ', 40) as text").write.parquet(str(tmp_path / "documents.parquet"))
    df = editing.QUERIES[name](spark, str(tmp_path))
    assert df.count() > 0 and "Exchange" not in plan(df) and "Join" not in plan(df)


def test_spans_of_any_kind_as_by_a_join(spark):
    rows = [(1, "ab cd  efg h", [(0, 0, 4), (1, 3, 5), (2, 1, 1), (3, -5, 99), (4, 5, 7), (5, 9, 9), (6, 11, 12)]), (2, "", [(0, 0, 3)]), (3, None, [(0, 0, 3)]), (4, "x" * 9, []), (5, "x y", None), (6, "é १२", [(0, 0, 4), (1, 2, 4)])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, s array<struct<no:int,start_pos:int,end_pos:int>>")
    got = spans.text_spans(docs, "doc_id", "text", F.col("s")).where("lo is not null").selectExpr("doc_id", "no", "lo", "hi", "hi - lo + 1 as n")
    t = tokens.token_offsets(docs, "doc_id", "text")
    sp = docs.select("doc_id", F.inline("s"))
    want = spans.span_tokens(sp, t, "doc_id").groupBy("s.doc_id", "s.no").agg(F.min("idx"), F.max("idx"), F.count(F.lit(1)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 8
    named = sp.select(F.col("doc_id").alias("unit_id"), F.col("doc_id").alias("key"), "no", "start_pos", "end_pos")
    old = library.token_runs(named, t.select(F.col("doc_id").alias("key"), "idx", "start_pos", "end_pos"))
    new = library.text_token_runs(docs, "doc_id", "text", F.col("s"))
    assert sorted(map(tuple, new[0].collect())) == sorted(map(tuple, old[0].drop("key").collect()))
    assert sorted(map(tuple, new[1].collect())) == sorted(map(tuple, old[1].collect()))
