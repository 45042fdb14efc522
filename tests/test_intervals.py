from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from loomtext.operators.intervals import merge_intervals

SCHEMA = StructType([
    StructField("block_id", StringType()), StructField("start_pos", IntegerType()),
    StructField("end_pos", IntegerType()), StructField("span_kind", StringType()),
])


def brute(rows):
    out = set()
    for k in {r[0] for r in rows if r[0] is not None}:
        iv = sorted({(a, b) for kk, a, b, _ in rows if kk == k and a is not None and b is not None and a < b})
        done = []
        for a, b in iv:
            if done and a <= done[-1][1]:
                done[-1][1] = max(done[-1][1], b)
            else:
                done.append([a, b])
        out |= {(k, "covered", a, b) for a, b in done}
        out |= {(k, "gap", x[1], y[0]) for x, y in zip(done, done[1:])}
    return out


def run(spark, rows, width=8):
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in merge_intervals(df, "block_id", "start_pos", "end_pos", width).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_nulls_ties_repeats_and_clashing_names(spark):
    rows = [("a", 1, 5, "x"), ("a", 1, 5, "x"), ("a", 1, 9, None), ("a", 9, 12, None), ("a", 40, 41, None),
            ("a", None, 3, None), ("a", 7, None, None), ("a", 20, 20, None), ("a", 30, 25, None), (None, 1, 2, None), ("b", 3, 3, None)]
    assert run(spark, rows) == {("a", "covered", 1, 12), ("a", "gap", 12, 40), ("a", "covered", 40, 41)}


def test_empty(spark):
    assert run(spark, []) == set()


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 60), st.integers(0, 60), st.none()), max_size=40))
def test_like_brute_force(spark, rows):
    assert run(spark, rows) == brute(rows)
