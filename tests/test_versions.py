from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fathomline.functions import versions as V


def choose(spark, cases):
    df = spark.createDataFrame([(i, r, v) for i, (r, v) in enumerate(cases)], "i int, raw string, installed string")
    return [r.v for r in df.select("i", V.choose_fix(F.col("raw"), F.col("installed")).alias("v")).orderBy("i").collect()]


def test_choice(spark):
    cases = [("3.1, 2.9.0, 2.6.1", "2.6.0"), ("1.2, 1.3", "1.9"), ("b, a", None), ("b, a", ""), ("", "1"), (None, "1"), (" , ", "1"), ("2:1.0", "9.9"), ("1.10", "1.9"), ("1.0, 01.0", "0.9"), ("1.1.1l", "1.1.1k")]
    assert choose(spark, cases) == ["2.6.1", "1.3", "b", "b", None, None, None, "2:1.0", "1.10", "1.0", "1.1.1l"]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text("0129.:-+ab", max_size=9), min_size=20, max_size=40))
def test_order_is_total(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "v string")
    a, b = df.select(F.col("v").alias("a")), df.select(F.col("v").alias("b"))
    got = {(r.a, r.b): r.c for r in a.crossJoin(b).select("a", "b", V.compare(F.col("a"), F.col("b")).alias("c")).collect()}
    assert all(got[x, y] == -got[y, x] for x, y in got)
    assert all(got[x, x] == 0 for x in names)
