import random

from pyspark.sql import functions as F

from fathomline.operators import index as I, retrieval as R


def corpus(spark, n=900, keys="long"):
    rng = random.Random(3)
    words = ["the"] * 30 + ["of"] * 10 + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(80)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (None, "the w1"), (5, "the w2 extra"), (n + 2, "the of " * 500)]
    df = spark.createDataFrame(rows, "doc long, text string")
    return df if keys == "long" else df.withColumn("doc", F.concat(F.lit("d"), F.col("doc").cast("string")))


QUERIES = [("a", "the of"), ("b", '"the of" OR w3'), ("c", "w1 w2 -w5"), ("d", '"of the" w7'), ("e", "nowhere the"), ("f", "the"), ("g", "extra OR w9 the")]


def rows_of(df):
    return sorted((r.query_id, r.rank, r.doc, round(r.score, 9)) for r in df.collect())


def test_search_equals_search_over_all_postings(spark, tmp_path):
    asked = spark.createDataFrame(QUERIES, "query_id string, query string")
    for keys in ("long", "string"):
        docs = corpus(spark, keys=keys)
        table = I.build(docs, "doc", "text", f"file://{tmp_path}/{keys}", block=16, buckets=8)
        want = rows_of(R.lexical_search(asked, R.postings(docs.where("doc IS NOT NULL"), "doc", "text"), "doc", 7))
        for first in (1, 1000) if keys == "long" else (4,):
            assert rows_of(I.search(table, asked, "doc", 7, first=first, buckets=8)) == want
        allowed = docs.where("doc IS NOT NULL").select(F.explode(F.array(F.lit("a"), F.lit("f"))).alias("query_id"), "doc").where("crc32(cast(doc AS string)) % 3 = 0")
        want = rows_of(R.lexical_search(asked, R.postings(docs.where("doc IS NOT NULL"), "doc", "text"), "doc", 7, allowed))
        assert want and rows_of(I.search(table, asked, "doc", 7, allowed, first=1, buckets=8)) == want


def test_bounds_hold_and_leave_slots_out(spark, tmp_path):
    docs = corpus(spark)
    asked = spark.createDataFrame(QUERIES, "query_id string, query string")
    table = I.build(docs, "doc", "text", f"file://{tmp_path}/a", block=16, buckets=8)
    terms = R.query_terms(asked)
    bound = {(r.query_id, r.slot): r.bound for r in I.bounds(terms, table).collect()}
    slots = table.agg(F.max("slot")).first()[0] + 1
    scored = R.lexical_search(asked, R.postings(docs.where("doc IS NOT NULL"), "doc", "text"), "doc", 10**6).withColumn("slot", F.pmod(F.xxhash64(F.lit(5), "doc"), F.lit(-(-docs.where("doc IS NOT NULL").count() // 16))).cast("int"))
    best = {(r.query_id, r.slot): r.m for r in scored.groupBy("query_id", "slot").agg(F.max("score").alias("m")).collect()}
    assert best and all(bound[k] >= v - 1e-9 for k, v in best.items()) and slots > 40
    least = scored.where("query_id = 'f' AND rank = 7").first().score
    assert sum(v >= least for (q, _), v in bound.items() if q == "f") < slots / 2  # most can't reach the seventh


def test_only_folders_of_the_terms_are_read(spark, tmp_path):
    table = I.build(corpus(spark), "doc", "text", f"file://{tmp_path}/a", buckets=8)
    terms = R.query_terms(spark.createDataFrame([("a", "w1")], "query_id string, query string"))
    here = I.of_terms(table, terms, 8)
    assert here.select("bucket").distinct().count() == 1
    plan = here._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_empty(spark, tmp_path):
    none = corpus(spark, 0).where("false")
    table = I.build(none, "doc", "text", f"file://{tmp_path}/a")
    assert I.search(table, spark.createDataFrame(QUERIES, "query_id string, query string"), "doc", 5).count() == 0


def test_long_texts_make_more_slots(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i} " + "the of " * (400 if i % 10 == 0 else 3)) for i in range(60)] + [(7, "w7 again")], "doc int, text string")
    asked = spark.createDataFrame(QUERIES + [("h", "w7 again OR the")], "query_id string, query string")
    want = rows_of(R.lexical_search(asked, R.postings(docs, "doc", "text"), "doc", 7))
    monkeypatch.setattr(I, "SLOT_BYTES", 2000)
    table = I.build(docs, "doc", "text", f"file://{tmp_path}/a", block=100, buckets=8)
    assert table.select("slot").distinct().count() > 5 and table.schema["base"].dataType == docs.schema["doc"].dataType
    assert rows_of(I.search(table, asked, "doc", 7, buckets=8)) == want
