import numpy as np
from pyspark.sql import functions as F

from fathomline.operators import retrieval as R, vectors as V


def recall(spark, x, k=10, **more):
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    asked = corpus.where("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    index = V.build(corpus, k, **more)
    want = R.evaluate(R.dense_search(asked, corpus, k).select("query_id", "vec_id"), R.dense_search(asked, corpus, k).select("query_id", "vec_id"), k).first()
    got = R.evaluate(V.search(asked, corpus, index, k).select("query_id", "vec_id"), R.dense_search(asked, corpus, k).select("query_id", "vec_id"), k).first()
    assert want.recall_at_k == 1.0
    return index, got.recall_at_k


def test_clustered_vectors_need_a_small_share(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((80, 32))
    x = centres[rng.integers(0, 80, 8000)] + 0.3 * rng.standard_normal((8000, 32))
    index, got = recall(spark, x)
    assert got >= 0.9 and index.share < 0.2 and index.blocks.count() >= 100


def test_many_copies_lie_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 200)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2400, 8))
    x[:800] = x[0]
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 8)], "vec_id long, embedding array<double>")
    index = V.build(corpus, 5)
    sizes = [r.n for r in index.blocks.select(F.size("ids").alias("n")).collect()]
    assert sum(sizes) == 2400 and max(sizes) < 400
    asked = corpus.where("vec_id IN (0, 9000, 9001)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = V.search(asked, corpus, index, 5, deep=900).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [1, 2, 3, 4, 5] and all(abs(r.score - 1) < 1e-12 for r in got)


def test_few_vectors(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    asked = corpus.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    assert sorted((r.query_id, r.vec_id) for r in V.search(asked, corpus, V.build(corpus), 3).collect()) == [(1, 2), (2, 1)]
    assert V.build(corpus.limit(0)) is None
