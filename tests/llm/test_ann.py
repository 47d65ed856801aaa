import math

import numpy as np

from fathomline.llm import ann as A


def brute(rows, top=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    out = {}
    for i, q in good:
        if i % 50 == 0:
            s = A.cosines(x, q)
            s[ids == i] = -2
            best = np.lexsort((ids, -s))[: min(top, (ids != i).sum())]
            out[i] = [(int(ids[b]), float(s[b])) for b in best]
    return out


def found(spark, df, **more):
    out = {}
    for r in A.search(df, df.where("vec_id % 50 = 0"), **more).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x[500:1500] = x[500]  # a third are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [None] * 16), (5200, [1e30] * 16), (5250, [1e-30] * 16)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cell string").repartition(3)
    got, want = found(spark, df, shard=700, block=20), brute(rows)
    assert set(got) == set(want)
    hits = [len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 5 for q in want]
    assert np.mean(hits) >= 0.9
    assert got[500] == want[500] and got[600] == want[600] == [(i, want[600][0][1]) for i in range(500, 505)]
    scores = {(q, a): s for q, best in want.items() for a, s in best}
    assert all(scores.get((q, a), s) == s for q, best in got.items() for a, s in best)


def test_only_visited_cells_are_scored(spark):
    """On clustered vectors a query is compared with a small part of all, in few shards, and finds its neighbours."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 16))
    x = (centres[np.arange(6000) % 60] + 0.1 * rng.standard_normal((6000, 16))).tolist()
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>").repartition(3)
    asked = A.usable(df.where("vec_id % 50 = 0"))
    index, entries = A.build(A.usable(df))
    for block in (A.BLOCK, 10):  # many tasks for one shard give the same
        per = A.compare(entries, asked, index, shard=500, block=block).groupBy("query_id").agg(A.F.sum("scored").alias("scored"), A.F.count("*").alias("shards")).toPandas()
        assert len(per) == 120 and per.scored.mean() < 0.15 * 6000 and per.shards.mean() < 8
        got, want = found(spark, df, shard=500, block=block), brute(list(enumerate(x)))
        assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 5 for q in want]) >= 0.9
    first, parts = index.shards(500)
    assert (first[1:] >= first[:-1]).all() and all(index.counts[first == s].sum() <= 500 for s in set(first[parts == 1].tolist()))


def test_lengths(spark):
    # Several lengths, each found among its own; one alone of its length finds nothing.
    rows = [(i, [float(i % 7 - 3.5)]) for i in range(200)] + [(i, [math.cos(i), math.sin(i)]) for i in range(1000, 1120)] + [(550, []), (600, [1.0] * 9)]
    got, want = found(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")), brute(rows[200:320])
    assert set(got) == {0, 50, 100, 150, 1000, 1050, 1100} and all(s == 1.0 for q in (0, 50, 100, 150) for _, s in got[q])
    assert all({a for a, _ in got[q]} <= set(range(1000, 1120)) and len({a for a, _ in got[q]} & {a for a, _ in want[q]}) >= 4 for q in want)
    twice = spark.createDataFrame([(50, [3.0, 1.0]), (50, [1.0, 3.0]), (1, [1.0, 3.0]), (2, [3.0, 1.0])], "vec_id long, embedding array<double>")
    assert [a for a, _ in found(spark, twice)[50]] == [1, 2]


def test_edges(spark):
    df = spark.createDataFrame([(50, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [a for a, _ in found(spark, df)[50]] == [1, 2]
    assert found(spark, df.limit(0)) == {} and found(spark, df.where("vec_id = 50")) == {}
