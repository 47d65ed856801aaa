from fathomline.llm import mixing as M


def water(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weigh[s] for s in free)
        full = {s for s in free if 2 * sizes[s] <= level * weigh[s]}
        if not full:
            out |= {s: level * weigh[s] for s in free}
            break
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        free -= full
    return out


def rows(spark, spec):
    data = [(i, (" \t".join(["w"] * n) if n is not None else None), s, "x") for i, (s, n) in enumerate(spec)]
    return spark.createDataFrame(data, "doc_id long, text string, source string, target string")


def test_targets_and_taken(spark):
    spec = [("hot", 3 + i % 40) for i in range(3000)] + [(f"s{i % 7}", i % 30) for i in range(900)] + [(None, 5)] * 20 + [("ü", None), ("Z", 0), ("z", 400)]
    got = M.mix(rows(spark, spec)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert len(got) == len(spec)
    sizes = {}
    for s, n in spec:
        sizes[s] = sizes.get(s, 0) + (n or 0)
    want = water(sizes)
    taken = {}
    for r in got:
        assert r.size == (spec[r.doc_id][1] or 0) and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 400 if s == "z" else abs(n - want[s]) <= 80
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    again = M.mix(rows(spark, spec).repartition(7)).select("doc_id", "taken").collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in got}


def test_edges(spark):
    assert M.mix(rows(spark, []).limit(0)).count() == 0
    assert [(r.size, r.taken, r.target) for r in M.mix(rows(spark, [("a", 0), (None, None)])).collect()] == [(0, 0, 0.0)] * 2
    df = spark.createDataFrame([(1, "a b", "s")] * 4, "doc_id long, text string, source string")
    assert sorted(r.taken for r in M.mix(df).collect()) == [2, 2, 4, 4]
    text = "a b c \x0b\x0c\r\nd\x1ce"
    assert M.mix(spark.createDataFrame([(None, text, None)], "doc_id long, text string, source string")).first().size == 2


def test_repeated_rows_have_a_place_each(spark, monkeypatch):
    monkeypatch.setattr(M, "COPIES", 7)
    data = [(1, "a b c d", "copies")] * 1000 + [(i, "x y", "other") for i in range(5)] + [(None, "n", "copies")] * 50
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(9)
    got = M.mix(df).collect()
    assert len(got) == len(data)
    for s in ("copies", "other"):
        rows = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 8 and all(r.taken in (0, r.size, 2 * r.size) for r in rows)


def mixed(rows):
    """The mix by its definition: all places in one list."""
    sizes = {}
    for _, s, size, _ in rows:
        sizes[s] = sizes.get(s, 0) + size
    target, entries = water(sizes), []
    for s in sizes:
        at = 0
        for key, _, size, doc in sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] % M.BUCKETS, r[0], r[3])):
            at += size
            if size:
                entries += [((at + e * sizes[s]) / target[s] if not e else at / target[s] + e * sizes[s] / target[s], key, doc, size) for e in range(2)]
    taken, left = {}, int(1.5 * sum(sizes.values()))
    for _, _, doc, size in sorted(entries):
        left -= size
        if left < 0:
            break
        taken[doc] = taken.get(doc, 0) + size
    return taken


def test_taken_equals_the_definition(spark):
    from pyspark.sql import functions as F

    spec = [("hot", 1 + i * 7 % 40) for i in range(700)] + [(f"s{i % 5}", i % 30) for i in range(300)] + [(None, 5)] * 20
    df = rows(spark, spec)
    keys = [(r.k, r.source, r.n, r.doc_id) for r in df.select(F.xxhash64(F.lit(7), "doc_id", "text").alias("k"), "source", M.size_of().alias("n"), "doc_id").collect()]
    want = mixed(keys)
    assert {r.doc_id: r.taken for r in M.mix(df).collect() if r.taken} == want
