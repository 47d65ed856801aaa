import corpus_pipeline as P
from fathomline.llm import decontaminate, mixing, near_dedup, pii

SF = "/root/testdata/sf0.01"


def test_stages_keep_their_promises(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        if name != "mixing":
            assert out.columns == docs.columns
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        seen.append((name, docs.count()))
        if name == "minhash_near_dedup":
            assert near_dedup.near_duplicates(docs).where("NOT kept").count() == 0
        if name == "benchmark_decontamination":
            assert decontaminate.decontaminate(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count() == 0
        if name == "pii":
            assert pii.digests(pii.detect(docs)).where("spans <> ''").count() == 0
    counts = [n for _, n in seen]
    assert [n for n, _ in seen] == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "pii", "mixing"]
    assert 1000 > counts[0] > 800 and counts[0] > counts[1] > counts[2] == counts[3] == counts[4]
    assert set(docs.columns) >= {"doc_id", "text", "size", "source_size", "target", "taken"}
    total = docs.selectExpr("sum(size) s", "sum(taken) t").first()
    assert 0.9 * mixing.BUDGET * total.s <= total.t <= mixing.BUDGET * total.s


def test_run_on_odd_rows(spark, tmp_path):
    """Null, empty and very long texts, null and repeated ids, repeated rows, and columns named as the operators' own."""
    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    rows = [
        (1, None), (2, ""), (3, words("u", 40)), (3, words("u", 40)), (4, words("u", 40) + " more"), (5, "so " + words("q", 20)), (6, words("m", 15) + " write to jane@example.com"), (6, words("n", 30)),
        (None, words("z", 30)), (None, words("z", 30)), (7, words("l", 60_000)), ((1 << 63) - 1, words("y", 9)),
    ]
    df = spark.createDataFrame([(d, t, "en", "s", len(t) if t else 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.selectExpr("*", "1 AS _row", "map('a', 1) AS _h1", "'x' AS class", "2 AS size", "'y' AS spans", "'z' AS score").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, words("q", 20)), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(3, 0, 0), (None, 1, 1), (99, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = P.run(spark, str(tmp_path))
    got = {(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()}
    masked = words("m", 15) + " write to <EMAIL>"
    assert {(d, t) for d, t in got if d != 1} == {(3, rows[2][1]), (6, masked), (6, rows[7][1]), (None, rows[8][1]), (7, rows[10][1]), ((1 << 63) - 1, rows[11][1])}
    assert [t or "" for d, t in got if d == 1] == [""] and out.count() == 7
    assert {"_row", "_h1", "class", "spans", "score", "taken", "target"} <= set(out.columns)
    assert [r.n_chars for r in out.where("doc_id = 6").select("n_chars").collect() if r.n_chars == len(masked)]


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
