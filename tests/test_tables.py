from pyspark.sql import functions as F

from fathomline.operators import merge, risk, worklist
from fathomline.session import written
from fathomline.streaming import findings as stream
from fathomline.operators import ingest


def test_rank_in_ranges(spark):
    values = [(i * 7919) % 300 // 3 for i in range(400)] + [None, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v int").repartition(5)
    got = {r.id: r.n for r in merge.ranked(df, F.col("v"), "n", lambda d: written(d, "t")).collect()}
    order = lambda v: -1 if v is None else v
    assert got == {i: 1 + sum(order(o) < order(v) for o in values) for i, v in enumerate(values)}


def test_sink_replaces_its_partitions_only(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    one = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, p string")
    merge.write_partitions(one, path, ["p"])
    for _ in range(2):
        merge.write_partitions(spark.createDataFrame([(9, "a")], "id int, p string"), path, ["p"])
    assert sorted((r.id, r.p) for r in spark.read.parquet(path).collect()) == [(3, "b"), (9, "a")]


def test_stream_merge_keeps_untouched_parts(spark, tmp_path):
    schema = "asset_id long, cve_id string, package_name string, installed_version string, last_scan_id int, last_seen date, fixed_version string, status string"
    row = lambda a, scan, status="open": (a, "CVE-2020-1000", "p", "1", scan, None, None, status)
    batches = [[row(1, 1, "fixed"), row(2, 1)], [row(1, 2), row(3, 2)], [row(2, 3, "fixed")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/n={i}")
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    for _ in range(2):  # the second run finds nothing new
        stream.stream_merge(source(), f"file://{tmp_path}/out", lambda b: b, f"file://{tmp_path}/state", parts=4)
    got = sorted((r.asset_id, r.last_scan_id, r.status) for r in stream.current(spark, f"file://{tmp_path}/out").collect())
    assert got == [(1, 2, "open"), (2, 3, "open"), (3, 2, "open")]


def test_stream_merge_deletes_what_no_batch_reads(spark, tmp_path):
    schema = "asset_id long, cve_id string, package_name string, installed_version string, last_scan_id int, last_seen date, fixed_version string, status string"
    for scan in range(4):
        spark.createDataFrame([(1, "CVE-2020-1000", "p", "1", scan, None, None, "open")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/n={scan}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    stream.stream_merge(source, f"file://{tmp_path}/out", lambda b: b, f"file://{tmp_path}/state", parts=1)
    assert [r.last_scan_id for r in stream.current(spark, f"file://{tmp_path}/out").collect()] == [3]
    assert sorted(p.parent.name for p in (tmp_path / "out").glob("batch=*/part=*")) == ["batch=2", "batch=3"]


def test_reshape_factors(spark):
    old = '{"components":{"a":{"points":"1","max":"40"},"b":{"max":"3","why":"x"}},"band_floor_rule":"kev","scored_band":"low","sla":{"rule":"r","kev_deadline_passed":false}}'
    df = spark.createDataFrame([(old,), ('{"x":1}',), (None,), ('{"components":{},"scored_band":"low"}',)], "f string")
    got = [r.f for r in df.select(risk.reshape_factors(F.col("f")).alias("f")).collect()]
    assert got == ['{"components":{"a":{"points":"1"},"b":{"why":"x"}},"band_floor":{"rule":"kev","scored_band":"low"},"sla":{"rule":"r"}}', '{"x":1}', None, '{"components":{}}']


def test_draft_markdown(spark):
    df = spark.createDataFrame([(("s", ["one", "two"], ["c"], "", "back", True),), (("s", [], None, "wall", "back", None),)], "d struct<summary: string, steps: array<string>, commands: array<string>, compensating_controls: string, rollback: string, requires_reboot: boolean>")
    got = [r.m for r in df.select(worklist.draft_markdown(F.col("d")).alias("m")).collect()]
    assert got == ["s\n\n**Steps**\n1. one\n2. two\n\n**Commands**\n```bash\nc\n```\n\n**Rollback**\nback\n\n_Requires a reboot._", "s\n\n**Compensating controls**\nwall\n\n**Rollback**\nback"]


def test_valid_ids_and_hosts(spark):
    rows = spark.createDataFrame([("CVE-2020-1234", "H1"), ("CVE-20-1", "h1"), (None, "h1"), ("CVE-2021-99999", "h9")], "cve_id string, hostname string")
    good = ingest.valid_ids(rows)
    assert sorted(r.cve_id for r in good.collect()) == ["CVE-2020-1234", "CVE-2021-99999"]
    assert [(r.cve_id, r.asset_id) for r in ingest.resolve_assets(good, spark.createDataFrame([(7, "h1")], "asset_id int, hostname string")).collect()] == [("CVE-2020-1234", 7)]


def test_chunks_of_asked_ids_alone(spark, monkeypatch):
    from fathomline import queries as queries_
    from fathomline.operators import retrieval

    t = queries_.Tables(spark, "/root/testdata/sf0.001")
    ids = t.cves.where("cve_key % 20 = 7").select("cve_id").unionByName(spark.createDataFrame([("CVE-1999-0001",), (None,)], "cve_id string"))
    rows = lambda df: sorted(tuple(r) for r in df.select("cve_id", "chunk_index", "content").collect())
    want = rows(t.chunks.join(ids, "cve_id", "left_semi"))
    made, plain = [], retrieval.fact_chunks

    def fact_chunks(facts):
        made.append(facts.select(F.count("*").alias("ids"), F.count("fixes").alias("with_fixes")).first())
        return plain(facts)

    monkeypatch.setattr(retrieval, "fact_chunks", fact_chunks)
    assert want and rows(t.chunks_of(ids.unionByName(ids))) == want
    assert [r.ids for r in made] == [t.cves.where("cve_key % 20 = 7").count()]
    made.clear()
    for name in ("plans_with_context", "widening_retries"):
        queries_.QUERIES[name](spark, "/root/testdata/sf0.001")
    every = t.cves.count()
    assert len(made) == 2 and all(r.ids < every for r in made)
