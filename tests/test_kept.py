"""Kept tables: the triage table, facts' prints, hash trees, and the stream without repeats."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from fathomline.operators import changes, grounding, merge, reports, retrieval, risk_table
from fathomline.streaming import findings as stream


def view(spark, n=3000):
    rng = random.Random(1)
    bands = ["critical", "high", "medium", "low"]
    rows = [(i, f"h{i % 50}", f"t{i % 3}", "debian", f"CVE-2020-{1000 + i % 90}", "p", "1", None, Decimal(rng.randrange(10000)) / 100, bands[i % 4], dt.date(2000, 1, 1) + dt.timedelta(rng.randrange(200)) if i % 50 else None, i % 2 == 0, 3, i % 7 == 0, Decimal(rng.randrange(100)) / 100 if i % 5 else None, i % 4 == 0, "prod") for i in range(n)]
    return spark.createDataFrame(rows, "finding_id long, hostname string, owner_team string, os_family string, cve_id string, package_name string, installed_version string, fixed_version string, risk_score decimal(5,2), risk_band string, due_date date, overdue boolean, days_remaining int, kev_listed boolean, epss_score decimal(6,5), internet_facing boolean, environment string")


def test_pages_equal_those_of_the_whole_view(spark, tmp_path):
    v = view(spark)
    path = f"file://{tmp_path}/t"
    risk_table.write(v, path, v.limit(50))
    assert risk_table.read(spark, path).count() == 3000 and risk_table.read(spark, path, False).count() == 50
    for sort, limit, offset, more in (("risk", 20, 0, {"band": "critical"}), ("risk", 50, 100, {}), ("due_date", 30, 5, {"band": "low"}), ("due_date", 3000, 0, {}), ("epss", 9, 0, {}), ("risk", 25, 0, {"team": "t1", "kev_only": True}), ("risk", 10, 0, {"hostname": "none"}), ("risk", None, 0, {"band": "high"})):
        want = [r.finding_id for r in reports.finding_list(v, sort, limit, offset, **more).collect()]
        assert [r.finding_id for r in risk_table.page(spark, path, sort, limit, offset, **more).collect()] == want
    plan = risk_table.page(spark, path, limit=20, band="critical")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "risk_band" in plan and "GreaterThanOrEqual(risk_score" in plan


def test_changed_facts_select_their_findings(spark):
    cve = lambda rows: spark.createDataFrame(rows, "cve_id string, cvss_v31_score decimal(3,1), cvss_v40_score decimal(3,1), cvss_severity string, kev_listed boolean, kev_ransomware boolean, kev_due_date date, epss_score decimal(6,5), description string")
    host = lambda rows: spark.createDataFrame(rows, "asset_id long, hostname string, os_family string, environment string, business_criticality int, internet_facing boolean, data_classification string, owner_team string, owner_email string")
    c = [(f"CVE-2020-100{i}", Decimal(7), None, None if i else "", False, False, None, Decimal("0.1"), "d") for i in range(6)]
    a = [(i, f"h{i}", "debian", "dev", 1, False, "public", "t", "e") for i in range(5)]
    before = changes.prints(cve(c), host(a))
    assert changes.changed(before, changes.prints(cve([(*r[:-1], "other words") for r in c]), host([(*r[:-1], "new@mail") for r in a]))).count() == 0
    c2 = [*c[1:3], (*c[3][:7], None, "d"), (*c[4][:4], True, *c[4][5:]), c[5], ("CVE-2020-1009", *c[0][1:])]
    a2 = [a[0], (1, "h1", "debian", "prod", *a[1][4:]), *a[2:]]
    moved = {(r.kind, r.key) for r in changes.changed(before, changes.prints(cve(c2), host(a2))).collect()}
    assert moved == {("cve", "CVE-2020-1000"), ("cve", "CVE-2020-1009"), ("cve", "CVE-2020-1003"), ("cve", "CVE-2020-1004"), ("asset", "1")}
    f = spark.createDataFrame([(10 * i + j, f"CVE-2020-100{i}", j, "open" if i != 4 or j else "fixed", dt.date(2000, 1, 1)) for i in range(6) for j in range(5)], "finding_id long, cve_id string, asset_id long, status string, first_seen date")
    got = sorted(r.finding_id for r in changes.rescore(f, cve(c2), host(a2), before).collect())
    assert got == sorted([30, 31, 32, 33, 34, 41, 42, 43, 44, 11, 21, 51])  # id 0 is gone: it can't be scored


def test_trees_tell_which_rows_to_compare(spark):
    left = spark.createDataFrame([(i, f"v{i}", i % 3) for i in range(5000)] + [(None, "x", 1)], "id long, v string, n int")
    right = left.where("id <> 77").withColumn("v", F.expr("CASE WHEN id = 4000 THEN 'other' ELSE v END")).unionByName(spark.createDataFrame([(9999, "new", 0)], "id long, v string, n int"))
    right = right.unionByName(left.where("id IS NULL")).select("n", "v", "id")
    for bits in (0, 3, 8, None):
        r = merge.reconcile_by_tree(left, right, "id", bits).first()
        assert (r.source_rows, r.target_rows, r.missing, r.surplus, r.changed, r.in_sync) == (5001, 5001, 1, 1, 1, False)
    assert merge.reconcile_by_tree(left, right, "id", 8).first().compared < 300
    same = merge.reconcile_by_tree(left, left.repartition(3), "id", 8).first()
    assert same.in_sync and same.compared == 0
    none = merge.reconcile_by_tree(left.limit(0), left.limit(0), "id").first()
    assert none.in_sync and none.source_rows == 0


def test_repeats_and_late_rows_change_nothing(spark, tmp_path):
    schema = "k string, at timestamp, n int"
    row = lambda k, day, n=1: (k, dt.datetime(2000, 1, day), n)
    parts = [[row("a", 1), row("b", 1)], [row("a", 1), row("c", 2)], [row("d", 20)], [row("a", 1), row("c", 2), row("e", 20)], [row("e", 20), row("d", 20), row("f", 21)]]
    for some in (parts[:2], parts[2:]):  # stopped after two files, and started again
        for rows in some:
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/n={parts.index(rows)}")
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
        once = stream.without_repeats(source, ["k", "at"], "at", "5 days")
        once.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "c", "d", "e", "f"]


def test_trailing_windows_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    rng = random.Random(5)
    day = dt.datetime(2000, 1, 1)
    rows = [(i, rng.randrange(4), day + dt.timedelta(minutes=rng.choice([i, i + rng.randrange(20), 10 * (i // 10)])), float(rng.randrange(50))) for i in range(400)]
    schema = "event_id long, key long, ts timestamp, weight double"
    parts = [rows[i : i + 80] for i in range(0, 400, 80)] + [[(None, None, day + dt.timedelta(days=9), None)]]
    for some in (parts[:3], parts[3:]):  # stopped, and started again from the state
        for part in some:
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/n={parts.index(part)}")
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
        told = stream.stream_trailing(source, 1800, 3, 60.0, "30 minutes")
        told.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    columns = ["event_id", "key", "calls", "used", "breach"]
    want = stream.quota_audit(spark.createDataFrame(rows, schema), 1800, 3, 60.0).select(*columns).collect()
    assert sorted(map(tuple, spark.read.schema(told.schema).parquet(f"{tmp_path}/out").select(*columns).collect())) == sorted(map(tuple, want))


def test_trailing_sums_that_just_meet_the_limit(spark, tmp_path):
    day = dt.datetime(2000, 1, 1)
    rng = random.Random(3)
    # 0.1 + 59.9 meets 60 and doesn't break it, whatever came before; null keys and null weights are events, too.
    rows = []
    for i in range(60):
        key, x = rng.choice([1, 2, None]), round(rng.uniform(0, 59), 2)
        rows += [(2 * i + j, key, day + dt.timedelta(hours=2 * i, minutes=20 * j), w) for j, w in enumerate((x, round(60 - x, 2) if i % 15 else None))]
    schema = "event_id long, key long, ts timestamp, weight double"
    for n, part in enumerate((rows, [(None, None, day + dt.timedelta(days=99), None)])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/n={n}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    told = stream.stream_trailing(source, 1800, 3, 60.0, "30 minutes")
    told.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    columns = ["event_id", "key", "calls", "used", "breach"]
    want = stream.quota_audit(spark.createDataFrame(rows, schema), 1800, 3, 60.0).select(*columns).collect()
    got = spark.read.schema(told.schema).parquet(f"{tmp_path}/out").select(*columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 120


def test_grounding_without_context_or_text(spark):
    rows = [(1, "Install 9.9.9 for CVE-2020-1234", None, ["9.9.9"]), (2, "Install 9.9.9 for CVE-2020-1234", [None], None), (3, None, None, None), (4, None, ["x"], ["1.2.3", None]), (5, "Install 9.9.9", ["go to 9.9.9"], None)]
    got = {r.id: (r.passed, r.reason) for r in grounding.check_grounding(spark.createDataFrame(rows, "id int, markdown string, context array<string>, required array<string>")).collect()}
    lacks = "ids without evidence: CVE-2020-1234; versions without evidence: 9.9.9"
    assert got == {1: (False, lacks), 2: (False, lacks), 3: (True, "grounded"), 4: (False, "target not named: 1.2.3"), 5: (True, "grounded")}


def test_vectors_without_direction_take_no_part(spark):
    rng = random.Random(2)
    real = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(40)]
    odd = [(100 + i, v) for i, v in enumerate([[0.0] * 4] * 12 + [None, [float("nan")] * 4, [1.0, None, 1.0, 1.0], [float("inf")] * 4, [1.0, 2.0]])]
    corpus = spark.createDataFrame(real + odd, "vec_id long, embedding array<double>").coalesce(1)
    asked = corpus.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = retrieval.dense_search(asked, corpus, 3).collect()
    assert len(got) == 8 * 3 and all(r.vec_id < 40 and r.query_id < 40 for r in got)
    label = lambda df: df.withColumn("label", F.lit(1))
    assert len(retrieval.dense_search(label(asked), label(corpus), 3, on=["label"]).collect()) == 8 * 3


def test_ranges_hold_few_rows(spark, tmp_path, monkeypatch):
    v = view(spark)
    monkeypatch.setattr(risk_table, "RANGE_ROWS", 300)
    risk_table.write(v, f"file://{tmp_path}/t")
    files = risk_table.read(spark, f"file://{tmp_path}/t").groupBy(F.input_file_name()).count().collect()
    assert len(files) > 8 and max(r["count"] for r in files) <= 900
    want = [r.finding_id for r in reports.finding_list(v, "risk", 40, 10).collect()]
    assert [r.finding_id for r in risk_table.page(spark, f"file://{tmp_path}/t", "risk", 40, 10).collect()] == want


def test_parts_grow_with_the_rows(spark, monkeypatch):
    from fathomline import queries

    monkeypatch.setattr(queries, "PART_ROWS", 100)
    assert queries._parts(spark.range(2001)) == 21 and queries._parts(spark.range(5)) == 8


def test_repeats_are_told_by_hashes_of_keys(spark, tmp_path):
    schema, day = "a string, b string, at timestamp", dt.datetime(2000, 1, 1)
    rows = [("x", None, day), (None, "x", day), ("x", None, day), ("x", "x", day), (None, None, day), (None, None, day)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    once = stream.without_repeats(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ["a", "b"], "at", "1 day")
    plan = once._jdf.queryExecution().analyzed().toString()
    assert "_seen1" in plan.split("DeduplicateWithinWatermark")[1].split("\n")[0] and once.columns == ["a", "b", "at"]
    once.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(str, ((r.a, r.b) for r in spark.read.schema(schema).parquet(f"{tmp_path}/out").collect()))) == sorted(map(str, [("x", None), (None, "x"), ("x", "x"), (None, None)]))


def test_what_a_stream_remembers_lies_on_disk(spark, tmp_path):
    schema = "asset_id long, cve_id string, package_name string, installed_version string, last_scan_id int, last_seen date, fixed_version string, status string, at timestamp"
    row = lambda a: (a, "CVE-2020-1000", "p", "1", 1, None, None, "open", dt.datetime(2000, 1, 1))
    for n, rows in enumerate([[row(1), row(2)], [row(2), row(3)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/n={n}")
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    once = stream.without_repeats(source, ["asset_id"], "at", "1 day").drop("at")
    stream.stream_merge(once, f"file://{tmp_path}/out", lambda b: b, f"file://{tmp_path}/state", parts=2)
    assert sorted(r.asset_id for r in stream.current(spark, f"file://{tmp_path}/out").collect()) == [1, 2, 3]
    kept = {f.suffix for f in (tmp_path / "state" / "state").rglob("*") if f.is_file() and not f.name.startswith((".", "_"))}
    assert kept & {".zip", ".changelog"} and ".delta" not in kept and spark.conf.get("spark.sql.streaming.stateStore.providerClass") == was
