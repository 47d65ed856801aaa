from fathomline.operators import ingest, merge as M

FIND = "asset_id long, cve_id string, package_name string, installed_version string, finding_id long, last_scan_id long, last_seen string, fixed_version string, status string"


def test_merge_rules_and_idempotence(spark):
    old = spark.createDataFrame([(1, "a", "p", "1", 10, 1, "d1", None, "fixed"), (1, "b", "p", "1", 11, 1, "d1", "2", "accepted_risk")], FIND)
    new = spark.createDataFrame([(1, "a", "p", "1", 20, 2, "d2", "3", "open"), (1, "c", "p", None, 21, 2, "d2", None, "open")], FIND)
    once = ingest.merge_findings(old, new)
    assert sorted((r.cve_id, r.finding_id, r.last_scan_id, r.status, r.fixed_version) for r in once.collect()) == [("a", 10, 2, "open", "3"), ("b", 11, 1, "accepted_risk", "2"), ("c", 21, 2, "open", None)]
    assert sorted(map(str, ingest.merge_findings(once, new).collect())) == sorted(map(str, once.collect()))
    assert {r.cve_id: r.status for r in ingest.merge_findings(once, new, close_missing=True).collect()}["b"] == "accepted_risk"


def test_null_keys_meet(spark):
    t = spark.createDataFrame([(None, 1, None)], "k string, a int, b int")
    s = spark.createDataFrame([(None, 2, 5)], "k string, a int, b int")
    assert [tuple(r) for r in M.merge(t, s, ["k"], {"a": "keep", "b": "fill"}).collect()] == [(None, 1, 5)]


def test_reconcile(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "q")], "id int, v string")
    r = M.reconcile(a, b, "id").first()
    assert (r.missing, r.surplus, r.changed, r.in_sync) == (1, 1, 1, False) and M.reconcile(a, a, "id").first().in_sync
