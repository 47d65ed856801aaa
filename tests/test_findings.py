from pyspark.sql import functions as F

from fathomline import fixtures as fx
from fathomline.operators import correlate, risk
from fathomline.session import written


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _tables(spark, where):
    """Odd keys: negative, repeated, without a line number, a brand or a line; and hits that are seen twice."""
    line = [(o, k, n, flag, state, f"199{i % 9}-02-03 00:00:00") for i, (o, k, n, flag, state) in enumerate(
        [(o, k, n, "RAN"[(o + k) % 3], "FO"[k % 2]) for o in (1, 2, 3, 4) for k in (-7, -9, 0, 8, 9, 364, 3276, 3285) for n in (1, 7, None)] * 2)]
    tables = {
        "lineitem": spark.createDataFrame([*line, (9, 8, 1, "N", "O", None), (1, None, 1, "N", "O", None)], "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_shipdate string"),
        "orders": spark.createDataFrame([(1, -1, "1995-01-01"), (2, 3, "1994-01-01"), (3, 4, None), (4, 3, "1993-01-01"), (4, 5, "1992-01-01")], "o_orderkey long, o_custkey long, o_orderdate string"),
        "part": spark.createDataFrame([(k, b) for k in (-7, -9, 0, 8, 9, 364, 3276, 3285) for b in (["Brand#1", "BRAND#1"] if k == 8 else [None if k == 9 else "Brand#2"])], "p_partkey long, p_brand string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{where}/{name}.parquet")
    return str(where)


def test_findings_equal_those_of_staged_rows(spark, tmp_path):
    where = _tables(spark, tmp_path / "t")
    got, want = fx.findings(spark, where), fx.findings_of(fx.staged(spark, where))
    assert got.dtypes == want.dtypes and want.count() > 50
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_fixes_are_chosen_for_kinds_of_texts(spark, tmp_path):
    plan = _plan(fx.findings(spark, _tables(spark, tmp_path / "t")).where("fixed_version IS NOT NULL"))
    assert "SortAggregate" not in plan
    chosen = [x for x in plan.splitlines() if "regexp_extract_all" in x]
    # The filter on fixes stays above the rows' distinct kinds: nothing below them takes a version apart.
    kinds = max(i for i, x in enumerate(plan.splitlines()) if "Generate" in x)
    assert chosen and all(plan.splitlines().index(x) < kinds for x in chosen)


def _view(spark):
    teams = [("a", None), (None, "a"), (None, None), ("b", "b")]
    rows = [(i, f"h{i % 40:02}", "prod" if i % 3 else "dev", i % 5 == 0, *teams[i % 4], f"p{i % 2}", "rhel", "high", i, i / 1000, f"CVE-{i % 30}", i % 7 == 0, f"1.{i % 9}", f"2.{i % 4}" if i % 6 else None) for i in range(400)]
    v = spark.createDataFrame(rows, "asset_id long, hostname string, environment string, internet_facing boolean, owner_team string, owner_email string, package_name string, os_family string, risk_band string, risk_score int, epss_score double, cve_id string, kev_listed boolean, installed_version string, fixed_version string")
    return written(v.withColumn("due_date", F.expr("date_add(date '2000-01-01', risk_score)")), "view")


def test_groups_move_by_number(spark):
    v = _view(spark)
    got = correlate.groups(v)
    assert "hashpartitioning(owner_team" not in _plan(got)
    want = {}
    for r in v.collect():
        g = want.setdefault((r.owner_team, r.owner_email, r.package_name, r.os_family, r.risk_band, r.fixed_version is not None), {"ids": set(), "hosts": set(), "n": 0, "min": []})
        g["ids"].add(r.cve_id), g["hosts"].add(r.hostname), g["min"].append(r.installed_version)
        g["n"] += 1
    found = {tuple(r[c] for c in correlate.GROUP): r for r in got.collect()}
    assert found.keys() == want.keys()
    for k, g in want.items():
        r = found[k]
        assert (r.cve_ids, r.hostnames, r.finding_count, r.installed_version) == (sorted(g["ids"]), sorted(g["hosts"]), g["n"], min(g["min"]))
    # With few bits hashes meet, and others are tried.
    rows = v.withColumn("has_fix", F.col("fixed_version").isNotNull())
    known, _ = correlate._numbered(rows, 6)
    assert known.count() == known.select("group").distinct().count() == len(want)


def test_components_are_made_before_the_join(spark):
    f = spark.createDataFrame([(1, 1, "CVE-1", "open", "2000-01-01")], "finding_id long, asset_id long, cve_id string, status string, first_seen string").withColumn("first_seen", F.col("first_seen").cast("date"))
    c = spark.createDataFrame([("CVE-1",)], "cve_id string").withColumns({**{s: F.lit(None).cast("decimal(3,1)") for s in ("cvss_v31_score", "cvss_v40_score")}, "cvss_severity": F.lit("HIGH"), "kev_listed": F.lit(False), "kev_ransomware": F.lit(False), "kev_due_date": F.lit(None).cast("date"), "epss_score": F.rand()})
    a = spark.createDataFrame([(1, "h")], "asset_id long, hostname string").withColumns({x: F.lit("x") for x in ("os_family", "environment", "data_classification", "owner_team", "owner_email")}).withColumns({"business_criticality": F.col("asset_id").cast("int"), "internet_facing": F.lit(True)})
    lines = risk.assess(f, c, a).select("exploit_reason")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = next(i for i, x in enumerate(lines) if "epss_gte_50pct" in x)
    assert max(i for i, x in enumerate(lines) if "Join" in x) < made
