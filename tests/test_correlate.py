import datetime

from pyspark.sql import functions as F

from fathomline.operators import correlate as C

SCHEMA = "asset_id long, hostname string, environment string, internet_facing boolean, owner_team string, owner_email string, package_name string, os_family string, risk_band string, risk_score decimal(5,2), epss_score decimal(6,5), due_date date, cve_id string, kev_listed boolean, installed_version string, fixed_version string"


def view(spark, rows):
    from decimal import Decimal

    day = datetime.date(2000, 1, 1)
    make = lambda a, team, package, system, band, score, cve, kev, now, fix: (a, f"h{a:04}", "prod" if a % 2 else "dev", a % 3 == 0, team, team and team + "@x", package, system, band, Decimal(score), Decimal("0.2"), day + datetime.timedelta(a % 50), cve, kev, now, fix)
    return spark.createDataFrame([make(*r) for r in rows], SCHEMA).repartition(3)


def test_targets_do_not_depend_on_the_bands_shown(spark):
    rows = [(1, "t", "lib", "debian", "critical", "90", "CVE-2020-0001", True, "1.0", "1.2"), (2, "t", "lib", "debian", "low", "10", "CVE-2020-0002", False, "1.0", "1.10"), (3, "t", "lib", "alpine", "low", "10", "CVE-2020-0003", False, "1.0", None)]
    v = view(spark, rows)
    every = {(r.os_family, r.risk_band): r for r in C.fix_actions(v).collect()}
    shown = C.fix_actions(v, bands=["critical"]).collect()
    assert [(r.fixed_version, r.version_requirements) for r in shown] == [("1.10", {"CVE-2020-0001": "1.2"})]
    assert every["debian", "critical"].fixed_version == every["debian", "low"].fixed_version == "1.10"
    none = every["alpine", "low"]
    assert none.fixed_version is None and not none.has_fix and none.version_requirements is None and none.title.endswith("(no fix available) on 1 alpine host")
    assert C.fix_actions(v, teams=["other"]).count() == 0 and C.target_violations(C.fix_actions(v)).count() == 0


def test_groups_against_plain_ones(spark):
    rows = [(a, None if a % 5 == 0 else "t", f"p{a % 2}", "rhel", "high", str(a % 90), f"CVE-2020-{1000 + a % 7}", a % 7 == 1, f"1.{a % 4}", None if a % 3 == 0 else f"2.{a % 11}") for a in range(900)]
    got = {(r.owner_team, r.package_name, r.has_fix): r for r in C.groups(view(spark, rows)).collect()}
    want = {}
    for r in rows:
        want.setdefault((r[1], r[2], r[9] is not None), []).append(r)
    assert set(got) == set(want)
    for k, found in want.items():
        r, ids = got[k], sorted({x[6] for x in found})
        assert (r.asset_count, r.finding_count, r.cve_ids, r.kev_cve_ids) == (len(found), len(found), ids, sorted({x[6] for x in found if x[7]}))
        assert r.hostnames == sorted(f"h{x[0]:04}" for x in found)[: C.HOSTS] and r.max_risk_score == max(int(x[5]) for x in found)
        assert (r.prod_count, r.internet_facing_count) == (sum(x[0] % 2 for x in found), sum(x[0] % 3 == 0 for x in found))
        assert {a.cve_id: a.required_version for a in r.asked} == ({i: max(x[9] for x in found if x[6] == i) for i in ids} if k[2] else {})


def test_most_urgent_first(spark):
    rows = [(a, f"t{a}", "lib", "debian", ("low", "critical", "medium")[a % 3], str(a), "CVE-2020-0001", False, "1.0", "1.2") for a in range(12)]
    got = C.fix_actions(view(spark, rows), limit=6).collect()
    assert [r.risk_band for r in got] == ["critical"] * 4 + ["medium"] * 2 and [r.due_date for r in got[:4]] == sorted(r.due_date for r in got[:4])


def test_violations_are_found(spark):
    rows = [(a, f"t{a}", "lib", "debian", "high", "50", "CVE-2020-0001", False, "1.0", "1.2") for a in range(4)]
    a = C.fix_actions(view(spark, rows))
    planted = a.withColumn("fixed_version", F.when(F.col("owner_team") == "t0", "1.1").when(F.col("owner_team") == "t1", "1.2-3.el9").otherwise(F.col("fixed_version"))).withColumn("idempotency_key", F.when(F.col("owner_team") > "t1", "k").otherwise(F.col("idempotency_key")))
    assert sorted((r.owner_team, r.violation) for r in C.target_violations(planted).collect()) == [("t0", "below_requirement"), ("t1", "foreign_system"), ("t2", "shared_key"), ("t3", "shared_key")]


def test_rows_carry_all_hosts(spark):
    rows = [(a, "t", "lib", "rhel", "high", "50", "CVE-2020-0001", False, "1.0", "1.2") for a in range(450)]
    assert [r.hostnames for r in C.groups(view(spark, rows)).collect()] == [[f"h{a:04}" for a in range(450)]]
