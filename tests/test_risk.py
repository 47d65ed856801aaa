import datetime as dt
import decimal

from pyspark.sql import functions as F

from fathomline.operators import risk as R

D = decimal.Decimal
CVE = "cve_id string, cvss_v31_score decimal(3,1), cvss_v40_score decimal(3,1), cvss_severity string, kev_listed boolean, kev_ransomware boolean, kev_due_date date, epss_score decimal(6,5)"
ASSET = "asset_id long, hostname string, os_family string, environment string, business_criticality int, internet_facing boolean, data_classification string, owner_team string, owner_email string"


def assess(spark, cve, asset, seen=dt.date(2024, 1, 10)):
    c = spark.createDataFrame([("CVE-1", *cve)], CVE)
    a = spark.createDataFrame([(1, "h", "debian", *asset, "t", "e")], ASSET)
    f = spark.createDataFrame([(1, 1, "CVE-1", seen, "open")], "finding_id long, asset_id long, cve_id string, first_seen date, status string")
    return R.assess(f, c, a).first()


def test_saturation_and_defaults(spark):
    r = assess(spark, (D("10.0"), None, None, True, True, None, D("0.9")), ("prod", 9, True, "restricted"))
    assert (r.risk_score, r.risk_band, r.due_date, r.sla_rule) == (100, "critical", dt.date(2024, 1, 13), "emergency_kev_internet_facing")
    r = assess(spark, (None, None, None, False, False, None, None), ("dev", 1, False, "public"))
    assert (r.risk_score, r.cvss_source, r.risk_band, r.sla_days) == (20, "unscored_default", "low", 90)


def test_floor_and_deadlines(spark):
    r = assess(spark, (D("3.0"), None, None, True, True, dt.date(2023, 1, 1), None), ("dev", 1, False, "public"))
    assert (r.risk_band, r.floor_rule, r.scored_band, r.sla_rule, r.kev_deadline_passed, r.sla_days) == ("critical", "kev_ransomware_floor", "medium", "kev_deadline_already_passed", True, 3)
    r = assess(spark, (D("9.0"), None, None, True, False, dt.date(2024, 1, 12), None), ("prod", 1, False, "public"))
    assert (r.sla_rule, r.sla_days, r.due_date) == ("cisa_kev_due_date_ceiling", 2, dt.date(2024, 1, 12))
    r = assess(spark, (D("9.0"), None, None, True, False, dt.date(2025, 1, 1), None), ("prod", 1, False, "public"))
    assert r.sla_rule == f"band_baseline_{r.risk_band}" and not r.kev_deadline_passed


def test_scoring_again_writes_nothing(spark):
    rows = spark.createDataFrame([(1, "p", "high", dt.date(2024, 1, 1), D("60.00")), (2, "p", "low", dt.date(2024, 1, 1), None)], "finding_id long, policy_version string, risk_band string, due_date date, risk_score decimal(5,2)")
    history = rows.selectExpr("*", "true AS is_current")
    assert R.changed(rows, history).count() == 0
    moved = rows.selectExpr("finding_id", "policy_version", "risk_band", "due_date", "cast(risk_score + 1 AS decimal(5,2)) AS risk_score")
    after = R.append_history(history, R.changed(moved, history))
    assert sorted((r.finding_id, r.is_current) for r in after.collect()) == [(1, False), (1, True), (2, True)]


def test_old_factors_are_parsed_once(spark):
    rows = [(1, '{"components":{"severity":{"points":"4.00","max":"40"}},"band_floor_rule":"kev_floor","scored_band":"low","sla":{"rule":"r","kev_deadline_passed":false}}'), (2, '{"other":1}'), (3, None)]
    made = spark.createDataFrame(rows, "id long, old string").select("id", R.reshape_factors(F.col("old")).alias("new"))
    got = {r.id: r["new"] for r in made.collect()}
    assert got == {1: '{"components":{"severity":{"points":"4.00"}},"band_floor":{"rule":"kev_floor","scored_band":"low"},"sla":{"rule":"r"}}', 2: rows[1][1], 3: None}
    assert made._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
