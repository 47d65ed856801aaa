"""Risk scores, due dates and the history of assessments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

POLICY = "2026.09.1"
# Fixed values of the policy.
LABEL_SCORE = {"CRITICAL": "9.0", "HIGH": "7.5", "MEDIUM": "5.0", "LOW": "2.0"}
DATA_POINTS = {"restricted": 5, "confidential": 3, "internal": 1, "public": 0}
BANDS = {"critical": 75, "high": 55, "medium": 35, "low": 0}
SLA_DAYS = {"critical": 7, "high": 15, "medium": 45, "low": 90}
EMERGENCY_DAYS = 3


def _case(column: Column, values: dict, default=None) -> Column:
    out = F
    for k, v in values.items():
        out = out.when(column == k, F.lit(v))
    return out if default is None else out.otherwise(F.lit(default))


def _points(c) -> Column:
    return (F.lit(c) if not isinstance(c, Column) else c).cast("decimal(5,2)")


def facts(findings: DataFrame, cves: DataFrame, assets: DataFrame, of_id: Callable[[DataFrame], DataFrame] = lambda c: c, of_asset: Callable[[DataFrame], DataFrame] = lambda a: a) -> DataFrame:
    """Open findings with what the policy looks at; and with what of_id() and of_asset() make of the ids and assets before these meet the findings."""
    c = cves.select("cve_id", "cvss_v31_score", "cvss_v40_score", "cvss_severity", "kev_listed", "kev_ransomware", "kev_due_date", "epss_score")
    a = assets.select("asset_id", "hostname", "os_family", "environment", "business_criticality", "internet_facing", "data_classification", "owner_team", "owner_email")
    return findings.where("status = 'open'").join(of_id(c), "cve_id").join(of_asset(a), "asset_id")


# The names of sources, reasons and rules in the components, scored() and with_sla().
def _of_id(rows: DataFrame) -> DataFrame:
    """The components that an id decides, severity and exploit, each with what decided it."""
    label = _case(F.upper("cvss_severity"), LABEL_SCORE).cast("decimal(3,1)")
    base = F.coalesce("cvss_v31_score", "cvss_v40_score", label, F.lit("5.0").cast("decimal(3,1)"))
    source = F.when(F.col("cvss_v31_score").isNotNull(), "cvss_v31").when(F.col("cvss_v40_score").isNotNull(), "cvss_v40").when(label.isNotNull(), "severity_label_fallback").otherwise("unscored_default")
    epss = F.col("epss_score")
    ladder = lambda v: F.when(F.col("kev_listed") & F.col("kev_ransomware"), v[0]).when(F.col("kev_listed"), v[1]).when(epss.isNull(), v[2]).when(epss >= 0.5, v[3]).when(epss >= 0.1, v[4]).when(epss >= 0.01, v[5]).otherwise(v[6])
    return rows.withColumns({
        "cvss_base": base, "cvss_source": source, "severity_points": _points(F.least(base * 4, F.lit(40))),
        "exploit_points": _points(ladder([30, 25, 0, 20, 12, 6, 0])), "exploit_reason": ladder(["kev_ransomware", "kev_listed", "no_epss_data", "epss_gte_50pct", "epss_gte_10pct", "epss_gte_1pct", "epss_below_1pct"]),
    })


def _of_asset(rows: DataFrame) -> DataFrame:
    """The components that an asset decides, exposure and the asset's own, each with what decided it."""
    env, inet = F.lower("environment"), F.col("internet_facing")
    exposed = lambda v: F.when(inet & (env == "prod"), v[0]).when(inet, v[1]).when(env == "prod", v[2]).when(env == "staging", v[3]).otherwise(v[4])
    inside = F.concat(F.lit("internal_"), env)
    criticality = (F.least(F.lit(5), F.greatest(F.lit(1), "business_criticality")) - 1) * F.lit("2.5").cast("decimal(3,1)")
    data = _case(F.lower("data_classification"), DATA_POINTS, 1)
    return rows.withColumns({
        "exposure_points": _points(exposed([15, 10, 6, 3, 0])), "exposure_reason": exposed([F.lit("internet_facing_prod"), F.lit("internet_facing_nonprod"), inside, inside, inside]),
        "criticality_points": _points(criticality), "data_points": _points(data), "asset_points": _points(F.least(criticality + data, F.lit(15))),
    })


def components(rows: DataFrame) -> DataFrame:
    """The four capped components, each with what decided it."""
    return _of_asset(_of_id(rows))


def rank(band: Column) -> Column:
    return _case(band, {"low": 0, "medium": 1, "high": 2, "critical": 3})


def scored(rows: DataFrame) -> DataFrame:
    """components() with risk_score, the band it falls into, and the band after the floors of exploited ids."""
    return _banded(components(rows))


def _banded(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("risk_score", (F.col("severity_points") + F.col("exploit_points") + F.col("exposure_points") + F.col("asset_points")).cast("decimal(5,2)"))
    band = F
    for name, least in BANDS.items():
        band = band.when(F.col("risk_score") >= least, name)
    rows = rows.withColumn("scored_band", band.otherwise("low"))
    floor = F.when(F.col("kev_listed") & F.col("kev_ransomware"), "critical").when(F.col("kev_listed"), "high")
    moved = rank(floor) > rank(F.col("scored_band"))
    rule = F.when(moved, F.when(F.col("kev_ransomware"), "kev_ransomware_floor").otherwise("kev_floor"))
    return rows.withColumns({"risk_band": F.when(moved, floor).otherwise(F.col("scored_band")), "floor_rule": rule})


def with_sla(rows: DataFrame) -> DataFrame:
    """sla_days, due_date, sla_rule, kev_deadline_passed: the strictest rule that applies."""
    days, due, seen = _case(F.col("risk_band"), SLA_DAYS, 90), F.col("kev_due_date"), F.col("first_seen")
    listed = F.col("kev_listed") & due.isNotNull()
    emergency, passed, ceiling = F.col("kev_listed") & F.col("internet_facing"), listed & (due < seen), listed & (due < F.date_add(seen, days))
    pick = lambda a, b, c, d: F.when(emergency, a).when(passed, b).when(ceiling, c).otherwise(d)
    soon = F.lit(EMERGENCY_DAYS)
    return rows.withColumns({
        "sla_days": pick(soon, soon, F.greatest(F.datediff(due, seen), F.lit(0)), days), "due_date": pick(F.date_add(seen, soon), F.date_add(seen, soon), due, F.date_add(seen, days)),
        "sla_rule": pick(F.lit("emergency_kev_internet_facing"), F.lit("kev_deadline_already_passed"), F.lit("cisa_kev_due_date_ceiling"), F.concat(F.lit("band_baseline_"), "risk_band")),
        "kev_deadline_passed": F.coalesce((emergency | passed) & (due < seen), F.lit(False)),
    })


def assess(findings: DataFrame, cves: DataFrame, assets: DataFrame) -> DataFrame:
    """Scored open findings with their dates; components are made once for each id and asset, not for each finding."""
    return with_sla(_banded(facts(findings, cves, assets, _of_id, _of_asset)))


def factors(rows: DataFrame) -> DataFrame:
    """factors: what each component saw and earned, and the floor where one moved the band."""
    part = lambda points, **more: F.struct(F.col(points).alias("points"), *(F.col(v).alias(k) for k, v in more.items()))
    parts = F.struct(
        part("severity_points", cvss_base="cvss_base", cvss_source="cvss_source").alias("severity"), part("exploit_points", kev_listed="kev_listed", kev_ransomware="kev_ransomware", epss_score="epss_score", reason="exploit_reason").alias("exploit"),
        part("exposure_points", internet_facing="internet_facing", environment="environment", reason="exposure_reason").alias("exposure"), part("asset_points", business_criticality="business_criticality", criticality_points="criticality_points", data_classification="data_classification", data_points="data_points").alias("asset"),
    )
    floor = F.when(F.col("floor_rule").isNotNull(), F.struct(F.col("floor_rule").alias("rule"), "scored_band"))
    return rows.withColumn("factors", F.struct(parts.alias("components"), floor.alias("band_floor")))


def factors_json(rows: DataFrame) -> DataFrame:
    """finding_id, policy_version and factors as JSON text; what is null isn't written."""
    return factors(rows).select("finding_id", F.lit(POLICY).alias("policy_version"), F.to_json("factors").alias("factors"))


_OLD = "components map<string, map<string, string>>, band_floor_rule string, scored_band string, sla struct<rule: string, kev_deadline_passed: boolean, kev_due_date: string>"


def reshape_factors(factors: Column) -> Column:
    """Factors of the old shape, as JSON text, in the new one: no `max` in the components, the floor's rule and band in one struct, flags of the date only where they hold."""

    def present(old: Column) -> Column:
        parts = F.transform_values(old["components"], lambda _, v: F.map_filter(v, lambda k, _: k != "max"))
        floor = F.when(old["band_floor_rule"].isNotNull(), F.struct(old["band_floor_rule"].alias("rule"), old["scored_band"].alias("scored_band")))
        sla = F.when(old["sla"].isNotNull(), F.struct(old["sla"]["rule"].alias("rule"), F.when(old["sla"]["kev_deadline_passed"], F.lit(True)).alias("kev_deadline_passed"), old["sla"]["kev_due_date"].alias("kev_due_date")))
        return F.when(old["components"].isNotNull(), F.struct(parts.alias("components"), floor.alias("band_floor"), sla.alias("sla")))

    # As a list of one, so that the text is parsed once for all that looks into it.
    return F.coalesce(F.to_json(F.transform(F.array(F.from_json(factors, _OLD)), present)[0]), factors)


def explain(rows: DataFrame) -> DataFrame:
    """Each finding's components as rows, with the total added up anew."""
    pair = lambda n, c, r: F.struct(F.lit(n).alias("component"), F.col(c).alias("points"), F.col(r).cast("string").alias("reason"))
    parts = F.array(pair("severity", "severity_points", "cvss_source"), pair("exploit", "exploit_points", "exploit_reason"), pair("exposure", "exposure_points", "exposure_reason"), pair("asset", "asset_points", "data_classification"))
    total = F.aggregate(parts, F.lit(0).cast("decimal(7,2)"), lambda s, p: (s + p["points"]).cast("decimal(7,2)"))
    return rows.select("finding_id", "risk_score", total.alias("total"), "floor_rule", "sla_rule", F.explode(parts).alias("p")).select("finding_id", "risk_score", "total", "floor_rule", "sla_rule", "p.*")


def current_risk(assessed: DataFrame, as_of: str) -> DataFrame:
    """The read view: current assessments with overdue and days_remaining at a date."""
    day = F.lit(as_of).cast("date")
    return assessed.withColumns({"overdue": F.col("due_date") < day, "days_remaining": F.datediff("due_date", day)})


OUTCOME = ["policy_version", "risk_band", "due_date", "risk_score"]


def changed(new: DataFrame, current: DataFrame) -> DataFrame:
    """New assessments whose outcome differs from the current one, or that have none."""
    old = current.select(F.col("finding_id").alias("_f"), *(F.col(c).alias(f"_{c}") for c in OUTCOME))
    same = F.col("_f").isNotNull()
    for c in OUTCOME:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return new.join(old, F.col("finding_id") == F.col("_f"), "left").where(~same).select(*new.columns)


def append_history(history: DataFrame, new: DataFrame) -> DataFrame:
    """History with the changed outcomes as current rows, what they replace demoted, the rest untouched."""
    fresh = new.withColumn("is_current", F.lit(True))
    keys = fresh.select("finding_id", F.lit(True).alias("_new"))
    old = history.join(keys, "finding_id", "left").withColumn("is_current", F.col("is_current") & F.col("_new").isNull()).drop("_new")
    return old.select(*history.columns).unionByName(fresh.select(*history.columns))


def backfill_current(history: DataFrame) -> DataFrame:
    """is_current by the latest computed_at, then the highest id."""
    order = Window.partitionBy("finding_id").orderBy(F.desc("computed_at"), F.desc("assessment_id"))
    return history.withColumn("is_current", F.row_number().over(order) == 1)


def latest(history: DataFrame) -> DataFrame:
    """The newest assessment of each finding from raw history, without a flag."""
    best = F.max_by(F.struct(*history.columns), F.struct("computed_at", "assessment_id"))
    return history.groupBy("finding_id").agg(best.alias("b")).select("b.*")


def prune(history: DataFrame, before: str) -> DataFrame:
    """Superseded rows older than a date lose their explanation."""
    old = ~F.col("is_current") & (F.col("computed_at") < F.lit(before).cast("date")) & F.col("explanation").isNotNull()
    return history.withColumns({"pruned": F.coalesce(old, F.lit(False)), "explanation": F.when(~F.coalesce(old, F.lit(False)), F.col("explanation"))})
