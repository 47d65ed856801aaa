"""Triage and reporting over the current-risk view."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (name, rows) of several tables."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def stats_row(tables: dict[str, DataFrame]) -> DataFrame:
    """The same counts as columns of one row."""
    names = list(tables)
    return table_counts(tables).agg(*(F.sum(F.when(F.col("name") == n, F.col("rows")).otherwise(0)).alias(n) for n in names))


def band_distribution(view: DataFrame) -> DataFrame:
    per = view.groupBy("risk_band", "asset_id").agg(F.count("*").alias("n"), F.count_if("overdue").alias("o"), F.count_if("kev_listed").alias("k"))
    order = F.expr("CASE risk_band WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END")
    return per.groupBy("risk_band").agg(F.sum("n").alias("findings"), F.sum("o").alias("overdue"), F.count("*").alias("assets"), F.sum("k").alias("kev")).orderBy(order)


def due_backlog(view: DataFrame, as_of: str, weeks: int = 12) -> DataFrame:
    """Open findings by the week, from Monday, in which they fall due, before as_of plus `weeks` weeks."""
    rows = view.where(F.col("due_date") < F.date_add(F.lit(as_of).cast("date"), 7 * weeks))
    return rows.groupBy(F.date_format(F.date_trunc("week", "due_date"), "yyyy-MM-dd").alias("week")).agg(F.count("*").alias("findings"), F.count_if(F.col("risk_band").isin("critical", "high")).alias("urgent")).orderBy("week")


def asset_list(assets: DataFrame, view: DataFrame, team: str | None = None, environment: str | None = None, internet_facing: bool | None = None, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Assets with their open findings and worst score, worst first."""
    a = assets
    for column, value in (("owner_team", team), ("environment", environment), ("internet_facing", internet_facing)):
        if value is not None:
            a = a.where(F.col(column) == value)
    worst = view.groupBy("asset_id").agg(F.count("*").alias("open_findings"), F.max("risk_score").alias("worst_risk_score"))
    rows = a.join(worst, "asset_id", "left").withColumn("open_findings", F.coalesce("open_findings", F.lit(0)))
    rows = rows.orderBy(F.desc_nulls_last("worst_risk_score"), "hostname")
    rows = rows.offset(offset) if offset else rows
    return rows.limit(limit) if limit is not None else rows


FILTERS = {"band": "risk_band", "team": "owner_team", "hostname": "hostname", "cve_id": "cve_id", "package": "package_name", "environment": "environment", "internet_facing": "internet_facing"}
ORDERS = {
    "risk": lambda: [F.desc("risk_score"), F.desc_nulls_last("epss_score")],
    "due_date": lambda: [F.asc("due_date"), F.desc("risk_score")],
    "epss": lambda: [F.desc_nulls_last("epss_score"), F.desc("risk_score")],
}
SHOWN = ["finding_id", "hostname", "owner_team", "os_family", "cve_id", "package_name", "installed_version", "fixed_version", "risk_score", "risk_band", "due_date", "overdue", "days_remaining", "kev_listed", "epss_score", "internet_facing", "environment"]


def finding_list(view: DataFrame, sort: str = "risk", limit: int | None = 50, offset: int = 0, kev_only: bool = False, overdue_only: bool = False, **filters) -> DataFrame:
    """Open findings, filtered and sorted; finding_id settles ties, so pages are stable."""
    rows = view
    for name, value in filters.items():
        if value is not None:
            rows = rows.where(F.col(FILTERS[name]) == value)
    if kev_only:
        rows = rows.where("kev_listed")
    if overdue_only:
        rows = rows.where("overdue")
    rows = rows.select(*SHOWN).orderBy(*ORDERS[sort](), "finding_id")
    rows = rows.offset(offset) if offset else rows
    return rows.limit(limit) if limit is not None else rows


def cve_lookup(cves: DataFrame, findings: DataFrame, ids: list[str]) -> DataFrame:
    """The ids asked for, in any case, with affected assets and packages."""
    wanted = cves.where(F.col("cve_id").isin([i.upper() for i in ids]))
    hit = findings.where("status = 'open'").join(wanted.select("cve_id"), "cve_id", "left_semi").groupBy("cve_id").agg(F.count_distinct("asset_id").alias("affected_assets"), F.array_sort(F.collect_set("package_name")).alias("affected_packages"))
    return wanted.join(hit, "cve_id", "left").withColumn("affected_assets", F.coalesce("affected_assets", F.lit(0)))


def team_workload(view: DataFrame) -> DataFrame:
    per = view.groupBy("owner_team", "owner_email", "asset_id").agg(F.count("*").alias("n"), F.count_if(F.col("risk_band") == "critical").alias("c"), F.count_if(F.col("risk_band") == "high").alias("h"), F.count_if("overdue").alias("o"), F.min("due_date").alias("d"), F.max("risk_score").alias("s"))
    out = per.groupBy("owner_team", "owner_email").agg(F.sum("n").alias("open_findings"), F.count("*").alias("assets"), F.sum("c").alias("critical"), F.sum("h").alias("high"), F.sum("o").alias("overdue"), F.min("d").alias("next_due"), F.round(F.max("s"), 1).alias("worst_risk_score"))
    return out.orderBy(F.desc("critical"), F.desc("open_findings"), "owner_team")


def overview(view: DataFrame, actions: DataFrame) -> DataFrame:
    """The tiles: open findings, actions, findings per action, overdue, critical and listed."""
    a = actions.agg(F.count("*").alias("actions"))
    v = view.agg(F.count("*").alias("open_findings"), F.count_if("overdue").alias("overdue"), F.count_if(F.col("risk_band") == "critical").alias("critical"), F.count_if("kev_listed").alias("kev"))
    return v.crossJoin(a).withColumn("reduction", F.round(F.col("open_findings") / F.col("actions"), 1))  # one row each


SHOWN_HOSTS = 20


def plan_flags(actions: DataFrame, plans: DataFrame) -> DataFrame:
    """Actions, with their first hosts, whether a plan for their package and version exists, and whether one is grounded."""
    known = plans.groupBy(F.col("package_name").alias("_p"), F.col("fixed_version").alias("_v")).agg(F.max("grounded").alias("plan_grounded"))
    rows = actions.join(known, (F.col("package_name") == F.col("_p")) & F.col("fixed_version").eqNullSafe(F.col("_v")), "left")
    return rows.withColumns({"has_plan": F.col("_p").isNotNull(), "plan_grounded": F.coalesce("plan_grounded", F.lit(False)), "hostnames": F.slice("hostnames", 1, SHOWN_HOSTS)}).drop("_p", "_v")


def plan_by_id(plans: DataFrame, wanted: DataFrame) -> DataFrame:
    """The plans with the ids in wanted (plan_id)."""
    return plans.join(wanted.select("plan_id").distinct(), "plan_id", "left_semi")


def plan_list(plans: DataFrame, grounded_only: bool = True, limit: int = 50) -> DataFrame:
    rows = plans.where("grounded") if grounded_only else plans
    return rows.orderBy(F.desc("created_at"), "plan_id").limit(limit)


def plan_coverage(plans: DataFrame) -> DataFrame:
    return plans.groupBy("grounded").agg(F.count("*").alias("plans"), F.count_distinct("package_name").alias("packages"))
