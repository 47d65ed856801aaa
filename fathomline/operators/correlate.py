"""Findings to fix actions: the upgrades that people do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.versions import version_key
from ..session import broadcast_if_small, written

GROUP = ["owner_team", "owner_email", "package_name", "os_family", "risk_band", "has_fix"]
#: Bands by urgency.
URGENCY = "CASE risk_band WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END"
#: Hosts that a wide row carries: all of them.
HOSTS = None


# The forms of an action's key and title.
def action_key(fix: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", "owner_team", "package_name", "os_family", "risk_band", F.when(fix, "fix").otherwise("nofix")), 256), 1, 32)


def title(version: Column) -> Column:
    target = F.when(version.isNotNull(), F.concat(F.lit(" to "), version)).otherwise(F.lit(" (no fix available)"))
    hosts = F.concat(F.col("asset_count").cast("string"), F.lit(" "), "os_family", F.when(F.col("asset_count") == 1, " host").otherwise(" hosts"))
    return F.concat(F.lit("["), F.upper("risk_band"), F.lit("] Upgrade "), "package_name", target, F.lit(" on "), hosts)


#: What correlation reads of the view.
USED = ["asset_id", "hostname", "environment", "internet_facing", "owner_team", "owner_email", "package_name", "os_family", "risk_band", "risk_score", "epss_score", "due_date", "cve_id", "kev_listed", "installed_version", "fixed_version"]


def groups(view: DataFrame) -> DataFrame:
    """Open findings by team, package, system, band and whether there is a fix; with the versions that its ids ask for.

    Hosts and ids come down to one row of a group each first, hosts to one of a group then; lists hold all names of hosts.
    The rows of all kinds then meet in one aggregation; null keys are keys. Texts are taken as keys where
    that does, and not as minima or maxima: aggregations by hash hold no texts, and those by sorting cost more.
    """
    rows = view.withColumn("has_fix", F.col("fixed_version").isNotNull())
    known, number = _numbered(rows)
    rows = rows.withColumn("group", number)
    host = rows.groupBy("group", "asset_id").agg(
        F.min("due_date").alias("due_date"), F.max("risk_score").alias("score"), F.max("epss_score").alias("epss"), F.first(F.col("environment") == "prod").alias("prod"), F.max("internet_facing").alias("inet"), F.count("*").alias("n"),
    )
    hosts = host.groupBy("group").agg(
        F.min("due_date").alias("due_date"), F.max("score").alias("score"), F.max("epss").alias("epss"), F.count("*").alias("hosts"), F.count_if("inet").alias("inet"), F.count_if("prod").alias("prod"), F.sum("n").alias("n"),
    )
    seen = rows.select("group", "environment", F.col("installed_version").alias("installed")).distinct()
    names = rows.select("group", "hostname").distinct()
    met = hosts
    for more in (seen, names, _asked(rows, ["group"])):
        met = met.unionByName(more, allowMissingColumns=True)
    found = met.groupBy("group").agg(
        F.min("due_date").alias("due_date"), F.max("score").alias("max_risk_score"), F.sum("hosts").alias("asset_count"), F.sum("inet").alias("internet_facing_count"), F.sum("prod").alias("prod_count"),
        F.sort_array(F.collect_list("cve_id")).alias("cve_ids"), F.sort_array(F.collect_list(F.when(F.col("kev_listed"), F.col("cve_id")))).alias("kev_cve_ids"), F.sum("n").alias("finding_count"),
        F.sort_array(F.collect_list("hostname")).alias("hostnames"), F.sort_array(F.collect_set("environment")).alias("environments"), F.max("epss").alias("max_epss"), F.min("installed").alias("installed_version"),
        F.sort_array(F.collect_list(F.when(F.col("required_version").isNotNull(), F.struct("cve_id", "required_version")))).alias("asked"),
    )
    return known.join(found, "group").drop("group")


def _numbered(rows: DataFrame, bits: int = 64) -> tuple[DataFrame, Column]:
    """(GROUP, group) of the groups that rows have, and their number as a column: a hash that tells all of them apart.

    Rows go by it and don't carry the group's texts. Hashes are tried until no two groups have the same (`bits` of it).
    """
    known, seed = written(rows.select(*GROUP).distinct(), "groups"), 0
    while True:
        hashed = F.xxhash64(F.lit(seed), *(F.col(c).isNull() for c in GROUP), *GROUP)
        number = hashed if bits == 64 else F.shiftrightunsigned(hashed, 64 - bits)
        numbered = known.withColumn("group", number)
        if numbered.groupBy("group").count().where("count > 1").isEmpty():
            return broadcast_if_small(numbered), number
        seed += 1


def _number(*columns: str) -> Column:
    """A number in front of a key of several texts, so that sorting by the key compares numbers."""
    return F.xxhash64(*columns).alias("_number")


def action_groups(view: DataFrame) -> DataFrame:
    """The groups alone, a row for each action: to count them, nothing else need be built."""
    return view.withColumn("has_fix", F.col("fixed_version").isNotNull()).select(*GROUP).distinct()


def package_targets(view: DataFrame) -> DataFrame:
    """The highest fix of each team, package and system, whatever the band."""
    fixes = view.where(F.col("fixed_version").isNotNull()).select("owner_team", "package_name", "os_family", "fixed_version").distinct()
    return fixes.groupBy("owner_team", "package_name", "os_family").agg(F.max_by("fixed_version", F.struct(version_key(F.col("fixed_version")), "fixed_version")).alias("target_version"))


def requirements(view: DataFrame) -> DataFrame:
    """Each id of a group, whether it is listed, and the version that it asks for there: of several, the last as text."""
    return _asked(view.withColumn("has_fix", F.col("fixed_version").isNotNull()), GROUP)


def _asked(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(_number(*keys, "cve_id"), *keys, "cve_id").agg(F.max("fixed_version").alias("required_version"), F.max("kev_listed").alias("kev_listed")).drop("_number")


def fix_actions(view: DataFrame, bands: list[str] | None = None, teams: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """groups() with target, requirements, key and title; targets come from all bands, filters apply after.

    With a limit the most urgent ones: by band, due date, score and key. The view is read several times: a written one is best.
    """
    shown = view
    if bands:
        shown = shown.where(F.col("risk_band").isin(bands))
    if teams:
        shown = shown.where(F.col("owner_team").isin(teams))
    found = groups(shown).join(package_targets(view), ["owner_team", "package_name", "os_family"], "left")
    fixed = F.when(F.col("has_fix"), F.col("target_version"))
    asked = F.when(F.col("has_fix"), F.map_from_entries("asked"))
    out = found.withColumns({"fixed_version": fixed, "version_requirements": asked, "idempotency_key": action_key(F.col("has_fix")), "title": title(fixed)}).drop("target_version", "asked")
    return out.orderBy(F.expr(URGENCY), "due_date", F.desc("max_risk_score"), "idempotency_key").limit(limit) if limit is not None else out


def action_summary(actions: DataFrame) -> DataFrame:
    """One row: actions, findings covered, reduction, actions of each band, without a fix and with internet-facing hosts."""
    band = lambda b: F.count_if(F.col("risk_band") == b).alias(b)
    return actions.agg(F.count("*").alias("actions"), F.sum("finding_count").alias("findings"), F.round(F.sum("finding_count") / F.count("*"), 1).alias("reduction"), *map(band, ("critical", "high", "medium", "low")), F.count_if(~F.col("has_fix")).alias("without_fix"), F.count_if(F.col("internet_facing_count") > 0).alias("touching_internet"))


def reduction_ladder(view: DataFrame) -> DataFrame:
    """How many tickets each candidate key would make."""
    rows = view.withColumn("fix", F.coalesce("fixed_version", F.lit(""))).withColumn("has_fix", F.col("fixed_version").isNotNull())
    keys = {"finding": ["finding_id"], "host_package_fix": ["hostname", "package_name", "fix"], "team_package_fix_band": ["owner_team", "package_name", "fix", "risk_band"], "team_package_band_hasfix": ["owner_team", "package_name", "risk_band", "has_fix"], "with_os": ["owner_team", "package_name", "os_family", "risk_band", "has_fix"]}
    counts = rows.agg(*(F.count_distinct(F.struct(*cols)).alias(name) for name, cols in keys.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("key"), F.col(n).alias("tickets")) for n in keys))).alias("x")).select("x.*")


def mixed_bands(view: DataFrame) -> DataFrame:
    """Groups of one team, package and fix, whether they span bands, and how far apart their dates lie."""
    per = view.groupBy("owner_team", "package_name", "fixed_version").agg(F.count_distinct("risk_band").alias("bands"), F.datediff(F.max("due_date"), F.min("due_date")).alias("spread"))
    return per.agg(F.count("*").alias("groups"), F.count_if(F.col("bands") > 1).alias("mixed"), F.max("spread").alias("max_spread_days"))


def target_violations(actions: DataFrame) -> DataFrame:
    """Actions (fix_actions()' columns) whose target is below a requirement, is of another system's packaging, or whose key isn't their own."""
    marks = {"debian": r"\+deb", "rhel": r"\.el[0-9]", "alpine": r"-r[0-9]+$"}
    foreign = F.lit(False)
    for own in marks:
        for other, mark in marks.items():
            if other != own:
                foreign = foreign | ((F.col("os_family") == own) & F.col("fixed_version").rlike(mark))
    low = F.exists(F.map_values("version_requirements"), lambda v: version_key(v) > version_key(F.col("fixed_version")))
    per_key = actions.groupBy("idempotency_key").agg(F.count("*").alias("_same"))
    found = actions.join(per_key, "idempotency_key").select("idempotency_key", *GROUP, F.when(F.coalesce(low, F.lit(False)), "below_requirement").when(F.coalesce(foreign, F.lit(False)), "foreign_system").when(F.col("_same") > 1, "shared_key").alias("violation"))
    return found.where("violation IS NOT NULL")
