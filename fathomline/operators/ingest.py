"""Scanner reports to findings, and feeds to ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .merge import first_per_key, merge

VALID_ID = r"^CVE-[0-9]{4}-[0-9]{4,}$"
SEVERITY_RANK = "CASE upper(severity) WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
IDENTITY = ["asset_id", "cve_id", "package_name", "installed_version"]


def valid_ids(rows: DataFrame, column: str = "cve_id") -> DataFrame:
    return rows.where(F.col(column).rlike(VALID_ID))


def skipped(rows: DataFrame, column: str = "cve_id") -> DataFrame:
    """One row: ids kept and skipped."""
    good = F.coalesce(F.col(column).rlike(VALID_ID), F.lit(False))
    return rows.agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("skipped"))


def merge_assets(assets: DataFrame, seen: DataFrame) -> DataFrame:
    """Upsert by host name in lower case; a known asset's system stays as it is."""
    rules = {c: "replace" for c in assets.columns if c not in ("asset_id", "hostname", "os_family", "_key")}
    keyed = lambda d: d.withColumn("_key", F.lower("hostname"))
    return merge(keyed(assets), keyed(seen), ["_key"], rules).drop("_key")


def seed_cves(rows: DataFrame) -> DataFrame:
    """One row per id of (cve_id, severity, title, hostname, position): the first of the highest severity."""
    return first_per_key(rows, ["cve_id"], [F.expr(SEVERITY_RANK).desc(), F.col("hostname"), F.col("position")])


def merge_seeds(cves: DataFrame, seeds: DataFrame) -> DataFrame:
    """Insert new ids; of known ones only what is null is filled."""
    return merge(cves, seeds, ["cve_id"], {c: "fill" for c in cves.columns if c != "cve_id"})


def resolve_assets(rows: DataFrame, assets: DataFrame) -> DataFrame:
    """Rows of known hosts, with asset_id; others are dropped."""
    known = assets.select(F.col("asset_id"), F.lower("hostname").alias("_host"))
    return rows.join(known, F.lower("hostname") == F.col("_host")).drop("_host", "hostname")


def dedup_staged(rows: DataFrame) -> DataFrame:
    """One row for each identity: of several the highest scan's, then the one with the lowest fix text."""
    return first_per_key(rows, IDENTITY, [F.desc("scan_id"), F.asc_nulls_last("fixed_version"), F.col("finding_id")])


def merge_findings(findings: DataFrame, found: DataFrame, close_missing: bool = False) -> DataFrame:
    """Insert new findings; known ones get the scan, its date and fix, and reopen only if they were fixed.

    close_missing sets open findings fixed that the scan doesn't have any more (off, as a scan may be partial).
    """
    reopen = lambda old, new: F.when(old == "fixed", F.lit("open")).otherwise(old)
    out = merge(findings, found, IDENTITY, {"last_seen": "replace", "last_scan_id": "replace", "fixed_version": "replace", "status": reopen})
    if close_missing:
        now = found.select(*IDENTITY, F.lit(True).alias("_found"))
        out = out.join(now, IDENTITY, "left").withColumn("status", F.when((F.col("status") == "open") & F.col("_found").isNull(), "fixed").otherwise(F.col("status"))).drop("_found")
    return out


def load_summary(rows: DataFrame, known: DataFrame) -> DataFrame:
    """One row: distinct ids, findings of known hosts, and rows skipped for ids or hosts."""
    hosts = known.select(F.lower("hostname").alias("_h"), F.lit(True).alias("_known"))
    all_ = rows.join(hosts, F.lower("hostname") == F.col("_h"), "left").withColumn("good", F.coalesce(F.col("cve_id").rlike(VALID_ID), F.lit(False)) & F.col("_known").isNotNull())
    return all_.agg(F.count_distinct(F.when(F.col("good"), F.col("cve_id"))).alias("cves"), F.count_if("good").alias("findings"), F.count_if(~F.col("good")).alias("skipped"))


def scan_ledger(rows: DataFrame) -> DataFrame:
    """A row for each scan: when it began and ended, and what it saw."""
    return rows.groupBy("scan_id").agg(F.min("seen_at").alias("started_at"), F.max("seen_at").alias("finished_at"), F.count("*").alias("findings"), F.count_distinct("asset_id").alias("assets"))


def enrich_exploited(cves: DataFrame, catalogue: DataFrame, clear_missing: bool = False) -> DataFrame:
    """Catalogue columns on the ids it lists; what isn't listed stays (or is cleared)."""
    c = catalogue.select(F.col("cve_id").alias("_c"), F.col("due_date").alias("_due"), F.col("ransomware").alias("_ransomware"))
    hit = F.col("_c").isNotNull()
    rest = F.lit(False) if clear_missing else F.col("kev_listed")
    return cves.join(c, F.col("cve_id") == F.col("_c"), "left").withColumns({
        "kev_due_date": F.when(hit, F.col("_due")).otherwise(F.col("kev_due_date")), "kev_ransomware": F.when(hit, F.col("_ransomware")).otherwise(F.col("kev_ransomware") if not clear_missing else F.lit(False)), "kev_listed": F.when(hit, F.lit(True)).otherwise(rest),
    }).drop("_c", "_due", "_ransomware")


def enrich_scores(cves: DataFrame, scores: DataFrame) -> DataFrame:
    """Exploit probability and percentile on the ids that the feed scores."""
    s = scores.select(F.col("cve_id").alias("_c"), F.col("epss").alias("_e"), F.col("percentile").alias("_p"))
    return cves.join(s, F.col("cve_id") == F.col("_c"), "left").withColumns({"epss_score": F.coalesce("_e", "epss_score"), "epss_percentile": F.col("_p")}).drop("_c", "_e", "_p")


def merge_records(cves: DataFrame, records: DataFrame, stamp: str) -> DataFrame:
    """Normalised records over cves: new values win unless null, arrays always; known ids are stamped."""
    rules = {c: ("replace" if isinstance_array(cves, c) else "refresh") for c in cves.columns if c not in ("cve_id", "enriched_at")}
    stamped = records.withColumn("enriched_at", F.lit(stamp).cast("date"))
    return merge(cves, stamped, ["cve_id"], rules | {"enriched_at": "replace"}, insert=False)


def isinstance_array(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() == "array"


def pending(cves: DataFrame, limit: int | None = None, refresh: bool = False) -> DataFrame:
    """Ids still to enrich, in order; all of them when refreshing."""
    rows = (cves if refresh else cves.where("enriched_at IS NULL")).select("cve_id").orderBy("cve_id")
    return rows.limit(limit) if limit else rows
