"""Readers of reports and feeds; schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

REPORT = """Results array<struct<Type: string, Vulnerabilities: array<struct<VulnerabilityID: string, PkgName: string, InstalledVersion: string,
    FixedVersion: string, Severity: string, Title: string, Description: string, CVSS: map<string, struct<V3Score: double, V3Vector: string>>,
    References: array<string>, PublishedDate: string, LastModifiedDate: string>>>>"""
CATALOGUE = "vulnerabilities array<struct<cveID: string, dateAdded: string, dueDate: string, knownRansomwareCampaignUse: string, requiredAction: string, shortDescription: string, vulnerabilityName: string>>"
_METRIC = "array<struct<type: string, cvssData: struct<baseScore: double, vectorString: string, baseSeverity: string>>>"
RECORD = f"""id string, published string, lastModified string, metrics struct<cvssMetricV40: {_METRIC}, cvssMetricV31: {_METRIC}, cvssMetricV30: {_METRIC}>,
    descriptions array<struct<lang: string, value: string>>, weaknesses array<struct<description: array<struct<value: string>>>>, references array<struct<url: string>>"""


def scan_reports(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A row for each vulnerability of each report, in report order.

    Blank severities are UNKNOWN, missing links an empty array; dates are timestamps in UTC, null where they don't parse. A
    report is a file, named by its host; with `lines` a line of the files below host=NAME, so that many fit a file.
    """
    files = spark.read.schema(REPORT).option("multiLine", not lines).json(path)
    host = F.regexp_extract(F.col("_metadata.file_path"), r"/host=([^/]+)/", 1) if lines else F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    results = files.select(host.alias("hostname"), F.posexplode("Results").alias("r", "result"))
    rows = results.select("hostname", "r", F.col("result.Type").alias("package_type"), F.posexplode("result.Vulnerabilities").alias("v", "x"))
    return rows.select(
        "hostname", (F.col("r") * 1_000_000 + F.col("v")).alias("position"), "package_type", F.col("x.VulnerabilityID").alias("cve_id"), F.col("x.PkgName").alias("package_name"), F.col("x.InstalledVersion").alias("installed_version"),
        F.col("x.FixedVersion").alias("fixed_raw"), F.coalesce("x.Severity", F.lit("UNKNOWN")).alias("severity"), F.col("x.Title").alias("title"), best_cvss(F.col("x.CVSS")).alias("cvss"),
        F.col("x.Description").alias("description"), F.coalesce("x.References", F.array().cast("array<string>")).alias("links"), F.expr("try_cast(x.PublishedDate AS timestamp)").alias("published"), F.expr("try_cast(x.LastModifiedDate AS timestamp)").alias("last_modified"),
    )


def best_cvss(scores: Column) -> Column:
    """The version 3 score (with its vector) by source: nvd, ghsa, redhat, then any other, by name."""
    scored = F.map_filter(scores, lambda _, v: v["V3Score"].isNotNull())
    named = [F.try_element_at(scored, F.lit(k)) for k in ("nvd", "ghsa", "redhat")]
    rest = F.array_min(F.map_entries(scored))
    return F.coalesce(*named, rest["value"])


def exploited_catalogue(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per listed id of catalogue files (with `lines`, a catalogue is a line); blank values are null, rows without an id are left out."""
    x = spark.read.schema(CATALOGUE).option("multiLine", not lines).json(path).select(F.explode("vulnerabilities").alias("x"))
    text = lambda f: F.nullif(F.trim(f"x.{f}"), F.lit(""))
    rows = x.select(
        text("cveID").alias("cve_id"), F.try_to_date(text("dateAdded"), "yyyy-MM-dd").alias("date_added"), F.try_to_date(text("dueDate"), "yyyy-MM-dd").alias("due_date"),
        F.coalesce(F.lower(text("knownRansomwareCampaignUse")) == "known", F.lit(False)).alias("ransomware"), text("requiredAction").alias("required_action"), text("vulnerabilityName").alias("name"),
    )
    return rows.where(F.col("cve_id").isNotNull())


def exploit_scores(spark: SparkSession, path: str) -> DataFrame:
    """cve_id, epss, percentile of a CSV (also gzipped) with `#` lines and a header; rows that don't parse are left out."""
    rows = spark.read.option("comment", "#").option("header", True).schema("cve string, epss string, percentile string").csv(path)
    number = lambda c: F.expr(f"try_cast({c} AS decimal(6,5))")
    return rows.select(F.col("cve").alias("cve_id"), number("epss").alias("epss"), number("percentile").alias("percentile")).where("cve_id IS NOT NULL AND epss IS NOT NULL AND percentile IS NOT NULL")


def score_model(spark: SparkSession, path: str) -> DataFrame:
    """The comment lines of a score file, which name its model."""
    return spark.read.text(path).where(F.col("value").startswith("#"))


def cve_records(spark: SparkSession, path: str) -> DataFrame:
    return normalise_records(spark.read.schema(RECORD).json(path))


def normalise_records(rows: DataFrame) -> DataFrame:
    """The primary, else first, metric of each version; severity by version 4.0, 3.1, 3.0; the first English description to 8,000 characters; sorted distinct weakness ids; the first 40 links; both dates (null where they don't parse) and the vectors of the scores."""
    m = lambda v: F.col(f"metrics.cvssMetricV{v}")
    pick = lambda v: F.coalesce(F.get(F.filter(m(v), lambda e: e["type"] == "Primary"), 0), F.get(m(v), 0))["cvssData"]
    named = lambda v: F.get(F.filter(F.transform(m(v), lambda e: e["cvssData"]["baseSeverity"]), lambda s: s.isNotNull() & (s != "")), 0)
    english = F.get(F.filter("descriptions", lambda d: d["lang"] == "en"), 0)["value"]
    cwes = F.filter(F.transform(F.flatten(F.transform("weaknesses", lambda w: w["description"])), lambda d: d["value"]), lambda v: F.startswith(v, F.lit("CWE-")))
    links = F.filter(F.transform("references", lambda r: r["url"]), lambda u: u.isNotNull() & (u != ""))
    return rows.select(
        F.col("id").alias("cve_id"), F.nullif(F.substring(english, 1, 8000), F.lit("")).alias("description"), pick("31")["baseScore"].cast("decimal(3,1)").alias("cvss_v31_score"), pick("40")["baseScore"].cast("decimal(3,1)").alias("cvss_v40_score"),
        F.coalesce(named("40"), named("31"), named("30")).alias("cvss_severity"), F.coalesce(F.array_sort(F.array_distinct(cwes)), F.array().cast("array<string>")).alias("cwe_ids"), F.coalesce(F.slice(links, 1, 40), F.array().cast("array<string>")).alias("links"),
        F.expr("try_cast(published AS timestamp)").alias("published"), F.expr("try_cast(lastModified AS timestamp)").alias("last_modified"), pick("31")["vectorString"].alias("cvss_v31_vector"), pick("40")["vectorString"].alias("cvss_v40_vector"),
    )
