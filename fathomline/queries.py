"""The registry of queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import fixtures as fx
from .functions import stems, text
from .functions.versions import choose_fix, compare, version_key
from .operators import changes, correlate, grounding as grounding_ops, index as posting_index, ingest, merge, reports, retrieval, risk, risk_table, tickets, vectors, worklist as worklist_ops
from .session import TIDY, broadcast_if_small, delete, scratch, settings, written
from .sources import feeds
from .streaming import findings as stream

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


class Tables:
    """The domain tables of one folder; nothing is read before it is used.

    What several parts of a query build on (the findings' view, actions, plans) is written once and read again.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._once: dict[str, DataFrame] = {}

    def once(self, name: str, make) -> DataFrame:
        if name not in self._once:
            self._once[name] = written(make(), name)
        return self._once[name]

    def table(self, name: str) -> DataFrame:
        return fx.table(self.spark, self.sf_dir, name)

    @property
    def assets(self) -> DataFrame:
        return fx.assets(self.spark, self.sf_dir)

    @property
    def cves(self) -> DataFrame:
        return fx.cves(self.spark, self.sf_dir)

    @property
    def staged(self) -> DataFrame:
        return fx.staged(self.spark, self.sf_dir)

    @property
    def findings(self) -> DataFrame:
        return self._once.get("findings") or fx.findings(self.spark, self.sf_dir)

    @property
    def kept_findings(self) -> DataFrame:
        """The findings, written: what is asked for after that builds on them, and the scanned rows are read once."""
        return self.once("findings", lambda: fx.findings(self.spark, self.sf_dir))

    @property
    def view(self) -> DataFrame:
        return self._once.get("view") or risk.current_risk(risk.assess(self.findings, self.cves, self.assets), fx.AS_OF)

    @property
    def kept_view(self) -> DataFrame:
        return self.once("view", lambda: self.view.select(*correlate.USED, "finding_id", "overdue"))

    @property
    def actions(self) -> DataFrame:
        """From the written view, if there is one, else from what they need of it."""
        return self.once("actions", lambda: correlate.fix_actions(self._once.get("view") or self.once("used", lambda: self.view.select(*correlate.USED))))

    @property
    def chunks(self) -> DataFrame:
        return self.once("chunks", lambda: retrieval.fact_chunks(retrieval.corpus_facts(self.cves, self.findings)))

    def chunks_of(self, ids: DataFrame) -> DataFrame:
        """All chunks of these ids (cve_id): those of others aren't made, nor are findings put together for them."""
        ids = broadcast_if_small(written(ids.where("cve_id IS NOT NULL").select("cve_id").distinct(), "ids"))
        facts = retrieval.corpus_facts(self.cves.join(ids, "cve_id", "left_semi"), fx.findings(self.spark, self.sf_dir, ids))
        return written(retrieval.fact_chunks(facts), "chunks")

    @property
    def drafted(self) -> DataFrame:
        """A plan for each action; some name a version or an id that nothing supports, forbidden commands, or a placeholder."""
        a = worklist_ops.representative(self.actions)
        a = a.withColumn("n", F.conv(F.substring("idempotency_key", 1, 6), 16, 10).cast("long"))
        version = F.expr("CASE WHEN n % 7 = 0 THEN concat(fixed_version, '9') ELSE fixed_version END")
        named = F.expr("CASE WHEN n % 11 = 0 THEN 'CVE-1999-0001' ELSE cve_id END")
        command = F.expr("CASE os_family WHEN 'debian' THEN concat('apt-get install ', package_name, '=') WHEN 'rhel' THEN concat('dnf install ', package_name, '-') ELSE concat('apk add ', package_name, '=') END")
        place = F.expr("CASE WHEN n % 13 = 0 THEN ' Restart /path/to/app.' ELSE '' END || CASE WHEN n % 17 = 0 THEN ' Then rm -rf / tmp.' ELSE '' END")
        fix = F.concat(F.lit("Upgrade `"), "package_name", F.lit("` to "), version, F.lit(" for "), named, F.lit(".\n\n```bash\n"), command, version, F.lit("\n```\n\nRollback to "), "installed_version", F.lit("."), place)
        none = F.concat(F.lit("No fix is out for "), named, F.lit("; isolate the service."), place)
        context = F.array_compact(F.array(F.concat(F.lit("Target "), "fixed_version", F.lit(" .")), F.concat(F.lit("Installed "), "installed_version", F.lit(" .")), F.array_join("cve_ids", " ")))
        return a.select(
            F.col("idempotency_key").alias("plan_id"), "n", "cve_id", "package_name", "os_family", "fixed_version", F.col("fixed_version").alias("target_version"), "risk_band", "max_risk_score", "due_date",
            F.coalesce(fix, none).alias("markdown"), context.alias("context"), F.array_compact(F.array("fixed_version")).alias("required"), F.expr("date_add(date '1999-01-01', cast(n % 300 AS int))").alias("created_at"),
        )

    @property
    def checked(self) -> DataFrame:
        return self.once("checked", lambda: grounding_ops.check_grounding(self.drafted))

    @property
    def plans(self) -> DataFrame:
        """The drafted plans, with what the gate says of them."""
        return self.checked.withColumn("grounded", F.col("passed"))

    @property
    def tickets(self) -> DataFrame:
        return tickets.ticket_rows(self.actions, self.plans)

    def counted(self) -> dict[str, DataFrame]:
        """What the statistics count; the view is written once for all that build on it."""
        found, open_, plans = self.kept_findings, self.kept_view, self.plans
        return {
            "assets": self.assets, "cves": self.cves, "findings": found, "findings_open": open_, "kev_cves": self.cves.where("kev_listed"), "chunks": self.chunks,
            "plans": plans, "plans_grounded": plans.where("grounded"), "tickets": self.tickets, "fix_actions": self.actions,
        }


_kept: dict[tuple, str] = {}


def _stamp(spark: SparkSession, sf_dir: str, *names: str) -> tuple:
    """What a kept table is kept for: the session, the folder, and when the tables that it comes from were changed."""
    stamps = []
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        stamps.append(path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime())
    return spark.sparkContext.applicationId, sf_dir, *names, *stamps


def _risk_table(spark: SparkSession, sf_dir: str) -> str:
    """The triage table of a folder, kept for the session; written anew where one of the tables that it comes from has changed."""
    key = _stamp(spark, sf_dir, "customer", "nation", "region", "part", "orders", "lineitem")
    if key not in _kept:
        path = scratch(spark, "risk")
        view = Tables(spark, sf_dir).view
        risk_table.write(view.select("asset_id", *reports.SHOWN), path)
        _kept[key] = path
    return _kept[key]


# Sources and merges


@query
def assets(spark, sf_dir):
    return Tables(spark, sf_dir).assets


@query
def cves(spark, sf_dir):
    return Tables(spark, sf_dir).cves


@query
def findings(spark, sf_dir):
    return Tables(spark, sf_dir).findings


@query
def asset_merge(spark, sf_dir):
    """Half the fleet is known under another system, which a new scan doesn't change."""
    fleet = Tables(spark, sf_dir).assets
    known = fleet.where("asset_id % 2 = 1").withColumns({"os_family": F.lit("unknown"), "environment": F.lit("dev"), "hostname": F.col("hostname")})
    return ingest.merge_assets(known, fleet)


@query
def cve_seeds(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.staged.join(t.assets.select("asset_id", "hostname"), "asset_id").select("cve_id", F.expr("CASE row_id % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' END").alias("severity"), "hostname", F.col("row_id").alias("position"))
    return ingest.seed_cves(rows)


@query
def seed_merge(spark, sf_dir):
    """Seeds of all ids into a table that knows two thirds of them, some without severity or title."""
    c = Tables(spark, sf_dir).cves
    known = c.where("cve_key % 3 <> 0").select("cve_id", F.expr("CASE WHEN cve_key % 4 <> 0 THEN cvss_severity END").alias("severity"), F.expr("CASE WHEN cve_key % 5 <> 0 THEN description END").alias("title"))
    seeds = ingest.seed_cves(c.select("cve_id", F.lit("HIGH").alias("severity"), F.lit("seen").alias("title"), F.lit("h").alias("hostname"), F.col("cve_key").alias("position")))
    return ingest.merge_seeds(known, seeds.select("cve_id", "severity", "title"))


@query
def host_resolution(spark, sf_dir):
    """Scanned rows by host name, in any case; a tenth of the hosts is unknown. Ids that aren't any are left out first."""
    t = Tables(spark, sf_dir)
    rows = t.staged.join(t.assets.select("asset_id", F.upper("hostname").alias("hostname")), "asset_id").select("row_id", "hostname", F.expr("CASE WHEN row_id % 7 = 0 THEN 'GHSA-xx' ELSE cve_id END").alias("cve_id"))
    return ingest.resolve_assets(ingest.valid_ids(rows), t.assets.where("asset_id % 10 > 0"))


@query
def findings_closed(spark, sf_dir):
    """Scans 5 to 7 merged into what scans 1 to 4 left; what they don't have any more is fixed."""
    t = Tables(spark, sf_dir)
    old, new = (fx.findings_of(t.staged.where(c)) for c in ("scan_id <= 4", "scan_id > 4"))
    return ingest.merge_findings(old, new, close_missing=True).select(*ingest.IDENTITY, "last_scan_id", "status")


@query
def findings_sink(spark, sf_dir):
    """The findings as a partitioned table, some of whose partitions a second write replaces."""
    f = Tables(spark, sf_dir).findings.select("finding_id", "asset_id", "status").withColumn("shard", F.expr("cast(asset_id % 16 AS int)"))
    path = scratch(spark, "sink")
    merge.write_partitions(f, path, ["shard"])
    merge.write_partitions(f.where("shard < 4").withColumn("status", F.lit("replaced")), path, ["shard"])
    return spark.read.schema(f.schema).parquet(path).groupBy("shard", "status").agg(F.count("*").alias("rows"), F.sum(F.col("finding_id") % 1_000_003).alias("ids"))


@query
def staged_dedup(spark, sf_dir):
    rows = Tables(spark, sf_dir).staged.drop("finding_id").select(F.col("row_id").alias("finding_id"), *ingest.IDENTITY, "scan_id", F.col("fixed_raw").alias("fixed_version"))
    return ingest.dedup_staged(rows).drop("fixed_version")


@query
def findings_merged(spark, sf_dir):
    """Scans 3 to 7 merged into what scans 1 to 4 left."""
    t = Tables(spark, sf_dir)
    old, new = (fx.findings_of(t.staged.where(c)) for c in ("scan_id <= 4", "scan_id > 2"))
    return ingest.merge_findings(old, new).drop("fixed_version")


@query
def load_summary(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.staged.join(t.assets.select("asset_id", "hostname"), "asset_id")
    return ingest.load_summary(rows, t.assets.where("asset_id % 10 > 0"))


@query
def skipped_ids(spark, sf_dir):
    rows = Tables(spark, sf_dir).staged.select(F.expr("CASE row_id % 5 WHEN 0 THEN 'GHSA-xx' WHEN 1 THEN NULL ELSE cve_id END").alias("cve_id"))
    return ingest.skipped(rows)


@query
def scan_ledger(spark, sf_dir):
    return ingest.scan_ledger(Tables(spark, sf_dir).staged)


#: Entries of a line of the files that feeds are written to.
ENTRIES = 1000


def _catalogue(t: Tables) -> DataFrame:
    """The catalogue of exploited ids, written as files and read as the feed; it has an entry without an id, too."""
    rows = t.cves.where("kev_listed").select(
        "cve_key", F.struct(F.when(F.col("cve_key") % 40 == 3, F.concat(F.lit(" "), "cve_id", F.lit(" "))).otherwise(F.col("cve_id")).alias("cveID"), F.col("kev_due_date").cast("string").alias("dueDate"), F.when(F.col("kev_ransomware"), " KNOWN").otherwise("Unknown").alias("knownRansomwareCampaignUse")).alias("x"),
    )
    none = F.struct(F.lit(" ").alias("cveID"), F.lit("").alias("dueDate"), F.lit("Known").alias("knownRansomwareCampaignUse"))
    path = scratch(t.spark, "catalogue")
    rows.groupBy(F.floor(F.col("cve_key") / ENTRIES)).agg(F.concat(F.collect_list("x"), F.array(none)).alias("vulnerabilities")).select("vulnerabilities").write.json(path)
    return feeds.exploited_catalogue(t.spark, path, lines=True)


def _bare(cves: DataFrame) -> DataFrame:
    return cves.withColumns({"kev_listed": F.lit(False), "kev_ransomware": F.lit(False), "kev_due_date": F.lit(None).cast("date")})


@query
def kev_enrich(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ingest.enrich_exploited(_bare(t.cves), _catalogue(t)).select("cve_id", "kev_listed", "kev_ransomware", "kev_due_date")


@query
def kev_summary(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ingest.enrich_exploited(_bare(t.cves), _catalogue(t)).agg(F.count_if("kev_listed").alias("matched"), F.count_if(F.col("kev_listed") & F.col("kev_ransomware")).alias("ransomware"))


def _scores(t: Tables) -> DataFrame:
    """Exploit scores, written as compressed CSV files with a comment line and rows that don't parse, and read as the feed."""
    text = lambda c: F.col(c).cast("string").alias(c)
    rows = t.cves.where("epss_score IS NOT NULL").select(F.col("cve_id").alias("cve"), F.col("epss_score").alias("epss"), F.expr("cast((cve_key % 100) / 100 AS decimal(6,5))").alias("percentile")).select("cve", text("epss"), text("percentile"))
    bad = t.cves.where("epss_score IS NULL").select(F.col("cve_id").alias("cve"), F.lit("n/a").alias("epss"), F.lit("0.5").alias("percentile"))
    comment = t.spark.range(1).select(F.lit("#model_version:v1").alias("cve"), F.lit("score_date").alias("epss"), F.lit("x").alias("percentile"))
    path = scratch(t.spark, "scores")
    rows.unionByName(bad).unionByName(comment).write.option("header", True).option("compression", "gzip").csv(path)
    return feeds.exploit_scores(t.spark, path)


@query
def epss_enrich(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ingest.enrich_scores(t.cves.withColumn("epss_score", F.lit(None).cast("decimal(6,5)")), _scores(t)).select("cve_id", "epss_score", "epss_percentile")


@query
def epss_summary(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = ingest.enrich_scores(t.cves.withColumn("epss_score", F.lit(None).cast("decimal(6,5)")), _scores(t))
    return rows.agg(F.count("epss_score").alias("scored"), F.count_if(F.col("epss_score") >= 0.1).alias("at_least_10pct"))


@query
def cve_record_normalise(spark, sf_dir):
    """Records written as JSON files, read and normalised."""
    metric = lambda c: f"CASE WHEN {c} IS NOT NULL THEN array(named_struct('type', 'Secondary', 'cvssData', named_struct('baseScore', 1D, 'vectorString', 'x', 'baseSeverity', cast(NULL AS string))), named_struct('type', 'Primary', 'cvssData', named_struct('baseScore', cast({c} AS double), 'vectorString', 'v', 'baseSeverity', cvss_severity))) END"
    made = Tables(spark, sf_dir).cves.select(F.expr(f"""to_json(named_struct('id', cve_id, 'published', concat('2001-02-', lpad(cast(1 + cve_key % 28 AS string), 2, '0'), 'T03:04:05.000'), 'lastModified', CASE WHEN cve_key % 2 = 0 THEN '2002-03-04T05:06:07' ELSE 'soon' END, 'metrics', named_struct('cvssMetricV40', {metric("cvss_v40_score")}, 'cvssMetricV31', {metric("cvss_v31_score")}),
        'descriptions', array(named_struct('lang', 'es', 'value', 'otra'), named_struct('lang', 'en', 'value', description)),
        'weaknesses', array(named_struct('description', array(named_struct('value', concat('CWE-', cast(cve_key % 9 AS string))), named_struct('value', 'NVD-other'))), named_struct('description', array(named_struct('value', concat('CWE-', cast(cve_key % 4 AS string)))))),
        'references', array(named_struct('url', concat('https://example.com/', cve_id)))))""").alias("json"))  # fmt: skip
    path = scratch(spark, "records")
    made.write.text(path)
    found = feeds.cve_records(spark, path)
    told = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return found.select(*[c for c in found.columns if c not in ("published", "last_modified")], told("published"), told("last_modified"))


@query
def record_merge(spark, sf_dir):
    c = Tables(spark, sf_dir).cves
    known = c.select("cve_id", "description", "cvss_v31_score", F.array(F.lit("CWE-1")).alias("cwe_ids"), F.lit(None).cast("date").alias("enriched_at"))
    new = c.where("cve_key % 3 = 0").select("cve_id", F.concat("description", F.lit(" (revised)")).alias("description"), F.lit(None).cast("decimal(3,1)").alias("cvss_v31_score"), F.array(F.expr("concat('CWE-', cast(cve_key % 9 AS string))")).alias("cwe_ids"))
    return ingest.merge_records(known, new, fx.AS_OF)


@query
def pending_enrichment(spark, sf_dir):
    c = Tables(spark, sf_dir).cves
    return ingest.pending(c.withColumn("enriched_at", F.expr("CASE WHEN cve_key % 3 = 0 THEN date '2000-01-01' END")))


@query
def cvss_preference(spark, sf_dir):
    """Scores of up to four sources per id; the preferred one's."""
    c = Tables(spark, sf_dir).cves
    entry = lambda name, mod, least: f"CASE WHEN cve_key % 4 <= {least} THEN named_struct('key', '{name}', 'value', named_struct('V3Score', cast(cve_key % {mod} AS double), 'V3Vector', '{name}')) END"
    scores = F.expr(f"map_from_entries(array_compact(array({entry('amazon', 7, 3)}, {entry('redhat', 8, 2)}, {entry('ghsa', 9, 1)}, {entry('nvd', 10, 0)})))")
    best = c.select("cve_id", feeds.best_cvss(scores).alias("b"))
    return best.select("cve_id", F.col("b.V3Score").alias("score"), F.col("b.V3Vector").alias("vector"))


@query
def report_flatten(spark, sf_dir):
    """Reports of five hosts, written as JSON files and read by the report reader."""
    where = scratch(spark, "reports")
    rows = Tables(spark, sf_dir).staged.withColumn("host", F.expr("concat('host-', cast(row_id % 5 AS string))"))
    # Rows are moved narrow: what is made of other columns is made in the report.
    narrow = F.struct("cve_id", "package_name", "installed_version", "fixed_raw", "seen_at", (F.col("row_id") % 3).cast("byte").alias("third"), (F.col("row_id") % 2).cast("byte").alias("half"))
    item = lambda x: F.struct(x["cve_id"].alias("VulnerabilityID"), x["package_name"].alias("PkgName"), x["installed_version"].alias("InstalledVersion"), x["fixed_raw"].alias("FixedVersion"), F.when(x["third"] == 0, "HIGH").when(x["third"] == 1, "LOW").alias("Severity"),
        F.concat(F.lit("About "), x["cve_id"]).alias("Description"), F.when(x["half"] == 0, F.array(F.concat(F.lit("https://example.com/"), x["cve_id"]))).alias("References"), x["seen_at"].cast("string").alias("PublishedDate"), F.lit("unknown").alias("LastModifiedDate"))
    # A report holds some thousand rows of a host, so the number of reports grows with the table.
    parts = max(1, rows.count() // (5 * ENTRIES))
    report = rows.groupBy("host", F.pmod(F.xxhash64("row_id"), F.lit(parts)).alias("part")).agg(F.collect_list(narrow).alias("v")).select("host", F.array(F.struct(F.lit("os-pkgs").alias("Type"), F.transform("v", item).alias("Vulnerabilities"))).alias("Results"))
    with settings(spark, TIDY):
        report.write.partitionBy("host").option("compression", "gzip").json(where)
    return feeds.scan_reports(spark, where, lines=True).groupBy("hostname", "cve_id", "package_name", "installed_version", "fixed_raw", "severity", "description", F.get("links", 0).alias("link"), F.col("published").cast("date").alias("published"), "last_modified").agg(F.count("*").alias("n")).withColumn("last_modified", F.col("last_modified").cast("string"))


@query
def store_reconcile(spark, sf_dir):
    d = Tables(spark, sf_dir).table("documents").select("doc_id", "text", "lang")
    other = d.where("doc_id % 10 <> 2").withColumn("lang", F.expr("CASE WHEN doc_id % 10 = 3 THEN 'xx' ELSE lang END"))
    return merge.reconcile(d.where("doc_id % 10 <> 1"), other, "doc_id")


@query
def reconcile_drift(spark, sf_dir):
    """Two stores that drifted by a few rows: digests of a tree tell which leaves to compare."""
    t = Tables(spark, sf_dir)
    d = written(t.table("orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("string").alias("day")), "store")
    other = d.where("o_orderkey % 3001 <> 5").withColumn("o_custkey", F.expr("CASE WHEN o_orderkey % 3011 = 7 THEN o_custkey + 1 ELSE o_custkey END"))
    return merge.reconcile_by_tree(d, other, "o_orderkey").withColumn("compared", F.col("compared") < F.col("source_rows"))


# Versions


@query
def version_order(spark, sf_dir):
    v = Tables(spark, sf_dir).findings.where("fixed_version IS NOT NULL").select(F.col("fixed_version").alias("version")).distinct()
    return merge.ranked(v, version_key(F.col("version")), "version_rank", lambda df: written(df, "ranges")).select("version", F.col("version_rank").cast("long").alias("version_rank"))


@query
def version_compare(spark, sf_dir):
    """Each installed version against its fix."""
    f = Tables(spark, sf_dir).findings.select("installed_version", "fixed_version").distinct()
    return f.withColumn("order", compare(F.col("installed_version"), F.col("fixed_version")))


@query
def fix_selection(spark, sf_dir):
    rows = Tables(spark, sf_dir).staged.where("fixed_raw IS NOT NULL").select("fixed_raw", "installed_version").distinct()
    return rows.withColumn("fixed_version", choose_fix(F.col("fixed_raw"), F.col("installed_version")))


# Risk


@query
def risk_components(spark, sf_dir):
    return Tables(spark, sf_dir).view.select("finding_id", "cvss_base", "cvss_source", "severity_points", "exploit_points", "exploit_reason", "exposure_points", "exposure_reason", "criticality_points", "data_points", "asset_points")


@query
def risk_scored(spark, sf_dir):
    return Tables(spark, sf_dir).view.select("finding_id", "risk_score", "scored_band", "risk_band", "floor_rule")


@query
def sla(spark, sf_dir):
    return Tables(spark, sf_dir).view.select("finding_id", "sla_days", "due_date", "sla_rule", "kev_deadline_passed")


@query
def current_risk(spark, sf_dir):
    return Tables(spark, sf_dir).view.select("finding_id", "asset_id", "cve_id", "risk_score", "risk_band", "due_date", "overdue", "days_remaining")


@query
def factors(spark, sf_dir):
    return risk.explain(Tables(spark, sf_dir).view)


@query
def factors_json(spark, sf_dir):
    """What is stored of each assessment, read back from its JSON text."""
    f = risk.factors_json(Tables(spark, sf_dir).view)
    at = lambda path: F.get_json_object("factors", path)
    return f.select("finding_id", "policy_version", at("$.components.severity.points").cast("decimal(5,2)").alias("severity"), at("$.components.exploit.reason").alias("exploit"), at("$.components.exposure.environment").alias("environment"), at("$.components.asset.data_classification").alias("data"), at("$.band_floor.rule").alias("floor"), at("$.band_floor.scored_band").alias("scored_band"))


#: What factors_reshaped shows of the factors' present shape, as text.
_SHOWN = "components struct<severity: struct<points: string>, exploit: struct<max: string>>, band_floor struct<rule: string, scored_band: string>, band_floor_rule string, sla struct<rule: string, kev_deadline_passed: string, kev_due_date: string>"


@query
def factors_reshaped(spark, sf_dir):
    """Factors of an old shape rewritten to the present one."""
    v = Tables(spark, sf_dir).view
    component = lambda c, most: F.struct(F.col(c).cast("string").alias("points"), F.lit(most).alias("max"))
    sla = F.when(F.col("finding_id") % 3 > 0, F.struct(F.col("sla_rule").alias("rule"), F.col("kev_deadline_passed"), F.col("kev_due_date").cast("string").alias("kev_due_date")))
    old = F.struct(F.struct(component("severity_points", "40").alias("severity"), component("exploit_points", "30").alias("exploit")).alias("components"), F.col("floor_rule").alias("band_floor_rule"), F.col("scored_band"), sla.alias("sla"))
    made = v.select("finding_id", risk.reshape_factors(F.to_json(old)).alias("factors"))
    # Each text is parsed once, for all that is shown of it.
    shown = made.select("finding_id", F.from_json("factors", _SHOWN).alias("f"))
    return shown.select(
        "finding_id", F.col("f.components.severity.points").cast("decimal(5,2)").alias("severity"), F.col("f.components.exploit.max").alias("max"), F.col("f.band_floor.rule").alias("floor"), F.col("f.band_floor.scored_band").alias("scored_band"),
        F.col("f.band_floor_rule").alias("old_floor"), F.col("f.sla.rule").alias("sla"), F.col("f.sla.kev_deadline_passed").alias("passed"), F.col("f.sla.kev_due_date").alias("due"),
    )


def _two_runs(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A history in which every third finding scored a point more, and the new run."""
    new = t.once("view", lambda: t.view.select("finding_id", "risk_band", "due_date", "risk_score")).select("finding_id", F.lit(risk.POLICY).alias("policy_version"), "risk_band", "due_date", "risk_score")
    return new.withColumns({"risk_score": F.expr("cast(CASE WHEN finding_id % 3 = 0 THEN risk_score + 1 ELSE risk_score END AS decimal(5,2))"), "is_current": F.lit(True)}), new


@query
def score_changes(spark, sf_dir):
    history, new = _two_runs(Tables(spark, sf_dir))
    found = risk.changed(new, history.where("is_current")).select("finding_id", F.lit(1).alias("_c"))
    return new.join(found, "finding_id", "left").agg(F.count("*").alias("evaluated"), F.count("_c").alias("inserted"), F.count_if(F.col("_c").isNull()).alias("unchanged"))


@query
def history_after_run(spark, sf_dir):
    history, new = _two_runs(Tables(spark, sf_dir))
    return risk.append_history(history, risk.changed(new, history.where("is_current"))).select("finding_id", "policy_version", "risk_band", "due_date", "risk_score", "is_current")


def _raw_history(t: Tables) -> DataFrame:
    return t.staged.select("finding_id", F.col("row_id").alias("assessment_id"), F.col("scan_id").alias("computed_at"), "scan_id")


@query
def current_backfill(spark, sf_dir):
    return risk.backfill_current(_raw_history(Tables(spark, sf_dir))).where("is_current").select("finding_id", "scan_id")


@query
def latest_assessment(spark, sf_dir):
    return risk.latest(_raw_history(Tables(spark, sf_dir))).select("finding_id", "scan_id")


@query
def history_prune(spark, sf_dir):
    rows = Tables(spark, sf_dir).staged.select(F.expr("row_id % 4 = 0").alias("is_current"), F.col("seen_at").alias("computed_at"), F.lit("why").alias("explanation"))
    return risk.prune(rows, "1997-01-01").groupBy("is_current").agg(F.count("*").alias("rows"), F.count_if("pruned").alias("pruned"), F.count("explanation").alias("explained"))


# Correlation


@query
def fix_actions(spark, sf_dir):
    a = Tables(spark, sf_dir).actions
    asked = F.array_join(F.transform(F.map_entries("version_requirements"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return a.withColumn("requirements", F.coalesce(asked, F.lit(""))).drop("version_requirements")


@query
def fix_actions_filtered(spark, sf_dir):
    """The most urgent actions of two bands and a team; their targets are those of all bands."""
    a = correlate.fix_actions(Tables(spark, sf_dir).kept_view, bands=["critical", "medium"], teams=["asia"], limit=40)
    return a.select("idempotency_key", "title", "risk_band", "due_date", "fixed_version", "asset_count", "finding_count")


@query
def package_targets(spark, sf_dir):
    return correlate.package_targets(Tables(spark, sf_dir).view)


@query
def version_requirements(spark, sf_dir):
    return correlate.requirements(Tables(spark, sf_dir).view).where("has_fix").drop("kev_listed")


@query
def action_summary(spark, sf_dir):
    return correlate.action_summary(Tables(spark, sf_dir).actions)


@query
def reduction_ladder(spark, sf_dir):
    return correlate.reduction_ladder(Tables(spark, sf_dir).view)


@query
def mixed_bands(spark, sf_dir):
    return correlate.mixed_bands(Tables(spark, sf_dir).view)


@query
def target_violations(spark, sf_dir):
    """Of the actions a quarter each gets a target below all fixes, one of another system, and a key that isn't its own."""
    a = Tables(spark, sf_dir).actions.withColumn("n", F.when(F.col("has_fix"), F.conv(F.substring("idempotency_key", 1, 6), 16, 10).cast("long") % 4))
    foreign = F.expr("CASE os_family WHEN 'rhel' THEN '99.0-r1' ELSE '99.0-1.el9' END")
    return correlate.target_violations(a.withColumns({"fixed_version": F.when(F.col("n") == 0, "0.0.1").when(F.col("n") == 1, foreign).otherwise(F.col("fixed_version")), "idempotency_key": F.when(F.col("n") == 2, "one-key").otherwise(F.col("idempotency_key"))}))


# Reports


@query
def table_counts(spark, sf_dir):
    return reports.table_counts(Tables(spark, sf_dir).counted())


@query
def stats_row(spark, sf_dir):
    return reports.stats_row(Tables(spark, sf_dir).counted())


@query
def band_distribution(spark, sf_dir):
    return reports.band_distribution(Tables(spark, sf_dir).view)


@query
def due_backlog(spark, sf_dir):
    return reports.due_backlog(Tables(spark, sf_dir).view, fx.AS_OF)


@query
def asset_list(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return reports.asset_list(t.assets, t.view, limit=None)


@query
def asset_page(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return reports.asset_list(t.assets, t.view, environment="prod", internet_facing=True, offset=50)


@query
def asset_detail(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return reports.asset_list(t.assets.where("asset_id = 7"), t.view.where("asset_id = 7"))


@query
def findings_risk(spark, sf_dir):
    return risk_table.page(spark, _risk_table(spark, sf_dir))


@query
def findings_due(spark, sf_dir):
    return risk_table.page(spark, _risk_table(spark, sf_dir), "due_date", 100, 20, overdue_only=True, band="high")


@query
def findings_epss(spark, sf_dir):
    return risk_table.page(spark, _risk_table(spark, sf_dir), "epss", kev_only=True, environment="prod")


@query
def findings_filtered(spark, sf_dir):
    return risk_table.page(spark, _risk_table(spark, sf_dir), limit=None, team="asia", internet_facing=True, band="critical")


@query
def triage_queue(spark, sf_dir):
    """The first page of the kept table: one band's folder, and of its row groups those with the highest scores."""
    return risk_table.page(spark, _risk_table(spark, sf_dir), limit=20, band="critical")


@query
def cve_lookup(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return reports.cve_lookup(t.cves, t.findings, ["cve-2013-10003", "CVE-2018-10023", "cve-2011-10001"])


@query
def cve_impact(spark, sf_dir):
    """Affected assets and packages of every id with open findings."""
    f = Tables(spark, sf_dir).findings.where("status = 'open'")
    per = f.groupBy("cve_id", "asset_id").agg(F.collect_set("package_name").alias("p"))
    return per.groupBy("cve_id").agg(F.count("*").alias("affected_assets"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("p")))).alias("affected_packages"))


@query
def team_workload(spark, sf_dir):
    return reports.team_workload(Tables(spark, sf_dir).view)


@query
def overview(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return reports.overview(t.kept_view, correlate.action_groups(t.kept_view))


# Text and retrieval


@query
def id_extraction(spark, sf_dir):
    rows = Tables(spark, sf_dir).cves.select("cve_key", F.concat(F.lit("see "), F.lower("cve_id"), F.lit(", "), "cve_id", F.lit(" and CVE-1999-0001x"), F.lit(" CVE-12-3")).alias("t"))
    return rows.select("cve_key", text.cve_ids(F.col("t")).alias("ids"))


@query
def command_extraction(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.plans.select("plan_id", text.commands(F.col("markdown")).alias("commands"))


@query
def version_extraction(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = t.table("documents").select(F.col("doc_id").cast("string").alias("id"), text.versions(F.col("text")).alias("versions"))
    return found.unionByName(t.plans.select(F.col("plan_id").alias("id"), text.versions(F.col("markdown")).alias("versions")))


@query
def split_text(spark, sf_dir):
    return text.split_table(Tables(spark, sf_dir).table("documents"), "doc_id", "text")


@query
def corpus_facts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    f = retrieval.corpus_facts(t.cves, t.findings)
    told = F.transform("fixes", lambda x: F.concat_ws(" ", x["package_name"], x["installed_version"], F.coalesce(x["fixed_version"], F.lit("-"))))
    return f.select("cve_id", F.size(F.coalesce("fixes", F.array())).alias("n_fixes"), told.alias("fixes"))


@query
def fact_chunks(spark, sf_dir):
    return Tables(spark, sf_dir).chunks


@query
def documents_assembled(spark, sf_dir):
    t = Tables(spark, sf_dir)
    titles = t.cves.where("cve_key % 3 <> 0").select("cve_id", F.expr("CASE WHEN cve_key % 3 = 1 THEN upper(description) ELSE '' END").alias("title"))
    return retrieval.documents_assembled(t.chunks, titles).withColumn("text", F.md5(F.col("text").cast("binary")))


@query
def corpus_rebuild(spark, sf_dir):
    """Every document anew, from its whole text behind a line that names the revision."""
    rows = Tables(spark, sf_dir).table("documents")
    d = text.split_table(rows, "doc_id", "text")
    fresh = text.split_table(rows.withColumn("text", F.concat(F.lit("Revision 2.\n"), "text")), "doc_id", "text")
    return retrieval.rebuild(d, fresh, "doc_id").groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max("chunk_index").alias("last_index"))


@query
def postings(spark, sf_dir):
    return retrieval.postings(Tables(spark, sf_dir).table("documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("places"), F.count_distinct("doc_id").alias("docs"))


def _two_words(rows: DataFrame, key: str) -> DataFrame:
    """A query of the two longest different words of each whole text, the longer one first."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]{4,}"), 0))
    best = F.slice(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, 2)["w"]
    return rows.select(F.col(key).alias("query_id"), F.array_join(best, " ").alias("query"), F.size(best).alias("n")).where("n = 2").drop("n")


def _index(t: Tables, stem: bool = False) -> DataFrame:
    """The index of the documents of a folder, by words or by stems, kept for the session; built anew where the documents have changed."""
    key = (*_stamp(t.spark, t.sf_dir, "documents"), stem)
    if key not in _kept:
        path = scratch(t.spark, "postings")
        posting_index.build(t.table("documents"), "doc_id", "text", path, stem=stem)
        _kept[key] = path
    return t.spark.read.parquet(_kept[key])


@query
def index_terms(spark, sf_dir):
    """What the kept index holds of each term."""
    places = F.aggregate("places", F.lit(0).cast("long"), lambda s, p: s + F.size(p))
    return _index(Tables(spark, sf_dir)).groupBy("term").agg(F.sum("docs").alias("docs"), F.sum(places).alias("places"), F.max("best").alias("best"), F.min(F.col("base") + F.col("keys")[0]).alias("first"))


@query
def lexical_topk(spark, sf_dir):
    """From the kept index."""
    t = Tables(spark, sf_dir)
    found = posting_index.search(_index(t), _two_words(t.table("benchmark"), "item_id"), "doc_id", 10)
    return found.withColumn("score", F.round("score", 6))


@query
def term_stems(spark, sf_dir):
    """The words of all documents with their stems."""
    words = retrieval.postings(Tables(spark, sf_dir).table("documents"), "doc_id", "text").select("term").distinct()
    return stems.stems(words, "term")


@query
def lexical_stemmed(spark, sf_dir):
    """As lexical_topk, from the kept index of stems: a search meets other forms of its words."""
    t = Tables(spark, sf_dir)
    found = posting_index.search(_index(t, True), _two_words(t.table("benchmark"), "item_id"), "doc_id", 10, stem=True)
    return found.withColumn("score", F.round("score", 6))


@query
def lexical_web(spark, sf_dir):
    """Phrases, alternatives and exclusions."""
    t = Tables(spark, sf_dir)
    w = _two_words(t.table("benchmark"), "item_id")
    word = lambda i: F.element_at(F.split("query", " "), i)
    asked = w.select("query_id", F.concat(F.lit('"'), "query", F.lit('" OR '), word(1), F.lit(" -"), word(2)).alias("query"))
    return posting_index.search(_index(t), asked, "doc_id", 10).withColumn("score", F.round("score", 6))


def _vectors(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = t.table("embeddings")
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label"), e


def _spread(e: DataFrame) -> DataFrame:
    """Vectors dealt to as many tasks as run at once: a file of one row group would be one task's."""
    return e.repartition(e.sparkSession.sparkContext.defaultParallelism, "vec_id")


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 6))


@query
def dense_topk(spark, sf_dir):
    q, e = _vectors(Tables(spark, sf_dir))
    return _rounded(retrieval.dense_search(q.drop("label"), _spread(e), 10))


@query
def dense_topk_filtered(spark, sf_dir):
    q, e = _vectors(Tables(spark, sf_dir))
    return _rounded(retrieval.dense_search(q, _spread(e), 10, on=["label"]))


@query
def ann_topk(spark, sf_dir):
    q, e = _vectors(Tables(spark, sf_dir))
    return _rounded(vectors.search(q.drop("label"), e, vectors.build(e), 10))


@query
def embed_terms(spark, sf_dir):
    """Vectors of all documents, in thousandths."""
    d = Tables(spark, sf_dir).table("documents")
    v = retrieval.embed_terms(d, "doc_id", "text", retrieval.fit_terms(d, "doc_id", "text"))
    return v.select("doc_id", F.transform("embedding", lambda x: F.round(x * 1000).cast("int")).alias("thousandths"))


@query
def embed_hash(spark, sf_dir):
    return retrieval.embed_hash(Tables(spark, sf_dir).table("documents"), "doc_id", "text").select("doc_id", F.size("embedding").alias("size"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 3).alias("norm"))


def _branches(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Lexical rankings of all documents, for the words of every fiftieth, and dense ones of all vectors, for that document's."""
    q, e = _vectors(t)
    docs = t.table("documents")
    asked = _two_words(written(docs.where("doc_id % 50 = 0").select("doc_id", "text"), "asking"), "doc_id")
    lexical = retrieval.search_all(asked, docs, "doc_id", "text", retrieval.CANDIDATES)
    return lexical, retrieval.dense_search(q.drop("label"), _spread(e), retrieval.CANDIDATES).withColumnRenamed("vec_id", "doc_id")


@query
def rrf(spark, sf_dir):
    """Fusion of two rankings by plain rules."""
    d = Tables(spark, sf_dir).table("documents").where("n_chars IS NOT NULL").select((F.col("doc_id") % 20).alias("query_id"), "doc_id", "n_chars")
    one = merge.top_k(d, ["query_id"], [F.desc("n_chars"), F.col("doc_id")], 50).select("query_id", "doc_id", "rank")
    two = merge.top_k(d, ["query_id"], [F.col("doc_id") % 7, F.col("doc_id")], 50).select("query_id", "doc_id", "rank")
    return retrieval.fuse(one, two, "doc_id", 8)


@query
def hybrid_topk(spark, sf_dir):
    return retrieval.fuse(*_branches(Tables(spark, sf_dir)), "doc_id")


@query
def mode_comparison(spark, sf_dir):
    """How often each mode's hits are chunks of the id that a question is about, with and without the restriction to named ids."""
    t = Tables(spark, sf_dir)
    sample = retrieval.query_sample(t.cves, t.findings)
    asked = sample.select(F.col("cve_id").alias("query_id"), F.concat(F.lit('"'), "cve_id", F.lit('" OR '), F.element_at(F.split("description", " "), -1)).alias("query"), F.concat(F.lit("how do we fix "), "cve_id", F.lit(": "), "description").alias("content"))
    asked = written(asked, "asked")
    out, terms = None, retrieval.chunk_terms(t.chunks)
    for prefilter in (False, True):
        hits = retrieval.chunk_search(asked, t.chunks, prefilter=prefilter, modes=retrieval.MODES, terms=terms).withColumn("prefilter", F.lit(prefilter))
        out = hits if out is None else out.unionByName(hits)
    good = F.startswith("chunk", F.concat("query_id", F.lit("#")))
    return out.groupBy("mode", "prefilter").agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("hits"), F.round(F.avg(good.cast("int")), 4).alias("on_target"))


def _expected(q: DataFrame, e: DataFrame) -> DataFrame:
    """For each query the number of other vectors with its label, counted by label."""
    return q.join(e.groupBy("label").agg(F.count("*").alias("n")), "label").select("query_id", (F.col("n") - 1).alias("n")).where("n > 0")


@query
def retrieval_eval(spark, sf_dir):
    q, e = _vectors(Tables(spark, sf_dir))
    hits = retrieval.dense_search(q.drop("label"), e, 8).join(e.select("vec_id", "label"), "vec_id").join(q.select("query_id", F.col("label").alias("want")), "query_id")
    return retrieval.evaluate_found(hits.select("query_id", (F.col("label") == F.col("want")).alias("good")), _expected(q, e), 8)


@query
def eval_grid(spark, sf_dir):
    """Recall and precision against exact search: exact, and the index by the cells looked at, over all vectors and over those of the query's label; with the share of entries that the measured number of cells holds."""
    q, e = _vectors(Tables(spark, sf_dir))
    q, e = written(q, "queries"), written(e, "corpus")
    index = vectors.build(e, 8)
    out = None
    for filtered in (False, True):
        want = written(retrieval.dense_search(q if filtered else q.drop("label"), e, 8, on=["label"] if filtered else None).select("query_id", "vec_id"), "exact")
        for backend, probe in (("exact", 0), ("index", 1), ("index", max(1, index.probe // 2)), ("index_measured", index.probe)):
            hits = want if backend == "exact" else vectors.search(q.select("query_id", "vector"), e, index, 8, probe, match=(q, e) if filtered else None).select("query_id", "vec_id")
            share = F.lit(round(index.share, 4)) if backend == "index_measured" else F.lit(None).cast("double")
            one = retrieval.evaluate(hits, want, 8).select(F.lit(backend).alias("backend"), F.lit(filtered).alias("filtered"), F.lit(probe).alias("probe"), share.alias("share"), "queries", "recall_at_k", "precision_at_k")
            out = one if out is None else out.unionByName(one)
    return out


@query
def query_sample(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return retrieval.query_sample(t.cves, t.findings)


@query
def prefilter_ids(spark, sf_dir):
    """Chunks that searches naming an id may find."""
    t = Tables(spark, sf_dir)
    asked = t.cves.select(F.col("cve_key").alias("query_id"), F.concat(F.lit("how to fix "), F.lower("cve_id")).alias("query"))
    return retrieval.named_ids(asked).join(t.chunks, "cve_id").select("query_id", "cve_id", "chunk_index")


@query
def plan_context(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return retrieval.plan_context(t.actions, t.chunks).select("idempotency_key", "cve_id", "chunk_ids", F.get("context", 0).alias("first"), F.sha2("prompt", 256).alias("prompt_sha256"))


# Plans


@query
def grounding(spark, sf_dir):
    return Tables(spark, sf_dir).checked.select("plan_id", "checked_cves", "ungrounded_cves", "passed", "reason")


@query
def grounding_ids(spark, sf_dir):
    return Tables(spark, sf_dir).checked.select("plan_id", "checked_cves", "ungrounded_cves")


@query
def ungrounded_clusters(spark, sf_dir):
    return grounding_ops.ungrounded_clusters(Tables(spark, sf_dir).checked)


@query
def plan_rubric(spark, sf_dir):
    return grounding_ops.rubric(Tables(spark, sf_dir).plans).select("plan_id", *grounding_ops.CHECKS, "score", "actionable", "failures", F.col("detail.command_count").alias("commands"), F.col("detail.wrong_os_tooling").alias("wrong_os"), F.col("detail.placeholders").alias("placeholders"), F.col("detail.vague_phrases").alias("vague"))


@query
def rubric_rates(spark, sf_dir):
    return grounding_ops.rates(grounding_ops.rubric(Tables(spark, sf_dir).plans))


@query
def worst_plans(spark, sf_dir):
    return grounding_ops.worst(grounding_ops.rubric(Tables(spark, sf_dir).plans), "plan_id").select("plan_id", "score", "failures")


@query
def plans_with_context(spark, sf_dir):
    t = Tables(spark, sf_dir)
    chunks = t.chunks_of(t.plans).select(F.concat_ws("/", "cve_id", "chunk_index").alias("chunk_id"), "content")
    plans = t.plans.select("plan_id", F.array(F.concat("cve_id", F.lit("/1")), F.concat("cve_id", F.lit("/0"))).alias("chunk_ids"))
    return grounding_ops.with_context(plans, chunks).select("plan_id", F.md5(F.array_join("context", "\n").cast("binary")).alias("context"))


@query
def action_plan_flags(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return reports.plan_flags(t.actions, t.plans).select("idempotency_key", "title", "owner_team", "package_name", "os_family", "risk_band", "fixed_version", "due_date", "asset_count", "finding_count", "hostnames", "has_plan", "plan_grounded")


@query
def plan_detail(spark, sf_dir):
    """One plan by its id."""
    p = Tables(spark, sf_dir).plans
    return reports.plan_by_id(p, p.agg(F.min("plan_id").alias("plan_id"))).select("plan_id", "cve_id", "package_name", "fixed_version", "markdown", "grounded", "created_at")


@query
def draft_markdown(spark, sf_dir):
    """Drafts for all actions as markdown."""
    a = Tables(spark, sf_dir).actions
    steps = F.when(F.col("has_fix"), F.array(F.concat(F.lit("Take a snapshot of "), "package_name"), F.lit("Upgrade"))).otherwise(F.array().cast("array<string>"))
    draft = F.struct(
        F.col("title").alias("summary"), steps.alias("steps"), F.when(F.col("has_fix"), F.array(F.concat(F.lit("upgrade "), "package_name"))).alias("commands"), F.when(~F.col("has_fix"), "Isolate the hosts.").otherwise("").alias("compensating_controls"),
        F.concat(F.lit("Go back to "), "installed_version").alias("rollback"), (F.col("internet_facing_count") > 0).alias("requires_reboot"),
    )
    return a.select("idempotency_key", worklist_ops.draft_markdown(draft).alias("markdown"))


@query
def plan_list(spark, sf_dir):
    return reports.plan_list(Tables(spark, sf_dir).plans).select("plan_id", "cve_id", "package_name", "fixed_version", "created_at")


@query
def plan_coverage(spark, sf_dir):
    return reports.plan_coverage(Tables(spark, sf_dir).plans)


# Worklist


@query
def representative_cve(spark, sf_dir):
    return worklist_ops.representative(Tables(spark, sf_dir).actions).select("idempotency_key", "cve_id", "route")


@query
def worklist(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return worklist_ops.worklist(t.actions, t.plans.where("n % 2 = 0")).select("idempotency_key", "cve_id", "package_name", "os_family", "fixed_version")


@query
def cache_economics(spark, sf_dir):
    return worklist_ops.cache_economics(Tables(spark, sf_dir).actions)


def _unique_plans(t: Tables) -> DataFrame:
    return merge.first_per_key(t.plans.select("plan_id", *worklist_ops.KEY, "grounded", "n"), worklist_ops.KEY, [F.col("plan_id")])


@query
def plan_persist(spark, sf_dir):
    p = _unique_plans(Tables(spark, sf_dir))
    fresh = p.where("n % 3 <> 0").withColumns({"grounded": F.lit(True), "plan_id": F.concat(F.lit("new-"), "plan_id")})
    return worklist_ops.persist_plans(p.where("n % 5 <> 0"), fresh).select("plan_id", *worklist_ops.KEY, "grounded")


@query
def run_outcomes(spark, sf_dir):
    return worklist_ops.run_outcomes(_runs(Tables(spark, sf_dir)))


def _runs(t: Tables) -> DataFrame:
    return t.plans.select(F.col("plan_id").alias("idempotency_key"), F.expr("CASE WHEN NOT grounded THEN 'ungrounded' WHEN n % 5 = 0 THEN 'cached' WHEN n % 19 = 0 THEN 'error' ELSE 'grounded' END").alias("status"))


@query
def run_failures(spark, sf_dir):
    return worklist_ops.failures(_runs(Tables(spark, sf_dir)))


@query
def budget_cut(spark, sf_dir):
    rows = Tables(spark, sf_dir).plans.select(F.col("plan_id").alias("idempotency_key"), F.col("max_risk_score").alias("urgency"), "due_date", worklist_ops.token_estimate("markdown").alias("tokens"))
    return worklist_ops.budget_cut(rows, 500_000).select("idempotency_key", "tokens", "running", "planned")


@query
def attempt_outcomes(spark, sf_dir):
    p = Tables(spark, sf_dir).plans.select(F.col("plan_id").alias("key"), "n", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("attempt"))
    tries = p.select("key", "attempt", F.expr("cast(CASE WHEN n % 19 = 0 THEN 0 WHEN n % 4 = 0 THEN 5 ELSE 4 * attempt END AS int)").alias("context_size"), F.expr("n % 6 < attempt").alias("passed"))
    return worklist_ops.attempt_outcomes(tries)


@query
def widening_retries(spark, sf_dir):
    """Plans that must name their package's remedy, from the first chunks of the id, then from twice as many; some ask for what no chunk has, some find none."""
    t = Tables(spark, sf_dir)
    a = worklist_ops.representative(t.actions).select("idempotency_key", "cve_id", "package_name", F.conv(F.substring("idempotency_key", 1, 6), 16, 10).cast("long").alias("n"))
    a = written(a, "asked")
    chunks = t.chunks_of(a)

    def find(open_: DataFrame, k: int) -> DataFrame:
        near = open_.where("n % 19 <> 0").select("idempotency_key", "cve_id").join(chunks.where(F.col("chunk_index") < k), "cve_id")
        best = near.groupBy("idempotency_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda c: c["content"]).alias("context"))
        return open_.join(best, "idempotency_key", "left")

    def draft(found: DataFrame) -> DataFrame:
        named = F.exists("context", lambda c: F.contains(c, F.concat(F.lit("Package "), "package_name", F.lit(","))))
        return found.withColumn("passed", named & F.expr("n % 5 <> 0"))

    return worklist_ops.widening(a, find, draft, k=1, most=6)


# Tickets


@query
def best_plan(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tickets.best_plan(t.actions, t.plans).select("idempotency_key", "plan_id", "grounded")


@query
def ticket_rows(spark, sf_dir):
    return Tables(spark, sf_dir).tickets.drop("body")


@query
def ticket_bodies(spark, sf_dir):
    return Tables(spark, sf_dir).tickets.select("idempotency_key", "body")


def _filed(t: Tables) -> DataFrame:
    return t.actions.where("asset_count % 3 = 0").select(F.concat(F.lit("T-"), F.substring("idempotency_key", 1, 8)).alias("ticket_id"), "idempotency_key", F.lit("old").alias("title"), "owner_team", "owner_email", "risk_band", "due_date", F.lit("open").alias("state"))


@query
def ticket_preview(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tickets.preview(t.tickets, _filed(t))


@query
def ticket_upsert(spark, sf_dir):
    t = Tables(spark, sf_dir)
    new = t.tickets.select(F.concat(F.lit("N-"), F.substring("idempotency_key", 1, 8)).alias("ticket_id"), "idempotency_key", "title", "owner_team", "owner_email", "risk_band", "due_date", F.lit("open").alias("state"))
    return tickets.upsert(_filed(t), new)


@query
def ticket_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tickets.upsert_counts(_filed(t), t.tickets)


def _action_findings(t: Tables) -> DataFrame:
    v = t.kept_view.withColumn("has_fix", F.col("fixed_version").isNotNull())
    return v.select(correlate.action_key(F.col("has_fix")).alias("idempotency_key"), "finding_id")


@query
def ticket_links(spark, sf_dir):
    t = Tables(spark, sf_dir)
    every = _action_findings(t)
    return tickets.links(t.actions.where("risk_band <> 'low'"), every, every.where("finding_id % 2 = 0"))


def _covering(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Tickets over all findings, by package and asset group, with their links; and which have nothing open."""
    f = t.findings.withColumn("idempotency_key", F.concat_ws("/", "package_name", (F.col("asset_id") % 50).cast("string"), F.substring("installed_version", 1, 6)))
    f = written(f.select("idempotency_key", "finding_id", "status"), "covering")
    filed = f.select("idempotency_key").distinct().withColumns({"title": F.concat(F.lit("Upgrade "), "idempotency_key"), "state": F.when(F.split("idempotency_key", "/")[1].cast("int") % 4 > 0, "open").otherwise("dropped")})
    return filed, tickets.closable(filed, f.select("idempotency_key", "finding_id"), f)


@query
def closable_tickets(spark, sf_dir):
    return _covering(Tables(spark, sf_dir))[1]


@query
def close_tickets(spark, sf_dir):
    """The ticket table after those with nothing open are closed."""
    return tickets.close(*_covering(Tables(spark, sf_dir))).select("idempotency_key", "state")


@query
def tracker_payload(spark, sf_dir):
    p = tickets.tracker_payload(Tables(spark, sf_dir).tickets)
    return p.select("idempotency_key", F.get_json_object("issue", "$.fields.summary").alias("summary"), F.get_json_object("issue", "$.fields.priority.name").alias("priority"), F.get_json_object("issue", "$.fields.duedate").alias("duedate"), F.get_json_object("issue", "$.fields.labels[0]").alias("label"), F.get_json_object("alternative", "$.title").alias("title"), F.get_json_object("alternative", "$.labels[0]").alias("other_label"))


# Streams

#: Scan rows of a part of the stream's table, about.
PART_ROWS = 500_000


def _parts(rows: DataFrame) -> int:
    return max(8, -(-rows.count() // PART_ROWS))


@query
def stream_findings(spark, sf_dir):
    """Seven scans, one micro-batch each, merged into the findings table."""
    where = scratch(spark, "stream")
    # Scans arrive one after another, each in so many files as its rows need, and a batch takes the files of one.
    staged = f"{where}/staged"
    with settings(spark, TIDY):
        (rows := Tables(spark, sf_dir).staged).write.parquet(staged)
        rows = spark.read.schema(rows.schema).parquet(staged)
        files = max(1, rows.count() // (7 * 1_000_000))
        for scan in range(1, 8):
            rows.where(F.col("scan_id") == scan).repartition(files).write.parquet(f"{where}/in/scan={scan}")
    parts = _parts(rows)
    delete(spark, staged)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{where}/in/*")
    stream.stream_merge(source, f"{where}/out", fx.findings_of, f"{where}/checkpoint", parts=parts)
    return stream.current(spark, f"{where}/out").select(*fx.IDENTITY, "first_seen", "last_scan_id", "status")


@query
def stream_repeats(spark, sf_dir):
    """The seven scans again, each delivered twice, the first once more when it is late, and the stream stopped after the fourth: the same table."""
    where = scratch(spark, "repeats")
    staged = f"{where}/staged"
    with settings(spark, TIDY):
        (rows := Tables(spark, sf_dir).staged.withColumn("scanned_at", F.expr("timestamp '2000-01-01 00:00:00' + make_interval(0, 0, 0, cast(scan_id AS int))"))).write.parquet(staged)
    rows = spark.read.schema(rows.schema).parquet(staged)
    files, parts = max(1, rows.count() // (7 * 1_000_000)), _parts(rows)
    deliveries = [[1], [2, 1], [3, 2], [4, 3], [5, 4], [6, 5], [7, 6], [7, 1]]
    for some in (deliveries[:4], deliveries[4:]):
        for scans in some:
            for scan in scans:
                with settings(spark, TIDY):
                    rows.where(F.col("scan_id") == scan).repartition(files).write.parquet(f"{where}/in/n={scans[0]}-{len(scans)}-{scan}-{scans[-1]}")
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2 * files).parquet(f"{where}/in/*")
        once = stream.without_repeats(source, [c for c in rows.columns if c != "scanned_at"], "scanned_at", "3 days")
        stream.stream_merge(once.drop("scanned_at"), f"{where}/out", fx.findings_of, f"{where}/checkpoint", parts=parts)
    delete(spark, staged)
    return stream.current(spark, f"{where}/out").select(*fx.IDENTITY, "first_seen", "last_scan_id", "status")


@query
def quota_trailing(spark, sf_dir):
    """The audit of each event's trailing day as a stream: events come up to three hours late, in some ten deliveries."""
    where = scratch(spark, "trailing")
    e = Tables(spark, sf_dir).table("events").select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("weight"))
    arrives = F.unix_seconds("ts") + F.pmod("event_id", F.lit(4)) * 3599
    span = e.agg(F.min(arrives).alias("a"), F.max(arrives).alias("b")).first()
    dealt = written(e.withColumn("n", F.floor((arrives - span.a) * 10 / (span.b - span.a + 1))), "arrivals")
    for n in range(10):
        dealt.where(F.col("n") == n).drop("n").coalesce(1).write.parquet(f"{where}/in/n={n}")
    last = spark.createDataFrame([(None, None, span.b + 4 * 3600, None)], "event_id long, key long, at long, weight double")
    last.select("event_id", "key", F.timestamp_seconds("at").alias("ts"), "weight").coalesce(1).write.parquet(f"{where}/in/n=last")
    source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in/*")
    told = stream.stream_trailing(source, 86_400, 3, 150.0, "3 hours")
    told.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(told.schema).parquet(f"{where}/out").select("event_id", "calls", F.round("used", 4).alias("used"), "breach")


@query
def quota_stream(spark, sf_dir):
    """Calls and weight of each key in sliding windows, as a stream over the events."""
    where = scratch(spark, "quota")
    e = Tables(spark, sf_dir).table("events").select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("weight"))
    e.write.parquet(f"{where}/in")
    source = spark.readStream.schema(e.schema).parquet(f"{where}/in")
    audit = stream.stream_quota(source, 86_400, 43_200, "3650 days")
    # Complete mode: the few windows of the table are written anew with each batch.
    write = lambda df, _: df.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "key", "calls", "used").write.mode("overwrite").parquet(f"{where}/out")
    audit.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{where}/out").select("start", "key", "calls", F.round("used", 4).alias("used"))


@query
def incremental_score(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return stream.incremental_score(t.findings, t.cves, t.assets, "1998-01-01").select("finding_id", "risk_score", "risk_band", "due_date")


def _new_facts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The ids and assets of a later day: some exploit scores rose, some ids were listed, some assets went to production."""
    cves = t.cves.withColumns({
        "epss_score": F.expr("CASE WHEN cve_key % 17 = 0 THEN cast(0.75 AS decimal(6,5)) ELSE epss_score END"), "kev_listed": F.expr("kev_listed OR cve_key % 101 = 7"),
        "description": F.concat("description", F.lit(" (revised)")),
    })
    return cves, t.assets.withColumn("environment", F.expr("CASE WHEN asset_id % 13 = 0 THEN 'prod' ELSE environment END"))


@query
def changed_facts(spark, sf_dir):
    """Ids and assets whose facts differ from the prints that the run before kept."""
    t = Tables(spark, sf_dir)
    before = written(changes.prints(t.cves, t.assets), "prints")
    return changes.changed(before, changes.prints(*_new_facts(t)))


@query
def changed_scores(spark, sf_dir):
    """The findings that changed facts concern, scored anew; no others are."""
    t = Tables(spark, sf_dir)
    before = written(changes.prints(t.cves, t.assets), "prints")
    return changes.rescore(t.findings, *_new_facts(t), before).select("finding_id", "risk_score", "risk_band", "due_date")


@query
def quota_audit(spark, sf_dir):
    e = Tables(spark, sf_dir).table("events").select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("weight"))
    return stream.quota_audit(e, 86_400, 3, 150.0).select("event_id", "calls", F.round("used", 4).alias("used"), "breach")
