"""Change capture: which ids' and assets' facts differ from those that the last run saw, and which findings that concerns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import broadcast_if_small
from . import risk

#: What the policy reads of an id and of an asset.
CVE_FACTS = ["cvss_v31_score", "cvss_v40_score", "cvss_severity", "kev_listed", "kev_ransomware", "kev_due_date", "epss_score"]
ASSET_FACTS = ["environment", "business_criticality", "internet_facing", "data_classification"]


def prints(cves: DataFrame, assets: DataFrame) -> DataFrame:
    """(kind, key, print): a hash of each id's and each asset's facts, to be kept until the next run. Null and empty facts differ."""
    told = lambda columns: F.md5(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]).cast("binary"))
    one = cves.select(F.lit("cve").alias("kind"), F.col("cve_id").alias("key"), told(CVE_FACTS).alias("print"))
    return one.unionByName(assets.select(F.lit("asset").alias("kind"), F.col("asset_id").cast("string").alias("key"), told(ASSET_FACTS).alias("print")))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, key) of the facts that are new, gone, or whose print differs."""
    old = before.select("kind", "key", F.col("print").alias("_old"))
    return after.join(old, ["kind", "key"], "full_outer").where(~F.col("print").eqNullSafe(F.col("_old"))).select("kind", "key")


def affected(findings: DataFrame, keys: DataFrame) -> DataFrame:
    """The findings of a changed id or asset, each once. The keys go out to the findings where they are few."""
    ids = broadcast_if_small(keys.where("kind = 'cve'").select(F.col("key").alias("_cve"), F.lit(True).alias("_c")))
    hosts = broadcast_if_small(keys.where("kind = 'asset'").select(F.col("key").alias("_asset"), F.lit(True).alias("_a")))
    marked = findings.join(ids, F.col("cve_id") == F.col("_cve"), "left").join(hosts, F.col("asset_id").cast("string") == F.col("_asset"), "left")
    return marked.where("_c OR _a").select(*findings.columns)


def rescore(findings: DataFrame, cves: DataFrame, assets: DataFrame, before: DataFrame) -> DataFrame:
    """New assessments of the open findings whose id's or asset's facts differ from the prints of the last run; no other finding is scored."""
    return risk.assess(affected(findings.where("status = 'open'"), changed(before, prints(cves, assets))), cves, assets)
