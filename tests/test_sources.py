import gzip
import json

from fathomline.sources import feeds


def test_reports_catalogue_and_scores(spark, tmp_path):
    vuln = {"VulnerabilityID": "CVE-2020-1234", "PkgName": "p", "InstalledVersion": "1", "FixedVersion": "2, 3", "Severity": "HIGH", "CVSS": {"redhat": {"V3Score": 5.0, "V3Vector": "r"}, "ghsa": {"V3Vector": "none"}, "a": {"V3Score": 9.0}}}
    (tmp_path / "web-1.json").write_text(json.dumps({"Results": [{"Type": "deb"}, {"Type": "deb", "Vulnerabilities": [vuln, vuln | {"VulnerabilityID": "GHSA-1"}]}]}))
    rows = feeds.scan_reports(spark, str(tmp_path / "web-1.json")).orderBy("position").collect()
    assert [(r.hostname, r.cve_id, r.cvss.V3Score, r.package_type) for r in rows] == [("web-1", "CVE-2020-1234", 5.0, "deb"), ("web-1", "GHSA-1", 5.0, "deb")]
    (tmp_path / "kev.json").write_text(json.dumps({"vulnerabilities": [{"cveID": "CVE-1", "dueDate": "2024-02-01", "knownRansomwareCampaignUse": " known "}, {"cveID": " "}]}))
    (kev,) = feeds.exploited_catalogue(spark, str(tmp_path / "kev.json")).collect()
    assert kev.ransomware and str(kev.due_date) == "2024-02-01" and kev.required_action is None
    with gzip.open(tmp_path / "epss.csv.gz", "wt") as f:
        f.write("#model:v3\ncve,epss,percentile\nCVE-1,0.5,0.9\nCVE-2,bad,0.1\n")
    assert [(r.cve_id, float(r.epss)) for r in feeds.exploit_scores(spark, str(tmp_path / "epss.csv.gz")).collect()] == [("CVE-1", 0.5)]
    assert feeds.score_model(spark, str(tmp_path / "epss.csv.gz")).first().value == "#model:v3"


def test_reports_are_written_compressed(spark, tmp_path, monkeypatch):
    from fathomline import queries

    monkeypatch.setattr(queries, "scratch", lambda *_: f"file://{tmp_path}/reports")
    n = queries.QUERIES["report_flatten"](spark, "/root/testdata/sf0.001").agg({"n": "sum"}).first()[0]
    files = list(tmp_path.rglob("part-*"))
    assert n == queries.Tables(spark, "/root/testdata/sf0.001").staged.count() and files and all(f.name.endswith(".json.gz") for f in files)
