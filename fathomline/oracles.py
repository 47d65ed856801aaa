"""DuckDB SQL with the results of the registered queries.

Every query is a chain of common table expressions over the given tables; `sql` puts the chain before a body.
"""

from __future__ import annotations


def _cve(k: str) -> str:
    return f"('CVE-' || cast(2010 + {k} % 15 AS VARCHAR) || '-' || cast(10000 + {k} AS VARCHAR))"


def key(v: str) -> str:
    """The orderable version key."""
    epoch = f"regexp_replace(regexp_extract({v}, '^([0-9]+):', 1), '^0+', '')"
    return (
        f"list_concat([struct_pack(k := 0, len := length({epoch}), s := {epoch})], list_transform(regexp_extract_all(regexp_replace({v}, '^[0-9]+:', ''), '[0-9]+|[A-Za-z]+'), "
        "lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN struct_pack(k := 1, len := length(regexp_replace(p, '^0+', '')), s := regexp_replace(p, '^0+', '')) ELSE struct_pack(k := 0, len := 0::BIGINT, s := lower(p)) END))"
    )


def points(kind: str) -> str:
    return {
        "severity": "cast(least(coalesce(cvss_v31_score, cvss_v40_score, CASE upper(cvss_severity) WHEN 'CRITICAL' THEN 9.0 WHEN 'HIGH' THEN 7.5 WHEN 'MEDIUM' THEN 5.0 WHEN 'LOW' THEN 2.0 END, 5.0) * 4, 40) AS DECIMAL(5,2))",
        "exploit": "cast(CASE WHEN kev_listed AND kev_ransomware THEN 30 WHEN kev_listed THEN 25 WHEN epss_score IS NULL THEN 0 WHEN epss_score >= 0.5 THEN 20 WHEN epss_score >= 0.1 THEN 12 WHEN epss_score >= 0.01 THEN 6 ELSE 0 END AS DECIMAL(5,2))",
        "exposure": "cast(CASE WHEN internet_facing AND environment = 'prod' THEN 15 WHEN internet_facing THEN 10 WHEN environment = 'prod' THEN 6 WHEN environment = 'staging' THEN 3 ELSE 0 END AS DECIMAL(5,2))",
        "criticality": "cast((least(5, greatest(1, business_criticality)) - 1) * 2.5 AS DECIMAL(5,2))",
        "data": "cast(CASE data_classification WHEN 'restricted' THEN 5 WHEN 'confidential' THEN 3 WHEN 'internal' THEN 1 WHEN 'public' THEN 0 ELSE 1 END AS DECIMAL(5,2))",
    }[kind]


CHAIN = {
    "assets": """
        SELECT c_custkey AS asset_id, lower(replace(c_name, '#', '-')) AS hostname,
            CASE c_custkey % 3 WHEN 0 THEN 'debian' WHEN 1 THEN 'rhel' ELSE 'alpine' END AS os_family,
            CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 'prod' WHEN c_mktsegment = 'MACHINERY' THEN 'staging' ELSE 'dev' END AS environment,
            cast(1 + c_custkey % 5 AS INTEGER) AS business_criticality, c_custkey % 4 = 0 AS internet_facing,
            CASE c_nationkey % 4 WHEN 0 THEN 'restricted' WHEN 1 THEN 'confidential' WHEN 2 THEN 'internal' ELSE 'public' END AS data_classification,
            lower(r_name) AS owner_team, lower(r_name) || '@example.com' AS owner_email
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "cves": f"""
        SELECT {_cve("p_partkey")} AS cve_id, p_name || ' ' || p_type AS description,
            CASE WHEN p_partkey % 7 <> 0 THEN cast(p_size / 5 AS DECIMAL(3,1)) END AS cvss_v31_score,
            CASE WHEN p_partkey % 14 = 0 THEN cast(p_size / 5 AS DECIMAL(3,1)) END AS cvss_v40_score,
            CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_size >= 45 THEN 'CRITICAL' WHEN p_size >= 35 THEN 'HIGH' WHEN p_size >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS cvss_severity,
            p_partkey % 20 = 3 AS kev_listed, p_partkey % 60 = 3 AS kev_ransomware,
            CASE WHEN p_partkey % 20 = 3 THEN DATE '1996-01-01' + cast(p_partkey AS INTEGER) END AS kev_due_date,
            CASE WHEN p_partkey % 11 <> 0 THEN cast(((p_partkey * 7919) % 1000) * (p_partkey % 10) / 10000 AS DECIMAL(6,5)) END AS epss_score, p_partkey AS cve_key
        FROM part""",
    "staged0": """
        SELECT l_orderkey * 10 + l_linenumber AS row_id, cast(l_linenumber AS BIGINT) AS scan_id, o_custkey AS asset_id, l_partkey AS k, l_linenumber AS ln, p_brand,
            CASE o_custkey % 3 WHEN 0 THEN '+deb11u' || (l_partkey % 4 + 1) WHEN 1 THEN '-' || (l_partkey % 4 + 1) || '.el9' ELSE '-r' || (l_partkey % 4 + 1) END AS suffix,
            CASE WHEN l_linestatus <> 'F' THEN 'open' WHEN l_returnflag = 'R' THEN 'fixed' WHEN l_returnflag = 'A' THEN 'accepted_risk' ELSE 'open' END AS status,
            cast(o_orderdate AS DATE) AS first_seen, cast(l_shipdate AS DATE) AS seen_at
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "staged1": f"""
        SELECT row_id, scan_id, asset_id, {_cve("k")} AS cve_id, lower(replace(p_brand, '#', '-')) AS package_name,
            '1.' || ln || '.' || (k % 13) || suffix AS installed_version,
            CASE WHEN k % 9 <> 0 THEN '0.9.' || (k % 7) || suffix || ', 1.' || (ln + 4) || '.0' || suffix || ', 1.' || ln || '.' || (k % 13 + 1) || suffix END AS fixed_raw,
            status, first_seen, seen_at
        FROM staged0""",
    "staged": """
        SELECT *, ('0x' || substr(md5(concat_ws('|', asset_id, cve_id, package_name, installed_version)), 1, 15))::BIGINT AS finding_id FROM staged1""",
    "findings0": """
        SELECT asset_id, cve_id, package_name, installed_version, min(finding_id) AS finding_id, max(scan_id) AS last_scan_id, min(fixed_raw) AS fixed_raw, min(first_seen) AS first_seen, max(seen_at) AS last_seen,
            CASE WHEN bool_or(status = 'open') THEN 'open' WHEN bool_or(status = 'accepted_risk') THEN 'accepted_risk' ELSE 'fixed' END AS status
        FROM staged GROUP BY ALL""",
    "pairs": "SELECT DISTINCT fixed_raw, installed_version FROM findings0",
    "options": f"""
        SELECT fixed_raw, installed_version, trim(unnest(string_split(fixed_raw, ','))) AS v, generate_subscripts(string_split(fixed_raw, ','), 1) AS pos FROM pairs WHERE fixed_raw IS NOT NULL""",
    "keyed": f"SELECT *, {key('v')} AS vk, {key('installed_version')} AS ik FROM options WHERE v <> ''",
    "chosen": """
        SELECT fixed_raw, installed_version, coalesce(arg_min(v, row(vk, pos)) FILTER (WHERE vk > ik), arg_max(v, row(vk, -pos))) AS fixed_version FROM keyed GROUP BY ALL""",
    "findings": """
        SELECT f.* EXCLUDE (fixed_raw), c.fixed_version FROM findings0 f LEFT JOIN chosen c ON f.fixed_raw = c.fixed_raw AND f.installed_version = c.installed_version""",
    "facts": """
        SELECT f.finding_id, f.asset_id, f.cve_id, f.package_name, f.installed_version, f.fixed_version, f.status, f.first_seen, f.last_seen, c.* EXCLUDE (cve_id, description, cve_key), a.* EXCLUDE (asset_id)
        FROM findings f JOIN cves c ON f.cve_id = c.cve_id JOIN assets a ON f.asset_id = a.asset_id WHERE f.status = 'open'""",
    "components": f"""
        SELECT *, coalesce(cvss_v31_score, cvss_v40_score, CASE upper(cvss_severity) WHEN 'CRITICAL' THEN 9.0 WHEN 'HIGH' THEN 7.5 WHEN 'MEDIUM' THEN 5.0 WHEN 'LOW' THEN 2.0 END, 5.0) AS cvss_base,
            CASE WHEN cvss_v31_score IS NOT NULL THEN 'cvss_v31' WHEN cvss_v40_score IS NOT NULL THEN 'cvss_v40' WHEN cvss_severity IS NOT NULL THEN 'severity_label_fallback' ELSE 'unscored_default' END AS cvss_source,
            {points("severity")} AS severity_points, {points("exploit")} AS exploit_points, {points("exposure")} AS exposure_points, {points("criticality")} AS criticality_points, {points("data")} AS data_points,
            CASE WHEN kev_listed AND kev_ransomware THEN 'kev_ransomware' WHEN kev_listed THEN 'kev_listed' WHEN epss_score IS NULL THEN 'no_epss_data' WHEN epss_score >= 0.5 THEN 'epss_gte_50pct' WHEN epss_score >= 0.1 THEN 'epss_gte_10pct' WHEN epss_score >= 0.01 THEN 'epss_gte_1pct' ELSE 'epss_below_1pct' END AS exploit_reason,
            CASE WHEN internet_facing AND environment = 'prod' THEN 'internet_facing_prod' WHEN internet_facing THEN 'internet_facing_nonprod' ELSE 'internal_' || environment END AS exposure_reason
        FROM facts""",
    "banded": """
        SELECT *, CASE WHEN risk_score >= 75 THEN 'critical' WHEN risk_score >= 55 THEN 'high' WHEN risk_score >= 35 THEN 'medium' ELSE 'low' END AS scored_band FROM (
            SELECT *, cast(least(criticality_points + data_points, 15) AS DECIMAL(5,2)) AS asset_points,
                cast(severity_points + exploit_points + exposure_points + least(criticality_points + data_points, 15) AS DECIMAL(5,2)) AS risk_score FROM components)""",
    "scored": """
        SELECT *, CASE WHEN kev_listed AND kev_ransomware THEN 'critical' WHEN kev_listed AND scored_band IN ('low', 'medium') THEN 'high' ELSE scored_band END AS risk_band,
            CASE WHEN kev_listed AND kev_ransomware AND scored_band <> 'critical' THEN 'kev_ransomware_floor' WHEN kev_listed AND NOT kev_ransomware AND scored_band IN ('low', 'medium') THEN 'kev_floor' END AS floor_rule
        FROM banded""",
    "ruled": """
        SELECT *, CASE risk_band WHEN 'critical' THEN 7 WHEN 'high' THEN 15 WHEN 'medium' THEN 45 ELSE 90 END AS band_days,
            CASE WHEN kev_listed AND internet_facing THEN 1 WHEN kev_listed AND kev_due_date < first_seen THEN 2
                WHEN kev_listed AND kev_due_date < first_seen + CASE risk_band WHEN 'critical' THEN 7 WHEN 'high' THEN 15 WHEN 'medium' THEN 45 ELSE 90 END THEN 3 ELSE 4 END AS rule
        FROM scored""",
    "v": """
        SELECT * EXCLUDE (rule, band_days), CASE rule WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 3 THEN greatest(kev_due_date - first_seen, 0) ELSE band_days END AS sla_days,
            CASE rule WHEN 1 THEN first_seen + 3 WHEN 2 THEN first_seen + 3 WHEN 3 THEN kev_due_date ELSE first_seen + band_days END AS due_date,
            CASE rule WHEN 1 THEN 'emergency_kev_internet_facing' WHEN 2 THEN 'kev_deadline_already_passed' WHEN 3 THEN 'cisa_kev_due_date_ceiling' ELSE 'band_baseline_' || risk_band END AS sla_rule,
            coalesce(rule <= 2 AND kev_due_date < first_seen, false) AS kev_deadline_passed,
            CASE rule WHEN 1 THEN first_seen + 3 WHEN 2 THEN first_seen + 3 WHEN 3 THEN kev_due_date ELSE first_seen + band_days END < DATE '2000-01-01' AS overdue,
            CASE rule WHEN 1 THEN first_seen + 3 WHEN 2 THEN first_seen + 3 WHEN 3 THEN kev_due_date ELSE first_seen + band_days END - DATE '2000-01-01' AS days_remaining
        FROM ruled""",
    "fixes": """
        SELECT *, fixed_version IS NOT NULL AS has_fix FROM v""",
    "groups": """
        SELECT owner_team, owner_email, package_name, os_family, risk_band, has_fix, min(due_date) AS due_date, max(risk_score) AS max_risk_score, count(DISTINCT asset_id) AS asset_count,
            count(DISTINCT asset_id) FILTER (WHERE internet_facing) AS internet_facing_count, count(DISTINCT asset_id) FILTER (WHERE environment = 'prod') AS prod_count,
            list_sort(list(DISTINCT cve_id)) AS cve_ids, coalesce(list_sort(list(DISTINCT cve_id) FILTER (WHERE kev_listed)), []) AS kev_cve_ids, count(*) AS finding_count,
            list_sort(list(DISTINCT hostname)) AS hostnames, list_sort(list(DISTINCT environment)) AS environments, max(epss_score) AS max_epss, min(installed_version) AS installed_version
        FROM fixes GROUP BY ALL""",
    "versions": f"SELECT DISTINCT owner_team, package_name, os_family, fixed_version, {key('fixed_version')} AS vk FROM v WHERE fixed_version IS NOT NULL",
    "targets": "SELECT owner_team, package_name, os_family, arg_max(fixed_version, row(vk, fixed_version)) AS target_version FROM versions GROUP BY ALL",
    "asked": "SELECT owner_team, owner_email, package_name, os_family, risk_band, has_fix, cve_id, max(fixed_version) AS required_version FROM fixes WHERE has_fix GROUP BY ALL",
    "actions": """
        SELECT g.*, CASE WHEN has_fix THEN target_version END AS fixed_version,
            substr(sha256(concat_ws('|', g.owner_team, g.package_name, g.os_family, risk_band, CASE WHEN has_fix THEN 'fix' ELSE 'nofix' END)), 1, 32) AS idempotency_key,
            '[' || upper(risk_band) || '] Upgrade ' || g.package_name || CASE WHEN has_fix THEN ' to ' || target_version ELSE ' (no fix available)' END || ' on ' || asset_count || ' ' || g.os_family || CASE WHEN asset_count = 1 THEN ' host' ELSE ' hosts' END AS title
        FROM groups g LEFT JOIN targets t ON g.owner_team = t.owner_team AND g.package_name = t.package_name AND g.os_family = t.os_family""",
    "led": "SELECT *, ('0x' || substr(idempotency_key, 1, 6))::BIGINT AS n, coalesce(kev_cve_ids[1], cve_ids[1]) AS cve_id FROM actions",
    "plans": """
        SELECT idempotency_key AS plan_id, n, cve_id, package_name, os_family, fixed_version, fixed_version AS target_version, risk_band, max_risk_score, due_date, DATE '1999-01-01' + cast(n % 300 AS INTEGER) AS created_at,
            NOT (n % 11 = 0 OR n % 17 = 0 OR (n % 7 = 0 AND fixed_version IS NOT NULL AND os_family <> 'debian')) AS grounded,
            coalesce('Upgrade `' || package_name || '` to ' || CASE WHEN n % 7 = 0 THEN fixed_version || '9' ELSE fixed_version END || ' for ' || CASE WHEN n % 11 = 0 THEN 'CVE-1999-0001' ELSE cve_id END || '.' || chr(10) || chr(10) || '```bash' || chr(10)
                || CASE os_family WHEN 'debian' THEN 'apt-get install ' || package_name || '=' WHEN 'rhel' THEN 'dnf install ' || package_name || '-' ELSE 'apk add ' || package_name || '=' END || CASE WHEN n % 7 = 0 THEN fixed_version || '9' ELSE fixed_version END
                || chr(10) || '```' || chr(10) || chr(10) || 'Rollback to ' || installed_version || '.' || CASE WHEN n % 13 = 0 THEN ' Restart /path/to/app.' ELSE '' END || CASE WHEN n % 17 = 0 THEN ' Then rm -rf / tmp.' ELSE '' END,
                'No fix is out for ' || CASE WHEN n % 11 = 0 THEN 'CVE-1999-0001' ELSE cve_id END || '; isolate the service.' || CASE WHEN n % 13 = 0 THEN ' Restart /path/to/app.' ELSE '' END || CASE WHEN n % 17 = 0 THEN ' Then rm -rf / tmp.' ELSE '' END) AS markdown
        FROM led""",
    "matched": """
        SELECT a.idempotency_key, p.plan_id, p.grounded, row_number() OVER (PARTITION BY a.idempotency_key ORDER BY p.grounded DESC, p.created_at DESC, p.plan_id) AS place
        FROM actions a JOIN plans p ON a.package_name = p.package_name AND a.fixed_version IS NOT DISTINCT FROM p.fixed_version AND list_contains(a.cve_ids, p.cve_id)""",
    "best": "SELECT idempotency_key, plan_id, grounded FROM matched WHERE place = 1",
    "tickets": """
        SELECT a.idempotency_key, title, owner_team, owner_email, a.risk_band, a.due_date, plan_id, coalesce(grounded, false) AS grounded, finding_count,
            list_filter(['scanner', 'sev:' || a.risk_band, CASE WHEN len(kev_cve_ids) > 0 THEN 'kev' END, CASE WHEN NOT has_fix THEN 'no-fix-available' END, CASE WHEN internet_facing_count > 0 THEN 'internet-facing' END, 'team:' || owner_team], lambda x: x IS NOT NULL) AS labels
        FROM actions a LEFT JOIN best b ON a.idempotency_key = b.idempotency_key""",
    "covered": "SELECT substr(sha256(concat_ws('|', owner_team, package_name, os_family, risk_band, CASE WHEN has_fix THEN 'fix' ELSE 'nofix' END)), 1, 32) AS idempotency_key, finding_id FROM fixes",
    "fixset": f"""
        SELECT cve_id, package_name, list(DISTINCT installed_version ORDER BY installed_version) AS seen, list_transform(list_sort(list(DISTINCT struct_pack(k := {key("fixed_version")}, v := fixed_version)) FILTER (WHERE fixed_version IS NOT NULL)), lambda x: x.v) AS fixed
        FROM findings GROUP BY ALL""",
    "headed": "SELECT *, cve_id || coalesce(' (' || cvss_severity || coalesce(', score ' || cast(cvss_v31_score AS VARCHAR), '') || ')', '') AS header FROM cves WHERE description IS NOT NULL",
    "whole": """
        SELECT cve_id, header, 0 AS part, '' AS package_name, 'What it is: ' || description AS body FROM headed
        UNION ALL SELECT cve_id, header, 1, '', concat_ws(' ', CASE WHEN kev_listed THEN 'It is known to be exploited.' END, CASE WHEN kev_ransomware THEN 'Ransomware uses it.' END, CASE WHEN epss_score IS NOT NULL THEN 'Exploit probability ' || cast(epss_score AS VARCHAR) || '.' END) FROM headed WHERE kev_listed OR epss_score IS NOT NULL
        UNION ALL SELECT h.cve_id, header, 2, f.package_name, 'Package ' || f.package_name || ', seen in ' || array_to_string(seen, ', ') || '.' || CASE WHEN len(fixed) > 0 THEN ' Fixed in ' || array_to_string(fixed, ', ') || '. Move to ' || fixed[1] || ' or later.' ELSE ' No fix is published; use a compensating control.' END FROM headed h JOIN fixset f ON h.cve_id = f.cve_id""",
}


def sql(body: str, upto: str | None = None) -> str:
    """`body` behind the chain up to and with the table named."""
    names = list(CHAIN)
    used = names[: names.index(upto) + 1] if upto else names
    return "WITH " + ",\n".join(f"{n} AS ({CHAIN[n]})" for n in used) + "\n" + body


def split(source: str, ident: str, text: str) -> str:
    """Recursive tables `cuts` and `parts` (columns of ident, idx from 1, content) that split the texts of `source`."""
    last = lambda sep: f"CASE WHEN strpos(reverse(w), reverse({sep})) > 0 THEN length(w) - (strpos(reverse(w), reverse({sep})) - 1) - length({sep}) ELSE -1 END"
    return f"""
        steps AS (
            SELECT {ident}, {text} AS t, length({text}) AS n, 0 AS a, CASE WHEN length({text}) <= 1400 THEN length({text}) ELSE NULL END AS e, 0 AS i FROM {source}
            UNION ALL
            SELECT {ident}, t, n, a, e, i FROM (
                SELECT {ident}, t, n, CASE WHEN i = 0 THEN 0 ELSE greatest(e - 150, a + 1) END AS a, i + 1 AS i,
                    CASE WHEN CASE WHEN i = 0 THEN 0 ELSE greatest(e - 150, a + 1) END + 1400 >= n THEN n ELSE CASE WHEN i = 0 THEN 0 ELSE greatest(e - 150, a + 1) END + (
                        SELECT CASE WHEN {last("'. '")} > 700 THEN {last("'. '")} + 2 WHEN {last("chr(10)")} > 700 THEN {last("chr(10)")} + 1 WHEN {last("' '")} > 700 THEN {last("' '")} + 1 ELSE 1400 END FROM (SELECT substr(t, CASE WHEN i = 0 THEN 0 ELSE greatest(e - 150, a + 1) END + 1, 1400) AS w)) END AS e
                FROM steps WHERE n > 1400 AND (e IS NULL OR e < n))),
        parts AS (SELECT {ident}, row_number() OVER (PARTITION BY {ident} ORDER BY i) AS idx, content FROM (SELECT {ident}, i, CASE WHEN n <= 1400 THEN t ELSE trim(substr(t, a + 1, e - a), ' ' || chr(10) || chr(9) || chr(13)) END AS content FROM steps WHERE e IS NOT NULL) WHERE content <> '' OR i = 0)"""


_SHOWN = "finding_id, hostname, owner_team, os_family, cve_id, package_name, installed_version, fixed_version, risk_score, risk_band, due_date, overdue, days_remaining, kev_listed, epss_score, internet_facing, environment"
_WIDE = "owner_team, owner_email, package_name, os_family, risk_band, has_fix, due_date, max_risk_score, asset_count, internet_facing_count, prod_count, cve_ids, kev_cve_ids, finding_count, hostnames, environments, max_epss, installed_version, fixed_version, idempotency_key, title"

_COUNTS = {
    "assets": "count(*) FROM assets", "cves": "count(*) FROM cves", "findings": "count(*) FROM findings", "findings_open": "count(*) FROM v", "kev_cves": "count(*) FROM cves WHERE kev_listed", "chunks": "count(*) FROM parts",
    "plans": "count(*) FROM plans", "plans_grounded": "count(*) FROM plans WHERE grounded", "tickets": "count(*) FROM actions", "fix_actions": "count(*) FROM actions",
}


def _chunked(body: str) -> str:
    """`body` behind the whole chain and the table `parts` of its chunks."""
    return sql("", "whole").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + "," + split("whole", "cve_id, header, part, package_name", "body") + "\n" + body


def _lexical(source: str, ident: str, which: str) -> str:
    """Tables q (a query's two words) and s (cover density of each query and document)."""
    words = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]{1}')".format
    return f"""
        WITH w AS (SELECT {ident} AS query_id, unnest(list_distinct({words('text', '{4,}')})) AS x FROM {source} WHERE {which}),
        q AS (SELECT query_id, max(CASE WHEN i = 1 THEN x END) AS t1, max(CASE WHEN i = 2 THEN x END) AS t2 FROM (SELECT query_id, x, row_number() OVER (PARTITION BY query_id ORDER BY length(x) DESC, x) AS i FROM w) WHERE i <= 2 GROUP BY ALL HAVING count(*) = 2),
        p AS (SELECT doc_id, unnest({words('text', '+')}) AS term, generate_subscripts({words('text', '+')}, 1) AS pos FROM documents),
        h AS (SELECT query_id, doc_id, pos, max(CASE WHEN term = t1 THEN pos END) OVER w AS l1, max(CASE WHEN term = t2 THEN pos END) OVER w AS l2 FROM p JOIN q ON term = t1 OR term = t2 WINDOW w AS (PARTITION BY query_id, doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
        c AS (SELECT query_id, doc_id, least(l1, l2) AS a, min(pos) AS b FROM h WHERE l1 IS NOT NULL AND l2 IS NOT NULL GROUP BY ALL),
        s AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (1 + greatest(0, b - a + 1 - 2))) AS score FROM c GROUP BY ALL)"""


_COVERING = """
    , covering AS (SELECT package_name || '/' || (asset_id % 50) || '/' || substr(installed_version, 1, 6) AS k, any_value((asset_id % 50) % 4 > 0) AS filed, count(*) AS total, count(*) FILTER (WHERE status = 'open') AS still FROM findings GROUP BY 1)
    """.lstrip()


def _later(body: str) -> str:
    """A body over the view with the facts of a later day."""
    later = {
        "assets": "SELECT * REPLACE (CASE WHEN asset_id % 13 = 0 THEN 'prod' ELSE environment END AS environment) FROM assets0",
        "cves": "SELECT * REPLACE (CASE WHEN cve_key % 17 = 0 THEN cast(0.75 AS DECIMAL(6,5)) ELSE epss_score END AS epss_score, kev_listed OR cve_key % 101 = 7 AS kev_listed) FROM cves0",
    }
    names = list(CHAIN)[: list(CHAIN).index("v") + 1]
    return "WITH " + ", ".join(f"{n}0 AS ({CHAIN[n]}), {n} AS ({later[n]})" if n in later else f"{n} AS ({CHAIN[n]})" for n in names) + " " + body


ORACLES = {
    "assets": sql("SELECT * FROM assets", "assets"),
    "cves": sql("SELECT * FROM cves", "cves"),
    "findings": sql("SELECT * FROM findings", "findings"),
    "asset_merge": sql("""
        SELECT asset_id, hostname, CASE WHEN asset_id % 2 = 0 THEN os_family ELSE 'unknown' END AS os_family, environment, business_criticality, internet_facing, data_classification, owner_team, owner_email FROM assets""", "assets"),
    "cve_seeds": sql("""
        SELECT cve_id, severity, hostname, position FROM (
            SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY CASE upper(severity) WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END DESC, hostname, position) AS n
            FROM (SELECT s.cve_id, CASE s.row_id % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' END AS severity, a.hostname, s.row_id AS position FROM staged s JOIN assets a ON s.asset_id = a.asset_id)) WHERE n = 1""", "staged"),
    "seed_merge": sql("""
        SELECT cve_id, CASE WHEN cve_key % 3 <> 0 THEN coalesce(CASE WHEN cve_key % 4 <> 0 THEN cvss_severity END, 'HIGH') ELSE 'HIGH' END AS severity, CASE WHEN cve_key % 3 <> 0 AND cve_key % 5 <> 0 THEN description ELSE 'seen' END AS title FROM cves""", "cves"),
    "host_resolution": sql("SELECT row_id, s.cve_id, a.asset_id FROM staged s JOIN assets a ON s.asset_id = a.asset_id WHERE a.asset_id % 10 > 0 AND row_id % 7 <> 0", "staged"),
    "findings_closed": sql("""
        , s AS (SELECT asset_id, cve_id, package_name, installed_version, scan_id > 4 AS new, max(scan_id) AS last_scan_id, CASE WHEN bool_or(status = 'open') THEN 'open' WHEN bool_or(status = 'accepted_risk') THEN 'accepted_risk' ELSE 'fixed' END AS status FROM staged GROUP BY ALL)
        SELECT asset_id, cve_id, package_name, installed_version, max(last_scan_id) AS last_scan_id,
            CASE WHEN NOT bool_or(new) THEN CASE max(status) WHEN 'open' THEN 'fixed' ELSE max(status) END WHEN bool_and(new) THEN max(status) ELSE CASE max(status) FILTER (WHERE NOT new) WHEN 'fixed' THEN 'open' ELSE max(status) FILTER (WHERE NOT new) END END AS status
        FROM s GROUP BY ALL""".lstrip(), "staged"),
    "findings_sink": sql("SELECT cast(asset_id % 16 AS INTEGER) AS shard, CASE WHEN asset_id % 16 < 4 THEN 'replaced' ELSE status END AS status, count(*) AS rows, cast(sum(finding_id % 1000003) AS BIGINT) AS ids FROM findings0 GROUP BY ALL", "findings0"),
    "staged_dedup": sql("SELECT finding_id, asset_id, cve_id, package_name, installed_version, scan_id FROM (SELECT * EXCLUDE (finding_id), row_id AS finding_id, row_number() OVER (PARTITION BY asset_id, cve_id, package_name, installed_version ORDER BY scan_id DESC, fixed_raw NULLS LAST, row_id) AS n FROM staged) WHERE n = 1", "staged"),
    "findings_merged": sql("""
        , old AS (SELECT asset_id, cve_id, package_name, installed_version, min(finding_id) AS finding_id, max(scan_id) AS last_scan_id, min(first_seen) AS first_seen, max(seen_at) AS last_seen, CASE WHEN bool_or(status = 'open') THEN 'open' WHEN bool_or(status = 'accepted_risk') THEN 'accepted_risk' ELSE 'fixed' END AS status FROM staged WHERE scan_id <= 4 GROUP BY ALL),
        new AS (SELECT asset_id, cve_id, package_name, installed_version, min(finding_id) AS finding_id, max(scan_id) AS last_scan_id, min(first_seen) AS first_seen, max(seen_at) AS last_seen, CASE WHEN bool_or(status = 'open') THEN 'open' WHEN bool_or(status = 'accepted_risk') THEN 'accepted_risk' ELSE 'fixed' END AS status FROM staged WHERE scan_id > 2 GROUP BY ALL)
        SELECT coalesce(o.asset_id, n.asset_id) AS asset_id, coalesce(o.cve_id, n.cve_id) AS cve_id, coalesce(o.package_name, n.package_name) AS package_name, coalesce(o.installed_version, n.installed_version) AS installed_version,
            coalesce(o.finding_id, n.finding_id) AS finding_id, coalesce(n.last_scan_id, o.last_scan_id) AS last_scan_id, coalesce(o.first_seen, n.first_seen) AS first_seen, coalesce(n.last_seen, o.last_seen) AS last_seen,
            CASE WHEN o.status = 'fixed' AND n.status IS NOT NULL THEN 'open' ELSE coalesce(o.status, n.status) END AS status
        FROM old o FULL JOIN new n ON o.asset_id = n.asset_id AND o.cve_id = n.cve_id AND o.package_name = n.package_name AND o.installed_version = n.installed_version""".lstrip(), "staged"),
    "load_summary": sql("SELECT count(DISTINCT s.cve_id) FILTER (WHERE a.asset_id % 10 > 0) AS cves, count(*) FILTER (WHERE a.asset_id % 10 > 0) AS findings, count(*) FILTER (WHERE a.asset_id % 10 = 0) AS skipped FROM staged s JOIN assets a ON s.asset_id = a.asset_id", "staged"),
    "skipped_ids": sql("SELECT count(*) FILTER (WHERE row_id % 5 > 1) AS kept, count(*) FILTER (WHERE row_id % 5 <= 1) AS skipped FROM staged", "staged"),
    "scan_ledger": sql("SELECT scan_id, min(seen_at) AS started_at, max(seen_at) AS finished_at, count(*) AS findings, count(DISTINCT asset_id) AS assets FROM staged GROUP BY ALL", "staged"),
    "kev_enrich": sql("SELECT cve_id, kev_listed, kev_ransomware, kev_due_date FROM cves", "cves"),
    "kev_summary": sql("SELECT count(*) FILTER (WHERE kev_listed) AS matched, count(*) FILTER (WHERE kev_listed AND kev_ransomware) AS ransomware FROM cves", "cves"),
    "epss_enrich": sql("SELECT cve_id, epss_score, CASE WHEN epss_score IS NOT NULL THEN cast((cve_key % 100) / 100 AS DECIMAL(6,5)) END AS epss_percentile FROM cves", "cves"),
    "epss_summary": sql("SELECT count(epss_score) AS scored, count(*) FILTER (WHERE epss_score >= 0.1) AS at_least_10pct FROM cves", "cves"),
    "cve_record_normalise": sql("""
        SELECT cve_id, description, cvss_v31_score, cvss_v40_score, coalesce(CASE WHEN cvss_v40_score IS NOT NULL THEN cvss_severity END, CASE WHEN cvss_v31_score IS NOT NULL THEN cvss_severity END) AS cvss_severity,
            list_sort(list_distinct(['CWE-' || (cve_key % 9), 'CWE-' || (cve_key % 4)])) AS cwe_ids, ['https://example.com/' || cve_id] AS links,
            '2001-02-' || lpad(cast(1 + cve_key % 28 AS VARCHAR), 2, '0') || ' 03:04:05' AS published, CASE WHEN cve_key % 2 = 0 THEN '2002-03-04 05:06:07' END AS last_modified,
            CASE WHEN cvss_v31_score IS NOT NULL THEN 'v' END AS cvss_v31_vector, CASE WHEN cvss_v40_score IS NOT NULL THEN 'v' END AS cvss_v40_vector FROM cves""", "cves"),
    "record_merge": sql("SELECT cve_id, CASE WHEN cve_key % 3 = 0 THEN description || ' (revised)' ELSE description END AS description, cvss_v31_score, CASE WHEN cve_key % 3 = 0 THEN ['CWE-' || (cve_key % 9)] ELSE ['CWE-1'] END AS cwe_ids, CASE WHEN cve_key % 3 = 0 THEN DATE '2000-01-01' END AS enriched_at FROM cves", "cves"),
    "pending_enrichment": sql("SELECT cve_id FROM cves WHERE cve_key % 3 <> 0", "cves"),
    "cvss_preference": sql("SELECT cve_id, cast(CASE cve_key % 4 WHEN 0 THEN cve_key % 10 WHEN 1 THEN cve_key % 9 WHEN 2 THEN cve_key % 8 ELSE cve_key % 7 END AS DOUBLE) AS score, CASE cve_key % 4 WHEN 0 THEN 'nvd' WHEN 1 THEN 'ghsa' WHEN 2 THEN 'redhat' ELSE 'amazon' END AS vector FROM cves", "cves"),
    "report_flatten": sql("SELECT 'host-' || (row_id % 5) AS hostname, cve_id, package_name, installed_version, fixed_raw, CASE row_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' ELSE 'UNKNOWN' END AS severity, 'About ' || cve_id AS description, CASE WHEN row_id % 2 = 0 THEN 'https://example.com/' || cve_id END AS link, seen_at AS published, NULL::VARCHAR AS last_modified, count(*) AS n FROM staged GROUP BY ALL", "staged"),
    "store_reconcile": "SELECT count(*) FILTER (WHERE doc_id % 10 <> 1) AS source_rows, count(*) FILTER (WHERE doc_id % 10 <> 2) AS target_rows, count(*) FILTER (WHERE doc_id % 10 = 2) AS missing, count(*) FILTER (WHERE doc_id % 10 = 1) AS surplus, count(*) FILTER (WHERE doc_id % 10 = 3) AS changed, count(*) = 0 AS in_sync FROM documents",
    "reconcile_drift": "SELECT count(*) AS source_rows, count(*) FILTER (WHERE k % 3001 <> 5) AS target_rows, count(*) FILTER (WHERE k % 3001 = 5) AS missing, 0::BIGINT AS surplus, count(*) FILTER (WHERE k % 3001 <> 5 AND k % 3011 = 7) AS changed, false AS in_sync, true AS compared FROM (SELECT o_orderkey AS k FROM orders)",
    "version_order": sql(f", x AS (SELECT DISTINCT fixed_version AS version FROM findings WHERE fixed_version IS NOT NULL) SELECT version, rank() OVER (ORDER BY {key('version')}) AS version_rank FROM x", "findings"),
    "version_compare": sql(f"SELECT installed_version, fixed_version, CASE WHEN a > b THEN 1 WHEN a < b THEN -1 WHEN a = b THEN 0 END AS \"order\" FROM (SELECT installed_version, fixed_version, {key('installed_version')} AS a, CASE WHEN fixed_version IS NOT NULL THEN {key('fixed_version')} END AS b FROM (SELECT DISTINCT installed_version, fixed_version FROM findings))", "findings"),
    "fix_selection": sql("SELECT fixed_raw, installed_version, fixed_version FROM chosen", "chosen"),
    "risk_components": sql("SELECT finding_id, cvss_base, cvss_source, severity_points, exploit_points, exploit_reason, exposure_points, exposure_reason, criticality_points, data_points, asset_points FROM v", "v"),
    "risk_scored": sql("SELECT finding_id, risk_score, scored_band, risk_band, floor_rule FROM v", "v"),
    "sla": sql("SELECT finding_id, sla_days, due_date, sla_rule, kev_deadline_passed FROM v", "v"),
    "current_risk": sql("SELECT finding_id, asset_id, cve_id, risk_score, risk_band, due_date, overdue, cast(days_remaining AS INTEGER) AS days_remaining FROM v", "v"),
    "factors": sql("""
        SELECT finding_id, risk_score, cast(risk_score AS DECIMAL(7,2)) AS total, floor_rule, sla_rule, component, points, reason FROM (
            SELECT finding_id, risk_score, floor_rule, sla_rule, unnest(['severity', 'exploit', 'exposure', 'asset']) AS component, unnest([severity_points, exploit_points, exposure_points, asset_points]) AS points, unnest([cvss_source, exploit_reason, exposure_reason, data_classification]) AS reason FROM v)""", "v"),
    "factors_json": sql("SELECT finding_id, '2026.09.1' AS policy_version, severity_points AS severity, exploit_reason AS exploit, environment, data_classification AS data, floor_rule AS floor, CASE WHEN floor_rule IS NOT NULL THEN scored_band END AS scored_band FROM v", "v"),
    "factors_reshaped": sql("""
        SELECT finding_id, severity_points AS severity, NULL::VARCHAR AS max, floor_rule AS floor, CASE WHEN floor_rule IS NOT NULL THEN scored_band END AS scored_band, NULL::VARCHAR AS old_floor, CASE WHEN finding_id % 3 > 0 THEN sla_rule END AS sla,
            CASE WHEN finding_id % 3 > 0 AND kev_deadline_passed THEN 'true' END AS passed, CASE WHEN finding_id % 3 > 0 THEN cast(kev_due_date AS VARCHAR) END AS due FROM v""", "v"),
    "score_changes": sql("SELECT count(*) AS evaluated, count(*) FILTER (WHERE finding_id % 3 = 0) AS inserted, count(*) FILTER (WHERE finding_id % 3 <> 0) AS unchanged FROM v", "v"),
    "history_after_run": sql("""
        SELECT finding_id, '2026.09.1' AS policy_version, risk_band, due_date, cast(CASE WHEN finding_id % 3 = 0 THEN risk_score + 1 ELSE risk_score END AS DECIMAL(5,2)) AS risk_score, finding_id % 3 <> 0 AS is_current FROM v
        UNION ALL SELECT finding_id, '2026.09.1', risk_band, due_date, risk_score, true FROM v WHERE finding_id % 3 = 0""", "v"),
    "current_backfill": sql("SELECT finding_id, last_scan_id AS scan_id FROM (SELECT asset_id, cve_id, package_name, installed_version, min(finding_id) AS finding_id, max(scan_id) AS last_scan_id FROM staged GROUP BY ALL)", "staged"),
    "latest_assessment": sql("SELECT finding_id, last_scan_id AS scan_id FROM (SELECT asset_id, cve_id, package_name, installed_version, min(finding_id) AS finding_id, max(scan_id) AS last_scan_id FROM staged GROUP BY ALL)", "staged"),
    "history_prune": sql("SELECT is_current, count(*) AS rows, count(*) FILTER (WHERE NOT is_current AND computed_at < DATE '1997-01-01') AS pruned, count(*) FILTER (WHERE is_current OR computed_at >= DATE '1997-01-01') AS explained FROM (SELECT row_id % 4 = 0 AS is_current, seen_at AS computed_at FROM staged) GROUP BY ALL", "staged"),
    "fix_actions": sql(f"SELECT {_WIDE}, coalesce(n.requirements, '') AS requirements FROM actions a LEFT JOIN (SELECT owner_team AS t, owner_email AS e, package_name AS p, os_family AS o, risk_band AS b, has_fix AS h, string_agg(cve_id || '=' || required_version, ',' ORDER BY cve_id) AS requirements FROM asked GROUP BY ALL) n ON a.owner_team = t AND a.owner_email = e AND a.package_name = p AND a.os_family = o AND a.risk_band = b AND a.has_fix = h", "actions"),
    "fix_actions_filtered": sql("""
        SELECT idempotency_key, title, risk_band, due_date, fixed_version, asset_count, cast(finding_count AS BIGINT) AS finding_count FROM actions WHERE risk_band IN ('critical', 'medium') AND owner_team = 'asia'
        ORDER BY CASE risk_band WHEN 'critical' THEN 1 ELSE 3 END, due_date, max_risk_score DESC, idempotency_key LIMIT 40""", "actions"),
    "package_targets": sql("SELECT * FROM targets", "targets"),
    "version_requirements": sql("SELECT * FROM asked", "asked"),
    "action_summary": sql("SELECT count(*) AS actions, cast(sum(finding_count) AS BIGINT) AS findings, round(sum(finding_count) / count(*), 1) AS reduction, count(*) FILTER (WHERE risk_band = 'critical') AS critical, count(*) FILTER (WHERE risk_band = 'high') AS high, count(*) FILTER (WHERE risk_band = 'medium') AS medium, count(*) FILTER (WHERE risk_band = 'low') AS low, count(*) FILTER (WHERE NOT has_fix) AS without_fix, count(*) FILTER (WHERE internet_facing_count > 0) AS touching_internet FROM actions", "actions"),
    "reduction_ladder": sql("""
        SELECT 'finding' AS key, count(*) AS tickets FROM v
        UNION ALL SELECT 'host_package_fix', count(DISTINCT (hostname, package_name, coalesce(fixed_version, ''))) FROM v
        UNION ALL SELECT 'team_package_fix_band', count(DISTINCT (owner_team, package_name, coalesce(fixed_version, ''), risk_band)) FROM v
        UNION ALL SELECT 'team_package_band_hasfix', count(DISTINCT (owner_team, package_name, risk_band, fixed_version IS NOT NULL)) FROM v
        UNION ALL SELECT 'with_os', count(DISTINCT (owner_team, package_name, os_family, risk_band, fixed_version IS NOT NULL)) FROM v""", "v"),
    "mixed_bands": sql("SELECT count(*) AS groups, count(*) FILTER (WHERE bands > 1) AS mixed, max(spread) AS max_spread_days FROM (SELECT count(DISTINCT risk_band) AS bands, max(due_date) - min(due_date) AS spread FROM v GROUP BY owner_team, package_name, fixed_version)", "v"),
    "target_violations": sql("""
        , planted AS (SELECT *, ('0x' || substr(idempotency_key, 1, 6))::BIGINT AS n FROM actions WHERE has_fix)
        SELECT CASE n % 4 WHEN 2 THEN 'one-key' ELSE idempotency_key END AS idempotency_key, owner_team, owner_email, package_name, os_family, risk_band, has_fix, CASE n % 4 WHEN 0 THEN 'below_requirement' WHEN 1 THEN 'foreign_system' ELSE 'shared_key' END AS violation
        FROM planted WHERE n % 4 IN (0, 1) OR (n % 4 = 2 AND (SELECT count(*) FROM planted WHERE n % 4 = 2) > 1)""".lstrip(), "actions"),
    "table_counts": _chunked(" UNION ALL ".join(f"SELECT '{n}' AS name, (SELECT {c}) AS rows" for n, c in _COUNTS.items())),
    "stats_row": _chunked("SELECT " + ", ".join(f"(SELECT {c}) AS {n}" for n, c in _COUNTS.items())),
    "band_distribution": sql("SELECT risk_band, count(*) AS findings, count(*) FILTER (WHERE overdue) AS overdue, count(DISTINCT asset_id) AS assets, count(*) FILTER (WHERE kev_listed) AS kev FROM v GROUP BY ALL", "v"),
    "due_backlog": sql("SELECT strftime(date_trunc('week', due_date), '%Y-%m-%d') AS week, count(*) AS findings, count(*) FILTER (WHERE risk_band IN ('critical', 'high')) AS urgent FROM v WHERE due_date < DATE '2000-01-01' + 84 GROUP BY ALL", "v"),
    "asset_list": sql("SELECT a.*, count(v.finding_id) AS open_findings, max(v.risk_score) AS worst_risk_score FROM assets a LEFT JOIN v ON v.asset_id = a.asset_id GROUP BY ALL", "v"),
    "asset_page": sql("SELECT a.*, count(v.finding_id) AS open_findings, max(v.risk_score) AS worst_risk_score FROM assets a LEFT JOIN v ON v.asset_id = a.asset_id WHERE a.environment = 'prod' AND a.internet_facing GROUP BY ALL ORDER BY worst_risk_score DESC NULLS LAST, a.hostname LIMIT 50 OFFSET 50", "v"),
    "asset_detail": sql("SELECT a.*, count(v.finding_id) AS open_findings, max(v.risk_score) AS worst_risk_score FROM assets a LEFT JOIN v ON v.asset_id = a.asset_id WHERE a.asset_id = 7 GROUP BY ALL", "v"),
    "findings_risk": sql(f"SELECT {_SHOWN} FROM v ORDER BY risk_score DESC, epss_score DESC NULLS LAST, finding_id LIMIT 50", "v"),
    "findings_due": sql(f"SELECT {_SHOWN} FROM v WHERE risk_band = 'high' AND overdue ORDER BY due_date, risk_score DESC, finding_id LIMIT 100 OFFSET 20", "v"),
    "findings_epss": sql(f"SELECT {_SHOWN} FROM v WHERE kev_listed AND environment = 'prod' ORDER BY epss_score DESC NULLS LAST, risk_score DESC, finding_id LIMIT 50", "v"),
    "findings_filtered": sql(f"SELECT {_SHOWN} FROM v WHERE owner_team = 'asia' AND internet_facing AND risk_band = 'critical'", "v"),
    "triage_queue": sql(f"SELECT {_SHOWN} FROM v WHERE risk_band = 'critical' ORDER BY risk_score DESC, epss_score DESC NULLS LAST, finding_id LIMIT 20", "v"),
    "cve_lookup": sql("SELECT c.*, coalesce(n, 0) AS affected_assets, p AS affected_packages FROM cves c LEFT JOIN (SELECT cve_id AS i, count(DISTINCT asset_id) AS n, list_sort(list(DISTINCT package_name)) AS p FROM findings WHERE status = 'open' GROUP BY ALL) ON c.cve_id = i WHERE c.cve_id IN ('CVE-2013-10003', 'CVE-2018-10023', 'CVE-2011-10001')", "findings"),
    "cve_impact": sql("SELECT cve_id, count(DISTINCT asset_id) AS affected_assets, list_sort(list(DISTINCT package_name)) AS affected_packages FROM findings WHERE status = 'open' GROUP BY ALL", "findings"),
    "team_workload": sql("SELECT owner_team, owner_email, count(*) AS open_findings, count(DISTINCT asset_id) AS assets, count(*) FILTER (WHERE risk_band = 'critical') AS critical, count(*) FILTER (WHERE risk_band = 'high') AS high, count(*) FILTER (WHERE overdue) AS overdue, min(due_date) AS next_due, round(max(risk_score), 1) AS worst_risk_score FROM v GROUP BY ALL", "v"),
    "overview": sql("SELECT (SELECT count(*) FROM v) AS open_findings, (SELECT count(*) FROM v WHERE overdue) AS overdue, (SELECT count(*) FROM v WHERE risk_band = 'critical') AS critical, (SELECT count(*) FROM v WHERE kev_listed) AS kev, (SELECT count(*) FROM actions) AS actions, round((SELECT count(*) FROM v) / (SELECT count(*) FROM actions), 1) AS reduction", "actions"),
    "id_extraction": sql("SELECT cve_key, list_sort(list_distinct([cve_id, 'CVE-1999-0001'])) AS ids FROM cves", "cves"),
    "command_extraction": sql("SELECT plan_id, CASE WHEN fixed_version IS NULL THEN [] ELSE [CASE os_family WHEN 'debian' THEN 'apt-get install ' || package_name || '=' WHEN 'rhel' THEN 'dnf install ' || package_name || '-' ELSE 'apk add ' || package_name || '=' END || CASE WHEN n % 7 = 0 THEN fixed_version || '9' ELSE fixed_version END] END AS commands FROM plans", "plans"),
    "split_text": "WITH RECURSIVE" + split("documents", "doc_id", "text") + " SELECT doc_id, cast(idx - 1 AS INTEGER) AS chunk_index, content FROM parts",
    "corpus_facts": sql("SELECT c.cve_id, coalesce(n, 0) AS n_fixes, p AS fixes FROM cves c LEFT JOIN (SELECT cve_id, count(*) AS n, list(package_name || ' ' || installed_version || ' ' || coalesce(fixed_version, '-') ORDER BY package_name, installed_version, fixed_version) AS p FROM (SELECT DISTINCT cve_id, package_name, installed_version, fixed_version FROM findings) GROUP BY ALL) f ON c.cve_id = f.cve_id", "findings"),
    "fact_chunks": sql("", "whole").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + "," + split("whole", "cve_id, header, part, package_name", "body") + " SELECT cve_id, cast(row_number() OVER (PARTITION BY cve_id ORDER BY part, package_name, idx) - 1 AS INTEGER) AS chunk_index, header || '. ' || content AS content FROM parts",
    "documents_assembled": _chunked("""
        SELECT p.cve_id, CASE WHEN any_value(c.cve_key) % 3 = 1 THEN upper(any_value(c.description)) ELSE p.cve_id || ' advisory' END AS title, [p.cve_id] AS cve_ids, count(*) AS chunks, md5(string_agg(header || '. ' || content, chr(10) || chr(10) ORDER BY part, package_name, idx)) AS text
        FROM parts p JOIN cves c ON p.cve_id = c.cve_id GROUP BY p.cve_id"""),
    "prefilter_ids": _chunked("SELECT c.cve_key AS query_id, c.cve_id, cast(row_number() OVER (PARTITION BY c.cve_id ORDER BY part, package_name, idx) - 1 AS INTEGER) AS chunk_index FROM parts p JOIN cves c ON p.cve_id = c.cve_id"),
    "corpus_rebuild": "WITH RECURSIVE revised AS (SELECT doc_id, 'Revision 2.' || chr(10) || text AS text FROM documents WHERE text IS NOT NULL)," + split("revised", "doc_id", "text") + " SELECT doc_id, count(*) AS chunks, cast(max(idx) - 1 AS INTEGER) AS last_index FROM parts GROUP BY ALL",
    "postings": "SELECT term, count(*) AS places, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents) GROUP BY ALL",
    "index_terms": "SELECT term, cast(count(*) AS BIGINT) AS docs, cast(sum(n) AS BIGINT) AS places, cast(max(n) AS INTEGER) AS best, min(doc_id) AS first FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents) GROUP BY ALL) GROUP BY term",
    "lexical_topk": _lexical("benchmark", "item_id", "true") + """
        SELECT query_id, doc_id, round(score, 6) AS score, cast(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM s) WHERE r <= 10""",
    "lexical_web": _lexical("benchmark", "item_id", "true") + """,
        n AS (SELECT query_id, doc_id, count(*)::DOUBLE AS score FROM p JOIN q ON term = t1 WHERE NOT EXISTS (SELECT 1 FROM p AS o WHERE o.doc_id = p.doc_id AND o.term = t2) GROUP BY ALL)
        SELECT query_id, doc_id, round(score, 6) AS score, cast(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM n) WHERE r <= 10""",
    "hybrid_topk": _lexical("documents", "doc_id", "doc_id % 50 = 0") + """,
        l AS (SELECT * FROM (SELECT query_id, doc_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS lexical_rank FROM s) WHERE lexical_rank <= 50),
        d AS (SELECT * FROM (SELECT query_id, vec_id AS doc_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS dense_rank FROM (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0)) WHERE dense_rank <= 50),
        f AS (SELECT coalesce(l.query_id, d.query_id) AS query_id, coalesce(l.doc_id, d.doc_id) AS doc_id, round(coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) + coalesce(1.0::DOUBLE / (60 + dense_rank), 0), 6) AS rrf_score, lexical_rank, dense_rank FROM l FULL JOIN d ON l.query_id = d.query_id AND l.doc_id = d.doc_id)
        SELECT query_id, doc_id, rrf_score, lexical_rank, dense_rank, cast(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, lexical_rank NULLS LAST, dense_rank) AS r FROM f) WHERE r <= 8""",
    "dense_topk": "SELECT query_id, vec_id, round(score, 6) AS score, cast(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0)) WHERE r <= 10",
    "dense_topk_filtered": "SELECT query_id, vec_id, round(score, 6) AS score, cast(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0)) WHERE r <= 10",
    "rrf": """
        WITH d AS (SELECT doc_id % 20 AS query_id, doc_id, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY n_chars DESC, doc_id) AS a, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY doc_id % 7, doc_id) AS b FROM documents WHERE n_chars IS NOT NULL),
        s AS (SELECT query_id, doc_id, round(coalesce(CASE WHEN a <= 50 THEN 1.0::DOUBLE / (60 + a) END, 0) + coalesce(CASE WHEN b <= 50 THEN 1.0::DOUBLE / (60 + b) END, 0), 6) AS rrf_score, cast(CASE WHEN a <= 50 THEN a END AS INTEGER) AS lexical_rank, cast(CASE WHEN b <= 50 THEN b END AS INTEGER) AS dense_rank FROM d WHERE a <= 50 OR b <= 50)
        SELECT query_id, doc_id, rrf_score, lexical_rank, dense_rank, cast(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, lexical_rank NULLS LAST, dense_rank) AS r FROM s) WHERE r <= 8""",
    "retrieval_eval": """
        WITH h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM (SELECT q.vec_id AS query_id, q.label AS want, e.vec_id, e.label, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0)) WHERE r <= 8),
        n AS (SELECT q.vec_id AS query_id, count(*) AS n FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL)
        SELECT count(*) AS queries, round(avg(found / least(n, 8)), 4) AS recall_at_k, round(avg(found / greatest(got, 1)), 4) AS precision_at_k FROM (SELECT n.query_id, n, count(h.vec_id) AS got, count(*) FILTER (WHERE want = label) AS found FROM n LEFT JOIN h ON n.query_id = h.query_id GROUP BY ALL)""",
    "query_sample": sql(", c AS (SELECT c.cve_id, description, kev_listed, epss_score, count(*) AS findings FROM cves c JOIN findings f ON c.cve_id = f.cve_id GROUP BY ALL) SELECT cve_id, description, findings FROM (SELECT * FROM c WHERE kev_listed OR epss_score > 0.1 ORDER BY findings DESC, cve_id LIMIT 30) UNION SELECT cve_id, description, findings FROM (SELECT * FROM c WHERE description IS NOT NULL ORDER BY md5(cve_id), cve_id LIMIT 30)", "findings"),
    "grounding_ids": sql("SELECT plan_id, [CASE WHEN n % 11 = 0 THEN 'CVE-1999-0001' ELSE cve_id END] AS checked_cves, CASE WHEN n % 11 = 0 THEN ['CVE-1999-0001'] ELSE [] END AS ungrounded_cves FROM plans", "plans"),
    "grounding": sql("""
        SELECT plan_id, [CASE WHEN n % 11 = 0 THEN 'CVE-1999-0001' ELSE cve_id END] AS checked_cves, CASE WHEN n % 11 = 0 THEN ['CVE-1999-0001'] ELSE [] END AS ungrounded_cves, grounded AS passed,
            CASE WHEN grounded THEN 'grounded' ELSE concat_ws('; ', CASE WHEN n % 11 = 0 THEN 'ids without evidence: CVE-1999-0001' END, CASE WHEN n % 7 = 0 AND fixed_version IS NOT NULL AND os_family <> 'debian' THEN 'versions without evidence: ' || fixed_version || '9' END,
                CASE WHEN n % 17 = 0 THEN 'forbidden commands: rm -rf /' END) END AS reason FROM plans""", "plans"),
    "ungrounded_clusters": sql("SELECT package_name, count(*) AS plans, count(*) FILTER (WHERE NOT grounded) AS failed FROM plans GROUP BY ALL", "plans"),
    "plan_rubric": sql("""
        SELECT plan_id, grounded, fixed_version IS NOT NULL AS names_target, fixed_version IS NOT NULL AS has_commands, fixed_version IS NOT NULL AS commands_match_os, fixed_version IS NOT NULL AS has_rollback, n % 13 <> 0 AS no_placeholders, true AS not_vague,
            round((cast(grounded AS INTEGER) + 4 * cast(fixed_version IS NOT NULL AS INTEGER) + cast(n % 13 <> 0 AS INTEGER) + 1) / 7, 3) AS score, grounded AND fixed_version IS NOT NULL AND n % 13 <> 0 AS actionable,
            list_filter([CASE WHEN NOT grounded THEN 'grounded' END, CASE WHEN fixed_version IS NULL THEN 'names_target' END, CASE WHEN fixed_version IS NULL THEN 'has_commands' END, CASE WHEN fixed_version IS NULL THEN 'commands_match_os' END, CASE WHEN fixed_version IS NULL THEN 'has_rollback' END, CASE WHEN n % 13 = 0 THEN 'no_placeholders' END], lambda x: x IS NOT NULL) AS failures,
            cast(fixed_version IS NOT NULL AS INTEGER) AS commands, []::VARCHAR[] AS wrong_os, CASE WHEN n % 13 = 0 THEN ['/path/to/'] ELSE [] END AS placeholders, []::VARCHAR[] AS vague FROM plans""", "plans"),
    "rubric_rates": sql("SELECT count(*) AS plans, round(avg(round((g + 4 * f + p + 1) / 7, 3)), 3) AS mean_score, round(avg(g * f * p), 3) AS actionable_rate, round(avg(g), 3) AS grounded_rate, round(avg(f), 3) AS names_target_rate, round(avg(f), 3) AS has_commands_rate, round(avg(f), 3) AS commands_match_os_rate, round(avg(f), 3) AS has_rollback_rate, round(avg(p), 3) AS no_placeholders_rate, 1.0 AS not_vague_rate FROM (SELECT cast(grounded AS INTEGER) AS g, cast(fixed_version IS NOT NULL AS INTEGER) AS f, cast(n % 13 <> 0 AS INTEGER) AS p FROM plans)", "plans"),
    "worst_plans": sql("""
        SELECT plan_id, score, failures FROM (
            SELECT plan_id, round((cast(grounded AS INTEGER) + 4 * cast(fixed_version IS NOT NULL AS INTEGER) + cast(n % 13 <> 0 AS INTEGER) + 1) / 7, 3) AS score,
                list_filter([CASE WHEN NOT grounded THEN 'grounded' END, CASE WHEN fixed_version IS NULL THEN 'names_target' END, CASE WHEN fixed_version IS NULL THEN 'has_commands' END, CASE WHEN fixed_version IS NULL THEN 'commands_match_os' END, CASE WHEN fixed_version IS NULL THEN 'has_rollback' END, CASE WHEN n % 13 = 0 THEN 'no_placeholders' END], lambda x: x IS NOT NULL) AS failures
            FROM plans WHERE NOT (grounded AND fixed_version IS NOT NULL AND n % 13 <> 0)) ORDER BY score, plan_id LIMIT 10""", "plans"),
    "plans_with_context": sql("", "whole").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + "," + split("whole", "cve_id, header, part, package_name", "body") + """,
        numbered AS (SELECT cve_id, row_number() OVER (PARTITION BY cve_id ORDER BY part, package_name, idx) - 1 AS i, header || '. ' || content AS content FROM parts),
        two AS (SELECT cve_id, md5(string_agg(content, chr(10) ORDER BY i)) AS context FROM numbered WHERE i <= 1 GROUP BY ALL)
        SELECT plan_id, context FROM plans LEFT JOIN two USING (cve_id)""",
    "action_plan_flags": sql("""
        SELECT idempotency_key, title, owner_team, package_name, os_family, risk_band, fixed_version, due_date, asset_count, finding_count, hostnames[1:20] AS hostnames, p IS NOT NULL AS has_plan, coalesce(g, false) AS plan_grounded
        FROM actions a LEFT JOIN (SELECT package_name AS p, fixed_version AS v, bool_or(grounded) AS g FROM plans GROUP BY ALL) ON a.package_name = p AND a.fixed_version IS NOT DISTINCT FROM v""", "plans"),
    "plan_detail": sql("SELECT plan_id, cve_id, package_name, fixed_version, markdown, grounded, created_at FROM plans WHERE plan_id = (SELECT min(plan_id) FROM plans)", "plans"),
    "draft_markdown": sql("""
        SELECT idempotency_key, title || chr(10) || chr(10) || CASE WHEN has_fix THEN '**Steps**' || chr(10) || '1. Take a snapshot of ' || package_name || chr(10) || '2. Upgrade' || chr(10) || chr(10) || '**Commands**' || chr(10) || '```bash' || chr(10) || 'upgrade ' || package_name || chr(10) || '```' || chr(10) || chr(10)
            ELSE '**Compensating controls**' || chr(10) || 'Isolate the hosts.' || chr(10) || chr(10) END || '**Rollback**' || chr(10) || 'Go back to ' || installed_version || CASE WHEN internet_facing_count > 0 THEN chr(10) || chr(10) || '_Requires a reboot._' ELSE '' END AS markdown FROM actions""", "actions"),
    "plan_list": sql("SELECT plan_id, cve_id, package_name, fixed_version, created_at FROM plans WHERE grounded ORDER BY created_at DESC, plan_id LIMIT 50", "plans"),
    "plan_coverage": sql("SELECT grounded, count(*) AS plans, count(DISTINCT package_name) AS packages FROM plans GROUP BY ALL", "plans"),
    "representative_cve": sql("SELECT idempotency_key, cve_id, CASE WHEN risk_band IN ('critical', 'high') THEN 'strong' ELSE 'bulk' END AS route FROM led", "led"),
    "worklist": sql("SELECT idempotency_key, cve_id, package_name, os_family, fixed_version FROM (SELECT *, row_number() OVER (PARTITION BY cve_id, package_name, os_family, fixed_version ORDER BY max_risk_score DESC, due_date, idempotency_key) AS place FROM led l WHERE NOT EXISTS (SELECT 1 FROM plans p WHERE p.grounded AND p.n % 2 = 0 AND p.cve_id = l.cve_id AND p.package_name = l.package_name AND p.os_family = l.os_family AND p.fixed_version IS NOT DISTINCT FROM l.fixed_version)) WHERE place = 1", "plans"),
    "cache_economics": sql("SELECT cast(sum(k) AS BIGINT) AS actions, count(*) AS plan_keys, round(1 - count(*) / sum(k), 3) AS hit_rate FROM (SELECT count(*) AS k FROM led GROUP BY cve_id, package_name, os_family, fixed_version)", "led"),
    "plan_persist": sql(", u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cve_id, package_name, os_family, fixed_version ORDER BY plan_id) AS place FROM plans) WHERE place = 1) SELECT CASE WHEN n % 5 <> 0 THEN plan_id ELSE 'new-' || plan_id END AS plan_id, cve_id, package_name, os_family, fixed_version, CASE WHEN n % 3 <> 0 THEN true ELSE grounded END AS grounded FROM u WHERE n % 5 <> 0 OR n % 3 <> 0", "plans"),
    "run_outcomes": sql(", r AS (SELECT CASE WHEN NOT grounded THEN 'ungrounded' WHEN n % 5 = 0 THEN 'cached' WHEN n % 19 = 0 THEN 'error' ELSE 'grounded' END AS s FROM plans) SELECT count(*) AS actions, count(*) FILTER (WHERE s = 'grounded') AS grounded, count(*) FILTER (WHERE s = 'cached') AS cached, count(*) FILTER (WHERE s = 'ungrounded') AS ungrounded, count(*) FILTER (WHERE s = 'no_context') AS no_context, count(*) FILTER (WHERE s = 'error') AS error, round(count(*) FILTER (WHERE s = 'grounded') / greatest(count(*) FILTER (WHERE s IN ('grounded', 'ungrounded')), 1), 3) AS grounded_rate FROM r", "plans"),
    "run_failures": sql("SELECT * FROM (SELECT plan_id AS idempotency_key, CASE WHEN NOT grounded THEN 'ungrounded' WHEN n % 5 = 0 THEN 'cached' WHEN n % 19 = 0 THEN 'error' ELSE 'grounded' END AS status FROM plans) WHERE status NOT IN ('grounded', 'cached') ORDER BY idempotency_key LIMIT 15", "plans"),
    "budget_cut": sql(", t AS (SELECT plan_id, max_risk_score, due_date, cast(floor(length(markdown) / 3.7) AS BIGINT) + 1500 AS tokens FROM plans), r AS (SELECT *, cast(sum(tokens) OVER (ORDER BY max_risk_score DESC, due_date, plan_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM t) SELECT plan_id AS idempotency_key, tokens, running, running <= 500000 AS planned FROM r", "plans"),
    "attempt_outcomes": sql(", a AS (SELECT plan_id AS key, n, unnest([1, 2, 3]) AS attempt FROM plans), c AS (SELECT key, attempt, cast(CASE WHEN n % 19 = 0 THEN 0 WHEN n % 4 = 0 THEN 5 ELSE 4 * attempt END AS INTEGER) AS context_size, n % 6 < attempt AS passed FROM a) SELECT *, CASE WHEN context_size = 0 THEN 'no_context' WHEN passed THEN 'done' WHEN attempt >= 3 OR context_size <= coalesce(lag(context_size) OVER (PARTITION BY key ORDER BY attempt), -1) THEN 'give_up' ELSE 'retry' END AS outcome FROM c", "plans"),
    "best_plan": sql("SELECT * FROM best", "best"),
    "ticket_rows": sql("SELECT * FROM tickets", "tickets"),
    "ticket_bodies": sql(r"""
        , asked_list AS (SELECT owner_team AS t, owner_email AS e, package_name AS p, os_family AS o, risk_band AS b, string_agg('| ' || cve_id || ' | ' || required_version || ' |', chr(10) ORDER BY cve_id) AS lines, count(DISTINCT required_version) AS several FROM asked GROUP BY ALL)
        SELECT a.idempotency_key, concat_ws(chr(10) || chr(10), '<!-- action:' || a.idempotency_key || ' -->',
            CASE WHEN has_fix THEN 'Upgrade `' || a.package_name || '` to **' || a.fixed_version || '** on ' || asset_count || ' host(s).' ELSE 'No fix is published for `' || a.package_name || '`; a compensating control is needed.' END,
            'Due **' || a.due_date || '**, band **' || a.risk_band || '**, highest score ' || round(a.max_risk_score, 1),
            CASE WHEN len(kev_cve_ids) > 0 OR max_epss >= 0.1 OR internet_facing_count > 0 OR prod_count > 0 THEN 'Why now:' || chr(10) || concat_ws(chr(10), CASE WHEN len(kev_cve_ids) > 0 THEN '- known to be exploited: ' || array_to_string(kev_cve_ids, ', ') END,
                CASE WHEN max_epss >= 0.1 THEN '- exploit probability up to ' || max_epss END, CASE WHEN internet_facing_count > 0 THEN '- internet-facing hosts: ' || internet_facing_count END, CASE WHEN prod_count > 0 THEN '- production hosts: ' || prod_count END) END,
            'Resolves ' || len(cve_ids) || ' id(s):', CASE WHEN has_fix THEN '| id | fixed in |' || chr(10) || '|---|---|' || chr(10) || lines ELSE array_to_string(list_transform(cve_ids, lambda i: '- ' || i), chr(10)) END,
            CASE WHEN has_fix AND several > 1 THEN 'The target **' || a.fixed_version || '** is the highest of these, so one upgrade serves all.' END,
            CASE WHEN m.grounded THEN 'Plan:' || chr(10) || chr(10) || q.markdown END,
            'Hosts (' || asset_count || '): ' || array_to_string(list_transform(hostnames[1:12], lambda h: '`' || h || '`'), ', '), CASE WHEN asset_count > 12 THEN 'and ' || (asset_count - 12) || ' more' END,
            'Scope: ' || array_to_string(environments, ', ') || '; ' || a.os_family || '; ' || a.owner_team || ' <' || a.owner_email || '>',
            'Covers ' || finding_count || ' findings. The date follows from the policy.') AS body
        FROM actions a LEFT JOIN asked_list ON a.owner_team = t AND a.owner_email = e AND a.package_name = p AND a.os_family = o AND a.risk_band = b AND has_fix
            LEFT JOIN best m ON a.idempotency_key = m.idempotency_key LEFT JOIN plans q ON m.plan_id = q.plan_id""".lstrip(), "tickets"),
    "ticket_preview": sql("SELECT t.idempotency_key, t.title, t.owner_team, t.due_date, t.finding_count, CASE WHEN a.asset_count % 3 = 0 THEN 'update' ELSE 'create' END AS would, t.grounded AS has_grounded_plan FROM tickets t JOIN actions a ON t.idempotency_key = a.idempotency_key", "tickets"),
    "ticket_upsert": sql("SELECT CASE WHEN asset_count % 3 = 0 THEN 'T-' ELSE 'N-' END || substr(idempotency_key, 1, 8) AS ticket_id, idempotency_key, title, owner_team, owner_email, risk_band, due_date, 'open' AS state FROM actions", "actions"),
    "ticket_counts": sql("SELECT count(*) FILTER (WHERE asset_count % 3 <> 0) AS created, count(*) FILTER (WHERE asset_count % 3 = 0) AS updated FROM actions", "actions"),
    "ticket_links": sql("SELECT idempotency_key, finding_id FROM covered WHERE finding_id % 2 = 0 UNION ALL SELECT idempotency_key, finding_id FROM covered c WHERE finding_id % 2 <> 0 AND EXISTS (SELECT 1 FROM actions a WHERE a.idempotency_key = c.idempotency_key AND a.risk_band <> 'low')", "covered"),
    "closable_tickets": sql(_COVERING + "SELECT k AS idempotency_key, 'Upgrade ' || k AS title, total FROM covering WHERE filed AND still = 0", "findings"),
    "close_tickets": sql(_COVERING + "SELECT k AS idempotency_key, CASE WHEN NOT filed THEN 'dropped' WHEN still = 0 THEN 'closed' ELSE 'open' END AS state FROM covering", "findings"),
    "tracker_payload": sql("SELECT idempotency_key, substr(title, 1, 255) AS summary, CASE risk_band WHEN 'critical' THEN 'Highest' WHEN 'high' THEN 'High' WHEN 'medium' THEN 'Medium' ELSE 'Low' END AS priority, cast(due_date AS VARCHAR) AS duedate, 'scanner' AS label, title, 'scanner' AS other_label FROM tickets", "tickets"),
    "stream_findings": sql("""
        , s AS (SELECT asset_id, cve_id, package_name, installed_version, scan_id, min(first_seen) AS first_seen, CASE WHEN bool_or(status = 'open') THEN 'open' WHEN bool_or(status = 'accepted_risk') THEN 'accepted_risk' ELSE 'fixed' END AS status FROM staged GROUP BY ALL)
        SELECT asset_id, cve_id, package_name, installed_version, arg_min(first_seen, scan_id) AS first_seen, max(scan_id) AS last_scan_id, CASE WHEN count(*) > 1 AND arg_min(status, scan_id) = 'fixed' THEN 'open' ELSE arg_min(status, scan_id) END AS status FROM s GROUP BY ALL""".lstrip(), "staged"),
    "changed_facts": sql("SELECT 'cve' AS kind, cve_id AS key FROM cves WHERE (cve_key % 17 = 0 AND epss_score IS DISTINCT FROM 0.75) OR (cve_key % 101 = 7 AND NOT kev_listed) UNION ALL SELECT 'asset', cast(asset_id AS VARCHAR) FROM assets WHERE asset_id % 13 = 0 AND environment <> 'prod'", "facts"),
    "changed_scores": _later("SELECT finding_id, risk_score, risk_band, due_date FROM v WHERE cve_id IN (SELECT cve_id FROM cves0 WHERE (cve_key % 17 = 0 AND epss_score IS DISTINCT FROM 0.75) OR (cve_key % 101 = 7 AND NOT kev_listed)) OR asset_id IN (SELECT asset_id FROM assets0 WHERE asset_id % 13 = 0 AND environment <> 'prod')"),
    "incremental_score": sql("SELECT finding_id, risk_score, risk_band, due_date FROM v WHERE last_seen > DATE '1998-01-01'", "v"),
    "quota_stream": "SELECT strftime(make_timestamp(cast(start * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS start, user_id AS key, count(*) AS calls, round(sum(value), 4) AS used FROM (SELECT (floor(epoch(ts) / 43200) - unnest([0, 1])) * 43200 AS start, user_id, value FROM events) GROUP BY ALL",
    "quota_audit": "SELECT event_id, count(*) OVER w AS calls, round(sum(value) OVER w, 4) AS used, count(*) OVER w > 3 OR sum(value) OVER w > 150 AS breach FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW)",
}
ORACLES["stream_repeats"] = ORACLES["stream_findings"]  # repeats change nothing
ORACLES["quota_trailing"] = ORACLES["quota_audit"]  # as a stream
ORACLES["widening_retries"] = _chunked("""
    , c AS (SELECT cve_id, package_name, part, idx, row_number() OVER (PARTITION BY cve_id ORDER BY part, package_name, idx) - 1 AS at FROM parts),
    a AS (
        SELECT plan_id AS key, n, count(c.at) AS chunks, min(c.at) FILTER (WHERE c.part = 2 AND c.package_name = p.package_name AND c.idx = 1) AS remedy
        FROM plans p LEFT JOIN c ON c.cve_id = p.cve_id AND n % 19 <> 0 GROUP BY plan_id, n, p.package_name),
    t AS (SELECT key, n, attempt, cast(2 ** (attempt - 1) AS INTEGER) AS k, cast(least(chunks, 2 ** (attempt - 1)) AS INTEGER) AS context_size, least(chunks, 2 ** (attempt - 2)) AS before, coalesce(remedy < 2 ** (attempt - 1) AND n % 5 <> 0, false) AS passed FROM a, (SELECT unnest(range(1, 7)) AS attempt)),
    o AS (SELECT *, CASE WHEN context_size = 0 THEN 'no_context' WHEN passed THEN 'done' WHEN attempt >= 6 OR (attempt > 1 AND context_size <= before) THEN 'give_up' ELSE 'retry' END AS outcome FROM t)
    SELECT key, cast(attempt AS INTEGER) AS attempt, k, context_size, passed, outcome FROM o
    WHERE attempt <= (SELECT min(attempt) FROM o AS e WHERE e.key = o.key AND e.outcome <> 'retry')""")
ORACLES["embed_terms"] = """
    WITH w AS (SELECT doc_id, md5(unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS word FROM documents WHERE doc_id IS NOT NULL),
    d AS (SELECT word, count(DISTINCT doc_id) AS d FROM w GROUP BY word),
    lowest AS (SELECT greatest(1, ceil(sum(d) / 100000)) AS least, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL) AS n FROM d),
    weights AS (SELECT word, greatest(0, ln((n + 1) / (greatest(d, least) + 1))) AS weight FROM d, lowest),
    bits AS (SELECT word, weight, unnest(list_transform(range(8), lambda i: ('0x' || substr(word, 4 * i::INTEGER + 1, 4))::INTEGER)) AS v FROM weights),
    sums AS (SELECT doc_id, v % 384 AS place, sum(CASE WHEN (v // 384) % 2 = 0 THEN weight ELSE -weight END) AS x FROM w JOIN bits USING (word) GROUP BY ALL),
    norms AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM sums GROUP BY doc_id),
    every AS (SELECT doc_id, unnest(range(384)) AS place FROM documents WHERE doc_id IS NOT NULL)
    SELECT doc_id, list(CASE WHEN norm > 1e-9 THEN cast(round(coalesce(x, 0) / norm * 1000) AS INTEGER) ELSE 0 END ORDER BY place) AS thousandths
    FROM every LEFT JOIN sums USING (doc_id, place) LEFT JOIN norms USING (doc_id) GROUP BY doc_id"""
