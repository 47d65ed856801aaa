"""Plans against their evidence: grounding, a rubric, and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X

# The tools of each system, tools of any, and wording that makes a plan useless.
TOOLS = {"debian": ["apt-get", "apt ", "dpkg", "apt-cache"], "rhel": ["yum", "dnf", "rpm", "microdnf"], "alpine": ["apk"]}
ECOSYSTEM = ["mvn", "gradle", "pip", "pip3", "npm", "yarn", "poetry"]
_WORDS = r"your|previous|prev|old|current|insert|todo|placeholder|example|service[-_ ]?name|unit[-_ ]?name|host|hostname|path|app[-_ ]?name"
PLACEHOLDER = rf"(?i)(/path/to/|<(?=[^>\n]{{0,40}}(?:{_WORDS}))[^>\n]{{3,40}}>|\byour[-_ ](?:app|service|host|server|application)\b|\bexample\.com\b|\bTODO\b|\bxxx+\b|\[insert)"
VAGUE = r"(?i)\b(apply (?:the )?(?:vendor|security|latest) (?:updates?|patches?)|update (?:the )?(?:package|software) as needed|follow vendor instructions|consult (?:the )?(?:vendor|documentation)|upgrade to (?:the )?(?:latest|newest|fixed) version)\b"
CHECKS = ["grounded", "names_target", "has_commands", "commands_match_os", "has_rollback", "no_placeholders", "not_vague"]


def check_grounding(plans: DataFrame) -> DataFrame:
    """plans (markdown, context array, required array) with report columns: ids and versions that the context lacks, forbidden commands, required versions not named, passed, reason.

    A null text is empty, a null context (also one of no chunks) holds nothing, so that any id or version in the text lacks
    evidence; null required versions, and nulls among them or the chunks, ask for nothing.
    """
    said = X.one_space(F.coalesce("markdown", F.lit("")))
    none = F.array().cast("array<string>")
    context = X.one_space(F.array_join(F.coalesce("context", none), " "))
    rows = plans.withColumns({"_said": said, "_context": context, "_required": F.array_compact(F.coalesce("required", none))})
    rows = rows.withColumns({"checked_cves": X.cve_ids(F.col("_said")), "checked_versions": X.versions(F.col("_said")), "forbidden": X.forbidden(F.col("_said"))})
    rows = rows.withColumns({
        "ungrounded_cves": F.filter("checked_cves", lambda c: ~F.contains(F.upper("_context"), c)), "ungrounded_versions": F.filter("checked_versions", lambda v: ~F.contains(F.col("_context"), v)),
        "missing_required": F.filter("_required", lambda v: (v != "") & ~F.contains(F.col("_said"), v)), "context_chars": F.length("_context"),
    })
    empty = [F.size(c) == 0 for c in ("ungrounded_cves", "ungrounded_versions", "forbidden", "missing_required")]
    rows = rows.withColumn("passed", empty[0] & empty[1] & empty[2] & empty[3])
    told = lambda words, c: F.when(F.size(c) > 0, F.concat(F.lit(words), F.array_join(c, ", ")))
    reason = F.concat_ws("; ", told("ids without evidence: ", "ungrounded_cves"), told("versions without evidence: ", "ungrounded_versions"), told("forbidden commands: ", "forbidden"), told("target not named: ", "missing_required"))
    return rows.withColumn("reason", F.when(F.col("passed"), "grounded").otherwise(reason)).drop("_said", "_context", "_required")


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _first(text: str, pattern: str, n: int = 4) -> Column:
    """The first `n` different matches of a pattern's group, sorted."""
    return F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))), 1, n)


def rubric(plans: DataFrame) -> DataFrame:
    """plans (markdown, grounded, target_version, os_family) with the seven checks, score, actionable, failures, and detail: commands, other systems' tools, the first placeholders and vague phrases."""
    rows = plans.withColumn("commands", X.commands(F.col("markdown"))).withColumn("_joined", F.array_join("commands", " "))
    joined = F.col("_joined")
    padded = F.concat(F.lit(" "), joined, F.lit(" "))
    eco = F.lit(False)
    for c in ECOSYSTEM:
        eco = eco | F.startswith(joined, F.lit(c)) | F.contains(padded, F.lit(f" {c} "))
    own, wrong = F.lit(False), F.lit(False)
    for system, tools in TOOLS.items():
        own = own | ((F.col("os_family") == system) & _any(joined, tools))
        wrong = wrong | ((F.col("os_family") != system) & _any(joined, tools))
    rows = rows.withColumns({
        "names_target": F.coalesce((F.col("target_version") != "") & F.contains("markdown", "target_version"), F.lit(False)), "has_commands": F.size("commands") > 0, "commands_match_os": (own | eco) & ~wrong,
        "has_rollback": F.contains(F.lower("markdown"), F.lit("rollback")), "no_placeholders": ~F.col("markdown").rlike(PLACEHOLDER), "not_vague": ~F.col("markdown").rlike(VAGUE),
    })
    rows = rows.withColumn("detail", F.struct(
        F.size("commands").alias("command_count"),
        F.array_compact(F.array(*(F.when((F.col("os_family") != s) & _any(joined, t), F.lit(s)) for s, t in TOOLS.items()))).alias("wrong_os_tooling"),
        _first("markdown", PLACEHOLDER).alias("placeholders"), _first("markdown", VAGUE).alias("vague_phrases"),
    )).drop("_joined")
    score = sum((F.col(c).cast("int") for c in CHECKS), F.lit(0)) / len(CHECKS)
    good = F.lit(True)
    for c in CHECKS:
        good = good if c == "has_rollback" else good & F.col(c)
    failed = F.array_compact(F.array(*(F.when(~F.col(c), F.lit(c)) for c in CHECKS)))
    return rows.withColumns({"score": F.round(score, 3), "actionable": good, "failures": failed})


def rates(scored: DataFrame) -> DataFrame:
    """One row: plans, mean score, share of actionable ones, and of each check."""
    share = lambda c, n: F.round(F.avg(F.col(c).cast("int")), 3).alias(n)
    return scored.agg(F.count("*").alias("plans"), F.round(F.avg("score"), 3).alias("mean_score"), share("actionable", "actionable_rate"), *(share(c, f"{c}_rate") for c in CHECKS))


def worst(scored: DataFrame, key: str, n: int = 10) -> DataFrame:
    return scored.where("NOT actionable").orderBy("score", key).limit(n)


def with_context(plans: DataFrame, chunks: DataFrame) -> DataFrame:
    """plans (plan_id, chunk_ids) with the texts of their chunks in the order of chunk_id."""
    rows = plans.select("plan_id", F.explode("chunk_ids").alias("chunk_id")).join(chunks, "chunk_id")
    texts = rows.groupBy("plan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "content"))), lambda c: c["content"]).alias("context"))
    return plans.join(texts, "plan_id", "left")


def ungrounded_clusters(checked: DataFrame) -> DataFrame:
    """Plans and failures of each package: many failures show a gap in the corpus."""
    return checked.groupBy("package_name").agg(F.count("*").alias("plans"), F.count_if(~F.col("passed")).alias("failed"))
