"""Tickets for fix actions: bodies, previews, upserts, links to findings, closing, and tracker payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .merge import merge, top_k

SHOWN_HOSTS = 12
# Fixed values of the trackers.
SEVERITY_LABEL = {"critical": "sev:critical", "high": "sev:high", "medium": "sev:medium", "low": "sev:low"}
PRIORITY = {"critical": "Highest", "high": "High", "medium": "Medium", "low": "Low"}


def _map(column: str, values: dict[str, str], other: str) -> Column:
    out = F
    for k, v in values.items():
        out = out.when(F.col(column) == k, v)
    return out.otherwise(other)


def best_plan(actions: DataFrame, plans: DataFrame) -> DataFrame:
    """(idempotency_key, plan_id, grounded, markdown): of plans for the action's package and version (null-safe) and one of its ids, a grounded one first, then the newest."""
    p = plans.select(F.col("plan_id"), F.col("package_name").alias("_p"), F.col("fixed_version").alias("_v"), F.col("cve_id").alias("_c"), "grounded", "created_at", "markdown")
    hit = actions.select("idempotency_key", "package_name", "fixed_version", "cve_ids").join(p, (F.col("package_name") == F.col("_p")) & F.col("fixed_version").eqNullSafe(F.col("_v")) & F.array_contains("cve_ids", F.col("_c")))
    return top_k(hit, ["idempotency_key"], [F.desc("grounded"), F.desc("created_at"), F.col("plan_id")], 1).select("idempotency_key", "plan_id", "grounded", "markdown")


def marker(key: Column) -> Column:
    return F.concat(F.lit("<!-- action:"), key, F.lit(" -->"))


def body(rows: DataFrame) -> Column:
    """The ticket's text, of an action with its plan's markdown and grounded (null without)."""
    c = F.col
    s = lambda x: (F.col(x) if isinstance(x, str) else x).cast("string")
    action = F.when(c("has_fix"), F.concat(F.lit("Upgrade `"), c("package_name"), F.lit("` to **"), c("fixed_version"), F.lit("** on "), s("asset_count"), F.lit(" host(s)."))).otherwise(F.concat(F.lit("No fix is published for `"), c("package_name"), F.lit("`; a compensating control is needed.")))
    why = F.array_compact(F.array(
        F.when(F.size("kev_cve_ids") > 0, F.concat(F.lit("- known to be exploited: "), F.array_join("kev_cve_ids", ", "))), F.when(c("max_epss") >= 0.1, F.concat(F.lit("- exploit probability up to "), s("max_epss"))),
        F.when(c("internet_facing_count") > 0, F.concat(F.lit("- internet-facing hosts: "), s("internet_facing_count"))), F.when(c("prod_count") > 0, F.concat(F.lit("- production hosts: "), s("prod_count"))),
    ))
    asked = F.transform(F.map_entries("version_requirements"), lambda e: F.concat(F.lit("| "), e["key"], F.lit(" | "), e["value"], F.lit(" |")))
    table = F.when(F.size(F.coalesce("version_requirements", F.create_map().cast("map<string,string>"))) > 0, F.concat(F.lit("| id | fixed in |\n|---|---|\n"), F.array_join(asked, "\n"))).otherwise(F.array_join(F.transform("cve_ids", lambda i: F.concat(F.lit("- "), i)), "\n"))
    several = F.size(F.array_distinct(F.map_values("version_requirements"))) > 1
    hosts = F.array_join(F.transform(F.slice("hostnames", 1, SHOWN_HOSTS), lambda h: F.concat(F.lit("`"), h, F.lit("`"))), ", ")
    return F.concat_ws(
        "\n\n", marker(c("idempotency_key")), action, F.concat(F.lit("Due **"), s("due_date"), F.lit("**, band **"), c("risk_band"), F.lit("**, highest score "), s(F.round("max_risk_score", 1))),
        F.when(F.size(why) > 0, F.concat(F.lit("Why now:\n"), F.array_join(why, "\n"))), F.concat(F.lit("Resolves "), s(F.size("cve_ids")), F.lit(" id(s):")), table,
        F.when(several, F.concat(F.lit("The target **"), c("fixed_version"), F.lit("** is the highest of these, so one upgrade serves all."))), F.when(c("grounded"), F.concat(F.lit("Plan:\n\n"), c("markdown"))),
        F.concat(F.lit("Hosts ("), s("asset_count"), F.lit("): "), hosts), F.when(c("asset_count") > SHOWN_HOSTS, F.concat(F.lit("and "), s(c("asset_count") - SHOWN_HOSTS), F.lit(" more"))),
        F.concat(F.lit("Scope: "), F.array_join("environments", ", "), F.lit("; "), c("os_family"), F.lit("; "), c("owner_team"), F.lit(" <"), c("owner_email"), F.lit(">")),
        F.concat(F.lit("Covers "), s("finding_count"), F.lit(" findings. The date follows from the policy.")),
    )


def ticket_rows(actions: DataFrame, plans: DataFrame) -> DataFrame:
    """A ticket for each action, its best plan attached only if it is grounded."""
    best = best_plan(actions, plans)
    # Of a wide row's hosts no more are moved than a body shows.
    rows = actions.withColumn("hostnames", F.slice("hostnames", 1, SHOWN_HOSTS)).join(best, "idempotency_key", "left").withColumn("grounded", F.coalesce("grounded", F.lit(False)))
    labels = F.array_compact(F.array(F.lit("scanner"), _map("risk_band", SEVERITY_LABEL, "sev:unknown"), F.when(F.size("kev_cve_ids") > 0, "kev"), F.when(~F.col("has_fix"), "no-fix-available"), F.when(F.col("internet_facing_count") > 0, "internet-facing"), F.concat(F.lit("team:"), "owner_team")))
    return rows.select("idempotency_key", "title", body(rows).alias("body"), "owner_team", "owner_email", "risk_band", "due_date", labels.alias("labels"), "plan_id", "grounded", "finding_count")


def preview(tickets: DataFrame, filed: DataFrame) -> DataFrame:
    """What a dispatch would do with each ticket."""
    old = filed.select("idempotency_key", F.lit(True).alias("_old"))
    return tickets.join(old, "idempotency_key", "left").select("idempotency_key", "title", "owner_team", "due_date", "finding_count", F.when(F.col("_old"), "update").otherwise("create").alias("would"), F.col("grounded").alias("has_grounded_plan"))


def upsert(filed: DataFrame, tickets: DataFrame) -> DataFrame:
    """The ticket table after a dispatch: known keys keep ticket_id and owner, content is replaced."""
    rules = {c: "replace" for c in filed.columns if c not in ("ticket_id", "idempotency_key", "owner_team", "owner_email", "risk_band")}
    return merge(filed, tickets, ["idempotency_key"], rules)


def upsert_counts(filed: DataFrame, tickets: DataFrame) -> DataFrame:
    """One row: tickets that a dispatch creates, and those that it updates; null keys are equal to each other."""
    old = filed.select(F.col("idempotency_key").alias("_k"), F.lit(True).alias("_old")).distinct()
    both = tickets.select("idempotency_key").distinct().join(old, F.col("idempotency_key").eqNullSafe(F.col("_k")), "left")
    return both.agg(F.count_if(F.col("_old").isNull()).alias("created"), F.count("_old").alias("updated"))


def links(filed: DataFrame, actions_of: DataFrame, known: DataFrame) -> DataFrame:
    """(idempotency_key, finding_id) after a dispatch: those that are missing are added."""
    fresh = actions_of.join(filed.select("idempotency_key"), "idempotency_key", "left_semi").select("idempotency_key", "finding_id").distinct()
    return known.unionByName(fresh.join(known, ["idempotency_key", "finding_id"], "left_anti"))


def closable(filed: DataFrame, ticket_links: DataFrame, findings: DataFrame) -> DataFrame:
    """Open tickets none of whose findings is open any more, with how many they cover."""
    state = findings.select("finding_id", (F.col("status") == "open").alias("_open"))
    per = ticket_links.join(state, "finding_id").groupBy("idempotency_key").agg(F.count_if("_open").alias("still_open"), F.count("*").alias("total")).where("still_open = 0")
    return filed.where("state = 'open'").join(per, "idempotency_key").select("idempotency_key", "title", "total")


def close(filed: DataFrame, done: DataFrame) -> DataFrame:
    """filed with the tickets in done (closable()'s) closed; closing again changes nothing."""
    return merge(filed, done.select("idempotency_key", F.lit("closed").alias("state")), ["idempotency_key"], {"state": "replace"}, insert=False)


# The trackers' field names and types below.
def tracker_payload(tickets: DataFrame, project: str = "SEC") -> DataFrame:
    """The fields of two kinds of trackers, as JSON text; sending them isn't done here."""
    tidy = F.transform("labels", lambda x: F.replace(F.replace(x, F.lit(":"), F.lit("-")), F.lit(" "), F.lit("-")))
    text = F.array(F.struct(F.lit("paragraph").alias("type"), F.array(F.struct(F.lit("text").alias("type"), F.col("body").alias("text"))).alias("content")))
    fields = F.struct(
        F.struct(F.lit(project).alias("key")).alias("project"), F.substring("title", 1, 255).alias("summary"), F.struct(F.lit("doc").alias("type"), F.lit(1).alias("version"), text.alias("content")).alias("description"),
        F.struct(F.lit("Task").alias("name")).alias("issuetype"), tidy.alias("labels"), F.col("due_date").cast("string").alias("duedate"), F.struct(_map("risk_band", PRIORITY, "Medium").alias("name")).alias("priority"),
    )
    return tickets.select("idempotency_key", F.to_json(F.struct(fields.alias("fields"))).alias("issue"), F.to_json(F.struct("title", "body", "labels")).alias("alternative"))
