"""The planner's worklist: what to plan, what is cached, what a budget reaches, and how attempts ended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written
from .merge import merge

KEY = ["cve_id", "package_name", "os_family", "fixed_version"]


def representative(actions: DataFrame) -> DataFrame:
    """The lowest listed id, else the lowest; and the model by band."""
    return actions.withColumns({"cve_id": F.coalesce(F.array_min("kev_cve_ids"), F.array_min("cve_ids")), "route": F.when(F.col("risk_band").isin("critical", "high"), "strong").otherwise("bulk")})


def worklist(actions: DataFrame, plans: DataFrame) -> DataFrame:
    """Actions without a grounded plan under their key (null versions equal each other), one for each key: the most urgent."""
    a, known = representative(actions), plans.where("grounded").select(*(F.col(c).alias(f"_{c}") for c in KEY)).distinct()
    on = None
    for c in KEY:
        same = F.col(c).eqNullSafe(F.col(f"_{c}"))
        on = same if on is None else on & same
    left = a.join(known, on, "left_anti")
    order = Window.partitionBy(*KEY).orderBy(F.desc("max_risk_score"), "due_date", "idempotency_key")
    return left.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def cache_economics(actions: DataFrame) -> DataFrame:
    """One row: actions, distinct plan keys, and the share of calls that a cache saves."""
    keys = representative(actions).groupBy(*KEY).agg(F.count("*").alias("n"))
    return keys.agg(F.sum("n").alias("actions"), F.count("*").alias("plan_keys")).withColumn("hit_rate", F.round(1 - F.col("plan_keys") / F.col("actions"), 3))


def persist_plans(plans: DataFrame, fresh: DataFrame) -> DataFrame:
    """Upsert by key, null versions equal; the new content wins."""
    return merge(plans, fresh, KEY, {c: "replace" for c in plans.columns if c not in KEY and c != "plan_id"})


def run_outcomes(runs: DataFrame) -> DataFrame:
    """One row: actions, counts by status, and the share of grounded ones among those planned."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = runs.agg(F.count("*").alias("actions"), *map(count, ("grounded", "cached", "ungrounded", "no_context", "error")))
    return out.withColumn("grounded_rate", F.round(F.col("grounded") / F.greatest(F.col("grounded") + F.col("ungrounded"), F.lit(1)), 3))


def draft_markdown(draft: Column) -> Column:
    """A drafted plan (summary, steps, commands, compensating_controls, rollback, requires_reboot) as markdown."""
    # The headings.
    part = lambda title, text: F.concat(F.lit(f"**{title}**\n"), text)
    filled = lambda a: F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0
    steps = F.array_join(F.transform(draft["steps"], lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")
    other = draft["compensating_controls"]
    return F.concat_ws(
        "\n\n", draft["summary"], F.when(filled(draft["steps"]), part("Steps", steps)), F.when(filled(draft["commands"]), part("Commands", F.concat(F.lit("```bash\n"), F.array_join(draft["commands"], "\n"), F.lit("\n```")))),
        F.when(F.coalesce(other, F.lit("")) != "", part("Compensating controls", other)), part("Rollback", draft["rollback"]), F.when(draft["requires_reboot"], F.lit("_Requires a reboot._")),
    )


def failures(runs: DataFrame, n: int = 15) -> DataFrame:
    """The first runs that neither made a plan nor found one."""
    return runs.where(~F.col("status").isin("grounded", "cached")).orderBy("idempotency_key").limit(n)


def token_estimate(prompt: str, reserved: int = 1500) -> F.Column:
    return (F.length(prompt) / 3.7).cast("long") + reserved


def budget_cut(rows: DataFrame, budget: int) -> DataFrame:
    """rows (idempotency_key, urgency, due_date, tokens) with the running sum in the order of urgency and whether it stays within the budget.

    Sums per urgency and due date come first, so only rows that are equal in both are put in order together.
    """
    level = ["urgency", "due_date"]
    per = rows.groupBy(*level).agg(F.sum("tokens").alias("_sum"))
    before = per.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy(F.desc("urgency"), "due_date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("urgency").alias("_u"), F.col("due_date").alias("_d"), "_before")
    inside = Window.partitionBy(*level).orderBy("idempotency_key").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.join(before, F.col("urgency").eqNullSafe(F.col("_u")) & F.col("due_date").eqNullSafe(F.col("_d"))).drop("_u", "_d")
    out = met.withColumn("running", F.col("_before") + F.sum("tokens").over(inside)).drop("_before")
    return out.withColumn("planned", F.col("running") <= budget)


def widening(actions: DataFrame, find: Callable[[DataFrame, int], DataFrame], draft: Callable[[DataFrame], DataFrame], k: int = 8, most: int = 3) -> DataFrame:
    """The log of attempts at actions (idempotency_key): key, attempt, k, context_size, passed, outcome.

    find(actions, k) gives them `context` (array of what a search for each finds, the best k; null: none), draft() a plan with
    `passed`, what the gate says of it. What fails is searched for again with twice k, as long as that finds more; so each
    round has the failures of the one before, and no others. Outcomes are those of attempt_outcomes(). Without a context
    nothing is drafted.
    """
    log, open_, attempt = None, actions.withColumn("_before", F.lit(-1)), 1
    while True:
        found = find(open_, k).withColumn("context_size", F.coalesce(F.size("context"), F.lit(0)))
        found = written(found, "found")
        told = draft(found.where("context_size > 0")).select("idempotency_key", F.coalesce("passed", F.lit(False)).alias("passed"))
        end = (F.lit(attempt) >= most) | (F.col("context_size") <= F.col("_before"))
        outcome = F.when(F.col("context_size") == 0, "no_context").when(F.col("passed"), "done").when(end, "give_up").otherwise("retry")
        tried = found.select("idempotency_key", "context_size", "_before").join(told, "idempotency_key", "left").withColumn("passed", F.coalesce("passed", F.lit(False))).withColumn("outcome", outcome)
        tried = written(tried, "tried")
        rows = tried.select(F.col("idempotency_key").alias("key"), F.lit(attempt).alias("attempt"), F.lit(k).alias("k"), "context_size", "passed", "outcome")
        log = rows if log is None else log.unionByName(rows)
        again = tried.where("outcome = 'retry'").select("idempotency_key", F.col("context_size").alias("_before"))
        if again.isEmpty():
            return log
        open_, attempt, k = open_.drop("_before").join(again, "idempotency_key"), attempt + 1, 2 * k


def attempt_outcomes(attempts: DataFrame, most: int = 3) -> DataFrame:
    """What comes after each attempt (key, attempt, context_size, passed): done, give_up after the last one or when the context didn't grow, no_context, else retry."""
    order = Window.partitionBy("key").orderBy("attempt")
    grew = F.col("context_size") > F.coalesce(F.lag("context_size").over(order), F.lit(-1))
    return attempts.withColumn("outcome", F.when(F.col("context_size") == 0, "no_context").when(F.col("passed"), "done").when((F.col("attempt") >= most) | ~grew, "give_up").otherwise("retry"))
