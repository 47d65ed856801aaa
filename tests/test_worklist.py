from pyspark.sql import functions as F

from fathomline.operators import worklist as W


def test_only_failures_are_searched_again_and_wider(spark):
    """Actions that need so many hits, of so many that there are."""
    need = {"first": (1, 9), "third": (3, 9), "late": (9, 9), "short": (9, 3), "nothing": (1, 0), "null": (None, 4)}
    actions = spark.createDataFrame([(k, a, b) for k, (a, b) in need.items()], "idempotency_key string, needs int, there int")
    asked = []

    def find(open_, k):
        asked.append((k, {r.idempotency_key for r in open_.collect()}))
        return open_.withColumn("context", F.when(F.col("there") > 0, F.slice(F.transform(F.sequence(F.lit(1), "there"), lambda i: i.cast("string")), 1, k)))

    log = W.widening(actions, find, lambda found: found.withColumn("passed", F.size("context") >= F.col("needs")), k=1, most=4)
    got = {}
    for r in log.orderBy("key", "attempt").collect():
        got.setdefault(r.key, []).append((r.k, r.context_size, r.outcome))
    assert got == {
        "first": [(1, 1, "done")], "third": [(1, 1, "retry"), (2, 2, "retry"), (4, 4, "done")], "late": [(1, 1, "retry"), (2, 2, "retry"), (4, 4, "retry"), (8, 8, "give_up")],
        "short": [(1, 1, "retry"), (2, 2, "retry"), (4, 3, "retry"), (8, 3, "give_up")], "nothing": [(1, 0, "no_context")], "null": [(1, 1, "retry"), (2, 2, "retry"), (4, 4, "retry"), (8, 4, "give_up")],
    }
    assert [k for k, _ in asked] == [1, 2, 4, 8] and asked[1][1] == {"third", "late", "short", "null"} and asked[3][1] == {"late", "short", "null"}
    told = W.attempt_outcomes(log.select("key", "attempt", "context_size", "passed"), most=4)
    assert told.join(log.select("key", "attempt", F.col("outcome").alias("want")), ["key", "attempt"]).where("NOT outcome <=> want").count() == 0
    assert W.widening(actions.where("false"), find, lambda found: found.withColumn("passed", F.lit(True))).count() == 0
