"""Mixing sources to target weights by weighted fair queueing.

Every document stands in its source's shuffled queue once for each epoch. Its virtual finish time is the
source's tokens up to and with it, divided by the source's target weight; the mix takes documents in the
order of their finish times until the budget is spent.

The queues are made of narrow rows, without texts; rows that equal each other are one with a number of copies. Both running sums are taken in two levels: sums per bucket first
(pre-aggregated before the shuffle), a running sum over the buckets, then a window inside each bucket. The global
order is cut by ranges of finish times, each finer than the last, until the range in which the budget ends holds few
rows: only these are put in order together. What the mix takes of a source is then a beginning of its queue, so its
last place for each epoch, a row for each source, is all that the documents themselves are compared with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .session import Tables, broadcast_if_small, partitions

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: Budget as a share of all words, and how often a source may be gone through.
BUDGET, EPOCHS = 1.5, 2
#: Buckets of a source's shuffled queue and of the finish times.
BUCKETS = 1 << 12
#: Slots into which a range of finish times is cut (a finish time of 1 is the source's target), and rows that are put in order together.
GRID, FEW = 1 << 10, 100_000
#: Copies of a row that one task lists, and parts in which copies are numbered.
COPIES, PARTS = 1 << 12, 1 << 10


def size_of(text: str | Column = "text") -> Column:
    """Words that white space divides; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """Of a table (source, source_size): each source's target in words.

    The budget is shared by weight; no target exceeds `epochs` times its source's size, and what is over goes to
    the others by weight until none is above. In the order of cap to weight, the sources up to some place get
    their cap and the rest share what is left. One row per source: its windows put the list of
    sources into one task, which is fine for names of feeds and up to some millions of hosts.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sizes.withColumn("_i", F.row_number().over(order) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_i") % len(weights) + 1).cast("int")))
    numbered = numbered.withColumn("_cap", (epochs * F.col("source_size")).cast("double"))
    by_level = Window.orderBy(F.col("_cap") / F.col("weight"), "_i")
    before, every = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    spent = F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    total = F.sum("source_size").over(every) * budget
    # The share that a source would get if all before it are at their caps and none after it is.
    share = numbered.withColumn("_level", F.greatest(total - spent, F.lit(0.0)) / left)
    capped = F.col("_cap") <= F.col("_level") * F.col("weight")
    share = share.withColumn("_capped", F.min(capped.cast("int")).over(by_level.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    first = F.min(F.when(~F.col("_capped"), F.struct((F.col("_cap") / F.col("weight")).alias("a"), F.col("_i").alias("b"), F.col("_level").alias("level")))).over(every)
    share = share.withColumn("_water", first["level"])
    return share.select("source", "source_size", "weight", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_water") * F.col("weight"))).alias("target"))


def _entries(queue: DataFrame) -> DataFrame:
    """The places of the queue's rows (size, key, doc_id, copies, start: words before the first copy, target): one for each copy, with its finish time."""
    rows = queue.where("size > 0 AND target > 0").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}"))))
    if not queue.where(F.col("copies") > COPIES).isEmpty():
        rows = rows.repartition(partitions(queue.sparkSession))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.col("part") * COPIES, F.least((F.col("part") + 1) * COPIES, "copies") - 1)))
    return rows.withColumn("finish", (F.col("start") + (F.col("copy") + 1) * F.col("size")) / F.col("target")).drop("part", "start")


def _last_taken(places: DataFrame, total: int, epochs: int) -> tuple | None:
    """The last (finish, key, doc_id, copy) in the global order of the places' epochs whose running sum is within `total`; null without any."""
    finish = [F.col("finish") + F.try_divide(F.col("source_size") * e, F.col("target")) for e in range(epochs)]
    entries = places.select("size", "key", "doc_id", "copy", F.explode(F.array(*finish)).alias("finish"))
    place = F.max(F.struct("finish", "key", "doc_id", "copy")).alias("m")
    low, high, left = 0.0, None, total
    while True:
        inside = entries.where(F.col("finish") >= low)
        if high is not None:
            inside = inside.where(F.col("finish") < high)
        every = inside.agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("finish").alias("low"), F.max("finish").alias("high")).first()
        if not every.n or every.size <= left:
            return inside.agg(place).first().m
        width = (every.high - every.low) / GRID
        if every.n <= FEW or width <= 0 or every.low + width == every.low:
            order = Window.orderBy("finish", "key", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            found = inside.withColumn("run", F.sum("size").over(order)).where(F.col("run") <= left).agg(place).first().m
            return found or entries.where(F.col("finish") < low).agg(place).first().m
        slot = F.least(F.floor((F.col("finish") - every.low) / width), F.lit(GRID - 1))
        slots = {r.slot: r.size for r in inside.groupBy(slot.alias("slot")).agg(F.sum("size").alias("size")).collect()}  # at most GRID rows
        for i in sorted(slots):
            if slots[i] > left:
                low, high = every.low + i * width, (every.low + (i + 1) * width if i < GRID - 1 else high)
                break
            left -= slots[i]


def _numbered(rows: DataFrame, group: list[str], tables: Tables) -> DataFrame:
    """rows with copy: the rows of each group numbered from 0, part by part, so that a large group is no task's own."""
    rows = tables.keep(rows.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(PARTS))))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = tables.keep(rows.groupBy(*group, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    own = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(F.lit(0))) - 1
    same = [F.col(f"_g{i}").eqNullSafe(F.col(c)) for i, c in enumerate([*group, "_part"])]
    starts = broadcast_if_small(starts.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate([*group, "_part"])], "_before"))
    return rows.withColumn("_own", own).join(starts, same).withColumn("copy", F.col("_own") + F.col("_before"))


def mix(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS, buckets: int = BUCKETS) -> DataFrame:
    """The columns of docs (but for clashing names) with size, source_size, target and taken, one row for each row.

    taken: words that the mix takes of the row: its size times the epochs whose finish time comes before the budget
    is spent. The order is by a hash of seed, doc_id and text, so reruns agree. Rows that equal each other in source,
    doc_id and text stand one after another in the queue, each in a place of its own; which of them the mix's end leaves out
    is arbitrary. Null or blank texts have size 0 and taken 0; a null source is a source of its own, the last. An empty
    table gives an empty result. Long texts are read whole.
    """
    tables = Tables(docs.sparkSession, "mix")
    spread = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    slim = docs.select("doc_id", "source", size_of().alias("size"), key.alias("key")).withColumn("b", F.pmod("key", F.lit(buckets)))
    slim = tables.keep(slim.groupBy("source", "b", "key", "doc_id", "size").agg(F.count("*").alias("copies")))
    sums = slim.groupBy("source", "b").agg(F.sum(F.col("size") * F.col("copies")).alias("sum"))
    share = tables.keep(targets(sums.groupBy("source").agg(F.sum("sum").alias("source_size")), weights, budget, epochs))
    in_source = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("sum").over(in_source), F.lit(0))).select(F.col("source").alias("_s"), F.col("b").alias("_b"), "before")
    in_bucket = Window.partitionBy("source", "b").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    queue = slim.where("size > 0").withColumn("run", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(in_bucket), F.lit(0))).join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("b") == F.col("_b")))
    of_source = share.select(F.col("source").alias("_t"), "source_size", "target")
    queue = queue.join(broadcast_if_small(of_source), F.col("source").eqNullSafe(F.col("_t")))
    queue = tables.keep(queue.select("doc_id", "source", "size", "key", "b", "copies", "source_size", "target", (F.col("before") + F.col("run")).alias("start")))
    total = share.agg(F.sum("source_size")).first()[0] or 0
    places = _entries(queue)
    last = _last_taken(places, int(total * budget), epochs)

    # The last place of each source's queue that the mix takes, for each epoch.
    ends = []
    for e in range(epochs):
        finish = F.col("finish") + F.try_divide(F.col("source_size") * e, F.col("target"))
        within = F.lit(False) if last is None else F.struct(finish, "key", "doc_id", "copy") <= F.struct(F.lit(last.finish), F.lit(last.key), F.lit(last.doc_id).cast(docs.schema["doc_id"].dataType), F.lit(last.copy).cast("long"))
        ends.append(F.max(F.when(within, F.struct("b", "key", "doc_id", "copy", "copies"))).alias(f"end{e}"))
    cuts = share.select("source", "source_size", "target").join(places.groupBy(F.col("source").alias("_t")).agg(*ends), F.col("source").eqNullSafe(F.col("_t")), "left").drop("_t")
    cuts = tables.keep(cuts)
    # Rows with copies of which the mix takes some: a place or two for each source.
    split = None
    for e in range(epochs):
        one = cuts.where(f"end{e}.copy + 1 < end{e}.copies").select(F.col("source").alias("_t"), F.struct(*[f"end{e}.{c}" for c in ("b", "key", "doc_id")]).alias("_end"))
        split = one if split is None else split.unionByName(one)
    split = tables.keep(split.distinct())
    packed = docs.select(F.struct(*[F.col(c) for c in spread]).alias("_row"), F.col("source").alias("_s"), size_of().alias("_size"), F.struct(F.pmod(key, F.lit(buckets)).alias("b"), key.alias("key"), "doc_id").alias("_place"))
    alone = packed.withColumn("copy", F.lit(0).cast("long"))
    if not split.isEmpty():
        here = F.col("_s").eqNullSafe(F.col("_t")) & F.col("_place").eqNullSafe(F.col("_end"))
        few = broadcast_if_small(split)
        many = _numbered(packed.join(few, here).drop("_t", "_end"), ["_s", "_place"], tables)
        alone = alone.join(few, here, "left_anti").unionByName(many.select(*alone.columns))
    joined = alone.join(broadcast_if_small(cuts), F.col("_s").eqNullSafe(F.col("source")))
    before = lambda e: F.struct("_place", "copy") <= F.struct(F.struct(*[f"end{e}.{c}" for c in ("b", "key", "doc_id")]), f"end{e}.copy")
    taken = sum((F.when(F.col(f"end{e}").isNotNull() & before(e), F.col("_size")).otherwise(0) for e in range(epochs)), F.lit(0))
    return joined.select("_row.*", F.col("_size").alias("size"), "source_size", "target", taken.cast("long").alias("taken"))
