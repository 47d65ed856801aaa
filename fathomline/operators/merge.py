"""Idempotent merges of a source into a table, by rules for each column, as one full outer join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import broadcast_if_small, written

Rule = str | Callable[[Column, Column], Column]

_RULES: dict[str, Callable[[Column, Column], Column]] = {
    "keep": lambda old, new: old,
    "replace": lambda old, new: new,
    "fill": lambda old, new: F.coalesce(old, new),
    "refresh": lambda old, new: F.coalesce(new, old),
    "least": lambda old, new: F.least(old, new),
    "greatest": lambda old, new: F.greatest(old, new),
}


def merge(target: DataFrame, source: DataFrame, keys: list[str], rules: dict[str, Rule], insert: bool = True) -> DataFrame:
    """target with source merged in: matching rows by the rules (default: keep), others as they are, new ones if `insert`.

    Keys compare null-safely. Both sides have one row per key; merging the same source again changes nothing where
    the rules don't count.
    """
    names = target.columns
    t = target.select(*(F.col(c).alias(f"_t_{c}") for c in names), F.lit(True).alias("_in_t"))
    s = source.select(*(F.col(c).alias(f"_s_{c}") for c in source.columns), F.lit(True).alias("_in_s"))
    on = None
    for k in keys:
        same = F.col(f"_t_{k}").eqNullSafe(F.col(f"_s_{k}"))
        on = same if on is None else on & same
    both = t.join(s, on, "full_outer" if insert else "left")
    here, there = F.col("_in_t").isNotNull(), F.col("_in_s").isNotNull()
    out = []
    for c in names:
        old = F.col(f"_t_{c}")
        if c not in source.columns:
            out.append(old.alias(c))
            continue
        new, rule = F.col(f"_s_{c}"), rules.get(c, "keep")
        value = old if c in keys else (_RULES[rule] if isinstance(rule, str) else rule)(old, new)
        out.append(F.when(here & there, value).when(here, old).otherwise(new).alias(c))
    return both.select(*out)


def write_partitions(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Set-based table sink: of a table partitioned by columns, the partitions that rows has are replaced, the others stay. Writing again changes nothing."""
    rows.repartition(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def ranked(rows: DataFrame, key: Column, name: str, into: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with their rank by key (equal keys share one) as column `name`, without putting all in one task.

    Keys are dealt out in ranges, ranked inside these, and moved on by what the ranges before hold. `into` writes a
    table and reads it again: the ranges must stay as they are.
    """
    dealt = into(rows.withColumn("_key", key).repartitionByRange("_key").withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")  # a row for each range
    inside = Window.partitionBy("_part").orderBy("_key")
    return dealt.join(F.broadcast(starts), "_part").withColumn(name, F.rank().over(inside) + F.col("_before")).drop("_part", "_key", "_before")


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first in an order that leaves no ties open."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


#: Rows of a leaf of a hash tree, about, and bits by which the tree widens from one level to the next.
LEAF_ROWS, STEP = 1_000, 6


def hash_tree(rows: DataFrame, key: str, bits: int) -> DataFrame:
    """(level, node, rows, one, two): digests of rows by the hash of their key, from the root (level 0) to 2**bits leaves.

    A digest is two sums of the rows' hashes, so their order doesn't matter, and a node's are the sums of its children's.
    Kept beside a table, a tree spares it from being read where nothing differs.
    """
    content = F.struct(*rows.columns)
    leaf = F.shiftrightunsigned(F.xxhash64(F.lit(11), key), 64 - bits) if bits else F.lit(0).cast("long")
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), content).cast("decimal(20,0)"))
    level = rows.groupBy(leaf.alias("node")).agg(F.count("*").alias("rows"), wide(1).alias("one"), wide(2).alias("two"))
    tree, at = level.withColumn("level", F.lit(bits)), bits
    while at:
        at, by = max(0, at - STEP), min(at, STEP)
        level = level.groupBy(F.shiftrightunsigned("node", by).alias("node")).agg(*(F.sum(c).alias(c) for c in ("rows", "one", "two")))
        tree = tree.unionByName(level.withColumn("level", F.lit(at)))
    return tree.select("level", "node", "rows", F.col("one").cast("decimal(38,0)").alias("one"), F.col("two").cast("decimal(38,0)").alias("two"))


def differing_leaves(left: DataFrame, right: DataFrame, bits: int) -> DataFrame:
    """(node) of the leaves of two hash trees whose digests differ: from the root down, only below nodes that differ."""
    level, found = 0, None
    while True:
        mine, other = (t.where(F.col("level") == level).select("node", "rows", "one", "two") for t in (left, right))
        other = other.withColumnsRenamed({c: f"_{c}" for c in ("rows", "one", "two")})
        both = mine.join(other, "node", "full_outer")
        if found is not None:
            both = both.join(broadcast_if_small(found.select(F.col("node").alias("_up"))), F.shiftrightunsigned("node", by) == F.col("_up"), "left_semi")  # noqa: B023
        same = F.lit(True)
        for c in ("rows", "one", "two"):
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        found = written(both.where(~same).select("node"), "differs")
        if level == bits:
            return found
        by = bits % STEP if not level and bits % STEP else STEP
        level += by


def reconcile_by_tree(left: DataFrame, right: DataFrame, key: str, bits: int | None = None) -> DataFrame:
    """reconcile() that joins only the rows of leaves that differ, with `compared`: how many rows of both sides those are."""
    if bits is None:
        bits = max(0, (left.count() // LEAF_ROWS).bit_length())
    right = right.select(*left.columns)
    trees = [written(hash_tree(t, key, bits), "tree") for t in (left, right)]
    leaves = broadcast_if_small(differing_leaves(*trees, bits))
    leaf = F.shiftrightunsigned(F.xxhash64(F.lit(11), key), 64 - bits) if bits else F.lit(0).cast("long")
    some = [t.join(leaves, leaf == F.col("node"), "left_semi") for t in (left, right)]
    found = reconcile(*some, key).select("missing", "surplus", "changed", "in_sync", (F.col("source_rows") + F.col("target_rows")).alias("compared"))
    whole = [t.where("level = 0").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias(n)) for t, n in zip(trees, ("source_rows", "target_rows"), strict=True)]
    return whole[0].crossJoin(whole[1]).crossJoin(found).select("source_rows", "target_rows", "missing", "surplus", "changed", "in_sync", "compared")  # one row each


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: rows of both sides, rows that only one has, rows that differ in content, and whether there is drift. A null key equals a null key."""
    content = [c for c in left.columns if c != key]
    a = left.select(F.col(key).alias("_a"), F.xxhash64(*content).alias("_ha"))
    b = right.select(F.col(key).alias("_b"), F.xxhash64(*content).alias("_hb"))
    both = a.join(b, F.col("_a").eqNullSafe(F.col("_b")), "full_outer")
    out = both.agg(F.count("_ha").alias("source_rows"), F.count("_hb").alias("target_rows"), F.count_if(F.col("_hb").isNull()).alias("missing"), F.count_if(F.col("_ha").isNull()).alias("surplus"), F.count_if(F.col("_ha") != F.col("_hb")).alias("changed"))
    return out.withColumn("in_sync", (F.col("missing") + F.col("surplus") + F.col("changed")) == 0)
