"""The kept table of assessments, laid out for triage: pages are read from a few row groups.

Current rows lie apart from superseded ones, by band, and sorted by score, so that partition folders and the row groups'
statistics say what a page can't need. Beside the table lies the number of rows of each score (and each due date) of
each band: some 10,000 scores at most, whatever the number of findings. They tell from which score on a page's rows lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import written
from . import reports

#: Bytes of a row group.
GROUP = 1 << 20
#: Rows of a range, about.
RANGE_ROWS = 250_000
#: Column that pages of an order start from, and whether the largest comes first.
LED_BY = {"risk": ("risk_score", True), "due_date": ("due_date", False)}


def write(assessed: DataFrame, path: str, superseded: DataFrame | None = None) -> None:
    """The table below `path`, of current assessments (as current_risk() has them) and, if given, superseded ones with the same columns."""
    rows = assessed.withColumn("is_current", F.lit(True))
    if superseded is not None:
        rows = rows.unionByName(superseded.select(*assessed.columns).withColumn("is_current", F.lit(False)))
    order = [F.col("is_current"), F.col("risk_band"), F.desc("risk_score"), F.desc_nulls_last("epss_score"), F.col("finding_id")]
    # Ranges are cut by the whole order, so a large band is several files. Their bounds are sampled: of written rows, so that
    # nothing is worked out twice; and a range has about RANGE_ROWS, which a task sorts in memory whatever the table.
    rows = written(rows, "assessed")
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).write.option("parquet.block.size", GROUP).partitionBy("is_current", "risk_band").parquet(f"{path}/rows")
    _count(assessed.sparkSession, path)


def _count(spark: SparkSession, path: str) -> None:
    current = read(spark, path)
    counts = None
    for column, _ in LED_BY.values():
        one = current.groupBy("risk_band", F.col(column).cast("string").alias("value")).agg(F.count("*").alias("rows")).withColumn("column", F.lit(column))
        counts = one if counts is None else counts.unionByName(one)
    counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")


def read(spark: SparkSession, path: str, current: bool = True) -> DataFrame:
    """The current (or the superseded) rows."""
    return spark.read.parquet(f"{path}/rows").where(F.col("is_current") == current).drop("is_current")


def _from(counts: list, least: int, descending: bool):
    """The value from which on at least `least` rows lie, in the page's order; null where all rows are needed."""
    seen = 0
    for value, n in sorted(counts, reverse=descending):
        seen += n
        if seen >= least:
            return value
    return None


def page(spark: SparkSession, path: str, sort: str = "risk", limit: int | None = 50, offset: int = 0, band: str | None = None, **filters) -> DataFrame:
    """The same as reports.finding_list() over all current rows, of the part of the table that holds the page.

    Where other filters leave too few rows of that part, a larger one is looked at, four times as many rows each time.
    """
    view = read(spark, path)
    if band is not None:
        view = view.where(F.col("risk_band") == band)
    if limit is None or sort not in LED_BY:
        return reports.finding_list(view, sort, limit, offset, **filters)
    column, descending = LED_BY[sort]
    kind = view.schema[column].dataType
    counts = spark.read.parquet(f"{path}/counts").where(F.col("column") == column)
    if band is not None:
        counts = counts.where(F.col("risk_band") == band)
    by_value = [(r.v, r.n) for r in counts.groupBy(F.col("value").cast(kind).alias("v")).agg(F.sum("rows").alias("n")).where("v IS NOT NULL").collect()]  # a row for each score or day
    need, looked = limit + offset, limit + offset
    narrow = any(v not in (None, False) for v in filters.values())
    while True:
        start = _from(by_value, looked, descending)
        part = view if start is None else view.where(F.col(column) >= F.lit(start) if descending else F.col(column) <= F.lit(start))
        if start is None or not narrow or reports.finding_list(part, sort, None, **filters).limit(need).count() >= need:
            return reports.finding_list(part, sort, limit, offset, **filters)
        looked *= 4
