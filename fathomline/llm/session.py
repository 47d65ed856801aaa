"""Session matters shared by the operators: checkpoints and scratch space in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


_local: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only where that isn't set, as in tests on one machine, a temporary folder that goes with the process."""
    global _local
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local is None:
        _local = tempfile.mkdtemp(prefix="fathomline-")
        atexit.register(shutil.rmtree, _local, ignore_errors=True)
    return f"file://{_local}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so that a lost executor costs no recomputation of all before."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store through Hadoop's file system, wherever that is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Spark's setting by which a query's shuffle files go when it ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Tables:
    """Written tables in a folder of the shared store: they cut the lineage, survive lost executors, and go when dropped."""

    #: Rows of a few longs that make one written file.
    ROWS = 200_000

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        """tidy: a write's shuffle files go as soon as it has ended, for its DataFrame isn't used again."""
        self.spark, self.root, self.made, self.n, self.tidy = spark, scratch(spark, name), [], 0, tidy

    def keep(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """df written and read again; with the number of rows at most, in no more files than these need."""
        if rows is not None:
            df = df.coalesce(max(1, min(partitions(self.spark), -(-rows // self.ROWS))))
        path = f"{self.root}/{self.n}"
        self.n += 1
        before = self.spark.conf.get(TIDY)
        self.spark.conf.set(TIDY, str(self.tidy or before == "true").lower())
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(TIDY, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.made.append((out, path))
        return out

    def drop(self, *but: DataFrame, since: int = 0) -> None:
        """Delete all tables from number `since` on but those given; nothing may read the others any more."""
        stay = [(df, path) for i, (df, path) in enumerate(self.made) if i < since or any(df is x for x in but)]
        for df, path in self.made:
            if not any(path == p for _, p in stay):
                delete(self.spark, path)
        self.made = stay


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows of a few longs (under 16 MB) that may be broadcast.
SMALL_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df with a broadcast hint where it has at most `rows` rows, else as it is. For narrow rows of fixed width."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bound_batches(spark: SparkSession, size: str = "8m") -> None:
    """Hand texts to Python workers in batches of about `size`, however long they are: a worker then needs a bounded memory.

    Every operator that hands out texts sets this alike, so none depends on what ran before.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
