"""Structured Streaming: scan rows into the findings table, incremental scores, and quota audits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.state import GroupState
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import ingest, risk
from ..session import TIDY, delete, scratch, settings


_STORE = "spark.sql.streaming.stateStore"
#: State on disk, in a memory that all stores of an executor share and that doesn't grow with the keys.
ON_DISK = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STORE}.rocksdb.boundedMemoryUsage": "true", f"{_STORE}.rocksdb.maxMemoryUsageMB": "256", f"{_STORE}.rocksdb.trackTotalNumberOfRows": "false",
}

#: Parts of the table of findings, by a hash of the asset.
PARTS = 64


def stream_merge(source: DataFrame, path: str, to_findings: Callable[[DataFrame], DataFrame], checkpoint: str, parts: int = PARTS) -> None:
    """Merge each micro-batch of scan rows into the table of findings below `path`.

    A batch writes anew the parts of the table that its assets lie in, below its number, and no others. A part's rows
    are those of the last batch that wrote it. A batch that runs again reads what the batches before it wrote and
    writes the same, so the merge is idempotent. What no batch can read any more is deleted as the next one begins.
    """
    part = F.pmod(F.xxhash64("asset_id"), F.lit(parts)).cast("int")

    def merge_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        _drop_superseded(spark, path, number)
        kept = scratch(spark, "batch")
        with settings(spark, TIDY):
            found = to_findings(batch).withColumn("part", part)
            found.write.parquet(kept)
            found = spark.read.schema(found.schema).parquet(kept)
            touched = [r.part for r in found.select("part").distinct().collect()]  # at most `parts`
            old = current(spark, path, number)
            old = old.where(F.col("part").isin(touched)).drop("batch") if old is not None else spark.createDataFrame([], found.schema)
            after = ingest.merge_findings(old.drop("part"), found.drop("part")).withColumn("part", part)
            # As many tasks as parts, so that each sorts and writes one.
            after.repartition(parts, "part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/batch={number}")
        delete(spark, kept)

    with settings(source.sparkSession, ON_DISK):  # a stream keeps the settings that it starts with
        stream = source.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()


def _drop_superseded(spark: SparkSession, path: str, number: int) -> None:
    """Delete the parts that a later batch before `number` wrote anew: those batches are done, and none reads them again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/part=*")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    folders = [(int(p.getParent().getName().removeprefix("batch=")), p.getName(), p.toString()) for p in (f.getPath() for f in found or [])]
    last: dict[str, int] = {}
    for batch, name, _ in folders:
        if batch < number:
            last[name] = max(batch, last.get(name, -1))
    for batch, name, folder in folders:
        if batch < last.get(name, -1):
            delete(spark, folder)


def without_repeats(source: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """A stream with each row (by keys) once, however often and in whatever batches it comes within `late` of its time.

    Keys are remembered until the watermark passes them. Rows that come later than that are dropped: those that came in
    time before are only repeated by them, and others must be loaded by a run over the table. What is remembered of a row are
    two hashes of 64 bits, however wide its keys are.
    """
    hashed = {f"_seen{i}": F.xxhash64(F.lit(i), *keys, *(F.col(k).isNull() for k in keys)) for i in (1, 2)}
    return source.withWatermark(time, late).withColumns(hashed).dropDuplicatesWithinWatermark(list(hashed)).drop(*hashed)


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The table as the batches (those before number `before`) left it; null without any. Folders tell which batch wrote a part last; no data is read for that."""
    if before == 0:
        return None
    rows = spark.read.parquet(path)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    last = rows.groupBy("part").agg(F.max("batch").alias("batch"))  # of partition columns alone
    return rows.join(F.broadcast(last), ["part", "batch"], "left_semi")


def incremental_score(findings: DataFrame, cves: DataFrame, assets: DataFrame, since: str) -> DataFrame:
    """Assessments of the findings that a scan has touched since a date; the others' stay as they are."""
    return risk.assess(findings.where(F.col("last_seen") > F.lit(since).cast("date")), cves, assets)


def quota_audit(events: DataFrame, seconds: int, most: int, weight: float) -> DataFrame:
    """Each event with the events and their summed weight in the `seconds` up to it, by key, and whether a quota is broken."""
    trailing = Window.partitionBy("key").orderBy(F.unix_micros("ts")).rangeBetween(-seconds * 1_000_000, 0)
    out = events.withColumns({"calls": F.count("*").over(trailing), "used": F.sum("weight").over(trailing)})
    return out.withColumn("breach", (F.col("calls") > most) | (F.col("used") > weight))


#: Windows of so many rows are added up row by row, in order, as SQL adds them; longer ones by running sums.
DIRECT = 32
#: Stands for a null event_id in the state.
_NO_ID = -(1 << 63)


def window_sums(weight: np.ndarray, first: np.ndarray, last: np.ndarray, direct: int = DIRECT) -> np.ndarray:
    """Sum of weight[first:last] of each window, nulls (NaN) left out; NaN where a window has nothing else.

    A difference of running sums isn't the sum of the rows to the last bit, and a limit that a sum just meets would seem broken.
    """
    known = ~np.isnan(weight)
    weight, n = np.where(known, weight, 0.0), np.concatenate([[0], np.cumsum(known)])
    size, used = last - first, np.zeros(len(first))
    for j in range(min(int(size.max(initial=0)), direct)):
        inside = size > j
        used[inside] += weight[first[inside] + j]
    if (far := size > direct).any():
        sums = np.concatenate([[0.0], np.cumsum(weight.astype(np.longdouble))])
        used[far] = (sums[last[far]] - sums[first[far]]).astype(float)
    return np.where(n[last] > n[first], used, np.nan)


def _trailing(seconds: int, direct: int):
    """applyInPandasWithState function: events by key to those whose trailing window is complete, with its numbers.

    The state has the times and weights of the `seconds` before the watermark, and the events after it, which others may
    still precede. What the watermark has passed is final, as no earlier event is let in any more.
    """
    width = seconds * 1_000_000

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past, ahead = (np.frombuffer(x, np.int64).reshape(-1, 3) for x in state.get) if state.exists else (np.zeros((0, 3), np.int64), np.zeros((0, 3), np.int64))
        # Time, bits of the weight, id.
        rows = [np.stack([f["us"].to_numpy(np.int64), f["weight"].to_numpy(float).view(np.int64), f["event_id"].to_numpy(np.int64)], 1) for f in ([] if state.hasTimedOut else frames) if len(f)]
        ahead = np.concatenate([ahead, *rows])
        ahead = ahead[np.lexsort((ahead[:, 2], ahead[:, 0]))]
        passed = state.getCurrentWatermarkMs() * 1000
        done = int(np.searchsorted(ahead[:, 0], passed, "right"))
        if done:
            every = np.concatenate([past, ahead[:done]])
            at, now = every[:, 0], ahead[:done]
            first, last = np.searchsorted(at, now[:, 0] - width, "left"), np.searchsorted(at, now[:, 0], "right")
            used = window_sums(np.ascontiguousarray(every[:, 1]).view(float), first, last, direct)
            yield pd.DataFrame({"event_id": now[:, 2], "key": [key[0]] * done, "calls": last - first, "used": used})
            past, ahead = every, ahead[done:]
        past = past[past[:, 0] >= passed - width]
        if len(past) or len(ahead):
            state.update((past.tobytes(), ahead.tobytes()))
            # Wakes when the watermark passes the next event, or, without one, when the past is over.
            next_us = int(ahead[0, 0] if len(ahead) else past[-1, 0] + width)
            state.setTimeoutTimestamp(max(next_us // 1000, state.getCurrentWatermarkMs()) + 1)
        else:
            state.remove()

    return step


def stream_trailing(events: DataFrame, seconds: int, most: int, weight: float, late: str) -> DataFrame:
    """quota_audit() of a stream (event_id and key: long, ts, weight: double), each event once its window is complete.

    Events may come in any order up to `late` after the newest; later ones are left out. An event is told when the
    watermark has passed it, so a stream that ends needs a last event (with a null event_id, which isn't told) that is later
    than `late` after all others. A null key is a key, and null weights count as calls alone. A key's state is its events of
    `seconds` and `late`, in one task.
    """
    rows = events.select(F.coalesce("event_id", F.lit(_NO_ID)).alias("event_id"), "key", "ts", "weight", F.unix_micros("ts").alias("us")).withWatermark("ts", late)
    told = rows.groupBy("key").applyInPandasWithState(_trailing(seconds, max(most, DIRECT)), "event_id long, key long, calls long, used double", "past binary, ahead binary", "append", "EventTimeTimeout")
    told = told.where(F.col("event_id") != _NO_ID).withColumn("used", F.nanvl("used", F.lit(None).cast("double")))
    return told.withColumn("breach", (F.col("calls") > most) | (F.col("used") > weight))


def stream_quota(events: DataFrame, seconds: int, slide: int, late: str = "10 minutes") -> DataFrame:
    """The streaming form: calls and weight by key in sliding windows, with a watermark for late events."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds", f"{slide} seconds"), "key").agg(F.count("*").alias("calls"), F.sum("weight").alias("used"))
