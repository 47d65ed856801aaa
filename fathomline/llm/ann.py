"""Approximate nearest neighbours by an inverted multi-index.

Both halves of the unit vectors are quantised on their own; a cell is a pair of centroids. A query goes through the
cells in the order of the summed distances of its halves to the centroids, with a heap, until it has seen a share
of all entries; what it has seen is ranked again by the true cosine.

The share is measured, not guessed: for a bounded sample of queries the true neighbours are found by brute force,
and the share is what their places in the traversal ask for. Entries are dealt into shards by their cells: small cells
share one, large ones are split by id. A query walks once, goes to the shards that hold cells of its walk, and is
compared with those cells' entries alone. A task holds one shard and lets its queries stream by; a shard that very
many queries visit is given to several tasks. So a vector that a third of the rows have lies in many shards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from .session import Tables, bound_batches, broadcast_if_small, partitions

#: Centroids of each half at most, entries of a mean cell, vectors that the centroids are fitted on at most, and
#: queries that the share is measured with.
CENTROIDS, CELL, FIT_ROWS, PROBES = 256, 50, 20_000, 200
#: Of the sampled queries' true neighbours so many are to lie in what is visited.
COVER = 0.97
#: Vectors of a shard, and visits of queries to it that one task takes.
SHARD, BLOCK = 8_000, 50_000
TOP = 5


def _fine(vectors: DataFrame) -> DataFrame:
    real = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select("vec_id", real.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return rows.where(F.coalesce(fine, F.lit(False)))


def usable(vectors: DataFrame, length: int | None = None) -> DataFrame:
    """vec_id and embedding (array of double) of the rows that take part: no null, non-finite or zero vector, no null id.

    Vectors of several lengths can't be compared: with `length`, only those of that length.
    """
    rows = _fine(vectors)
    return rows if length is None else rows.where(F.size("embedding") == length)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if x.shape[1] == 1:
        x = np.hstack([x, np.zeros_like(x)])
    h = x.shape[1] // 2
    return x[:, :h], x[:, h:]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that the squares of very large or small components stay finite.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines of the rows with the query; a row's value doesn't depend on the others, so equal vectors tie."""
    return (unit(rows) * unit(query[None])).sum(axis=1)


class Index:
    """Centroids of both halves, entries per cell, and the share of all entries that a query visits."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right = left, right
        self.counts = np.zeros(len(left) * len(right), np.int64)
        self.share, self.dims = 1.0, 0

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple((p * p).sum(axis=1)[:, None] - 2 * p @ c.T + (c * c).sum(axis=1)[None] for p, c in zip(halves(x), (self.left, self.right), strict=True))

    def cells(self, x: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(x), 1000):
            a, b = self.distances(x[i : i + 1000])
            out.append(a.argmin(axis=1) * len(self.right) + b.argmin(axis=1))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def walk(self, a: np.ndarray, b: np.ndarray) -> Iterator[int]:
        """Cells by summed distance: the multi-sequence walk over both sorted lists of centroids."""
        oa, ob = a.argsort(kind="stable"), b.argsort(kind="stable")
        da, db = a[oa].tolist(), b[ob].tolist()
        heap, n, m = [(da[0] + db[0], 0, 0)], len(da), len(db)
        while heap:
            _, i, j = heapq.heappop(heap)
            yield int(oa[i] * m + ob[j])
            if j + 1 < m:
                heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
            if j == 0 and i + 1 < n:
                heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))

    def visited(self, x: np.ndarray, least: int) -> Iterator[list[int]]:
        """For each unit vector the cells with entries that it visits: up to the share, and `least` entries at any rate, so that a few entries are found in a small index too."""
        a, b = self.distances(x)
        enough = max(least, int(np.ceil(self.share * self.counts.sum())))
        counts = self.counts.tolist()
        for i in range(len(x)):
            seen, cells = 0, []
            for cell in self.walk(a[i], b[i]):
                if counts[cell]:
                    cells.append(cell)
                    seen += counts[cell]
                    if seen >= enough:
                        break
            yield cells

    def shards(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For each cell its first shard and the number of its shards: neighbouring small cells share one of about `size` entries."""
        first, parts, shard, held = np.zeros(len(self.counts), np.int64), np.ones(len(self.counts), np.int64), 0, 0
        for cell, n in enumerate(self.counts.tolist()):
            if n > size or held + n > size and held:
                shard, held = shard + (held > 0), 0
            first[cell] = shard
            if n > size:
                parts[cell] = -(-n // size)
                shard += int(parts[cell])
            else:
                held += n
        return first, parts


def _centroids(sample: DataFrame, column: str, k: int) -> np.ndarray:
    different = sample.select(column).distinct().limit(k + 1).collect()
    if len(different) <= k:  # each is its own centroid
        return np.array(sorted(r[0].toArray().tolist() for r in different))
    model = KMeans(featuresCol=column, k=k, maxIter=12, seed=3, initSteps=2).fit(sample)
    return np.array(model.clusterCenters())


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            left, right = halves(unit(_matrix(batch.column("embedding"))))
            yield pa.RecordBatch.from_arrays([pa.array(list(left), pa.list_(pa.float64())), pa.array(list(right), pa.list_(pa.float64()))], names=["left", "right"])


def build(rows: DataFrame, centroids: int = CENTROIDS, fit_rows: int = FIT_ROWS, probes: int = PROBES, cover: float = COVER, top: int = TOP) -> tuple[Index | None, DataFrame]:
    """The index, and all rows of usable() as (cell, vec_id, embedding)."""
    spark = rows.sparkSession
    few = rows.orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").select("vec_id", "embedding").limit(fit_rows)
    few = Tables(spark, "ann-fit").keep(few)
    n_few = few.count()
    if not n_few:
        return None, rows.select(F.lit(0).cast("long").alias("cell"), "vec_id", "embedding")
    both = few.select("embedding").mapInArrow(_halves, "left array<double>, right array<double>").select(array_to_vector("left").alias("left"), array_to_vector("right").alias("right"))
    k = max(2, min(centroids, n_few // 4, int((rows.count() / CELL) ** 0.5)))
    index = Index(_centroids(both, "left", k), _centroids(both, "right", k))
    index.dims = len(few.first().embedding)
    sent = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = sent.value.cells(unit(_matrix(batch.column("embedding"))))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), batch.column("vec_id"), batch.column("embedding")], names=["cell", "vec_id", "embedding"])

    entries = rows.select("vec_id", "embedding").mapInArrow(place, "cell long, vec_id long, embedding array<double>")
    for r in entries.groupBy("cell").count().collect():  # one row a cell
        index.counts[r.cell] = r["count"]

    # What share holds the true neighbours of the sampled queries?
    asked = few.orderBy(F.xxhash64(F.lit(6), "vec_id"), "vec_id").limit(probes).collect()
    ids, q = np.array([r.vec_id for r in asked]), unit(np.array([r.embedding for r in asked]))
    probe = spark.sparkContext.broadcast((ids, q))

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = probe.value
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
        for batch in batches:
            if not batch.num_rows:
                continue
            s = unit(_matrix(batch.column("embedding"))) @ q.T
            vec, cell = batch.column("vec_id").to_numpy(), batch.column("cell").to_numpy()
            for i in range(len(ids)):
                score = np.where(vec == ids[i], -2.0, s[:, i])
                take = np.argpartition(-score, min(top, len(score)) - 1)[:top]
                both, cells = np.append(best[i][0], score[take]), np.append(best[i][1], cell[take])
                keep = np.argsort(-both, kind="stable")[:top]
                best[i] = both[keep], cells[keep]
        out = [(i, float(s), int(c)) for i, (ss, cc) in enumerate(best) for s, c in zip(ss, cc, strict=True) if s > -2]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.int64())], names=["i", "score", "cell"])

    near: dict[int, list] = {}
    for r in entries.mapInArrow(truth, "i long, score double, cell long").groupBy("i").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "cell")), False), 1, top).alias("best")).collect():
        near[r.i] = [b.cell for b in r.best]
    need, (a, b) = [], index.distances(q)
    for i, cells in near.items():
        seen, left = 0, list(cells)
        for cell in index.walk(a[i], b[i]):
            seen += int(index.counts[cell])
            if cell in left:
                need += [seen] * left.count(cell)
                left = [c for c in left if c != cell]
            if not left:
                break
    total = int(index.counts.sum())
    index.share = min(1.0, float(np.quantile(need, cover)) / total + 0.01) if need else 1.0
    return index, entries


def compare(entries: DataFrame, asked: DataFrame, index: Index, top: int = TOP, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, scored, best: array of (vec_id, score)) for each query and each shard it visits; scored: entries it was compared with there."""
    spark = entries.sparkSession
    first, parts = index.shards(shard)
    sent = spark.sparkContext.broadcast((index, first, parts))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, first, parts = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                rows, shards, cells = [], [], []
                for i, own in enumerate(index.visited(unit(_matrix(some.column("embedding"))), 50 * (top + 1))):
                    by: dict[int, list[int]] = {}
                    for c in own:
                        for p in range(parts[c]):
                            by.setdefault(int(first[c]) + p, []).append(c)
                    rows += [i] * len(by)
                    shards += by
                    cells += by.values()
                if rows:
                    some = some.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), some.column("vec_id"), some.column("embedding"), pa.array(cells, pa.list_(pa.int32()))], names=["shard", "id", "embedding", "cells"])

    tables = Tables(spark, "ann")
    visits = tables.keep(asked.select("vec_id", "embedding").mapInArrow(walk, "shard long, id long, embedding array<double>, cells array<int>"))
    # One row a cell: at most CENTROIDS squared.
    cells = spark.createDataFrame(pd.DataFrame({"cell": np.arange(len(first)), "first": first, "parts": parts}))
    blocks = broadcast_if_small(tables.keep(visits.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))))
    dealt = entries.join(F.broadcast(cells), "cell").withColumn("shard", F.col("first") + F.pmod(F.xxhash64(F.lit(8), "vec_id"), "parts")).join(blocks, "shard")
    dealt = dealt.select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("asks"), F.col("vec_id").alias("id"), "embedding", F.array(F.col("cell").cast("int")).alias("cells"))
    going = visits.join(blocks, "shard").select("shard", F.pmod(F.xxhash64(F.lit(9), "id"), F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("asks"), "id", "embedding", "cells")
    met = dealt.unionByName(going).repartition(partitions(spark), "shard", "block").sortWithinPartitions("shard", "block", "asks")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, cell, unit_x, order = [], None, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column("shard").to_numpy(), batch.column("block").to_numpy()], 1)
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            cut = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1) | (asks[1:] != asks[:-1])) + 1), batch.num_rows]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                some, here = batch.slice(lo, hi - lo), tuple(place[lo])
                if here != now:
                    held, now, cell = [], here, None
                if not asks[lo]:
                    held.append(some)
                    continue
                if cell is None and held:  # the shard is whole: its entries by cell
                    cell = np.concatenate([b.column("cells").flatten().to_numpy() for b in held])
                    order = np.argsort(cell, kind="stable")
                    x = np.concatenate([_matrix(b.column("embedding")) for b in held])[order]
                    ids, cell, unit_x, held = np.concatenate([b.column("id").to_numpy() for b in held])[order], cell[order], unit(x), []
                if cell is None:
                    continue
                found = []
                q = _matrix(some.column("embedding"))
                unit_q = unit(q)
                for i, (own, wanted) in enumerate(zip(some.column("id").to_pylist(), some.column("cells"), strict=True)):
                    c = np.sort(wanted.values.to_numpy())
                    a, b = np.searchsorted(cell, c), np.searchsorted(cell, c, "right")
                    new = np.flatnonzero(np.concatenate([[True], a[1:] != b[:-1]]))  # neighbouring cells are one stretch
                    spans = list(zip(a[new].tolist(), b[np.append(new[1:], len(a)) - 1].tolist(), strict=True))
                    score = np.concatenate([unit_x[s:e] @ unit_q[i] for s, e in spans])
                    at = np.concatenate([np.arange(s, e) for s, e in spans])
                    other = ids[at] != own
                    at, score = at[other], score[other]
                    if len(at) > top:
                        near = score >= np.partition(score, len(at) - top)[len(at) - top] - 1e-9
                        seen, at = len(at), at[near]
                    else:
                        seen = len(at)
                    exact = cosines(x[at], q[i])
                    best = np.lexsort((ids[at], -exact))[:top]
                    found.append((own, seen, [{"vec_id": int(v), "score": float(s)} for v, s in zip(ids[at][best], exact[best], strict=True)]))
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())])))], names=["query_id", "scored", "best"])

    return met.mapInArrow(rank, "query_id long, scored long, best array<struct<vec_id: long, score: double>>")


def search(vectors: DataFrame, queries: DataFrame, top: int = TOP, shard: int = SHARD, block: int = BLOCK, index: tuple[Index | None, DataFrame] | None = None) -> DataFrame:
    """The `top` nearest found of each query (vec_id, embedding) among vectors, but for the query's own vec_id.

    Returns query_id, rank (from 1), vec_id, score: the cosine in double precision on the vectors as given; ties go to
    the smaller vec_id. Queries and vectors that usable() leaves out take no part. With fewer candidates than `top`,
    all are returned. A repeated query counts once; of several vectors of one length under one query's id the least,
    component by component, is asked. Vectors of another length aren't candidates: each length has an index of its own.
    Repeated vectors are entries of their own. Other columns don't matter.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    lengths = [r.d for r in _fine(vectors).select(F.size("embedding").alias("d")).distinct().collect()] if index is None else [index[0].dims] if index[0] else []
    found = None
    for d in sorted(lengths):
        one, entries = index or build(usable(vectors, d), top=top)
        asked = usable(queries, d).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        near = compare(entries, asked, one, top, shard, block).select("query_id", F.explode("best").alias("b")).select("query_id", "b.vec_id", "b.score")
        found = near if found is None else found.unionByName(near)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
