"""A kept vector index: coarse cells, product-quantised residuals, and exact ranks for the best of them.

Vectors are taken at length one. A cell is what lies nearest to one of CELLS centroids; of each vector the index keeps its
cell and, for each part of what is left after the centroid, the number of the nearest entry of that part's book. A query
looks at its nearest cells: an entry's score is the query's product with the cell's centroid plus, for each part, a
number read from a small table of the query's products with the books. The best DEEP are compared exactly.

Centroids and books are fitted on at most FIT_ROWS vectors, taken by a hash. How many cells a query looks at is measured on
PROBES vectors of the corpus: so many that COVER of their true neighbours lie in them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import written
from .merge import top_k
from .retrieval import cosine, dense_search, sound

#: Cells at most, parts of a vector, entries of a book.
CELLS, PARTS, BOOK = 256, 16, 32
#: Vectors for a cell of the fit, vectors of the fit and of the measurement at most, and the share of neighbours to be looked at.
PER_CELL, FIT_ROWS, PROBES, COVER = 40, 20_000, 100, 0.97
#: Entries of a block of a cell, queries that meet one together, and candidates of a query that are compared exactly.
BLOCK, TOGETHER, DEEP = 4_096, 256, 100


@dataclass
class Index:
    """The fitted model and its blocks (cell, ids, codes); `probe` cells hold `share` of all entries."""

    coarse: np.ndarray
    books: list[np.ndarray]
    blocks: DataFrame
    probe: int = 1
    share: float = 1.0


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k means of the rows, at most as many as differ; one that loses its rows stays where it is."""
    different = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centres = different[rng.permutation(len(different))[:k]]
    for _ in range(rounds if len(different) > k else 0):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, x[:, i], len(centres)) for i in range(x.shape[1])], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.argmax(x[a : a + 4096] @ centres.T - half, axis=1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def build(corpus: DataFrame, k: int = 10, cells: int = CELLS, parts: int = PARTS, book: int = BOOK) -> Index | None:
    """The index of corpus (vec_id, embedding); null where no vector has a direction. All vectors have one length; others fail.

    Repeated vectors are entries of their own.
    """
    spark = corpus.sparkSession
    rows = written(corpus.where(sound("embedding")).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")), "vectors")
    sample = written(rows.orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(FIT_ROWS), "fit")
    taken = sample.count()
    if not taken:
        return None
    cells = max(1, min(cells, taken // PER_CELL))
    # The fit is a few small tasks over the bounded sample: the centroids, then each part's book.
    coarse = sample.select("embedding").groupBy().applyInArrow(lambda t: pa.table({"c": list(_means(_unit(_matrix(t.column("embedding").combine_chunks())), cells))}), "c array<double>")
    coarse = np.array([r.c for r in coarse.collect()])  # `cells` rows
    sent = spark.sparkContext.broadcast(coarse)
    cuts = np.array_split(np.arange(coarse.shape[1]), min(parts, coarse.shape[1]))

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_matrix(batch.column("embedding")))
            x = x - sent.value[_nearest(x, sent.value)]
            for p, cut in enumerate(cuts):
                yield pa.RecordBatch.from_pydict({"part": pa.array([p] * len(x), pa.int32()), "x": list(x[:, cut])})

    def of_part(t: pa.Table) -> pa.Table:
        means = _means(_matrix(t.column("x").combine_chunks()), book)
        return pa.table({"part": pa.array([t.column("part")[0].as_py()] * len(means), pa.int32()), "entry": pa.array(range(len(means)), pa.int32()), "c": list(means)})

    found = sample.select("embedding").mapInArrow(residuals, "part int, x array<double>").groupBy("part").applyInArrow(of_part, "part int, entry int, c array<double>").collect()  # parts * book rows
    books = [np.array([r.c for r in sorted((r for r in found if r.part == p), key=lambda r: r.entry)]) for p in range(len(cuts))]
    model = spark.sparkContext.broadcast((coarse, books, cuts))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coarse, books, cuts = model.value
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column("embedding")))
                cell = _nearest(x, coarse)
                x = x - coarse[cell]
                codes = np.stack([_nearest(x[:, cut], b) for cut, b in zip(cuts, books, strict=True)], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["cell", "vec_id", "codes"])

    coded = written(rows.mapInArrow(encode, f"cell int, vec_id {rows.schema['vec_id'].dataType.simpleString()}, codes binary"), "codes")
    # A cell with many entries, whatever their likeness, is many blocks.
    sizes = coded.groupBy("cell").agg(F.count("*").alias("n"))
    counts = {r.cell: r.n for r in sizes.collect()}  # `cells` rows
    part = F.pmod(F.xxhash64(F.lit(9), "vec_id", F.monotonically_increasing_id()), F.ceil(F.col("n") / BLOCK).cast("int"))
    blocks = coded.join(F.broadcast(sizes), "cell").groupBy("cell", part.alias("part")).agg(F.collect_list(F.struct("vec_id", "codes")).alias("e"))
    index = Index(coarse, books, written(blocks.select("cell", F.col("e.vec_id").alias("ids"), F.col("e.codes").alias("codes")), "blocks"))

    # How many cells hold the neighbours?
    asked = sample.orderBy(F.xxhash64(F.lit(6), "vec_id"), "vec_id").limit(PROBES).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    near = dense_search(asked, rows, k).select("query_id", "vec_id").join(asked, "query_id").join(coded.select("vec_id", "cell"), "vec_id").select("vector", "cell").collect()  # PROBES * k rows, and repeated ids
    if near:
        q, own = _unit(np.array([r.vector for r in near])), np.array([r.cell for r in near])
        product = q @ coarse.T - (coarse * coarse).sum(1) / 2
        rank = (product > product[np.arange(len(q)), own][:, None]).sum(1) + 1
        index.probe = int(np.quantile(rank, COVER, method="higher"))
        order = np.argsort(-product, axis=1)[:, : index.probe]
        have = np.array([counts.get(c, 0) for c in range(len(coarse))])
        index.share = float(have[order].sum(1).mean() / have.sum())
    return index


def search(queries: DataFrame, corpus: DataFrame, index: Index, k: int, probe: int | None = None, deep: int = DEEP, match: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Approximate: (query_id, vec_id, score, rank) of queries (query_id, vector), the exact cosine of the best that the cells looked at have.

    A query doesn't find the vector of its own id; queries without a direction find nothing. match, of two tables (query_id,
    label) and (vec_id, label), restricts a query to vectors of its label, before any are ranked.
    """
    each = BLOCK * 4 if match else deep  # then all entries of a block are told
    spark, probe = queries.sparkSession, probe or index.probe
    sent = spark.sparkContext.broadcast((index.coarse, index.books, np.array_split(np.arange(index.coarse.shape[1]), len(index.books))))
    asked = queries.where(sound("vector")).select("query_id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    kind = asked.schema["query_id"].dataType.simpleString()

    def nearest_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coarse, _, _ = sent.value
        for batch in batches:
            if batch.num_rows:
                q = _unit(_matrix(batch.column("vector")))
                cell = np.argsort(-(q @ coarse.T - (coarse * coarse).sum(1) / 2), axis=1, kind="stable")[:, :probe]
                row = pa.array(np.repeat(np.arange(len(q)), cell.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(cell.ravel().astype(np.int32)), batch.column("query_id").take(row), batch.column("vector").take(row)], names=["cell", "query_id", "vector"])

    visits = asked.mapInArrow(nearest_cells, f"cell int, query_id {kind}, vector array<double>")
    # Queries meet a cell's blocks in groups of about TOGETHER, however many there are.
    groups = max(1, -(-asked.count() // TOGETHER))
    visits = visits.groupBy("cell", F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("group")).agg(F.collect_list(F.struct("query_id", "vector")).alias("q"))
    met = index.blocks.join(visits.select("cell", F.col("q.query_id").alias("asking"), F.col("q.vector").alias("vectors")), "cell")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coarse, books, cuts = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids, asking = batch.column("ids")[i].values, batch.column("asking")[i].values
                codes = np.frombuffer(b"".join(batch.column("codes")[i].as_py()), np.uint8).reshape(len(ids), len(books))
                q = _unit(np.array(batch.column("vectors")[i].as_py()))
                score = np.repeat((q @ coarse[batch.column("cell")[i].as_py()])[:, None], len(ids), 1)
                for p, (cut, book) in enumerate(zip(cuts, books, strict=True)):
                    score += (q[:, cut] @ book.T)[:, codes[:, p]]
                score[np.array(asking.to_pylist(), object)[:, None] == np.array(ids.to_pylist(), object)[None]] = -np.inf
                n = min(each, len(ids))
                top = np.argpartition(-score, n - 1, axis=1)[:, :n]
                row = np.repeat(np.arange(len(q)), n)
                yield pa.RecordBatch.from_arrays([asking.take(pa.array(row)), ids.take(pa.array(top.ravel())), pa.array(score[row, top.ravel()])], names=["query_id", "vec_id", "near"])

    near = met.select("cell", "ids", "codes", "asking", "vectors").mapInArrow(best, f"query_id {kind}, vec_id {corpus.schema['vec_id'].dataType.simpleString()}, near double").where("near > double('-infinity')")
    if match:
        near = near.join(match[0].select("query_id", "label"), "query_id").join(match[1].select("vec_id", F.col("label").alias("_own")), "vec_id").where("label = _own")
    few = top_k(near, ["query_id"], [F.desc("near"), F.col("vec_id")], deep).select("query_id", "vec_id").distinct()
    exact = few.join(asked, "query_id").join(corpus.where(sound("embedding")).select("vec_id", "embedding"), "vec_id").select("query_id", "vec_id", cosine("embedding", "vector").alias("score"))
    return top_k(exact, ["query_id"], [F.desc("score"), F.col("vec_id")], k)
