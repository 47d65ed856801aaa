"""A kept inverted index: posting blocks in buckets of terms, searched by their bounds.

Documents are dealt to slots of about BLOCK by a hash of their key. A block has what one term has in one slot: the keys,
as distances from the least where they are whole numbers, each one's places, and the most places that one has. The table is
partitioned by a hash of the term and sorted by term and slot, so a search reads the folders of its terms' buckets,
and in these the row groups whose range holds its terms.

A search takes the blocks' bounds first, without their places: a document's score can't exceed the number of clauses times
the fewest places that one of them has in its slot. The slots with the best bounds are scored; what the k-th of
their documents reaches decides which others can still matter, and only these are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.stems import stem as english_stem, stemmed
from ..functions.text import tokens
from ..session import broadcast_if_small, written
from .merge import top_k
from .retrieval import query_terms, score_hits

#: Documents of a slot, about; folders of the table; slots of a query that are scored before bounds are compared.
BLOCK, BUCKETS, FIRST = 512, 64, 4
#: Bytes of text of a slot, about; slots of a task that makes their blocks; slots of a file.
SLOT_BYTES, TASK_SLOTS, FILE_SLOTS = 4 << 20, 8, 2048
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def build(rows: DataFrame, key: str, text: str, path: str, block: int = BLOCK, buckets: int = BUCKETS, stem: bool = False) -> DataFrame:
    """Write the index of rows (key, text) below `path` and read it: bucket, term, slot, docs, best, base, keys, places.

    Rows of one key are one document. Rows with a null key can't be found and are left out; null texts have no terms.
    With `stem` the terms are English stems, and searches have to say so too. Texts are exchanged once, to their slots, and
    the blocks that a slot's words make once more, to their folders; words aren't exchanged one by one.
    """
    spark, kind = rows.sparkSession, rows.schema[key].dataType
    rows = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    slots = max(1, -(-size.n // block), -(-size.bytes // SLOT_BYTES))
    slot = F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(slots)).cast("int")
    # Texts move, not their words: these are found in the slot's task. A fixed number of tasks, so that none gets many slots.
    dealt = rows.withColumn("slot", slot).repartition(max(-(-slots // TASK_SLOTS), min(slots, spark.sparkContext.defaultParallelism)), "slot")
    schema = T.StructType([T.StructField("term", T.StringType()), *T.StructType.fromDDL("slot int, docs int, best int"), T.StructField("base", kind), T.StructField("keys", T.ArrayType(kind)), *T.StructType.fromDDL("places array<array<int>>")])
    blocks = dealt.select("slot", "key", tokens(F.col("text")).alias("words")).groupBy("slot").applyInArrow(_blocks(schema, stem), schema)
    table = blocks.select(_bucket(buckets).alias("bucket"), *schema.names)
    # A folder's blocks are cut by slots, so that a file doesn't grow with the table.
    pieces = -(-slots // FILE_SLOTS)
    order = ["bucket", "term", "slot"]
    table.repartition(buckets * pieces, "bucket", F.floor(F.col("slot") / FILE_SLOTS)).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def _blocks(schema: T.StructType, stem: bool):
    """applyInArrow function: the blocks of one slot's rows (slot, key, words)."""
    whole = isinstance(schema["base"].dataType, _WHOLE)
    out = to_arrow_schema(schema)

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        group = group.take(pc.sort_indices(group["key"])).combine_chunks()
        lists = group["words"].combine_chunks().fill_null([])
        code = lists.flatten().dictionary_encode()
        if not len(code):
            return out.empty_table()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        key = group["key"].combine_chunks()
        # The document of each row: rows of one key have one.
        new = np.concatenate([[True], pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)])
        first, doc = np.flatnonzero(new), np.cumsum(new) - 1
        start = np.cumsum(sizes) - sizes
        pos = np.arange(len(code)) - np.repeat(start, sizes)
        terms, at = code.dictionary, code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if stem:
            stemmed_ = pa.array([english_stem(w) for w in terms.to_pylist()], pa.string()).dictionary_encode()
            terms, at = stemmed_.dictionary, stemmed_.indices.to_numpy(zero_copy_only=False).astype(np.int64)[at]
        pair = at * len(first) + np.repeat(doc, sizes)
        order = np.lexsort((pos, pair)) if len(first) < len(key) else np.argsort(pair, kind="stable")
        pair, pos = pair[order], pos[order]
        entry = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))  # a term in a document
        count = np.diff(np.append(entry, len(pair)))
        term, inside = pair[entry] // len(first), pair[entry] % len(first)
        head = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))  # a term
        docs = np.diff(np.append(head, len(entry)))
        places = pa.ListArray.from_arrays(pa.array(np.append(entry, len(pair)), pa.int32()), pa.array(pos, pa.int32()))
        cut = pa.array(np.append(head, len(entry)), pa.int32())
        keys = key.take(pa.array(first[inside]))
        base = keys.take(pa.array(head))
        if whole:
            number = keys.to_numpy(zero_copy_only=False)
            keys = pa.array(number - np.repeat(number[head], docs), keys.type)
        columns = [terms.take(pa.array(term[head])), group["slot"].combine_chunks().take(pa.array(np.zeros(len(head), np.int64))), pa.array(docs, pa.int32()), pa.array(np.maximum.reduceat(count, head), pa.int32()), base, pa.ListArray.from_arrays(cut, keys), pa.ListArray.from_arrays(cut, places)]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return run


def bounds(terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, slot, bound): the slots that have all clauses of a query, and what a document's score there can reach."""
    hit = blocks.select("term", "slot", "best").join(terms.where("NOT negative"), "term")
    alts = hit.groupBy("query_id", "slot", "clause", "alt", "length").agg(F.count_distinct("word").alias("n"), F.min("best").alias("most")).where("n = length")
    clauses = alts.groupBy("query_id", "slot", "clause").agg(F.sum("most").alias("most"))
    need = terms.where("NOT negative").groupBy("query_id").agg(F.count_distinct("clause").alias("need"))
    have = clauses.groupBy("query_id", "slot").agg(F.count("*").alias("have"), F.min("most").alias("most"))
    return have.join(broadcast_if_small(need), "query_id").where("have = need").select("query_id", "slot", (F.col("have") * F.col("most")).cast("double").alias("bound"))


def of_terms(index: DataFrame, terms: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The blocks of the buckets that the terms lie in: other folders aren't read."""
    buckets = [r.b for r in terms.select(_bucket(buckets).alias("b")).distinct().collect()]  # each folder once at most
    return index.where(F.col("bucket").isin(buckets))


def search(index: DataFrame, queries: DataFrame, key: str, k: int, allowed: DataFrame | None = None, first: int = FIRST, buckets: int = BUCKETS, stem: bool = False) -> DataFrame:
    """(query_id, key, score, rank): the same as lexical_search() over all postings, from the blocks of build().

    allowed (query_id, key) restricts what a query may find, before ranking. `buckets` and `stem` are those of build().
    """
    terms = query_terms(queries)
    terms = written(stemmed(terms, "term") if stem else terms, "terms")
    here = of_terms(index, terms, buckets)
    sent = broadcast_if_small(terms)
    slots = written(bounds(sent, here).withColumn("order", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "slot"))), "bounds")
    if allowed is not None:
        allowed = allowed.select("query_id", F.col(key).alias("key")).distinct()
    whole = isinstance(index.schema["keys"].dataType.elementType, _WHOLE)
    one_key = (F.col("base") + F.col("key")) if whole else F.col("key")

    def score(wanted: DataFrame) -> DataFrame:
        hit = here.join(sent, "term").join(broadcast_if_small(wanted.select("query_id", "slot")), ["query_id", "slot"])
        docs = hit.select("query_id", "clause", "alt", "negative", "length", "word", "term", "base", F.explode(F.arrays_zip(F.col("keys").alias("key"), F.col("places").alias("places"))).alias("e"))
        docs = docs.select("query_id", "clause", "alt", "negative", "length", "word", "base", F.col("e.key").alias("key"), F.col("e.places").alias("places")).withColumn("key", one_key)
        if allowed is not None:
            docs = docs.join(allowed, ["query_id", "key"], "left_semi")
        return score_hits(docs.withColumn("pos", F.explode("places")), terms, "key")

    best = written(score(slots.where(F.col("order") <= first)), "best")
    reached = top_k(best, ["query_id"], [F.desc("score"), F.col("key")], k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = slots.where(F.col("order") > first).join(broadcast_if_small(reached), "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-9))
    found = best.unionByName(score(written(rest.select("query_id", "slot"), "rest")))
    return top_k(found, ["query_id"], [F.desc(F.round("score", 9)), F.col("key")], k).withColumnRenamed("key", key)
