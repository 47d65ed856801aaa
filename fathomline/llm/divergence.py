"""Divergence of sources on a quadtree over the matrix of groups and terms.

A group is a (lang, source) with a row of the matrix; a kept term of the lang is a column. Rows lie in blocks of ROWS
groups, columns in strips of about COLUMNS terms, a power of two of them, dealt by a hash. A block's part of a strip is a
leaf, if it has a count that isn't zero; each level above halves both numbers, down to one root for each lang, and a
node is there only if one of its four quadrants is. So the tree has nonzero leaves alone, and all-zero quadrants of any size
are known by a node that isn't there.

Pairs of blocks go down the tree together. Where neither has a node for a range of columns, all of it is zero for all
their groups: such a range only adds its number of terms, and what a term is worth that neither group has is the
same for all of them, so it is priced by one product for each pair of groups. Where one of both has a node, its
quadrants are looked at in turn, and of leaves the terms are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .session import Tables, bound_batches, broadcast_if_small
from .textbytes import slices

#: Documents that keep a term, the price's unit, what is added to a count, and terms listed for a group.
LEAST, UNIT, ADDED, TOP = 10, 1_000_000_000, 2, 10
#: Groups of a block and terms of a strip, about.
ROWS, COLUMNS = 16, 4096
#: Bytes of a term, in lower case: letters, and all that isn't ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
#: Bytes of text that are counted at a time.
SLICE = 1 << 20


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each slice's groups, and in these its different terms with their occurrences and the rows that have them."""
    for batch in batches:
        for at, to, texts in slices(batch.column("text"), SLICE):
            lang, source = (batch.column(c).slice(at, to - at).dictionary_encode() for c in ("lang", "source"))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            words = texts.words(LETTERS, lower=True)
            terms, text = words.coded(), words.texts()
            code, most = terms.indices.to_numpy().astype(np.int64), max(1, len(terms.dictionary))
            unit = pa.array(group[text] * most + code).dictionary_encode()
            of, once = unit.indices.to_numpy(), unit.dictionary.to_numpy()
            n = np.bincount(of, minlength=len(once))
            docs = np.bincount(of[np.unique(text * most + code, return_index=True)[1]], minlength=len(once))
            of_group, of_term = np.divmod(once, most)
            every = np.unique(group)
            of_group = pa.array(np.concatenate([every, of_group]))
            zeros = np.zeros(len(every), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    lang.dictionary.take(pc.divide(of_group, len(source.dictionary))),
                    source.dictionary.take(pa.array(of_group.to_numpy() % len(source.dictionary))),
                    pa.concat_arrays([pa.nulls(len(every), pa.string()), terms.dictionary.take(pa.array(of_term)).cast(pa.string())]),
                    pa.array(np.concatenate([zeros, n])), pa.array(np.concatenate([zeros, docs])),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of docs (text, lang, source): occurrences of a term in a group, and rows with it; each group has a row with a null term, too."""
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    counts = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def price(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + ADDED) / (total + ADDED * terms)), exact for counts below 10**18; null without terms."""
    over = (n + ADDED).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.when(terms > 0, F.call_function("div", over, (total + ADDED * terms).cast("decimal(19,0)")) + 1)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q)): both are about UNIT at most, so that the square fits into 63 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


class Matrix:
    """The kept counts of a corpus: groups (lang, source, i, total, terms, zero), cells (lang, source, term, n, all), strips and the tree above them."""

    def __init__(self, docs: DataFrame, least: int = LEAST, rows: int = ROWS, columns: int = COLUMNS):
        self.tables, self.rows = Tables(docs.sparkSession, "divergence"), rows
        counts = self.tables.keep(term_counts(docs))
        of_term = Window.partitionBy("lang", "term")
        # Groups that have a term, at most as many rows as groups; null terms stay outside.
        kept = counts.where(F.col("term").isNotNull()).withColumns({"in_docs": F.sum("docs").over(of_term), "all": F.sum("n").over(of_term), "one": F.row_number().over(of_term.orderBy("source"))}).where(F.col("in_docs") >= least)
        self.cells = self.tables.keep(kept.select("lang", "source", "term", "n", "all", (F.col("one") == 1).alias("first")))
        langs = self.cells.groupBy("lang").agg(F.count_if("first").alias("terms"), F.sum("n").alias("lang_total"))
        sums = self.cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        names = counts.where(F.col("term").isNull()).select("lang", "source")
        # A row for each group; its number in its lang is taken in one task for each lang, as the pairs are no fewer.
        groups = names.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
        groups = groups.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
        self.groups = self.tables.keep(groups.withColumns({"zero": price(F.lit(0).cast("long"), F.col("total"), F.col("terms")), "levels": F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("terms"), F.lit(1)) / columns))).cast("int")}))

    def of_groups(self, *names: str) -> DataFrame:
        return broadcast_if_small(self.groups.select("lang", "source", *names))

    def leaves(self) -> DataFrame:
        """(lang, block, strip, cells): of each nonzero leaf the counts' (row in the block, term's number in the strip, price)."""
        cells = self.cells.join(self.of_groups("i", "total", "terms", "levels"), ["lang", "source"])
        strip = F.expr("pmod(xxhash64(term), shiftleft(1L, levels))")
        cells = cells.withColumn("strip", strip)
        column = F.dense_rank().over(Window.partitionBy("lang", "strip").orderBy("term")) - 1
        cells = cells.withColumns({"block": F.floor(F.col("i") / self.rows), "column": column, "p": price(F.col("n"), F.col("total"), F.col("terms"))})
        return cells.groupBy("lang", "block", "strip").agg(F.collect_list(F.struct((F.col("i") % self.rows).alias("row"), "column", "p")).alias("cells"))  # rows * columns at most, about

    def widths(self) -> DataFrame:
        """(lang, strip, width): the number of a strip's terms."""
        levels = F.broadcast(self.groups.select("lang", "levels").distinct())
        strip = F.expr("pmod(xxhash64(term), shiftleft(1L, levels))")
        return self.cells.where("first").join(levels, "lang").groupBy("lang", strip.alias("strip")).agg(F.count("*").alias("width"))


def _halve(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.shiftright(c, 1) for c in columns})


def traverse(nodes: DataFrame, widths: DataFrame, last: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(met, free) of leaves (lang, block, strip), of strips (lang, strip, width) and of each lang's last block (lang, last).

    met (lang, a, b, strip): the pairs of blocks a <= b of which one has a leaf at the strip. free (lang, a, b, terms): of each
    pair of blocks the terms in ranges where neither has a node. Level by level from the root; a level's
    frontier has the pairs whose parents had a node.
    """
    spread = last.agg(F.max("last")).first()[0] or 0, widths.agg(F.max("strip")).first()[0] or 0
    depth = max(int(x).bit_length() for x in spread)
    levels, wide = [nodes], [widths]
    for _ in range(depth):
        levels.append(tables.keep(_halve(levels[-1], "block", "strip").distinct()))
        wide.append(tables.keep(_halve(wide[-1], "strip").groupBy("lang", "strip").agg(F.sum("width").alias("width"))))
    frontier = levels[-1].select("lang", F.col("block").alias("a"), F.col("block").alias("b"), "strip")
    priced = last.select("lang", F.lit(depth).alias("level"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("terms"))
    for level in range(depth - 1, -1, -1):
        # The four quadrants of each of the two nodes: both halves of the columns, and each half of one's rows with each of the other's.
        half = lambda c: F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1)).alias(c)
        pairs = frontier.select("lang", "a", "b", half("strip")).select("lang", "strip", "b", half("a")).select("lang", "strip", "a", half("b")).where("a <= b")
        pairs = pairs.join(wide[level], ["lang", "strip"]).join(broadcast_if_small(last), "lang").where(F.col("b") <= F.shiftright("last", level))
        here = levels[level].select("lang", "strip", F.col("block").alias("a"), F.lit(True).alias("has_a"))
        there = levels[level].select("lang", "strip", F.col("block").alias("b"), F.lit(True).alias("has_b"))
        pairs = tables.keep(pairs.join(here, ["lang", "strip", "a"], "left").join(there, ["lang", "strip", "b"], "left").select("lang", "a", "b", "strip", "width", F.coalesce("has_a", "has_b").alias("some")))
        none = pairs.where("some IS NULL").select("lang", F.lit(level).alias("level"), "a", "b", F.col("width").alias("terms"))
        priced = priced.unionByName(none)
        frontier = pairs.where("some").select("lang", "a", "b", "strip")
    # A range priced at a level belongs to all pairs of blocks below its two.
    priced = tables.keep(priced.groupBy("lang", "level", "a", "b").agg(F.sum("terms").alias("terms")))
    blocks = last.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("a"), "last").select("lang", "a", F.explode(F.sequence("a", "last")).alias("b"))
    above = blocks.select("lang", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"))
    up = lambda c: F.expr(f"shiftright({c}, level)")
    above = above.select("lang", "level", F.col("a").alias("block_a"), F.col("b").alias("block_b"), up("a").alias("a"), up("b").alias("b"))
    return frontier, above.join(priced, ["lang", "level", "a", "b"]).groupBy("lang", F.col("block_a").alias("a"), F.col("block_b").alias("b")).agg(F.sum("terms").alias("terms"))


def _compare(size: int):
    """mapInArrow function: (lang, a, b, width, left, right) to the sums of gaps of each pair of groups over the strip's terms that one of both has, and the number of the others."""

    def dense(cells, zero: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        p, has = np.repeat(zero[:, None], width, 1), np.zeros((len(zero), width), bool)
        if cells.is_valid:
            row, column, price = (cells.values.field(k).to_numpy() for k in ("row", "column", "p"))
            p[row, column], has[row, column] = price, True
        return p, has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("i", "j", "value", "zeros")}
            langs = []
            for r in range(batch.num_rows):
                lang, a, b, width = (batch.column(c)[r].as_py() for c in ("lang", "a", "b", "width"))
                zeros = [np.array(batch.column(c)[r].as_py(), np.int64) for c in ("zero_a", "zero_b")]
                (p, has_p), (q, has_q) = (dense(batch.column(c)[r], z, width) for c, z in zip(("left", "right"), zeros, strict=True))
                for i in range(len(p)):
                    either = has_p[i] | has_q
                    value = np.where(either, (p[i] - q) ** 2 // (p[i] + q), 0).sum(1)
                    n = width - either.sum(1)
                    j = np.arange(len(q)) if a != b else np.arange(i + 1, len(q))
                    if len(j):
                        out["i"].append(np.full(len(j), a * size + i)), out["j"].append(b * size + j), out["value"].append(value[j]), out["zeros"].append(n[j])
                        langs += [lang] * len(j)
            if langs:
                yield pa.RecordBatch.from_arrays([pa.array(langs), *(pa.array(np.concatenate(v)) for v in out.values())], names=["lang", *out])

    return run


def pair_values(m: Matrix) -> DataFrame:
    """(lang, i, j, value): the sum of gaps of each two groups i < j of a lang over all its kept terms."""
    leaves = m.tables.keep(m.leaves())
    widths = m.tables.keep(m.widths())
    size, groups = m.rows, m.groups.where("terms > 0")
    last = m.tables.keep(groups.groupBy("lang").agg(F.floor(F.max("i") / size).alias("last")))
    met, free = traverse(leaves.select("lang", "block", "strip"), widths, last, m.tables)
    blocks = m.tables.keep(groups.groupBy("lang", F.floor(F.col("i") / size).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "zero"))), lambda x: x["zero"]).alias("zero")))
    side = lambda c, cells: leaves.withColumnsRenamed({"block": c, "cells": cells})
    zeros = lambda c: broadcast_if_small(blocks.withColumnsRenamed({"block": c, "zero": f"zero_{c}"}))
    work = met.join(widths, ["lang", "strip"]).join(side("a", "left"), ["lang", "strip", "a"], "left").join(side("b", "right"), ["lang", "strip", "b"], "left")
    work = work.join(zeros("a"), ["lang", "a"]).join(zeros("b"), ["lang", "b"]).select("lang", "a", "b", "width", "left", "right", "zero_a", "zero_b")
    compared = work.mapInArrow(_compare(size), "lang string, i long, j long, value long, zeros long").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"), F.sum("zeros").alias("zeros"))
    zero = groups.select("lang", "i", "zero")
    every = zero.withColumnRenamed("zero", "zi").join(zero.withColumnsRenamed({"i": "j", "zero": "zj"}), "lang").where("i < j")  # the pairs that the result has
    every = every.join(compared, ["lang", "i", "j"], "left").withColumns({"a": F.floor(F.col("i") / size), "b": F.floor(F.col("j") / size)}).join(free, ["lang", "a", "b"], "left")
    unmet = F.coalesce("zeros", F.lit(0)) + F.coalesce("terms", F.lit(0))
    return every.select("lang", "i", "j", (F.coalesce("value", F.lit(0)) + unmet * gap(F.col("zi"), F.col("zj"))).alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, rows: int = ROWS, columns: int = COLUMNS) -> DataFrame:
    """lang, source, part, item, value, rank of docs (text, lang, source; other columns don't matter).

    Part `pair`: how far each other source of the lang (item) lies from the group, by the sum of gaps of their prices over
    all kept terms; all ranks. Part `term`: the terms that the group has and that are worth more in it than in the lang, by
    their gap; the first `top`. Kept: terms in at least `least` rows of the lang. Ranks are by value, the largest first,
    then by item's bytes. Null texts, langs and sources are empty strings; repeated rows count each; a
    group without terms has its pairs, too, and where no term is kept all values are 0. An empty table has no rows;
    a lang with one source has no pairs. Texts are read whole, however long.
    """
    bound_batches(docs.sparkSession)
    m = Matrix(docs, least, rows, columns)
    names = lambda c, n: broadcast_if_small(m.groups.select("lang", F.col("i").alias(c), F.col("source").alias(n)))
    one = m.tables.keep(pair_values(m)).join(names("i", "x"), ["lang", "i"]).join(names("j", "y"), ["lang", "j"])
    both = one.select("lang", F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item")))).alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    # Langs that keep no term have no matrix.
    bare = m.groups.where("terms = 0").select("lang", "source")
    empty = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    priced = m.cells.join(m.of_groups("total", "terms", "lang_total"), ["lang", "source"]).withColumns({"p": price(F.col("n"), F.col("total"), F.col("terms")), "q": price(F.col("all"), F.col("lang_total"), F.col("terms"))})
    more = priced.where("n > 0 AND p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).cast("int").alias("rank")
    ranked = both.unionByName(empty).select("*", rank)
    best = more.select("*", rank).where(F.col("rank") <= top)
    return ranked.unionByName(best)
