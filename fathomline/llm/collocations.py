"""Phrase collocations by the layout of external stream estimation.

Phrases of one to three words are counted, shortest first: a task counts the different ones of a slice of text exactly,
by dictionary codes, then Spark adds the slices up. Longer phrases are counted where the shorter ones in them are
frequent enough, as theirs can't be more, and pairs where their hashes are, which are counted first; filters of a bounded
number of bits say so, and what they let through in error only costs work.

The counts then are one stream, kept twice: sorted by the words from the last to the first (suffix order), then from
the first to the last (prefix order). In either order a phrase comes right after the shorter ones that it ends with, or
starts with, so one pass over a sorted range, with the last counts of one and of two words at hand, gives each phrase
the counts of its right parts, then of its left parts, and each pair the longer phrases that hold it. Nothing is looked
up by hash. Ranges are cut by whole phrases, so a frequent word is no partition's own: what a range needs from those
before it are their last counts, a row for each range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .session import Tables, bound_batches, broadcast_if_small, partitions
from .textbytes import _BASES, U, Texts, _ranges, mix, slices

#: Occurrences that make a candidate; candidates of a lang that are reported; percent of a phrase's occurrences in one longer candidate that drop it.
LEAST, TOP, INSIDE = 10, 2000, 50
#: Bits of a filter: 16 for each frequent phrase, at least 2**16 and at most 2**29 (64 MB, the bound of what is broadcast).
FILTER_BITS = (16, 29)
#: Bytes of text that are coded at a time.
SLICE = 1 << 20
#: Parts in which a filter is put together.
PARTS_BITS = 6

_inside = np.ones(256, bool)
_ends = np.zeros(256, bool)
_ends[[*b".,;:!?\x0a\x0b\x0c\x0d"]] = True
_inside[[0x20, 0x09, *b".,;:!?\x0a\x0b\x0c\x0d"]] = False


class Slice:
    """A slice's words as codes of (lang, word): code, follows (the next word is in the same piece), and of each code its lang and word."""

    def __init__(self, texts: Texts, langs: pa.Array):
        words = texts.words(_inside, lower=True)
        n = len(words)
        inside = _inside[words.data]
        offsets = np.concatenate([[0], np.cumsum(words.ends - words.starts)])
        column = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(words.data[inside])).dictionary_encode()
        lang, text = langs.dictionary_encode(), words.texts()
        both = pa.array(lang.indices.to_numpy()[text].astype(np.int64) * max(1, len(column.dictionary)) + column.indices.to_numpy()).dictionary_encode()
        of_lang, of_word = np.divmod(both.dictionary.to_numpy(), max(1, len(column.dictionary)))
        self.code, self.lang, self.word = both.indices.to_numpy().astype(np.int64), lang.dictionary.take(pa.array(of_lang)), column.dictionary.take(pa.array(of_word))
        piece = np.concatenate([[0], np.cumsum(_ends[words.data])])[words.starts]
        self.follows = np.zeros(n, bool)
        self.follows[:-1] = (text[1:] == text[:-1]) & (piece[1:] == piece[:-1])

    def hashes(self) -> np.ndarray:
        return _hash([self.lang, self.word])


def _hash(columns: list[pa.Array]) -> np.ndarray:
    """A hash of each row's strings."""
    out = np.zeros(len(columns[0]), U)
    for c in columns:
        c = c.cast(pa.large_string())
        _, offsets, data = c.buffers()
        at = np.frombuffer(offsets, np.int64)[c.offset : c.offset + len(c) + 1]
        letters = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(c) else np.zeros(0, np.uint8)
        at = at - at[0] if len(c) else at
        out = mix(out * U(_BASES[1]) + _ranges(letters.astype(U) + U(1), at[:-1], at[1:], _BASES[0])) if len(c) else out
    return out


def _pair_hash(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return mix(one * U(_BASES[1]) + two)


def _count(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different codes, how often each occurs, and the place of each entry among them."""
    coded = pa.array(codes).dictionary_encode()
    at = coded.indices.to_numpy().astype(np.int64)
    once = coded.dictionary.to_numpy()
    return once, np.bincount(at, minlength=len(once)), at


def _counts(docs: DataFrame, size: int, found: Callable[[Slice], tuple[list[np.ndarray], np.ndarray]]) -> DataFrame:
    """(lang, w1 to w`size`, a): phrases of `size` words and their occurrences. `found` gives codes of the words of a slice's different phrases, and their counts."""
    names = ["lang", *(f"w{i + 1}" for i in range(size)), "a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, texts in slices(batch.column("text"), SLICE):
                s = Slice(texts, batch.column("lang").slice(at, to - at))
                codes, n = found(s)
                if len(n):
                    columns = [s.lang.take(first := pa.array(codes[0])), s.word.take(first), *(s.word.take(pa.array(c)) for c in codes[1:])]
                    yield pa.RecordBatch.from_arrays([*(c.cast(pa.string()) for c in columns), pa.array(n.astype(np.int64))], names=names)

    rows = docs.mapInArrow(run, ", ".join(f"{c} string" for c in names[:-1]) + ", a long")
    return rows.groupBy(*names[:-1]).agg(F.sum("a").alias("a"))


def _hashes(rows: DataFrame, words: list[str]) -> DataFrame:
    """h: of each row (lang and one or two words) the hash that Slice gives its phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [_hash([batch.column("lang"), batch.column(w)]) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array((each[0] if len(each) == 1 else _pair_hash(*each)).view(np.int64))], names=["h"])

    return rows.select("lang", *words).mapInArrow(run, "h long")


def _filter(rows: DataFrame):
    """Broadcast (bits, bytes): the filter of the hashes h of the rows of a written table; 64 MB at most, whatever the data."""
    spark = rows.sparkSession
    bits = min(max((16 * rows.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    size = 1 << (bits - PARTS_BITS)

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            part, slot = np.divmod((batch.column("h").to_numpy().view(U) >> U(64 - bits)).astype(np.int64), size)
            for p in np.unique(part).tolist():
                parts.setdefault(p, np.zeros(size, bool))[slot[part == p]] = True
        for p, f in parts.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "bits": [np.packbits(f).tobytes()]})

    by_part = rows.select("h").repartition(min(partitions(spark), 1 << PARTS_BITS), F.shiftrightunsigned("h", 64 - PARTS_BITS))
    whole = np.zeros(1 << (bits - 3), np.uint8)
    for r in by_part.mapInArrow(flags, "part int, bits binary").collect():  # 2**PARTS_BITS rows
        whole[r.part * size // 8 : (r.part + 1) * size // 8] = np.frombuffer(r.bits, np.uint8)
    return spark.sparkContext.broadcast((bits, whole.tobytes()))


def _in(sent, h: np.ndarray) -> np.ndarray:
    bits, flags = sent.value
    slot = (h >> U(64 - bits)).astype(np.int64)
    return ((np.frombuffer(flags, np.uint8)[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1).astype(bool)


def phrase_counts(docs: DataFrame, least: int = LEAST, tables: Tables | None = None) -> tuple[DataFrame, DataFrame]:
    """All words (lang, w1, a), and phrases of two and three words (lang, w1, w2, w3, a) that occur at least `least` times."""
    tables = tables or Tables(docs.sparkSession, "counts")
    bound_batches(docs.sparkSession)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where(F.col("text").isNotNull())

    def single(s: Slice):
        return [np.arange(len(s.word))], np.bincount(s.code, minlength=len(s.word))

    words = tables.keep(_counts(rows, 1, single))
    frequent = _filter(tables.keep(_hashes(words.where(F.col("a") >= least), ["w1"])))

    def pairs_of(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of pairs of frequent words, the different pairs as code * codes + code, their counts, each place's pair, and the pairs' hashes."""
        h = s.hashes()
        often = _in(frequent, h)[s.code]
        first = np.flatnonzero(s.follows[:-1] & often[:-1] & often[1:]) if len(s.code) else np.zeros(0, np.int64)
        once, n, at = _count(s.code[first] * len(s.word) + s.code[first + 1])
        one, two = np.divmod(once, max(1, len(s.word)))
        return first, once, n, at, _pair_hash(h[one], h[two])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, texts in slices(batch.column("text"), SLICE):
                _, _, n, _, h = pairs_of(Slice(texts, batch.column("lang").slice(at, to - at)))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    # Pairs' hashes are counted first: most pairs of frequent words are rare, and needn't be counted as words.
    likely = _filter(tables.keep(rows.mapInArrow(hashed, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h")))

    def double(s: Slice):
        _, once, n, _, h = pairs_of(s)
        keep = _in(likely, h)
        return list(np.divmod(once[keep], max(1, len(s.word)))), n[keep]

    pairs = tables.keep(_counts(rows, 2, double).where(F.col("a") >= least))
    often_two = _filter(tables.keep(_hashes(pairs, ["w1", "w2"])))

    def triple(s: Slice):
        first, once, _, at, h = pairs_of(s)
        words = max(1, len(s.word))
        good = _in(often_two, h)[at]
        first, at = first[good], at[good]
        run = np.flatnonzero(first[1:] == first[:-1] + 1)  # this pair's second word starts the next pair
        both, n, _ = _count(at[run] * words + s.code[first[run] + 2])
        pair, last = np.divmod(both, words)
        one, two = np.divmod(once, words)
        return [one[pair], two[pair], last], n

    triples = tables.keep(_counts(rows, 3, triple).where(F.col("a") >= least))
    for b in (frequent, likely, often_two):
        b.unpersist()
    return words, pairs.select("lang", "w1", "w2", F.lit(None).cast("string").alias("w3"), "a").unionByName(triples)


def _lockstep(schema: list[str], one: str, two: str):
    """mapInArrow function over a sorted range: for each phrase the last counts of one word and of two before it, and at the end those that the range leaves to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last = {1: None, 2: None}
        for batch in batches:
            if not batch.num_rows:
                continue
            size, a = batch.column("size").to_numpy(), batch.column("a").to_numpy()
            made = {}
            for k in (1, 2):
                at = np.maximum.accumulate(np.where(size == k, np.arange(len(size)), -1))
                value = np.where(at >= 0, a[np.maximum(at, 0)], last[k] or 0)
                made[k] = pa.array(value, pa.int64(), mask=(at < 0) & (last[k] is None))
                if at[-1] >= 0:
                    last[k] = int(a[at[-1]])
            columns = {c: batch.column(c) for c in schema} | {one: made[1], two: made[2], "part": pa.array([part] * len(size), pa.int32())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        types = {c: pa.string() if c in ("lang", "w1", "w2", "w3") else pa.int64() for c in schema}
        end = {c: pa.nulls(1, t) for c, t in types.items()} | {"size": pa.array([0], pa.int64()), one: pa.array([last[1]], pa.int64()), two: pa.array([last[2]], pa.int64()), "part": pa.array([part], pa.int32())}
        yield pa.RecordBatch.from_arrays(list(end.values()), names=list(end))

    return run


def _pass(stream: DataFrame, order: list[Column], one: str, two: str, tables: Tables) -> DataFrame:
    """stream (lang, w1, w2, w3, size, a and more) sorted by lang and `order`, with the columns one and two: the counts of the phrases of one word and of two that come before in the same order."""
    names = stream.columns
    keys = [F.col("lang"), *(c.asc_nulls_first() for c in order)]
    ranges = stream.repartitionByRange(partitions(stream.sparkSession), *keys).sortWithinPartitions(*keys)
    kinds = ", ".join(f"{c} {'string' if c in ('lang', 'w1', 'w2', 'w3') else 'long'}" for c in [*names, one, two])
    made = tables.keep(ranges.mapInArrow(_lockstep(names, one, two), f"{kinds}, part int"))
    # What each range gets from those before it: a row for each range.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = made.where("size = 0").select(F.col("part").alias("_p"), F.last(one, True).over(before).alias("_one"), F.last(two, True).over(before).alias("_two"))
    fixed = made.where("size > 0").join(F.broadcast(carried), F.col("part") == F.col("_p"))
    return fixed.select(*names, F.coalesce(one, "_one").alias(one), F.coalesce(two, "_two").alias(two))


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), exact for counts below 10**16."""
    wide = lambda c: F.col(c).cast("decimal(16,0)")
    over, under = wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right)
    return F.call_function("div", over, under)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of docs (text, lang; other columns don't matter): each lang's `top` best phrases.

    Words are what spaces and tabs divide in the pieces that .,;:!? and line ends divide, A-Z lower-cased; phrases have two or
    three words of one piece. a, l, r: occurrences of the phrase, of its left part and of its right part at the cut that
    scores lowest (of equal ones the first); n: words of the lang. A phrase of which `inside` percent of the
    occurrences lie in one longer candidate goes. Ties of score go to the larger a, then the smaller phrase by bytes. A
    null text is empty, a null lang `und`; repeated rows count each; texts are read whole, however long. Without
    candidates, and for an empty table, there are no rows.
    """
    tables = Tables(docs.sparkSession, "collocations")
    words, longer = phrase_counts(docs, least, tables)
    null = F.lit(None).cast("string")
    single = words.where(F.col("a") >= least).select("lang", "w1", null.alias("w2"), null.alias("w3"), "a")
    stream = single.unionByName(longer).withColumn("size", F.when(F.col("w2").isNull(), 1).when(F.col("w3").isNull(), 2).otherwise(3).cast("long"))
    w = [F.col("w1"), F.col("w2"), F.col("w3")]
    back = [F.coalesce(w[2], w[1], w[0]), F.when(w[2].isNotNull(), w[1]).when(w[1].isNotNull(), w[0]), F.when(w[2].isNotNull(), w[0])]
    stream = _pass(stream, back, "last_one", "last_two", tables)
    stream = tables.keep(_pass(stream, w, "first_one", "first_two", tables))

    held = F.col("a") * 100 >= inside * F.col("first_two")
    in_left = stream.where("size = 3").where(held).select("lang", "w1", "w2")
    in_right = stream.where("size = 3").where(F.col("a") * 100 >= inside * F.col("last_two")).select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"))
    # At most four rows for a pair: its longer candidates with half its occurrences on one side are two at most.
    pairs = stream.where("size = 2").join(in_left.unionByName(in_right).hint("merge"), ["lang", "w1", "w2"], "left_anti")
    pairs = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("first_one").alias("l"), F.col("last_one").alias("r"), _score("a", "first_one", "last_one").alias("score"))
    cuts = stream.where("size = 3").withColumns({"s1": _score("a", "first_one", "last_two"), "s2": _score("a", "first_two", "last_one")})
    early = F.col("s1") <= F.col("s2")
    triples = cuts.select("lang", F.concat_ws(" ", *w).alias("phrase"), "a", F.when(early, F.col("first_one")).otherwise(F.col("first_two")).alias("l"), F.when(early, F.col("last_two")).otherwise(F.col("last_one")).alias("r"), F.least("s1", "s2").alias("score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = pairs.unionByName(triples).withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    total = tables.keep(words.groupBy("lang").agg(F.sum("a").alias("n")))
    return ranked.join(broadcast_if_small(total), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
