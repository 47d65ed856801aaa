"""Benchmark decontamination by suffix arrays over the training text.

Each shard of documents (a slice of an Arrow batch) gets a suffix array over its words, built by prefix
doubling to the length of the longest benchmark text. Every suffix of every benchmark text is looked up in
it by binary search, which gives its longest verbatim match and, at window length, all its places. Shards
need no exchange: the pass over the documents has no shuffle. The benchmark goes out in broadcasts of a
bounded size, one pass for each block of it; with several blocks, the hit ranges are merged per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .session import Tables, bound_batches, broadcast_if_small
from .textbytes import _GRAM_BASES, PLAIN, Texts, Words, _ranges, slices

#: Words of a window. A shorter benchmark text is one window.
WINDOW = 13
#: Characters of benchmark text in one broadcast, about; results are the same with any number.
BLOCK_CHARS = 8_000_000
#: A document is contaminated when at least one in so many of its words is hit.
ONE_IN = 20



class Probes:
    """The words of a block of benchmark texts, as hashes, where each text starts, and the order of their suffixes."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        items = [(i, t) for i, t in items if t]
        raw = [t.encode() for _, t in items]
        words = Texts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])).words(PLAIN, lower=True)
        sizes = words.counts()
        self.ids = [str(i) if i is not None else None for i, _ in items]
        self.hashes = words.hashes()
        self.item = words.texts()
        self.left = np.repeat(words.bounds[1:], sizes) - np.arange(len(words))  # words from here to the text's end
        size = sizes[self.item]
        first = np.arange(len(words)) == words.bounds[:-1][self.item]
        self.window = np.where(self.left >= window, window, np.where(first & (size < window), size, 0))
        self.longest = int(sizes.max(initial=0))
        self.vocab, number = np.unique(self.hashes, return_inverse=True)
        self.seq, place = np.zeros(len(words) + len(items), np.int64), np.arange(len(words)) + self.item  # 0 ends a text
        self.seq[place] = number + 1
        order = suffix_array(self.seq, max(3, self.longest))
        self.order = order[self.seq[order] > 0]  # without the ends
        self.word = np.zeros(len(self.seq), np.int64)
        self.word[place] = np.arange(len(words))
        # Equal windows have one number, the least word that starts one; their items follow one another.
        at = np.flatnonzero(self.window)
        ends = at + self.window[at]
        key = np.stack([_ranges(self.hashes, at, ends, b).view(np.int64) for b in _GRAM_BASES] + [self.window[at]], 1)
        _, least, group = np.unique(key, axis=0, return_index=True, return_inverse=True)
        self.group = np.full(len(words), -1, np.int64)
        self.group[at] = at[least][group.ravel()]
        pair = np.unique(np.stack([self.group[at], self.item[at]], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        self.group_items, self.group_bounds = pair[:, 1], np.searchsorted(pair[:, 0], np.arange(len(words) + 1))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The benchmark's numbers of these words, -1 for others."""
        if not len(self.vocab):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
        return np.where(self.vocab[at] == hashes, at + 1, -1)


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of `seq` (values from 0 to 2**31 - 2), in the order of their first `depth` values."""
    n = len(seq)
    padded = np.concatenate([seq.astype(np.int64) + 1, np.zeros(2, np.int64)])
    three = padded.max() < 1 << 21  # three values fit a key, else two
    key = (padded[:n] << 42) | (padded[1 : n + 1] << 21) | padded[2 : n + 2] if three else (padded[:n] << 32) | padded[1 : n + 1]
    order = np.argsort(key, kind="stable")
    head = np.ones(n, bool)
    head[1:] = key[order[1:]] != key[order[:-1]]
    done, rank = 3 if three else 2, np.empty(n, np.int64)
    while done < depth:
        group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        tied = ~head
        tied[:-1] |= ~head[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        rank[order] = group
        start = order[at]
        after = np.where(start + done < n, rank[np.minimum(start + done, n - 1)] + 1, 0)
        pair = (group[at] << 32) | after
        by = np.argsort(pair, kind="stable")
        order[at] = start[by]
        pair = pair[by]
        head[at[1:]] = (pair[1:] != pair[:-1]) | (at[1:] != at[:-1] + 1)
        done *= 2
    return order


def _bound(seq, order, lo, hi, at, value, right: bool):
    """Within order[lo:hi], sorted by the value at distance `at`, the first place not below (or above) `value`."""
    lo, hi = lo.copy(), hi.copy()
    n = len(seq)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        place = order[np.minimum(mid, len(order) - 1)] + at
        have = np.where(place < n, seq[np.minimum(place, n - 1)], -1)
        below = (have <= value if right else have < value) & open_
        lo = np.where(below, mid + 1, lo)
        hi = np.where(open_ & ~below, mid, hi)
    return lo


def search(words: Words, probes: Probes) -> dict[int, dict]:
    """For each text with a match of a window: its hit words, items, and the longest match with its place."""
    counts = words.counts()
    seq, vocab = _sequence(words, probes)
    order = suffix_array(seq, max(3, probes.longest))
    n = len(seq)
    rank = np.searchsorted(vocab, probes.hashes)
    known = rank < len(vocab)
    known &= vocab[np.minimum(rank, len(vocab) - 1)] == probes.hashes if len(vocab) else False
    value = np.where(known, rank + 1, -2)  # 0 ends a text, so words count from 1
    live = np.flatnonzero(known)
    lo, hi = np.zeros(len(live), np.int64), np.full(len(live), n)
    window_lo, window_hi = np.zeros(len(value), np.int64), np.zeros(len(value), np.int64)
    at = 0
    while len(live):
        want = value[live + at]
        new_lo = _bound(seq, order, lo, hi, at, want, False)
        new_hi = _bound(seq, order, new_lo, hi, at, want, True)
        keep = new_lo < new_hi
        live, lo, hi = live[keep], new_lo[keep], new_hi[keep]
        at += 1
        full = probes.window[live] == at
        window_lo[live[full]], window_hi[live[full]] = lo[full], hi[full]
        more = probes.left[live] > at
        live, lo, hi = live[more], lo[more], hi[more]
    found = np.flatnonzero(window_hi > window_lo)
    found = found[probes.group[found] == found]  # of equal windows one
    out: dict[int, dict] = {}
    if not len(found):
        return out
    many = window_hi[found] - window_lo[found]
    which = np.repeat(found, many)
    place = order[np.repeat(window_lo[found], many) + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)]
    text_start = words.bounds[:-1] + np.arange(len(counts))  # in seq, where each text is followed by one end mark
    doc = np.searchsorted(text_start, place, "right") - 1
    by = np.lexsort((place, doc))
    cuts = np.flatnonzero(np.diff(doc[by])) + 1
    size, item = _longest(words, probes, place - doc)
    for group in np.split(by, cuts):
        d = int(doc[group[0]])
        probe, start = which[group], place[group] - text_start[d]
        edge = np.zeros(counts[d] + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + probes.window[probe], -1)
        hit = np.cumsum(edge[:-1]) > 0
        items = [probes.group_items[probes.group_bounds[g] : probes.group_bounds[g + 1]] for g in np.unique(probe)]
        k = int(np.argmax(size[group]))
        out[d] = {"hit": hit, "items": np.unique(np.concatenate(items)), "longest": int(size[group[k]]), "item": int(item[group[k]]), "start": int(start[k])}
    return out


def _longest(words: Words, probes: Probes, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of these words of the shard the length of the longest match from it on, and its item: a search in the benchmark's suffixes."""
    value = probes.numbers(words.hashes())
    end = np.repeat(words.bounds[1:], words.counts())[word]
    live, at = np.arange(len(word)), 0
    lo, hi = np.zeros(len(word), np.int64), np.full(len(word), len(probes.order))
    size, item = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
    while len(live):
        want = value[word[live] + at]
        new_lo = _bound(probes.seq, probes.order, lo, hi, at, want, False)
        new_hi = _bound(probes.seq, probes.order, new_lo, hi, at, want, True)
        keep = (new_lo < new_hi) & (want > 0)
        live, lo, hi = live[keep], new_lo[keep], new_hi[keep]
        at += 1
        size[live], item[live] = at, probes.item[probes.word[probes.order[lo]]] if len(lo) else 0
        more = word[live] + at < end[live]
        live, lo, hi = live[more], lo[more], hi[more]
    return size, item


def _sequence(words: Words, probes: Probes) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers, 0 after each text, and the sorted hashes of the words that have a number from 1."""
    vocab, number = np.unique(words.hashes(), return_inverse=True)
    seq = np.zeros(len(words) + len(words.bounds) - 1, np.int64)
    seq[np.arange(len(words)) + words.texts()] = number + 1
    return seq, vocab


SCHEMA = "n_words long, hit array<struct<a: int, b: int>>, item_ids array<string>, longest_words int, longest_item string, longest_start int"


def _scan(probes, spread: list[str]):
    """mapInArrow function: appends SCHEMA to the kept columns; hit holds ranges of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = probes.value
        for batch in batches:
            for at, to, texts in slices(batch.column("text")):
                words = texts.words(PLAIN, lower=True)
                found = search(words, p) if len(words) and len(p.hashes) else {}
                rows = [found.get(i) for i in range(to - at)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(at, to - at) for c in spread]
                    + [
                        pa.array(words.counts(), pa.int64()),
                        pa.array([_ranges_of(r["hit"]) if r else [] for r in rows], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                        pa.array([sorted({p.ids[i] for i in r["items"]} - {None}) if r else [] for r in rows], pa.list_(pa.string())),
                        pa.array([r and r["longest"] for r in rows], pa.int32()),
                        pa.array([r and p.ids[r["item"]] for r in rows], pa.string()),
                        pa.array([r and r["start"] for r in rows], pa.int32()),
                    ],
                    names=[*spread, "n_words", "hit", "item_ids", "longest_words", "longest_item", "longest_start"],
                )

    return run


def _ranges_of(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).tolist()
    return [{"a": a, "b": b} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _blocks(benchmark: DataFrame, chars: int) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """The number of blocks of about `chars` characters, and the benchmark in them; the driver holds one at a time."""
    items = benchmark.select(F.col("item_id"), F.col("text")).where(F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    n = max(1, -(-total // chars))
    block = lambda i: items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else items
    return n, ([(r.item_id, r.text) for r in block(i).collect()] for i in range(n))


def matches(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """`keep` columns of docs (default: doc_id) with SCHEMA, one row for each row of docs.

    hit: ranges of words inside an occurrence of a benchmark window, as (a, b) with b exclusive. item_ids: the items
    with an occurring window, sorted as strings. longest_*: the longest verbatim match among them and its place.
    Null and empty texts have no words; items without words or with a null text match nothing; an item with a
    null id hits words but isn't listed. Repeated rows each give a row. Other columns of either table don't matter. A
    text of any length is one part of a shard, and is indexed whole.
    """
    spark, keep = docs.sparkSession, keep or ["doc_id"]
    bound_batches(spark)
    slim = docs.select(*dict.fromkeys([*keep, "text"]))
    n, blocks = _blocks(benchmark, block_chars)
    text = ["_text1", "_text2"] if n > 1 else []
    if text:
        slim = slim.withColumns({"_text1": F.xxhash64("text"), "_text2": F.xxhash64(F.lit(17), "text")})
    schema = T.StructType([*(slim.schema[c] for c in [*keep, *text]), *T.StructType.fromDDL(SCHEMA)])
    if n == 1:
        return slim.mapInArrow(_scan(spark.sparkContext.broadcast(Probes(next(blocks), window)), [*keep, *text]), schema)
    # One block after another: its results are written, and its broadcast is gone before the next one's.
    parts, tables = [], Tables(spark, "blocks")
    for items in blocks:
        sent = spark.sparkContext.broadcast(Probes(items, window))
        parts.append(tables.keep(slim.mapInArrow(_scan(sent, [*keep, *text]), schema)))
        sent.destroy()
    # Several blocks: a row is its kept columns and its text, by two hashes. Equal rows have equal results, so of those
    # one is kept for each block, with their number, before the blocks' results meet.
    every = parts[0].withColumn("_block", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        every = every.unionByName(p.withColumn("_block", F.lit(i)))
    fields = [f.name for f in T.StructType.fromDDL(SCHEMA)]
    once = every.groupBy(*keep, *text, "_block").agg(*[F.first(c).alias(c) for c in fields], F.count("*").alias("_n"))
    best = F.max_by(F.struct("longest_words", "longest_item", "longest_start"), F.coalesce("longest_words", F.lit(-1)))
    return (
        once.groupBy(*keep, *text)
        .agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hit")).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), best.alias("best"), F.first("_n").alias("_n"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
        .select(*keep, "n_words", "hit", "item_ids", "best.*")
    )


def merged_length(ranges: str) -> F.Column:
    """Words in the union of an array of ranges."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["end"]))).alias("n"), F.greatest(s["end"], x["b"]).alias("end"))
    return F.aggregate(F.array_sort(ranges), start, step)["n"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """matches() with the verdict: n_words, n_hit, n_items, items_sha256, contaminated, and where the longest match is."""
    found = matches(docs, benchmark, keep, block_chars=block_chars)
    keep = keep or ["doc_id"]
    return found.withColumn("n_hit", merged_length("hit")).select(
        *keep, "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (ONE_IN * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "longest_words", "longest_item", "longest_start",
    )


def clean(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the contaminated rows, all columns kept, whatever their names and types; equal rows go or stay together."""
    if _blocks(benchmark, block_chars)[0] == 1:
        packed = docs.select(F.struct(*docs.columns).alias("_row"), "text")
        return decontaminate(packed, benchmark, ["_row"], block_chars).where(~F.col("contaminated")).select("_row.*")
    # Rows' other columns don't go through the merge of several blocks: a row's fate depends on its text alone.
    hashes = [F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit(17), "text").alias("_h2")]
    keys = docs.select("text", *hashes)
    gone = decontaminate(keys, benchmark, ["_h1", "_h2"], block_chars).where("contaminated").select("_h1", "_h2").distinct()
    packed = docs.select(F.struct(*docs.columns).alias("_row"), hashes[0].alias("_t1"), hashes[1].alias("_t2"))
    gone = broadcast_if_small(Tables(docs.sparkSession, "contaminated").keep(gone))
    return packed.join(gone, (F.col("_t1") == F.col("_h1")) & (F.col("_t2") == F.col("_h2")), "left_anti").select("_row.*")
