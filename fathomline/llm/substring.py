"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of the 5-word grams in each run of 13 words the one with the least hash, so equal runs
share an anchor. Which anchors stand in two different documents is found by one exchange of their hashes, packed
in arrays and already reduced to one entry a task. Then matches are extended from such anchors both ways:

1. A segment is all the neighbouring runs with one anchor, so up to 12 words before it and after it. Segments'
   128-bit hashes are exchanged and each learns the smallest document that has it: there all its runs match.
2. Of anchors with several different segments, where matches end inside one, each run is exchanged by itself.

Runs that also start in a smaller document cover words to remove, and neighbouring runs join to maximal repeats.

The sets of anchors travel back as filters of a bounded number of bits. They only save work: what they let through in
error finds no partner among the exact hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .session import Tables, bound_batches, partitions
from .textbytes import _GRAM_BASES, SPACED, U, Texts, Words, _ranges, grams, slices, slide, within

#: Words of a repeat, at least, and of an anchor.
LENGTH, ANCHOR = 13, 5
#: Two hashes of a text: with the doc_id they tell rows apart.
ROW = ["row1", "row2"]
#: Bits of the filter of shared anchors, by the size of the texts: at least 2**20, and at most 2**29 (64 MB, the bound of
#: what is broadcast).
FILTER_BITS = (20, 29)
#: Exchanged packs per shuffle partition, so that partitions come out even and a pack is a small part of one.
PACKS = 8
#: Bytes of text that are hashed at a time: a worker needs some 60 times as much for it.
SLICE = 2 << 20
#: Entries of a pack after which equal keys are brought together.
HELD = 4_000_000

NEVER = np.iinfo(np.int64).max


class Grams:
    """Words and anchors of a slice. least[p] is the anchor's hash of the run that starts at word p; ok[p]: the run lies in one text."""

    def __init__(self, texts: Texts, length: int, anchor: int):
        self.words: Words = texts.words(SPACED)
        n = len(self.words)
        self.length, self.ok, self.least, self._words = length, np.zeros(0, bool), np.zeros(0, U), {}
        if n >= length:
            self._words[0] = self.words.hashes()
            self.ok = within(self.words.bounds, n - length + 1, length)
            self.least = slide(grams(self._words[0], anchor), length - anchor + 1)
        self.text = self.words.texts()

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, number of runs and end of the words of each stretch of neighbouring runs with one anchor in one text."""
        run = np.flatnonzero(self.ok)
        new = np.ones(len(run), bool)
        new[1:] = (run[1:] != run[:-1] + 1) | (self.least[run[1:]] != self.least[run[:-1]])
        at = np.flatnonzero(new)
        last = run[np.append(at[1:], len(run)) - 1]
        return run[at], last - run[at] + 1, last + self.length

    def hash(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        """Hash of the words start[i]:end[i]."""
        if which not in self._words:
            self._words[which] = self.words.hashes(which)
        return _ranges(self._words[which], start, end, _GRAM_BASES[which])


def _pack(first: np.ndarray, columns: dict[str, np.ndarray], bits: int) -> pa.RecordBatch:
    """Rows (pack, one binary per column): `columns` dealt out by the top `bits` bits of `first`, which is sorted."""
    cut = np.searchsorted(first, np.arange(1, 1 << bits, dtype=U) << U(64 - bits)) if bits else np.zeros(0, np.int64)
    edge = np.concatenate([[0], cut, [len(first)]])
    full = np.flatnonzero(np.diff(edge))
    made = {k: [v[edge[i] : edge[i + 1]].tobytes() for i in full] for k, v in columns.items()}
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(v, pa.binary()) for v in made.values())], names=["pack", *made])


def _packs(spark) -> int:
    """Bits of a pack's number."""
    return max(1, (partitions(spark) * PACKS - 1).bit_length())


def _ids(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).fill_null(NEVER).to_numpy(zero_copy_only=False).astype(np.int64)


def _least_per_key(keys: list[np.ndarray], doc: np.ndarray, many: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct keys in order, each with its smallest document and whether it has two different ones."""
    order = np.lexsort((doc, *reversed(keys)))
    keys, doc, many = [k[order] for k in keys], doc[order], many[order]
    new = np.ones(len(doc), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys]) if len(doc) else False
    at = np.flatnonzero(new)
    if not len(at):
        return keys, doc, many
    last = np.append(at[1:], len(doc)) - 1
    return [k[at] for k in keys], doc[at], np.logical_or.reduceat(many, at) | (doc[at] != doc[last])


def _flags(h: np.ndarray, bits: int, filter_bits: int) -> bytes:
    """The part of the filter that belongs to the pack of these hashes, with them set."""
    flags = np.zeros(1 << (filter_bits - bits), bool)
    flags[((h << U(bits)) >> U(64 - filter_bits + bits)).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def _whole(parts: DataFrame, bits: int, filter_bits: int) -> bytes:
    """The filter put together from rows (pack, bits); 2**filter_bits bits whatever the data."""
    size = 1 << (filter_bits - bits - 3)
    out = np.zeros(1 << (filter_bits - 3), np.uint8)
    for r in parts.collect():
        out[r.pack * size : (r.pack + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def _in(filter_: bytes, h: np.ndarray, filter_bits: int) -> np.ndarray:
    flags, slot = np.frombuffer(filter_, np.uint8), (h >> U(64 - filter_bits)).astype(np.int64)
    return ((flags[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1).astype(bool)


def _row(text: str) -> list[F.Column]:
    return [F.xxhash64(text).alias("row1"), F.xxhash64(F.lit(17), text).alias("row2")]


_TYPES = {"h": U, "h1": U, "h2": U, "doc": np.int64, "many": bool}


def _emit(found, names: list[str], bits: int):
    """mapInArrow function: what `found` yields (arrays for names but the last, many), reduced to one entry per key, as packs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0

        def out():
            *keys, doc = (np.concatenate(x) for x in zip(*kept, strict=True))
            keys, doc, many = _least_per_key(keys, doc, np.zeros(len(doc), bool))
            return _pack(keys[0], dict(zip(names, [*keys, doc, many], strict=True)), bits)

        for arrays in found(batches):
            kept.append(arrays)
            held += len(arrays[0])
            if held > 1_500_000:
                yield out()
                kept, held = [], 0
        if kept:
            yield out()

    return run


def _met(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    """(pack, keys, smallest document, many) for each pack; packs come one after another, and one's entries are held at once."""

    def out(pack, held):
        *keys, doc, many = (np.concatenate(x) for x in zip(*held, strict=True))
        return pack, *_least_per_key(keys, doc, many)

    now, held, size = None, [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            pack = batch.column(0)[i].as_py()
            if held and pack != now:
                yield out(now, held)
                held, size = [], 0
            now = pack
            held.append([np.frombuffer(batch.column(n)[i].as_py(), _TYPES[n]) for n in names])
            size += len(held[-1][0])
            if size > HELD and len(held) > 1:  # equal keys of many tasks come down to one entry each
                *keys, doc, many = (np.concatenate(x) for x in zip(*held, strict=True))
                keys, doc, many = _least_per_key(keys, doc, many)
                held = [[*keys, doc, many]]
                size = len(doc) // 2
    if held:
        yield out(now, held)


def _dealt(rows: DataFrame, function, names: list[str]) -> DataFrame:
    """What `function` yields, by pack: Spark's sort brings a pack's rows together, and spills where it must."""
    made = rows.mapInArrow(function, "pack int, " + ", ".join(f"{n} binary" for n in names))
    return made.repartition(partitions(rows.sparkSession), "pack").sortWithinPartitions("pack")


def _slices(batches: Iterator[pa.RecordBatch], length: int, anchor: int):
    """(Grams, ids, rows) of each slice that has runs. A row of rows is a text's two hashes."""
    for batch in batches:
        ids, rows = _ids(batch, "doc_id"), np.stack([batch.column(c).to_numpy() for c in ROW], 1)
        for at, to, texts in slices(batch.column("text"), SLICE):
            g = Grams(texts, length, anchor)
            if g.ok.any():
                yield g, ids[at:to], rows[at:to]


def repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, filter_bits: int | None = None) -> DataFrame:
    """doc_id, row1, row2 (two hashes of the text), gone: the maximal stretches [a, b) of words in runs of `length` words that also start in a smaller document.

    Only rows with such runs; rows that equal each other in doc_id and text come once.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    if filter_bits is None:  # a slot for each eight bytes of text: about one for each word
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        filter_bits = min(max((size // 8).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    bits = min(_packs(spark), filter_bits - 3)
    rows = docs.select("doc_id", "text", *_row("text"))

    def anchors(batches):
        for g, ids, _ in _slices(batches, length, anchor):
            first, _, _ = g.segments()
            yield g.least[first], ids[g.text[first]]

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, (h,), _, many in _met(batches, ["h", "doc", "many"]):
            yield pa.RecordBatch.from_pydict({"pack": pa.array([pack], pa.int32()), "bits": [_flags(h[many], bits, filter_bits)]})

    names = ["h", "doc", "many"]
    seeds = spark.sparkContext.broadcast(_whole(_dealt(rows, _emit(anchors, names, bits), names).mapInArrow(shared, "pack int, bits binary"), bits, filter_bits))

    def segments(batches):
        for g, ids, own in _slices(batches, length, anchor):
            first, n, end = g.segments()
            keep = _in(seeds.value, g.least[first], filter_bits)
            first, n, end = first[keep], n[keep], end[keep]
            if len(first):
                yield g.least[first], g.hash(first, end, 0), g.hash(first, end, 1), ids[g.text[first]], own[g.text[first]], first - g.words.bounds[:-1][g.text[first]], n

    def different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, (h, h1, h2), doc, many in _met(batches, ["h", "h1", "h2", "doc", "many"]):
            again = np.zeros(len(h), bool)
            again[1:] = h[1:] == h[:-1]  # another segment of one anchor
            size = int(many.sum())
            yield pa.RecordBatch.from_arrays([pa.array([None] * size, pa.int32()), pa.array([None] * size, pa.binary()), pa.array(h1[many].view(np.int64)), pa.array(h2[many].view(np.int64)), pa.array(doc[many])], names=["pack", "bits", "h1", "h2", "least"])
            none = pa.array([None], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([pack], pa.int32()), pa.array([_flags(h[again], bits, filter_bits)], pa.binary()), none, none, none], names=["pack", "bits", "h1", "h2", "least"])

    names = ["h", "h1", "h2", "doc", "many"]
    met = Tables(spark, "segments").keep(_dealt(rows, _emit(lambda b: (x[:4] for x in segments(b)), names, bits), names).mapInArrow(different, "pack int, bits binary, h1 long, h2 long, least long"))
    whole = met.where("pack IS NULL").select("h1", "h2", "least")
    ends = spark.sparkContext.broadcast(_whole(met.where("pack IS NOT NULL").select("pack", "bits"), bits, filter_bits))

    def single(batches):
        for g, ids, own in _slices(batches, length, anchor):
            run = np.flatnonzero(g.ok & _in(ends.value, g.least[: len(g.ok)], filter_bits))
            if len(run):
                yield g.hash(run, run + length, 0), g.hash(run, run + length, 1), ids[g.text[run]], own[g.text[run]], run - g.words.bounds[:-1][g.text[run]], np.ones(len(run), np.int64)

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (h1, h2), doc, many in _met(batches, ["h1", "h2", "doc", "many"]):
            yield pa.RecordBatch.from_arrays([pa.array(h1[many].view(np.int64)), pa.array(h2[many].view(np.int64)), pa.array(doc[many])], names=["h1", "h2", "least"])

    def places(found):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for h1, h2, doc, row, start, n in found(batches):
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(doc), pa.array(row[:, 0]), pa.array(row[:, 1]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["h1", "h2", "doc", *ROW, "start", "n"])

        return rows.mapInArrow(run, "h1 long, h2 long, doc long, row1 long, row2 long, start int, n int").select("h1", F.shiftright("h2", 24).alias("h2"), "doc", *ROW, "start", "n")

    names = ["h1", "h2", "doc", "many"]
    alone = _dealt(rows, _emit(lambda b: (x[:3] for x in single(b)), names, bits), names).mapInArrow(smallest, "h1 long, h2 long, least long")
    # Of the 128 bits of a segment's hash 104 are compared; of a text's, which tell texts of one doc_id apart, all 128.
    later = lambda here, known: here.join(known.select("h1", F.shiftright("h2", 24).alias("h2"), "least"), ["h1", "h2"]).where(F.col("least") < F.col("doc")).select("doc", *ROW, "start", "n")
    found = later(places(lambda b: (x[1:] for x in segments(b))), whole).unionByName(later(places(single), alone))
    runs = found.groupBy("doc", *ROW).agg(F.collect_set(F.struct("start", "n")).alias("runs"))  # no more than the text has words
    merged = runs.mapInArrow(_stretches(length), "doc long, row1 long, row2 long, gone array<struct<a: int, b: int>>")
    return merged.select(F.when(F.col("doc") != NEVER, F.col("doc")).alias("doc_id"), *ROW, "gone")


def _stretches(length: int):
    """mapInArrow function: runs (start, n) of a document to the maximal stretches [a, b) of words that they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for runs in batch.column("runs"):
                start, n = (np.asarray(runs.values.field(k)) for k in ("start", "n"))
                order = np.argsort(start, kind="stable")
                a, b = start[order], np.maximum.accumulate((start + n + (length - 1))[order])
                new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
                out.append([{"a": int(x), "b": int(y)} for x, y in zip(a[new], b[np.append(new[1:], len(a)) - 1], strict=True)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc", *ROW)), pa.array(out, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], names=["doc", *ROW, "gone"])

    return run


#: Documents and stretches that may be broadcast: under 24 MB.
SMALL_DOCS, SMALL_STRETCHES = 300_000, 1_000_000


def _small(found: DataFrame) -> DataFrame:
    """found with a broadcast hint if its rows and stretches are few enough, else as it is."""
    n = found.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size("gone")), F.lit(0)).alias("stretches")).first()
    return F.broadcast(found) if n.docs <= SMALL_DOCS and n.stretches <= SMALL_STRETCHES else found


OUT = "n_words long, n_removed long, n_repeats long, kept_sha256 string, kept string"


def dedup(docs: DataFrame, keep: list[str] | None = None, with_text: bool = True, length: int = LENGTH, anchor: int = ANCHOR, filter_bits: int | None = None) -> DataFrame:
    """`keep` columns of docs (default: doc_id) and OUT, one row for each row of docs.

    A word goes if it lies in a run of `length` words that also starts in a document with a smaller doc_id; runs are
    judged on the input. n_repeats: the maximal stretches of such words. kept: the words left, joined by one space.
    Rows of one doc_id are one document. A null doc_id counts as the largest; a null text has no words; shorter
    texts have no runs. Exact copies aren't special: all their words go but for the smallest's, from `length` words.
    """
    keep = keep or ["doc_id"]
    slim = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    found = _small(Tables(docs.sparkSession, "repeats").keep(repeats(slim, length, anchor, filter_bits).select(F.col("doc_id").alias("_d"), *[F.col(c).alias(f"_{c}") for c in ROW], "gone")))
    rows = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
    same = [h == F.col(f"_{c}") for h, c in zip(_row("_text"), ROW, strict=True)]
    joined = rows.join(found, [F.col("_doc").eqNullSafe(F.col("_d")), *same], "left").drop("_d", "_row1", "_row2")
    slots = [f"_k{i}" for i in range(len(keep))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stretches = batch.column("gone")
            for at, to, texts in slices(batch.column("_text")):
                words = texts.words(SPACED)
                data = texts.data.tobytes()
                rows = []
                for i in range(to - at):
                    a, b = words.bounds[i], words.bounds[i + 1]
                    gone, many = np.zeros(b - a, bool), 0
                    if (r := stretches[at + i]).is_valid:
                        many = len(r)
                        for x, y in zip(r.values.field("a").to_pylist(), r.values.field("b").to_pylist(), strict=True):
                            gone[x:y] = True
                    left = np.flatnonzero(~gone) + a
                    kept = b" ".join([data[s:e] for s, e in zip(words.starts[left].tolist(), words.ends[left].tolist(), strict=True)])
                    rows.append((b - a, int(gone.sum()), many, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
                n, g, m, s, t = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, to - at) for c in slots), pa.array(n, pa.int64()), pa.array(g, pa.int64()), pa.array(m, pa.int64()), pa.array(s, pa.string()), pa.array(t, pa.string())], names=[*slots, "n_words", "n_removed", "n_repeats", "kept_sha256", "kept"])

    schema = T.StructType([*(T.StructField(s, docs.schema[c].dataType) for s, c in zip(slots, keep, strict=True)), *T.StructType.fromDDL(OUT)])
    return joined.mapInArrow(cut, schema).select(*[F.col(s).alias(c) for s, c in zip(slots, keep, strict=True)], "n_words", "n_removed", "n_repeats", "kept_sha256", *["kept"] * with_text)
