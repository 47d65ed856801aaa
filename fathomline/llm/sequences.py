"""Token ids as Arrow files of equal-length sequences.

Documents are put in the order of doc_id by a range exchange; each partition encodes its documents, ends each with the
end id, and cuts the run of ids into sequences of one length. They go to Arrow files (the random-access form of the
stream format) whose record batches all have the same number of sequences but for a file's last: two columns, fixed-size
lists of ids and of mask bits (set: an id, clear: padding, in a file's last sequence only). So sequence i of a file is
row i % n of its batch i // n, for batches of n, and is read as a view of the file's bytes, without decoding anything before it.
Beside each file lies another with the doc_id and the first id's place of each document. A manifest, a Parquet table
with a row for each file, says which files count: what a lost or doubled task wrote isn't in it.

Files are read and written through pyarrow's file systems: local or mounted folders, hdfs, s3 and gs.
"""

from __future__ import annotations

import bisect
import itertools
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .session import bound_batches, partitions
from .textbytes import SPACED, Texts, Words, slices

#: A public vocabulary; a parameter of every function that reads one. Encoded documents end with END.
VOCABULARY, END = "/opt/tokenizers/word_bpe_49k.json", 1
#: Ids of a sequence (a multiple of 8, so that each mask starts a byte), sequences of a record batch, and of a file about.
LENGTH, BATCH, FILE = 2048, 64, 1 << 15
#: Words that a worker remembers the ids of.
REMEMBERED = 1_000_000
#: Words that are encoded together.
TOGETHER = 500
#: Documents of a batch of a file's directory.
DOCUMENTS = 1 << 14

MANIFEST = "part int, n int, file string, sequences long, ids long, documents long"

_alnum = np.zeros(256, bool)
_alnum[0x30:0x3A] = _alnum[0x41:0x5B] = _alnum[0x61:0x7B] = True
_stop = np.zeros(256, bool)
_stop[[0x2C, 0x2E]] = True


class Encoder:
    """Ids of whole texts.

    A vocabulary of words (its model marks words' ends, its pre-tokenizer drops white space) encodes what white space
    divides, and a comma or full stop after a letter or digit at its end, each by itself: then words' ids are
    remembered. Others get the texts whole.
    """

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            suffix = json.load(f)["model"].get("end_of_word_suffix")
        self.by_word = bool(suffix)
        size = self.tokenizer.get_vocab_size()
        self.type = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.ends = np.zeros(size, bool)
        if suffix:
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.type).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _remember(self, words: list[str]) -> None:
        """Words of letters alone are encoded many at a time and divided where a word ends: each has one end at least, so as many ends as words are one each."""
        letters = [w for w in words if w.isalpha()]
        rest = [w for w in words if not w.isalpha()]
        runs = [letters[i : i + TOGETHER] for i in range(0, len(letters), TOGETHER)]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.type)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(run):
                data, at = ids.tobytes(), [0, *(ends * self.type.itemsize).tolist()]
                self.known.update((w, data[a:b]) for w, (a, b) in zip(run, itertools.pairwise(at), strict=True))
            else:
                rest += run
        self.known.update(zip(rest, self._bytes(rest), strict=True))

    def encode(self, texts: Texts, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, each with the end id; and how many each has."""
        if not self.by_word:
            data = texts.data.tobytes()
            each = self._bytes([data[a:b].decode() for a, b in itertools.pairwise(texts.offsets.tolist())])
            counts = np.array([len(x) for x in each], np.int64) // self.type.itemsize + 1
            return np.frombuffer((e := np.array([end], self.type).tobytes()).join(each) + e, self.type), counts
        words = _cut(texts)
        lengths = words.ends - words.starts
        inside = np.zeros(len(words.data) + 1, np.int8)
        inside[words.starts] += 1  # no two words start, or end, at one place
        inside[words.ends] -= 1
        letters = words.data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        column = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)).dictionary_encode()
        once = column.dictionary.to_pylist()
        new = [w for w in once if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, once
        self._remember(new)
        own = [self.known[w] for w in once]
        # Ids of each word of the slice, gathered from those of the different words.
        size = np.array([len(x) for x in own], np.int64) // self.type.itemsize
        first, flat = np.cumsum(size) - size, np.frombuffer(b"".join(own), self.type)
        code = column.indices.to_numpy()
        n, text = size[code], words.texts()
        counts = np.bincount(text, n, len(texts)).astype(np.int64) + 1
        ids = np.full(int(counts.sum()), end, self.type)
        to = np.cumsum(n) - n
        each = np.arange(int(n.sum())) - np.repeat(to, n)
        ids[np.repeat(to + text, n) + each] = flat[np.repeat(first[code], n) + each]  # a text's ids move on by the end ids before it
        return ids, counts


_encoders: dict[str, Encoder] = {}


def _encoder(vocabulary: str) -> Encoder:
    """A worker's own, for all its tasks: with what it remembers."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def _cut(texts: Texts) -> Words:
    """What white space divides, with a comma or full stop that ends it after a letter or digit cut off."""
    words = texts.words(SPACED)
    last = words.ends - 1
    cut = (words.ends - words.starts > 1) & _stop[words.data[last]] & _alnum[words.data[np.maximum(last - 1, 0)]]
    at = np.flatnonzero(cut)
    starts, ends = np.insert(words.starts, at + 1, last[at]), np.insert(words.ends, at, last[at])
    return Words(words.data, starts, ends, words.bounds + np.concatenate([[0], np.cumsum(cut)])[words.bounds])


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if "://" in path or path.startswith("file:") else f"file://{path}")


def _schema(kind: np.dtype, length: int, per_batch: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))], {"sequences_per_batch": str(per_batch)})


class _Shard:
    """A file that is being written, and its directory of documents."""

    def __init__(self, folder: str, name: str, kind: np.dtype, length: int, per_batch: int, ids_type: pa.DataType):
        store, inside = _store(f"{folder}/{name}")
        self.name, self.kind, self.length, self.full = name, kind, length, length * per_batch
        self.sequences = self.ids = self.documents = 0
        self.held, self.size = [], 0
        self.schema, self.about = _schema(kind, length, per_batch), pa.schema([("doc_id", ids_type), ("start", pa.int64())])
        self.sinks = [store.open_output_stream(inside), store.open_output_stream(f"{inside}.documents")]
        self.data, self.directory = pa.ipc.new_file(self.sinks[0], self.schema), pa.ipc.new_file(self.sinks[1], self.about)

    def add(self, ids: np.ndarray, counts: np.ndarray, doc_ids: pa.Array) -> None:
        starts = self.ids + np.cumsum(counts) - counts
        for a in range(0, len(counts), DOCUMENTS):
            self.directory.write_batch(pa.record_batch([doc_ids.slice(a, DOCUMENTS), pa.array(starts[a : a + DOCUMENTS])], schema=self.about))
        self.ids, self.documents = self.ids + len(ids), self.documents + len(counts)
        self.held.append(ids)
        self.size += len(ids)
        full = self.full
        if self.size >= full:
            flat = np.concatenate(self.held)
            for a in range(0, self.size - full + 1, full):
                self._write(flat[a : a + full], full)
            rest = flat[self.size - self.size % full :].copy()
            self.held, self.size = [rest], len(rest)

    def _write(self, ids: np.ndarray, count: int) -> None:
        """A batch of whole sequences, the last one padded after `count` ids."""
        n = -(-len(ids) // self.length)
        values, bits = np.zeros(n * self.length, self.kind), np.zeros(n * self.length, bool)
        values[:count], bits[:count] = ids[:count], True
        mask = pa.Array.from_buffers(pa.bool_(), len(bits), [None, pa.py_buffer(np.packbits(bits, bitorder="little"))])
        self.data.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(values), self.length), pa.FixedSizeListArray.from_arrays(mask, self.length)], schema=self.schema))
        self.sequences += n

    def close(self) -> tuple:
        if self.size:
            self._write(np.concatenate(self.held), self.size)
        for x in (self.data, self.directory, *self.sinks):
            x.close()
        return self.name, self.sequences, self.ids, self.documents


def _write(folder: str, vocabulary: str, end: int, length: int, per_batch: int, per_file: int):
    """mapInArrow function: sorted rows (doc_id, text) to files, of which it yields the manifest's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own, encoder, shard, made = TaskContext.get().partitionId(), uuid.uuid4().hex, _encoder(vocabulary), None, []
        for batch in batches:
            for at, to, texts in slices(batch.column("text")):
                ids, counts = encoder.encode(texts, end)
                if shard is None:
                    shard = _Shard(folder, f"{part:06d}-{len(made):06d}-{own}.arrow", encoder.type, length, per_batch, batch.column("doc_id").type)
                shard.add(ids, counts, batch.column("doc_id").slice(at, to - at))
                if shard.ids >= per_file * length:
                    made.append(shard.close())
                    shard = None
        if shard is not None:
            made.append(shard.close())
        if made:
            name, sequences, ids, documents = zip(*made, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(made), pa.int32()), pa.array(range(len(made)), pa.int32()), pa.array(name), *(pa.array(x, pa.int64()) for x in (sequences, ids, documents))], names=[x.split(" ")[0] for x in MANIFEST.split(", ")])

    return run


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END, length: int = LENGTH, per_batch: int = BATCH, per_file: int = FILE) -> None:
    """Files and manifest below `path`, a fresh folder, for docs (doc_id, text; other columns don't matter).

    Documents stand in the order of doc_id, null ones last, rows of one doc_id in the order of a hash of their texts; a
    null or empty text is the end id alone. Repeated rows each have their ids. An empty table has an empty manifest. A
    text is encoded whole, however long it is. Rows of one doc_id are dealt to several partitions if they are many.
    """
    if length % 8:
        raise ValueError("the length of a sequence must be a multiple of 8")
    bound_batches(docs.sparkSession)
    folder = f"{path}/data"
    where = docs.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(docs.sparkSession._jsc.hadoopConfiguration()).mkdirs(where)
    order = [F.col("doc_id").asc_nulls_last(), F.col("_h")]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), *order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    ordered.drop("_h").mapInArrow(_write(folder, vocabulary, end, length, per_batch, per_file), MANIFEST).write.parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """MANIFEST with first_id and first_sequence: how many ids and sequences the files before have. A row for each file, in one task."""
    before = Window.orderBy("part", "n").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").withColumns({"first_id": F.coalesce(F.sum("ids").over(before), F.lit(0)), "first_sequence": F.coalesce(F.sum("sequences").over(before), F.lit(0))})


class Shard:
    """A written file, for reading; local files are mapped into memory, so that what is read of them is a view."""

    def __init__(self, path: str):
        self.opened = [self._open(p) for p in (path, f"{path}.documents")]
        self.data, self.directory = map(pa.ipc.open_file, self.opened)
        self.length, self.per_batch = self.data.schema.field("ids").type.list_size, int(self.data.schema.metadata[b"sequences_per_batch"])
        self._at, self._batch = -1, None

    @staticmethod
    def _open(path: str):
        store, inside = _store(path)
        return pa.memory_map(inside) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(inside)

    def __enter__(self) -> "Shard":
        return self

    def __exit__(self, *_) -> None:
        for x in self.opened:
            x.close()

    def batch(self, i: int) -> pa.RecordBatch:
        if i != self._at:
            self._at, self._batch = i, self.data.get_batch(i)
        return self._batch

    def ids(self, batch: int) -> np.ndarray:
        """The ids of a batch's sequences, one after another: a view."""
        return self.batch(batch).column("ids").flatten().to_numpy()

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Views of sequence i: its ids, and its mask as bytes of eight bits, the lowest first."""
        at, row = divmod(i, self.per_batch)
        bits = np.frombuffer(self.batch(at).column("mask").values.buffers()[1], np.uint8)
        return self.ids(at)[row * self.length : (row + 1) * self.length], bits[row * self.length // 8 : (row + 1) * self.length // 8]

    def documents(self, ids: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """(doc_ids, starts, counts) of the file's documents, batch by batch; `ids` is the number of ids of the file."""
        n = self.directory.num_record_batches
        for i in range(n):
            now = self.directory.get_batch(i)
            starts = now.column("start").to_numpy()
            end = self.directory.get_batch(i + 1).column("start")[0].as_py() if i + 1 < n else ids
            yield now.column("doc_id"), starts, np.diff(starts, append=end)


def _documents(folder: str):
    """mapInArrow function: rows of the manifest to the documents of their files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, ids, first in zip(*(batch.column(c).to_pylist() for c in ("file", "ids", "first_id")), strict=True):
                with Shard(f"{folder}/{file}") as shard:
                    full, have, flat = shard.length * shard.per_batch, -1, None
                    for doc_ids, starts, counts in shard.documents(ids):
                        sums = []
                        for a, n in zip(starts.tolist(), counts.tolist(), strict=True):
                            crc, end = 0, a + n
                            while a < end:
                                at, inside = divmod(a, full)
                                if at != have:
                                    have, flat = at, memoryview(shard.ids(at).astype("<u4")).cast("B")
                                upto = min(full, inside + end - a)
                                crc = zlib.crc32(flat[4 * inside : 4 * upto], crc)
                                a += upto - inside
                            sums.append(crc)
                        yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts + first), pa.array(counts), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def _spread(files: DataFrame) -> DataFrame:
    """The manifest's rows, each a task's, up to 10,000 tasks."""
    return files.repartition(max(1, min(files.count(), 10_000)))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before), n_tokens (with the end id), ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    files = manifest(spark, path).select("file", "ids", "first_id")
    kind = next((f.dataType for f in _doc_type(spark, path)), T.LongType())
    schema = T.StructType([T.StructField("doc_id", kind), *T.StructType.fromDDL("start long, n_tokens long, ids_crc32 long")])
    return _spread(files).mapInArrow(_documents(f"{path}/data"), schema)


def _doc_type(spark: SparkSession, path: str) -> list[T.StructField]:
    """The field of doc_id as the first file's directory has it; none without files."""
    from pyspark.sql.pandas.types import from_arrow_type

    row = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("file").first()
    if row is None:
        return []
    with Shard(f"{path}/data/{row.file}") as shard:
        return [T.StructField("doc_id", from_arrow_type(shard.directory.schema.field("doc_id").type))]


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(sequence, ids, mask) of the sequences of wanted (sequence: its number in all files, in their order) by random access: nothing else of the files is read.

    Numbers that don't exist, and null ones, have no row; repeated ones have one each.
    """
    # A row for each file, as a listing of the folder would have.
    rows = manifest(spark, path).select("first_sequence", "sequences", "file").orderBy("first_sequence").collect()
    sent = spark.sparkContext.broadcast(([r.first_sequence for r in rows], [r.sequences for r in rows], [r.file for r in rows]))
    folder = f"{path}/data"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, counts, files = sent.value
        for batch in batches:
            found = []
            for s in batch.column("sequence").to_pylist():
                i = bisect.bisect_right(firsts, s) - 1
                if i >= 0 and s - firsts[i] < counts[i]:
                    found.append({"sequence": s, "file": files[i], "row": s - firsts[i]})
            yield pa.RecordBatch.from_pylist(found, pa.schema([("sequence", pa.int64()), ("file", pa.string()), ("row", pa.int64())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard = None, None
        for batch in batches:
            out = []
            for s, file, row in zip(*(batch.column(c).to_pylist() for c in ("sequence", "file", "row")), strict=True):
                if file != name:
                    if shard is not None:
                        shard.__exit__()
                    name, shard = file, Shard(f"{folder}/{file}")
                ids, bits = shard.sequence(row)
                out.append({"sequence": s, "ids": ids.astype(np.int32).tolist(), "mask": np.unpackbits(bits, bitorder="little").astype(bool).tolist()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("sequence", pa.int64()), ("ids", pa.list_(pa.int32())), ("mask", pa.list_(pa.bool_()))]))
        if shard is not None:
            shard.__exit__()

    placed = wanted.where("sequence IS NOT NULL").select(F.col("sequence").cast("long").alias("sequence")).mapInArrow(place, "sequence long, file string, row long")
    return placed.repartitionByRange("file", "row").sortWithinPartitions("file", "row").mapInArrow(read, "sequence long, ids array<int>, mask array<boolean>")
