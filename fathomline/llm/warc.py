"""WARC archives with a two-level capture index.

Archives are written by Spark's text sink, whose line separator is the blank lines that end a WARC record, and read
through pyarrow's file systems: local or mounted folders, hdfs, s3 and gs. The index sorts captures by their reversed-host URL key into
compressed blocks (a Parquet table) and keeps a sparse directory of the blocks' first keys. A lookup finds its
block in the directory and its capture in the block, each by binary search, and then reads only the record's
byte range from the archive.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .session import Tables, checkpoint

#: Payloads of at least so many bytes are stored once; the others that equal them become revisit records.
REVISIT_BYTES = 0
RECORDS_PER_ARCHIVE = 2000
#: Bytes of the table of repeated payloads (digest, first page and its URL) that may be broadcast.
SMALL_BYTES = 32 << 20
#: Bytes that are read at a time to find a header's end.
CHUNK = 1 << 16
#: Captures in an index block, at least; blocks grow when the directory would exceed MOST_BLOCKS entries.
BLOCK_CAPTURES = 512
MOST_BLOCKS = 1 << 16

HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CAPTURE = "file string, offset long, length long, record_type string, page_id long, url string, refers_to long, refers_to_url string, payload_bytes long, payload_digest string, told_digest string"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, from 40 bits at a time."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def surt(url: Column) -> Column:
    """Reversed-host key: http://a.example.com:80/x?y has com,example,a:80)/x?y. No host: the URL as it is."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/:?#]+(:[0-9]+)?((?s).*)$", 2)
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/:?#]+(:[0-9]+)?", 1)
    return F.when(host == "", url).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), rest))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for null. CR and LF can't stand in it and are percent-encoded."""
    value = F.replace(F.replace(F.replace(value.cast("string"), F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """One WARC record (column `value`, without the blank lines at its end) for each row of pages (page_id, url, html).

    Of equal payloads the row with the largest page_id is the response; a page_id may have several payloads. A null html is empty, a null url has no
    header line; null ids lose to others, and equal rows with the largest id are all responses. No rows, no record.
    Other columns don't matter. A page is one value, of up to 2 GB.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", base32_sha1(F.col("html"))).withColumn("bytes", F.octet_length("html"))
    big = rows.where(F.col("bytes") >= revisit_bytes)
    # Written out, so that its size is known: a small table goes to the pages, and beyond that the join deals both sides
    # out by itself and can split a payload that many pages have.
    first = Tables(pages.sparkSession, "repeated").keep(big.groupBy("digest", "bytes").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1 AND first.page_id IS NOT NULL").select(F.col("digest").alias("_d"), F.col("bytes").alias("_b"), "first"))
    size = first.agg(F.sum(F.octet_length("_d") + F.coalesce(F.octet_length("first.url"), F.lit(0)) + 24)).first()[0] or 0
    rows = rows.join(F.broadcast(first) if size <= SMALL_BYTES else first, (F.col("digest") == F.col("_d")) & (F.col("bytes") == F.col("_b")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), "html"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")), _field("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        _field("WARC-Target-URI", F.col("url")), _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(_field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _field("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first.page_id").cast("string"), F.lit(">"))), _field("WARC-Refers-To-Target-URI", F.col("first.url")))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"), F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    records(pages, revisit_bytes).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_ARCHIVE).text(path)


_plain = lambda s: s.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _capture(file: str, at: int, header: bytes, block: bytes) -> dict:
    """The row of the record at byte `at` of a file."""
    lines = header.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    payload = memoryview(block)[block.index(b"\r\n\r\n") + 4 :]
    url, other = fields.get("WARC-Target-URI"), fields.get("WARC-Refers-To-Target-URI")
    told = (fields.get("WARC-Payload-Digest") or "").removeprefix("sha1:")
    row = {"file": file, "offset": at, "length": len(header) + 4 + len(block), "record_type": fields["WARC-Type"], "page_id": _id(fields.get("WARC-Record-ID")), "url": url and _plain(url), "refers_to": _id(fields.get("WARC-Refers-To")), "refers_to_url": other and _plain(other), "told_digest": told}
    return row | {"payload_bytes": len(payload), "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode()}


def _id(value: str | None) -> int | None:
    return int(value[len("<urn:page:") : -1]) if value else None


def _whole(stream, size: int) -> bytes:
    data = stream.read(size)
    if len(data) < size:
        raise ValueError("an archive ends within a record")
    return data


def _records(file: str, stream, size: int) -> Iterator[dict]:
    """The rows of an archive's records, of which one is held at a time."""
    at, held = 0, b""
    while at < size:
        while (end := held.find(b"\r\n\r\n")) < 0:
            held += _whole(stream, min(CHUNK, size - at - len(held)) or 1)
        header, held = held[:end], held[end + 4 :]
        length = re.search(rb"\r\nContent-Length: ([0-9]+)$", header)
        if not header.startswith(b"WARC/1.1\r\n") or not length:
            raise ValueError(f"no WARC record at byte {at} of {file}")
        need = int(length[1]) + 4  # with the blank lines after it
        if len(held) < need:
            held = b"".join([held, _whole(stream, need - len(held))])
        yield _capture(file, at, header, held[: need - 4])
        held, at = held[need:], at + end + 4 + need


_ARROW = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split(" ") for x in CAPTURE.split(", "))])


#: What a capture is looked up by.
KEY = ("key", "page_id", "digest")


def _open(file: str):
    store, inside = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", file))
    return store, inside


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
            store, inside = _open(file)
            with store.open_input_stream(inside) as stream:
                rows = _records(file, stream, size)
                while some := list(itertools.islice(rows, 1000)):
                    yield pa.RecordBatch.from_pylist(some, _ARROW)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives (CAPTURE). A revisit's payload is empty here; resolve() fetches it.

    Archives are read as streams, a record at a time, so their sizes don't matter. To be used several times, the
    result is best written first.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "length").mapInArrow(_scan, CAPTURE)


def _blocks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, rows = TaskContext.get().partitionId(), 0, []

        def block(rows):
            data = zlib.compress("\n".join(json.dumps(r) for r in rows).encode())
            return pa.RecordBatch.from_pydict({"block": [(part << 32) + made], "first_key": [rows[0][0]], "first_page": [rows[0][1]], "first_digest": [rows[0][2]], "n": [len(rows)], "data": [data]})

        for batch in batches:
            rows += map(list, zip(*(batch.column(c).to_pylist() for c in (*KEY, "file", "offset", "length")), strict=True))
            while len(rows) >= size:
                yield block(rows[:size])
                rows, made = rows[size:], made + 1
        if rows:
            yield block(rows)

    return run


def build_index(captures: DataFrame, path: str) -> None:
    """The block table of the response records of read_archives(), by reversed-host key, page_id and payload digest."""
    spark = captures.sparkSession
    rows = captures.where("record_type = 'response' AND page_id IS NOT NULL").select(surt(F.col("url")).alias("key"), "page_id", F.col("told_digest").alias("digest"), "file", "offset", "length")
    size = max(BLOCK_CAPTURES, -(-rows.count() // MOST_BLOCKS))
    ordered = rows.repartitionByRange("key", "page_id", "digest").sortWithinPartitions("key", "page_id", "digest")
    ordered.mapInArrow(_blocks(size), "block long, first_key string, first_page long, first_digest string, n long, data binary").write.parquet(path)


def lookup(spark: SparkSession, index: str, wanted: DataFrame) -> DataFrame:
    """Captures (key, page_id, digest, file, offset, length) of the distinct rows of wanted (key, page_id, digest); of several captures with all three alike, one."""
    blocks = spark.read.parquet(index)
    # At most MOST_BLOCKS entries and one more for each partition of the index.
    entries = sorted(((r.first_key, r.first_page, r.first_digest), r.block) for r in blocks.select("first_key", "first_page", "first_digest", "block").collect())
    sent = spark.sparkContext.broadcast(([e[0] for e in entries], [e[1] for e in entries]))
    found = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("digest", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, ids = sent.value
        for batch in batches:
            at = [bisect.bisect_right(firsts, x) - 1 for x in zip(*(batch.column(c).to_pylist() for c in KEY), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] if i >= 0 else None for i in at], pa.int64()), *(batch.column(c) for c in KEY)], names=["block", *KEY])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, keys in zip(batch.column("data"), batch.column("wanted"), strict=True):
                lines = [json.loads(x) for x in zlib.decompress(data.as_py()).decode().split("\n")]
                for k in keys.as_py():
                    own = [k[c] for c in KEY]
                    at = bisect.bisect_left(lines, own)
                    if at < len(lines) and lines[at][:3] == own:
                        rows.append(dict(zip(found.names, lines[at], strict=True)))
            yield pa.RecordBatch.from_pylist(rows, found)

    placed = wanted.select(*KEY).distinct().mapInArrow(place, "block long, key string, page_id long, digest string").where("block IS NOT NULL")
    by_block = placed.groupBy("block").agg(F.collect_list(F.struct(*KEY)).alias("wanted"))  # no more than the block has
    return by_block.join(blocks, "block").select("data", "wanted").mapInArrow(search, "key string, page_id long, digest string, file string, offset long, length long")


def read_ranges(captures: DataFrame) -> DataFrame:
    """The records (CAPTURE) in the byte ranges of captures (file, offset, length); nothing else of the files is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, opened = None, None
        for batch in batches:
            rows = []
            for file, at, size in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != name:
                    store, inside = _open(file)
                    name, opened = file, store.open_input_file(inside)
                header, _, block = opened.read_at(size, at).partition(b"\r\n\r\n")
                rows.append(_capture(file, at, header, block))
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return captures.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset").mapInArrow(run, CAPTURE)


def resolve(spark: SparkSession, captures: DataFrame, index: str) -> DataFrame:
    """captures with the full payload's size and digest also for revisits, taken from the records they refer to.

    A revisit's record is the one with the URL key and page_id that it refers to and with its own payload's digest: an id may
    have several payloads.
    """
    revisit = captures.where("record_type = 'revisit'").select(surt(F.col("refers_to_url")).alias("key"), F.col("refers_to"), F.col("told_digest").alias("digest"), "page_id", "record_type")
    found = read_ranges(lookup(spark, index, revisit.select("key", F.col("refers_to").alias("page_id"), "digest")))
    # Captures of equal payloads under one id and key are one, however their hosts were written.
    found = checkpoint(found.select(F.col("page_id").alias("_p"), surt(F.col("url")).alias("_k"), F.col("told_digest").alias("_t"), F.col("payload_bytes").alias("_n"), F.col("payload_digest").alias("_d")).dropDuplicates(["_p", "_k", "_t"]))
    full = revisit.join(found, (F.col("refers_to") == F.col("_p")) & (F.col("key") == F.col("_k")) & (F.col("digest") == F.col("_t"))).select("page_id", "_n", "_d", "record_type", "refers_to")
    same = captures.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return same.unionByName(full.withColumnsRenamed({"_n": "payload_bytes", "_d": "payload_digest"}))
