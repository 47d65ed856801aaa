import functools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from fathomline.llm import sequences as S
from fathomline.llm.textbytes import slices

ODD = ["", " ", None, "It's Ünïcode, don't. é Á. ́x x ́y", "a\x0bb\x0cc\x1cd e f g\x85h", "<|endoftext|>. <|ENDOFTEXT|>, x<|startoftext|>y z.", '" 1 "', "12.5, 3., ,. .,", "ΑΣ. ΑΣ", "日本語。です, 한국어", "...", "word" * 9000, "x\r\n\ty.", "I'll've we're'd 's. s'", " a b　", "a.\x01 b\x01.", "ﬁ ǅ İi ẞ"]


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(S.VOCABULARY)


@functools.cache
def encode(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, S.END]


@pytest.mark.parametrize("vocabulary", [S.VOCABULARY, "/opt/tokenizers/byte_bpe_50k.json"])
def test_encoder_equals_whole_encoding(vocabulary):
    from tokenizers import Tokenizer

    e, t, texts = S.Encoder(vocabulary), Tokenizer.from_file(vocabulary), pa.array(ODD * 3)
    for limit in (1 << 20, 7):
        got = []
        for _, _, some in slices(texts, limit):
            ids, counts = e.encode(some, 1)
            got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in ODD * 3]


def want(rows):
    out, at = [], 0
    for doc, text in rows:
        ids = encode(text)
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, start string, ids int")


def test_round_trip_and_random_access(spark, tmp_path):
    rows = [(i * 7 % 211, ODD[i % len(ODD)] if i % 3 else f"document {i} " * (i % 40)) for i in range(211)]
    path = f"file://{tmp_path}/a"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    S.write(frame(spark, rows).repartition(5), path, length=16, per_batch=3, per_file=4)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows.sort()
    got = sorted(map(tuple, S.read_documents(spark, path).collect()))
    assert got == sorted(want(rows))
    files = sorted(S.manifest(spark, path).collect(), key=lambda r: (r.part, r.n))
    assert len(files) > 8 and sum(r.documents for r in files) == len(rows) and all(r.ids <= 16 * r.sequences < r.ids + 16 for r in files)
    whole = [i for _, t in rows for i in encode(t)]
    total = sum(r.sequences for r in files)
    asked = spark.createDataFrame([(i,) for i in [*range(0, total, 2), 0, total, -1, None]], "sequence long")
    back = {r.sequence: r for r in S.fetch(spark, path, asked).collect()}
    assert set(back) == set(range(0, total, 2))
    for f in files:
        for i in range(f.first_sequence + f.first_sequence % 2, f.first_sequence + f.sequences, 2):
            at = f.first_id + 16 * (i - f.first_sequence)
            ids = whole[at : min(at + 16, f.first_id + f.ids)]
            assert back[i].ids == ids + [0] * (16 - len(ids)) and back[i].mask == [True] * len(ids) + [False] * (16 - len(ids))


def test_files_are_views_of_equal_batches(spark, tmp_path):
    S.write(frame(spark, [(i, "some words here " * 900) for i in range(64)]).coalesce(1), f"file://{tmp_path}/a", length=32)
    for f in S.manifest(spark, f"file://{tmp_path}/a").collect():
        with S.Shard(f"{tmp_path}/a/data/{f.file}") as shard:
            n = shard.data.num_record_batches
            assert [shard.data.get_batch(i).num_rows for i in range(n - 1)] == [S.BATCH] * (n - 1)
            before = pa.total_allocated_bytes()
            ids, bits = shard.sequence(f.sequences // 2)
            assert pa.total_allocated_bytes() == before and not ids.flags.owndata and not bits.flags.owndata and (bits == 255).all()


def test_edges(spark, tmp_path):
    S.write(frame(spark, []), f"file://{tmp_path}/none")
    assert S.read_documents(spark, f"file://{tmp_path}/none").count() == 0 and S.fetch(spark, f"file://{tmp_path}/none", spark.range(3).withColumnRenamed("id", "sequence")).count() == 0
    rows = [(5, "same")] * 300 + [(None, "last")] * 2 + [(5, None), (-3, "first")]
    S.write(frame(spark, rows), f"file://{tmp_path}/ties", per_file=1, length=8)
    got = sorted(map(tuple, S.read_documents(spark, f"file://{tmp_path}/ties").collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [-3] + [5] * 301 + [None] * 2 and [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got[:-1]]).tolist()
    assert sorted(r[3] for r in got) == sorted(zlib.crc32(np.array(encode(t), "<u4").tobytes()) for _, t in rows)
    parts = S.manifest(spark, f"file://{tmp_path}/ties").where("documents > 0").select("part").distinct().count()
    assert parts > 1
    with pytest.raises(ValueError):
        S.write(frame(spark, []), f"file://{tmp_path}/odd", length=12)
