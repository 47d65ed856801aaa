import tracemalloc

import numpy as np
import pyarrow as pa

from fathomline.llm import textbytes as B


def words_of(text):
    ((_, _, texts),) = B.slices(pa.array([text]))
    return texts.words(B.PLAIN, lower=True)


def test_pieces_give_the_same_hashes(monkeypatch):
    words = words_of("Some words, " * 50 + "x" * 500 + " of any length " * 20)
    want = B._ranges(words.data.astype(B.U) + B.U(1), words.starts, words.ends, B._BASES[0])
    for size in (1, 7, 100, 10_000):
        monkeypatch.setattr(B, "PIECE_BYTES", size)
        assert (words.hashes() == want).all()
    assert len(words_of("").hashes()) == 0


def test_hashing_needs_little_beside_its_result():
    words = words_of("abcd efg " * 400_000)
    B._tables.clear()
    tracemalloc.start()
    out = words.hashes()
    peak, kept = tracemalloc.get_traced_memory()[1], sum(a.nbytes for t in B._tables.values() for a in t)
    tracemalloc.stop()
    assert peak - out.nbytes < 24 << 20 and kept < 8 << 20 and len(np.unique(out)) == 2
