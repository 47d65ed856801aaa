import random

import pytest

from fathomline.llm import token_counts as C

PIECES = ["the", " Größe", "  ", "\n", "'s", "'", "12", "ab", "!?", "\t \n", "é", "日本", "😀", " don't", "　"]


def whole(text, counter):
    return len(counter.encoding.encode_ordinary(text))


def edits_of(rng, text, most=5):
    at, edits = 0, []
    for _ in range(rng.randrange(most)):
        a = rng.randint(at, len(text))
        b = rng.randint(a, min(len(text), a + 6))
        edits.append((a, b, "".join(rng.choice(PIECES) for _ in range(rng.randrange(3)))))
        at = b
    return edits


def test_edits_against_whole_encoding(monkeypatch):
    """Several sets of edits, one after another, on one tree, also stored and read between."""
    counter, rng = C.read_vocabulary(), random.Random(0)
    for n in range(3000):
        monkeypatch.setattr(C, "LEAF", rng.choice([1, 2, 16]))
        monkeypatch.setattr(C, "GROWN", rng.choice([0, 1, 8]))
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(60)))
        doc, pieces = C.Counted.of(text, counter)
        assert doc.tree.tokens == whole(text, counter) and pieces == len(counter.pattern.findall(text))
        for _ in range(4):
            edits = edits_of(rng, doc.text)
            want = doc.text
            for a, b, new in reversed(edits):
                want = want[:a] + new + want[b:]
            doc.edit(edits)
            assert doc.text == want and doc.tree.chars == len(want)
            assert doc.tree.tokens == whole(want, counter) == sum(t for _, t in doc.tree.leaves()), (text, edits)
            doc = C.Counted(doc.text, C.Tree.read(doc.tree.stored()), counter)


def test_only_regions_are_encoded():
    counter = C.read_vocabulary()
    doc, _ = C.Counted.of("word " * 10_000, counter)
    doc.edit([(5003, 5004, "x"), (30_000, 30_010, "")])
    assert doc.encoded < 80 and doc.tree.tokens == whole("word " * 1000 + "worx " + "word " * 4999 + "word " * 3998, counter)
    doc.encoded = 0
    doc.edit([(5003, 5004, "d"), (5010, 5010, "and " * 4000)])
    assert doc.encoded < 4100 and doc.tree.tokens == whole(doc.text, counter)
    doc.encoded = 0
    doc.edit([(9000, 9003, "")])  # inside what the last set brought
    assert doc.encoded < 80 and doc.tree.tokens == whole(doc.text, counter)


def test_table(spark, tmp_path):
    rows = [(1, "a b\na b\nx y@z.de", "q"), (2, None, "q"), (3, "", None), (4, "w " * 100_000, "q"), (4, "w", "q"), (None, "x\nx", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits string")
    counter = C.read_vocabulary()
    got = {(r.doc_id, r.tokens_before): r for r in C.count_clean_up(df).collect()}
    assert len(got) == len(rows)
    one = got[1, whole("a b\na b\nx y@z.de", counter)]
    assert (one.n_edits, one.tokens_after) == (2, whole("a b\nx <EMAIL>", counter)) and got[None, 3].tokens_after == whole("x\n", counter)
    assert got[4, whole("w " * 100_000, counter)].pieces_encoded == 0
    # Trees of a table, kept, and edited by a column twice.
    path = f"file://{tmp_path}/trees"
    C.build_trees(df, ["doc_id", "text"]).write.parquet(path)
    trees, rng = spark.read.parquet(path), random.Random(3)
    for _ in range(2):
        edits = [(r.doc_id, r.text, [{"start": a, "end": b, "new": s} for a, b, s in edits_of(rng, r.text)] or None) for r in trees.select("doc_id", "text").distinct().collect()]
        given = spark.createDataFrame(edits, f"_d long, _t string, edits {C.EDITS}")
        trees = C.edit_trees(trees.join(given, trees.doc_id.eqNullSafe(given._d) & (trees.text == given._t)).drop("_d", "_t"))
        for r in trees.collect():
            assert r.tokens == whole(r.text, counter) == C.Tree.read(r.tree).tokens
    assert C.count_clean_up(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="overlap"):
        C.edit_trees(C.build_trees(df).selectExpr("*", "array(named_struct('start', 0, 'end', 9999999, 'new', '')) AS edits")).collect()
