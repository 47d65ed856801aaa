import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from fathomline.llm import decontaminate as D
from fathomline.llm.textbytes import PLAIN, slices

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - 12)) if w else []:
            windows.setdefault(tuple(w[a : a + 13]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for a in range(len(w) - size + 1):
                if (got := windows.get(tuple(w[a : a + size]))) is not None:
                    hit |= {*range(a, a + size)}
                    ids |= got
        s = sorted(map(str, ids - {None}))
        out[d] = (len(w), len(hit), len(s), hashlib.sha256(",".join(s).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def cases():
    rng = random.Random(3)
    vocab = ["a", "b", "the", "Größe", "ÉTÉ", "été", "x1", "7"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 5, 13, 20, 40])))) for i in range(30)] + [(99, None), (100, "..."), (7, "a b the a b the a b the a b the a b the")]
    docs = []
    for d in range(120):
        parts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(60))) for _ in range(3)]
        parts.insert(1, rng.choice(items)[1] or "")
        docs.append((d, rng.choice([" ", ".\n", "--"]).join(parts).upper() if d % 5 == 0 else ", ".join(parts)))
    docs += [(1000, None), (1001, ""), (1002, "!!!"), (1003, "w " * 30_000 + items[3][1])]
    return docs, items


def check(spark, block):
    docs, items = cases()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    df = df.selectExpr("*", "1 AS item_id", "'x' AS n_words").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "0 AS doc_id")
    old, D.BLOCK_CHARS = D.BLOCK_CHARS, block
    got = D.decontaminate(df, bench) if block is None else None
    if got is None:
        found = D.matches(df, bench, block_chars=block)
        got = found.withColumn("n_hit", D.merged_length("hit")).selectExpr("doc_id", "n_words", "n_hit", "cast(size(item_ids) as long) n_items", "sha2(array_join(item_ids, ','), 256) s", "n_hit > 0 and 20 * n_hit >= n_words c", "longest_words")
    D.BLOCK_CHARS = old
    rows = got.collect()
    assert {r[0]: tuple(r[1:6]) for r in rows} == brute(docs, items)
    assert len(rows) == len(docs)
    assert all((r["longest_words"] or 0) >= 1 for r in rows if r[2])


def test_against_brute_force(spark):
    check(spark, 8_000_000)


def test_in_blocks(spark):
    check(spark, 400)


def test_empty_tables_and_clean(spark):
    docs = spark.createDataFrame([(1, "a b c", "z"), (1, "a b c", "z"), (2, "q", None)], "doc_id long, text string, hit string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(docs, none).where("contaminated").count() == 0
    assert D.decontaminate(docs.limit(0), none).count() == 0
    bench = spark.createDataFrame([(5, "a b c")], "item_id long, text string")
    assert [tuple(r) for r in D.clean(docs, bench).collect()] == [(2, "q", None)]


def test_in_blocks_with_shared_ids(spark):
    """Different texts under a null and under one repeated doc_id, and equal rows, as one block gives them."""
    docs, items = cases()
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else d, t) for i, (d, t) in enumerate(docs[:90] + docs[-4:])]
    rows += [rows[0]] * 20 + rows[:30]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.matches(df, bench, block_chars=400).withColumn("n_hit", D.merged_length("hit")).selectExpr("doc_id", "n_words", "n_hit", "cast(size(item_ids) as long)", "sha2(array_join(item_ids, ','), 256)", "n_hit > 0 and 20 * n_hit >= n_words").collect()
    want = brute([(i, t) for i, (_, t) in enumerate(rows)], items)
    assert sorted(map(tuple, got), key=str) == sorted(((d, *want[i]) for i, (d, _) in enumerate(rows)), key=str)
    packed = df.selectExpr("struct(*) AS _row", "text")
    assert D.matches(packed, bench, ["_row"], block_chars=400).count() == len(rows)


def test_text_of_many_different_words():
    """More different words in one text than fit three to a key."""
    inside = [f"q{i}" for i in range(40)]
    items = [(1, " ".join(inside)), (2, "5 6 7 8"), (3, "7 6 5"), (4, " ".join([*inside[:20], "no", *inside[20:]]))]
    text = " ".join([*map(str, range(1 << 20)), *inside, *map(str, range(1 << 20, (1 << 21) + 100)), *inside[:13]])
    (_, _, texts), = slices(pa.array([text]))
    found = D.search(texts.words(PLAIN, lower=True), D.Probes(items, 13))[0]
    n = (1 << 21) + 100
    assert np.flatnonzero(found["hit"]).tolist() == [5, 6, 7, 8, *range(1 << 20, (1 << 20) + 40), *range(n + 40, n + 53)]
    assert found["items"].tolist() == [0, 1, 3] and (found["longest"], found["start"]) == (40, 1 << 20)


def test_suffixes_of_wide_values_are_in_order():
    rng = np.random.default_rng(2)
    small = rng.integers(0, 3, 300)
    for depth in (3, 4, 9, 20):
        for seq in (small, small + (1 << 22)):
            order = D.suffix_array(seq, depth)
            keys = [tuple(seq[i : i + depth]) for i in order]
            assert keys == sorted(keys) and sorted(order) == list(range(300))


def test_longest_matches_and_equal_windows():
    rng = np.random.default_rng(6)
    for _ in range(30):
        word = lambda k: [f"w{i}" for i in rng.integers(0, 4, k)]
        items = [(i, " ".join(word(rng.integers(3, 30)))) for i in range(8)]
        items += [(20 + i, items[i][1] + " w9 " + items[0][1]) for i in range(3)]
        docs = [" ".join(word(60)) + " " + items[rng.integers(len(items))][1] for _ in range(3)]
        ((_, _, texts),) = slices(pa.array(docs))
        found = D.search(texts.words(PLAIN, lower=True), D.Probes(items, 5))
        for d, text in enumerate(docs):
            w, best = text.split(), 0
            for _, t in items:
                v = t.split()
                for a in range(len(w)):
                    for b in range(len(v)):
                        k = 0
                        while a + k < len(w) and b + k < len(v) and w[a + k] == v[b + k]:
                            k += 1
                        best = max(best, k)
            if best >= 5:
                r = found[d]
                assert r["longest"] == best and " ".join(w[r["start"] : r["start"] + best]) in items[r["item"]][1]


def test_clean_in_blocks_with_any_columns(spark):
    docs, items = cases()
    df = spark.createDataFrame(docs + docs[:9], "doc_id long, text string").selectExpr("*", "map('a', doc_id) AS _row", "1 AS _h1", "doc_id AS n_words").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = (D.clean(df, bench, block_chars=n) for n in (8_000_000, 400))
    assert one.columns == many.columns == df.columns
    ids = lambda x: sorted(r.doc_id for r in x.select("doc_id").collect())
    want = brute(docs, items)
    assert ids(one) == ids(many) == sorted(d for d, _ in docs + docs[:9] if not want[d][4])
