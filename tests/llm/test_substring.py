import hashlib
import random
import re

from fathomline.llm import substring as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    least = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            least[k] = min(least.get(k, S.NEVER), S.NEVER if d is None else d)
    out = []
    for d, t in rows:
        w, gone = WORD.findall(t or ""), set()
        for i in range(len(w) - 12):
            if least[tuple(w[i : i + 13])] < (S.NEVER if d is None else d):
                gone |= {*range(i, i + 13)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def make(seed, vocab, n):
    rng = random.Random(seed)
    piece = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    shared = [piece(rng.choice([12, 13, 14, 30, 60])) for _ in range(12)]
    rows = []
    for d in range(n):
        parts = [piece(rng.randrange(25)) for _ in range(3)] + rng.sample(shared, rng.randrange(3))
        rng.shuffle(parts)
        rows.append((d, rng.choice([" ", "\n", " \t "]).join(parts)))
    return rows + [(n + i, rows[i][1]) for i in range(15)] + [(3, rows[3][1]), (4, rows[9][1])]


def test_against_brute_force(spark):
    rows = make(1, ["a", "é", "b,", "B", "\x1c", " x"], 120) + make(2, [f"w{i}" for i in range(500)], 100)
    rows += [(None, rows[7][1]), (None, rows[7][1]), (900, None), (901, ""), (902, " \n "), (903, "w " * 40_000), (904, "w " * 14)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, row string, runs int").repartition(5)
    for bits in (None, 27, 10):  # a full filter only costs work
        got = S.dedup(df, ["doc_id", "runs"], with_text=bits == 27, filter_bits=bits).collect()
        assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == brute(rows)
        assert all(r.runs == 1 and (r.n_repeats > 0) == (r.n_removed > 0) for r in got)
    assert S.dedup(df.limit(0)).count() == 0


def test_many_texts_of_one_id(spark):
    rng = random.Random(5)
    piece = lambda k: " ".join(f"w{rng.randrange(3000)}" for _ in range(k))
    shared = [piece(20) for _ in range(40)]
    text = lambda: " ".join([piece(rng.randrange(40)), *rng.sample(shared, rng.randrange(2)), piece(rng.randrange(40))])
    rows = [(1, " ".join(shared))] + [(d, text()) for d in (None, 7) for _ in range(1500)]
    rows += rows[-20:]
    got = S.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), with_text=False).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == brute(rows)
