import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from fathomline.llm import toxicity as X
from fathomline.llm.textbytes import slices

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = X.toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("score", "toxic", "predicted").toPandas()
    pos, neg = got.score[got.toxic == 1].to_numpy(), got.score[got.toxic == 0].to_numpy()
    auc = (pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean()
    recall, false = (got.predicted[got.toxic == 1] == 1).mean(), (got.predicted[got.toxic == 0] == 1).mean()
    print("auc", auc, "recall", recall, "false", false)
    assert auc > 0.95 and recall > 0.85 and false < 0.03


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "you idiot", "x"), (2, "a", "y")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    got = X.toxicity(docs, labels).collect()
    assert len(got) == 4 and {r.held_out for r in got if r.doc_id is None} == {False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert X.toxicity(docs.limit(0), labels.limit(0)).count() == 0
    assert X.clean(docs, X.Model(X.Lexicon([]))).columns == docs.columns


def test_features():
    lexicon = X.Lexicon([(0, "größe", 2.0), (4, "grün", 4.0)])
    texts = ["Größe YOU idiot", "", "grünlich 1d10t!!", None, "z " * 100_000]
    ((_, _, t),) = slices(pa.array(texts))
    x = dict(zip(X.FEATURES, X.features(t, lexicon).T, strict=True))
    assert np.allclose(x["weak"], [1 / 3, 0, 1 / 3, 0, 0]) and np.allclose(x["strong"], [0, 0, 1 / 3, 0, 0]) and np.allclose(x["most_odds"], [2, 0, 4, 0, 0])
    assert np.allclose(x["insults"], [1 / 3, 0, 0, 0, 0]) and x["near_second"][0] > 0 and x["disguised_insults"][2] > 0
    assert x["marks"][2] > 0 and not any(v[1] or v[3] for v in x.values())
    random.seed(0)


def plain_features(text, terms):
    """FEATURES of one text, character by character."""
    text = text or ""
    size = max(1, len(text.encode()))
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    found = list(re.finditer(r"[a-z\x80-\U0010ffff]+", lower))
    words, n = [m.group() for m in found], max(1, len(found))
    table = {(k, t): o for k, t, o in terms}
    odds = [max([table.get((0, w), 0.0)] + [table.get((k, w[:k]), 0.0) for k in X.PREFIXES if len(w) >= k]) for w in words]
    insult, second = [w in X.INSULTS for w in words], [w in X.SECOND for w in words]
    bad = [i or o >= X.STRONG for i, o in zip(insult, odds)]
    near = sum(b and any(second[max(0, i - 5) : i + 6]) for i, b in enumerate(bad))
    tokens = [m.group() for m in re.finditer(r"[a-z0-9@$*\x80-\U0010ffff]+", lower)]
    letter = lambda c: "a" <= c <= "z" or c >= "\x80"
    mixed = [t for t in tokens if any(map(letter, t)) and not all(map(letter, t))]
    undone = [t.translate(str.maketrans("013457@$", "oieastas")) for t in mixed]
    ascii_ = lambda kind: sum(ord(c) < 128 and kind(c) for c in text) / size
    shouted = sum(m.end() - m.start() >= 3 and all("A" <= c <= "Z" for c in text[m.start() : m.end()]) for m in found)
    punctuation = lambda c: not c.isalnum() and "!" <= c <= "~"
    return [
        math.log1p(len(words)), sum(o >= X.WEAK for o in odds) / n, sum(o >= X.STRONG for o in odds) / n, sum(odds) / n, max(odds, default=0.0), math.log1p(sum(o >= X.STRONG for o in odds)), sum(insult) / n, math.log1p(sum(insult)), math.log1p(near), sum(second) / n,
        ascii_(str.isupper), shouted / n, ascii_(lambda c: c in "!?"), ascii_(punctuation), len(mixed) / n, math.log1p(sum(u in X.INSULTS for u in undone)), sum(len(w.encode()) for w in words) / n,
    ]


def test_features_against_plain_ones():
    rng = random.Random(7)
    pieces = ["you", "Idiot", "1d10t", "DUMM", "größe", "ÉTÉ", "grünlich", "a", "Tú", "müll", "x9", "$tup1d", "word", "STOP", "b@d", "!!", "?", ", ", ".", " ", " ", "-", "\n", "*", "7", "schön", "vous"]
    terms = [(0, "word", 2.0), (0, "größe", 3.5), (4, "grün", 1.6), (5, "grünl", 4.0), (6, "schön", 9.0), (4, "stop", 1.5)]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(400)] + [None, "", " ", "z " * 50_000]
    got = np.concatenate([X.features(t, X.Lexicon(terms)) for _, _, t in slices(pa.array(texts), 2000)])
    want = np.array([plain_features(t, terms) for t in texts])
    for name, a, b in zip(X.FEATURES, got.T, want.T, strict=True):
        assert np.allclose(a, b), name


def test_texts_of_one_id(spark):
    """The fit takes the same text of an id whatever the order of the rows."""
    rows = [(i, f"{'you idiot scum ' if i % 2 else 'a calm day '}{j} " + "q " * (i % 9)) for i in range(900) for j in range(2)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(900)], "doc_id long, toxic int")
    scores = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        scores.append({(r.doc_id, r.score) for r in X.fit(docs, labels, trees=2, depth=2).score(docs).collect()})
    assert scores[0] == scores[1] and len({s for _, s in scores[0]}) > 1
