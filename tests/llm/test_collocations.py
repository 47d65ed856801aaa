import random
import re
from collections import Counter
from decimal import Decimal

from pyspark.sql import functions as F

from fathomline.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top, inside=50):
    count, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    count[lang, tuple(words[i : i + k])] += 1
    good = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, w), a in good.items():
        if len(w) == 3:
            gone |= {(lang, p) for p in (w[:2], w[1:]) if 100 * a >= inside * count[lang, p]}
    out = []
    for (lang, w), a in good.items():
        if (lang, w) not in gone:
            cuts = [(10**6 * a * a // (count[lang, w[:k]] * count[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.append((lang, " ".join(w), a, count[lang, w[:k]], count[lang, w[k:]], n[lang], score))
    ranked = []
    for lang in n:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(mine)]
    return sorted(ranked)


def found(spark, rows, least, top):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, a long, w1 string").repartition(6)
    return sorted(map(tuple, C.collocations(df, least, top).collect()))


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "é", "日本", "naïve", "a\x00b", "x-y", " ", *("w%d" % i for i in range(30))]
    fixed = ["new york city", "Hot dog stand", "in spite of", "new york"]
    out = []
    for _ in range(n):
        words = [rng.choice(fixed) if rng.random() < 0.2 else rng.choice(vocabulary) if rng.random() < 0.5 else "the" for _ in range(rng.randrange(60))]
        out.append("".join(w + rng.choice([" ", " ", " ", "  ", "\t ", ". ", ",", "\n", "\x0b", "!?"]) for w in words))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(4)
    langs = ["en"] * 6 + ["de", None, "", "und"]
    rows = [(t, rng.choice(langs)) for t in texts(1, 700)] + [(None, "en"), ("", None), (" .,", "fr"), ("one", "xx")] + [("all day long again", "en")] * 400
    for least, top in ((10, 2000), (3, 7)):
        want = brute(rows, least, top)
        assert len(want) > 20 and found(spark, rows, least, top) == want


def test_ranges_get_what_those_before_leave(spark):
    # One word starts and one ends nearly all phrases, so that their streams go through many ranges.
    rows = [(f"hub v{i % 97} z{i % 89}. u{i % 83} v{i % 97} end", "en") for i in range(6000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 23)
    try:
        assert found(spark, rows, 2, 10**6) == brute(rows, 2, 10**6)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_full_filters_cost_no_results(spark, monkeypatch):
    rows = [(t, "en") for t in texts(2, 300)]
    monkeypatch.setattr(C, "FILTER_BITS", (9, 9))
    assert found(spark, rows, 4, 500) == brute(rows, 4, 500)


def test_long_text_and_empty_table(spark):
    long = " ".join(f"a{i % 400} b{i % 7}" for i in range(300_000))
    assert found(spark, [(long, "en")], 10, 2000) == brute([(long, "en")], 10, 2000)
    assert found(spark, [], 1, 5) == [] and found(spark, [("one two", "en")], 2, 5) == [] and found(spark, [(None, None)], 1, 5) == []


def test_scores_are_exact(spark):
    for a, left, right in ((10**15 + 7, 3 * 10**15 + 1, 2 * 10**15 + 9), (10, 10, 10), (9_007_199_254_740_993, 9_007_199_254_740_995, 9_007_199_254_740_997)):
        df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
        assert df.select(C._score("a", "l", "r").alias("s"), F.lit(Decimal(1))).first().s == 10**6 * a * a // (left * right)
