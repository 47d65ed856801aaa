import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from fathomline.llm import divergence as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=10):
    count, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups[lang].add(source)
        count[lang, source].update(words)
        seen[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        whole = Counter()
        for s in sources:
            whole.update(count[lang, s])

        def prices(c, kept=kept):
            n = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // n for t in kept}

        p, q = {s: prices(count[lang, s]) for s in sources}, prices(whole)
        gap = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(gap(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ordered)]
    return sorted(out)


def found(spark, data, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in data], "text string, lang string, source string, term string, i int").repartition(5)
    return sorted(map(tuple, D.audit(df, **more).select("lang", "source", "part", "item", "value", "rank").collect()))


def corpus(seed, n, sources, own=20):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        s = rng.choice(sources)
        words = [rng.choice(["The", "of", "naïve", "日本", "x1y", "tree"]) if rng.random() < 0.4 else f"{s or 'none'}{'abcdefghij'[rng.randrange(10)]}" if rng.random() < 0.5 else "w" + "abcdefghijklmnop"[rng.randrange(16)] * rng.randrange(1, 5) for _ in range(rng.randrange(own))]
        out.append((" ".join(words) + "!", rng.choice(["en", "en", "en", "de", None]), s))
    return out


def test_equals_brute_force(spark):
    rows = corpus(1, 900, ["src", "src", "src", "b", "ü", None, "", "c"]) + [(None, "en", "empty"), ("", "xx", "one"), (" ", "xx", "two"), ("!", "yy", "alone")]
    want = brute(rows)
    assert len(want) > 60 and found(spark, rows) == want


def test_many_groups_and_strips(spark):
    # Sources with words of their own leave most quadrants empty; some have no kept word at all.
    rows = corpus(2, 1500, [f"s{'abcdefghijklmnopqrstuvwxyz'[i % 26] * (1 + i // 26)}" for i in range(70)]) + [("one-off" + "q" * i, "en", f"zz{i}") for i in range(9)]
    want = brute(rows, 2)
    for size, columns in ((3, 1), (16, 4096)):
        assert found(spark, rows, least=2, rows=size, columns=columns) == want


def test_zero_quadrants_are_priced_once(spark):
    rows = [(f"{s}{w} {s}{w}", "en", s) for s in "abcdefghijklmnop" for w in ("x", "y", "z", "u", "v") for _ in range(2)]
    m = D.Matrix(spark.createDataFrame(rows, "text string, lang string, source string"), 2, 1, 2)
    leaves, widths = m.leaves(), m.widths()
    met, free = D.traverse(leaves.select("lang", "block", "strip"), widths, spark.createDataFrame([("en", 15)], "lang string, last long"), m.tables)
    total = sum(r.width for r in widths.collect())
    width = {r.strip: r.width for r in widths.collect()}
    seen = Counter()
    for r in met.collect():
        seen[r.a, r.b] += width[r.strip]
    for r in free.collect():
        seen[r.a, r.b] += r.terms
    assert set(seen.values()) == {total} and len(seen) == 136
    assert met.count() < 136 * len(width) / 2


def test_edges(spark):
    assert found(spark, []) == [] and found(spark, [(None, None, None)]) == []
    assert found(spark, [("a", "en", "x"), ("b", "en", "y")]) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    rows = [("same same", "en", "x")] * 30 + [("same", "en", "y")] * 10 + [("long " * 200_000, "en", "y")] * 10
    assert found(spark, rows) == brute(rows)


def test_prices_are_exact(spark):
    for n, total, terms in ((10**15 + 3, 7 * 10**15 + 1, 10**9 + 7), (0, 1, 1), (9 * 10**16, 9 * 10**16, 1)):
        df = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long")
        assert df.select(D.price(F.col("n"), F.col("total"), F.col("terms")).alias("p")).first().p == 1 + 10**9 * (n + 2) // (total + 2 * terms)
