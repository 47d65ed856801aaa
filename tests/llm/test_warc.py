import base64
import hashlib
import random

from fathomline.llm import warc as A


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def run(spark, rows, where):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, bytes int")
    A.write_archives(df, f"{where}/warc")
    captures = A.read_archives(spark, f"{where}/warc")
    A.build_index(captures, f"{where}/index")
    return captures, A.resolve(spark, captures, f"{where}/index")


def test_round_trip(spark, tmp_path):
    rng = random.Random(2)
    texts = ["", None, "a\r\n\r\nWARC/1.1\r\n", "é€😀" * 50, "x" * 500_000, *("t%d\r\n\r\n" % i for i in range(40))]
    urls = ["http://A.b.example.com:8080/p?q=1#z", "https://x.org", None, "no host", "http://e.com/%41\r\nX: y", "http://e.com/a"]
    rows = [(i, rng.choice(urls), rng.choice(texts)) for i in range(400)]
    A.BLOCK_CAPTURES = 7
    captures, got = run(spark, rows, f"file://{tmp_path}")
    best = {}
    for i, _, t in rows:
        best[t or ""] = max(best.get(t or "", -1), i)
    want = {(i, len((t or "").encode()), digest(t), "response" if best[t or ""] == i else "revisit", None if best[t or ""] == i else best[t or ""]) for i, _, t in rows}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(rows)
    assert {(r.page_id, r.url) for r in captures.collect()} == {(i, u) for i, u, _ in rows}
    keys = spark.createDataFrame([("org,x)", 10**9, "A"), ("zz", 3, "")], "key string, page_id long, digest string")
    assert A.lookup(spark, f"file://{tmp_path}/index", keys).count() == 0
    assert spark.createDataFrame([(u,) for u in urls[:4]], "u string").select(A.surt(A.F.col("u"))).collect()[0][0] == "com,example,b,a:8080)/p?q=1#z"


def test_repeated_payloads_beyond_a_broadcast(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://h{i % 3}.org/{i}", "same" if i % 3 else f"own{i}") for i in range(60)]
    small = sorted(map(tuple, run(spark, rows, f"file://{tmp_path}/a")[1].collect()))
    monkeypatch.setattr(A, "SMALL_BYTES", 0)
    assert sorted(map(tuple, run(spark, rows, f"file://{tmp_path}/b")[1].collect())) == small and sum(r[3] == "revisit" for r in small) == 39


def test_edges(spark, tmp_path):
    assert run(spark, [], f"file://{tmp_path}/a")[1].count() == 0
    rows = [(None, None, "q"), (5, "u", "q"), (5, "u", "q"), (2, "u", "r")]
    got = run(spark, rows, f"file://{tmp_path}/b")[1].collect()
    assert sorted((r.page_id or -1, r.record_type, r.refers_to) for r in got) == [(-1, "revisit", 5), (2, "response", None), (5, "response", None), (5, "response", None)]


def test_an_id_with_several_payloads(spark, tmp_path):
    rows = [(5, "http://A.org/x", "AAA"), (5, "http://a.org/x", "BBBBBB"), (3, "http://b.org", "AAA"), (2, "http://c.org", "AAA"), (1, "u", "BBBBBB"), (5, "http://a.ORG/x", "AAA")]
    got = run(spark, rows, f"file://{tmp_path}/a")[1].collect()
    want = [(i, len(t), digest(t), "response" if i == 5 else "revisit", None if i == 5 else 5) for i, _, t in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
