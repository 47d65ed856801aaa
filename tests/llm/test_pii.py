import hashlib
import random
import re
import time

from fathomline.llm import pii as P

CASES = {
    "write to jane [at] mail (dot) example [dot] com now": ["email:9:47"],
    "jane at mail dot example dot com": ["email:0:32"],
    "ｊａｎｅ＠example．com": ["email:0:16"],
    "jаne@exаmple.com": ["email:0:16"],
    "ip 10[.]0[.]0[.]7 and 1.2.3.4": ["ip:3:17", "ip:22:29"],
    "plus four nine one five five five one two three four five six": ["phone:0:61"],
    "+1 five five five-1234567": ["phone:0:25"],
    "card ４１１１ 1111 1111 1111": ["card:5:24"],
    "look at the dot com era, one two three": [],
    "meet me at example.com or two, three four": [],
    "a@b.co 300.1.1.1 4111 1111 1111 1112 +12 345": ["email:0:6"],
    "": [],
}


def test_disguises():
    for text, want in CASES.items():
        base, added = P.find(text)
        assert P.joined(base + added) == ",".join(want), text


def test_table(spark):
    rng = random.Random(1)
    texts = [*CASES, None, "x " * 200_000 + "q@r.de", *(" ".join(rng.choice(list(CASES)) for _ in range(5)) for _ in range(60))]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(3)
    got = {r.doc_id: r for r in P.digests(P.detect(df)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base, added = P.find(t or "")
        assert got[i].base_sha256 == hashlib.sha256(P.joined(base).encode()).hexdigest() == P.base_digest(t or "")
        assert got[i].spans == P.joined(base + added)
        assert got[i].n_email == sum(k == "email" for *_, k in base + added)
    masked = {r.doc_id: r for r in P.mask(df.withColumn("n_chars", P.F.length("text").cast("long"))).collect()}
    assert masked[0].text == "write to <EMAIL> now" and masked[0].n_chars == 20 and masked[0].spans == "s"
    assert P.detect(df.limit(0)).count() == 0 and masked[len(CASES)].text is None


def plain(text):
    """The base spans as the patterns read, each by itself: leftmost matches that don't overlap, and their tests."""
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    spans = [(m.start(), 0, m.end(), "email") for m in email.finditer(text)]
    spans += [(m.start(), 1, m.end(), "ip") for m in ip.finditer(text) if max(map(int, m.group().split("."))) <= 255]
    for m in card.finditer(text):
        d = [int(c) for c in m.group() if c.isdigit()]
        twice = [2 * x - 9 * (2 * x > 9) if i % 2 else x for i, x in enumerate(reversed(d))]
        if 14 <= len(d) <= 19 and sum(twice) % 10 == 0:
            spans.append((m.start(), 2, m.end(), "card"))
    spans += [(m.start(), 3, m.end(), "phone") for m in phone.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return [(k, a, b) for a, _, b, k in sorted(spans)]


def test_base_spans_against_the_patterns(spark):
    rng = random.Random(8)
    pieces = ["a", "Z9", "@", ".", "-", "_", "%", "+", " ", "1", "25", "300", "4111 1111 1111 1111", "5500-0000-0000-0004", "+49 (30) 1234567", "+1.555.555.1234", "x@y.z", "1.2.3.4", "(", ")", "é", "@@", "..", "\n", "０"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(6000)] + [None]
    for t in texts[:-1]:
        assert [(k, a, b) for a, b, k in P.find(t)[0]] == plain(t), t
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {i: hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain(t or "")).encode()).hexdigest() for i, t in enumerate(texts)}
    assert {r.doc_id: r.base_sha256 for r in P.digests(P.detect(df)).collect()} == want


def test_runs_of_a_million_signs():
    for unit in ("1", "a", "aB3/+", "1.", "1 ", "a.", "+1", "a dot ", "one ", " ", "@", "(", "[ ", "é", "a@", "a@b.", "0" * 40 + "."):
        text = unit * (1_000_000 // len(unit)) + " x at y dot com q@r.de [dot]"
        began = time.perf_counter()
        base, added = P.find(text)
        P.masked(text, base + added)
        assert time.perf_counter() - began < 15, unit
        assert base[-1][2] == "email"


def test_mask_overlapping_spans(spark):
    rows = [(1, "+30569309025904 x 4111 1111 1111 1111"), (2, " ".join(f"u{i}@x.de" for i in range(20_000))), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "map('k', 1) AS _row", "'m' AS masked", "array(1) AS spans")
    got = {r.doc_id: r for r in P.mask(df).collect()}
    assert P.mask(df).columns == df.columns and got[2].text == " ".join(["<EMAIL>"] * 20_000) and got[3].text is None and got[1].masked == "m"
    assert got[1].text == "<PHONE> x <CARD>"  # the card within the phone number is part of it
