from pyspark.sql import functions as F

from fathomline.functions.stems import stemmed, stems
from fathomline.operators import index as I, retrieval as R

# Words and stems, by the rules of the algorithm's description.
KNOWN = """caresses caress, ties tie, cries cri, gas gas, this this, gaps gap, kiwis kiwi, agreed agre, feed feed, luxuriating luxuri, hopping hop, hoping hope, hoped hope, falling fall, filing file, sized size, happy happi, cry cri, by by, say say,
relational relat, conditional condit, rational ration, valency valenc, digitizer digit, operator oper, feudalism feudal, decisiveness decis, hopefulness hope, formality formal, sensitivity sensit, sensibility sensibl, apology apolog, triplicate triplic,
formative format, formalize formal, electrical electr, hopeful hope, goodness good, revival reviv, allowance allow, inference infer, airliner airlin, gyroscopic gyroscop, adjustable adjust, defensible defens, irritant irrit, replacement replac,
adjustment adjust, dependent depend, adoption adopt, activate activ, effective effect, probate probat, rate rate, cease ceas, controll control, roll roll, generate generat, generic generic, communism communism, arsenal arsenal, skies sky, dying die,
news news, inning inning, innings inning, succeeded succeed, exceed exceed, youth youth, boyish boyish, sayings say, vulnerabilities vulner, vulnerability vulner, vulnerable vulner, exploiting exploit, exploited exploit, exploitation exploit,
upgrades upgrad, upgrading upgrad, quickly quick, knightly knight, fully fulli, lately late, consistency consist, consolation consol, consigned consign, knocks knock, knives knive, bed bed, shred shred, beds bed, sing sing, running run"""


def test_known_words(spark):
    want = dict(p.split() for p in KNOWN.replace("\n", " ").split(","))
    more = {"log4j": "log4j", "ab": "ab", "": "", "größen": "größen", "a" * 65 + "s": "a" * 65 + "s", "Ships": "Ships"}
    rows = spark.createDataFrame([(w,) for w in {**want, **more}] + [(None,)], "w string")
    got = {r.word: r.stem for r in stems(rows, "w").collect()}
    assert got.pop(None) is None
    assert {w: s for w, s in got.items() if s != {**want, **more}[w]} == {}


def test_searches_meet_inflected_forms(spark, tmp_path):
    docs = spark.createDataFrame([(1, "attackers exploited the parser"), (2, "upgrading parsers helps"), (3, "an exploit"), (4, None), (5, "")], "doc long, text string")
    asked = spark.createDataFrame([("a", "exploiting"), ("b", "parser -upgrades"), ("c", '"upgrade parser"')], "query_id string, query string")
    table = I.build(docs, "doc", "text", f"file://{tmp_path}/s", stem=True)
    got = {}
    for r in I.search(table, asked, "doc", 5, stem=True).collect():
        got.setdefault(r.query_id, set()).add(r.doc)
    assert got == {"a": {1, 3}, "b": {1}, "c": {2}}
    plain = I.build(docs, "doc", "text", f"file://{tmp_path}/p")
    assert I.search(plain, asked.where("query_id = 'a'"), "doc", 5).count() == 0


def test_rows_keep_their_other_columns(spark):
    rows = spark.createDataFrame([("ships", 1, "x"), ("ships", 1, "x"), (None, 2, "y"), ("sea", 3, "z")], "term string, stem int, word string")
    assert sorted(map(str, map(tuple, stemmed(rows, "term").collect()))) == sorted(map(str, [("ship", 1, "x"), ("ship", 1, "x"), (None, 2, "y"), ("sea", 3, "z")]))
    assert stemmed(rows.where("false"), "term").count() == 0


def test_stems_are_remembered():
    from fathomline.functions.stems import stem

    stem("remembering")
    before = stem.cache_info().hits
    assert stem("remembering") == "rememb" and stem.cache_info().hits == before + 1
