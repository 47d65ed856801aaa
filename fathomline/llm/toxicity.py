"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The fit takes a bounded sample of labelled rows (FIT_ROWS), in three parts by hash of the id: on the first a lexicon
of words and word beginnings is learnt by log-odds, on the second the trees, on the third the calibration. So the
lexicon's densities are as honest for the trees as they are for new documents. Features come from whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F, types as T

from .session import bound_batches, checkpoint
from .textbytes import LOWER, U, Texts, _BASES, _ranges, slices

#: Labelled rows that the fit takes at most: those with the least hashes of their ids.
FIT_ROWS = 24_000
#: Bytes of text whose features are made at a time.
SLICE = 512 << 10
#: Terms of the learnt lexicon, documents that a term needs, and log-odds from which it counts.
TERMS, LEAST_DOCS, WEAK, STRONG = 4_000, 5, 1.5, 3.0
#: Characters of word beginnings in the lexicon, next to whole words.
PREFIXES = (4, 5, 6)

# Insults and second-person pronouns of common use in four languages.
INSULTS = """idiot idiots moron morons stupid loser losers scum trash garbage pathetic worthless disgusting clown clowns dumb
fool jerk bastard bitch asshole fuck fucking shit crap retard ugly filthy vermin kill die hate disgrace
idioten dumm dummkopf arschloch scheisse scheiße abschaum müll ekelhaft trottel wichser verlierer hure
connard connasse imbécile crétin merde salope ordure minable dégoûtant abruti pute
idiota imbécil estúpido estúpida basura mierda puta cabrón gilipollas asqueroso perdedor patético""".split()
SECOND = "you your yours yourself u ur ya du dich dir dein deine euch ihr sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()

_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_TOKEN = _LETTER.copy()
_TOKEN[[*range(0x30, 0x3A), *b"@$*"]] = True
_LEET = LOWER.copy()
for _a, _b in zip(b"013457@$", b"oieastas", strict=True):
    _LEET[_a] = _b
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b"!?")] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True

FEATURES = ("log_words", "weak", "strong", "odds", "most_odds", "strong_log", "insults", "insults_log", "near_second", "second", "capitals", "shouted", "marks", "punctuation", "obfuscated", "disguised_insults", "word_length")


def _hashed(terms: list[str]) -> np.ndarray:
    raw = [t.encode() for t in terms]
    ends = np.cumsum([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8).astype(U) + U(1)
    return _ranges(data, ends - np.array([len(r) for r in raw], np.int64), ends, _BASES[0]) if raw else np.zeros(0, U)


class Lexicon:
    """Sorted hashes of terms of each kind (0: whole words, else characters of a beginning) with their log-odds."""

    def __init__(self, terms: list[tuple[int, str, float]]):
        self.kinds = {}
        for kind in (0, *PREFIXES):
            own = [(t, o) for k, t, o in terms if k == kind]
            h, o = _hashed([t for t, _ in own]), np.array([o for _, o in own])
            by = np.argsort(h)
            self.kinds[kind] = (h[by], o[by] if len(own) else o)

    def odds(self, kind: int, hashes: np.ndarray) -> np.ndarray:
        known, odds = self.kinds[kind]
        if not len(known) or not len(hashes):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.where(known[at] == hashes, odds[at], 0.0)


_INSULTS, _SECOND = np.sort(_hashed(INSULTS)), np.sort(_hashed(SECOND))


def _member(sorted_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, hashes), len(sorted_) - 1)] == hashes


def features(texts: Texts, lexicon: Lexicon) -> np.ndarray:
    """A row of FEATURES for each text; all zero for texts without words and marks."""
    n = len(texts)
    words = texts.words(_LETTER, lower=True)
    count = words.counts()
    owner, per = words.texts(), np.maximum(count, 1)
    add = lambda v: np.bincount(owner, v, n)
    h = words.hashes()
    data = words.data.astype(U) + U(1)
    odds = lexicon.odds(0, h)
    # A beginning is counted in characters: bytes that don't continue one.
    lead = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    place = np.append(np.flatnonzero((words.data & 0xC0) != 0x80), len(words.data))
    for k in PREFIXES:
        first = lead[words.starts]
        end = np.minimum(place[np.minimum(first + k, len(place) - 1)], words.ends)
        long = lead[words.ends] - first >= k
        odds = np.maximum(odds, np.where(long, lexicon.odds(k, _ranges(data, words.starts, end, _BASES[0])), 0.0))
    weak, strong = odds >= WEAK, odds >= STRONG
    most = np.zeros(n)
    np.maximum.at(most, owner, odds)
    insult, second = _member(_INSULTS, h), _member(_SECOND, h)
    bad = insult | strong
    # Hits with a second-person word at most five words before or after, in one text.
    at = np.flatnonzero(second)
    near = np.zeros(len(h), bool)
    if len(at):
        hit = np.flatnonzero(bad)
        i = np.searchsorted(at, hit)
        for j in (np.maximum(i - 1, 0), np.minimum(i, len(at) - 1)):
            near[hit[(np.abs(at[j] - hit) <= 5) & (owner[at[j]] == owner[hit])]] = True
    size = np.maximum(np.diff(texts.offsets), 1)
    by_byte = lambda table: np.add.reduceat(np.append(table[texts.data], 0), texts.offsets[:-1]) * (np.diff(texts.offsets) > 0)
    capitals, marks, punct = (by_byte(t.astype(np.int64)) for t in (_UPPER, _MARKS, _PUNCT))
    upper = np.concatenate([[0], np.cumsum(_UPPER[texts.data])])
    shouted = (upper[words.ends] - upper[words.starts] == words.ends - words.starts) & (words.ends - words.starts >= 3)
    # Tokens of letters mixed with digits or signs, and those that read as an insult when these are undone.
    tokens = Texts(texts.data, texts.offsets).words(_TOKEN, lower=True)
    letters = np.concatenate([[0], np.cumsum(_LETTER[tokens.data])])
    inside = letters[tokens.ends] - letters[tokens.starts]
    mixed = (inside > 0) & (inside < tokens.ends - tokens.starts)
    undone = mixed & _member(_INSULTS, _ranges(_LEET[texts.data].astype(U) + U(1), tokens.starts, tokens.ends, _BASES[0]))
    by_token = lambda v: np.bincount(tokens.texts(), v, n)
    return np.column_stack([
        np.log1p(count), add(weak) / per, add(strong) / per, add(odds) / per, most, np.log1p(add(strong)), add(insult) / per, np.log1p(add(insult)), np.log1p(add(near)), add(second) / per,
        capitals / size, add(shouted) / per, marks / size, punct / size, by_token(mixed) / per, np.log1p(by_token(undone)), add((words.ends - words.starts).astype(float)) / per,
    ])


def with_features(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """`keep` columns and `_features`, an array of doubles."""
    bound_batches(docs.sparkSession)
    slim = docs.select(*dict.fromkeys([*keep, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, texts in slices(batch.column("text"), SLICE):
                x = features(texts, lexicon)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, to - at) for c in keep), flat], names=[*keep, "_features"])

    return slim.mapInArrow(run, T.StructType([*(slim.schema[c] for c in keep), T.StructField("_features", T.ArrayType(T.DoubleType()))]))


def held_out(doc_id="doc_id"):
    """Rows whose labels no fit may use."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn_lexicon(texts: DataFrame, terms: int = TERMS) -> list[tuple[int, str, float]]:
    """Terms (kind, text, log-odds) that toxic texts of (text, toxic) hold more often, at most `terms` of each kind."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), 1))
    base = texts.select("toxic", words.alias("w"))
    kinds = [base.select("toxic", F.lit(0).alias("kind"), F.explode("w").alias("term"))]
    for k in PREFIXES:
        cut = F.array_distinct(F.transform(F.filter("w", lambda w, k=k: F.length(w) >= k), lambda w, k=k: F.substring(w, 1, k)))
        kinds.append(base.select("toxic", F.lit(k).alias("kind"), F.explode(cut).alias("term")))
    every = kinds[0]
    for other in kinds[1:]:
        every = every.unionByName(other)
    total = texts.agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c")).first()
    seen = every.groupBy("kind", "term").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c")).where(F.col("t") >= LEAST_DOCS)
    odds = F.log((F.col("t") + 0.5) / (total.t + 1)) - F.log((F.col("c") + 0.5) / (total.c + 1))
    found = seen.withColumn("odds", odds).where(F.col("odds") >= WEAK)
    out = []
    for kind in (0, *PREFIXES):
        out += [(kind, r.term, r.odds) for r in found.where(F.col("kind") == kind).orderBy(F.desc("odds"), F.desc("t"), "term").limit(terms).collect()]
    return out


class Model:
    """A fitted scorer. prior: the score of everything where there was nothing to learn from."""

    def __init__(self, lexicon: Lexicon, trees=None, calibration=None, prior: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.prior = lexicon, trees, calibration, prior

    def score(self, docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """`keep` columns of docs (default: doc_id) and score, 0 to 1; one row for each row, null texts as empty ones."""
        keep = keep or ["doc_id"]
        if self.trees is None:
            return docs.select(*keep, F.lit(self.prior).alias("score"))
        rows = with_features(docs, self.lexicon, keep).withColumn("_vector", array_to_vector("_features"))
        rows = self.trees.transform(rows).withColumn("_raw", vector_to_array("probability")[1])
        rows = self.calibration.transform(rows)
        # Isotonic steps tie many rows; a thousandth of the trees' own score keeps their order.
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.999 * F.col("_step") + 0.001 * F.col("_raw")))
        return rows.select(*keep, score.alias("score"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, trees: int = 20, depth: int = 4) -> Model:
    """Learn from at most `rows` rows of labels (doc_id, toxic) that aren't held out and have a document.

    Several labels of a document count as toxic if one does; of several texts under one id, that with the least hash
    is learnt from, so reruns agree; null labels and ids are left out. With fewer than five
    documents of either kind in a part, the model gives every document the mean label (0 without any).
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(rows)  # narrow rows, bounded
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    part = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(20))
    sample = checkpoint(texts.withColumn("part", F.when(part < 9, 0).when(part < 16, 1).otherwise(2)))
    counts = {(r.part, r.toxic): r["count"] for r in sample.groupBy("part", "toxic").count().collect()}
    if any(counts.get((p, t), 0) < 5 for p in range(3) for t in (0, 1)):
        total = sum(counts.values())
        return Model(Lexicon([]), prior=sum(n for (_, t), n in counts.items() if t) / total if total else 0.0)
    lexicon = Lexicon(learn_lexicon(sample.where("part = 0")))
    ready = checkpoint(with_features(sample.where("part > 0").repartition(8, "doc_id"), lexicon, ["part", "toxic"]).select("part", F.col("toxic").cast("double").alias("label"), array_to_vector("_features").alias("_vector")))
    gbt = GBTClassifier(featuresCol="_vector", labelCol="label", predictionCol="_predicted", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=5, cacheNodeIds=False, maxMemoryInMB=64)
    fitted = gbt.fit(ready.where("part = 1"))
    scored = fitted.transform(ready.where("part = 2")).select("label", vector_to_array("probability")[1].alias("_raw"))
    return Model(lexicon, fitted, IsotonicRegression(featuresCol="_raw", labelCol="label", predictionCol="_step").fit(scored))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; labels, lang, source and doc_id aren't features.

    Null texts score as empty ones do; texts are read whole, however long; repeated rows have the same score each; other
    columns of either table don't matter. An empty table gives an empty result; without labels to learn from see fit().
    """
    scored = fit(docs, labels).score(docs)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs without those that score `threshold` or more, all columns kept, whatever their names and types; repeated rows go or stay together, null texts count as empty."""
    return model.score(docs.select(F.struct(*docs.columns).alias("_row"), "text"), ["_row"]).where(F.col("score") < threshold).select("_row.*")
