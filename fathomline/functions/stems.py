"""English stems by Porter's second algorithm: distinct words get theirs, rows get them by a join."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import broadcast_if_small, written

#: Longer words stay as they are, so that a dictionary's rows have a bounded width.
LONGEST = 64

# Fixed values, from the algorithm's published description: words with a stem of their own, and words whose stem is final after the plural.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
FINAL = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
# Endings and what replaces them, for steps 2, 3 and 4.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = dict.fromkeys(["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"], "")
# Beginnings after which the first region starts, doubled letters, and a short last syllable (Y: a y that is a consonant).
REGION = r"^(gener|commun|arsen|.*?[aeiouy][^aeiouy])"
DOUBLE = "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"
SHORT = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"


_ENDING = {name: re.compile(f"({'|'.join(table)})$") for name, table in (("2", STEP_2), ("3", STEP_3), ("4", STEP_4), ("past", ["eed", "eedly", "ed", "edly", "ing", "ingly"]))}  # the first match from the left is the longest ending
_WORD, _FIRST, _NEXT = re.compile(rf"[a-z]{{3,{LONGEST}}}"), re.compile(REGION), re.compile("^.*?[aeiouy][^aeiouy]")


def _replaced(w: str, step: str, table: dict[str, str], allowed: Callable[[str, str], bool]) -> str:
    """w with its longest ending replaced, where allowed(ending, what stands before) holds."""
    m = _ENDING[step].search(w)
    return w[: m.start()] + table[m[1]] if m and allowed(m[1], w[: m.start()]) else w


# A worker remembers stems: batches have most of their words in common.
@functools.lru_cache(1 << 17)
def stem(word: str) -> str:
    """The stem of a word; words of other than 3 to LONGEST letters a-z are their own."""
    if not _WORD.fullmatch(word):
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", word))
    m = _FIRST.match(w)
    r1 = m.end() if m else len(w)
    m = _NEXT.match(w[r1:])
    r2 = r1 + m.end() if m else len(w)
    # Plurals.
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-3] + ("i" if len(w) > 4 else "ie")
    elif not w.endswith(("us", "ss")) and re.search("[aeiouy].+s$", w):
        w = w[:-1]
    if w in FINAL:
        return w
    # Past and progressive forms.
    if m := _ENDING["past"].search(w):
        t = w[: m.start()]
        if m[1].startswith("ee"):
            w = t + "ee" if len(t) >= r1 else w
        elif re.search("[aeiouy]", t):
            if re.search("(at|bl|iz)$", t) or (not re.search(DOUBLE, t) and r1 >= len(t) and re.search(SHORT, t)):
                w = t + "e"
            else:
                w = t[:-1] if re.search(DOUBLE, t) else t
    if re.search("^.+[^aeiouy][yY]$", w):
        w = w[:-1] + "i"
    # Derived forms.
    w = _replaced(w, "2", STEP_2, lambda a, t: len(t) >= r1 and (a != "ogi" or t.endswith("l")) and (a != "li" or t[-1:] in set("cdeghkmnrt")))
    w = _replaced(w, "3", STEP_3, lambda a, t: len(t) >= r1 and (a != "ative" or len(t) >= r2))
    w = _replaced(w, "4", STEP_4, lambda a, t: len(t) >= r2 and (a != "ion" or t.endswith(("s", "t"))))
    # A last e or l.
    t = w[:-1]
    if (w.endswith("e") and (len(t) >= r2 or (len(t) >= r1 and not re.search(SHORT, t)))) or (w.endswith("ll") and len(t) >= r2):
        w = t
    return w.lower()


def stems(words: DataFrame, word: str) -> DataFrame:
    """(word, stem) of rows with distinct words, a batch of them at a time; a null word has a null stem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = [None if w is None else stem(w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(of, pa.string())], names=["word", "stem"])

    return words.select(word).mapInArrow(run, "word string, stem string")


def stemmed(rows: DataFrame, column: str) -> DataFrame:
    """rows with the words of a column replaced by their stems: each distinct word is stemmed once, and those that change are joined back."""
    changed = broadcast_if_small(written(stems(rows.select(column).distinct(), column).where("stem <> word"), "stems"))
    met = rows.join(changed.withColumnsRenamed({"word": "_word", "stem": "_stem"}), F.col(column) == F.col("_word"), "left")
    return met.withColumn(column, F.coalesce("_stem", column)).select(*rows.columns)
