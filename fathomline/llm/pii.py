"""Personal data with obfuscation seen through, spans kept in the source's characters.

The base patterns run over the text as it is. Then transducers rewrite the disguises (homoglyphs and full-width
forms to ASCII, invisible characters to nothing, spelled digits to digits, at/dot words and brackets to signs).
Each keeps, for every character of its output, the source characters that it came from, so what the patterns
find in the rewritten text is mapped back to source spans. Spans that overlap a base span aren't added.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .session import bound_batches

KINDS = ("email", "ip", "card", "phone")
#: An address' local part; what follows its @; and the other base patterns. A number is tried from its first digit
#: only: from a later one it could match no more. So the work is in proportion to the text, whatever its runs.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
BASE = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def holds(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))
    digits = _NOT_DIGIT.sub("", found)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses that don't overlap: from each @ back to the first sign that a local part can't have, and on over the host."""
    low = 0  # no address starts before this
    at = text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(_LOCAL))
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
        low = host.end() if host else at + 1
        at = text.find("@", low)


def matches(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of the base patterns; a match that fails its test is dropped and not tried again."""
    out = [(0, a, b) for a, b in emails(text)]
    for k, kind in enumerate(KINDS[1:], 1):
        if kind != "phone" or "+" in text:
            out += [(k, m.start(), m.end()) for m in BASE[kind].finditer(text) if holds(kind, m.group())]
    return out


# Letters of other scripts that look like Latin ones.
_LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ɑ": "a", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "．": ".", "＠": "@", "﹫": "@", "＋": "+",
}
_INVISIBLE = "­​‌‍⁠﻿"
# Spelled digits in the corpus' languages.
_SPELLED = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
_DIGIT_WORDS = {*_SPELLED, *"0123456789", *"dot point punkt dash hyphen".split()}
_NUMBER = "|".join(sorted(_SPELLED, key=len, reverse=True))
#: Three spelled digits (or single ones between them) at least: lone number words are ordinary prose.
_SPELLED_RUN = re.compile(rf"(?i)(?<![^\W_])(?:plus[ ,.-]+)?(?:{_NUMBER})(?:[ ,.-]{{1,2}}(?:{_NUMBER}|[0-9]|dot|point|punkt|dash|hyphen)){{2,}}(?![^\W_])")
_TOKEN = re.compile(rf"(?i)plus|{_NUMBER}|[0-9]|dot|point|punkt|dash|hyphen|[ ,.-]+")
#: name (of up to nine parts) at host dot tld, with or without brackets; bare words only in the whole pattern.
_AT = r"(?:\s*[\[({<]\s*(?:at|@|arroba|ät)\s*[\])}>]\s*|\s+(?:at|arroba|ät)\s+(?!(?:the|a|an|this|that|my|our|your|his|her|its|their)\s)|\s*@\s*)"
_DOT = r"(?:\s*[\[({<]\s*(?:dot|\.|punkt|point|punto)\s*[\])}>]\s*|\s+(?:dot|punkt|point|punto)\s+|\s?\.\s?(?=[A-Za-z0-9-]))"
_WORDED = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?:(?:\s+(?:dot|punkt|punto)\s+|\s*[\[({{<]\s*(?:dot|\.|punkt|point|punto)\s*[\])}}>]\s*)[A-Za-z0-9_%+-]+){{0,8}}(?P<at>{_AT})[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+")
_AT_RE, _DOT_RE = re.compile("(?i)" + _AT), re.compile("(?i)" + _DOT)
_BRACKETED_DOT = re.compile(r"(?i)(?<=[0-9])\s*[\[({<]\s*(?:dot|\.|punkt|point|punto)\s*[\])}>]\s*(?=[0-9])")
_SIGNS = re.compile(r"(?i)[\[({<]\s*(?:at|@|dot|\.|arroba|punkt|point|punto|ät)\s*[\])}>]|\s@|@\s")
_BARE = re.compile(r"\s(?:at|arroba|ät)\s+(?!(?:the|a|an|this|that|my|our|your|his|her|its|their)\s)[a-z0-9-]+\s+(?:dot|punkt|point|punto)\s")
_DOT_WORDS = ("dot", "punkt", "point", "punto")


def disguised(text: str) -> bool:
    """Whether at/dot disguises or three spelled digits in a row can be in the text; quick, for most texts have none."""
    low = text.lower()
    if "@" in text or "[" in text or "(" in text or "{" in text or "<" in text:
        if _SIGNS.search(text):
            return True
    if any(w in low for w in _DOT_WORDS) and _BARE.search(low):
        return True
    run = 0
    for w in map(_DIGIT_WORDS.__contains__, low.replace(",", " ").replace(".", " ").replace("-", " ").split()):
        run = run + 1 if w else 0
        if run == 3:
            return True
    return False


class Tape:
    """A text under rewriting; starts[i] and ends[i] are the source span of its character i."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, range(len(text)), range(1, len(text) + 1)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace [from, to) by a string whose every character stands for the whole of it; edits in order."""
        if not edits:
            return
        text, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            text.append(self.text[at:a])
            starts.extend(self.starts[at:a])
            ends.extend(self.ends[at:a])
            if b > a and new:
                text.append(new)
                starts.extend([self.starts[a]] * len(new))
                ends.extend([self.ends[b - 1]] * len(new))
            at = b
        text.append(self.text[at:])
        starts.extend(self.starts[at:])
        ends.extend(self.ends[at:])
        self.text, self.starts, self.ends = "".join(text), starts, ends


def _ascii(c: str) -> str:
    if c in _INVISIBLE:
        return ""
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    # Digits of any script, and compatibility forms (full-width, circled, mathematical) of one ASCII character.
    n = unicodedata.decimal(c, None)
    if n is not None:
        return str(n)
    form = unicodedata.normalize("NFKC", c)
    return form if len(form) == 1 and "!" <= form <= "~" else c


_FOLD: dict[str, str] = {}
_CANDIDATE = re.compile(r"[^\x00-¬®-İĲ-ɏ]")


def fold(tape: Tape) -> None:
    edits = []
    for m in _CANDIDATE.finditer(tape.text):
        c = m.group()
        if (new := _FOLD.get(c)) is None:
            new = _FOLD[c] = _ascii(c)
        if new != c:
            edits.append((m.start(), m.end(), new))
    tape.replace(edits)


def spelled(tape: Tape) -> None:
    """Runs of spelled digits to digits; a run that follows digits, or is followed by some, joins them."""
    edits = []
    for run in _SPELLED_RUN.finditer(tape.text):
        for m in _TOKEN.finditer(tape.text, run.start(), run.end()):
            w = m.group().lower()
            new = str(_SPELLED[w]) if w in _SPELLED else "+" if w == "plus" else "." if w in ("dot", "point", "punkt") else "-" if w in ("dash", "hyphen") else "" if not w.isdigit() else w
            if new != m.group():
                edits.append((m.start(), m.end(), new))
    tape.replace(edits)


def worded(tape: Tape) -> None:
    """at and dot, in words or brackets, to signs where a whole address (or number) is around them."""
    edits = []
    for m in _WORDED.finditer(tape.text):
        if m.group("at").strip() == "@" and not re.search(r"\s|[\[({<]", m.group()):
            continue
        a, b = m.span("at")
        # A bare "at" counts only with dots in words or brackets: "me at example.com" stays prose.
        tail = tape.text[b : m.end()]
        if m.group("at").strip().lower() in ("at", "arroba", "ät", "@") and not re.search(r"(?i)\s(?:dot|punkt|point|punto)\s|[\[({<]", tail):
            continue
        for d in _DOT_RE.finditer(tape.text, m.start(), a):
            if d.group() != ".":
                edits.append((*d.span(), "."))
        edits.append((a, b, "@"))
        for d in _DOT_RE.finditer(tape.text, b, m.end()):
            if d.group() != ".":
                edits.append((*d.span(), "."))
    tape.replace(edits)
    tape.replace([(*m.span(), ".") for m in _BRACKETED_DOT.finditer(tape.text)])


def find(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, added spans), each (start, end, kind)."""
    base = [(a, b, KINDS[k]) for k, a, b in sorted(matches(text), key=lambda x: (x[1], x[0]))]
    odd = not text.isascii() and _CANDIDATE.search(text)
    if not odd and not disguised(text):
        return base, []
    tape = Tape(text)
    if odd:
        fold(tape)
    if disguised(tape.text):
        spelled(tape)
        worded(tape)
    if tape.text == text:
        return base, []
    added, taken = [], sorted((a, b) for a, b, _ in base)
    starts = [a for a, _ in taken]
    reach, most = [], 0
    for _, b in taken:
        reach.append(most := max(most, b))
    for k, a, b in sorted(matches(tape.text), key=lambda x: (x[1], x[0])):
        a, b = tape.starts[a], tape.ends[b - 1]
        i = bisect_right(starts, b - 1) - 1
        if i < 0 or reach[i] <= a:
            added.append((a, b, KINDS[k]))
    return base, added


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


FOUND = "spans array<struct<kind: string, start: long, end: long, added: boolean>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span put as its kind in angle brackets; of spans that overlap, the one that starts first covers the others."""
    parts, at = [], 0
    for a, b, kind in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))):
        if a >= at:
            parts += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def detect(docs: DataFrame, keep: list[str] | None = None, with_masked: bool = False) -> DataFrame:
    """`keep` columns of docs (default: doc_id) and FOUND: all spans by start, then kind as in KINDS.

    Offsets are code points, the end exclusive. Null and empty texts have no spans; every row gives one row; other
    columns don't matter. A span is added when its source characters overlap no base span of any kind. Texts of any
    length are read whole, in time in proportion. with_masked adds the text with its spans masked, null without spans.
    """
    keep = keep or ["doc_id"]
    bound_batches(docs.sparkSession)
    slim = docs.select(*dict.fromkeys([*keep, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], []
            for t in batch.column("text"):
                text = t.as_py() or ""
                base, added = find(text)
                both = sorted([(a, KINDS.index(k), b, k, False) for a, b, k in base] + [(a, KINDS.index(k), b, k, True) for a, b, k in added]) if base or added else ()
                rows.append([{"kind": k, "start": a, "end": b, "added": new} for a, _, b, k, new in both])
                texts.append(masked(text, base + added) if with_masked and both else None)
            more = [pa.array(texts, pa.string())] if with_masked else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(rows, _SPANS), *more], names=[*keep, "spans", *["masked"] * with_masked])

    return slim.mapInArrow(run, T.StructType([*(slim.schema[c] for c in keep), *T.StructType.fromDDL(FOUND + ", masked string" * with_masked)]))


def digests(found: DataFrame) -> DataFrame:
    """Counts of all spans by kind, base_sha256 and spans as text."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.array_join(F.transform(F.filter("spans", lambda s: ~s["added"]), text), ",")
    return found.select("doc_id", *map(count, KINDS), F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", text), ",").alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets, and n_chars, where there is one, brought up to date."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    found = detect(packed, ["_row"], with_masked=True)
    text = F.coalesce("masked", F.col("_row.text"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*(new[c].alias(c) if c in new else F.col("_row")[c].alias(c) for c in docs.columns))


def base_digest(text: str) -> str:
    """base_sha256 of one text."""
    return hashlib.sha256(joined([(a, b, KINDS[k]) for k, a, b in matches(text)]).encode()).hexdigest()
