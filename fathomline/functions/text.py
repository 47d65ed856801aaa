"""Text as column expressions: ids, versions, commands, tokens, and splitting of long texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: the form of an id.
CVE_ID = r"(?i)(CVE-\d{4}-\d{4,})"
# The forms of a version in prose, with guards so that no part of a longer token counts.
_HEAD, _TAIL = r"(?<![\w.])", r"(?![\w-])(?!\.\w)"
VERSION = rf"(?U)(?i)({_HEAD}(?:\d+:)?\d+(?:\.\d+){{2,}}(?:[a-z][\w+~]*)?(?:\.[a-z][\w+~]*)*(?:-[\w.+~]*[\w+~])?{_TAIL}|{_HEAD}(?:\d+:)?\d+(?:\.\d+)+[a-z]*-[\w.+~]*[\w+~]{_TAIL})"
# Endings of files, which aren't part of a version.
EXTENSIONS = "jar war ear zip tar gz tgz bz2 xz zst whl egg deb rpm apk so dll dylib exe msi jsonc json yaml yml xml txt md sh py js pom sig asc sha256 sha512 bak old orig save tmp backup".split()
# Fixed value: commands that no plan may name.
FORBIDDEN = r"(?i)\b(rm\s+-rf\s+/|mkfs|dd\s+if=/dev/zero|:\(\)\{|curl[^|\n]*\|\s*(?:ba)?sh)"


def cve_ids(text: Column) -> Column:
    """Distinct ids in upper case, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CVE_ID), 1), lambda m: F.upper(m))))


# The address ranges below.
def _private(v: Column) -> Column:
    """Loopback, private, link-local, unspecified and mask addresses; other dotted quads may be versions."""
    part = lambda i: F.try_element_at(F.split(v, r"\."), F.lit(i)).try_cast("int")
    quad = v.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    for i in range(1, 5):
        quad = quad & (part(i) <= 255)
    a, b = part(1), part(2)
    return F.coalesce(quad & (a.isin(127, 10, 0, 255) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))), F.lit(False))


def versions(text: Column) -> Column:
    """Distinct version-like tokens, sorted; ids are taken out first, file endings dropped, addresses left out."""
    bare = F.regexp_replace(text, r"(?i)CVE-\d{4}-\d{4,}", " ")
    found = F.transform(F.regexp_extract_all(bare, F.lit(VERSION), 1), lambda m: F.regexp_replace(F.trim(m), rf"(?i)(?<=.)(\.({'|'.join(EXTENSIONS)}))+$", ""))
    keep = lambda v: ~_private(v) & ((F.length(v) - F.length(F.replace(v, F.lit("."), F.lit(""))) >= 2) | F.contains(v, F.lit("-")))
    return F.array_sort(F.array_distinct(F.filter(found, keep)))


def one_space(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def forbidden(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(FORBIDDEN), 1)))


def commands(markdown: Column) -> Column:
    """Trimmed lines of fenced blocks that are unlabelled or bash, sh or shell: the odd pieces between fences."""
    pieces = F.filter(F.transform(F.split(markdown, "```"), lambda p, i: F.when(i % 2 == 1, p)), lambda p: p.isNotNull())
    shell = F.filter(pieces, lambda p: p.rlike(r"^(bash|sh|shell)?\n"))
    lines = F.flatten(F.transform(shell, lambda p: F.split(F.regexp_replace(p, r"^(bash|sh|shell)?\n", ""), "\n")))
    return F.filter(F.transform(lines, lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def _last(window: Column, sep: str) -> Column:
    """Place of the last `sep` in window from 0, or -1."""
    at = F.locate(sep[::-1], F.reverse(window))
    return F.when(at > 0, F.length(window) - (at - 1) - len(sep)).otherwise(-1)


def split_long(text: Column, most: int = 1400, overlap: int = 150) -> Column:
    """Parts of at most `most` characters that overlap by `overlap`, each ending after the last sentence, line or space past its half, else cut hard; trimmed, without empty ones.

    The work is in proportion to the text: a part is taken from pieces of a fixed size, and parts are gathered in two
    levels, so that no step copies what all steps before it made.
    """
    size = 2 * most
    least = most // 2 - overlap  # a step moves on by so much at least
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}"), 0)

    def spread(s):
        n, pieces = s["n"], s["pieces"]

        def window(at):
            """`most` characters from `at` on: they lie in two neighbouring pieces."""
            k = (at / size).cast("int")
            return F.substring(F.concat(F.get(pieces, k), F.coalesce(F.get(pieces, k + 1), F.lit(""))), at - k * size + 1, F.lit(most))

        def cut(w):
            end = F.lit(most)
            for sep in (" ", "\n", ". "):
                place = _last(w, sep)
                end = F.when(place > most * 0.5, place + len(sep)).otherwise(end)
            return end

        def step(t, _):
            def move(w):
                end = F.when(t["at"] + most >= n, n).otherwise(t["at"] + cut(w))
                part = F.btrim(F.substring(w, F.lit(1), end - t["at"]), F.lit(" \n\t\r"))
                done = end >= n
                return F.struct(F.when(done, t["at"]).otherwise(F.greatest(end - overlap, t["at"] + 1)).alias("at"), F.concat(t["parts"], F.array(part)).alias("parts"), done.alias("done"))

            return F.when(t["done"], t).otherwise(F.get(F.transform(F.array(window(t["at"])), move), 0))

        none = F.array().cast("array<string>")
        inner = F.sequence(F.lit(1), F.ceil(F.sqrt(n / least)).cast("int") + 1)

        def row(t, _):
            start = F.struct(t["at"].alias("at"), none.alias("parts"), t["done"].alias("done"))
            return F.when(t["done"], t).otherwise(F.aggregate(inner, start, step, lambda x: F.struct(x["at"].alias("at"), F.concat(t["rows"], F.array(x["parts"])).alias("rows"), x["done"].alias("done"))))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<string>>").alias("rows"), F.lit(False).alias("done"))
        return F.filter(F.flatten(F.aggregate(inner, start, row, lambda x: x["rows"])), lambda p: p != "")

    once = F.array(F.struct(F.length(text).alias("n"), pieces.alias("pieces")))  # made once, not at each use
    return F.when(F.length(text) <= most, F.array(text)).otherwise(F.get(F.transform(once, spread), 0))


def split_table(rows: DataFrame, key: str, text: str, most: int = 1400, overlap: int = 150) -> DataFrame:
    """(key, chunk_index, content) of each part."""
    return rows.select(key, F.posexplode(split_long(F.col(text), most, overlap)).alias("chunk_index", "content"))
