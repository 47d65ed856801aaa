"""Version order and the choice of a fix, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _part(kind: int, digits: Column) -> Column:
    bare = F.ltrim(digits, F.lit("0"))
    return F.struct(F.lit(kind).alias("k"), F.length(bare).alias("len"), bare.alias("s"))


def version_key(version: Column) -> Column:
    """Orderable key: the epoch, then each run of digits or letters. Numbers of any length compare as numbers, letters sort before them, a prefix before what it begins."""
    epoch = F.regexp_extract(version, r"^([0-9]+):", 1)
    parts = F.regexp_extract_all(F.regexp_replace(version, r"^[0-9]+:", ""), F.lit("([0-9]+|[A-Za-z]+)"), 1)
    letters = lambda p: F.struct(F.lit(0).alias("k"), F.lit(0).alias("len"), F.lower(p).alias("s"))
    return F.concat(F.array(_part(0, epoch)), F.transform(parts, lambda p: F.when(p < ":", _part(1, p)).otherwise(letters(p))))


def compare(a: Column, b: Column) -> Column:
    ka, kb = version_key(a), version_key(b)
    return F.when(ka > kb, 1).when(ka < kb, -1).when(ka == kb, 0)


def candidates(raw: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda c: F.trim(c)), lambda c: c != "")


def choose_fix(raw: Column, installed: Column) -> Column:
    """The lowest candidate above what is installed; the highest if none is; the first if nothing is installed; null without candidates."""
    keyed = F.transform(candidates(raw), lambda c, i: F.struct(version_key(c).alias("key"), i.alias("at"), c.alias("v")))

    def pick(s: Column) -> Column:
        above = F.filter(s["c"], lambda x: x["key"] > s["now"])
        highest = F.array_max(F.transform(s["c"], lambda x: F.struct(x["key"], (-x["at"]).alias("at"), x["v"].alias("v"))))["v"]
        return F.when(F.size(s["c"]) == 0, None).when(F.coalesce(installed, F.lit("")) == "", F.get(s["c"], 0)["v"]).otherwise(F.coalesce(F.array_min(above)["v"], highest))

    # An array of one, so that the keys are made once and not at each use.
    once = F.array(F.struct(keyed.alias("c"), version_key(installed).alias("now")))
    return F.get(F.transform(once, pick), 0)
