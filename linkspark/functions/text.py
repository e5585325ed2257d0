"""Normalisation and key expressions. All native but `normalize_unicode`, which needs NFKC and case folding."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NOT_WORD = r"[^\p{L}\p{N}]+"


def normalize(c: Column) -> Column:
    """Lower case, runs of anything but letters and numbers to one space, trimmed; null gives ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), NOT_WORD, " "))


def normalize_native(c: Column) -> Column:
    """The Unicode variant for text where case folding differs from lower case by sharp s only and NFKC changes nothing."""
    return F.trim(F.regexp_replace(F.replace(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ß"), F.lit("ss")), F.lit("&"), F.lit(" and ")), NOT_WORD, " "))


@F.pandas_udf(StringType())
def nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: "" if x is None else x.lower() if x.isascii() else unicodedata.normalize("NFKC", x).casefold())


def normalize_unicode(c: Column) -> Column:
    """NFKC, case fold, '&' to ' and ', other marks to spaces: one Arrow pass, the rest native."""
    return F.trim(F.regexp_replace(F.replace(nfkc_casefold(c), F.lit("&"), F.lit(" and ")), NOT_WORD, " "))


def compact(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def tokens(c: Column) -> Column:
    """Distinct words in code-point order."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(c, " "))), " ")


def name_core(c: Column) -> Column:
    return F.regexp_replace(c, " group$", "")


def first_word(c: Column, least: int = 5) -> Column:
    w = F.split_part(c, F.lit(" "), F.lit(1))
    return F.when(F.length(w) >= least, w)


def prefix(c: Column, n: int, gated: bool = True) -> Column:
    p = F.left(c, F.lit(n))
    return F.when(F.length(c) >= n, p) if gated else p


def suffix(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def composite(*parts: Column, strict: bool = False) -> Column:
    """Components joined by a bar; null if one is empty, unless strict (then empty components stay)."""
    filled = [F.coalesce(p, F.lit("")) for p in parts]
    key = F.concat_ws("|", *filled)
    if strict:
        return key
    usable = filled[0] != ""
    for p in filled[1:]:
        usable = usable & (p != "")
    return F.when(usable, key)
