"""Values that only stand for "not stated"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that say nothing, compared after lower-casing and dropping all but letters and digits.
NOT_STATED = [
    "", "na", "none", "null", "nil", "nan", "unknown", "unknownproduct", "unknownstyle", "unnamed", "untitled", "notstated", "notavailable", "notapplicable", "notspecified",
    "notgiven", "notprovided", "nonegiven", "nonestated", "nostyle", "noname", "noinfo", "tbd", "tba", "tbc", "unbekannt", "inconnu", "desconocido", "sinnombre", "ohnenamen", "sansnom", "missing", "unspecified", "undefined", "various", "seelabel",
    "productname", "namenotset", "nodescription", "nodescriptionavailable", "descriptionnotavailable", "comingsoon", "descriptioncomingsoon", "othernone", "noneother", "todo", "test", "xxx", "x", "styleunknown", "other", "misc",
]


def says_nothing(text: Column) -> Column:
    """True for null, blank, punctuation and placeholder texts; never null."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")
    return bare.isin(NOT_STATED)


def is_non_alcoholic(*texts: Column) -> Column:
    """True if one of the texts holds the word "alcoholic", up to three typing errors.

    In this domain the word only occurs as "non-alcoholic". Words may be run together, so the start
    of every word is compared, with and without the prefix.
    """
    bare = F.translate(F.lower(F.concat_ws(" ", *texts)), "0", "o")
    words = F.split(bare, r"[^\p{L}]+")
    near = lambda w: (F.levenshtein(F.substring(w, 1, 9), F.lit("alcoholic")) <= 3) | (F.levenshtein(F.substring(w, 1, 12), F.lit("nonalcoholic")) <= 3)
    return bare.rlike("a[a-z]?l|lc") & F.coalesce(F.exists(words, lambda w: (F.length(w) >= 6) & near(w)), F.lit(False))


def stated_abv(value: Column, *class_texts: Column) -> Column:
    """The strength if it can be one, else null: 0 < value <= 95, or the true zero of a non-alcoholic drink."""
    return F.when(F.isnan(value), None).when((value > 0) & (value <= 95), value).when((value == 0) & is_non_alcoholic(*class_texts), F.lit(0.0))


def stated_ibu(value: Column) -> Column:
    """The bitterness if it can be one (0 to 200), else null."""
    return F.when(~F.isnan(value) & value.between(0, 200), value)
