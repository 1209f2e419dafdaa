"""Predicates of the catalogue: permits, plausible strengths, facts that may be replaced."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strengths that a drink of a category can have, and the most a non-alcoholic one has.
BANDS = {"beer": (0.5, 30.0), "cider": (1.0, 15.0), "wine": (4.0, 24.0), "sake": (4.0, 25.0), "mead": (3.0, 25.0), "rtd": (1.0, 25.0), "spirit": (10.0, 96.0), "other": (0.3, 96.0)}
NON_ALCOHOLIC_MOST = 1.2
# How a fact was obtained if a drinker's word, or an open database, may take its place.
BELOW_DRINKERS = ["llm_inferred_from_style_prior", "llm_recalled", "community_clone", "review_consensus"]
BELOW_DATABASES = ["llm_inferred_from_style_prior", "llm_recalled", "open_database"]


def importer_permit(permit: Column) -> Column:
    """Whether a permit, in lower case with hyphens, is an importer's: the class stands second, or first without a state."""
    return (F.split_part(permit, F.lit("-"), F.lit(2)) == "i") | permit.rlike("^i-[0-9]")


# What a name says of a drink without alcohol.
WITHOUT_ALCOHOL = ["0,0", "0.0", "alcohol free", "alcohol-free", "alkoholfrei", "sans alcool", "non alcoholic", "non-alcoholic", "sin alcohol", "analcolico", "0 %", "0%", "alkoholfri", "cero", "tostada 0"]


def says_non_alcoholic(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    says = F.lit(False)
    for words in WITHOUT_ALCOHOL:
        says = says | low.contains(words)
    return says


def plausible_strength(abv: Column, category: Column, name: Column) -> Column:
    """Whether a strength can be one of a drink of this category; unknown categories count as "other"."""
    band = lambda i: F.coalesce(F.create_map(*[F.lit(x) for c, b in BANDS.items() for x in (c, b[i])])[F.coalesce(category, F.lit("other"))], F.lit(BANDS["other"][i]))
    low, high = F.when(says_non_alcoholic(name), 0.0).otherwise(band(0)), F.when(says_non_alcoholic(name), NON_ALCOHOLIC_MOST).otherwise(band(1))
    return ~F.isnan(abv) & (abv >= low) & (abv <= high)


def replaceable_by_drinkers(value: Column, method: Column) -> Column:
    """What a fact is now if a drinker's word may replace it: "empty" or its method; else null."""
    return F.when(value.isNull(), "empty").when(method.isin(BELOW_DRINKERS), method)


def replaceable_by_databases(value: Column, method: Column) -> Column:
    """The same for a second-hand fact of an open database."""
    return F.when(value.isNull() | method.isNull(), "empty").when(method.isin(BELOW_DATABASES), method)


def stated_strengths(name: Column) -> Column:
    """Strengths a name states itself: a number first and its unit behind, at most 96."""
    found = F.regexp_extract_all(name, F.lit(r"(?i)(?<![\d.,])(\d{1,2}(?:[.,]\d{1,2})?)\s*(?:%|degre|degree|abv|alc|vol)"), 1)
    return F.filter(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double")), lambda x: x <= 96)
