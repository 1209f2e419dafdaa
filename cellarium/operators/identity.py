"""Entity resolution of the catalogue: redirects, merges, makers by permit."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cellarium.functions import text as T
from cellarium.session import materialise


def flatten_redirects(redirects: DataFrame, most_hops: int = 8) -> DataFrame:
    """``id, target``: where every redirect ends; null for cycles and chains of ``most_hops`` or more.

    Pointer doubling: three self-joins follow up to eight hops. Redirects are one row per alias.
    """
    # `hops` counts the redirects followed so far; a target that is no alias itself is final.
    now = redirects.where("id is not null and target is not null").groupBy("id").agg(F.min("target").alias("target")).withColumn("hops", F.lit(1))
    reach = 1
    while reach < most_hops:
        nxt = now.select(F.col("id").alias("target"), F.col("target").alias("t2"), F.col("hops").alias("h2"))
        now = now.join(nxt, "target", "left").select("id", F.coalesce("t2", "target").alias("target"), (F.col("hops") + F.coalesce("h2", F.lit(0))).alias("hops"))
        reach *= 2
    return now.select("id", F.when(F.col("hops") < most_hops, F.col("target")).alias("target"))


def _words(name):
    return F.array_distinct(F.filter(F.split(T.fold(name), "[^a-z0-9]+"), lambda w: w != ""))


def rarest_word(rows: DataFrame, key: str, words: str) -> DataFrame:
    """``word`` with ``key, words``: the word of every row that the fewest rows hold; rows without words are left out.

    What contains all words of a row contains this one, so containment is a join on it.
    """
    each = rows.select(key, F.explode(words).alias("word"))
    df = each.groupBy("word").agg(F.count("*").alias("df"))
    first = each.join(df, "word").groupBy(key).agg(F.min(F.struct("df", "word"))["word"].alias("word"))
    return rows.select(key, words).join(first, key)


def exact_buckets(names: DataFrame) -> DataFrame:
    """Groups of names with the same set of words: ``k, n, keeper`` (the smallest id)."""
    k = F.array_join(F.array_sort(_words(F.col("name"))), " ")
    return names.groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.min("id").alias("keeper")).where("n > 1")


def containment_merges(names: DataFrame) -> DataFrame:
    """``alias, canonical`` where all words of one name stand in exactly one longer name with the same digits.

    Blocked on shared words; one name of each set of words is compared.
    """
    n = names.select("id", _words(F.col("name")).alias("w"), F.regexp_replace("name", "[^0-9]", "").alias("digits"))
    n = n.groupBy(F.array_sort("w").alias("w")).agg(F.min(F.struct("id", "digits")).alias("m")).select("m.id", "m.digits", "w")
    x = n.select("id", "digits", "w", F.explode("w").alias("k"))
    y = x.select(F.col("id").alias("canonical"), F.col("digits").alias("digits"), F.col("w").alias("cw"), "k")
    pairs = x.join(y, ["k", "digits"]).where((F.size("w") < F.size("cw")) & (F.size(F.array_except("w", "cw")) == 0)).select(F.col("id").alias("alias"), "canonical").distinct()
    return pairs.groupBy("alias").agg(F.min("canonical").alias("canonical"), F.count("*").alias("n")).where("n = 1").drop("n")


# Words that carry no product's identity, words of an age that may be missing on one side, and least likeness of two spellings of a brand.
STYLE = frozenset(
    (
        "abbaye abbey abv aged agricole alc ale ales amaro amber american and anejo anos ans apa aperitif aperitivo artificial artificially beer beers belgian "
        "belgisch beverage bier biere birra bitter bitters blanc blanche blanco blended blond blonde bock bottle bottled bottles bourbon brandy brasserie "
        "brewed brewers brewery brewing brown brune by can canadian canned cans caribbean cerveja cerveses cerveza cider cie cl classic co coconut cognac color "
        "colored colors colour coloured colours contents craft crowler dark double draft draught drink drinks dry dubbel dunkel ecosse extra flavor flavored "
        "flavors flavour flavoured flavours for fresh from german gin gold golden gose grain grappa growler hazy hefeweizen helles highland hop hopped hops "
        "imperial imported india ipa irish islay japanese juicy keg kentucky kolsch kriek lager lagers lambic light limoncello liqueur liquore lite liter "
        "liters litre litres london malt mexican mezcal milliliter milliliters ml natural net new of old organic original ounce ounces ouzo oz pack pale pils "
        "pilsener pilsner pint pints pivo porter premium product radler red reposado reserve rhum ron rouge rum rye saison sake sambuca scotch seltzer session "
        "shandy silver single sixpack soju special speyside spiced spirit spirits stout straight strong style tennessee tequila the traditional trappist tripel "
        "triple unknown vermouth vermut vodka vol volume vsop weiss weisse weizen wheat whiskey whisky wine wit witbier with year years "
    ).split()
)
AGE = frozenset("ans ano anos anni jahre jahren year years yr yrs old aged".split())
BRAND_LIKENESS = 0.8


def is_generic(words: Column) -> Column:
    """Whether a name's words are all words of style, so that it names a class."""
    return (F.size(words) > 0) & F.forall(words, lambda w: w.isin(*STYLE))


def is_anonymous(words: Column) -> Column:
    """Whether no word of four letters or more tells more than a style."""
    return ~F.exists(words, lambda w: (F.length(w) >= 4) & ~w.isin(*STYLE))


def identifying_tokens(name: Column) -> Column:
    """Distinct words of three letters or more that tell more than a style, and numbers of four digits or more."""
    tokens = F.regexp_extract_all(T.fold(name), F.lit("([a-z]+|[0-9]+)"), 1)
    telling = lambda t: (F.length(t) >= 3) & t.rlike("^[a-z]") & ~t.isin(*STYLE) | t.rlike("^[0-9]{4,}$")
    return F.array_distinct(F.filter(tokens, telling))


def without_legal_form(brand: Column) -> Column:
    return F.trim(F.regexp_replace(brand, r"(?i)[ ,]+(llc|inc\.?|ltd\.?|co\.?|corp\.?|company)$", ""))


def shown_name(name: Column, brand: Column) -> Column:
    """A product's name without the brand that stands beside it anyway."""
    n, b = F.trim(name), F.coalesce(brand, F.lit(""))
    repeats = (b != "") & (F.lower(n) != F.lower(b)) & F.startswith(F.lower(n), F.concat(F.lower(b), F.lit(" ")))
    return F.when(repeats, F.trim(F.substring(n, F.length(b) + 1, F.length(n)))).otherwise(n)


@F.pandas_udf(DoubleType())
def letters_likeness_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two texts by the letters they hold in order of the alphabet."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def _letters(words: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(F.array_join(words, ""), ""), lambda c: c != "")), "")


def product_merges(products: DataFrame) -> DataFrame:
    """``alias, canonical`` of ``id, name, brand``: the name of one product stands in the name and brand of exactly one longer-named product.

    Only words of an age may be missing there if others than words of style remain; numbers are
    equal, brands compatible (one absent, part of the other product, or spelt alike), a word other
    than of style is shared, and the ids are of different sources. Products of the same words,
    numbers, brand and source are compared once, but each gets its own row and counts as a candidate.

    Blocked on the two rarest words that tell the name, which the other product must hold.
    """
    arr = lambda words: F.array(*[F.lit(w) for w in sorted(words)])
    words = lambda c: F.coalesce(F.array_sort(F.array_distinct(F.filter(F.split(T.unaccent(F.lower(c)), r"[^\p{L}]+"), lambda w: F.length(w) >= 2))), F.array().cast("array<string>"))
    telling = lambda c: F.filter(c, lambda w: ~w.isin(*STYLE))
    key = ["nt", "bt", "digits", "src"]
    p = products.where("id is not null").select("id", words(F.col("name")).alias("nt"), words(F.col("brand")).alias("bt"), F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("name", F.lit(r"\d+"), F.lit(0)))), " ").alias("digits"), F.substring_index("id", ":", 1).alias("src")).where(F.size("nt") > 0)
    p = p.withColumn("sig", F.unhex(F.sha2(F.to_json(F.struct(*key)), 256)))
    s = p.groupBy("sig").agg(*[F.first(k).alias(k) for k in key], F.count("*").alias("n"), F.min("id").alias("id"))
    own = F.when((F.size("bt") > 0) & (F.col("bt") != F.array(F.lit("unknown"))) & (F.size(F.array_except("bt", "nt")) > 0), F.col("bt"))
    s = materialise(s.withColumn("full", F.array_union("nt", "bt")).withColumn("ident", own))
    # Products that could be the longer one are listed under each telling word and each pair of them.
    told = s.select("*", F.array_sort(telling(F.col("full"))).alias("tw"))
    pairs = F.flatten(F.transform("tw", lambda x, i: F.transform(F.slice("tw", i + 2, F.size("tw")), lambda y: F.concat_ws(" ", x, y))))
    # Words travel as one text, which takes less room than an array.
    sup = told.select("digits", F.explode(F.concat("tw", pairs)).alias("key"), F.size("nt").alias("s_size"), *[F.array_join(c, " ").alias(f"s_{c}") for c in ("full", "ident")], *[F.col(c).alias(f"s_{c}") for c in ("src", "n", "id")])
    df = told.select(F.explode("tw").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    named = F.array_except(telling(F.col("nt")), arr(AGE))
    rare = s.select("sig", F.explode(named).alias("word")).join(df, "word").groupBy("sig").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("r"))
    two = F.array_join(F.array_sort(F.transform(F.slice("r", 1, 2), lambda x: x["word"])), " ")
    sub = told.join(rare, "sig", "left").select("*", F.explode(F.when(F.col("r").isNotNull(), F.array(two)).otherwise(F.col("tw"))).alias("key"))
    within = lambda a, b: F.size(F.array_except(a, b)) == 0
    missing = F.array_except("nt", "s_full")
    covered = (F.size(missing) == 0) | (within(missing, arr(AGE)) & (F.size(telling(F.array_except("nt", missing))) > 0))
    met = sub.join(sup, ["digits", "key"]).where((F.col("src") != F.col("s_src")) & (F.col("s_size") > F.size("nt")))
    met = met.withColumn("s_full", F.split("s_full", " ")).where(covered).withColumn("s_ident", F.split("s_ident", " "))
    either = F.col("ident").isNull() | F.col("s_ident").isNull() | within("ident", "s_full") | within("s_ident", "full")
    met = met.withColumn("ok", F.coalesce(either, F.lit(False)))
    # Letters are only needed where nothing else settles the brands.
    met = met.select("sig", "s_id", "s_n", "ok", F.when(~F.col("ok"), _letters(F.col("ident"))).alias("a"), F.when(~F.col("ok"), _letters(F.col("s_ident"))).alias("b")).distinct()
    met = met.where("ok").select("sig", "s_id", "s_n").unionByName(met.where("not ok").where(letters_likeness_udf("a", "b") >= BRAND_LIKENESS).select("sig", "s_id", "s_n"))
    one = met.groupBy("sig").agg(F.sum("s_n").alias("n"), F.min("s_id").alias("canonical")).where("n = 1")
    return p.join(one, "sig").select(F.col("id").alias("alias"), "canonical")


# Words that end a maker's name without naming it.
_HOUSE = "brewing|distillers|cellars|company|co|inc|llc|ltd|works|beverage|wine|estates|imports|group"


def maker_merges(makers: DataFrame) -> DataFrame:
    """``id, core, canonical``: makers by the core of their name; the shortest name, then id, stands for all."""
    core = F.trim(F.regexp_replace(F.regexp_replace(F.lower("name"), "^the ", ""), rf"( ({_HOUSE})[.,]*)+$", ""))
    c = makers.select("id", "name", core.alias("core")).where("core <> ''")
    best = c.groupBy("core").agg(F.min(F.struct(F.length("name").alias("n"), "id")).alias("m")).select("core", F.col("m.id").alias("canonical"))
    return c.join(best, "core").select("id", "core", "canonical")


def absorb(members: DataFrame, group: list[str], order: str, fields: list[str]) -> DataFrame:
    """Per group and field, the first non-empty value in order; an aggregate, so no group is gathered."""
    first = lambda f: F.min_by(F.when(F.col(f).isNotNull() & (F.col(f) != ""), F.col(f)), F.when(F.col(f).isNotNull() & (F.col(f) != ""), F.col(order))).alias(f)
    return members.groupBy(*group).agg(*[first(f) for f in fields])


def permit_producers(filings: DataFrame) -> DataFrame:
    """``permit_no, producer_id, name, region``: a producer per permit, named by its most filed brand,
    placed where at least 80 % of its filings come from."""
    f = filings.where("permit_no is not null")
    n = f.where("brand_name is not null").groupBy("permit_no", "brand_name").count()
    named = n.groupBy("permit_no").agg(F.min(F.struct((-F.col("count")).alias("c"), "brand_name")).alias("m")).select("permit_no", F.col("m.brand_name").alias("name"))
    o = f.where("origin_desc is not null").groupBy("permit_no", "origin_desc").agg(F.count("*").alias("c"))
    o = o.withColumn("t", F.sum("c").over(Window.partitionBy("permit_no"))).where("c >= 0.8 * t").groupBy("permit_no").agg(F.min("origin_desc").alias("region"))
    return named.join(o, "permit_no", "left").select("permit_no", F.concat(F.lit("permit:"), T.slug(F.col("permit_no"))).alias("producer_id"), "name", "region")
