"""Stages from raw documents to catalogue entities, as functions of DataFrames.

A connector is a pair of functions: ``normalize`` turns bronze documents into none, one or several
silver records, ``promote`` turns silver records into gold entities. :func:`run_pipeline` writes every
stage before the next one reads it, so a run that breaks off leaves whole stages behind and a second
run writes the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellarium.functions import text as T
from cellarium.operators.classify import category_of
from cellarium.operators.medallion import latest_rows

# ---- names

# Words that keep their capitals.
KEEP_UPPER = "ipa dipa neipa apa xpa esb ipl pbr abv ibu usa us uk nz vsop vs xo bba bbl ii iii iv vi vii viii ix xi xii llc inc lp dc nyc la sf pa ny ca n/a n.a".split()
# Single words that name a kind of drink and so no product.
BARE_CATEGORY = "gin rum rhum beer beers ale ales ipa lager lagers pils pilsner stout porter vodka whisky whiskey wine cider eau spirit spirits liqueur mini biere bière cerveza birra tequila tequilas mezcal bourbon scotch brandy cognac sake ouzo grappa absinthe schnapps sherry vermouth mead soju shochu".split()
# What a page says while it loads, and what only food says.
PLACEHOLDERS = ["chargement", "loading", "unknown", "unknown product", "sans nom", "no name", "n/a", ""]
NOT_DRINKS = ["yaourt", "yogurt", "yoghurt", "vinegar", "vinaigre", "pasta", "pâtes", "pates", "sodas", "soft drink"]
# The first family whose words occur in a list of categories.
OPEN_CATEGORIES = [
    ("spirit", r"\bwhisk|\bbourbon|\bscotch\b|\bspirit|\bliqueur|\bliquor|\bvodka|\bgins?\b|\brums?\b|\brhums?\b|\btequila|\bmezcal|\bcognac|\bbrandy|\bbrandies|\barmagnac|\bcalvados|\beaux?[\s-]de[\s-]vie|\bcacha[çc]a|\bgrappa|\bouzo|\bamaro|\bvermouth|\bap[eé]ritif|\babsinthe|\bschnapps|\baquavit|\bpastis|\bsambuca|\btriple sec|\bbitters|\bsake\b|\bsoju"),
    ("cider", r"\bcidres?\b|\bcider"),
    ("wine", r"\bwines?\b|\bchampagne|\bprosecco|\bsherry|\bsparkling"),
    ("beer", r"\bbeers?\b|\bbiers?\b|\bbirra|\bcerveza|\bcerveja|\bales?\b|\blager|\bpils|\bstout|\bipas?\b|\bporter|\bsaison|\bweizen|\bweiss|\bweiß"),
    ("beer", r"\bbeverage|\bdrink|\balcohol"),
]


def title_case(text: Column) -> Column:
    """A name in capitals made readable; acronyms stay, and so does a text with any small letter."""
    cap = lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, F.lit(2), F.length(s))))
    tail = lambda s: F.when(F.length(s) > 1, cap(s)).otherwise(F.lower(s))
    parts = lambda w: F.array_join(F.transform(F.split(w, "'"), lambda s, i: F.when(i == 0, cap(s)).otherwise(tail(s))), "'")
    core = lambda w: F.lower(F.regexp_replace(w, r"""^[.,()&\-/'"]+|[.,()&\-/'"]+$""", ""))
    bare = F.trim(text)
    words = F.transform(F.split(bare, r"\s+"), lambda w: F.when(core(w).isin(KEEP_UPPER), w).otherwise(parts(w)))
    return F.when((bare != "") & (bare == F.upper(bare)), F.array_join(words, " ")).otherwise(text)


def says_none(fanciful: Column) -> Column:
    """Whether a name is blank, dashes, or the word "none" in any dress; true for null."""
    bare = F.trim(F.coalesce(fanciful, F.lit("")))
    letters = F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}]", "")
    return (bare == "") | (letters == "none") | bare.rlike(r"^[\-–— ]+$")


def fanciful_name(text: Column) -> Column:
    return F.when(says_none(text), F.lit("")).otherwise(title_case(text))


def branded_name(brand: Column, fanciful: Column) -> Column:
    """The brand in front of the name, unless the name holds it; the brand alone if there is no name."""
    b, f = F.trim(brand), F.trim(fanciful)
    return F.when(says_none(fanciful), b).when((b != "") & ~F.contains(F.lower(f), F.lower(b)), F.concat_ws(" ", b, f)).otherwise(f)


def weak_name(name: Column) -> Column:
    """Whether a name is too thin to stand alone: blank, up to three digits, a bare category, without Latin
    letters, or up to three small letters."""
    return F.trim(F.coalesce(name, F.lit(""))).rlike(rf"^$|^[0-9]{{1,3}}$|^(?iu:{'|'.join(BARE_CATEGORY)})$|^(?s)(?=.*[^0-9])[^A-Za-z]+$|^\p{{Ll}}{{1,3}}$")


def open_name(product_name: Column, brand: Column) -> Column:
    """What to call a row of an open corpus: its name if that can stand, else with its brand; null if neither can."""
    pn, b = F.trim(F.coalesce(product_name, F.lit(""))), F.trim(F.coalesce(brand, F.lit("")))
    both = F.trim(F.concat_ws(" ", b, pn))
    rescued = F.when(pn.rlike(r"^[\x00-\x7f]+$") & ~F.contains(F.lower(b), F.lower(pn)), F.concat_ws(" ", b, pn)).otherwise(b)
    return F.when(~weak_name(pn), pn).when((b == "") | weak_name(b), F.when((both != "") & ~weak_name(both), both)).otherwise(rescued)


def open_category(categories: Column) -> Column:
    low = F.lower(F.coalesce(categories, F.lit("")))
    return F.coalesce(*[F.when(low.rlike(p), F.lit(c)) for c, p in OPEN_CATEGORIES])


def is_drink(name: Column, categories: Column) -> Column:
    """Whether nothing a row says is only said of food, and its name is not that of a page still loading."""
    said = F.concat_ws(" ", name, categories)
    loading = F.regexp_replace(F.lower(F.trim(name)), r"[ .…]+$", "").isin(PLACEHOLDERS)
    return ~said.rlike(rf"(?iu){'|'.join(NOT_DRINKS)}") & ~loading


def slug(text: Column) -> Column:
    return F.coalesce(F.when(T.slug(text) != "", T.slug(text)), F.lit("x"))


# ---- recipes

def ingredient_role(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.rlike("malt|barley|wheat|oat|rye"), "base_malt").when(n.contains("hop"), "aroma_hop").when(n.contains("yeast"), "yeast").when(n.contains("water"), "water_salt").otherwise("other")


def ingredient_kind(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.contains("hop"), "hop").when(n.rlike("malt|barley"), "malt").when(n.contains("yeast"), "yeast").otherwise("other")


def split_ingredients(text: Column) -> Column:
    """The ingredients of a list parted by commas or semicolons, with role and kind; empty for null."""
    names = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(names, lambda x: F.struct(ingredient_role(x).alias("role"), ingredient_kind(x).alias("entity_kind"), x.alias("raw_name")))


# ---- connectors: silver records and gold entities

def normalize_open(bronze: DataFrame) -> DataFrame:
    """Silver of an open corpus: ``id, bronze_id, upc, name, brand, ingredients_text, abv, category``; rows
    without a usable name, without a drink's category, or of food are dropped."""
    brand = F.trim(F.split(F.coalesce("brands", F.lit("")), ",")[0])
    r = bronze.select(F.col("id").alias("bronze_id"), F.col("code").alias("upc"), open_name(F.col("product_name"), brand).alias("name"), brand.alias("brand"), "ingredients_text", F.col("alcohol_value").cast("string").try_cast("double").alias("abv"), open_category(F.col("categories")).alias("category"), "categories")
    kept = r.where("name is not null and category is not null").where(is_drink(F.col("name"), F.col("categories")))
    return kept.drop("categories").withColumn("id", F.concat("bronze_id", F.lit(":off_product:0")))


def promote_open(silver: DataFrame, source: str) -> dict[str, DataFrame]:
    """Producers, brands, products and SKUs of an open corpus, each id once."""
    s = silver.where("name is not null").withColumn("maker", F.coalesce(F.when(F.col("brand") != "", F.col("brand")), F.lit("Unknown"))).withColumn("slug", slug(F.col("maker")))
    pid = F.concat(F.lit("off:"), "upc")
    one = lambda df, *order: latest_rows(df, ["id"], [*order])
    producers = one(s.select(F.concat(F.lit(f"prod:{source}:"), "slug").alias("id"), F.col("maker").alias("name")), "name")
    brands = one(s.select(F.concat(F.lit(f"brand:{source}:"), "slug").alias("id"), F.concat(F.lit(f"prod:{source}:"), "slug").alias("producer_id"), F.col("maker").alias("name")), "name")
    products = one(s.where("upc is not null").select(pid.alias("id"), F.concat(F.lit(f"brand:{source}:"), "slug").alias("brand_id"), "category", "name", "abv", split_ingredients(F.col("ingredients_text")).alias("ingredients"), "bronze_id"), "bronze_id")
    skus = one(s.where("upc <> ''").select(F.concat(F.lit("sku:"), "upc").alias("id"), pid.alias("product_id"), F.lit("bottle").alias("container"), "upc"), "product_id")
    return {"producer": producers, "brand": brands, "product": products, "sku": skus}


def normalize_filings(filings: DataFrame) -> DataFrame:
    """Silver of filings: the last fetch of each, its names readable, placeholders erased."""
    last = latest_rows(filings.where("ttb_id is not null"), ["ttb_id"], ["fetched_at", "row_id"])
    return last.select(F.concat("ttb_id", F.lit(":cola:0")).alias("id"), "ttb_id", title_case(F.col("brand_name")).alias("brand_name"), fanciful_name(F.col("fanciful_name")).alias("fanciful_name"), "class_type", "permit_no", "permittee", "origin_desc", "abv", "upc")


def promote_filings(silver: DataFrame, source: str) -> dict[str, DataFrame]:
    """Producers by permit, brands, products and SKUs of filings that name a brand, each id once."""
    s = silver.where("brand_name <> ''")
    permit = F.trim(F.coalesce("permit_no", F.lit("")))
    maker = F.coalesce(F.when(F.col("permittee") != "", F.col("permittee")), F.col("brand_name"))
    producer = F.when(permit != "", F.concat(F.lit(f"prod:{source}:permit:"), slug(permit))).otherwise(F.concat(F.lit(f"prod:{source}:"), slug(maker)))
    brand = F.concat(F.lit(f"brand:{source}:"), slug(F.col("brand_name")))
    region = F.when(F.trim("origin_desc") != "", F.initcap(F.trim("origin_desc")))
    product = F.concat(F.lit("ttb:"), "ttb_id")
    one = lambda df, *order: latest_rows(df, ["id"], [*order])
    return {
        "producer": one(s.select(producer.alias("id"), maker.alias("name"), region.alias("region"), F.when(permit != "", permit).alias("ttb_permit"), "ttb_id"), "ttb_id").drop("ttb_id"),
        "brand": one(s.select(brand.alias("id"), producer.alias("producer_id"), F.col("brand_name").alias("name"), "ttb_id"), "ttb_id").drop("ttb_id"),
        "product": s.select(product.alias("id"), brand.alias("brand_id"), producer.alias("producer_id"), F.when(F.col("class_type").isNotNull(), category_of(F.col("class_type"))).otherwise("other").alias("category"), branded_name(F.col("brand_name"), F.col("fanciful_name")).alias("name"), F.col("class_type").alias("style"), "abv"),
        "sku": one(s.where("upc <> ''").select(F.concat(F.lit("sku:"), "upc").alias("id"), product.alias("product_id"), "upc"), "product_id"),
    }


def promote_demo(demo: DataFrame, source: str) -> dict[str, DataFrame]:
    """Producers, brands, products and SKUs of the nested demo catalogue, each id from its last row."""
    d = demo.select(F.col("producer").alias("m"), F.col("product").alias("p"), "fetched_at", "row_id").where("m.slug is not null and p.key is not null")
    last = lambda df: latest_rows(df, ["id"], ["fetched_at", "row_id"]).drop("fetched_at", "row_id")
    producer, brand, product = F.concat(F.lit(f"prod:{source}:"), "m.slug"), F.concat(F.lit(f"brand:{source}:"), "p.key"), F.concat(F.lit(f"{source}:"), "p.key")
    at = ["fetched_at", "row_id"]
    return {
        "producer": last(d.select(producer.alias("id"), "m.name", "m.kind", "m.country", "m.region", "m.lat", "m.lon", *at)),
        "brand": last(d.select(brand.alias("id"), producer.alias("producer_id"), "p.name", *at)),
        "product": last(d.select(product.alias("id"), brand.alias("brand_id"), producer.alias("producer_id"), "p.category", "p.name", "p.style", "p.abv", "p.ibu", "p.ingredients", *at)),
        "sku": last(d.where("p.upc <> ''").select(F.concat(F.lit("sku:"), "p.upc").alias("id"), product.alias("product_id"), F.coalesce("p.container", F.lit("can")).alias("container"), "p.volume_ml", "p.upc", *at)),
    }


def normalize_breweries(rows: DataFrame) -> DataFrame:
    """Silver of a directory of makers: named ones, coordinates read from text."""
    return rows.where("name <> ''").select("id", "name", "kind", "country", "region", "city", F.col("latitude").try_cast("double").alias("lat"), F.col("longitude").try_cast("double").alias("lon"))


# ---- the driver of a pipeline

def run_pipeline(spark: SparkSession, fetched: DataFrame | None, folder: str, normalize: Callable[[DataFrame], DataFrame], promote: Callable[[DataFrame], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Gold entities by type, after bronze and silver were written below ``folder``.

    Without ``fetched`` the bronze that is there is taken up again. Every stage overwrites itself, so
    running twice gives the same tables.
    """
    stage = lambda name, df: df.write.mode("overwrite").parquet(f"{folder}/{name}")
    if fetched is not None:
        stage("bronze", fetched)
    stage("silver", normalize(spark.read.parquet(f"{folder}/bronze")))
    return promote_again(spark, folder, promote)


def promote_again(spark: SparkSession, folder: str, promote: Callable[[DataFrame], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Gold entities by type from the silver below ``folder``, without a fetch."""
    gold = {}
    for kind, df in promote(spark.read.parquet(f"{folder}/silver")).items():
        df.write.mode("overwrite").parquet(f"{folder}/gold/{kind}")
        gold[kind] = spark.read.parquet(f"{folder}/gold/{kind}")
    return gold


def take_claims(claims: DataFrame, known: DataFrame, cap: int = 200) -> DataFrame:
    """``doc_id, account_id, client_id, received_at, duplicate`` of ``account_id, client_id, received_at``:
    one document per account and client id, of which the first ``cap`` of an account are taken."""
    c = claims.where("account_id is not null and client_id is not null").groupBy("account_id", "client_id").agg(F.min("received_at").alias("received_at"))
    k = F.row_number().over(Window.partitionBy("account_id").orderBy("received_at", "client_id"))
    taken = c.withColumn("k", k).where(F.col("k") <= cap).select(F.concat_ws("::", "account_id", "client_id").alias("doc_id"), "account_id", "client_id", "received_at")
    return taken.join(known.select("doc_id").distinct().withColumn("duplicate", F.lit(True)), "doc_id", "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))
