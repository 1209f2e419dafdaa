"""Scores, evidence and ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarium.functions import vectors as V
from cellarium.session import materialise

#: Items up to this many are broadcast to the users; beyond, users and items meet in blocks.
BROADCAST_ITEMS = 100_000
BLOCKS = 64


def personal_score(cos: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + 0.5 * cos))


def band(score: Column) -> Column:
    return F.when(score >= 0.8, 0).when(score >= 0.6, 1).otherwise(2)


# Sources behind which drinkers or knowledge of the product stand, and the confidence knowledge needs.
RATED, KNOWN, KNOWN_FLOOR = ["review_consensus", "reconciled"], ["llm_profile", "chemistry_prior"], 0.45
EVIDENCE = ["rated", "known", "guessed"]


def evidence_tier(source: Column, confidence: Column) -> Column:
    """0 for a vector drinkers stand behind, 1 for one from knowledge of the product, 2 for a guess."""
    known = source.isin(KNOWN) & (confidence >= KNOWN_FLOOR)
    return F.when(source.isin(RATED), 0).when(known, 1).otherwise(2)


# Words that say what kind of drink a name is for, and trade words of a maker.
KIND = r"(?i)\b(tequila|mezcal|mescal|rum|ron|rhum|cacha[cç]a|vodka|gin|whisky|whiskey|scotch|bourbon|rye|soju|shochu|baijiu|sake|agave|spirit|spirits|liqueur|beer|ale|lager|stout|ipa|cider|blanco|plata|plato|silver|white|joven|reposado|a[ñn]ejo|cristalino|gold|dark|light|aged|old|extra|spiced|flavou?red|single|malt|blend|blended|straight|premium|proof|pure|dry|kentucky|tennessee|irish|japanese|canadian|american|london|caribbean|100|de|of|the|and|y)\b"
TRADE = r"(?i)\b(brewing|brewery|brewers|distillery|distilling|co\.?|company|inc\.?|llc|ltd\.?)\b"


def legible(name: Column) -> Column:
    """How well a name can stand for others: 0 well, 1 if two fields ran together, 2 if it only says its kind."""
    letters = F.regexp_replace(F.lower(F.regexp_replace(name, KIND, " ")), "[^a-z0-9]", "")
    return F.when(F.length(letters) < 3, 2).when(name.contains(" ,"), 1).otherwise(0)


def plain_name(name: Column, maker: Column) -> Column:
    """The name without its maker's, also without the maker's trade; the name itself if nothing is left."""
    whole = lambda m: F.concat(F.lit(r"(?i)\b"), F.regexp_replace(m, r"([^\p{L}\p{N} ])", r"\\$1"), F.lit(r"\b"))
    short = F.trim(F.regexp_replace(maker, TRADE, " "))
    bare = F.when(F.coalesce(maker, F.lit("")) != "", F.regexp_replace(name, whole(maker), F.lit(" "))).otherwise(name)
    bare = F.when((short != "") & (F.lower(short) != F.lower(maker)), F.regexp_replace(bare, whole(short), F.lit(" "))).otherwise(bare)
    tidy = F.trim(F.regexp_replace(bare, r"\s+", " "))
    return F.when(tidy == "", name).otherwise(tidy)


#: Profiles ranked in one go; each is a stated query against all vectors.
MOST_PROFILES = 1_000


def _against_all(profiles: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every vector with every profile and their cosine; profiles travel as one short array."""
    asked = profiles.select("user_id", "ideal").limit(MOST_PROFILES + 1)
    if asked.count() > MOST_PROFILES:
        raise ValueError(f"more than {MOST_PROFILES} profiles at once")
    all_ = asked.agg(F.collect_list(F.struct("user_id", "ideal"))).scalar()
    met = vectors.withColumn("__u", F.explode(all_))
    return met.select(*[F.col(c) for c in vectors.columns], F.col("__u.user_id").alias("user_id"), F.round(V.cosine(F.col("__u.ideal"), F.col("sensory")), 9).alias("cos"))


def rank_pool(profiles: DataFrame, products: DataFrame, limit: int, members: int = 16) -> DataFrame:
    """``user_id, id, cos``: what a list of ``limit`` is chosen from: the members of the nearest known vectors
    and the nearest products of all, three lists deep each.

    ``products`` has ``id, name, sensory, known``. Vectors are met once each; of the products that share
    one only as many are looked at as could be taken.
    """
    deep = 3 * limit
    rows = products.where(V.usable(F.col("sensory")))
    vectors = rows.groupBy("sensory").agg(F.min(F.when(F.col("known"), F.col("id"))).alias("first"))
    met = materialise(_against_all(profiles, vectors))
    by_user = lambda *order: F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    near = met.where("first is not null").withColumn("k", by_user(F.desc("cos"), "first")).where(F.col("k") <= deep)
    few = rows.where("known").withColumn("k", F.row_number().over(Window.partitionBy("sensory").orderBy(F.length("name"), "name", "id"))).where(F.col("k") <= members)
    known = near.select("user_id", "cos", "sensory").join(few.select("sensory", "id"), "sensory")
    top = met.withColumn("k", F.dense_rank().over(Window.partitionBy("user_id").orderBy(F.desc("cos")))).where(F.col("k") <= deep)
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("sensory").orderBy("id"))).where(F.col("k") <= deep).select("sensory", "id")
    every = top.select("user_id", "cos", "sensory").join(first, "sensory").withColumn("k", by_user(F.desc("cos"), "id")).where(F.col("k") <= deep)
    return known.select("user_id", "id", "cos").unionByName(every.select("user_id", "id", "cos")).distinct()


def rank_catalog(profiles: DataFrame, products: DataFrame, sightings: DataFrame, judged: DataFrame, limit: int = 10) -> DataFrame:
    """``user_id, rank, id, score, evidence``: the best ``limit`` recommendations of every profile.

    ``products`` has ``id, name, maker, sensory, known, source, confidence``, ``sightings`` has
    ``user_id, id, n`` and ``judged`` ``user_id, id``. Ranked by band, sightings, evidence, score,
    confidence and name. Products of one vector are one recommendation, named by the plainest of them;
    none of them is given if one has been judged.
    """
    attributes = products.select("id", F.coalesce("name", F.lit("")).alias("name"), "maker", "sensory", evidence_tier(F.col("source"), F.col("confidence")).alias("tier"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    pool = rank_pool(profiles, products.withColumn("name", F.coalesce("name", F.lit(""))), limit).join(attributes, "id")
    pool = pool.join(sightings.select("user_id", "id", "n"), ["user_id", "id"], "left").join(judged.select("user_id", "id").distinct().withColumn("judged", F.lit(True)), ["user_id", "id"], "left")
    score = F.round(personal_score(F.col("cos")), 3)
    plain = plain_name(F.col("name"), F.col("maker"))
    key = [band(F.col("score")).alias("band"), (-F.coalesce("n", F.lit(0))).alias("seen"), F.col("tier"), (-F.col("score")).alias("less"), (-F.col("confidence")).alias("unsure")]
    entry = F.struct(*key, legible(F.col("name")).alias("legible"), F.size(F.split(plain, " ")).alias("words"), F.length(plain).alias("length"), F.col("name"), F.col("id"))
    stands = pool.withColumn("score", score).groupBy("user_id", "sensory").agg(F.min(entry).alias("e"), F.max("judged").alias("judged")).where("judged is null")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("e.band", "e.seen", "e.tier", "e.less", "e.unsure", "e.name", "e.id"))
    best = stands.withColumn("rank", rank).where(F.col("rank") <= limit)
    return best.select("user_id", "rank", F.col("e.id").alias("id"), (-F.col("e.less")).alias("score"), F.element_at(F.array(*[F.lit(e) for e in EVIDENCE]), F.col("e.tier") + 1).alias("evidence"))


def rank_shelves(rows: DataFrame, sightings: DataFrame, judged: DataFrame, limit: int = 6) -> DataFrame:
    """``shelf, rank, id, basis, score`` of rows ``shelf, place, id, sensory, cos, rated_in, cross``.

    Rows keep their place, those seen are lifted in front, most seen first; judged ones are left out and
    each vector stands once. A shelf is ranked for someone only if they rated in it, or ask for it; else
    there is no score.
    """
    r = rows.join(judged.select("id").distinct(), "id", "left_anti").join(sightings.select("id", "n"), "id", "left")
    order = [F.desc(F.coalesce("n", F.lit(0))), F.col("place")]
    vector = F.coalesce(F.to_json("sensory"), F.col("id"))
    once = r.withColumn("__v", vector).withColumn("__k", F.row_number().over(Window.partitionBy("shelf", "__v").orderBy(*order))).where("__k = 1")
    best = once.withColumn("rank", F.row_number().over(Window.partitionBy("shelf").orderBy(*order))).where(F.col("rank") <= limit)
    basis = F.when(F.col("rated_in"), "yours").when(F.col("cross"), "cross").otherwise("unrated")
    return best.select("shelf", "rank", "id", basis.alias("basis"), F.when(F.col("rated_in") | F.col("cross"), F.round(personal_score(F.col("cos")), 3)).alias("score"))


def rank_for_users(centroids: DataFrame, items: DataFrame, judged: DataFrame, limit: int) -> DataFrame:
    """``user_id, rank, k, score``: the best items a user has not judged; ties go to the smaller item.

    Every user is a stated query against all items. A checked small item table is broadcast; a larger
    one meets the users block by block, each block keeping its best ``limit`` before they are merged.
    """
    small = items.count() <= BROADCAST_ITEMS
    blocks = 1 if small else BLOCKS
    # Lengths are taken out once per vector, so that a pair costs one dot product.
    size = lambda c: F.greatest(V.norm(F.col(c)), F.lit(1e-300))
    unit = lambda df, c: df.withColumn("__size", size(c)).withColumn(c, F.transform(c, lambda x: x.cast("double") / F.col("__size"))).drop("__size")
    items = unit(items.select("k", F.col(items.columns[1]).alias("v")), "v")
    centroids = materialise(unit(centroids.select("user_id", "centroid"), "centroid"))
    stored = items.select("k", "v", F.pmod(F.xxhash64("k"), F.lit(blocks)).alias("block"))
    asked = centroids.select("user_id", "centroid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    met = asked.join(F.broadcast(stored) if small else stored, "block").select("user_id", "k", F.round(personal_score(V.dot(F.col("centroid"), F.col("v"))), 9).alias("score"))
    fresh = met.join(judged.select("user_id", "k"), ["user_id", "k"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "k"))
    return fresh.withColumn("rank", rank).where(F.col("rank") <= limit).select("user_id", "rank", "k", "score")
