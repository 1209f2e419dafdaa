"""Profiles of drinkers folded from their events in arrival order, and what they are built from.

Every stage is an aggregate by user, so a user with any number of events is reduced before anything
meets; the order of arrival decides between verdicts, never the clock of the sender.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Neutral rating and span, weight of the disliked, confidence of a profile (base, step,
# most), weight of a quiz answer, signals a band needs, padding of a band.
NEUTRAL, SPAN, DISLIKE, CONFIDENCE, QUIZ, LEAST_SIGNALS, PAD = 3.0, 2.0, 0.4, (0.3, 0.08, 0.9), 0.5, 2, 0.5


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def rating_weight(rating: Column) -> Column:
    """Stars from 1 to 5 as a weight from -1 to 1."""
    return clamp((rating - NEUTRAL) / SPAN, -1.0, 1.0)


def profile_confidence(signals: Column) -> Column:
    base, step, most = CONFIDENCE
    return F.round(F.least(F.lit(most), base + step * signals), 3)


def canonical_events(events: DataFrame, column: str, redirects: DataFrame) -> DataFrame:
    """Events about the product that is left after all merges; ``redirects`` are flattened ``id, target``."""
    r = redirects.where("target is not null").select(F.col("id").alias(column), F.col("target").alias("__to"))
    return events.join(r, column, "left").withColumn(column, F.coalesce("__to", column)).drop("__to")


def product_signals(events: DataFrame) -> DataFrame:
    """``user_id, product, w`` of ``user_id, product, seq, name, weight``.

    The last of ``rating`` and ``withdrawn`` counts; a standing rating wins over what ``list`` adds
    give, which add up to at most 1; nothing is kept of weight 0.
    """
    e = events.where("user_id is not null and product is not null and name in ('rating', 'withdrawn', 'list')")
    said = F.col("name") != "list"
    g = e.groupBy("user_id", "product").agg(
        F.max_by(F.struct("name", "weight"), F.when(said, F.col("seq"))).alias("last"),
        F.max(F.when(said, F.col("seq"))).alias("at"),
        F.sum(F.when(F.col("name") == "list", F.col("weight"))).alias("lists"),
    )
    rated = F.when(F.col("at").isNotNull() & (F.col("last.name") == "rating"), F.col("last.weight"))
    return g.select("user_id", "product", F.coalesce(rated, F.when(F.col("lists").isNotNull(), F.least(F.lit(1.0), "lists"))).alias("w")).where("w <> 0")


def quiz_answers(events: DataFrame) -> DataFrame:
    """``user_id, family, w`` of ``user_id, family, seq, weight``: the last answer of each family, within -1 and 1, none of 0."""
    last = events.where("user_id is not null and family is not null and weight is not null").groupBy("user_id", "family").agg(F.max_by("weight", "seq").alias("w"))
    return last.select("user_id", "family", clamp(F.col("w"), -1.0, 1.0).alias("w")).where("w <> 0")


def considerations(events: DataFrame) -> DataFrame:
    """``user_id, product, n`` of ``user_id, product, seq, event_id``: separate looks; an event sent twice
    counts once, for the product it named first, and one without an id counts by itself."""
    key = F.coalesce(F.when(F.col("event_id") != "", F.col("event_id")), F.concat(F.lit("\u0001"), F.col("seq").cast("string")))
    first = events.where("user_id is not null and product is not null").groupBy("user_id", key.alias("key")).agg(F.min_by("product", "seq").alias("product"))
    return first.groupBy("user_id", "product").agg(F.count("*").alias("n"))


def all_signals(signals: DataFrame, looks: DataFrame, each: float = 0.15, most: float = 0.6) -> DataFrame:
    """Signals, and for other products the interest that looks show."""
    interest = looks.select("user_id", "product", F.least(each * F.col("n"), F.lit(most)).alias("w"))
    return signals.unionByName(interest.join(signals.select("user_id", "product"), ["user_id", "product"], "left_anti"))


def build_profiles(signals: DataFrame, products: DataFrame, quiz: DataFrame, families: DataFrame) -> DataFrame:
    """``user_id, n, confidence, abv_min, abv_max, novelty, ideal`` of every user with a signal or an answer.

    ``products`` has ``product, style, abv, vector``; ``families`` has ``family, style, vector``. Answers
    weigh half. The ideal is the mean of the liked vectors less a share of that of the disliked, each
    axis within 0 and 1 to three decimals; null without a liked vector or if nothing is left.
    """
    known = signals.join(products, "product").select("user_id", "w", "style", "abv", "vector")
    answered = quiz.join(families, "family").select("user_id", (F.col("w") * QUIZ).alias("w"), "style", F.lit(None).cast("double").alias("abv"), "vector")
    both = known.unionByName(answered)
    liked = F.col("w") > 0
    few = lambda c, x: F.when(F.count(c) >= LEAST_SIGNALS, x)
    abv, style = F.when(liked, F.col("abv")), F.when(liked, F.col("style"))
    said = both.groupBy("user_id").agg(
        F.count("vector").alias("n"),
        few(abv, F.round(F.greatest(F.lit(0.0), F.min(abv) - PAD), 1)).alias("abv_min"),
        few(abv, F.round(F.max(abv) + PAD, 1)).alias("abv_max"),
        few(style, F.round(F.count_distinct(style) / F.count(style), 3)).alias("novelty"),
    )
    axes = both.where("vector is not null").select("user_id", "w", F.posexplode("vector").alias("i", "x"))
    mean = lambda w: F.try_divide(F.sum(F.col("x").cast("double") * w), F.sum(w))
    m = axes.groupBy("user_id", "i").agg(mean(F.when(liked, F.col("w"))).alias("p"), mean(F.when(F.col("w") < 0, -F.col("w"))).alias("q")).where("p is not null")
    axis = F.struct("i", F.round(clamp(F.col("p") - DISLIKE * F.coalesce("q", F.lit(0.0)), 0.0, 1.0), 3).alias("x"))
    ideal = m.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(axis)), lambda a: a["x"]).alias("ideal")).where(F.exists("ideal", lambda x: x > 0))
    return said.join(ideal, "user_id", "left").select("user_id", "n", profile_confidence(F.col("n")).alias("confidence"), "abv_min", "abv_max", "novelty", "ideal")


def style_affinities(signals: DataFrame, products: DataFrame) -> DataFrame:
    """``user_id, style, affinity``: mean weight of the products of a style, within -1 and 1."""
    s = signals.join(products.select("product", "style"), "product").where("style is not null")
    return s.groupBy("user_id", "style").agg(F.round(F.round(clamp(F.avg("w"), -1.0, 1.0), 9), 3).alias("affinity"))


def latest_list(rows: DataFrame, key: str, most: int) -> DataFrame:
    """``user_id, key, rank``: the ``most`` entries used last, each once."""
    last = rows.groupBy("user_id", key).agg(F.max("seq").alias("seq"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("seq")))
    return last.withColumn("rank", rank).where(F.col("rank") <= most).select("user_id", key, "rank")
