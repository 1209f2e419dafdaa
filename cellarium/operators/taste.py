"""Profiles folded from the event log, in arrival order (``event_id``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weight of what was disliked, of one consideration, and the most considerations can add up to.
DISLIKE, LOOK, MOST_LOOKS = 0.4, 0.15, 0.6


def _item():
    return F.get_json_object("props", "$.k").cast("int").alias("k")


def signals(events: DataFrame) -> DataFrame:
    """``user_id, k, w``: the latest verdict per item, 1 for a purchase and -1 for an error."""
    e = events.where(F.col("event_type").isin("purchase", "error"))
    last = e.groupBy("user_id", _item()).agg(F.max_by("event_type", "event_id").alias("last"))
    return last.select("user_id", "k", F.when(F.col("last") == "purchase", 1.0).otherwise(-1.0).alias("w"))


def interest(events: DataFrame) -> DataFrame:
    """``user_id, k, w``: looks at an item, each counted once by event id, capped."""
    e = events.where(F.col("event_type").isin("view", "click"))
    n = e.groupBy("user_id", _item()).agg(F.count_distinct("event_id").alias("n"))
    return n.select("user_id", "k", F.round(F.least(F.col("n") * LOOK, F.lit(MOST_LOOKS)), 6).alias("w"))


def bands(events: DataFrame) -> DataFrame:
    """Band of values and appetite for novelty of users with at least two values."""
    g = events.where("value is not null").groupBy("user_id").agg(F.min("value").alias("a"), F.max("value").alias("b"), F.count_distinct("event_type").alias("kinds"), F.count("*").alias("n")).where("n >= 2")
    return g.select("user_id", (F.col("a") - 0.5).alias("low"), (F.col("b") + 0.5).alias("high"), F.round(F.col("kinds") / F.col("n"), 6).alias("novelty"))


def centroids(signal: DataFrame, items: DataFrame, vector: str) -> DataFrame:
    """``user_id, centroid``: mean of the liked vectors minus a share of the mean of the disliked, each
    axis within 0 and 1.

    Summed axis by axis, so a user with any number of signals is a partial aggregate. Users without
    a liked item have no centroid, nor have those for whom nothing is left.
    """
    x = signal.join(items, "k").select("user_id", "w", F.posexplode(vector).alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    mean = lambda w: F.try_divide(F.sum(F.col("x") * w), F.sum(w))
    like, dislike = F.when(F.col("w") > 0, F.col("w")), F.when(F.col("w") < 0, -F.col("w"))
    m = x.groupBy("user_id", "i").agg(mean(like).alias("p"), mean(dislike).alias("n")).where("p is not null")
    left = F.col("p") - DISLIKE * F.coalesce("n", F.lit(0.0))
    axis = F.struct("i", F.greatest(F.lit(0.0), F.least(F.lit(1.0), left)).alias("x"))
    return m.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(axis)), lambda a: a["x"]).alias("centroid")).where(F.exists("centroid", lambda x: x > 0))
