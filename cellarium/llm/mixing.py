"""Mixing sources to target weights without sorting.

Every document has a hash; a source's documents are taken in the order of their hashes up to a
threshold. Tokens are summed by source and hash bucket, the bucket in which the budget runs out is
split by the next bits of the hash, and after three levels the threshold is exact to about one
document in 2^30. Selecting is then a filter on the hash. Budgets of several mixes over one source
give nested selections, as they use the same hash. Histograms have a fixed number of buckets per
source of the target table; only thresholds, one per row of that table, reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarium.session import materialise

#: Bits per level, levels, and bits of the hash.
BITS, LEVELS, HASH_BITS = 10, 3, 60


def order_hash(doc: Column, seed: int = 0) -> Column:
    return F.xxhash64(F.lit(seed), doc).bitwiseAND(F.lit((1 << HASH_BITS) - 1))


def _budgets(sized: DataFrame, targets: DataFrame, total_tokens: int | None) -> DataFrame:
    """Per row of the targets: available tokens, full repeats of everything, and the rest to be cut out.

    Without a given total, the largest one is taken for which every source that has any documents
    reaches its share within its repeats.
    """
    have = sized.groupBy("source").agg(F.sum("tokens").alias("available"))
    t = targets.groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).where("mix_id is not null and source is not null and target_share > 0")
    t = t.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0))).withColumn("most", F.col("available") * F.greatest("max_repeats", F.lit(0)))
    reach = F.min(F.when(F.col("most") > 0, F.col("most") / F.col("target_share"))).over(Window.partitionBy("mix_id"))
    t = t.withColumn("total", F.coalesce(F.lit(total_tokens).cast("double") if total_tokens else reach, F.lit(0.0)))
    t = t.withColumn("budget", F.least(F.col("most").cast("double"), F.col("target_share") * F.col("total")))
    t = t.withColumn("full", F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available") + 1e-9)).otherwise(F.lit(0)).cast("int"))
    return t.withColumn("rest", F.greatest(F.col("budget") - F.col("full") * F.col("available"), F.lit(0.0)))


def thresholds(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """The targets with ``full`` and ``threshold``: documents below it are taken once more than ``full``."""
    spark = sized.sparkSession
    plan = [r.asDict() for r in _budgets(sized, targets, total_tokens).collect()]  # as many rows as the target table
    low = {(r["mix_id"], r["source"]): 0 for r in plan}
    left = {(r["mix_id"], r["source"]): float(r["rest"]) for r in plan}
    for level in range(LEVELS):
        shift = HASH_BITS - BITS * (level + 1)
        open_ = [(m, s, low[m, s]) for m, s in low if left[m, s] > 0]
        if not open_:
            break
        at = F.broadcast(spark.createDataFrame(open_, "mix_id long, source string, low long"))
        inside = sized.join(at, "source").where(F.col("h").between(F.col("low"), F.col("low") + (1 << (shift + BITS)) - 1))
        buckets = inside.groupBy("mix_id", "source", F.shiftright(F.col("h") - F.col("low"), shift).alias("bucket")).agg(F.sum("tokens").alias("tokens"))
        upto = F.sum("tokens").over(Window.partitionBy("mix_id", "source").orderBy("bucket"))
        cut = buckets.withColumn("upto", upto).join(F.broadcast(spark.createDataFrame([(m, s, left[m, s]) for m, s, _ in open_], "mix_id long, source string, rest double")), ["mix_id", "source"])
        past = F.min(F.when(F.col("upto") > F.col("rest"), F.struct("bucket", "upto", "tokens")))
        for r in cut.groupBy("mix_id", "source").agg(past.alias("past")).collect():
            key = (r["mix_id"], r["source"])
            if r["past"] is None:  # all of it fits
                low[key], left[key] = low[key] + (1 << (shift + BITS)), 0.0
            else:
                low[key] += r["past"]["bucket"] << shift
                left[key] -= r["past"]["upto"] - r["past"]["tokens"]
                if level == LEVELS - 1 and left[key] * 2 >= r["past"]["tokens"]:  # the nearer side of the last bucket
                    low[key] += 1 << shift
    rows = [(r["mix_id"], r["source"], float(r["target_share"]), int(r["max_repeats"]), int(r["full"]), low[r["mix_id"], r["source"]]) for r in plan]
    return spark.createDataFrame(rows, "mix_id long, source string, target_share double, max_repeats int, full int, threshold long")


def sized_documents(documents: DataFrame, tokens: Column) -> DataFrame:
    """``doc_id, source, tokens, h`` of documents with an id, a source and at least one token."""
    s = documents.where("doc_id is not null and source is not null and text is not null").select("doc_id", "source", tokens.alias("tokens"))
    return materialise(s.where("tokens > 0").withColumn("h", order_hash(F.col("doc_id"))))


def select_mix(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """``mix_id, doc_id, source, tokens, times``: every selected document and how often it is used.

    ``times`` never exceeds the source's ``max_repeats``. Sources without documents select nothing;
    an empty target table gives an empty result.
    """
    t = F.broadcast(thresholds(sized, targets, total_tokens).select("mix_id", "source", "max_repeats", "full", "threshold"))
    times = F.least(F.col("full") + (F.col("h") < F.col("threshold")).cast("int"), F.col("max_repeats"))
    return sized.join(t, "source").withColumn("times", times).where("times > 0").select("mix_id", "doc_id", "source", "tokens", "times")


def share_report(selected: DataFrame, targets: DataFrame) -> DataFrame:
    """``mix_id, source, target_share, reached_share, tokens, documents, most_times`` for every target."""
    per = selected.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("times")).alias("tokens"), F.count("*").alias("documents"), F.max("times").alias("most_times"))
    t = targets.groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"))
    r = t.join(per, ["mix_id", "source"], "left").fillna(0, ["tokens", "documents", "most_times"])
    total = F.sum("tokens").over(Window.partitionBy("mix_id"))
    return r.select("mix_id", "source", "target_share", F.round(F.coalesce(F.try_divide(F.col("tokens"), total), F.lit(0.0)), 6).alias("reached_share"), "tokens", "documents", "most_times")


def broken_rules(selected: DataFrame, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``mix_id, source, wanted_share, near, repeated``: the share of each source among those that exist,
    whether it was reached within two documents, and documents taken more often than allowed."""
    have = sized.groupBy("source").agg(F.max("tokens").alias("longest"))
    t = targets.where("mix_id is not null and source is not null and target_share > 0").groupBy("mix_id", "source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("most"))
    t = t.join(have, "source", "left").withColumn("there", F.when(F.col("longest").isNotNull() & (F.col("most") > 0), F.col("share")).otherwise(0.0))
    per = selected.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("times")).alias("tokens"), F.max("times").alias("times"))
    r = t.join(per, ["mix_id", "source"], "left").fillna(0, ["tokens", "times"])
    mix = Window.partitionBy("mix_id")
    r = r.withColumn("wanted", F.try_divide(F.col("there"), F.sum("there").over(mix))).withColumn("total", F.sum("tokens").over(mix))
    off = F.abs(F.col("tokens") - F.col("wanted") * F.col("total"))
    near = off <= 2 * F.max(F.coalesce("longest", F.lit(0)) * F.col("most")).over(mix)
    return r.select("mix_id", "source", F.round(F.coalesce("wanted", F.lit(0.0)), 6).alias("wanted_share"), F.coalesce(near, F.lit(True)).alias("near"), F.greatest(F.col("times") - F.col("most"), F.lit(0)).cast("int").alias("repeated"))
