"""Candidates for filings and products: brands that only begin or end alike don't meet, and no pair that counts is lost."""

import random

from pyspark.sql import functions as F

from cellarium.llm import entities


def test_pairs_that_cannot_be_kept_do_not_meet_and_none_that_can_is_lost(spark):
    rng = random.Random(11)
    part = lambda n: "".join(rng.choice("abdegiklmnoprstu") for _ in range(n))
    brands = [f"torwen{part(6)}creek" for _ in range(60)]
    brands += [b[:9] + rng.choice("xyz") + b[10:] for b in brands[:20]] + [b[:12] for b in brands[:10]] + ["torwen", "élanmarda", None]
    words = ["amber", "ferry", "ferri", "owlet", "lazy"]

    def rows(n, node):
        out = [(i, rng.choice(brands), rng.sample(words, rng.choice([0, 1, 2, 2, 2, 3])), rng.choice(["", "", "", "y8", "b3"]), rng.choice([None, None, "412345678903", "412345678904", "412345678905"]), *rng.choice([(None, None), (5.0, 5.0), (5.3, 5.6), (6.0, 6.1), (12.5, 12.5)])) for i in range(n)]
        return spark.createDataFrame(out, f"{node} long, brand string, words array<string>, num string, upc string, abv_low double, abv_high double")

    left, right = rows(150, "l"), rows(150, "r").withColumn("drink", F.concat_ws("|", "brand", F.array_join("words", " "), "num"))
    met = left.select("l", F.explode(entities._keys()).alias("key")).join(right.select("r", F.explode(entities._keys()).alias("key")), "key").select("l", "r").distinct()
    side = lambda df, k, x: df.select(k, *[F.col(c).alias(f"{x}_{c}") for c in df.columns if c != k])
    kept = lambda pairs: sorted(map(str, entities.score_pairs(pairs).where(F.col("prior") > entities.LEAST_PRIOR).collect()))
    want = kept(met.join(side(left, "l", "a"), "l").join(side(right, "r", "b"), "r"))
    found = entities.candidate_pairs(left, right)
    assert kept(found) == want
    assert len(want) <= found.count() < 0.7 * met.count()
