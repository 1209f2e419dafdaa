"""Curation passes: duplicate merges, repointing, fact promotion, enrichment, families and fusion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarium.functions import text as T

# Contribution of an ingredient role to a taste axis, and the axes hops and malts feed.
ROLE_WEIGHT = {"aroma_hop": 0.9, "dry_hop": 0.9, "bittering_hop": 0.4, "base_malt": 0.4, "specialty_malt": 0.6}
ROLE_AXIS = {"aroma_hop": "citrus", "dry_hop": "citrus", "bittering_hop": "bitter", "base_malt": "bready", "specialty_malt": "roasty"}


def duplicate_merges(products: DataFrame) -> DataFrame:
    """``id, canonical`` of products with the same words and digits whose brands do not contradict.

    Products of one brand are duplicates; those without a brand join only if the bucket knows exactly
    one. The smallest id stands for all. Buckets are aggregates and are never gathered.
    """
    words = F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(T.fold(F.col("name")), "[^a-z]+"), lambda w: w != ""))), " ")
    p = products.select("id", words.alias("words"), F.regexp_replace("name", "[^0-9]", "").alias("digits"), F.lower("brand").alias("brand")).where("words <> ''")
    known = p.groupBy("words", "digits").agg(F.min("brand").alias("low"), F.max("brand").alias("high"))
    p = p.join(known, ["words", "digits"]).withColumn("key", F.coalesce("brand", F.when(F.col("low") == F.col("high"), F.col("low")))).where("key is not null")
    best = p.groupBy("words", "digits", "key").agg(F.min("id").alias("canonical"), F.count("*").alias("n")).where("n > 1")
    return p.join(best, ["words", "digits", "key"]).where("id <> canonical").select("id", "canonical")


def repoint(rows: DataFrame, column: str, redirects: DataFrame) -> DataFrame:
    """Rows with ``column`` following flattened redirects; ids without a redirect stay."""
    r = redirects.where("target is not null").select(F.col("id").alias(column), F.col("target").alias("__to"))
    return rows.join(r, column, "left").withColumn(column, F.coalesce("__to", column)).drop("__to")


def hold_reason(accounts: Column, spread: Column, mean: Column) -> Column:
    """Why a claimed value is held back; null if it can be promoted."""
    return F.when(accounts < 2, "one account").when(spread > 0.2, "accounts disagree").when(~mean.between(0.0, 95.0), "implausible")


def agreed_values(claims: DataFrame, tolerance: float) -> DataFrame:
    """``key, value, sources``: keys whose sources agree within the tolerance; the mean, to one decimal, halves up.

    The mean is taken over whole millionths, so a half stays one in whatever order the values are added.
    """
    claims = claims.where("key is not null and value is not null").withColumn("__m", F.round(F.col("value") * 1_000_000).cast("long"))
    g = claims.groupBy("key").agg(F.sum("__m").alias("s"), F.count("*").alias("n"), F.count_distinct("source").alias("sources"), (F.max("value") - F.min("value")).alias("spread"))
    tenths = F.expr("(2 * s + 100000 * n - pmod(2 * s + 100000 * n, 200000 * n)) div (200000 * n)")
    return g.where(F.col("spread") <= tolerance).select("key", (tenths / 10).alias("value"), "sources")


def best_spelling(said: DataFrame, key: str) -> DataFrame:
    """``key, name`` of ``key, name, account``: the spelling most accounts use; then the one with the most
    words of four letters, the longest, the first of the alphabet."""
    long = F.size(F.filter(F.split(F.trim("name"), r"\s+"), lambda w: F.length(w) >= 4))
    n = said.where(f"{key} is not null and name is not null").groupBy(key, "name").agg(F.count_distinct("account").alias("accounts"))
    order = F.struct((-F.col("accounts")).alias("a"), (-long).alias("w"), (-F.length("name")).alias("l"), "name")
    return n.groupBy(key).agg(F.min(order).alias("m")).select(key, F.col("m.name").alias("name"))


def recipe_axes(ingredients: DataFrame) -> DataFrame:
    """``id, axis, x``: what the roles of a recipe's ingredients add to each axis, at most 1."""
    lit_map = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    i = ingredients.select("id", lit_map(ROLE_AXIS)[F.col("role")].alias("axis"), lit_map(ROLE_WEIGHT)[F.col("role")].alias("w")).where("axis is not null")
    return i.groupBy("id", "axis").agg(F.round(F.least(F.sum("w"), F.lit(1.0)), 6).alias("x"))


def interval_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def box_overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two structs ``x, y, w, h``."""
    both = interval_overlap(a["x"], a["x"] + a["w"], b["x"], b["x"] + b["w"]) * interval_overlap(a["y"], a["y"] + a["h"], b["y"], b["y"] + b["h"])
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def one_per_maker(ranked: DataFrame, maker: str, order: list[Column], limit: int) -> DataFrame:
    """The best row of each maker, then the best ``limit`` of all."""
    k = F.row_number().over(Window.partitionBy(maker).orderBy(*order))
    return ranked.withColumn("__k", k).where("__k = 1").drop("__k").orderBy(*order).limit(limit)


def maker_core(name: Column) -> Column:
    """Name of a maker without article and trailing trade words."""
    return F.trim(F.regexp_replace(F.regexp_replace(T.fold(name), "^the ", ""), r"( (brewing|brewery|distillers|distilling|cellars|winery|company|co|inc|llc|ltd)[.,]*)+$", ""))


def taste_sentence(axes: Column, names: list[str]) -> Column:
    """The two strongest axes of a vector in words; null for null vectors."""
    pairs = F.transform(axes, lambda x, i: F.struct((-x).alias("x"), i.alias("i")))
    best = F.array_sort(pairs)
    word = lambda k: F.get(F.array(*[F.lit(n) for n in names]), F.get(best, F.lit(k))["i"])
    return F.when(axes.isNotNull(), F.format_string("Mostly %s, with some %s.", word(0), word(1)))


# Least overlap of two lines as a share of the narrower one, and greatest gap between them
# as a multiple of the taller one and at least.
LEAST_OVERLAP, GAP_HEIGHTS, LEAST_GAP = 0.3, 1.5, 0.04


def stand_together(a: tuple[float, float, float, float], b: tuple[float, float, float, float]) -> bool:
    """Whether two boxes ``x, y, w, h`` overlap enough sideways and stand close enough above each other."""
    narrow = min(a[2], b[2])
    across = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    gap = max(a[1], b[1]) - min(a[1] + a[3], b[1] + b[3])
    return narrow > 0 and across > 0 and across / narrow >= LEAST_OVERLAP and max(gap, 0.0) <= max(GAP_HEIGHTS * max(a[3], b[3]), LEAST_GAP)


def join_boxes(rows: list[tuple[int, float, float, float, float]]) -> list[tuple[int, int]]:
    """``(pos, cluster)`` of the lines ``(pos, x, y, w, h)`` of one frame; a cluster is named by its first line.

    Lines are taken from the top down; one that starts below the reach of all lines so far closes them.
    """
    root = {r[0]: r[0] for r in rows}

    def find(p: int) -> int:
        while root[p] != p:
            root[p] = p = root[root[p]]
        return p

    tallest, near = max((r[4] for r in rows), default=0.0), []
    for r in sorted(rows, key=lambda r: r[2]):
        reach = max(GAP_HEIGHTS * tallest, LEAST_GAP)
        near = [q for q in near if q[2] + q[4] + reach >= r[2]]
        for q in near:
            if stand_together(q[1:], r[1:]):
                a, b = find(q[0]), find(r[0])
                root[max(a, b)] = min(a, b)
        near.append(r)
    return [(r[0], find(r[0])) for r in rows]


def text_clusters(boxes: DataFrame) -> DataFrame:
    """``frame_id, pos, cluster`` of lines that stand together, directly or through others of their frame.

    The lines of a frame arrive together and are joined as they stream by; a task holds one frame.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame, rows = None, []
        for b in batches:
            out = []
            for f, *r in zip(b["frame_id"], b["pos"], b["x"], b["y"], b["w"], b["h"]):
                if f != frame and rows:
                    out += [(frame, *c) for c in join_boxes(rows)]
                    rows = []
                frame = f
                rows.append(tuple(r))
            yield pd.DataFrame(out, columns=["frame_id", "pos", "cluster"])
        yield pd.DataFrame([(frame, *c) for c in join_boxes(rows)] if rows else [], columns=["frame_id", "pos", "cluster"])

    b = boxes.where("frame_id is not null and pos is not null and x is not null and y is not null").select(F.col("frame_id").cast("long"), F.col("pos").cast("long"), *[F.col(c).cast("double") for c in "xywh"])
    return b.repartition("frame_id").sortWithinPartitions("frame_id", "y", "pos").mapInPandas(fold, "frame_id long, pos long, cluster long")
