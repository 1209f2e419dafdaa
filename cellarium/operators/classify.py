"""Ordered rules that classify filings, ingredients and styles, and assignment by overlap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The first phrase found in a filing's class decides its category.
CATEGORY_RULES = [
    ("single malt", "spirit"),
    *[(k, "beer") for k in ("ale", "lager", "stout", "porter", "malt beverage", "beer")],
    *[(k, "spirit") for k in ("whisky", "whiskey", "bourbon", "rye")],
    *[(k, "spirit") for k in ("tequila", "mezcal", "agave")],
    *[(k, "spirit") for k in ("brandy", "cognac", "armagnac", "calvados", "pisco", "grappa", "slivovitz")],
    *[(k, "spirit") for k in ("liqueur", "cordial", "schnapps", "amaretto", "triple sec", "curacao", "anisette", "ouzo", "absinthe", "bitters", "arack", "raki", "aquavit")],
    *[(k, "spirit") for k in ("vodka", "gin", "rum", "neutral spirits", "spirits")],
    ("sake", "sake"), ("cider", "cider"), ("mead", "mead"), ("wine", "wine"),
]
FAMILY_RULES = [("sour", "gose|lambic|weisse|bruin"), ("dark", "stout|porter|schwarz|dubbel|doppelbock"), ("hoppy", "india|hazy|pale ale"), ("wheat", "wheat|weizen|witbier"), ("crisp", "lager|pils|helles|kolsch"), ("strong", "quadrupel|tripel|barley"), ("spirit", "bourbon|malt|gin|rum|agave"), ("wine", "wine|riesling|syrah|chardonnay|sparkling")]
KIND_RULES = [("malt", "malt|barley|oats|rye|wheat"), ("hop", "hop"), ("yeast", "yeast|culture"), ("water", "water")]


def category_of(class_type: Column) -> Column:
    low = F.lower(class_type)
    return F.coalesce(*[F.when(low.contains(k), F.lit(c)) for k, c in CATEGORY_RULES], F.lit("other"))


def family_of(style: Column) -> Column:
    low = F.lower(style)
    return F.coalesce(*[F.when(low.rlike(p), F.lit(f)) for f, p in FAMILY_RULES])


def family_sql(column: str) -> str:
    return "case " + " ".join(f"when regexp_matches(lower({column}), '{p}') then '{f}'" for f, p in FAMILY_RULES) + " end"


def ingredient_kind(name: Column) -> Column:
    return F.coalesce(*[F.when(name.rlike(p), F.lit(k)) for k, p in KIND_RULES], F.lit("other"))


#: Texts of one block, and difference of two coordinates that rounding may cause.
BLOCK, CLOSE = 500_000, 1e-9


def overlap_argmax(texts: DataFrame, regions: DataFrame, width: float, height: float) -> DataFrame:
    """``t, k, a``: the region each text overlaps most; ties to the smaller region.

    A text lies in one cell of a grid of the boxes' size, and a region is known in that cell and the
    eight around it, so that every two boxes that overlap meet in one task. Texts of one place are asked
    once and regions of one place are one, the smallest. A task searches from the nearest row of regions
    outwards and in each row from the nearest on either side, until nothing further can overlap more.
    """
    cell = lambda c, size: F.floor(F.col(c) / size)
    around = lambda c, size: F.explode(F.sequence(cell(c, size) - 1, cell(c, size) + 1))
    place = [F.col(c).cast("double").alias(c) for c in ("x", "y")]
    t, r = (df.select(k, *place).where(f"{k} is not null and abs(x) < double('inf') and abs(y) < double('inf')") for df, k in ((texts, "t"), (regions, "k")))
    asked = t.select("x", "y").distinct().withColumn("column", cell("x", width)).withColumn("row", cell("y", height))
    # A full cell is cut into blocks of texts; each of them meets all regions of the cell.
    blocks = asked.groupBy("column", "row").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    asked = asked.join(blocks, ["column", "row"]).select("x", "y", "column", "row", F.pmod(F.xxhash64("x", "y"), "blocks").alias("block"))
    offered = r.groupBy("x", "y").agg(F.min("k").alias("k")).withColumn("column", around("x", width)).withColumn("row", around("y", height))
    offered = offered.join(blocks, ["column", "row"]).select("x", "y", "k", "column", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))

    def search(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = a["x"].to_numpy(), a["y"].to_numpy()
        best, which = most_overlap(x, y, b["x"].to_numpy(), b["y"].to_numpy(), b["k"].to_numpy(), width, height)
        return pd.DataFrame({"x": x, "y": y, "k": which, "a": best})[best > 0]

    keys = ["column", "row", "block"]
    kind = regions.schema["k"].dataType.simpleString()
    found = asked.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInPandas(search, f"x double, y double, k {kind}, a double")
    return t.join(found, ["x", "y"]).select("t", "k", F.round("a", 4).alias("a"))


def most_overlap(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray, k: np.ndarray, width: float, height: float) -> tuple[np.ndarray, np.ndarray]:
    """Greatest overlap of every text with a region, 0 if there is none, and the smallest region that has it."""
    best, which = np.zeros(len(x)), np.zeros(len(x), dtype=k.dtype)
    if not len(x) or not len(k):
        return best, which
    order = np.lexsort((rx, ry))
    rx, ry, k = rx[order], ry[order], k[order]
    rows, first = np.unique(ry, return_index=True)
    last = np.append(first[1:], len(ry))

    def meet(i: np.ndarray, j: np.ndarray) -> None:
        """Texts ``i`` meet the regions ``j``."""
        a = np.maximum(0.0, np.minimum(x[i], rx[j]) + width - np.maximum(x[i], rx[j])) * np.maximum(0.0, np.minimum(y[i], ry[j]) + height - np.maximum(y[i], ry[j]))
        better = (a > best[i]) | (a == best[i]) & (a > 0) & (k[j] < which[i])
        best[i[better]], which[i[better]] = a[better], k[j[better]]

    def scan(i: np.ndarray, row: np.ndarray) -> None:
        """Texts ``i`` meet the nearest regions of their ``row`` on either side, and all as near but for rounding."""
        start = np.empty(len(i), dtype=np.int64)
        by_row = np.argsort(row, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(row[by_row]) != 0, True])
        for lo, hi in zip(at[:-1], at[1:]):
            mine, r = by_row[lo:hi], row[by_row[lo]]
            start[mine] = first[r] + np.searchsorted(rx[first[r] : last[r]], x[i[mine]])
        for step, j in ((-1, start - 1), (1, start)):
            left, nearest = np.arange(len(i)), None
            while len(left):
                inside = (j[left] >= first[row[left]]) & (j[left] < last[row[left]])
                left = left[inside]
                away = np.abs(rx[j[left]] - x[i[left]])
                if nearest is None:
                    nearest = np.full(len(i), np.inf)
                    nearest[left] = away
                left = left[away <= nearest[left] + CLOSE]
                meet(i[left], j[left])
                j[left] += step

    middle = np.searchsorted(rows, y)
    for step, row in ((-1, middle - 1), (1, middle)):
        i = np.arange(len(x))
        while len(i):
            i = i[(row[i] >= 0) & (row[i] < len(rows))]
            most = width * (height - np.abs(rows[row[i]] - y[i]))
            i = i[(most > 0) & (most >= best[i] - CLOSE * width * height)]
            if len(i):
                scan(i, row[i])
            row[i] += step
    return best, which
