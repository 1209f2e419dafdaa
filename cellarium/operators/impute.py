"""Filling missing values from similar records by predictive mean matching.

A group-aware predictor gives every row, filled or not, an expected value: the regression of its
cell (class or category) on a covariate, drawn towards the mean of its own group (drink or product)
the more, the more values the group states. A missing value is copied from a donor: from the row's
own group the one whose prediction is nearest, otherwise one of the rows of the same cell whose
predictions are nearest, otherwise one of the nearest rows of all. Donors are real rows and are
named in the result; which of several near ones is taken depends on a hash of the row's id.

What a cell has is joined by broadcast up to :data:`MOST_CELLS` cells and shuffled beyond, so that rows
only travel by their group; and only rows of groups that have both a value and a gap travel to be
compared inside their group.

The range search never sees rows: donors are first reduced to a few per cell and rounded prediction,
so a cell of any size becomes at most as many points as the rounded scale has steps, times a few.
Points are numbered in order of prediction, and the neighbours on either side come by their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarium.functions.stated import says_nothing, stated_abv
from cellarium.functions.text import unaccent
from cellarium.session import materialise

#: Values a group must state to weigh as much as its cell.
SHRINK = 3.0
#: Step to which predictions are rounded before the search.
STEP = 0.01
#: Donors kept per cell and step, donors looked at on either side, and steps that one may lie further off than the nearest.
PER_STEP, POOL, REACH = 5, 5, 10
#: Cells whose figures are broadcast; more of them are joined by a shuffle.
MOST_CELLS = 50_000


def bare(text: Column) -> Column:
    """Letters and digits of a text in lower case without marks."""
    return F.regexp_replace(unaccent(F.lower(text)), r"[^\p{L}\p{N}]+", "")


def _small(cells: DataFrame) -> DataFrame:
    """A table with one row a cell, to be broadcast if it is short."""
    cells = materialise(cells)
    return F.broadcast(cells) if cells.count() <= MOST_CELLS else cells


def predict(rows: DataFrame) -> DataFrame:
    """Add ``pred`` and ``open`` to rows with ``id, value, y, x, grp, cell``.

    ``pred`` is y from the cell's line in x and the group's mean, ``open`` says that the group has rows
    with a value and rows without. Null ``grp`` means no group, null ``cell`` its own cell. Without any
    ``y`` the prediction is null.
    """
    rows = rows.withColumn("cell", F.coalesce("cell", F.lit(""))).withColumn("grp", F.coalesce("grp", F.concat(F.lit("\u0001"), F.col("id").cast("string"))))
    seen = rows.where("y is not null")
    per_cell = seen.groupBy("cell").agg(F.avg("y").alias("cy"), F.regr_slope("y", "x").alias("slope"), F.regr_avgx("y", "x").alias("cx"), F.regr_avgy("y", "x").alias("cyx"), F.regr_r2("y", "x").alias("r2"), F.min("y").alias("low"), F.max("y").alias("high"))
    gap = F.col("value").isNull()
    per_group = rows.groupBy("grp").agg(F.avg("y").alias("gy"), F.count("y").alias("gn"), (F.min(gap) != F.max(gap)).alias("open"))
    overall = seen.agg(F.avg("y").alias("ay")).scalar()
    line = F.when((F.col("r2") > 0) & F.col("x").isNotNull(), F.least(F.greatest(F.col("cyx") + F.col("slope") * (F.col("x") - F.col("cx")), "low"), "high"))
    # The cell's figures end in one number before the rows travel by their group.
    known = rows.join(_small(per_cell), "cell", "left").withColumn("base", F.coalesce(line, "cy", overall)).drop("cy", "slope", "cx", "cyx", "r2", "low", "high")
    n = F.coalesce("gn", F.lit(0))
    pred = (n * F.coalesce("gy", F.lit(0.0)) + SHRINK * F.col("base")) / (n + SHRINK)
    return known.join(per_group, "grp", "left").withColumn("pred", pred).drop("base", "gy", "gn")


def _nearest(points: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """For every asked ``(*by, step)`` the donors ``near``: of the ``POOL`` points on either side those
    that lie at most ``REACH`` steps further off than the nearest, nearest first."""
    both = asked.select(*by, "step", F.lit(None).cast(points.schema["donor"].dataType).alias("donor")).unionByName(points.select(*by, "step", "donor"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    # A step's asked row follows its donors, so its count of donors so far is the number of the last one at or below it.
    both = both.withColumn("k", F.count("donor").over(w.orderBy("step", F.col("donor").isNull(), "donor").rowsBetween(Window.unboundedPreceding, 0)))
    numbered = both.where("donor is not null").select(*by, "k", F.col("step").alias("at"), "donor")
    sought = both.where("donor is null").select(*by, "step", F.explode(F.sequence(F.col("k") - POOL + 1, F.col("k") + POOL)).alias("k"))
    met = sought.join(numbered, [*by, "k"]).withColumn("off", F.abs(F.col("at") - F.col("step")))
    found = met.groupBy(*by, "step").agg(F.array_sort(F.collect_list(F.struct("off", "donor"))).alias("all"))
    inside = F.filter("all", lambda x: x["off"] <= F.col("all")[0]["off"] + REACH)
    return found.select(*by, "step", F.transform(inside, lambda x: x["donor"]).alias("near"))


def _own(donors: DataFrame, asked: DataFrame) -> DataFrame:
    """For every asked ``(grp, step)`` the donor ``g`` of the group whose step is nearest."""
    points = donors.groupBy("grp", "step", "value").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    points = points.withColumn("n", F.sum("n").over(Window.partitionBy("grp", "value"))).withColumnRenamed("step", "at")
    best = F.min(F.struct(F.abs(F.col("at") - F.col("step")).alias("off"), (-F.col("n")).alias("n"), F.col("id"), F.col("value")))
    return asked.join(points, "grp").groupBy("grp", "step").agg(best.alias("g")).select("grp", "step", F.struct("g.id", "g.value").alias("g"))


def match_means(rows: DataFrame) -> DataFrame:
    """``id, value, donor_id, method, pred`` for every row of ``rows`` whose ``value`` is null.

    ``rows`` has ``id, value string, y double, x double, grp string, cell string``; ``y`` is a number
    that stands for the value (itself, or a score of a category). ``method`` is ``group``, ``cell``,
    ``overall``, or ``none`` where no row states a value. Equal candidates of a group: the value stated
    most often, then the smallest id; near ones of a cell: by a hash of the row's id. A repeated row is
    filled as often as it appears.
    """
    p = predict(materialise(rows.select("id", "value", "y", "x", "grp", "cell")))
    p = materialise(p.select("id", "value", F.when(F.col("open"), F.col("grp")).alias("grp"), "cell", "pred", F.round(F.col("pred") / STEP).cast("long").alias("step")))
    missing, donors = p.where("value is null"), p.where("value is not null")
    left = missing.join(_own(donors.where("grp is not null"), missing.where("grp is not null").select("grp", "step").distinct()), ["grp", "step"], "left")
    asked = left.where("g is null").select("cell", "step").distinct()
    salt = F.pmod(F.xxhash64("id"), F.lit(PER_STEP))
    points = donors.groupBy("cell", "step", salt.alias("salt")).agg(F.min(F.struct(F.xxhash64("id").alias("h"), F.col("id"), F.col("value"))).alias("donor"))
    in_cell = _nearest(points, asked, ["cell"])
    # All cells together have no more points than the rounded scale has steps, times a few: one small window.
    every = _nearest(points.groupBy("step", "salt").agg(F.min("donor").alias("donor")), asked.select("step").distinct(), []).withColumnRenamed("near", "near_all")
    out = left.join(in_cell, ["cell", "step"], "left").join(every, "step", "left")
    one = lambda c: F.get(c, F.pmod(F.xxhash64("id", F.lit(1)), F.size(c)))
    out = out.withColumn("near", one(F.col("near"))).withColumn("near_all", one(F.col("near_all")))
    cell_pick, all_pick = F.when(F.col("near").isNotNull(), F.struct("near.id", "near.value")), F.when(F.col("near_all").isNotNull(), F.struct("near_all.id", "near_all.value"))
    pick = F.coalesce("g", cell_pick, all_pick)
    method = F.when(F.col("g").isNotNull(), "group").when(cell_pick.isNotNull(), "cell").when(all_pick.isNotNull(), "overall").otherwise("none")
    return out.select("id", pick["value"].alias("value"), pick["id"].alias("donor_id"), method.alias("method"), F.round("pred", 6).alias("pred"))


def _maker_lean(rows: DataFrame) -> DataFrame:
    """Add ``x`` to rows with ``y, grp, cell, maker``: how far the maker's other drinks lie from their class means on average.

    The row's own drink is left out, so filled and missing rows of a drink have the same ``x``; a row
    without a group is its own drink. Null without other drinks.
    """
    # Sums only feed a covariate, so their keys are hashes: short rows, and two keys that clash do no harm.
    rows = rows.withColumn("drink", F.xxhash64(F.coalesce("grp", F.concat(F.lit("\u0001"), F.col("id").cast("string")))))
    y = F.when(F.col("cell").isNotNull(), F.col("y"))
    lean = materialise(rows.where("maker is not null").groupBy("maker", "drink", F.xxhash64("cell").alias("cell")).agg(F.sum(y).alias("s"), F.count(y).alias("n")))
    mean = _small(lean.where("n > 0").groupBy("cell").agg((F.sum("s") / F.sum("n")).alias("cy")))
    off = lean.join(mean, "cell", "left").select("maker", "drink", (F.col("s") - F.col("n") * F.col("cy")).alias("s"), "n")
    # Drinks and makers are summed up after one shuffle, by maker, of one short row a drink and cell.
    per_drink = off.repartition("maker").groupBy("maker", "drink").agg(F.sum("s").alias("gs"), F.sum("n").alias("gn"))
    w = Window.partitionBy("maker")
    others = F.sum("gn").over(w) - F.col("gn")
    x = F.when(others > 0, (F.sum("gs").over(w) - F.coalesce("gs", F.lit(0.0))) / others)
    return rows.join(per_drink.select("maker", "drink", x.alias("x")), ["maker", "drink"], "left").drop("drink", "maker")


def fill_strengths(filings: DataFrame) -> DataFrame:
    """Missing ``abv`` of filings: from filings of the same drink, else from the same class.

    The covariate is how strong the brand's other drinks are for their classes.
    """
    named = ~says_nothing(F.col("fanciful_name")) & ~says_nothing(F.col("brand_name"))
    v = stated_abv(F.col("abv"), F.col("class_type"))
    words = F.array_join(F.array_sort(F.filter(F.split(unaccent(F.lower("class_type")), r"[^\p{L}]+"), lambda w: F.length(w) > 1)), " ")
    rows = filings.select(
        F.col("row_id").alias("id"),
        v.alias("y"),
        F.when(named, F.concat_ws("|", bare(F.col("brand_name")), bare(F.col("fanciful_name")))).alias("grp"),
        words.alias("cell"),
        F.when(~says_nothing(F.col("brand_name")), F.xxhash64(bare(F.col("brand_name")))).alias("maker"),
    )
    return match_means(_maker_lean(rows).withColumn("value", F.col("y").cast("string")))


def fill_styles(demo: DataFrame) -> DataFrame:
    """Missing style of demo products: from packages of the same product, else from the same category.

    The score of a style is the mean strength of the products that state it.
    """
    p = F.col("product")
    style = F.when(~says_nothing(p["style"]), F.trim(p["style"]))
    abv = stated_abv(p["abv"], p["style"], p["name"])
    named = F.col("producer.slug").isNotNull() & ~says_nothing(p["name"])
    rows = demo.select(F.col("row_id").alias("id"), style.alias("value"), abv.alias("x"), F.when(named, F.concat_ws("|", F.col("producer.slug"), bare(p["name"]))).alias("grp"), p["category"].alias("cell"))
    score = rows.where("value is not null").groupBy(bare(F.col("value")).alias("k")).agg(F.avg("x").alias("s"))
    usual = rows.agg(F.coalesce(F.avg("x"), F.lit(0.0))).scalar()
    scored = rows.withColumn("k", bare(F.col("value"))).join(score, "k", "left").withColumn("usual", usual)
    return match_means(scored.select("id", "value", F.when(F.col("value").isNotNull(), F.coalesce("s", "usual")).alias("y"), "x", "grp", "cell"))


def filled_cells(filings: DataFrame, demo: DataFrame) -> DataFrame:
    """``src, row_id, field_name, value, donor_row_id, method, pred`` of every cell that had to be filled."""
    out = lambda df, src, field: df.select(F.lit(src).alias("src"), F.col("id").alias("row_id"), F.lit(field).alias("field_name"), "value", F.col("donor_id").alias("donor_row_id"), "method", "pred")
    return out(fill_strengths(filings), "ttb_cola_sample", "abv").unionByName(out(fill_styles(demo), "demo_products", "style"))
