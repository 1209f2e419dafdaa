"""Bronze, silver and gold stages as idempotent DataFrame transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert by key: the last row of each key in the given order; all columns are kept."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def silver_filings(filings: DataFrame) -> DataFrame:
    """The last fetch of each filing with placeholder names erased and its date read."""
    last = latest_rows(filings.where("ttb_id is not null"), ["ttb_id"], ["fetched_at", "row_id"])
    bare = F.regexp_replace(F.lower("fanciful_name"), "[^a-z0-9]+", "")
    clean = F.when(~bare.isin("", "na", "none"), F.col("fanciful_name"))
    return last.withColumns({"id": F.concat("ttb_id", F.lit(":cola:0")), "fanciful_name": clean, "completed": F.try_to_timestamp("completed_date", F.lit("MM/dd/yyyy")).cast("date")})


def promote_demo(demo: DataFrame) -> DataFrame:
    """One product per producer and key, from its last row."""
    d = demo.select(F.col("producer.slug").alias("slug"), F.col("product.key").alias("key"), F.col("product.name").alias("name"), F.col("product.ingredients").alias("ingredients"), "fetched_at", "row_id").where("slug is not null and key is not null")
    return latest_rows(d, ["slug", "key"], ["fetched_at", "row_id"]).withColumn("id", F.concat_ws(":", "slug", "key"))


def recipe_completeness(ingredients: Column, steps: Column) -> Column:
    """Share of malt, hops, yeast and process that a recipe states."""
    has = lambda test: F.coalesce(F.exists(ingredients, test), F.lit(False)).cast("int")
    return (has(lambda i: i["role"].contains("malt")) + has(lambda i: i["role"].contains("hop")) + has(lambda i: i["role"] == "yeast") + F.coalesce((F.size(steps) > 0).cast("int"), F.lit(0))) / 4.0


def quarantine(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy every rule, and the rest with the names of the rules they break."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    judged = rows.withColumn("broken_rules", broken)
    return judged.where(F.size("broken_rules") == 0).drop("broken_rules"), judged.where(F.size("broken_rules") > 0)
