"""Sources: HTML result pages, damaged CSV exports, JSON lines and gzip batches, source registries."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


@F.pandas_udf(StringType())
def decoded(texts: pd.Series) -> pd.Series:
    """Character references as characters."""
    return texts.map(html.unescape, na_action="ignore")


def table_rows(page: Column) -> Column:
    """Cell texts of every table row of a page: tags dropped, blanks collapsed. Null pages give null."""
    rows = F.regexp_extract_all(page, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1)
    cells = lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), 1)
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "(?s)<[^>]*>", " "), r"\s+", " "))
    return F.transform(rows, lambda r: F.transform(cells(r), plain))


def read_table(pages: DataFrame, page: str, columns: list[str]) -> DataFrame:
    """One row per table row that has all the columns; shorter rows are left out, not guessed at."""
    r = pages.select(F.explode(table_rows(F.col(page))).alias("c")).where(F.size("c") >= len(columns))
    return r.select(*[decoded(F.get("c", F.lit(i))).alias(n) for i, n in enumerate(columns)])


def page_range(page: Column) -> Column:
    """First, last and total of a header such as ``1 to 20 of 345``; null without one."""
    parts = lambda i: F.regexp_extract(page, r"(\d+)\s+to\s+(\d+)\s+of\s+(\d+)", i).try_cast("int")
    return F.when(page.rlike(r"\d+\s+to\s+\d+\s+of\s+\d+"), F.struct(parts(1).alias("first"), parts(2).alias("last"), parts(3).alias("total")))


# Shape of the export.
EXPORT_COLUMNS = ["ttb_id", "permit_no", "serial", "completed_date", "fanciful_name", "brand_name", "origin_code", "origin_desc", "class_type_code", "class_type"]
_STARTS = r"""^\s*["']{0,2}\d{8,20}["']{0,2}\s*(,|$)"""
_DATE = r"^\d{2}/\d{2}/\d{4}$"
#: A record of any number of fields: id, permit, serial up to the first date, names, of which the last is
#: the brand, two fields of origin, the last field of three digits, and the class behind it.
_ANCHORED = r"^([^,]*),([^,]*),(.*?),\s*(\d{2}/\d{2}/\d{4})\s*,(.*),([^,]*),([^,]*),([^,]*),\s*(\d{3})\s*,(.*)$"
_QUOTED_COMMA = "\u0001"


def export_fields(record: Column) -> Column:
    """The fields of one record as text; null if it has too few or its anchors are missing.

    Commas between quotes do not part fields. A record of the right number of fields is taken as it is,
    any other is parted at its date and its class code.
    """
    hidden = F.array_join(F.transform(F.split(record, '"'), lambda t, i: F.when(i % 2 == 1, F.replace(t, F.lit(","), F.lit(_QUOTED_COMMA))).otherwise(t)), "")
    plain, n = F.split(hidden, ","), len(EXPORT_COLUMNS)
    parted = F.array(*[F.regexp_extract(hidden, _ANCHORED, i + 1) for i in range(n)])
    fields = F.when(F.size(plain) == n, plain).when((F.size(plain) > n) & hidden.rlike(_ANCHORED), parted)
    return F.transform(fields, lambda f: F.trim(F.regexp_replace(F.trim(F.replace(f, F.lit(_QUOTED_COMMA), F.lit(","))), "^'+|'+$", "")))


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """All dated records of a folder of exports.

    A record starts at a line whose first field is shaped like an id; the lines up to the next one
    continue it. Lines of one file are numbered in one task, everything else is spread by record.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    lines = lines.where((F.col("pos") > 0) & (F.trim("line") != ""))
    record = F.sum(F.col("line").rlike(_STARTS).cast("int")).over(Window.partitionBy("file").orderBy("pos"))
    whole = lines.withColumn("record", record).where("record > 0").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    f = whole.select(export_fields(F.array_join(F.transform("lines", lambda x: F.trim(x["line"])), " ")).alias("f")).where("f is not null")
    return f.select(*[F.col("f")[i].alias(c) for i, c in enumerate(EXPORT_COLUMNS)]).where((F.col("ttb_id") != "") & F.col("completed_date").rlike(_DATE))


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str, names: list[str] | None = None) -> DataFrame:
    """Event logs, plain or gzipped; torn lines are dropped, and names outside the list are filtered."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows if names is None else rows.where(F.col("name").isin(names))


def read_json_documents(spark: SparkSession, path: str, schema: StructType | str, limit: int | None = None) -> DataFrame:
    """Documents that span lines, one array or object a file; damaged files give no row."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return rows if limit is None else rows.limit(limit)


def scanned_candidates(logs: DataFrame) -> DataFrame:
    """``ts, product_id, score`` of every candidate in scan logs."""
    return logs.select("ts", F.explode("candidates").alias("c")).select("ts", "c.product_id", "c.score")


def check_registry(registry: DataFrame) -> DataFrame:
    """``source_id, problem``: entries with a missing or doubled id, or a tier outside 1 to 5."""
    doubled = registry.groupBy("source_id").count().where("count > 1").select("source_id", F.lit("doubled").alias("problem"))
    wrong = registry.where("trust_tier is null or trust_tier not between 1 and 5").select("source_id", F.lit("tier").alias("problem"))
    return doubled.unionByName(wrong).unionByName(registry.where("source_id is null or trim(source_id) = ''").select("source_id", F.lit("missing").alias("problem")))
