"""Named queries of the core, with their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellarium.operators.impute import filled_cells
from cellarium.operators.units import stated_sizes
from cellarium.session import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and its SQL under one name."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return stated_sizes(table(spark, d, "ttb_cola_sample"), table(spark, d, "demo_products"))


# Fixed values of the SQL: texts that only stand for "not stated", and how a class without alcohol is written.
_NOTHING = "coalesce(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), '') in ('', 'na', 'none', 'null', 'nil', 'nan', 'unknown', 'unknownproduct', 'unknownstyle', 'unnamed', 'untitled', 'notstated', 'notavailable', 'notapplicable', 'notspecified', 'notgiven', 'notprovided', 'nonegiven', 'nonestated', 'nostyle', 'noname', 'noinfo', 'tbd', 'tba', 'tbc', 'unbekannt', 'inconnu', 'desconocido', 'sinnombre', 'ohnenamen', 'sansnom', 'missing', 'unspecified', 'undefined', 'various', 'seelabel', 'productname', 'namenotset', 'nodescription', 'nodescriptionavailable', 'comingsoon', 'othernone', 'noneother', 'todo', 'test', 'xxx', 'x', 'styleunknown', 'other', 'misc')"


@query(
    "p4_found",
    f"""with w as (select row_id, abv, list_filter(string_split_regex(replace(lower(coalesce(class_type, '')), '0', 'o'), '[^\\p{{L}}]+'), lambda w: length(w) >= 6) ws from ttb_cola_sample),
    f as (select row_id, abv, len(list_filter(ws, lambda w: levenshtein(w[1:9], 'alcoholic') <= 3 or levenshtein(w[1:12], 'nonalcoholic') <= 3)) > 0 free from w)
    select 'ttb_cola_sample' src, row_id, 'abv' field_name from f where abv is null or isnan(abv) or not ((abv > 0 and abv <= 95) or (abv = 0 and free))
    union all select 'demo_products', row_id, 'style' from demo_products where {_NOTHING.format("product.style")}""",
)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    cells = filled_cells(table(spark, d, "ttb_cola_sample"), table(spark, d, "demo_products"))
    # Every cell counts once its donor is settled, also where no row could give one; without this
    # condition the optimizer would drop the search for donors, as its columns are not returned.
    return cells.where("value is not null or method = 'none'").select("src", "row_id", "field_name")


@query("p4_filled")
def p4_filled(spark: SparkSession, d: str) -> DataFrame:
    return filled_cells(table(spark, d, "ttb_cola_sample"), table(spark, d, "demo_products"))
