"""Quantities recorded in different units, brought to one unit.

Text is read into the ``(number, unit)`` measures of one size, once per distinct text of an Arrow
batch; each measure meets the conversion table in a broadcast equi-join on ``(source unit, target unit)``. The
table has one row per ordered pair of known units, so its size is bounded by the unit graph and
never grows with the data. No row is shuffled.
"""

from __future__ import annotations

import re
from decimal import Decimal
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegerType, StringType, StructField, StructType

from cellarium.functions.units import VOLUME_EDGES, compositions

# Spellings of units after lower-casing and dropping dots that end a word.
SPELLINGS = {
    "ml": ["ml", "mls", "milliliter", "millilitre", "milliliters", "millilitres"],
    "cl": ["cl", "centiliter", "centilitre", "centiliters", "centilitres"],
    "dl": ["dl", "deciliter", "decilitre", "deciliters", "decilitres"],
    "l": ["l", "ltr", "liter", "litre", "liters", "litres"],
    "hl": ["hl", "hectoliter", "hectolitre", "hectoliters", "hectolitres"],
    "floz": ["floz", "oz", "ounce", "ounces", "fluidounce", "fluidounces"],
    "pt": ["pt", "pts", "pint", "pints"],
    "qt": ["qt", "qts", "quart", "quarts"],
    "gal": ["gal", "gals", "gallon", "gallons"],
    "bbl": ["bbl", "bbls", "barrel", "barrels"],
}
METRIC = {"ml", "cl", "dl", "l", "hl"}
NUMBER_WORDS = {
    **{w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())},
    **{w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)},
    "half": 0.5,
    "quarter": 0.25,
}
#: Plausible millilitres of one container, used only where no unit is stated.
PLAUSIBLE_ML = {
    "bottle": (300, 3100),
    "can": (200, 1100),
    "crowler": (700, 1100),
    "growler": (900, 4000),
    "draft": (18000, 60000),
    "cask": (18000, 60000),
    "keg": (18000, 60000),
}
IMPLIED_ORDER = ["ml", "l", "cl", "us_floz", "us_gal"]

_UNIT = r"(?:millilit(?:er|re)s?|centilit(?:er|re)s?|decilit(?:er|re)s?|hectolit(?:er|re)s?|lit(?:er|re)s?|ltr|mls?|cl|dl|hl|l|fl\s*oz|fluid\s+ounces?|ounces?|oz|pints?|pts?|quarts?|qts?|gallons?|gals?|barrels?|bbls?)"
_NUMBER = r"(?:\d+\s+\d+/\d+|\d+/\d+|\d+(?:\.\d+)?|\.\d+)"
_WORDS = "|".join(sorted(["hundred", "thousand", *NUMBER_WORDS], key=len, reverse=True))
_RUN = rf"\b(?:{_WORDS})(?:(?:\s+and)?[\s-]+(?:{_WORDS}))*\b"
NUMBER_TYPE = DecimalType(16, 8)
SCALE_TYPE = DecimalType(20, 10)
MEASURES = "array<struct<number:decimal(16,8),unit:string>>"


_RUN_RE, _PACK = re.compile(_RUN), re.compile(r"\b\d+\s*[x×]\s*(?=[\d.])|\b\d+\s*(?:bottle|can|keg|carton)s?\s+of\b|\b\d+[\s-]*(?:pack|pk|ct)s?\b")
_LETTER_O, _DOT = re.compile(r"(?<=[\do])o(?![zu])|(?<=\d[.,])o(?![zu])|\bo(?=[.,]\d)"), re.compile(r"\.(?!\d)")
_THOUSANDS, _COMMA = re.compile(r"(?<![\d.,])([1-9]\d{0,2}),(\d{3})(?=\s*m)"), re.compile(r"(\d),(?=\d)")
_AGAIN = re.compile(rf"({_UNIT})\b\s*[;/(-].*$", re.DOTALL)
_MEASURE = re.compile(rf"({_NUMBER})\s*-?\s*(?:us\s+|imp(?:erial)?\s+)?({_UNIT})\b")
_KEY = {spelled: unit for unit, all_ in SPELLINGS.items() for spelled in all_}
#: Units in which one size can be stated together, from the largest down; each at most once.
_DOWN = ["bbl", "gal", "qt", "pt", "floz"]


def spelled_number(run: str) -> str:
    """Digits for a run of number words: ``three hundred fifty-five`` is ``355``."""
    total = now = 0.0
    for word in re.split(r"[\s-]+", run):
        if word == "thousand":
            total, now = total + max(now, 1) * 1000, 0.0
        elif word == "hundred":
            now = max(now, 1) * 100
        elif word != "and":
            now += NUMBER_WORDS[word]
    return f"{total + now:g}"


def read_number(text: str) -> Decimal | None:
    """``7``, ``.75``, ``1/6`` or ``1 1/2`` to eight decimals; None when the column type can't hold it."""
    whole, _, ratio = text.rpartition(" ") if "/" in text else (text, "", "")
    value = Fraction(whole.strip() or 0)
    if ratio:
        up, down = ratio.split("/")
        if int(down) == 0:
            return None
        value += Fraction(int(up), int(down))
    return (Decimal(value.numerator) / Decimal(value.denominator)).quantize(Decimal(1).scaleb(-8)) if value < 10**8 else None


def read_measures(raw: str | None) -> list[tuple[Decimal, str]]:
    """Measures of the first size a text states; several when they add up (``1 pint 6 fl oz``).

    Measures add up as long as each unit is smaller than the one before, down to fluid ounces, so there
    are never more than there are such units.

    Number words and the letter O are read as digits, pack counts are left out, and a second
    statement of the same size (after ``;``, ``/``, ``-`` or in brackets) is not read, as it agrees.
    """
    if not raw or raw.isspace():
        return []
    t = _LETTER_O.sub("0", raw.strip().lower())
    t = _RUN_RE.sub(lambda m: spelled_number(m[0]), t)
    t = _COMMA.sub(r"\1.", _THOUSANDS.sub(r"\1\2", _DOT.sub("", t)))
    t = _PACK.sub(" ", t)
    system = "imp_" if re.search(r"\bimp", t) else "us_"
    found = []
    for number, unit in _MEASURE.findall(_AGAIN.sub(r"\1", t)):
        if (value := read_number(number)) is not None:
            found.append((value, _KEY[re.sub(r"\s+", "", unit)]))
    run = found[:1]
    for value, unit in found[1:]:
        if not (run[-1][1] in _DOWN and unit in _DOWN and _DOWN.index(unit) > _DOWN.index(run[-1][1])):
            break
        run.append((value, unit))
    if len(run) > 1 and run[-1][1] != _DOWN[-1]:
        run = run[:1]
    return [(v, u if u in METRIC else system + u) for v, u in run]


_MOST = len(_DOWN)
_PARTS = StructType([f for i in range(_MOST) for f in (StructField(f"n{i}", NUMBER_TYPE), StructField(f"u{i}", StringType()))])


@F.pandas_udf(_PARTS)
def measures_udf(texts: pd.Series) -> pd.DataFrame:
    """Reads each distinct text of an Arrow batch once; sizes repeat, so most rows are a lookup.

    As built-in expressions the same reading is a chain of rewrites that the optimizer inlines into
    one expression of exponential size, hence the batch function.
    """
    codes, distinct = pd.factorize(texts, use_na_sentinel=False)
    rows = []
    for raw in distinct:
        m = read_measures(raw if isinstance(raw, str) else None)
        rows.append([x for i in range(_MOST) for x in (m[i] if i < len(m) else (None, None))])
    return pd.DataFrame(rows, columns=_PARTS.names, dtype=object).take(codes).reset_index(drop=True)


def measures_in_text(raw: Column) -> Column:
    """The measures a text states, as an array; empty for null, blank and unreadable texts."""
    parts = measures_udf(raw)
    each = F.array(*[F.struct(parts[f"n{i}"].alias("number"), parts[f"u{i}"].alias("unit")) for i in range(_MOST)])
    return F.filter(each, lambda m: m["unit"].isNotNull()).cast(MEASURES)


def measure_in_number(value: Column, container: Column, description: Column) -> Column:
    """One measure from a bare number, whose unit the description or the container tells.

    A unit stated in the description before or after the container word wins; otherwise the first
    unit that makes the number a plausible content of the container; otherwise millilitres.
    """
    unit_word = r"(?:ml|l|litres?|liters?|cl|centilit(?:re|er)s?|fl oz|oz|ounces?|gal|gallons?)"
    stated = F.regexp_extract(F.lower(description), rf"(?:comes in the|sold as a|\bsize)\s+(\d+(?:\.\d+)?)\s*({unit_word})\b", 2)
    names = {s: ("" if u in METRIC else "us_") + u for u, spelled in SPELLINGS.items() for s in spelled}
    lookup = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    ml_per = {u: float(compositions(VOLUME_EDGES)[u, "ml"][0]) for u in IMPLIED_ORDER}
    c = F.lower(F.trim(container))
    low = F.create_map(*[x for k, (a, _) in PLAUSIBLE_ML.items() for x in (F.lit(k), F.lit(float(a)))])
    high = F.create_map(*[x for k, (_, b) in PLAUSIBLE_ML.items() for x in (F.lit(k), F.lit(float(b)))])
    guess = F.coalesce(*[F.when((value * ml_per[u]).between(low[c], high[c]), F.lit(u)) for u in IMPLIED_ORDER], F.lit("ml"))
    number = F.when(F.isnan(value), None).otherwise(value).try_cast(NUMBER_TYPE)
    unit = F.when(stated != "", lookup[F.regexp_replace(stated, r"\s+", "")]).otherwise(guess)
    return F.when(number > 0, F.array(F.struct(number.alias("number"), unit.alias("unit")))).otherwise(F.array()).cast(MEASURES)


def conversion_table(spark: SparkSession, edges=VOLUME_EDGES) -> DataFrame:
    """One row per ordered pair of units: ``src_unit, dst_unit, scale, offset_, hops``."""
    schema = StructType([StructField("src_unit", StringType()), StructField("dst_unit", StringType()), StructField("scale", SCALE_TYPE), StructField("offset_", SCALE_TYPE), StructField("hops", IntegerType())])
    q = Decimal(1).scaleb(-10)
    dec = lambda f: (Decimal(f.numerator) / Decimal(f.denominator)).quantize(q)
    rows = [(a, b, dec(s), dec(o), h) for (a, b), (s, o, h) in sorted(compositions(edges).items())]
    return spark.createDataFrame(rows, schema)


def convert_measures(df: DataFrame, measures: str, target: str, out: str, edges=VOLUME_EDGES, parts: int = _MOST) -> DataFrame:
    """Add ``out``: the measures in ``target``, added up; null if there is none or a unit is unknown.

    Exact decimal arithmetic; a total of zero or less is null. ``df`` keeps all rows and columns. An
    array of more than ``parts`` measures gives null.
    """
    conv = F.broadcast(conversion_table(df.sparkSession, edges).where(F.col("dst_unit") == target).select("src_unit", "scale", "offset_"))
    total, known, m = F.lit(0).cast("decimal(38,18)"), F.size(measures).between(1, parts), F.col(measures)
    names = df.columns
    for i in range(parts):
        side = conv.select(F.col("src_unit").alias(f"__u{i}"), F.col("scale").alias(f"__s{i}"), F.col("offset_").alias(f"__o{i}"))
        df = df.join(side, F.get(m, F.lit(i))["unit"] == F.col(f"__u{i}"), "left")
        part = F.get(m, F.lit(i))["number"] * F.col(f"__s{i}") + F.col(f"__o{i}")
        total = total + F.when(F.size(m) > i, part.cast("decimal(38,18)")).otherwise(F.lit(0).cast("decimal(38,18)"))
        known = known & ((F.size(m) <= i) | part.isNotNull())
    return df.select(*[F.col(f"`{c}`") for c in names if c != out], F.when(known & (total > 0), total).alias(out))


def stated_sizes(filings: DataFrame, demo: DataFrame) -> DataFrame:
    """Sizes of both sources in whole millilitres: ``src, row_id, ml``.

    Rows that state no size (null, blank, words, zero, negative, NaN) are left out. Halves round up.
    Repeated rows give repeated results; texts of any length are read whole.
    """
    a = filings.select(F.lit("ttb_cola_sample").alias("src"), "row_id", measures_in_text(F.col("net_contents")).alias("m"))
    p = F.col("product")
    b = demo.select(F.lit("demo_products").alias("src"), F.col("row_id"), measure_in_number(p["volume_ml"], p["container"], p["description"]).alias("m"))
    sized = convert_measures(a.unionByName(b), "m", "ml", "v")
    return sized.where(F.col("v").isNotNull()).select("src", "row_id", F.round("v", 0).cast("bigint").alias("ml")).where("ml is not null")
