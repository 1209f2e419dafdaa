from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cellarium.functions.units import InconsistentUnits, compositions
from cellarium.operators import units

CASES = {
    "750 ML": 750, "0,75 l": 750, "1,000 ML": 1000, "O.33L": 330, "25OML": 250, "1 PINT 6 OZ": 651, "1 PT .9 FL. OZ. (500 ML)": 500, "24 FL OZ - 710 ML": 710, "1/6 BBL": 19558, "1 1/2 pt": 710, "HALF GALLON": 1893,
    "SEVEN HUNDRED FIFTY MILLILITERS": 750, "twenty-two fl. oz.": 651, "12 x .33 LITER": 330, "12 BOTTLES OF 355 M.L.": 355, "8-pack, 375ML each": 375, "200 ml (24 PACK)": 200, "1 PINT (IMP.)": 568, "20 IMP FL OZ": 568, "18.75 cl": 188, "1 gal 2 qt 1 pt 6 fl oz": 6329, "1 PINT 473 ML": 473,
    "SEE LABEL": None, "": None, " ": None, None: None, "0 ml": None, "12": None, "1/0 gal": None, "9" * 4000: None, "x" * 50000 + " 5 cl": 50,
}


def frames(spark, texts, numbers):
    f = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id long, net_contents string")
    d = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "row_id long, product struct<volume_ml:double,container:string,description:string>")
    return f, d


def test_stated_sizes(spark):
    f, d = frames(spark, list(CASES), [(0.0, "can", None), (None, "can", "x"), (float("nan"), "can", None), (-5.0, "can", None), (12.0, "can", None), (33.0, "can", None), (0.5, "bottle", None), (15.5, "draft", None), (2000.0, "draft", None), (16.0, "Can", "Sold as a 16 centilitre can."), (500.0, None, None), None])
    f = f.withColumn("src", F.lit("clash")).withColumn("m", F.lit(1)).withColumn("scale", F.lit(1)).withColumn("__u0", F.lit(1))
    got = {(r["src"], r["row_id"]): r["ml"] for r in units.stated_sizes(f.unionByName(f), d).collect()}
    want = {("ttb_cola_sample", i): ml for i, ml in enumerate(CASES.values()) if ml}
    want |= {("demo_products", i): ml for i, ml in {4: 355, 5: 330, 6: 500, 7: 58674, 8: 20000, 9: 160, 10: 500}.items()}
    assert got == want
    assert units.stated_sizes(f, d).count() == len(want)
    assert units.stated_sizes(f.limit(0), d.limit(0)).count() == 0


def test_compositions_are_shortest_affine_and_consistent():
    edges = [("c", "f", "9/5", 32), ("k", "c", 1, "-273.15")]
    c = compositions(edges)
    assert c["k", "f"][2] == 2 and c["k", "f"][0] * 300 + c["k", "f"][1] == pytest.approx(80.33)
    with pytest.raises(InconsistentUnits):
        compositions([*edges, ("k", "f", 2, 0)])
    with pytest.raises(InconsistentUnits):
        compositions([("a", "b", 0, 1)])


def test_numbers_are_exact():
    assert units.read_measures("1/3 gal")[0] == (Decimal("0.33333333"), "us_gal")
    assert units.spelled_number("one thousand two hundred and five") == "1205"
