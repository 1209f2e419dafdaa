from pyspark.sql import functions as F

from cellarium.operators import impute


def test_every_missing_cell_is_filled_and_named(spark):
    rows = [(1, "Oak", "Comet", "Ale", 5.0), (2, "OAK", "comet", "Ale", None), (3, "Elm", "Otter", "Ale", float("nan")), (4, "Elm", None, "Rum", 40.0), (5, "Elm", "N/A", "Rum", 999.0), (6, "Ash", "Free", "Non-Alcoholic Malt", 0.0), (7, "Ash", "Full", "Ale", 0.0), (8, None, None, None, None), (8, None, None, None, None), (9, "x" * 9000, "y" * 9000, "Ale", -1.0)]
    f = spark.createDataFrame(rows, "row_id long, brand_name string, fanciful_name string, class_type string, abv double").withColumn("id", F.lit(1)).withColumn("pred", F.lit(1)).withColumn("cell", F.lit(1))
    got = impute.fill_strengths(f)
    by = {r["id"]: r for r in got.collect()}
    assert set(by) == {2, 3, 5, 7, 8, 9} and got.count() == 7
    assert by[2]["method"] == "group" and by[2]["donor_id"] == 1 and by[2]["value"] == "5.0"
    assert by[5]["method"] == "cell" and by[5]["donor_id"] == 4
    assert by[8]["method"] == "overall" and by[8]["donor_id"] in {1, 4, 6}
    assert impute.fill_strengths(f.limit(0)).count() == 0
    assert {r["method"] for r in impute.fill_strengths(f.where("row_id in (2, 3)")).collect()} == {"none"}


def test_styles_come_from_the_same_product_first(spark):
    p = "row_id long, producer struct<slug:string>, product struct<name:string,category:string,style:string,abv:double>"
    rows = [(1, ("a",), ("Comet", "beer", "Porter", 5.0)), (2, ("a",), ("COMET", "beer", "?", None)), (3, ("b",), ("Otter", "beer", None, 5.1)), (4, None, None), (5, ("c",), ("Elm", "wine", "Riesling", 11.0)), (6, ("d",), ("Ash", "wine", "unknown", 12.0))]
    by = {r["id"]: r for r in impute.fill_styles(spark.createDataFrame(rows, p)).collect()}
    assert set(by) == {2, 3, 4, 6}
    assert (by[2]["method"], by[2]["value"]) == ("group", "Porter") and (by[6]["method"], by[6]["value"]) == ("cell", "Riesling")


def test_donors_have_the_nearest_prediction(spark):
    rows = [(i, str(v), float(v), float(v), None, "c") for i, v in enumerate([10, 20, 30, 40])] + [(9, None, None, 29.0, None, "c")]
    df = spark.createDataFrame(rows, "id long, value string, y double, x double, grp string, cell string")
    assert impute.match_means(df).first()["donor_id"] == 2


def test_cells_of_a_large_class_copy_many_donors_and_heed_the_brand(spark):
    rows = [(i, f"House {i % 8}", f"Drink {i}", "Ale", 4.0 + (i % 8) + 0.01 * (i % 3)) for i in range(160)]
    rows += [(1000 + i, None, None, "Ale", None) for i in range(40)] + [(2000 + h, f"House {h}", f"New {h}", "Ale", None) for h in (0, 7)]
    f = spark.createDataFrame(rows, "row_id long, brand_name string, fanciful_name string, class_type string, abv double")
    by = {r["id"]: r for r in impute.fill_strengths(f).collect()}
    assert len({by[1000 + i]["donor_id"] for i in range(40)}) > 3
    assert float(by[2000]["value"]) < 5.5 and float(by[2007]["value"]) > 9.5


def test_donors_inside_a_group_have_the_nearest_prediction(spark):
    rows = [(i, str(v), float(v), float(v), f"g{i}", "c") for i, v in enumerate([10, 20, 30, 40])]
    rows += [(10, "12", 12.0, 12.0, "g", "c"), (11, "38", 38.0, 38.0, "g", "c"), (20, None, None, 37.0, "g", "c"), (21, None, None, 13.0, "g", "c")]
    df = spark.createDataFrame(rows, "id long, value string, y double, x double, grp string, cell string")
    assert {r["id"]: r["donor_id"] for r in impute.match_means(df).collect()} == {20: 11, 21: 10}


def test_more_cells_than_are_broadcast_give_the_same_cells(spark, monkeypatch):
    rows = [(i, f"House {i % 8}", f"Drink {i % 60}", f"Ale {chr(97 + i % 5) * 2}", None if i % 7 == 0 else 4.0 + (i % 30) / 10) for i in range(210)]
    f = spark.createDataFrame(rows, "row_id long, brand_name string, fanciful_name string, class_type string, abv double")
    few = sorted(impute.fill_strengths(f).collect())
    monkeypatch.setattr(impute, "MOST_CELLS", 2)
    assert sorted(impute.fill_strengths(f).collect()) == few
