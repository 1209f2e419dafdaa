from cellarium.plans import curation  # noqa: F401
from cellarium.plans.registry import QUERIES


def test_agreed_values_keep_keys_half_way_between_tenths(spark, tmp_path):
    rows = [("Comet", 5.0, "a"), ("COMET", 5.1, "b"), ("Otter", 8.1, "a"), ("Otter", 8.2, "a"), ("Anvil", 5.0, "a"), ("Anvil", 6.0, "b"), ("Elm", 0.1, "a"), ("Elm", 0.2, "b"), ("Elm", 0.1, "c"), ("Elm", 0.2, "d")]
    spark.createDataFrame(rows, "fanciful_name string, abv double, permit_no string").write.parquet(f"{tmp_path}/ttb_cola_sample.parquet")
    got = {r["key"]: (r["value"], r["sources"]) for r in QUERIES["er_open_data_values"](spark, str(tmp_path)).collect()}
    assert got == {"comet": (5.1, 2), "otter": (8.2, 1), "elm": (0.2, 4)}
