"""Promotion, makers, typed names, profiles and ranked lists on small fixtures: nulls, ties, repeats, empty tables."""

import difflib
import re

import pytest
from pyspark.sql import functions as F

from cellarium.operators import filters, identity, makers, profiles, promote, ranking
from cellarium.sources import pages, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_names_are_made_readable(spark):
    lit = lambda t: F.lit(t).cast("string")
    for raw, want in {"STRANAHAN'S O'BRIEN IPA": "Stranahan's O'Brien IPA", "goodBeer": "goodBeer", "OLD  N/A": "Old N/A", "": "", None: None}.items():
        assert one(spark, promote.title_case(lit(raw))) == want
    for raw, want in {"- NONE -": "", "--": "", None: "", "Salvation For None": "Salvation For None", "N/A": "N/A"}.items():
        assert one(spark, promote.fanciful_name(lit(raw))) == want
    for name, brand, want in [("15", "Glenfiddich", "Glenfiddich 15"), ("Gin", "Hendrick's", "Hendrick's Gin"), ("fen", None, None), ("1664", None, "1664"), ("Виски", "Jameson", "Jameson"), (None, None, None), ("J&B", None, "J&B"), ("Bière", "Duvel", "Duvel")]:
        assert one(spark, promote.open_name(lit(name), lit(brand))) == want
    assert one(spark, promote.branded_name(lit("Oak"), lit("Oak Ale"))) == "Oak Ale" and one(spark, promote.branded_name(lit("Oak"), lit("none"))) == "Oak"
    assert one(spark, promote.split_ingredients(lit("Water; Barley Malt,, hops")))[1]["role"] == "base_malt" and one(spark, promote.split_ingredients(lit(None))) == []


def test_open_rows_that_are_no_drinks_are_dropped(spark):
    rows = [("1", "100", "Oak Ale", "Oak, Elm", "water, hops", "5.0", "Beers, Ales"), ("2", "101", "Drinking yogurt", "Dairy", None, None, "Beverages"), ("3", "102", "Loading…", "Oak", None, "x", "Gins"), ("4", None, "Gin", "Elm", None, "nan", "Gins"), ("5", "104", "Rose", "Elm", None, None, "flowers"), ("6", "105", None, None, None, None, None)]
    b = spark.createDataFrame(rows, "id string, code string, product_name string, brands string, ingredients_text string, alcohol_value string, categories string").withColumn("name", F.lit("clash"))
    silver = promote.normalize_open(b)
    assert {(r["bronze_id"], r["name"], r["category"]) for r in silver.collect()} == {("1", "Oak Ale", "beer"), ("4", "Elm Gin", "spirit")}
    gold = promote.promote_open(silver.unionByName(silver), "off")
    assert {k: v.count() for k, v in gold.items()} == {"producer": 2, "brand": 2, "product": 1, "sku": 1}
    assert promote.normalize_open(b.limit(0)).count() == 0


def test_a_pipeline_run_twice_gives_the_same(spark, tmp_path):
    rows = [("t1", "OAK HOUSE", "RUSTY COMET", "Ale", "BR-1", None, "OHIO", 5.0, "123", 1, 1), ("t1", "OAK HOUSE", "NONE", "Ale", "BR 1", None, None, 5.0, "123", 2, 2), ("t2", None, "X", None, None, None, None, None, None, 1, 3), (None, "Y", "Z", None, None, None, None, None, None, 1, 4)]
    f = spark.createDataFrame(rows, "ttb_id string, brand_name string, fanciful_name string, class_type string, permit_no string, permittee string, origin_desc string, abv double, upc string, fetched_at int, row_id int")
    run = lambda source: promote.run_pipeline(spark, source, str(tmp_path), promote.normalize_filings, lambda s: promote.promote_filings(s, "cola"))
    first = {k: sorted(map(tuple, v.collect())) for k, v in run(f).items()}
    assert first == {k: sorted(map(tuple, v.collect())) for k, v in run(None).items()}
    assert [r[0] for r in first["product"]] == ["ttb:t1"] and first["product"][0][4] == "Oak House" and first["producer"][0][0] == "prod:cola:permit:br-1"


def test_claims_are_taken_once_and_capped(spark):
    c = spark.createDataFrame([("a", f"c{i}", i) for i in range(5)] + [("a", "c0", 9), (None, "x", 1), ("b", None, 1)], "account_id string, client_id string, received_at int")
    got = {r["doc_id"]: r["duplicate"] for r in promote.take_claims(c, spark.createDataFrame([("a::c1",)], "doc_id string"), 3).collect()}
    assert got == {"a::c0": False, "a::c1": True, "a::c2": False}


def test_makers_merge_by_core_and_trade(spark):
    rows = [("1", "The Oak Brewing Comapny, LLC", "Ohio"), ("2", "Oak", "Iowa"), ("3", "Oak Brewery", "Ohio"), ("4", "Elm Distillers", None), ("5", "Elm Brewing", None), ("6", "Elm", None), ("7", "Company", None), ("8", "the", None), ("9", None, None), (None, "Oak", None), ("10", "麦酒", None)]
    m = spark.createDataFrame(rows, "id string, name string, region string")
    cores = makers.maker_cores(m)
    assert {r["id"]: (r["core"], r["trade"]) for r in cores.collect()} == {"1": ("oak", "brew"), "2": ("oak", ""), "3": ("oak", "brew"), "4": ("elm", "dist"), "5": ("elm", "brew"), "6": ("elm", ""), "7": ("company", ""), "8": ("the", "")}
    merges = makers.maker_merges(cores)
    assert {(r["alias"], r["canonical"]) for r in merges.collect()} == {("1", "2"), ("3", "2")}
    left = {r["id"]: (r["region"], r["members"]) for r in makers.merge_makers(m.where("id is not null"), merges).collect()}
    assert left["2"] == ("Ohio", 3) and "1" not in left
    assert makers.maker_merges(makers.maker_cores(m.limit(0))).count() == 0


def test_typed_names_find_what_reading_every_pair_finds(spark):
    known = [("a:1", "Lagavulin 16 Year Old", "Lagavulin"), ("a:2", "Hazy Little Thing", "Sierra Nevada"), ("a:3", "Juicy Little Thing Hazy IPA", "Sierra Nevada"), ("a:4", "Crusher", "Alchemist"), ("a:5", "Bone Crusher Stout", "Other"), ("a:6", "Pale Ale", None), ("a:7", None, "X"), (None, "Crusher", "Alchemist")]
    typed = [(1, "Lagavulin 16 ans", None), (2, "Hazy Littel Thing", "sierra nevda"), (3, "Crushr", "Alchemist"), (4, "Crusher", None), (5, "Pale Ale", "Oak"), (6, "Lagavulin 8", None), (7, None, None), (8, "", None), (8, "", None), (9, "Lagavulin", "Lagavulin"), (9, "Lagavulin", "Lagavulin")]
    p, t = spark.createDataFrame(known, "id string, name string, brand string"), spark.createDataFrame(typed, "q int, name string, maker string")
    got = {tuple(r) for r in makers.match_typed_names(t.withColumn("id", F.lit(1)), p.withColumn("q", F.lit(1))).collect()}
    want = {(q, i) for q, n, m in typed if n for i, k, b in known if i and k and makers.typed_as(n, m, k, b)}
    assert got == want and {(1, "a:1"), (2, "a:2"), (3, "a:4"), (9, "a:1")} <= got and not {(6, "a:1"), (5, "a:6"), (2, "a:3")} & got
    assert makers.match_typed_names(t.limit(0), p).count() == 0 and makers.match_typed_names(t, p.limit(0)).count() == 0
    assert makers.same_word("crusher", "crushr") and not makers.same_word("crusher", "funcrusher") and not makers.same_word("bock", "back") and difflib and re


def test_the_last_verdict_counts_and_lists_are_capped(spark):
    rows = [(1, "p", 1, "rating", 1.0), (1, "p", 2, "withdrawn", None), (1, "q", 1, "withdrawn", None), (1, "q", 2, "rating", -0.5), (1, "r", 1, "list", 0.6), (1, "r", 2, "list", 0.6), (1, "s", 1, "list", 0.3), (1, "s", 2, "rating", 0.0), (1, "t", 1, "withdrawn", None), (1, "u", 1, "list", 0.3), (1, "u", 2, "rating", 1.0), (1, "u", 3, "withdrawn", None), (None, "p", 1, "rating", 1.0), (1, None, 1, "rating", 1.0)]
    e = spark.createDataFrame(rows, "user_id int, product string, seq int, name string, weight double")
    assert {(r["product"], r["w"]) for r in profiles.product_signals(e).collect()} == {("q", -0.5), ("r", 1.0), ("u", 0.3)}
    assert profiles.product_signals(e.limit(0)).count() == 0
    looks = spark.createDataFrame([(1, "p", 1, "e"), (1, "q", 2, "e"), (1, "q", 3, None), (1, "q", 4, ""), (None, "q", 5, "f")], "user_id int, product string, seq int, event_id string")
    assert {(r["product"], r["n"]) for r in profiles.considerations(looks).collect()} == {("p", 1), ("q", 2)}
    assert [one(spark, profiles.rating_weight(F.lit(x))) for x in (1.0, 3.0, 9.0)] == [-1.0, 0.0, 1.0] and one(spark, profiles.profile_confidence(F.lit(20))) == 0.9


def test_products_of_one_vector_are_one_recommendation(spark):
    a, b, c = [1.0, 0.0], [0.9, 0.1], [0.0, 1.0]
    rows = [("1", "Oak Brewing Company Truth India Pale Ale", "Oak Brewing Company", a, True, "reconciled", 0.9), ("2", "Truth", "Oak Brewing Company", a, True, "reconciled", 0.9), ("3", "Gin", None, b, True, "llm_profile", 0.2), ("4", "Elm", None, b, True, "llm_profile", 0.2), ("5", "Judged", None, c, True, "reconciled", 0.9), ("6", "Sibling", None, c, True, "reconciled", 0.9), ("7", None, None, None, False, None, None), ("8", "Zero", None, [0.0, 0.0], False, None, None)]
    p = spark.createDataFrame(rows, "id string, name string, maker string, sensory array<double>, known boolean, source string, confidence double").withColumn("rank", F.lit(1))
    users = spark.createDataFrame([("u", [1.0, 0.05])], "user_id string, ideal array<double>")
    seen = spark.createDataFrame([("u", "4", 2)], "user_id string, id string, n int")
    judged = spark.createDataFrame([("u", "5")], "user_id string, id string")
    got = ranking.rank_catalog(users, p, seen, judged, 5).orderBy("rank").collect()
    assert [(r["id"], r["evidence"]) for r in got] == [("4", "guessed"), ("2", "rated")]
    assert ranking.rank_catalog(users.limit(0), p, seen, judged, 5).count() == 0 and ranking.rank_catalog(users, p.limit(0), seen, judged, 5).count() == 0
    assert [one(spark, ranking.legible(F.lit(n))) for n in ("Tequila blanco", "4b ,plantation", "Truth")] == [2, 1, 0]
    assert one(spark, ranking.plain_name(F.lit("Oak Brewing Truth"), F.lit("Oak Brewing"))) == "Truth" and one(spark, ranking.plain_name(F.lit("Oak"), F.lit("Oak"))) == "Oak"


def test_filters(spark):
    strong = lambda a, c, n: one(spark, filters.plausible_strength(F.lit(a).cast("double"), F.lit(c).cast("string"), F.lit(n).cast("string")))
    assert strong(5.0, "beer", None) and not strong(0.3, "beer", "x") and strong(0.3, "beer", "Wit 0.0%") and not strong(5.0, "beer", "alcohol free") and strong(50.0, "odd", None) and strong(50.0, None, None) and not strong(float("nan"), "beer", None)
    assert one(spark, filters.stated_strengths(F.lit("Pale 6.6% and 5,0 degre, 100% malt, 4X33CL"))) == [6.6, 5.0]
    assert [one(spark, filters.importer_permit(F.lit(p))) for p in ("phi-i-4477", "i-1214", "br-co-1")] == [True, True, False]
    assert one(spark, filters.replaceable_by_databases(F.lit("5"), F.lit("open_database"))) == "open_database" and one(spark, filters.replaceable_by_drinkers(F.lit("5"), F.lit("label_ocr"))) is None
    assert one(spark, identity.shown_name(F.lit("Oak Rusty"), F.lit("oak"))) == "Rusty" and one(spark, identity.shown_name(F.lit("Oakland"), F.lit("Oak"))) == "Oakland"


def test_documents_indexes_and_evidence(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.json").write_text('[{"k": "1",\n "n": {"v": 2}},\n {"k": "2"}]')
    assert pages.read_json_documents(spark, str(tmp_path / "docs"), "k string, n struct<v:int>").count() == 2
    assert pages.read_json_documents(spark, str(tmp_path / "docs"), "k string", 1).count() == 1
    rows = spark.createDataFrame([("oak", 1)], "token string, id int").withColumn("at", F.lit("2025-01-01").cast("timestamp"))
    stamp = sinks.content_stamp(rows, "at")
    sinks.write_index(rows.drop("at"), str(tmp_path / "ix"), stamp)
    assert sinks.load_index(spark, str(tmp_path / "ix"), stamp).count() == 1 and sinks.content_stamp(rows.limit(0), "at") == "0-never"
    with pytest.raises(Exception):
        sinks.load_index(spark, str(tmp_path / "ix"), "other").count()
    sinks.append_evidence(rows, str(tmp_path / "ev"))
    sinks.append_evidence(rows, str(tmp_path / "ev"))
    assert spark.read.json(str(tmp_path / "ev")).count() == 2
