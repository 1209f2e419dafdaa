import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellarium.functions import text as T
from cellarium.functions import vectors as V
from cellarium.functions.stated import is_non_alcoholic, says_nothing, stated_abv, stated_ibu
from cellarium.operators import frames, identity, medallion, retrieval
from cellarium.sources import pages, sinks
from cellarium.streaming import events, tracker


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_text_functions(spark):
    s = F.lit
    assert one(spark, T.fold(s("Crème d’Été'S"))) == "creme detes"
    assert one(spark, T.word_tokens(s("A Bee, bee & Cee"))) == ["bee", "cee"]
    assert one(spark, T.trigrams(s("ab"))) == ["  a", " ab", "ab "]
    assert one(spark, T.jaccard(T.trigrams(s("ab")), T.trigrams(s("ab")))) == 1.0
    assert one(spark, T.within_one_edit(s("porter"), s("proter"))) and one(spark, T.within_one_edit(s("ale"), s("ales"))) and not one(spark, T.within_one_edit(s("ale"), s("lea")))
    assert one(spark, T.slug(s("--Old & Odd Co.--"))) == "old-odd-co"
    assert one(spark, T.title_case(s("OLD OAK"))) == "Old Oak" and one(spark, T.title_case(s("Old OAK"))) == "Old OAK"
    assert one(spark, T.upc_variants(s("0-12345 678905 1"))) == ["0123456789051", "123456789051"]
    assert one(spark, T.latin_look_alikes(s("РАВ"))) == "PAB"
    assert one(spark, F.round(T.bigram_dice(s("night"), s("nacht")), 3)) == 0.25
    assert one(spark, T.without_nul(s("a\u0000b"))) == "ab"
    assert one(spark, T.fold(F.lit(None).cast("string"))) is None


def test_vectors(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, V.cosine(a, a)) == pytest.approx(1) and one(spark, V.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0
    assert one(spark, V.weighted_mean(F.array(a, F.array(F.lit(1.0), F.lit(0.0))), F.array(F.lit(1.0), F.lit(3.0)), 2)) == [1.5, 1.0]
    assert one(spark, V.dense(F.create_map(F.lit("b"), F.lit(2.0)), ["a", "b"])) == [0.0, 2.0]


def test_placeholders_and_plausible_numbers(spark):
    for t in ("", " ", "N/A", "???", "None given", "TBD", None):
        assert one(spark, says_nothing(F.lit(t).cast("string")))
    assert not one(spark, says_nothing(F.lit("Ale")))
    for t in ("nNO-aLCOHOLIC-mALT", "noalcoholic malt", "N0n-Alcohhoilc", "Non-AlcohlicMatBeverage"):
        assert one(spark, is_non_alcoholic(F.lit(t)))
    for t in ("Ale", "American Stout", "Artisanal Mezcal", None):
        assert not one(spark, is_non_alcoholic(F.lit(t).cast("string")))
    abv = lambda x, c: one(spark, stated_abv(F.lit(x).cast("double"), F.lit(c).cast("string")))
    assert abv(5.0, None) == 5.0 and abv(0.0, "Ale") is None and abv(0.0, "Non-Alcoholic") == 0.0 and abv(99.9, "Rum") is None and abv(float("nan"), "Rum") is None
    assert one(spark, stated_ibu(F.lit(999.0))) is None


def test_redirects_end_and_cycles_do_not(spark):
    chain = [(f"r{i}", f"r{i + 1}") for i in range(7)] + [("a", "b"), ("b", "a"), ("self", "self"), ("x", "gold")] + [(f"long{i}", f"long{i + 1}") for i in range(12)] + [(None, "x"), ("y", None)]
    got = {r["id"]: r["target"] for r in identity.flatten_redirects(spark.createDataFrame(chain, "id string, target string")).collect()}
    assert got["r0"] == "r7" and got["r6"] == "r7" and got["x"] == "gold"
    assert got["a"] is None and got["self"] is None and got["long0"] is None and got["long11"] == "long12"


def test_merges(spark):
    n = spark.createDataFrame([("1", "Oak Ale"), ("2", "ale OAK"), ("3", "Oak Ale 12"), ("4", "Oak"), ("5", "Oak Ale Reserve"), ("6", "Elm Ale Reserve")], "id string, name string")
    assert [tuple(r) for r in identity.exact_buckets(n).collect()] == [("ale oak", 2, "1")]
    got = {r["alias"]: r["canonical"] for r in identity.containment_merges(n).collect()}
    assert got == {"1": "5"}
    m = spark.createDataFrame([("1", "The Oak Brewing Co."), ("2", "Oak"), ("3", "LLC")], "id string, name string")
    assert {r["id"]: r["canonical"] for r in identity.maker_merges(m).where("core = 'oak'").collect()} == {"1": "2", "2": "2"}


def test_upsert_is_idempotent_and_quarantine_names_rules(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, seq int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "id int, v string, seq int")
    once = sinks.upsert(old, new, ["id"], "seq")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, sinks.upsert(once, new, ["id"], "seq").collect())) == [(1, "a", 1), (2, "c", 2), (3, "d", 2)]
    good, bad = medallion.quarantine(old, {"small": F.col("id") < 2, "set": F.col("v").isNotNull()})
    assert good.count() == 1 and bad.first()["broken_rules"] == ["small"]
    assert sinks.delete(old, new, "id").count() == 1
    assert sinks.pre_image(old, new, old.limit(0), "id").count() == 1


def test_damaged_export(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "head\n'21088900000001',BR-1,\"21,142\",03/29/2021,Oak,House,01,X,901,Ale\n21088900000002,BR-1,1,03/29/2021,Capon, Tobala,House,01,X,977,Anisette, Ouzo\n21088900000003,BR-1,21,142,03/30/2021,Elm\nLine,House,6J,Y,901,Ale\n21088900000004,short\n21088900000005,BR,1,no date,A,B,01,X,901,Ale\n"
    )
    got = {r["ttb_id"]: r for r in pages.read_exports(spark, str(tmp_path)).collect()}
    assert set(got) == {"21088900000001", "21088900000002", "21088900000003"}
    assert got["21088900000002"]["fanciful_name"] == "Capon, Tobala" and got["21088900000002"]["class_type"] == "Anisette, Ouzo"
    assert got["21088900000003"]["serial"] == "21,142" and got["21088900000003"]["brand_name"] == "House" and got["21088900000003"]["fanciful_name"] == "Elm Line"
    assert got["21088900000001"]["serial"] == "21,142" and got["21088900000001"]["permit_no"] == "BR-1"


def test_export_ids_of_eight_to_twenty_digits_start_records(spark, tmp_path):
    row = ',BR-1,1,03/29/2021,"Oak, Old",House,01,X,901,Ale'
    ids = ["12345678", "1234567890", "12345678901234567890"]
    (tmp_path / "a.csv").write_text("head\n" + "\n".join([*(i + row for i in ids), ""]) + "\n")
    (tmp_path / "b.csv").write_text("")
    got = {r["ttb_id"]: r["fanciful_name"] for r in pages.read_exports(spark, str(tmp_path)).collect()}
    assert got == dict.fromkeys(ids, "Oak, Old")


def test_pages_and_logs(spark, tmp_path):
    page = "<TR><td>A&#x2f;B</td><td> <b>x</b>\n y </td></TR><tr><td>short</td></tr>"
    df = spark.createDataFrame([(page,), (None,), ("",)], "page string")
    assert [tuple(r) for r in pages.read_table(df, "page", ["a", "b"]).collect()] == [("A/B", "x y")]
    assert one(spark, pages.page_range(F.lit("Results 1 to 20 of 345")))["total"] == 345
    (tmp_path / "log.jsonl").write_text('{"name": "scan", "n": 1}\n{"name": "sc')
    assert pages.read_json_lines(spark, str(tmp_path), "name string, n int", ["scan"]).count() == 1


def test_fuzzy_tokens(spark):
    q = spark.createDataFrame([("harbr",), ("harbor",), ("harbo",), ("zzzzz",)], "q string")
    w = spark.createDataFrame([("harbor",), ("harborside",)], "w string")
    got = {(r["q"], r["w"]): r["weight"] for r in retrieval.token_lookup(q, w).collect()}
    assert got.pop(("harbor", "harborside")) == 0.6 and got.pop(("harbo", "harborside")) == 0.6
    long = "y" * 40 + "oak" + "z" * 40
    far = spark.createDataFrame([(long,), ("x" + long,), (long[:-1],)], "q string")
    assert retrieval.token_lookup(far, spark.createDataFrame([(long,)], "w string")).count() == 3
    ends = retrieval.token_lookup(spark.createDataFrame([("undersea",)], "q string"), spark.createDataFrame([("dersea",)], "w string"))
    assert [r["weight"] for r in ends.collect()] == [0.6]
    assert got == {("harbr", "harbor"): 0.7, ("harbor", "harbor"): 1.0, ("harbo", "harbor"): 0.7}


def test_frames(spark):
    names = spark.createDataFrame([("n1", "Rusty Harbor", "Rusty Harbor"), ("n2", "Elm", "Elm Mill")], "id string, name string, qualified string")
    f = spark.createDataFrame([(1, 0, "RUSTY HARBOR"), (1, 1, "12%"), (2, 0, "nothing known"), (3, 0, None), (None, 0, "Rusty Harbor")], "frame_id long, pos int, text string")
    got = frames.resolve_frames(f, names).collect()
    assert [(r["frame_id"], r["id"], r["verdict"]) for r in got] == [(1, "n1", "resolved")]
    grams = lambda t: frames.word_grams(F.lit(t))
    assert one(spark, frames.extent_similarity(grams("high life"), grams("miller brewed high life"))) == 1.0
    assert one(spark, frames.extent_similarity(grams("high life"), grams(""))) == 0.0
    assert one(spark, frames.match_score([grams("Elm"), grams("Elm Mill")], grams("ELM MILL ALE"))) == 1.0
    assert frames.echoes(["Rusty Harbor Ale", "Rusty Harbor", "Elm"]) == [0, 0, 2]


def test_lines_find_the_same_names_by_their_rarest_word_as_by_all(spark):
    names = [(f"n{i:03d}", f"{a} {b}") for i, (a, b) in enumerate((a, b) for a in ("oak", "elm", "ash", "fir", "yew") for b in ("mill", "barn", "barn mill", "hill house mill"))] + [("x", None), ("y", "mill mill"), ("z", "")]
    lines = [(i, t) for i, t in enumerate(["Oak Mill", "OAK barn mill", "mill", "nothing known", "hill mill barn", None, "", "oak mill", "elm hill house", "yew"])]
    n, q = spark.createDataFrame(names, "id string, name string"), spark.createDataFrame(lines, "qid int, text string")
    split = lambda t: {w for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split() if len(w) >= 3}
    import math

    total = sum(name is not None for _, name in names)
    df = {w: sum(w in split(name) for _, name in names) for w in {w for _, name in names for w in split(name)}}
    want = set()
    for i, t in lines:
        hits = [(-round(sum(math.log1p(total / df[w]) for w in split(t) & split(name)), 6), k) for k, name in names if split(t) & split(name)]
        want |= {(i, k, -e) for e, k in sorted(hits)[:3]}
    for spare in (0, 2, retrieval.SPARE):
        assert {tuple(r) for r in retrieval.match_lines(q, n, 3, spare).select("qid", "id", "evidence").collect()} == want
    garbled = retrieval.find_candidates(spark.createDataFrame([(1, "hous barm")], "qid int, text string"), n)
    assert garbled.count() == 0 and retrieval.find_candidates(q, n.limit(0)).count() == 0


def test_boxes_of_a_frame_are_joined_through_others(spark):
    from cellarium.operators import curation

    # Two columns side by side, each of three lines; a line far below; a frame of its own.
    rows = [(1, i * 2 + c, c * 0.5, 0.05 * i, 0.3, 0.03) for i in range(3) for c in range(2)] + [(1, 9, 0.0, 0.9, 0.3, 0.03), (2, 0, 0.0, 0.0, 0.3, 0.03), (None, 1, 0.0, 0.0, 0.1, 0.1), (3, 1, None, 0.0, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "frame_id long, pos long, x double, y double, w double, h double")
    got = {(r["frame_id"], r["pos"]): r["cluster"] for r in curation.text_clusters(df).collect()}
    assert got == {(1, p): p % 2 for p in range(6)} | {(1, 9): 9, (2, 0): 0}


def test_tracker_smooths_ends_and_forgets():
    t = tracker.advance({}, 0.0, [((0.1, 0.1, 0.2, 0.2), ["oak"])])
    t = tracker.advance(t, 1.0, [((0.12, 0.1, 0.2, 0.2), ["ale"]), ((0.7, 0.7, 0.1, 0.1), [])])
    assert t["t0"]["frames"] == 2 and t["t0"]["box"][0] == pytest.approx(0.11) and set(t["t0"]["texts"]) == {"oak", "ale"} and "t1" in t
    t = tracker.advance(t, 2.4, [((0.11, 0.1, 0.2, 0.2), [])])
    t = tracker.advance(t, 3.8, [((0.11, 0.1, 0.2, 0.2), [])])
    assert set(t["t0"]["texts"]) == {"ale"} and "t1" not in t
    assert set(tracker.advance(t, 9.0, [((0.11, 0.1, 0.2, 0.2), [])])) == {"t2", "next"}


def test_sightings_do_not_depend_on_batches():
    at = lambda m: pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)
    rows = pd.DataFrame({"ts": [at(m) for m in (0, 5, 30, 44, 60)]})
    gap = pd.Timedelta(minutes=15)
    _, whole = events.count_sightings(rows, None, 0, gap)
    last, n = events.count_sightings(rows[:2], None, 0, gap)
    _, parts = events.count_sightings(rows[2:], last, n, gap)
    assert whole == parts == 3


def test_tracker_stream(spark, tmp_path):
    rows = [{"session_id": s, "t": float(t), "x": 0.1, "y": 0.1, "w": 0.2, "h": 0.2, "text": "oak"} for s in (1, 2) for t in (0, 1)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    s = spark.readStream.schema("session_id long, t double, x double, y double, w double, h double, text string").json(str(tmp_path / "in"))
    got = events.run_to_end(tracker.track(s)).where("ready").collect()
    assert {(r["session_id"], r["track_id"], r["texts"]) for r in got} == {(1, "t0", "oak"), (2, "t0", "oak")}


def test_files_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("scan", 1), ("other", 2)], "name string, n int")
    sinks.append_events(e, e.limit(1), str(tmp_path / "log"))
    sinks.append_events(e, e.limit(1), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    sinks.write_index(spark.createDataFrame([("a", 1)], "token string, id int"), str(tmp_path / "ix"), dt.date(2025, 1, 1).isoformat())
    assert spark.read.parquet(str(tmp_path / "ix")).first()["stamp"] == dt.date(2025, 1, 1)
