"""Every training-data operator on small fixtures: brute force, ties, nulls, empty tables, clashing columns."""

import datetime as dt
import json
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellarium.llm import canonical, components, entities, mixing, neighbours, packing, quality, survivors, tokens

DAY = dt.datetime(2025, 1, 1)


# ---- p2

def brute_neighbours(rows, k, least):
    ok = {i: np.array(v, dtype=float) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None for x in v) and any(v)}
    pairs = set()
    for i in ok:
        near = sorted(((-round(float(ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j])), 12), j) for j in ok if j != i))[:k]
        pairs |= {(i, j) for c, j in near if -c >= least}
    return pairs


def test_neighbours_match_brute_force_with_copies_ties_and_nulls(spark):
    rng = np.random.default_rng(3)
    rows = [(f"v{i:03d}", rng.random(5).tolist()) for i in range(60)]
    rows += [(f"c{i}", rows[0][1]) for i in range(9)] + [("scaled", [2 * x for x in rows[1][1]])]
    rows += [("zero", [0.0] * 5), ("none", None), (None, [1.0] * 5), ("hole", [1.0, None, 1.0, 1.0, 1.0]), ("empty", [])]
    df = spark.createDataFrame(rows, "id string, vec array<double>").withColumn("point", F.lit(1)).withColumn("cos", F.lit("x"))
    got = neighbours.most_similar(df, "id", "vec", k=5).select("id", "other").collect()
    assert {tuple(r) for r in got} == brute_neighbours(rows, 5, -1)
    assert neighbours.most_similar(df.limit(0), "id", "vec").count() == 0


def test_neighbours_through_learned_partitions_reach_their_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.random((40, 12))
    x = np.abs(centres[rng.integers(0, 40, 3000)] + 0.05 * rng.standard_normal((3000, 12)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    points = neighbours.distinct_points(neighbours.usable_vectors(df, "id", "vec"), 6)
    index, n = neighbours.build_index(points, part_points=200)
    index = index.cache()
    found = neighbours.search(index, index, 5).join(points.select(F.col("point").alias("q"), F.col("members")[0].alias("a")), "q").join(points.select("point", F.col("members")[0].alias("b")), "point")
    got = {(r["a"], r["b"]) for r in found.select("a", "b").collect()}
    assert neighbours.search(*[neighbours.build_index(points, part_points=None)[0]] * 2, 5).select("q", "point").exceptAll(neighbours.search(*[neighbours.build_index(points, part_points=10**6)[0]] * 2, 5).select("q", "point")).count() == 0
    two, _ = neighbours.build_index(points, part_points=100, one_level=8)
    two = two.cache()
    assert two.select(F.element_at("parts", 1)).distinct().count() > 20 and two.where(F.size("parts") != F.size(F.array_distinct("parts"))).count() == 0
    found2 = neighbours.search(two, two, 5).join(points.select(F.col("point").alias("q"), F.col("members")[0].alias("a")), "q").join(points.select("point", F.col("members")[0].alias("b")), "point")
    got2 = {(r["a"], r["b"]) for r in found2.select("a", "b").collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T
    np.fill_diagonal(sim, -1)
    want = {(i, int(j)) for i in range(n) for j in np.argsort(-sim[i])[:5]}
    assert len(got & want) / len(want) >= 0.9
    assert len(got2 & want) / len(want) >= 0.9


def test_partitions_are_balanced():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = neighbours.balanced_cut(neighbours.neighbour_graph(x, 5), 400, 7, 1)
    assert set(np.bincount(label, minlength=7)) <= {57, 58}


# ---- p3

ENTRIES = [(1, "class_type", "Milk Stout", "beer"), (2, "class_type", "Pear Perry", "cider"), (3, "class_type", "Table Red Wine", "wine"), (4, "class_type", "Porter", "beer"), (5, "class_type", "Baltic Porter", "beer")]


TYPED = {"MILK STOUT": 1, "Stout, Milk": 1, "milkstout": 1, "MlkStout": 1, "412 - Mikl Stout": 1, "p0rter": 4, "Portér *": 4, "wine table red": 3, "Table Red Wn": 3, "baltic por": 5, "Per Perry": 2, "Candle": -1, "Sparkling water": -1, "9999": -1, "x" * 5000: -1}


def test_typed_values_find_their_entry(spark):
    entries = spark.createDataFrame(ENTRIES, "entry_id int, list_name string, label string, category string")
    values = spark.createDataFrame([("class_type", v) for v in TYPED], "list_name string, value string")
    assert {r["value"]: r["entry_id"] for r in canonical.match_values(values, entries).collect()} == TYPED


def test_typed_rows_keep_ids_and_leave_out_labels_and_blanks(spark):
    entries = spark.createDataFrame(ENTRIES, "entry_id int, list_name string, label string, category string")
    f = spark.createDataFrame([(1, "PORTER", "a"), (1, "PORTER", "a"), (2, "Porter", "b"), (3, None, None), (4, " n/a ", None), (5, "candle", None)], "row_id long, class_type string, value string")
    d = spark.createDataFrame([(7, ("??",)), (8, None)], "row_id long, product struct<style:string>")
    got = sorted(map(tuple, canonical.map_typed_values(f, d, entries).collect()))
    assert got == [("ttb_cola_sample", 1, 4), ("ttb_cola_sample", 1, 4), ("ttb_cola_sample", 5, -1)]
    assert canonical.map_typed_values(f.limit(0), d.limit(0), entries).count() == 0
    assert canonical.map_typed_values(f, d, entries.limit(0)).where("entry_id <> -1").count() == 0


# ---- p5

def test_components_equal_union_find_on_chains_stars_and_cycles(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(0, 60)] + [("hub", f"s{i:03d}") for i in range(80)] + [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("a", "b")]
    rows = [(x, y, True) for x, y in edges] + [("q", "r", False), ("q", "s", None), ("t", "t", True), (None, "a", True), ("zz", None, True)]
    df = spark.createDataFrame(rows, "id_a string, id_b string, is_match boolean").withColumn("root", F.lit(0)).withColumn("x", F.lit(0))
    got = {r["gold_id"]: r["group_id"] for r in components.match_groups(df).collect()}
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for x, y in edges:
        parent[find(x)] = find(y)
    groups = {}
    for v in list(parent):
        groups.setdefault(find(v), []).append(v)
    assert got == {v: min(g) for g in groups.values() for v in g}
    assert components.match_groups(df.limit(0)).count() == 0


# ---- p6

def gold_rows():
    rec = lambda **x: json.dumps(x)
    return [
        ("brand:a:1", "brand", rec(name="Tormel Harbor")),
        ("p:1", "product", rec(brand_id="brand:a:1", name="Rusty Comet", aliases=[], spec={"abv_pct": {"value": 5.0}})),
        ("p:2", "product", rec(brand_id="brand:a:1", name="Rusty Comet No. 7", aliases=[])),
        ("p:3", "product", rec(brand_id="brand:gone-9", name="Quiet Otter by Belvar Mill", aliases=[])),
        ("p:4", "product", rec(brand_id=None, name=None, aliases=None)),
        ("p:5", "product", "not json"),
        ("sku:1", "sku", rec(product_id="p:1", upc="412345678905")),
        (None, None, None),
    ]


def test_entities_match_on_damaged_names_and_never_across_numbers(spark):
    gold = spark.createDataFrame(gold_rows(), "id string, entity_type string, record string").withColumn("l", F.lit(1)).withColumn("words", F.lit(1))
    rows = [
        ("t1", "TORMEL HARBOR", "RUSTY COMET", "4 12345 67890 5", 5.0),
        ("t2", "The Tormel Harbor Spirits", "Comet Rusty", None, None),
        ("t3", "Tormel Harbr", "Rusty Comt", None, 5.0),
        ("t4", "Tormel Harbor", "RUSTY COMET NO. 7", None, None),
        ("t5", "Tormel Harbor", None, "0412345678905", 5.0),
        ("t6", "Belvar Mill", "Quiet Otter", None, None),
        ("t7", "Other House", "Rusty Comet", None, None),
        ("t7", "Other House", "Rusty Comet", None, None),
        ("t8", None, None, None, None),
        (None, "Tormel Harbor", "Rusty Comet", None, None),
        ("t9", "Tormel Harbor", "Quiet Engine", "412345678905", 40.0),
        ("t10", "x" * 20000, "y " * 5000, "1" * 500, float("nan")),
    ]
    f = spark.createDataFrame([(*r, "Ale") for r in rows], "ttb_id string, brand_name string, fanciful_name string, upc string, abv double, class_type string")
    got = entities.match_entities(f, gold).collect()
    assert {(r["ttb_id"], r["gold_id"]) for r in got} == {("t1", "p:1"), ("t2", "p:1"), ("t3", "p:1"), ("t4", "p:2"), ("t5", "p:1"), ("t6", "p:3")}
    assert all(0.5 <= r["confidence"] <= 1 for r in got)
    assert entities.match_entities(f.limit(0), gold).count() == 0
    assert entities.match_entities(f, gold.limit(0)).count() == 0


def test_names_keep_every_word_but_their_class():
    labels = frozenset({"barley wine ale", "porter"})
    read = lambda b, n: entities.read_name(b, n, labels)
    assert read("Old House", "Old House Old Barrel Reserve Cask") == ("oldhouse", ["old", "barrel", "reserve", "cask"], "")
    assert read("Old House", "Old Barrel Barley Wine Al") == ("oldhouse", ["old", "barrel"], "")
    assert read(None, "Torbrinarqui Mill Old Barrel Porter") == ("torbrinarquimill", ["old", "barrel"], "")
    assert read("Three Word House", "Three Word House Barrel 12 Yaer Batch 7") == ("threewordhouse", ["barrel", "batch", "7"], "y12")


def test_drinks_that_differ_in_a_third_word_do_not_match(spark):
    rec = lambda **x: json.dumps(x)
    names = ["Rusty Barrel", "Rusty Barrel Reserve Cask", "Rusty Barrel Smoked"]
    gold = spark.createDataFrame([("b", "brand", rec(name="Tormel Harbor"))] + [(f"p:{i}", "product", rec(brand_id="b", name=n, aliases=[])) for i, n in enumerate(names)], "id string, entity_type string, record string")
    f = spark.createDataFrame([(f"t{i}", "TORMEL HARBOR", n.upper(), None, None, "Ale") for i, n in enumerate([*names, "Rusty Barrel Organic"])], "ttb_id string, brand_name string, fanciful_name string, upc string, abv double, class_type string")
    told = []
    got = {(r["ttb_id"], r["gold_id"]) for r in entities.match_entities(f, gold, told_of=told).collect()}
    assert got == {("t0", "p:0"), ("t1", "p:1"), ("t2", "p:2")} and told[-1][1] < entities.SETTLED


def test_barcodes_are_read_with_and_without_their_check_digit(spark):
    codes = ["412345678903", "0412345678903", "4 12345 67890 3", "41234567890", "412345678904", "41234567", "111111111111", None]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    assert [r[0] for r in df.select(entities.barcode_key(F.col("c"))).collect()] == ["412345678903"] * 4 + ["412345678904", None, None, None]


def test_competing_pairs_share_their_probability(spark):
    scored = spark.createDataFrame([(1, 10, 2.0, "x", ""), (1, 11, 2.0, "y", ""), (2, 12, 2.0, "", ""), (3, 13, -9.0, "", "")], "l long, r long, prior double, l_rival string, r_rival string")
    p = {(r["l"], r["r"]): r["prob"] for r in entities.propagate(scored).collect()}
    assert p[1, 10] == pytest.approx(p[1, 11]) and p[1, 10] < 0.6
    assert p[2, 12] == pytest.approx(1 / (1 + np.exp(-2))) and (3, 13) not in p


# ---- p7

def test_surviving_fields_follow_trust_then_recency(spark):
    def rec(name=None, style=None, abv=None, ibu=None, text=None):
        v = lambda x: None if x is None else {"value": x}
        return json.dumps({"name": name, "style": v(style), "spec": {"abv_pct": v(abv), "ibu": v(ibu)}, "description": v(text)})

    gold = spark.createDataFrame(
        [
            ("mk:1", "product", rec("N/A", "Ale", 5.0), DAY),
            ("ob:2", "product", rec("Good", "Porter", 999.0, 30.0), DAY + dt.timedelta(days=9)),
            ("ob:3", "product", rec("Later", None, 0.0, -1.0, "coming soon"), DAY + dt.timedelta(days=20)),
            ("ob:4", "product", rec("Tie", None, None, 31.0), DAY + dt.timedelta(days=20)),
            ("ob:5", "product", None, None),
        ],
        "id string, entity_type string, record string, updated_at timestamp",
    )
    bronze = spark.createDataFrame([("maker_direct", "1"), (" OPEN-MAIN ", "2"), ("open-main", "3"), ("open-main", "4"), ("open-main", "4"), (None, "5"), ("x", None)], "source_id string, natural_key string")
    reg = spark.createDataFrame([("maker-direct", "mk", 1), ("open-main", "ob", 3)], "source_id string, id_prefix string, trust_tier int")
    groups = spark.createDataFrame([(1, "mk:1"), (1, "ob:2"), (1, "ob:3"), (1, "ob:4"), (1, "ob:4"), (2, "ob:5"), (3, None), (4, "no:9")], "group_id long, gold_id string").withColumn("tier", F.lit(99))
    m = survivors.group_members(groups, survivors.member_values(gold), survivors.source_tiers(bronze, reg))
    got = {(r["group_id"], r["field_name"]): r["gold_id"] for r in survivors.field_survivors(m).collect()}
    assert got == {(1, "name"): "ob:3", (1, "style"): "mk:1", (1, "abv_pct"): "mk:1", (1, "ibu"): "ob:4"}
    wide = {r["group_id"]: r for r in survivors.build_survivors(m).collect()}
    assert wide[1]["survivor_id"] == "mk:1" and wide[1]["ibu"] == "31.0" and wide[2]["name"] is None
    assert wide[1]["layers"] >= 1 and wide[1]["name_layer"] >= 1 and wide[1]["style_layer"] == 1
    assert survivors.field_survivors(m.limit(0)).count() == 0 and survivors.build_survivors(m.limit(0)).count() == 0


def test_layers_are_peeled_one_after_the_other(spark):
    rng = np.random.default_rng(4)
    rows = [(g, f"m{g}-{i:02d}", int(rng.integers(1, 5)), int(rng.integers(0, 6)), DAY + dt.timedelta(days=int(rng.integers(0, 9)))) for g in range(6) for i in range(40)]
    m = spark.createDataFrame(rows, "group_id long, gold_id string, tier int, complete int, updated_at timestamp")
    for r in survivors.dominance_layers(m, "group_id").collect():
        best = {}
        for _, i, t, c, u in (x for x in rows if x[0] == r["group_id"]):
            best[t, c] = min(best.get((t, c), (u - u, "~")), (DAY - u, i))
        left, layer, want = {k: v[0] for k, v in best.items()}, 0, {}
        while left:
            layer += 1
            top = [p for p in left if not any(q != p and q[0] <= p[0] and q[1] >= p[1] and left[q] <= left[p] for q in left)]
            want |= {best[p][1]: layer for p in top}
            left = {p: a for p, a in left.items() if p not in top}
        assert {p["gold_id"]: p["layer"] for p in r["points"]} == want


# ---- p8

def test_packing_places_everything_once_and_near_the_bound(spark):
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in rng.integers(1, 90, 3000)] + [250, 100, 200, 100] + [60] * 1500
    rows = [(i, s) for i, s in enumerate(sizes)] + [(9001, 0), (9002, None), (0, sizes[0])]
    items = spark.createDataFrame(rows, "doc_id long, tokens long").withColumn("container", F.lit(1)).withColumn("salt", F.lit(1))
    got = packing.pack(items, 100).cache()
    assert got.groupBy("container").agg(F.sum("tokens").alias("t")).where("t > 100").count() == 0
    assert got.agg(F.sum("tokens")).first()[0] == sum(sizes) + sizes[0]
    assert got.where("doc_id = 3000").agg(F.count("*")).first()[0] == 3
    used, bound = got.select("container").distinct().count(), packing_bound(sizes + [sizes[0]], 100)
    assert used <= bound * 1.01 + 1
    docs = spark.createDataFrame([(i, "x") for i in range(len(sizes))] + [(-1, None), (-2, "")], "doc_id long, text string")
    packs = spark.createDataFrame([(1, 100), (2, 40), (None, 7), (3, None)], "pack_id int, capacity_tokens int")
    rules = packing.broken_rules(packing.pack_all(items, packs), docs).collect()
    assert {(r["pack_id"], r["overfull"], r["lost"]) for r in rules} == {(1, 0, 0), (2, 0, 0)}
    assert packing.pack(items.limit(0), 100).count() == 0


def packing_bound(sizes, capacity):
    """Containers any packing needs: by volume, or with items above half a container apart from each other."""
    small = [s % capacity for s in sizes]
    return max(-(-sum(sizes) // capacity), sum(s > capacity / 2 for s in small) + sum(s // capacity for s in sizes))


def test_packing_equals_the_optimum_on_a_small_case():
    plan = packing.plan_containers(np.array([30, 70]), np.array([10, 10]), 100)
    assert sum(n for _, n in plan) == 10
    assert packing.best_composition(np.array([3, 5]), np.array([4.0, 7.0]), np.array([9, 9]), 11).tolist() == [2, 1]
    assert packing.best_composition(np.array([3, 5]), np.array([4.0, 7.0]), np.array([1, 1]), 30).tolist() == [1, 1]


@pytest.mark.parametrize(("capacity", "draw"), [(4096, lambda g: np.exp(g.normal(5.4, 0.9, 1000))), (1024, lambda g: np.exp(g.normal(5.4, 0.9, 10_000))), (1024, lambda g: g.integers(200, 600, 5000)), (256, lambda g: g.integers(1, 256, 4000)), (1000, lambda g: np.full(5000, 333))])
def test_plans_hold_every_item_once_near_the_bound_and_never_above_best_fit(capacity, draw):
    lengths, counts = np.unique(draw(np.random.default_rng(1)).astype(int) % capacity, return_counts=True)
    lengths, counts = lengths[lengths > 0], counts[lengths > 0]
    need = dict(zip(lengths.tolist(), counts.tolist()))
    plan, held = packing.plan_containers(lengths, counts, capacity), {}
    for parts, n in plan:
        assert n > 0 and sum(m * k for m, k in parts.items()) <= capacity
        for m, k in parts.items():
            held[m] = held.get(m, 0) + n * k
    assert held == need
    used = sum(n for _, n in plan)
    assert used <= sum(n for _, n in packing.best_fit(need, [], capacity))
    assert used <= 1.01 * packing.least_containers(lengths, counts, capacity) + 1
    solved = packing.solve_configurations(lengths, counts, capacity)
    assert sum(n * m * k for parts, n in solved for m, k in parts.items()) >= (1 - min(packing.LEFT)) * (lengths * counts).sum()


# ---- p9

def test_mix_reaches_its_shares_within_the_caps(spark):
    rows = [(i, "big" if i % 3 else "small", 10 + i % 7) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n long").withColumn("text", F.lit("x")).withColumn("times", F.lit(9))
    sized = mixing.sized_documents(docs.unionByName(spark.createDataFrame([(None, "big", 5, "x", 9), (1, None, 5, "x", 9), (5000, "big", 0, "x", 9)], docs.schema)), F.col("n"))
    targets = spark.createDataFrame([(1, "big", 0.5, 1), (1, "small", 0.4, 3), (1, "absent", 0.1, 2), (2, "big", 0.25, 1), (2, "small", 0.75, 2)], "mix_id int, source string, target_share double, max_repeats int")
    sel = mixing.select_mix(sized, targets).cache()
    share = {(r["mix_id"], r["source"]): r for r in mixing.share_report(sel, targets).collect()}
    assert share[1, "big"]["reached_share"] == pytest.approx(5 / 9, abs=0.01) and share[1, "small"]["reached_share"] == pytest.approx(4 / 9, abs=0.01)
    assert share[1, "absent"]["tokens"] == 0 and share[2, "small"]["most_times"] == 2
    assert share[2, "small"]["reached_share"] == pytest.approx(0.75, abs=0.01)
    small_in = lambda mix: {r["doc_id"] for r in sel.where(f"mix_id = {mix} and source = 'big'").collect()}
    assert small_in(2) <= small_in(1) or small_in(1) <= small_in(2)
    assert mixing.select_mix(sized.limit(0), targets).count() == 0 and mixing.select_mix(sized, targets.limit(0)).count() == 0


# ---- p10

PROSE = ["The barrels were filled in the spring and moved twice before anyone tasted them, which is not how we like to work. ", "It was a cold day, so the brewer had to wait for the yeast, and that was the end of the argument with her neighbour. ", "By the second week they had lost most of it to the heat, although the numbers on the label said it was better than that. "]
JUNK = ["honey, 2 kg\nhops, 9 g\nmalt, 12 kg\noats, 1 kg\nsalt, 2 g", "name\tabv\tibu\nComet\t5.1\t33\nOtter\t6.2\t12\nAnvil\t7.0\t55", "Home | Shop | Terms | Privacy | Basket (0) | Jobs", "a9Fk3+Lm/Qz8rT0==" * 20, "Click here to continue " * 30, "****************************"]


def test_junk_is_told_from_prose(spark):
    texts = [PROSE[i % 3] + PROSE[(i + 1) % 3] * (1 + i % 2) + PROSE[(i * 7) % 3].upper() for i in range(60)]
    words = (PROSE[0] + PROSE[1]).split()
    texts += ["\n".join(" ".join(words[i : i + 6]) for i in range(0, len(words), 6)), "Notes\n- hops\n- malt\n" + PROSE[0] + PROSE[1] + PROSE[2], (PROSE[0] + PROSE[1]) * 3]
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(texts)] + [(1000 + i, t, "EN") for i, t in enumerate(JUNK)] + [(2000, None, "en"), (2001, "  \n", "en"), (2002, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("spoken", F.lit(1)).withColumn("distance2", F.lit(1))
    got = quality.quality_report(docs).cache()
    assert {r["doc_id"] for r in got.where("is_junk").collect()} == {1000 + i for i in range(len(JUNK))}
    assert got.count() == len(texts) + len(JUNK)
    parts = sum((F.col(f"{s}_part") for s in quality.STATISTICS), F.lit(0.0))
    assert got.where(F.abs(parts - F.col("distance2")) > 1e-6 * (1 + F.col("distance2"))).count() == 0
    assert quality.quality_report(docs.limit(0)).count() == 0


def test_junk_distance_counts_every_statistic_and_covariance(spark):
    k, at = len(quality.STATISTICS), quality.STATISTICS.index
    cov = np.eye(k)
    i, j = at("digit_ratio"), at("symbol_ratio")
    cov[i, j] = cov[j, i] = 0.8
    fit = {"en": (np.zeros(k), np.linalg.inv(cov))}
    off = {0: {"mean_word_length": 4.0}, 1: {"line_end_share": -3.0}, 2: {"digit_ratio": 2.0, "symbol_ratio": 2.0}, 3: {"digit_ratio": 2.0}, 4: {"common_word_share": 5.0}}
    rows = [(d, "en", *[float(x.get(s, 0)) for s in quality.STATISTICS]) for d, x in off.items()]
    stats = spark.createDataFrame(rows, "doc_id long, spoken string, " + ", ".join(f"{s} double" for s in quality.STATISTICS))
    got = {r["doc_id"]: r for r in quality.with_distance(stats, fit).collect()}
    want = {0: 16.0, 1: 0.0, 2: 8 / 1.8, 3: 4 / 0.36, 4: 0.0}
    for d, x in want.items():
        assert got[d]["junk_distance2"] == pytest.approx(x)
        assert sum(got[d][f"{s}_junk_part"] for s in quality.STATISTICS) == pytest.approx(x)


# ---- tokens

def test_tokens_of_long_texts_add_up(spark):
    long = "one two, three " * 20_000
    df = spark.createDataFrame([("",), (None,), ("a",), (long,), ("z" * 250_000,)], "t string")
    n = [r[0] for r in df.select(tokens.count_tokens(F.col("t"))).collect()]
    enc = tokens.encoding(f"{tokens.FOLDER}/{tokens.VOCABULARY}")
    assert n[0] == 0 and n[1] is None and n[2] == 1 and n[3] == len(enc.encode_ordinary(long)) and n[4] > 0


def test_no_candidate_is_lost_between_close_brands():
    assert entities.close("torulmarda", "torulmrda") and not entities.close("amber", "ember")
    for a, b in combinations(["rusty", "harbor", "comet"], 2):
        assert not entities.close(a, b)
