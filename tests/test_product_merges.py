import difflib
import random
import re

from cellarium.operators import identity


def brute(rows):
    """The rule over all pairs, product by product."""
    def prep(id_, name, brand):
        nt, bt = ({w for w in re.findall(r"[^\W\d_]+", (x or "").lower()) if len(w) >= 2} for x in (name, brand))
        return id_, nt, nt | bt, set() if not bt or bt == {"unknown"} or bt <= nt else bt, set(re.findall(r"\d+", name or ""))

    def fits(a, b):
        missing = a[1] - b[2]
        if a[0].split(":")[0] == b[0].split(":")[0] or len(b[1]) <= len(a[1]) or a[4] != b[4]:
            return False
        if missing and not (missing <= identity.AGE and (a[1] - missing) - identity.STYLE):
            return False
        x, y = ("".join(sorted("".join(v[3]))) for v in (a, b))
        alike = not a[3] or not b[3] or a[3] <= b[2] or b[3] <= a[2] or difflib.SequenceMatcher(None, x, y).ratio() >= identity.BRAND_LIKENESS
        return alike and bool((a[2] & b[2]) - identity.STYLE)

    ps = [prep(*r) for r in rows]
    found = {a[0]: [b[0] for b in ps if fits(a, b)] for a in ps if a[1]}
    return {(k, v[0]) for k, v in found.items() if len(v) == 1}


def test_products_merge_into_the_one_longer_name(spark):
    rows = [("a:1", "Rusty Comet", "Oak Harbor"), ("a:2", "Comet Rusty", "Oak Harbor"), ("b:1", "Rusty Comet Stout", "Oak Harbour"), ("a:3", "Rusty Comet", "Elm Mill"), ("b:2", "Tidal Fox 16 Year Old Whisky", None), ("a:4", "Tidal Fox 16 ans", "Unknown"), ("a:5", "Tidal Fox 8", None), ("a:6", "Stout", "Quiet Otter"), ("b:3", "Quiet Otter Stout", None), ("c:1", "Quiet Otter Stout Extra", None), ("a:7", None, "Oak"), ("b:4", "x", None)]
    rng = random.Random(4)
    pool = ["rusty", "comet", "stout", "ale", "fox", "tidal", "old", "7"]
    rows += [(f"{rng.choice('xyz')}:r{i}", " ".join(rng.sample(pool, rng.randint(1, 5))), rng.choice([None, "Vale", "Vale Mill", "Brae", "unknown"])) for i in range(120)]
    got = [tuple(r) for r in identity.product_merges(spark.createDataFrame(rows[:12], "id string, name string, brand string")).collect()]
    assert sorted(got) == sorted(brute(rows[:12])) and {("a:1", "b:1"), ("a:2", "b:1"), ("a:4", "b:2")} <= set(got)
    df = spark.createDataFrame(rows[12:], "id string, name string, brand string")
    got = [tuple(r) for r in identity.product_merges(df).collect()]
    assert sorted(got) == sorted(brute(rows[12:]))
    assert identity.product_merges(df.limit(0)).count() == 0
