"""Long chains take many rounds; what the driver keeps of them does not grow."""

from cellarium.llm import components


def test_estimates_and_plans_do_not_grow_with_the_rounds(spark, monkeypatch):
    bits, joins, stored = [], [], components._stored

    def watched(df):
        plan = df._jdf.queryExecution().optimizedPlan()
        bits.append(len(plan.stats().sizeInBytes().toString() if hasattr(plan.stats().sizeInBytes(), "toString") else format(plan.stats().sizeInBytes(), "x")))
        joins.append(plan.toString().count("Join "))
        return stored(df)

    monkeypatch.setattr(components, "_stored", watched)
    pairs = spark.createDataFrame([(f"v{i:05d}", f"v{i + 1:05d}", True) for i in range(3000)], "id_a string, id_b string, is_match boolean")
    got = components.match_groups(pairs)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 3
    assert len(bits) > 10 and max(bits) < 40 and max(joins) <= 2
    assert {(r["group_id"]) for r in got.collect()} == {"v00000"} and got.count() == 3001
