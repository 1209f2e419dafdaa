"""Best representative of each duplicate group, by skylines over completeness, recency and trust.

Points are aggregated before they are compared: trust has a handful of tiers and completeness a
handful of values, so a group of any size shrinks to a bounded number of points (the latest record
of every tier and completeness). A group that holds a third of all rows therefore costs one partial
aggregate per task and never meets in one place. Dominance layers are then peeled from the points of
each group: the first layer is undominated, the next one is so once the first is taken away.

The surviving record is taken from the first layer by the policy: lowest tier, then latest update,
then most complete, then smallest id. Every field is taken from the first layer of the members that
state it, by tier, update and id; where that member is not the surviving record, the field is filled
from the record layer reported with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarium.functions.stated import says_nothing, stated_abv, stated_ibu

FIELDS = ["name", "style", "abv_pct", "ibu", "description"]
_RECORD = "name string, style struct<value:string>, spec struct<abv_pct:struct<value:double>,ibu:struct<value:double>>, description struct<value:string>"
#: Trust of a record without a registered source: behind all registered tiers.
UNTRUSTED = 1_000_000


def normal_source(source: Column) -> Column:
    """One spelling of a source id: trimmed, lower case, hyphens."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[_\s]+", "-")


def member_values(gold: DataFrame) -> DataFrame:
    """``gold_id, updated_at`` and one text column per field, null where nothing is stated."""
    r = F.from_json("record", _RECORD)
    g = gold.where("entity_type = 'product'").select(F.col("id").alias("gold_id"), "updated_at", r.alias("r"))
    text = lambda c: F.when(~says_nothing(c), c)
    return g.select(
        "gold_id",
        "updated_at",
        text(F.col("r.name")).alias("name"),
        text(F.col("r.style.value")).alias("style"),
        stated_abv(F.col("r.spec.abv_pct.value"), F.col("r.style.value"), F.col("r.name")).cast("string").alias("abv_pct"),
        stated_ibu(F.col("r.spec.ibu.value")).cast("string").alias("ibu"),
        text(F.col("r.description.value")).alias("description"),
    )


def source_tiers(bronze: DataFrame, registry: DataFrame) -> DataFrame:
    """``gold_id, tier``: the lowest tier among the sources a record was fetched from."""
    reg = registry.select(normal_source(F.col("source_id")).alias("s"), "id_prefix", "trust_tier")
    fetched = bronze.select(normal_source(F.col("source_id")).alias("s"), "natural_key").distinct()
    return fetched.join(F.broadcast(reg), "s").groupBy(F.concat_ws(":", "id_prefix", "natural_key").alias("gold_id")).agg(F.min("trust_tier").alias("tier"))


def group_members(groups: DataFrame, values: DataFrame, tiers: DataFrame) -> DataFrame:
    """Members with their values, tier and completeness; a group row listed twice counts once."""
    complete = sum(F.col(f).isNotNull().cast("int") for f in FIELDS)
    g = groups.select("group_id", "gold_id").where("group_id is not null and gold_id is not null").distinct()
    return g.join(values, "gold_id").join(tiers, "gold_id", "left").withColumn("tier", F.coalesce("tier", F.lit(UNTRUSTED))).withColumn("complete", complete)


def _latest_first() -> Column:
    return F.struct((-F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(-(2**62)))).alias("age"), F.col("gold_id"))


def dominance_layers(members: DataFrame, *keys: str) -> DataFrame:
    """``*keys, points``: per group the points ``tier, age, less, gold_id, layer`` in lexicographic order.

    A point is the latest record of one tier and completeness. It is dominated by points of no higher
    tier, no earlier update and no less completeness, all of which come before it in this order, so
    its layer is one more than the last layer among those.
    """
    latest = members.groupBy(*keys, "tier", "complete").agg(F.min(_latest_first()).alias("best"))
    point = F.struct("tier", F.col("best.age").alias("age"), (-F.col("complete")).alias("less"), F.col("best.gold_id").alias("gold_id"))
    sorted_ = latest.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("sorted"))

    def add(done: Column, p: Column) -> Column:
        over = F.filter(done, lambda q: (q["age"] <= p["age"]) & (q["less"] <= p["less"]))
        layer = F.coalesce(F.array_max(F.transform(over, lambda q: q["layer"])), F.lit(0)) + 1
        return F.concat(done, F.array(F.struct(p["tier"].alias("tier"), p["age"].alias("age"), p["less"].alias("less"), p["gold_id"].alias("gold_id"), layer.alias("layer"))))

    none = F.array().cast("array<struct<tier:int,age:bigint,less:int,gold_id:string,layer:int>>")
    return sorted_.select(*keys, F.aggregate("sorted", none, add).alias("points"))


def field_survivors(members: DataFrame) -> DataFrame:
    """``group_id, field_name, gold_id``: whose value of each field survives; one row per stated field.

    From the first layer of the members that state the field, over trust and recency (a field has no
    degree of completeness): lowest tier, then latest update, then smallest id.
    """
    stating = F.explode(F.filter(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in FIELDS]), lambda x: x.isNotNull())).alias("field_name")
    layers = dominance_layers(members.select("group_id", "tier", F.lit(0).alias("complete"), "updated_at", "gold_id", stating), "group_id", "field_name")
    first = F.transform(F.filter("points", lambda p: p["layer"] == 1), lambda p: F.struct(p["tier"].alias("tier"), p["age"].alias("age"), p["gold_id"].alias("gold_id")))
    return layers.select("group_id", "field_name", F.array_min(first)["gold_id"].alias("gold_id"))


def record_skyline(members: DataFrame) -> DataFrame:
    """``group_id, gold_id, tier, complete, points, undominated, layers``: the surviving record of each
    group, and how many points and layers it was taken from."""
    layers = dominance_layers(members, "group_id")
    first = F.filter("points", lambda p: p["layer"] == 1)
    pick = F.array_min(F.transform(first, lambda p: F.struct(p["tier"].alias("tier"), p["age"].alias("age"), p["less"].alias("less"), p["gold_id"].alias("gold_id"))))
    out = layers.select("group_id", pick.alias("p"), F.size("points").alias("points"), F.size(first).alias("undominated"), F.array_max(F.transform("points", lambda p: p["layer"])).alias("layers"), F.col("points").alias("__all"))
    return out.select("group_id", F.col("p.gold_id").alias("gold_id"), F.col("p.tier").alias("tier"), (-F.col("p.less")).alias("complete"), "points", "undominated", "layers", "__all")


def build_survivors(members: DataFrame) -> DataFrame:
    """One row per group: the surviving record's id and every field, with the member it came from and
    the layer of that member's tier and completeness."""
    records = record_skyline(members).withColumnRenamed("gold_id", "survivor_id")
    value = F.coalesce(*[F.when(F.col("field_name") == f, F.col(f)) for f in FIELDS])
    donors = field_survivors(members).join(members.select("group_id", "gold_id", F.col("tier").alias("t"), F.col("complete").alias("c"), *FIELDS), ["group_id", "gold_id"])
    at = donors.select("group_id", "field_name", "gold_id", value.alias("v"), "t", "c").join(records.select("group_id", "__all"), "group_id")
    layer = F.array_min(F.transform(F.filter("__all", lambda p: (p["tier"] == F.col("t")) & (-p["less"] == F.col("c"))), lambda p: p["layer"]))
    filled = at.select("group_id", "field_name", "gold_id", "v", layer.alias("layer"))
    of = lambda f, c: F.max(F.when(F.col("field_name") == f, F.col(c)))
    wide = filled.groupBy("group_id").agg(*[x for f in FIELDS for x in (of(f, "v").alias(f), of(f, "gold_id").alias(f"{f}_from"), of(f, "layer").alias(f"{f}_layer"))])
    return records.drop("__all").join(wide, "group_id", "left")
