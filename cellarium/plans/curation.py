"""Queries of the curation passes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellarium.functions import vectors as V
from cellarium.operators import curation, identity, taste
from cellarium.plans.registry import query
from cellarium.plans.relational import PRODUCTS, entities, products
from cellarium.session import table


@query("agg_considered", "select k, count(*) n from (select event_id, min(json_extract_string(props, '$.k')::int) k from events where event_type in ('view', 'click') group by 1) group by 1")
def agg_considered(spark, d):
    e = table(spark, d, "events").where(F.col("event_type").isin("view", "click"))
    first = e.groupBy("event_id").agg(F.min(F.get_json_object("props", "$.k").cast("int")).alias("k"))
    return first.groupBy("k").agg(F.count("*").alias("n"))


@query("agg_list_cap", "select user_id, round(least(1, sum(case event_type when 'signup' then 0.6 when 'purchase' then 0.5 else 0.3 end)), 6)::double w from events where event_type in ('signup', 'purchase', 'click') group by 1")
def agg_list_cap(spark, d):
    w = F.when(F.col("event_type") == "signup", 0.6).when(F.col("event_type") == "purchase", 0.5).otherwise(0.3)
    return table(spark, d, "events").where(F.col("event_type").isin("signup", "purchase", "click")).groupBy("user_id").agg(F.round(F.least(F.lit(1.0), F.sum(w)), 6).alias("w"))


@query("agg_families_spoken", """with e as (select user_id, event_type, label from events join embeddings on vec_id = json_extract_string(props, '$.k')::int)
  select user_id, label from e where event_type = 'signup' union select user_id, label from e where event_type in ('purchase', 'error') union select user_id, label from (select distinct user_id, label, k from (select e2.user_id, e2.label, e2.k from (select user_id, event_type, label, vec_id k from events join embeddings on vec_id = json_extract_string(props, '$.k')::int) e2 where event_type = 'view')) group by 1, 2 having count(*) >= 2""")
def agg_families_spoken(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, d, "events").withColumn("vec_id", k.cast("long")).join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id").select("user_id", "event_type", "label", "vec_id")
    said = e.where(F.col("event_type").isin("signup", "purchase", "error")).select("user_id", "label")
    seen = e.where("event_type = 'view'").groupBy("user_id", "label").agg(F.count_distinct("vec_id").alias("n")).where("n >= 2").select("user_id", "label")
    return said.unionByName(seen).distinct()


@query("er_duplicate_merges", f"""with p as (select p.id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(replace(replace(replace(replace(lower(strip_accents(p.name)), '''', ''), '’', ''), '‘', ''), '`', ''), '[^a-z]+'), lambda w: w <> ''))), ' ') w, regexp_replace(p.name, '[^0-9]', '', 'g') dg, lower(b.name) brand
   from ({PRODUCTS}) p left join (select id, name from gold where entity_type = 'brand') b on p.brand_id = b.id where p.name is not null),
  k as (select w, dg, min(brand) lo, max(brand) hi from p where w <> '' group by 1, 2), q as (select id, w, dg, coalesce(brand, case when lo = hi then lo end) ky from p join k using (w, dg)),
  c as (select w, dg, ky, min(id) canonical from q where ky is not null group by 1, 2, 3 having count(*) > 1) select id, canonical from q join c using (w, dg, ky) where id <> canonical""")
def er_duplicate_merges(spark, d):
    b = entities(spark, d, "brand").select(F.col("id").alias("brand_id"), F.col("name").alias("brand"))
    p = products(spark, d).where("name is not null").join(b, "brand_id", "left").select("id", "name", "brand")
    return curation.duplicate_merges(p)


@query("er_repoint_skus", """with recursive e as (select id, json_extract_string(record, '$.redirects_to') t from gold where entity_type = 'product_redirect'), w as (select id, t, 1 h from e union all select w.id, e.t, h + 1 from w join e on w.t = e.id where h < 8),
  r as (select id, case when max(h) < 8 then max_by(t, h) end t from w group by 1), s as (select id, json_extract_string(record, '$.product_id') product_id from gold where entity_type = 'sku') select s.id, coalesce(r.t, product_id) product_id from s left join r on s.product_id = r.id""")
def er_repoint_skus(spark, d):
    r = identity.flatten_redirects(entities(spark, d, "product_redirect").select("id", F.get_json_object("record", "$.redirects_to").alias("target")))
    s = entities(spark, d, "sku").select("id", F.get_json_object("record", "$.product_id").alias("product_id"))
    return curation.repoint(s, "product_id", r).select("id", "product_id")


@query("er_fact_reasons", "with g as (select json_extract_string(props, '$.k')::int k, count(distinct user_id) a, max(value) - min(value) s, avg(value) m from events where value is not null group by 1) select k, case when a < 2 then 'one account' when s > 0.2 then 'accounts disagree' when not m between 0 and 95 then 'implausible' end reason from g")
def er_fact_reasons(spark, d):
    g = table(spark, d, "events").where("value is not null").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count_distinct("user_id").alias("a"), (F.max("value") - F.min("value")).alias("s"), F.avg("value").alias("m"))
    return g.select("k", curation.hold_reason(F.col("a"), F.col("s"), F.col("m")).alias("reason"))


_AGREED = """with g as (select lower(fanciful_name) key, sum(round(abv * 1000000)::bigint) s, count(*) n, count(distinct permit_no) sources from ttb_cola_sample where fanciful_name is not null and abv between 0.1 and 95 group by 1 having max(abv) - min(abv) <= 0.5)
  select key, ((2 * s + 100000 * n) // (200000 * n))::double / 10 as value, sources from g"""


@query("er_open_data_values", _AGREED)
@query("er_open_data_fill", _AGREED)
def er_open_data_fill(spark, d):
    f = table(spark, d, "ttb_cola_sample").where(F.col("abv").between(0.1, 95) & ~F.isnan("abv"))
    return curation.agreed_values(f.select(F.lower("fanciful_name").alias("key"), F.col("abv").alias("value"), F.col("permit_no").alias("source")), 0.5)


@query("er_maker_core", "select distinct permittee, trim(regexp_replace(regexp_replace(lower(permittee), '^the ', ''), '( (brewing|brewery|distillers|distilling|cellars|winery|company|co|inc|llc|ltd)[.,]*)+$', '')) core from ttb_cola_sample where permittee is not null")
def er_maker_core(spark, d):
    return table(spark, d, "ttb_cola_sample").where("permittee is not null").select("permittee", curation.maker_core(F.col("permittee")).alias("core")).distinct()


@query("enr_recipe_axes", "select id, axis, round(least(sum(w), 1), 6)::double x from (select row_id id, i.role r from (select row_id, unnest(product.ingredients) i from demo_products)) join (values " + ", ".join(f"('{r}', '{curation.ROLE_AXIS[r]}', {w})" for r, w in curation.ROLE_WEIGHT.items()) + ") v(r, axis, w) using (r) group by 1, 2")
def enr_recipe_axes(spark, d):
    i = table(spark, d, "demo_products").select(F.col("row_id").alias("id"), F.explode("product.ingredients").alias("i")).select("id", "i.role")
    return curation.recipe_axes(i)


@query("enr_missing_styles", f"select p.id, m.style from ({PRODUCTS}) p join (select category, min(style) style from (select *, row_number() over (partition by category order by n desc, style) k from (select category, style, count(*) n from ({PRODUCTS}) where style is not null group by 1, 2)) where k = 1 group by 1) m using (category) where p.style is null")
def enr_missing_styles(spark, d):
    p = products(spark, d)
    n = p.where("style is not null").groupBy("category", "style").count()
    m = n.groupBy("category").agg(F.min(F.struct((-F.col("count")).alias("c"), "style")).alias("m")).select("category", F.col("m.style").alias("style"))
    return p.where("style is null").select("id", "category").join(F.broadcast(m), "category").select("id", "style")


_COS = "list_dot_product({0}, {1}) / sqrt(list_dot_product({0}, {0}) * list_dot_product({1}, {1}))"


@query("rank_similar", f"with e as (select vec_id, label, embedding::double[] v from embeddings), q as (select v from e order by vec_id limit 1), s as (select vec_id, label, round({_COS.format('e.v', 'q.v')}, 9) c from e, q where vec_id <> (select min(vec_id) from e)), r as (select *, row_number() over (partition by label order by c desc, vec_id) k from s) select vec_id from r where k = 1 order by c desc, vec_id limit 6")
def rank_similar(spark, d):
    e = table(spark, d, "embeddings")
    first = lambda c: e.orderBy("vec_id").limit(1).select(c).scalar()
    s = e.withColumn("q", first("embedding")).where(F.col("vec_id") != first("vec_id")).select("vec_id", "label", F.round(V.cosine(F.col("embedding"), F.col("q")), 9).alias("c"))
    return curation.one_per_maker(s, "label", [F.desc("c"), F.col("vec_id")], 6).select("vec_id")


@query("geo_box_overlap", "with b as (select s_suppkey k, s_nationkey n, s_suppkey % 17 x, s_suppkey % 13 y from supplier) select a.k a, b.k b, round(i / (200 - i), 6)::double iou from (select a.k, b.k, a.k ak, b.k bk, greatest(0, least(a.x, b.x) + 10 - greatest(a.x, b.x)) * greatest(0, least(a.y, b.y) + 10 - greatest(a.y, b.y)) i from b a join b on a.n = b.n and a.k < b.k) z(a0, b0, ak, bk, i) join b a on a.k = ak join b b on b.k = bk where i > 0")
def geo_box_overlap(spark, d):
    box = F.struct((F.col("s_suppkey") % 17).cast("double").alias("x"), (F.col("s_suppkey") % 13).cast("double").alias("y"), F.lit(10.0).alias("w"), F.lit(10.0).alias("h"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").alias("n"), box.alias("ba"))
    pairs = b.join(b.select(F.col("a").alias("b"), "n", F.col("ba").alias("bb")), "n").where("a < b")
    return pairs.select("a", "b", F.round(curation.box_overlap(F.col("ba"), F.col("bb")), 6).alias("iou")).where("iou > 0")


@query("fn_taste_sentence", "with s as (select id, list_slice(sensory, 1, 4) v from gold where entity_type = 'product' and sensory is not null and len(list_filter(sensory, lambda x: x is null)) = 0), r as (select id, list_transform(list_reverse_sort(list_transform(range(1, 5), lambda i: [v[i], -i])), lambda p: ['sweet', 'bitter', 'sour', 'salty'][(-p[2])::int]) o from s) select id, 'Mostly ' || o[1] || ', with some ' || o[2] || '.' sentence from r")
def fn_taste_sentence(spark, d):
    s = entities(spark, d, "product").where(F.col("sensory").isNotNull() & ~F.exists("sensory", lambda x: x.isNull()))
    return s.select("id", curation.taste_sentence(F.slice("sensory", 1, 4), ["sweet", "bitter", "sour", "salty"]).alias("sentence"))


@query("fn_profile_prompt", f"select id, concat_ws(chr(10), name, category, style) prompt from ({PRODUCTS})")
def fn_profile_prompt(spark, d):
    return products(spark, d).select("id", F.concat_ws("\n", "name", "category", "style").alias("prompt"))


@query("str_text_clusters", """with recursive b as (select o_custkey f, o_orderkey pos, o_totalprice % 1 x, (o_orderkey % 97) / 100.0::double y from orders),
  e as (select a.f, a.pos u, b.pos v from b a join b on a.f = b.f and a.pos <> b.pos where (least(a.x + 0.3::double, b.x + 0.3::double) - greatest(a.x, b.x)) / 0.3::double >= 0.3::double and greatest(0, greatest(a.y, b.y) - least(a.y + 0.02::double, b.y + 0.02::double)) <= 0.04::double),
  r as (select f, pos u, pos v from b union select r.f, r.u, e.v from r join e on r.f = e.f and r.v = e.u) select f frame_id, u pos, min(v) as cluster from r group by 1, 2""")
def str_text_clusters(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("frame_id"), F.col("o_orderkey").alias("pos"), (F.col("o_totalprice") % 1).alias("x"), ((F.col("o_orderkey") % 97) / 100.0).alias("y"), F.lit(0.3).alias("w"), F.lit(0.02).alias("h"))
    return curation.text_clusters(o)


@query("prf_touched_users", "select user_id, k, w from (select user_id, json_extract_string(props, '$.k')::int k, case when max_by(event_type, event_id) = 'purchase' then 1.0 else -1.0 end::double w from events where event_type in ('purchase', 'error') group by 1, 2) where user_id in (select user_id from events where ts >= timestamp '2024-01-29')")
def prf_touched_users(spark, d):
    e = table(spark, d, "events")
    return taste.signals(e.join(e.where("ts >= timestamp '2024-01-29'").select("user_id").distinct(), "user_id", "left_semi"))


@query("ret_style_catalog", f"select distinct category, style from ({PRODUCTS}) where style is not null")
def ret_style_catalog(spark, d):
    return products(spark, d).where("style is not null").select("category", "style").distinct()
