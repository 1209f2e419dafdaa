"""Filters, joins, aggregates, windows, sets and top-k of the catalogue, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellarium.functions import text as T
from cellarium.functions import vectors as V
from cellarium.operators import curation, filters, identity
from cellarium.plans.registry import query
from cellarium.session import table

# SQL of the product view that several queries start from.
PRODUCTS = """select id, name, sensory, updated_at, json_extract_string(record, '$.brand_id') brand_id, json_extract_string(record, '$.producer_id') producer_id,
  json_extract_string(record, '$.category') category, json_extract_string(record, '$.style.value') style, json_extract_string(record, '$.sensory.source') src,
  json_extract_string(record, '$.spec.abv_pct.value')::double abv from gold where entity_type = 'product'"""


def products(spark: SparkSession, d: str) -> DataFrame:
    j = lambda path: F.get_json_object("record", path)
    g = table(spark, d, "gold").where("entity_type = 'product'")
    return g.select("id", "name", "sensory", "updated_at", j("$.brand_id").alias("brand_id"), j("$.producer_id").alias("producer_id"), j("$.category").alias("category"), j("$.style.value").alias("style"), j("$.sensory.source").alias("src"), j("$.spec.abv_pct.value").cast("double").alias("abv"))


def entities(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return table(spark, d, "gold").where(F.col("entity_type") == kind)


# ---- filters and projections

@query("prj_json_paths", f"select id, brand_id, producer_id, category, style, abv from ({PRODUCTS})")
def prj_json_paths(spark, d):
    return products(spark, d).select("id", "brand_id", "producer_id", "category", "style", "abv")


@query("flt_known", f"select id, src from ({PRODUCTS}) where sensory is not null and len(list_filter(sensory, lambda x: x <> 0)) > 0 and src is not null and src <> 'style_prior'")
def flt_known(spark, d):
    return products(spark, d).where(V.usable(F.col("sensory")) & (F.col("src") != "style_prior")).select("id", "src")


@query("flt_membership", f"select id, style from ({PRODUCTS}) where lower(style) in ('kolsch', 'milk stout', 'dry riesling')")
def flt_membership(spark, d):
    return products(spark, d).where(F.lower("style").isin("kolsch", "milk stout", "dry riesling")).select("id", "style")


@query("flt_exact_name", "select p_partkey, p_name from part where p_name = (select min(p_name) from part)")
def flt_exact_name(spark, d):
    p = table(spark, d, "part")
    return p.join(F.broadcast(p.agg(F.min("p_name").alias("p_name"))), "p_name").select("p_partkey", "p_name")


@query("flt_identity_text", "select row_id from ttb_cola_sample where regexp_matches(fanciful_name, '[A-Za-z].*[A-Za-z].*[A-Za-z]') or regexp_matches(fanciful_name, '^[0-9]{4,}$')")
def flt_identity_text(spark, d):
    n = F.col("fanciful_name")
    return table(spark, d, "ttb_cola_sample").where(n.rlike("(?s)[A-Za-z][^\n]*[A-Za-z][^\n]*[A-Za-z]") | n.rlike("^[0-9]{4,}$")).select("row_id")


@query("flt_worth_matching", "select row_id from (select row_id, list_filter(string_split_regex(lower(fanciful_name), '[^a-z]+'), lambda w: length(w) >= 4) w from ttb_cola_sample) where len(w) = 0 or len(list_filter(w, lambda x: x not in ('brewed', 'bottled', 'contents', 'batch', 'vintage', 'year', 'none'))) > 0")
def flt_worth_matching(spark, d):
    w = F.filter(F.split(F.lower("fanciful_name"), "[^a-z]+"), lambda x: F.length(x) >= 4)
    packaging = ["brewed", "bottled", "contents", "batch", "vintage", "year", "none"]
    return table(spark, d, "ttb_cola_sample").select("row_id", w.alias("w")).where((F.size("w") == 0) | F.exists("w", lambda x: ~x.isin(packaging))).where("w is not null").select("row_id")


@query("flt_placeholder_names", "select row_id from ttb_cola_sample where fanciful_name is null or regexp_replace(lower(fanciful_name), '[^a-z0-9]+', '', 'g') in ('', 'na', 'none')")
def flt_placeholder_names(spark, d):
    bare = F.regexp_replace(F.lower("fanciful_name"), "[^a-z0-9]+", "")
    return table(spark, d, "ttb_cola_sample").where(F.col("fanciful_name").isNull() | bare.isin("", "na", "none")).select("row_id")


@query("flt_degenerate_brand", "select distinct brand_name from ttb_cola_sample where length(regexp_replace(lower(brand_name), '[^a-z0-9]+', '', 'g')) >= 3 and lower(brand_name) not in ('llc', 'inc', 'company')")
def flt_degenerate_brand(spark, d):
    b = F.col("brand_name")
    return table(spark, d, "ttb_cola_sample").where((F.length(F.regexp_replace(F.lower(b), "[^a-z0-9]+", "")) >= 3) & ~F.lower(b).isin("llc", "inc", "company")).select("brand_name").distinct()


@query("flt_permit_kind", """select row_id, split_part(p, '-', 2) kind, split_part(p, '-', 2) = 'i' or regexp_matches(p, '^i-[0-9]') importer from (select row_id, lower(regexp_replace(permit_no, '[^A-Za-z0-9]+', '-', 'g')) p from ttb_cola_sample where permit_no is not null)""")
def flt_permit_kind(spark, d):
    p = F.lower(F.regexp_replace("permit_no", "[^A-Za-z0-9]+", "-"))
    f = table(spark, d, "ttb_cola_sample").where("permit_no is not null").select("row_id", p.alias("p"))
    return f.select("row_id", F.split_part("p", F.lit("-"), F.lit(2)).alias("kind"), filters.importer_permit(F.col("p")).alias("importer"))


@query("flt_plausible_abv", """select row_id, product.abv abv from demo_products where case when regexp_matches(coalesce(lower(product.name), ''), '0,0|0\\.0|alcohol free|alcohol-free|alkoholfrei|sans alcool|non alcoholic|non-alcoholic|sin alcohol|analcolico|0 %|0%|alkoholfri|cero|tostada 0') then product.abv between 0 and 1.2
    when product.category = 'beer' then product.abv between 0.5 and 30 when product.category = 'cider' then product.abv between 1 and 15 when product.category = 'wine' then product.abv between 4 and 24 when product.category = 'sake' then product.abv between 4 and 25
    when product.category = 'mead' then product.abv between 3 and 25 when product.category = 'rtd' then product.abv between 1 and 25 when product.category = 'spirit' then product.abv between 10 and 96 else product.abv between 0.3 and 96 end and not isnan(product.abv)""")
def flt_plausible_abv(spark, d):
    p = table(spark, d, "demo_products").select("row_id", F.col("product.abv").alias("abv"), F.col("product.category").alias("c"), F.col("product.name").alias("n"))
    return p.where(filters.plausible_strength(F.col("abv"), F.col("c"), F.col("n"))).select("row_id", "abv")


@query("flt_replaceable_fact", """select id, case when v is null then 'empty' else m end was from (select id, json_extract_string(record, '$.spec.abv_pct.value') v, json_extract_string(record, '$.spec.abv_pct.provenance.method') m from gold where entity_type = 'product')
  where v is null or m in ('llm_inferred_from_style_prior', 'llm_recalled', 'community_clone', 'review_consensus')""")
def flt_replaceable_fact(spark, d):
    j = lambda c: F.get_json_object("record", f"$.spec.abv_pct.{c}")
    return entities(spark, d, "product").select("id", filters.replaceable_by_drinkers(j("value"), j("provenance.method")).alias("was")).where("was is not null")


@query("flt_consent", "select event_id, user_id from events where event_type in ('purchase', 'view') and json_extract_string(props, '$.k') is not null")
def flt_consent(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("purchase", "view") & F.get_json_object("props", "$.k").isNotNull()).select("event_id", "user_id")


@query("flt_intent", "select row_id from demo_products where (product.abv is null or product.abv <= 6) and lower(product.style) like '%ale%'")
def flt_intent(spark, d):
    return table(spark, d, "demo_products").where((F.col("product.abv").isNull() | (F.col("product.abv") <= 6)) & F.lower("product.style").contains("ale")).select("row_id")


@query("flt_live_rows", "select id from gold where entity_type = 'product' and id not in (select id from gold where entity_type = 'product_redirect')")
def flt_live_rows(spark, d):
    return entities(spark, d, "product").join(entities(spark, d, "product_redirect").select("id"), "id", "left_anti").select("id")


@query("flt_record_like", "select id from gold where entity_type = 'producer' and lower(record) like '%brewing%'")
def flt_record_like(spark, d):
    return entities(spark, d, "producer").where(F.lower("record").like("%brewing%")).select("id")


# ---- joins

@query("join_hydrate", f"""select p.id, coalesce(b.name, 'Unknown') brand, coalesce(m.name, 'Unknown') maker from ({PRODUCTS}) p
  left join (select id, name from gold where entity_type = 'brand') b on p.brand_id = b.id left join (select id, name from gold where entity_type = 'producer') m on p.producer_id = m.id""")
def join_hydrate(spark, d):
    b = entities(spark, d, "brand").select(F.col("id").alias("brand_id"), F.col("name").alias("bn"))
    m = entities(spark, d, "producer").select(F.col("id").alias("producer_id"), F.col("name").alias("mn"))
    j = products(spark, d).select("id", "brand_id", "producer_id").join(b, "brand_id", "left").join(m, "producer_id", "left")
    return j.select("id", F.coalesce("bn", F.lit("Unknown")).alias("brand"), F.coalesce("mn", F.lit("Unknown")).alias("maker"))


@query("join_barcode", """with v as (select row_id, unnest([u, case when length(u) = 13 and u[1] = '0' then u[2:] end, case when length(u) = 12 then '0' || u end]) u from
   (select row_id, regexp_replace(upc, '[^0-9]', '', 'g') u from ttb_cola_sample where upc is not null)),
  s as (select json_extract_string(record, '$.product_id') product_id, regexp_replace(json_extract_string(record, '$.upc'), '[^0-9]', '', 'g') u from gold where entity_type = 'sku')
  select distinct row_id, product_id from v join s using (u) where u <> ''""")
def join_barcode(spark, d):
    v = table(spark, d, "ttb_cola_sample").where("upc is not null").select("row_id", F.explode(T.upc_variants(F.col("upc"))).alias("u"))
    s = entities(spark, d, "sku").select(F.get_json_object("record", "$.product_id").alias("product_id"), F.regexp_replace(F.get_json_object("record", "$.upc"), "[^0-9]", "").alias("u"))
    return v.join(s, "u").select("row_id", "product_id").distinct()


@query("join_posting_intersection", """with t as (select distinct row_id, unnest(string_split_regex(lower(brand_name || ' ' || coalesce(fanciful_name, '')), '[^a-z]+')) w from ttb_cola_sample),
  q as (select unnest(['rusty', 'harbor']) w) select row_id from t join q using (w) group by row_id having count(*) = 2""")
def join_posting_intersection(spark, d):
    words = F.split(F.lower(F.concat(F.col("brand_name"), F.lit(" "), F.coalesce("fanciful_name", F.lit("")))), "[^a-z]+")
    t = table(spark, d, "ttb_cola_sample").select("row_id", F.explode(F.array_distinct(words)).alias("w"))
    q = F.broadcast(spark.createDataFrame([("rusty",), ("harbor",)], "w string"))
    return t.join(q, "w").groupBy("row_id").count().where("count = 2").select("row_id")


@query("join_subset_tokens", """with b as (select distinct id, list_distinct(list_filter(string_split(lower(name), ' '), lambda w: w <> '')) t from gold where entity_type = 'brand' and name is not null),
  p as (select id, list_distinct(list_filter(string_split(lower(name), ' '), lambda w: w <> '')) t from gold where entity_type = 'product' and name is not null), x as (select id, unnest(t) w, len(t) n from b), y as (select id, unnest(t) w from p)
  select y.id product_id, x.id brand_id from x join y using (w) group by 1, 2, n having count(*) = n""")
def join_subset_tokens(spark, d):
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), " "), lambda w: w != ""))
    b = entities(spark, d, "brand").where("name is not null").select(F.col("id").alias("brand_id"), words("name").alias("bt")).distinct()
    p = entities(spark, d, "product").where("name is not null").select(F.col("id").alias("product_id"), words("name").alias("pt"))
    # A name that holds all words of a brand holds its rarest, so only that one is joined on.
    rarest = identity.rarest_word(b, "brand_id", "bt")
    met = p.select("product_id", "pt", F.explode("pt").alias("word")).join(rarest, "word")
    return met.where(F.size(F.array_except("bt", "pt")) == 0).select("product_id", "brand_id")


@query("join_semi_in", "select l_orderkey, l_linenumber from lineitem where l_partkey in (select p_partkey from part where p_size > 45)")
def join_semi_in(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "part").where("p_size > 45").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("join_anti_not_exists", "select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey)")
def join_anti_not_exists(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("join_left_using", "select s_suppkey, n_name, r_name from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def join_left_using(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", "n_name", "r_name")


@query("join_correlated_update", "select p.id, coalesce((select max(json_extract_string(s.record, '$.upc')) from gold s where s.entity_type = 'sku' and json_extract_string(s.record, '$.product_id') = p.id), 'none') upc from gold p where p.entity_type = 'product'")
def join_correlated_update(spark, d):
    s = entities(spark, d, "sku").groupBy(F.get_json_object("record", "$.product_id").alias("id")).agg(F.max(F.get_json_object("record", "$.upc")).alias("u"))
    return entities(spark, d, "product").select("id").join(s, "id", "left").select("id", F.coalesce("u", F.lit("none")).alias("upc"))


@query("join_silver_bronze", "select b.id, b.fetched_at, g.id gold_id from bronze b join gold g on g.entity_type = 'product' and split_part(g.id, ':', 2) = b.natural_key")
def join_silver_bronze(spark, d):
    g = entities(spark, d, "product").select(F.col("id").alias("gold_id"), F.split_part("id", F.lit(":"), F.lit(2)).alias("natural_key"))
    return table(spark, d, "bronze").join(g, "natural_key").select("id", "fetched_at", "gold_id")


@query("join_location_unique", """with k as (select lower(regexp_extract(name, '^[^ ]+', 0)) k, min(id) id, min(lat) lat from gold where entity_type = 'producer' and name is not null and lat is not null group by 1 having count(*) = 1),
  f as (select distinct permittee from ttb_cola_sample where permittee is not null) select permittee, k.id producer_id, round(lat, 4) lat from f join k on lower(regexp_extract(permittee, '^[^ ]+', 0)) = k""")
def join_location_unique(spark, d):
    first = lambda c: F.lower(F.regexp_extract(c, "^[^ ]+", 0))
    k = entities(spark, d, "producer").where("name is not null and lat is not null").groupBy(first("name").alias("k")).agg(F.min("id").alias("producer_id"), F.min("lat").alias("lat"), F.count("*").alias("n")).where("n = 1")
    f = table(spark, d, "ttb_cola_sample").where("permittee is not null").select("permittee").distinct()
    return f.withColumn("k", first("permittee")).join(k, "k").select("permittee", "producer_id", F.round("lat", 4).alias("lat"))


PATTERNS = [(1, "imperial|strong"), (2, "stout|porter"), (3, "ale"), (4, "wine|sake"), (5, "cider|mead")]


@query("join_pattern_first", "select s.style, min_by(p, o) pattern from (select distinct product.style style from demo_products where product.style is not null) s join (values " + ", ".join(f"({o}, '{p}')" for o, p in PATTERNS) + ") v(o, p) on regexp_matches(lower(s.style), p) group by 1")
def join_pattern_first(spark, d):
    pick = F.coalesce(*[F.when(F.lower("style").rlike(p), F.lit(p)) for _, p in PATTERNS])
    return table(spark, d, "demo_products").select(F.col("product.style").alias("style")).where("style is not null").distinct().withColumn("pattern", pick).where("pattern is not null")


@query("join_id_list", "select id, name from gold where id in (select id_a from match_pairs where matcher = 'barcode')")
def join_id_list(spark, d):
    ids = table(spark, d, "match_pairs").where("matcher = 'barcode'").select(F.col("id_a").alias("id"))
    return table(spark, d, "gold").join(ids, "id", "left_semi").select("id", "name")


@query("join_replay_diff", "select coalesce(a.k, b.k) k, a.k is null gained, b.k is null lost from (select distinct json_extract_string(props, '$.k')::int k from events where ts < timestamp '2024-01-15') a full join (select distinct json_extract_string(props, '$.k')::int k from events where ts >= timestamp '2024-01-15') b using (k) where a.k is null or b.k is null")
def join_replay_diff(spark, d):
    e = table(spark, d, "events").select("ts", F.get_json_object("props", "$.k").cast("int").alias("k"))
    a = e.where("ts < timestamp '2024-01-15'").select("k").distinct().withColumn("a", F.lit(True))
    b = e.where("ts >= timestamp '2024-01-15'").select("k").distinct().withColumn("b", F.lit(True))
    return a.join(b, "k", "full").select("k", F.col("a").isNull().alias("gained"), F.col("b").isNull().alias("lost")).where("gained or lost")


# ---- aggregates

@query("agg_vector_groups", f"select count(*) members, max(id) last_id, list_sort(list(id))[1:16] ids from ({PRODUCTS}) where sensory is not null and src <> 'style_prior' group by sensory")
def agg_vector_groups(spark, d):
    known = products(spark, d).where("sensory is not null and src <> 'style_prior'")
    few = known.withColumn("rank", F.row_number().over(Window.partitionBy("sensory").orderBy("id"))).where("rank <= 16").groupBy("sensory").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return known.groupBy("sensory").agg(F.count("*").alias("members"), F.max("id").alias("last_id")).join(few, "sensory").select("members", "last_id", "ids")


@query("agg_permit_tally", "select permit_no, lower(brand_name) brand, count(*) n, count(distinct ttb_id) filter (where abv > 0 and not isnan(abv)) stated, bool_or(upc is not null) coded from ttb_cola_sample where permit_no is not null group by 1, 2")
def agg_permit_tally(spark, d):
    f = table(spark, d, "ttb_cola_sample").where("permit_no is not null")
    return f.groupBy("permit_no", F.lower("brand_name").alias("brand")).agg(F.count("*").alias("n"), F.count_distinct(F.when((F.col("abv") > 0) & ~F.isnan("abv"), F.col("ttb_id"))).alias("stated"), F.bool_or(F.col("upc").isNotNull()).alias("coded"))


@query("agg_mode", "select permit_no, brand_name from (select permit_no, brand_name, row_number() over (partition by permit_no order by count(*) desc, brand_name) k from ttb_cola_sample where permit_no is not null and brand_name is not null group by 1, 2) where k = 1")
def agg_mode(spark, d):
    n = table(spark, d, "ttb_cola_sample").where("permit_no is not null and brand_name is not null").groupBy("permit_no", "brand_name").count()
    return n.groupBy("permit_no").agg(F.min(F.struct((-F.col("count")).alias("c"), "brand_name")).alias("m")).select("permit_no", F.col("m.brand_name").alias("brand_name"))


@query("agg_share_gate", "with c as (select permit_no, origin_desc, count(*) n from ttb_cola_sample where permit_no is not null and origin_desc is not null group by 1, 2), s as (select *, n / sum(n) over (partition by permit_no) share from c) select permit_no, min(origin_desc) origin from s where share >= 0.8 group by 1")
def agg_share_gate(spark, d):
    c = table(spark, d, "ttb_cola_sample").where("permit_no is not null and origin_desc is not null").groupBy("permit_no", "origin_desc").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("permit_no"))
    return c.withColumn("share", F.col("n") / total).where("share >= 0.8").groupBy("permit_no").agg(F.min("origin_desc").alias("origin"))


@query("agg_having_unique", "select lower(brand_name) brand, min(permit_no) permit from ttb_cola_sample where brand_name is not null and permit_no is not null group by 1 having count(distinct permit_no) = 1")
def agg_having_unique(spark, d):
    g = table(spark, d, "ttb_cola_sample").where("brand_name is not null and permit_no is not null").groupBy(F.lower("brand_name").alias("brand"))
    return g.agg(F.min("permit_no").alias("permit"), F.max("permit_no").alias("most")).where("permit = most").select("brand", "permit")


@query("agg_distinct_on", "select ttb_id, max(fetched_at) fetched_at, max(row_id) row_id from (select *, rank() over (partition by ttb_id order by fetched_at desc, row_id desc) k from ttb_cola_sample) where k = 1 group by 1")
def agg_distinct_on(spark, d):
    return table(spark, d, "ttb_cola_sample").groupBy("ttb_id").agg(F.max(F.struct("fetched_at", "row_id")).alias("m")).select("ttb_id", "m.fetched_at", "m.row_id")


@query("agg_document_frequency", "select w, count(*) df, round(ln(1 + (select count(*) from demo_products) / count(*)), 9) idf from (select distinct row_id, unnest(string_split_regex(lower(product.name), '[^a-z]+')) w from demo_products where product.name is not null) where length(w) >= 2 group by 1")
def agg_document_frequency(spark, d):
    p = table(spark, d, "demo_products")
    w = p.select("row_id", F.explode(F.array_distinct(F.split(F.lower("product.name"), "[^a-z]+"))).alias("w")).where("length(w) >= 2")
    total = p.agg(F.count("*")).scalar()
    return w.groupBy("w").agg(F.count("*").alias("df")).select("w", "df", F.round(F.log1p(total / F.col("df")), 9).alias("idf"))


@query("agg_lexicon", "select w, count(*) n from (select unnest(string_split_regex(lower(name), '[^a-z]+')) w from gold where entity_type in ('product', 'producer') and name is not null) where length(w) >= 3 group by 1 order by n desc, w limit 200")
def agg_lexicon(spark, d):
    w = table(spark, d, "gold").where("entity_type in ('product', 'producer') and name is not null").select(F.explode(F.split(F.lower("name"), "[^a-z]+")).alias("w")).where("length(w) >= 3")
    return w.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(200)


@query("agg_conditional_counts", "select category, count(*) n, count(*) filter (where abv is null) no_abv, count(*) filter (where style is null) no_style from (" + PRODUCTS + ") group by 1")
def agg_conditional_counts(spark, d):
    return products(spark, d).groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("abv").isNull()).alias("no_abv"), F.count_if(F.col("style").isNull()).alias("no_style"))


@query("agg_category_vote", "with c as (select permit_no, class_type, count(*) n from ttb_cola_sample where permit_no is not null and class_type is not null group by 1, 2), t as (select permit_no, max(n) m from c group by 1) select permit_no, case when count(*) = 1 then min(class_type) end class_type from c join t using (permit_no) where n = m group by 1")
def agg_category_vote(spark, d):
    c = table(spark, d, "ttb_cola_sample").where("permit_no is not null and class_type is not null").groupBy("permit_no", "class_type").agg(F.count("*").alias("n"))
    top = c.withColumn("m", F.max("n").over(Window.partitionBy("permit_no"))).where("n = m")
    return top.groupBy("permit_no").agg(F.when(F.count("*") == 1, F.min("class_type")).alias("class_type"))


@query("agg_agreement", """with l as (select lower(fanciful_name) k, permit_no, arg_max(abv, row(fetched_at, row_id)) v from ttb_cola_sample where fanciful_name is not null and permit_no is not null and abv > 0 and abv <= 95 group by 1, 2),
  g as (select k, count(*) accounts, sum(round(v * 1000000)::bigint) s, max(v) - min(v) r from l group by 1) select k, accounts, ((2 * s + 100000 * accounts) // (200000 * accounts))::double / 10 v from g where accounts >= 2 and r <= 0.2""")
def agg_agreement(spark, d):
    f = table(spark, d, "ttb_cola_sample").where("fanciful_name is not null and permit_no is not null and abv > 0 and abv <= 95")
    latest = f.groupBy(F.lower("fanciful_name").alias("key"), F.col("permit_no").alias("source")).agg(F.max_by("abv", F.struct("fetched_at", "row_id")).alias("value"))
    return curation.agreed_values(latest, 0.2).where("sources >= 2").select(F.col("key").alias("k"), F.col("sources").alias("accounts"), F.col("value").alias("v"))


@query("agg_best_spelling", """with n as (select brand_name, count(distinct permit_no) a, len(list_filter(string_split_regex(trim(brand_name), '\\s+'), lambda w: length(w) >= 4)) w from ttb_cola_sample where brand_name is not null group by 1)
  select lower(brand_name) brand, arg_min(brand_name, row(-a, -w, -length(brand_name), brand_name)) spelling from n group by 1""")
def agg_best_spelling(spark, d):
    f = table(spark, d, "ttb_cola_sample").select(F.lower("brand_name").alias("brand"), F.col("brand_name").alias("name"), F.col("permit_no").alias("account"))
    return curation.best_spelling(f, "brand").select("brand", F.col("name").alias("spelling"))


@query("agg_freshness", "select max(updated_at) stamp, count(*) n from gold")
def agg_freshness(spark, d):
    return table(spark, d, "gold").agg(F.max("updated_at").alias("stamp"), F.count("*").alias("n"))


@query("agg_latency", "select event_type, round(median(value), 6) p50, max(value) worst from events group by 1")
def agg_latency(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.max("value").alias("worst"))


@query("agg_poisoned_keys", "select lower(name) k from gold where entity_type = 'brand' and name is not null group by 1 having count(*) > 1")
def agg_poisoned_keys(spark, d):
    return entities(spark, d, "brand").where("name is not null").groupBy(F.lower("name").alias("k")).count().where("count > 1").select("k")


@query("agg_ambiguous_styles", "select product.style style from demo_products where product.style is not null group by 1 having count(distinct coalesce(product.category, '-')) = 1")
def agg_ambiguous_styles(spark, d):
    s = table(spark, d, "demo_products").select(F.col("product.style").alias("style"), F.coalesce("product.category", F.lit("-")).alias("c")).where("style is not null")
    return s.groupBy("style").agg(F.count_distinct("c").alias("n")).where("n = 1").select("style")


@query("agg_registry_tally", "select trust_tier, count(*) sources, count(distinct source_kind) kinds from source_registry group by 1")
def agg_registry_tally(spark, d):
    return table(spark, d, "source_registry").groupBy("trust_tier").agg(F.count("*").alias("sources"), F.count_distinct("source_kind").alias("kinds"))


# ---- windows, sets, top-k

@query("win_ranked_brand", "select permit_no, brand_name, n, row_number() over (partition by permit_no order by n desc, brand_name) k from (select permit_no, brand_name, count(*) n from ttb_cola_sample where permit_no is not null and brand_name is not null group by 1, 2)")
def win_ranked_brand(spark, d):
    n = table(spark, d, "ttb_cola_sample").where("permit_no is not null and brand_name is not null").groupBy("permit_no", "brand_name").agg(F.count("*").alias("n"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy("permit_no").orderBy(F.desc("n"), "brand_name")))


@query("win_latest_by_arrival", "select user_id, event_type, max(event_id) event_id, max_by(value, event_id) v from events group by 1, 2")
def win_latest_by_arrival(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("v"))


@query("win_margin_runner_up", "select l_suppkey, l_partkey, round(q - nxt, 2) margin from (select *, row_number() over w k, lead(q) over w nxt from (select l_suppkey, l_partkey, sum(l_quantity) q from lineitem group by 1, 2) window w as (partition by l_suppkey order by q desc, l_partkey)) where k = 1 and nxt is not null")
def win_margin_runner_up(spark, d):
    q = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("q"), "l_partkey")
    return q.withColumn("k", F.row_number().over(w)).withColumn("nxt", F.lead("q").over(w)).where("k = 1 and nxt is not null").select("l_suppkey", "l_partkey", F.round(F.col("q") - F.col("nxt"), 2).alias("margin"))


@query("win_cap_per_group", "select p_partkey from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) k from part) where k <= 1 order by p_retailprice desc, p_partkey limit 6")
def win_cap_per_group(spark, d):
    k = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return table(spark, d, "part").withColumn("k", k).where("k <= 1").orderBy(F.desc("p_retailprice"), "p_partkey").limit(6).select("p_partkey")


@query("win_session_gap", "select user_id, count(*) sightings from (select user_id, ts, lag(ts) over (partition by user_id order by ts, event_id) p from events where event_type = 'view') where p is null or ts - p > interval 15 second group by 1")
def win_session_gap(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = table(spark, d, "events").where("event_type = 'view'").withColumn("p", F.lag("ts").over(w))
    return v.where("p is null or ts - p > interval 15 seconds").groupBy("user_id").agg(F.count("*").alias("sightings"))


@query("top_total_order", "select p_partkey, p_name from part order by p_retailprice desc, length(p_name), p_partkey limit 25")
def top_total_order(spark, d):
    return table(spark, d, "part").orderBy(F.desc("p_retailprice"), F.length("p_name"), "p_partkey").limit(25).select("p_partkey", "p_name")


@query("top_booleans_first", f"select id from ({PRODUCTS}) order by (sensory is not null) desc, (abv is not null) desc, name nulls last, id limit 40")
def top_booleans_first(spark, d):
    return products(spark, d).orderBy(F.desc(F.col("sensory").isNotNull()), F.desc(F.col("abv").isNotNull()), F.asc_nulls_last("name"), "id").limit(40).select("id")


@query("set_except", "select c_nationkey k from customer except select s_nationkey from supplier where s_acctbal > 5000")
def set_except(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).subtract(table(spark, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("set_union_first_wins", "select k, min_by(origin, rank) origin from (select n_name k, 'nation' origin, 1 rank from nation union all select r_name, 'region', 2 from region) group by 1")
def set_union_first_wins(spark, d):
    u = table(spark, d, "nation").select(F.col("n_name").alias("k"), F.lit("nation").alias("origin"), F.lit(1).alias("rank")).unionByName(table(spark, d, "region").select(F.col("r_name").alias("k"), F.lit("region").alias("origin"), F.lit(2).alias("rank")))
    return u.groupBy("k").agg(F.min_by("origin", "rank").alias("origin"))


@query("set_exclude_vector_group", f"select id from ({PRODUCTS}) p where sensory is not null and not exists (select 1 from ({PRODUCTS}) q where q.sensory = p.sensory and q.id in (select id_a from match_pairs where is_match))")
def set_exclude_vector_group(spark, d):
    p = products(spark, d).where("sensory is not null").select("id", "sensory")
    judged = p.join(table(spark, d, "match_pairs").where("is_match").select(F.col("id_a").alias("id")), "id", "left_semi").select("sensory").distinct()
    return p.join(judged, "sensory", "left_anti").select("id")
