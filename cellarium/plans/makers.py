"""Queries of makers, typed drinks, names as shown, and lists, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellarium.functions import text as T
from cellarium.operators import frames, identity, makers
from cellarium.plans.registry import query
from cellarium.plans.relational import PRODUCTS, entities, products
from cellarium.session import table
from cellarium.streaming import events

_ENDS = "'brewing','brewery','breweries','brewers','brewhouse','brewpub','brewer','distilling','distillery','distilleries','distillers','distiller','winery','wineries','vineyards','vineyard','cellars','cellar','company','co','corp','corporation','inc','incorporated','llc','lc','llp','lp','ltd','limited','plc','pllc','gmbh','bv','nv','srl','spa','ag','kg','oy','ab','holdings','group'"
_CORES = f"""w as (select id, name, json_extract_string(record, '$.region') region, string_split(regexp_replace(trim(regexp_replace(replace(replace(replace(lower(strip_accents(name)), '&', ' and '), chr(39), ''), '`', ''), '[^a-z0-9]+', ' ', 'g')), '^(the )+', ''), ' ') w from gold where entity_type = 'producer' and name is not null),
  c as (select *, list_transform(range(1, len(w) + 1), lambda i: case when w[i] in ({_ENDS}) then 0 else i end) n from w where w[1] <> ''),
  k as (select id, name, region, array_to_string(w[1:greatest(list_max(n), 1)], ' ') core, case when list_has_any(w, ['brewing','brewery','breweries','brewers','brewhouse','brewpub']) and not list_has_any(w, ['distilling','distillery','distilleries','distillers']) then 'brew'
    when list_has_any(w, ['distilling','distillery','distilleries','distillers']) and not list_has_any(w, ['brewing','brewery','breweries','brewers','brewhouse','brewpub']) then 'dist' else '' end trade from c)"""
_MERGES = """j as (select k.*, case when trade <> '' then trade when low is null then '' when low = high then low end of_ from k join (select core, min(nullif(trade, '')) low, max(nullif(trade, '')) high from k group by 1) using (core)),
  b as (select core, of_, arg_min(id, row(length(name), id)) canonical from j where of_ is not null group by 1, 2), mm as (select id alias, canonical from j join b using (core, of_) where id <> canonical)"""


def _makers(spark, d):
    return entities(spark, d, "producer").where("name is not null").select("id", "name", F.get_json_object("record", "$.region").alias("region"))


@query("er_maker_cores", f"with {_CORES} select id, core, trade from k")
def er_maker_cores(spark, d):
    return makers.maker_cores(_makers(spark, d)).select("id", "core", "trade")


@query("er_maker_merges", f"with {_CORES}, {_MERGES} select alias, canonical from mm")
def er_maker_merges(spark, d):
    return makers.maker_merges(makers.maker_cores(_makers(spark, d)))


@query("er_merged_makers", f"""with {_CORES}, {_MERGES}, t as (select k.*, coalesce(canonical, k.id) to_ from k left join mm on mm.alias = k.id), r as (select to_, region, count(*) n from t where region is not null group by 1, 2), m as (select to_, arg_min(region, row(-n, region)) region from r group by 1),
  s as (select to_, count(*) members from t group by 1) select t.id, t.name, m.region, s.members from t left join m on m.to_ = t.id join s on s.to_ = t.id where t.id = t.to_""")
def er_merged_makers(spark, d):
    m = _makers(spark, d)
    return makers.merge_makers(m, makers.maker_merges(makers.maker_cores(m)))


@query("er_importer_makers", """with f as (select row_id, lower(regexp_replace(permit_no, '[^A-Za-z0-9]+', '-', 'g')) p, trim(regexp_replace(lower(brand_name), '[^a-z0-9]+', ' ', 'g')) b from ttb_cola_sample where permit_no is not null and brand_name is not null),
  g as (select *, split_part(p, '-', 2) = 'i' or regexp_matches(p, '^i-[0-9]') imports from f where length(replace(b, ' ', '')) >= 3), e as (select b, min(p) p from g where not imports group by 1 having count(distinct p) = 1)
  select row_id, coalesce('permit:' || trim(regexp_replace(e.p, '[^a-z0-9]+', '-', 'g')[1:60], '-'), '') maker from g left join e using (b) where imports""")
def er_importer_makers(spark, d):
    return makers.importer_makers(table(spark, d, "ttb_cola_sample"))


@query("er_typed_names")
def er_typed_names(spark, d):
    b = entities(spark, d, "brand").select(F.col("id").alias("brand_id"), F.col("name").alias("brand"))
    p = products(spark, d).where("name is not null").join(b, "brand_id", "left").select("id", "name", "brand")
    typed = table(spark, d, "ttb_cola_sample").select(F.col("row_id").alias("q"), F.col("fanciful_name").alias("name"), F.col("brand_name").alias("maker"))
    return makers.match_typed_names(typed, p)


_STYLE = ", ".join(f"'{w}'" for w in sorted(identity.STYLE))


@query("txt_generic_names", f"""select id, len(w) > 0 and len(list_filter(w, lambda x: x not in ({_STYLE}))) = 0 generic, len(list_filter(w, lambda x: length(x) >= 4 and x not in ({_STYLE}))) = 0 anonymous from (select id, list_distinct(regexp_extract_all(lower(strip_accents(name)), '[a-z]{{2,}}')) w from gold where entity_type = 'product' and name is not null)""")
def txt_generic_names(spark, d):
    w = F.array_distinct(F.regexp_extract_all(T.unaccent(F.lower("name")), F.lit("([a-z]{2,})"), 1))
    p = entities(spark, d, "product").where("name is not null").select("id", w.alias("w"))
    return p.select("id", identity.is_generic(F.col("w")).alias("generic"), identity.is_anonymous(F.col("w")).alias("anonymous"))


@query("txt_identifying_tokens", f"select id, list_sort(list_distinct(list_filter(regexp_extract_all(replace(lower(strip_accents(name)), chr(39), ''), '[a-z]+|[0-9]+'), lambda x: (length(x) >= 3 and regexp_matches(x, '^[a-z]') and x not in ({_STYLE})) or regexp_matches(x, '^[0-9]{{4,}}$')))) tokens from gold where entity_type = 'product' and name is not null")
def txt_identifying_tokens(spark, d):
    return entities(spark, d, "product").where("name is not null").select("id", F.array_sort(identity.identifying_tokens(F.col("name"))).alias("tokens"))


@query("txt_shown_names", f"""with p as (select p.id, trim(p.name) n, trim(regexp_replace(b.name, '(?i)[ ,]+(llc|inc\\.?|ltd\\.?|co\\.?|corp\\.?|company)$', '')) b from ({PRODUCTS}) p left join (select id, name from gold where entity_type = 'brand') b on p.brand_id = b.id where p.name is not null)
  select id, case when b is null or b = '' then n when lower(n) = lower(b) then n when starts_with(lower(n), lower(b) || ' ') then trim(n[length(b) + 1:]) else n end as shown, coalesce(b, '') brand from p""")
def txt_shown_names(spark, d):
    b = entities(spark, d, "brand").select(F.col("id").alias("brand_id"), F.col("name").alias("b"))
    p = products(spark, d).where("name is not null").join(b, "brand_id", "left")
    brand = identity.without_legal_form(F.col("b"))
    return p.select("id", identity.shown_name(F.col("name"), brand).alias("shown"), F.coalesce(brand, F.lit("")).alias("brand"))


@query("ret_products_of", f"select producer_id, id, k from (select producer_id, id, row_number() over (partition by producer_id order by (sensory is not null) desc, (abv is not null) desc, coalesce(name, ''), id) k from ({PRODUCTS}) where producer_id is not null) where k <= 8")
def ret_products_of(spark, d):
    k = F.row_number().over(Window.partitionBy("producer_id").orderBy(F.desc(F.col("sensory").isNotNull()), F.desc(F.col("abv").isNotNull()), F.coalesce("name", F.lit("")), "id"))
    return products(spark, d).where("producer_id is not null").withColumn("k", k).where("k <= 8").select("producer_id", "id", "k")


@query("ret_match_producers")
def ret_match_producers(spark, d):
    lines = table(spark, d, "ttb_cola_sample").where("permittee is not null").select(F.col("permittee").alias("text")).distinct()
    names = entities(spark, d, "producer").where("name is not null").select("id", "name", F.col("name").alias("qualified"))
    return frames.line_hits(lines, names)


@query("set_shortlist", """with q as (select distinct lower(trim(fanciful_name)) n, lower(trim(brand_name)) m from ttb_cola_sample where fanciful_name is not null and brand_name is not null), p as (select id, lower(trim(name)) n from gold where entity_type = 'product' and name is not null),
  s as (select q.n, q.m, p.id from q join p on p.n = q.n union select q.n, q.m, p.id from q join p on p.n = q.m || ' ' || q.n) select n, m, count(*) hits, count(*) >= 250 capped from s group by 1, 2""")
def set_shortlist(spark, d):
    low = lambda c: F.lower(F.trim(c))
    q = table(spark, d, "ttb_cola_sample").where("fanciful_name is not null and brand_name is not null").select(low("fanciful_name").alias("n"), low("brand_name").alias("m")).distinct()
    p = entities(spark, d, "product").where("name is not null").select("id", low("name").alias("key"))
    asked = q.withColumn("key", F.explode(F.array(F.col("n"), F.concat_ws(" ", "m", "n"))))
    return asked.join(p, "key").select("n", "m", "id").distinct().groupBy("n", "m").agg(F.count("*").alias("hits"), (F.count("*") >= 250).alias("capped"))


@query("set_shelf_spellings", f"select category, list_sort(list_distinct(list_concat(s, l))) spellings from (select category, list(style) s from ({PRODUCTS}) where style is not null group by 1) join (select category, list(label) l from canon_list where list_name = 'style' group by 1) using (category)")
def set_shelf_spellings(spark, d):
    listed = table(spark, d, "canon_list").where("list_name = 'style'").groupBy("category").agg(F.collect_set("label").alias("l"))
    used = products(spark, d).where("style is not null").groupBy("category").agg(F.collect_set("style").alias("s"))
    return used.join(listed, "category").select("category", F.array_sort(F.array_union("s", "l")).alias("spellings"))


@query("join_market_check", "select p.id, coalesce(lower(m.region) = lower(p.region), false) agrees, p.region is null or m.region is null silent from (select id, json_extract_string(record, '$.region') region, split_part(id, ':', 3) k from gold where entity_type = 'producer') p left join (select split_part(id, ':', 3) k, min(json_extract_string(record, '$.region')) region from gold where entity_type = 'producer' group by 1) m using (k)")
def join_market_check(spark, d):
    p = entities(spark, d, "producer").select("id", F.get_json_object("record", "$.region").alias("region"), F.split_part("id", F.lit(":"), F.lit(3)).alias("k"))
    m = p.groupBy("k").agg(F.min("region").alias("market"))
    silent = F.col("region").isNull() | F.col("market").isNull()
    return p.join(m, "k", "left").select("id", F.coalesce(F.lower("region") == F.lower("market"), F.lit(False)).alias("agrees"), silent.alias("silent"))


@query("flt_repair_net", "select g.id, b.id bronze_id from gold g join bronze b on b.natural_key = split_part(g.id, ':', 2) where g.entity_type = 'product' and regexp_matches(g.name, '(?i)^[^a-z]*(none|untitled|unknown|unnamed|n/a|no name)[^a-z]*$|^[-–— ?.]+$')")
def flt_repair_net(spark, d):
    g = entities(spark, d, "product").where(F.col("name").rlike(r"(?i)^[^a-z]*(none|untitled|unknown|unnamed|n/a|no name)[^a-z]*$|^[-–— ?.]+$")).select("id", F.split_part("id", F.lit(":"), F.lit(2)).alias("natural_key"))
    return g.join(table(spark, d, "bronze").select("natural_key", F.col("id").alias("bronze_id")), "natural_key").select("id", "bronze_id")


@query("top_shown_lines", "select o_custkey, o_orderkey, k from (select *, row_number() over (partition by o_custkey order by round(o_totalprice % 1, 2) desc, o_orderpriority, o_orderkey) k from orders) where k <= 3")
def top_shown_lines(spark, d):
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc(F.round(F.col("o_totalprice") % 1, 2)), "o_orderpriority", "o_orderkey"))
    return table(spark, d, "orders").withColumn("k", k).where("k <= 3").select("o_custkey", "o_orderkey", "k")


@query("top_promotable", "select m, (y * 2 <= n and a >= 2) promotable, a accounts from (select lower(matcher) m, count(distinct id_a) a, count(*) n, count(*) filter (where is_match) y from match_pairs where matcher is not null group by 1) order by promotable desc, a desc, m limit 20")
def top_promotable(spark, d):
    g = table(spark, d, "match_pairs").where("matcher is not null").groupBy(F.lower("matcher").alias("m")).agg(F.count_distinct("id_a").alias("accounts"), F.count("*").alias("n"), F.count_if("is_match").alias("y"))
    return g.select("m", ((F.col("y") * 2 <= F.col("n")) & (F.col("accounts") >= 2)).alias("promotable"), "accounts").orderBy(F.desc("promotable"), F.desc("accounts"), "m").limit(20)


@query("stream_dedupe", "select user_id, count(distinct event_id // 2) looks from events where event_type = 'view' group by 1")
def stream_dedupe(spark, d):
    s = events.event_stream(spark, f"{d}/events*.parquet").where("event_type = 'view'").withColumn("eid", F.floor(F.col("event_id") / 2)).withColumn("ts", F.col("ts").cast("timestamp"))
    once = events.once_per_id(s.select("user_id", "eid", "ts"), ["user_id", "eid"], "ts", "40 days")
    return events.run_to_end(once).groupBy("user_id").agg(F.count("*").alias("looks"))
