"""Queries of sources, sinks and the stages from raw documents to entities, each with its SQL.

Files are written to a folder of their own below the shared one and read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.operators import promote, retrieval
from cellarium.plans.registry import query
from cellarium.plans.relational import entities
from cellarium.session import ensure_checkpoint_dir, table
from cellarium.sources import pages, sinks


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


# ---- names and categories

_KEEP = "'ipa','dipa','neipa','apa','xpa','esb','ipl','pbr','abv','ibu','usa','us','uk','nz','vsop','vs','xo','bba','bbl','ii','iii','iv','vi','vii','viii','ix','xi','xii','llc','inc','lp','dc','nyc','la','sf','pa','ny','ca','n/a','n.a'"
_EDGE = """[.,()&\\-/''"]+"""


def _title(c: str) -> str:
    word = f"case when lower(regexp_replace(regexp_replace(w, '^{_EDGE}', ''), '{_EDGE}$', '')) in ({_KEEP}) then w else array_to_string(list_transform(string_split(w, ''''), lambda s, i: case when i = 1 or length(s) > 1 then upper(s[1]) || lower(s[2:]) else lower(s) end), '''') end"
    return f"case when trim({c}) <> '' and trim({c}) = upper(trim({c})) then array_to_string(list_transform(string_split_regex(trim({c}), '\\s+'), lambda w: {word}), ' ') else {c} end"


def _none(c: str) -> str:
    return f"(trim(coalesce({c}, '')) = '' or regexp_replace(lower(trim({c})), '[^\\p{{L}}\\p{{N}}]', '', 'g') = 'none' or regexp_matches(trim({c}), '^[\\-–— ]+$'))"


_SILVER = f"""last as (select * from ttb_cola_sample where ttb_id is not null qualify row_number() over (partition by ttb_id order by fetched_at desc nulls last, row_id desc) = 1),
  silver as (select ttb_id, {_title("brand_name")} brand, case when {_none("fanciful_name")} then '' else {_title("fanciful_name")} end fanciful, class_type, permit_no, permittee, abv, upc from last)"""


@query("med_filing_products", f"""with {_SILVER} select 'ttb:' || ttb_id id, case when fanciful = '' then trim(brand) when not contains(lower(trim(fanciful)), lower(trim(brand))) then trim(brand) || ' ' || trim(fanciful) else trim(fanciful) end as name, class_type style, abv from silver where brand <> ''""")
def med_filing_products(spark, d):
    run = promote.run_pipeline(spark, table(spark, d, "ttb_cola_sample"), _folder(spark), promote.normalize_filings, lambda s: {"product": promote.promote_filings(s, "cola")["product"]})
    return run["product"].select("id", "name", "style", "abv")


_SLUG = "coalesce(nullif(trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g')[1:60], '-'), ''), 'x')"


@query("med_filing_makers", f"""with {_SILVER}, s as (select ttb_id, nullif(trim(coalesce(permit_no, '')), '') permit, case when permittee <> '' then permittee else brand end maker from silver where brand <> ''),
  p as (select case when permit is not null then 'prod:cola:permit:' || {_SLUG.format("permit")} else 'prod:cola:' || {_SLUG.format("maker")} end id, maker as name, permit ttb_permit, ttb_id from s) select id, name, ttb_permit from p qualify row_number() over (partition by id order by ttb_id desc) = 1""")
def med_filing_makers(spark, d):
    silver = promote.normalize_filings(table(spark, d, "ttb_cola_sample"))
    return promote.promote_filings(silver, "cola")["producer"].select("id", "name", "ttb_permit")


@query("med_demo_entities", """with d as (select producer m, product p, fetched_at, row_id from demo_products where producer.slug is not null and product.key is not null),
  e as (select 'producer' kind, 'prod:demo:' || m.slug id, m.name as name, fetched_at, row_id from d union all select 'brand', 'brand:demo:' || p.key, p.name, fetched_at, row_id from d union all select 'product', 'demo:' || p.key, p.name, fetched_at, row_id from d
    union all select 'sku', 'sku:' || p.upc, 'demo:' || p.key, fetched_at, row_id from d where p.upc <> '') select kind, id, name from e qualify row_number() over (partition by kind, id order by fetched_at desc nulls last, row_id desc) = 1""")
def med_demo_entities(spark, d):
    folder = _folder(spark)
    run = lambda source: promote.run_pipeline(spark, source, folder, lambda b: b, lambda s: promote.promote_demo(s, "demo"))
    run(table(spark, d, "demo_products"))
    gold, out = run(None), None  # again, from the bronze that is there
    for kind, df in gold.items():
        one = df.select(F.lit(kind).alias("kind"), "id", F.col("product_id" if kind == "sku" else "name").alias("name"))
        out = one if out is None else out.unionByName(one)
    return out


_BARE = "'gin','rum','rhum','beer','beers','ale','ales','ipa','lager','lagers','pils','pilsner','stout','porter','vodka','whisky','whiskey','wine','cider','eau','spirit','spirits','liqueur','mini','biere','bière','cerveza','birra','tequila','tequilas','mezcal','bourbon','scotch','brandy','cognac','sake','ouzo','grappa','absinthe','schnapps','sherry','vermouth','mead','soju','shochu'"


def _weak(c: str) -> str:
    return f"({c} = '' or regexp_matches({c}, '^[0-9]{{1,3}}$') or lower({c}) in ({_BARE}) or (not regexp_matches({c}, '[A-Za-z]') and not regexp_matches({c}, '^[0-9]+$')) or regexp_matches({c}, '^\\p{{Ll}}{{1,3}}$'))"


@query("med_open_products", f"""with r as (select row_id, trim(coalesce(product.name, '')) pn, trim(string_split(coalesce(producer.name, ''), ',')[1]) b, lower(concat_ws(' ', product.style, product.category)) c from demo_products),
  n as (select row_id, c, case when not {_weak("pn")} then pn when b = '' or {_weak("b")} then case when trim(b || ' ' || pn) <> '' and not {_weak("trim(b || ' ' || pn)")} then trim(b || ' ' || pn) end when regexp_matches(pn, '^[\\x00-\\x7f]+$') and not contains(lower(b), lower(pn)) then b || ' ' || pn else b end as name from r),
  k as (select row_id, name, case when regexp_matches(c, '\\bwhisk|\\bbourbon|\\bscotch\\b|\\bspirit|\\bliqueur|\\bliquor|\\bvodka|\\bgins?\\b|\\brums?\\b|\\brhums?\\b|\\btequila|\\bmezcal|\\bcognac|\\bbrandy|\\bbrandies|\\barmagnac|\\bcalvados|\\bgrappa|\\bouzo|\\bamaro|\\bvermouth|\\babsinthe|\\bschnapps|\\baquavit|\\bpastis|\\bsambuca|\\btriple sec|\\bbitters|\\bsake\\b|\\bsoju') then 'spirit'
     when regexp_matches(c, '\\bcidres?\\b|\\bcider') then 'cider' when regexp_matches(c, '\\bwines?\\b|\\bchampagne|\\bprosecco|\\bsherry|\\bsparkling') then 'wine'
     when regexp_matches(c, '\\bbeers?\\b|\\bbiers?\\b|\\bbirra|\\bcerveza|\\bcerveja|\\bales?\\b|\\blager|\\bpils|\\bstout|\\bipas?\\b|\\bporter|\\bsaison|\\bweizen|\\bweiss|\\bbeverage|\\bdrink|\\balcohol') then 'beer' end category, c from n)
  select row_id, name, category from k where name is not null and category is not null and not regexp_matches(lower(name || ' ' || c), 'yaourt|yogurt|yoghurt|vinegar|vinaigre|pasta|pâtes|pates|sodas|soft drink') and lower(trim(name)) not in ('chargement', 'loading', 'unknown', 'unknown product', 'sans nom', 'no name', 'n/a', '')""")
def med_open_products(spark, d):
    p = F.col("product")
    b = table(spark, d, "demo_products").select(F.col("row_id").alias("id"), p["upc"].alias("code"), p["name"].alias("product_name"), F.col("producer.name").alias("brands"), F.array_join(F.transform(p["ingredients"], lambda i: i["raw_name"]), ", ").alias("ingredients_text"), F.concat_ws(" ", p["style"], p["category"]).alias("categories"), p["abv"].alias("alcohol_value"))
    return promote.normalize_open(b.withColumn("id", F.col("id").cast("string"))).select(F.col("bronze_id").cast("long").alias("row_id"), "name", "category")


@query("med_ingredient_records", "select row_id || ':ingredient:' || (i - 1) id, ing.role as role, lower(ing.raw_name) raw_name from (select row_id, unnest(product.ingredients) ing, generate_subscripts(product.ingredients, 1) i from demo_products)")
def med_ingredient_records(spark, d):
    i = table(spark, d, "demo_products").select("row_id", F.posexplode("product.ingredients").alias("i", "ing"))
    return i.select(F.concat_ws(":", F.col("row_id").cast("string"), F.lit("ingredient"), F.col("i").cast("string")).alias("id"), "ing.role", F.lower("ing.raw_name").alias("raw_name"))


@query("med_ingredient_guesses", """select distinct n, case when regexp_matches(n, 'malt|barley|wheat|oat|rye') then 'base_malt' when contains(n, 'hop') then 'aroma_hop' when contains(n, 'yeast') then 'yeast' when contains(n, 'water') then 'water_salt' else 'other' end as role,
  case when contains(n, 'hop') then 'hop' when regexp_matches(n, 'malt|barley') then 'malt' when contains(n, 'yeast') then 'yeast' else 'other' end kind from (select lower(trim(unnest(string_split_regex(t, '[,;]')))) n from (select array_to_string(list_transform(product.ingredients, lambda i: i.raw_name), ', ') t from demo_products where product.ingredients is not null)) where n <> ''""")
def med_ingredient_guesses(spark, d):
    t = table(spark, d, "demo_products").select(F.array_join(F.transform("product.ingredients", lambda i: i["raw_name"]), ", ").alias("t"))
    return t.select(F.explode(promote.split_ingredients(F.col("t"))).alias("i")).select(F.lower("i.raw_name").alias("n"), "i.role", F.col("i.entity_kind").alias("kind")).distinct()


@query("med_makers_located", "select id, json_extract_string(record, '$.name') as name, try_cast(json_extract_string(record, '$.lat') as double) lat, try_cast(json_extract_string(record, '$.lon') as double) lon from gold where entity_type = 'producer' and json_extract_string(record, '$.name') <> ''")
def med_makers_located(spark, d):
    j = lambda c: F.get_json_object("record", f"$.{c}")
    rows = entities(spark, d, "producer").select("id", *[j(c).alias(c) for c in ("name", "kind", "country", "region", "city")], j("lat").alias("latitude"), j("lon").alias("longitude"))
    return promote.normalize_breweries(rows).select("id", "name", "lat", "lon")


_CLAIMS = "c as (select matcher account_id, id_a client_id, min(decided_at) received_at from match_pairs where matcher is not null and id_a is not null group by 1, 2)"


@query("med_claims", f"with {_CLAIMS}, t as (select * from c qualify row_number() over (partition by account_id order by received_at nulls first, client_id) <= 200) select account_id || '::' || client_id doc_id, received_at, (account_id, client_id) in (select matcher, id_a from match_pairs where score > 0.9 and matcher is not null and id_a is not null) duplicate from t")
def med_claims(spark, d):
    m = table(spark, d, "match_pairs")
    claims = m.select(F.col("matcher").alias("account_id"), F.col("id_a").alias("client_id"), F.col("decided_at").alias("received_at"))
    known = m.where("score > 0.9 and matcher is not null and id_a is not null").select(F.concat_ws("::", "matcher", "id_a").alias("doc_id"))
    return promote.take_claims(claims, known).select("doc_id", "received_at", "duplicate")


@query("med_claim_listing", f"with {_CLAIMS} select account_id, client_id, received_at from c where starts_with(account_id, 'b') or starts_with(account_id, 'n') order by received_at desc")
def med_claim_listing(spark, d):
    c = table(spark, d, "match_pairs").where("matcher is not null and id_a is not null").groupBy(F.col("matcher").alias("account_id"), F.col("id_a").alias("client_id")).agg(F.min("decided_at").alias("received_at"))
    return c.where(F.startswith("account_id", F.lit("b")) | F.startswith("account_id", F.lit("n"))).orderBy(F.desc("received_at"))


# ---- sources

@query("src_event_log", "select event_id, event_type from events where event_type in ('view', 'click')")
def src_event_log(spark, d):
    e, folder = table(spark, d, "events").select("event_id", F.col("event_type").alias("name")), _folder(spark)
    line = F.to_json(F.struct("event_id", "name"))
    torn = e.where("event_id % 1000 = 0").select(F.substring(line, 1, 12).alias("value"))
    e.select(line.alias("value")).unionByName(torn).write.option("compression", "gzip").text(folder)
    return pages.read_json_lines(spark, folder, "event_id long, name string", ["view", "click"]).select("event_id", F.col("name").alias("event_type"))


@query("src_damaged_export", "select ttb_id, fanciful_name, brand_name, class_type from (select ttb_id, trim(fanciful_name) || ', ' || row_id fanciful_name, trim(brand_name) brand_name, trim(class_type) || ', ' || row_id class_type, replace(replace(concat(fanciful_name, brand_name, class_type), '\"', ','), '''', ',') x from ttb_cola_sample where ttb_id is not null and not regexp_matches(coalesce(fanciful_name || brand_name || class_type, ','), '[,\"''\\n\\r]')) where x is not null")
def src_damaged_export(spark, d):
    f = table(spark, d, "ttb_cola_sample").where(F.col("ttb_id").isNotNull() & ~F.coalesce(F.concat("fanciful_name", "brand_name", "class_type"), F.lit(",")).rlike("[,\"'\\n\\r]"))
    no = F.col("row_id").cast("string")
    line = F.concat_ws(",", F.concat(F.lit("'"), "ttb_id", F.lit("'")), F.lit("BR-1"), F.lit('"21,142"'), F.lit("03/29/2021"), F.concat_ws(", ", F.trim("fanciful_name"), no), F.trim("brand_name"), F.lit("01"), F.lit("X"), F.lit("901"), F.concat_ws(", ", F.trim("class_type"), no))
    folder = _folder(spark)
    # Every file begins with a line of headings; nothing is quoted beyond what the lines hold.
    f.select(line.alias("head")).repartition(8).write.option("header", True).option("sep", "\u0001").option("quote", "").option("escapeQuotes", False).csv(folder)
    return pages.read_exports(spark, folder).select("ttb_id", "fanciful_name", "brand_name", "class_type")


@query("src_fraction_join", "select row_id, product.name as name, producer.name maker, round(round(product.abv / 100, 6) * 100, 1)::double pct from demo_products where product.abv is not null and not isnan(product.abv) and product.name is not null and producer.slug is not null and producer.name is not null qualify row_number() over (partition by row_id) = 1")
def src_fraction_join(spark, d):
    t, folder = table(spark, d, "demo_products").where("product.abv is not null and not isnan(product.abv) and product.name is not null and producer.slug is not null and producer.name is not null"), _folder(spark)
    t.select("row_id", "product.name", F.round(F.col("product.abv") / 100, 6).alias("abv")).write.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{folder}/drinks")
    t.select("row_id", F.col("producer.name").alias("maker")).write.option("header", True).option("escape", '"').csv(f"{folder}/makers")
    read = lambda name: spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{folder}/{name}")
    joined = read("drinks").join(read("makers"), "row_id", "left")
    return joined.select(F.col("row_id").cast("long").alias("row_id"), "name", "maker", F.round(F.col("abv").cast("double") * 100, 1).alias("pct"))


@query("src_optional_sample", "select lower(fanciful_name) item, abv, min(permittee) maker, count(*) n from ttb_cola_sample where fanciful_name is not null and abv is not null and not isnan(abv) group by 1, 2")
def src_optional_sample(spark, d):
    f = table(spark, d, "ttb_cola_sample").where("fanciful_name is not null and abv is not null and not isnan(abv)")
    return f.groupBy(F.lower("fanciful_name").alias("item"), "abv").agg(F.min("permittee").alias("maker"), F.count("*").alias("n"))


@query("src_page_range", "select p_partkey, p_size low, p_size + 19 high, p_partkey total from part")
def src_page_range(spark, d):
    head = F.format_string("Results %d to %d of %d", F.col("p_size"), F.col("p_size") + 19, F.col("p_partkey"))
    r = table(spark, d, "part").select("p_partkey", pages.page_range(head).alias("r"))
    return r.select("p_partkey", F.col("r.first").alias("low"), F.col("r.last").alias("high"), F.col("r.total").cast("long").alias("total"))


@query("src_scan_candidates", "select ts, json_extract_string(props, '$.k')::int product_id, value score from events where event_type = 'view'")
def src_scan_candidates(spark, d):
    candidate = F.struct(F.get_json_object("props", "$.k").cast("int").alias("product_id"), F.col("value").alias("score"))
    return pages.scanned_candidates(table(spark, d, "events").where("event_type = 'view'").select("ts", F.array(candidate).alias("candidates")))


# ---- sinks

@query("snk_delete", "select id, entity_type from gold where id is null or id not in (select id_a from match_pairs where id_a is not null)")
def snk_delete(spark, d):
    gone = table(spark, d, "match_pairs").where("id_a is not null").select(F.col("id_a").alias("id"))
    return sinks.delete(table(spark, d, "gold"), gone, "id").select("id", "entity_type")


@query("snk_batch_upsert", "select ttb_id, max(fetched_at) fetched_at from ttb_cola_sample where ttb_id is not null group by 1")
def snk_batch_upsert(spark, d):
    f = table(spark, d, "ttb_cola_sample").where("ttb_id is not null").select("ttb_id", "fetched_at", "row_id")
    old, new = f.where("row_id % 2 = 0"), f.where("row_id % 2 = 1")
    return sinks.upsert(old, new, ["ttb_id"], "fetched_at").select("ttb_id", "fetched_at")


@query("snk_pre_image", "select g.id, g.name from gold g where g.id in (select gold_id from dup_groups)")
def snk_pre_image(spark, d):
    touched = table(spark, d, "dup_groups").select(F.col("gold_id").alias("id"))
    gold = table(spark, d, "gold").select("id", "name")
    saved = sinks.pre_image(gold, touched, None, "id")
    return sinks.pre_image(gold.withColumn("name", F.lit("changed")), touched, saved, "id")


@query("snk_index", "select w token, count(*) n from (select distinct row_id, unnest(string_split_regex(lower(product.name), '[^a-z]+')) w from demo_products where product.name is not null) where length(w) >= 3 group by 1")
def snk_index(spark, d):
    p, folder = table(spark, d, "demo_products").select(F.col("row_id").alias("id"), F.col("product.name").alias("name")), _folder(spark)
    stamp = sinks.content_stamp(table(spark, d, "demo_products"), "fetched_at")
    sinks.write_index(retrieval.postings(p), folder, stamp)
    return sinks.load_index(spark, folder, stamp).groupBy("token").agg(F.count("*").alias("n"))
