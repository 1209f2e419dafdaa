"""Text, vector, retrieval, entity-resolution, profile and ranking queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellarium.functions import text as T
from cellarium.functions import vectors as V
from cellarium.operators import identity, medallion, ranking, retrieval, taste
from cellarium.plans.registry import query
from cellarium.plans.relational import PRODUCTS, entities, products
from cellarium.session import table

# ---- text

_FOLD = "lower(replace(replace({0}, '''', ''), '’', ''))"


@query("txt_fold_tokens", "select row_id, list_distinct(list_filter(string_split_regex(lower(replace(brand_name, '''', '')), '[^a-z]+'), lambda w: length(w) >= 2)).list_sort() tokens from ttb_cola_sample where brand_name is not null")
def txt_fold_tokens(spark, d):
    return table(spark, d, "ttb_cola_sample").where("brand_name is not null").select("row_id", F.array_sort(T.word_tokens(F.col("brand_name"))).alias("tokens"))


@query("txt_name_tokens", "select p_partkey, list_sort(list_distinct(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda w: length(w) >= 3 or regexp_matches(w, '^[0-9]+$')))) tokens from part")
def txt_name_tokens(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_sort(T.name_tokens(F.col("p_name"))).alias("tokens"))


_TRI = "list_distinct(list_transform(range(1, length({0}) + 2), lambda i: ('  ' || lower({0}) || ' ')[i:i+2]))"


_PLAIN = "translate(strip_accents({0}), chr(39) || '’‘`', '')"
_NAMES = "select distinct name from gold where entity_type = 'producer' and name is not null"


@query("txt_trigrams", f"select name, list_sort({_TRI.format(_PLAIN.format('name'))}) grams from ({_NAMES})")
def txt_trigrams(spark, d):
    return entities(spark, d, "producer").where("name is not null").select("name").distinct().select("name", F.array_sort(T.trigrams(F.col("name"))).alias("grams"))


@query("txt_word_trigrams", f"select name, list_sort(list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({_PLAIN.format('name')}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: ('  ' || w || ' ')[i:i+2]))))) grams from ({_NAMES})")
def txt_word_trigrams(spark, d):
    return entities(spark, d, "producer").where("name is not null").select("name").distinct().select("name", F.array_sort(T.word_trigrams(F.col("name"))).alias("grams"))


@query("txt_trigram_similarity", f"""with g as (select distinct product.style k from demo_products where product.style is not null), a as (select k, {_TRI.format(_PLAIN.format('k'))} t from g), b as (select label l, {_TRI.format(_PLAIN.format('label'))} t from canon_list where list_name = 'style')
  select k, l, round(len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t)), 9) sim from a, b where len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t)) >= 0.5""")
def txt_trigram_similarity(spark, d):
    # Styles and labels meet on the trigrams they share; the counts of the join are the similarity.
    typed = table(spark, d, "demo_products").select(F.col("product.style").alias("k")).where("k is not null").distinct()
    labels = table(spark, d, "canon_list").where("list_name = 'style'").select(F.col("label").alias("l"))
    grams = lambda df, c, n: df.select(c, T.trigrams(F.col(c)).alias("t")).select(c, F.size("t").alias(n), F.explode("t").alias("g"))
    both = grams(typed, "k", "n").join(grams(labels, "l", "m"), "g").groupBy("k", "l", "n", "m").agg(F.count("*").alias("c"))
    return both.withColumn("sim", F.col("c") / (F.col("n") + F.col("m") - F.col("c"))).where("sim >= 0.5").select("k", "l", F.round("sim", 9).alias("sim"))


@query("txt_one_edit", "with b as (select distinct regexp_replace(lower(brand_name), '[^a-z ]', '', 'g') b from ttb_cola_sample where length(brand_name) >= 5) select x.b a, y.b b from b x join b y on x.b < y.b and abs(length(x.b) - length(y.b)) <= 1 and damerau_levenshtein(x.b, y.b) <= 1")
def txt_one_edit(spark, d):
    b = table(spark, d, "ttb_cola_sample").where("length(brand_name) >= 5").select(F.regexp_replace(F.lower("brand_name"), "[^a-z ]", "").alias("a")).distinct()
    keyed = b.select("a", F.explode(T.one_edit_keys(F.col("a"))).alias("k"))
    pairs = keyed.join(keyed.select(F.col("a").alias("b"), "k"), "k").where("a < b").select("a", "b").distinct()
    return pairs.where(T.within_one_edit(F.col("a"), F.col("b")))


@query("txt_slug", "select distinct permittee, trim(regexp_replace(lower(permittee), '[^a-z0-9]+', '-', 'g')[1:60], '-') slug from ttb_cola_sample where permittee is not null")
def txt_slug(spark, d):
    return table(spark, d, "ttb_cola_sample").where("permittee is not null").select("permittee", T.slug(F.col("permittee")).alias("slug")).distinct()


@query("txt_document_id", "select distinct id, lower(trim(source_id)) || ':' || sha256(lower(trim(source_id)) || '::' || natural_key)[1:16] made from bronze")
def txt_document_id(spark, d):
    return table(spark, d, "bronze").select("id", T.document_id(F.lower(F.trim("source_id")), F.col("natural_key")).alias("made")).distinct()


@query("txt_title_case", "select distinct brand_name, case when upper(brand_name) = brand_name and lower(brand_name) <> brand_name then array_to_string(list_transform(string_split(lower(brand_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') else brand_name end titled from ttb_cola_sample where brand_name is not null")
def txt_title_case(spark, d):
    return table(spark, d, "ttb_cola_sample").where("brand_name is not null").select("brand_name", T.title_case(F.col("brand_name")).alias("titled")).distinct()


@query("txt_look_alikes", f"select name, name latin from ({_NAMES})")
def txt_look_alikes(spark, d):
    # Names in which Latin letters were replaced by Cyrillic ones that look like them come back as they were.
    n = entities(spark, d, "producer").where("name is not null").select("name").distinct()
    return n.select("name", T.latin_look_alikes(F.translate("name", "ABEKMHOPCTyxaeopc", "АВЕКМНОРСТухаеорс")).alias("latin"))


@query("txt_stated_strength", "select doc_id, regexp_extract(text, '([0-9]+(\\.[0-9]+)?)% alcohol', 1)::double abv from documents where regexp_matches(text, '[0-9]+(\\.[0-9]+)?% alcohol')")
def txt_stated_strength(spark, d):
    return table(spark, d, "documents").where(F.col("text").rlike(r"[0-9]+(\.[0-9]+)?% alcohol")).select("doc_id", F.regexp_extract("text", r"([0-9]+(\.[0-9]+)?)% alcohol", 1).cast("double").alias("abv"))


@query("txt_search_name", f"select p.id, case when b.name is null or starts_with(lower(p.name), lower(b.name)) then p.name else b.name || ' ' || p.name end search_name from ({PRODUCTS}) p left join (select id, name from gold where entity_type = 'brand') b on p.brand_id = b.id where p.name is not null")
def txt_search_name(spark, d):
    b = entities(spark, d, "brand").select(F.col("id").alias("brand_id"), F.col("name").alias("b"))
    p = products(spark, d).where("name is not null").join(b, "brand_id", "left")
    return p.select("id", F.when(F.col("b").isNull() | F.startswith(F.lower("name"), F.lower("b")), F.col("name")).otherwise(F.concat_ws(" ", "b", "name")).alias("search_name"))


@query("txt_without_nul", "select p_partkey, p_name from part")
def txt_without_nul(spark, d):
    return table(spark, d, "part").select("p_partkey", T.without_nul(F.concat("p_name", F.lit("\u0000"))).alias("p_name"))


@query("txt_match_key", "select row_id, regexp_replace(lower(brand_name), '[^a-z0-9]+', ' ', 'g') || chr(31) || regexp_replace(lower(fanciful_name), '[^a-z0-9]+', ' ', 'g') k from ttb_cola_sample where brand_name is not null and fanciful_name is not null")
def txt_match_key(spark, d):
    n = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")
    return table(spark, d, "ttb_cola_sample").where("brand_name is not null and fanciful_name is not null").select("row_id", F.concat(n("brand_name"), F.lit("\x1f"), n("fanciful_name")).alias("k"))


# ---- vectors and scalar scores

_COS = "list_dot_product({0}, {1}) / sqrt(list_dot_product({0}, {0}) * list_dot_product({1}, {1}))"


@query("vec_cosine_topk", f"with e as (select vec_id, embedding::double[] v from embeddings), q as (select v from e order by vec_id limit 1) select vec_id, round({_COS.format('e.v', 'q.v')}, 6) cos from e, q order by {_COS.format('e.v', 'q.v')} desc, vec_id limit 20")
def vec_cosine_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.orderBy("vec_id").limit(1).select(F.col("embedding")).scalar()
    return e.withColumn("q", q).withColumn("c", V.cosine(F.col("embedding"), F.col("q"))).orderBy(F.desc("c"), "vec_id").limit(20).select("vec_id", F.round("c", 6).alias("cos"))


@query("vec_shelves", f"with e as (select vec_id, label, embedding::double[] v from embeddings), q as (select v from e order by vec_id limit 1), r as (select vec_id, label, row_number() over (partition by label order by {_COS.format('e.v', 'q.v')} desc, vec_id) k from e, q) select label, vec_id, k from r where k <= 5")
def vec_shelves(spark, d):
    e = table(spark, d, "embeddings")
    q = e.orderBy("vec_id").limit(1).select(F.col("embedding")).scalar()
    k = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("c"), "vec_id"))
    return e.withColumn("q", q).withColumn("c", V.cosine(F.col("embedding"), F.col("q"))).withColumn("k", k).where("k <= 5").select("label", "vec_id", "k")


@query("vec_centroids", "select label, i, round(avg(x), 6) x from (select label, unnest(embedding)::double x, generate_subscripts(embedding, 1) - 1 i from embeddings) group by 1, 2")
def vec_centroids(spark, d):
    return table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))


@query("vec_strongest_axes", "select id, list_sort(list_transform(list_slice(list_reverse_sort(list_transform(range(1, 26), lambda i: [sensory[i], -i])), 1, 3), lambda p: (-p[2])::int - 1)) axes from gold where entity_type = 'product' and sensory is not null and len(list_filter(sensory, lambda x: x is null)) = 0")
def vec_strongest_axes(spark, d):
    s = entities(spark, d, "product").where(F.col("sensory").isNotNull() & ~F.exists("sensory", lambda x: x.isNull()))
    best = F.slice(F.array_sort(F.transform("sensory", lambda x, i: F.struct((-x).alias("x"), i.alias("i")))), 1, 3)
    return s.select("id", F.array_sort(F.transform(best, lambda p: p["i"])).alias("axes"))


@query("fn_personal_score", f"with e as (select vec_id, embedding::double[] v from embeddings), q as (select v from e order by vec_id desc limit 1), s as (select vec_id, greatest(0, least(1, 0.5 + 0.5 * ({_COS.format('e.v', 'q.v')}))) s from e, q) select vec_id, round(s, 6) score, case when s >= 0.8 then 0 when s >= 0.6 then 1 else 2 end band from s")
def fn_personal_score(spark, d):
    e = table(spark, d, "embeddings")
    q = e.orderBy(F.desc("vec_id")).limit(1).select(F.col("embedding")).scalar()
    scored = e.withColumn("q", q).withColumn("s", ranking.personal_score(V.cosine(F.col("embedding"), F.col("q"))))
    return scored.select("vec_id", F.round("s", 6).alias("score"), ranking.band(F.col("s")).alias("band"))


@query("fn_evidence_tier", f"select id, case when src in ('review_consensus', 'reconciled') then 0 when src in ('llm_profile', 'chemistry_prior') and json_extract_string(record, '$.sensory.confidence')::double >= 0.45 then 1 else 2 end tier from (select g.record, p.* from ({PRODUCTS}) p join gold g using (id))")
def fn_evidence_tier(spark, d):
    g = entities(spark, d, "product")
    j = lambda p: F.get_json_object("record", p)
    return g.select("id", ranking.evidence_tier(j("$.sensory.source"), j("$.sensory.confidence").cast("double")).alias("tier"))


# Greatest confidence a fact may have by the way it was obtained.
CEILING = {"stated_by_producer": 1.0, "regulatory_filing": 1.0, "label_ocr": 0.9, "retailer_listing": 0.8, "open_database": 0.75, "community_clone": 0.6, "review_consensus": 0.6, "llm_recalled": 0.6, "llm_inferred_from_style_prior": 0.4, "user_contributed": 0.7}


@query("fn_confidence_clamp", """select id, m, round(case when m in ('stated_by_producer', 'regulatory_filing') then least(c, 1.0) when m = 'label_ocr' then least(c, 0.9) when m = 'retailer_listing' then least(c, 0.8) when m = 'open_database' then least(c, 0.75)
   when m in ('community_clone', 'review_consensus', 'llm_recalled') then least(c, 0.6) when m = 'llm_inferred_from_style_prior' then least(c, 0.4) when m = 'user_contributed' then least(c, 0.7) else c end, 6)::double confidence
  from (select id, json_extract_string(record, '$.spec.abv_pct.provenance.method') m, json_extract_string(record, '$.spec.abv_pct.provenance.confidence')::double c from gold where entity_type = 'product')""")
def fn_confidence_clamp(spark, d):
    j = lambda p: F.get_json_object("record", f"$.spec.abv_pct.provenance.{p}")
    cap = F.create_map(*[F.lit(x) for kv in CEILING.items() for x in kv])
    g = entities(spark, d, "product").select("id", j("method").alias("m"), j("confidence").cast("double").alias("c"))
    return g.select("id", "m", F.round(F.when(F.col("c").isNotNull(), F.least("c", F.coalesce(cap[F.col("m")], F.lit(1.0)))), 6).alias("confidence"))


@query("fn_recipe_completeness", "with r as (select id, from_json(json_extract(record, '$.recipe.ingredients'), '[{\"role\":\"VARCHAR\"}]') i, json_array_length(json_extract(record, '$.recipe.process_steps')) s from gold where entity_type = 'product') select id, (((len(list_filter(i, lambda x: x.role like '%malt%')) > 0)::int + (len(list_filter(i, lambda x: x.role like '%hop%')) > 0)::int + (len(list_filter(i, lambda x: x.role = 'yeast')) > 0)::int + (s > 0)::int) / 4.0)::double completeness from r")
def fn_recipe_completeness(spark, d):
    r = F.from_json("record", "recipe struct<ingredients:array<struct<role:string>>,process_steps:array<string>>")["recipe"]
    return entities(spark, d, "product").select("id", medallion.recipe_completeness(r["ingredients"], r["process_steps"]).alias("completeness"))


# ---- retrieval

@query("idx_postings", "select w token, count(*) rows, min(row_id) first_row from (select distinct row_id, unnest(string_split_regex(lower(product.name), '[^a-z]+')) w from demo_products where product.name is not null) where length(w) >= 3 group by 1")
def idx_postings(spark, d):
    p = table(spark, d, "demo_products").select(F.col("row_id").alias("id"), F.col("product.name").alias("name"))
    return retrieval.postings(p).groupBy("token").agg(F.count("*").alias("rows"), F.min("id").alias("first_row"))


_LINES = "select row_id qid, brand_name || ' ' || fanciful_name q from ttb_cola_sample where brand_name is not null and fanciful_name is not null"


@query("match_line_topk", f"""with q as ({_LINES}), n as (select count(*) n from gold where entity_type = 'brand' and name is not null),
  pt as (select distinct id, unnest(string_split_regex(lower(name), '[^a-z]+')) w from gold where entity_type = 'brand' and name is not null), pf as (select * from pt where length(w) >= 3),
  df as (select w, count(*) df from pf group by 1), qt as (select distinct qid, unnest(string_split_regex(lower(q), '[^a-z]+')) w from q),
  s as (select qid, id, round(sum(ln(1 + n / df)), 6) evidence from qt join pf using (w) join df using (w), n group by 1, 2),
  r as (select *, row_number() over (partition by qid order by evidence desc, id) k from s) select qid, id, evidence from r where k <= 3""")
def match_line_topk(spark, d):
    q = table(spark, d, "ttb_cola_sample").where("brand_name is not null and fanciful_name is not null").select(F.col("row_id").alias("qid"), F.concat_ws(" ", "brand_name", "fanciful_name").alias("text"))
    return retrieval.match_lines(q, entities(spark, d, "brand").select("id", "name"), 3)


@query("search_names", """with p as (select id, name from gold where entity_type = 'producer' and name is not null), t as (select id, name, list_distinct(list_transform(range(1, length(name) + 2), lambda i: ('  ' || lower(name) || ' ')[i:i+2])) t from p),
  q as (select unnest(['harbor brewing', 'meadow cellars']) q), u as (select q, list_distinct(list_transform(range(1, length(q) + 2), lambda i: ('  ' || q || ' ')[i:i+2])) u from q),
  s as (select q, id, len(list_intersect(t, u)) / len(list_distinct(t || u)) sim, length(name) l from t, u), r as (select *, row_number() over (partition by q order by sim desc, l, id) k from s where sim >= 0.2) select q, id, round(sim, 6) sim from r where k <= 10""")
def search_names(spark, d):
    q = spark.createDataFrame([("harbor brewing",), ("meadow cellars",)], "q string")
    return retrieval.search_names(q, entities(spark, d, "producer").select("id", "name"), floor=0.2, limit=10)


@query("fuzzy_token_lookup", """with v as (select distinct w from (select unnest(string_split_regex(lower(name), '[^a-z]+')) w from gold where entity_type = 'brand' and name is not null) where length(w) >= 5),
  q as (select distinct w q from (select unnest(string_split_regex(lower(brand_name), '[^a-z]+')) w from ttb_cola_sample where brand_name is not null) where length(w) >= 5)
  select q, w, case when q = w then 1.0 when damerau_levenshtein(q, w) <= 1 then 0.7 else 0.6 end::double weight from q join v on damerau_levenshtein(q, w) <= 1 or starts_with(w, q) or starts_with(q, w) or ends_with(w, q) or ends_with(q, w)""")
def fuzzy_token_lookup(spark, d):
    words = lambda df, c: df.where(F.col(c).isNotNull()).select(F.explode(F.split(F.lower(c), "[^a-z]+")).alias("w")).where("length(w) >= 5").distinct()
    return retrieval.token_lookup(words(table(spark, d, "ttb_cola_sample"), "brand_name").withColumnRenamed("w", "q"), words(entities(spark, d, "brand"), "name"))


# ---- entity resolution and medallion

@query("er_redirect_closure", """with recursive e as (select id, json_extract_string(record, '$.redirects_to') t from gold where entity_type = 'product_redirect'),
  w as (select id, t, 1 hops from e union all select w.id, e.t, hops + 1 from w join e on w.t = e.id where hops < 8)
  select id, case when max(hops) < 8 then max_by(t, hops) end target from w group by 1""")
def er_redirect_closure(spark, d):
    r = entities(spark, d, "product_redirect").select("id", F.get_json_object("record", "$.redirects_to").alias("target"))
    return identity.flatten_redirects(r, 8)


@query("er_exact_buckets", """with t as (select id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(replace(replace(replace(replace(lower(strip_accents(name)), '''', ''), '’', ''), '‘', ''), '`', ''), '[^a-z0-9]+'), lambda w: w <> ''))), ' ') k, name from gold where entity_type = 'product' and name is not null)
  select k, count(*) n, min(id) keeper from t group by 1 having count(*) > 1""")
def er_exact_buckets(spark, d):
    p = entities(spark, d, "product").where("name is not null").select("id", "name")
    return identity.exact_buckets(p).select("k", "n", "keeper")


@query("er_containment_unique", """with t as (select id, list_distinct(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda w: w <> '')) w, regexp_replace(name, '[^0-9]', '', 'g') dg from gold where entity_type = 'brand' and name is not null),
  n as (select distinct on (list_sort(w)) * from t order by list_sort(w), id), x as (select id, w, dg, unnest(w) k from n),
  p as (select distinct a.id alias, b.id canonical from x a join x b on a.k = b.k and a.id <> b.id and a.dg = b.dg where len(a.w) < len(b.w) and len(list_filter(a.w, lambda z: not list_contains(b.w, z))) = 0)
  select alias, min(canonical) canonical from p group by 1 having count(*) = 1""")
def er_containment_unique(spark, d):
    return identity.containment_merges(entities(spark, d, "brand").where("name is not null").select("id", "name"))


@query("er_product_containment")
def er_product_containment(spark, d):
    b = entities(spark, d, "brand").select(F.col("id").alias("brand_id"), F.col("name").alias("brand"))
    return identity.product_merges(products(spark, d).where("name is not null").join(b, "brand_id", "left").select("id", "name", "brand"))


@query("er_maker_merge", """with c as (select id, name, trim(regexp_replace(regexp_replace(lower(name), '^the ', ''), '( (brewing|distillers|cellars|company|co|inc|llc|ltd|works|beverage|wine|estates|imports|group)[.,]*)+$', '')) core from gold where entity_type = 'producer' and name is not null)
  select id, core, first_value(id) over (partition by core order by length(name), id) canonical from c where core <> ''""")
def er_maker_merge(spark, d):
    return identity.maker_merges(entities(spark, d, "producer").where("name is not null").select("id", "name"))


@query("er_absorb", """with f as (select group_id, json_extract_string(record, '$.description.value') de, json_extract_string(record, '$.style.value') st, updated_at, id from dup_groups join gold on id = gold_id)
  select group_id, arg_min(de, id) filter (where de is not null and de <> '') de, arg_min(st, id) filter (where st is not null and st <> '') st from f group by 1""")
def er_absorb(spark, d):
    j = lambda p: F.get_json_object("record", p)
    m = table(spark, d, "dup_groups").join(entities(spark, d, "product").select(F.col("id").alias("gold_id"), j("$.description.value").alias("de"), j("$.style.value").alias("st")), "gold_id")
    return identity.absorb(m, ["group_id"], "gold_id", ["de", "st"])


@query("er_rekey_permits", """with n as (select permit_no, brand_name, count(*) n from ttb_cola_sample where permit_no is not null and brand_name is not null group by 1, 2), r as (select *, row_number() over (partition by permit_no order by n desc, brand_name) k from n),
  o as (select permit_no, origin_desc, count(*) c, sum(count(*)) over (partition by permit_no) t from ttb_cola_sample where permit_no is not null and origin_desc is not null group by 1, 2)
  select r.permit_no, 'permit:' || trim(regexp_replace(lower(r.permit_no), '[^a-z0-9]+', '-', 'g')[1:60], '-') producer_id, brand_name as name, o2.region from r left join (select permit_no, min(origin_desc) region from o where c >= 0.8 * t group by 1) o2 on r.permit_no = o2.permit_no where k = 1""")
def er_rekey_permits(spark, d):
    return identity.permit_producers(table(spark, d, "ttb_cola_sample"))


@query("er_contribution_verdict", """with g as (select lower(matcher) m, count(distinct pair_id % 7) accounts, count(*) n, count(*) filter (where is_match) y from match_pairs group by 1)
  select m, case when accounts < 2 then 'needs_a_look' when y * 2 > n then 'in_catalog' else 'new' end verdict from g""")
def er_contribution_verdict(spark, d):
    g = table(spark, d, "match_pairs").groupBy(F.lower("matcher").alias("m")).agg(F.count_distinct(F.col("pair_id") % 7).alias("accounts"), F.count("*").alias("n"), F.count_if("is_match").alias("y"))
    return g.select("m", F.when(F.col("accounts") < 2, "needs_a_look").when(F.col("y") * 2 > F.col("n"), "in_catalog").otherwise("new").alias("verdict"))


@query("med_upsert_latest", "select id, natural_key, fetched_at from (select *, row_number() over (partition by id order by fetched_at desc, payload desc) k from bronze) where k = 1")
def med_upsert_latest(spark, d):
    return medallion.latest_rows(table(spark, d, "bronze"), ["id"], ["fetched_at", "payload"]).select("id", "natural_key", "fetched_at")


@query("med_silver_filings", "select ttb_id || ':cola:0' id, ttb_id, case when regexp_replace(lower(fanciful_name), '[^a-z0-9]+', '', 'g') in ('', 'na', 'none') then null else fanciful_name end fanciful_name, strptime(completed_date, '%m/%d/%Y')::date completed from (select *, row_number() over (partition by ttb_id order by fetched_at desc, row_id desc) k from ttb_cola_sample) where k = 1")
def med_silver_filings(spark, d):
    return medallion.silver_filings(table(spark, d, "ttb_cola_sample")).select("id", "ttb_id", "fanciful_name", "completed")


@query("med_promote_demo", "select producer.slug || ':' || product.key id, product.name as name, len(product.ingredients) ingredients from demo_products where product.key is not null and producer.slug is not null qualify row_number() over (partition by producer.slug, product.key order by fetched_at desc, row_id desc) = 1")
def med_promote_demo(spark, d):
    return medallion.promote_demo(table(spark, d, "demo_products")).select("id", "name", F.size("ingredients").alias("ingredients"))


@query("med_counts", "select entity_type, count(*) n from gold group by 1")
def med_counts(spark, d):
    return table(spark, d, "gold").groupBy("entity_type").agg(F.count("*").alias("n"))


@query("med_ingredient_roles", "select i.role as role, lower(i.raw_name) raw_name, count(*) n from (select unnest(product.ingredients) i from demo_products) group by 1, 2")
def med_ingredient_roles(spark, d):
    i = table(spark, d, "demo_products").select(F.explode("product.ingredients").alias("i"))
    return i.groupBy("i.role", F.lower("i.raw_name").alias("raw_name")).agg(F.count("*").alias("n")).select("role", "raw_name", "n")


# ---- profile and ranking

_SIGNALS = "select user_id, k, case when last = 'purchase' then 1.0 else -1.0 end::double w from (select user_id, json_extract_string(props, '$.k')::int k, max_by(event_type, event_id) last from events where event_type in ('purchase', 'error') group by 1, 2)"


@query("taste_signals", _SIGNALS)
def taste_signals(spark, d):
    return taste.signals(table(spark, d, "events"))


@query("taste_interest", "select user_id, k, round(least(0.15 * count(*), 0.6), 6) w from (select distinct user_id, json_extract_string(props, '$.k')::int k, event_id from events where event_type in ('view', 'click')) group by 1, 2")
def taste_interest(spark, d):
    return taste.interest(table(spark, d, "events"))


@query("taste_band_novelty", "select user_id, min(value) - 0.5 low, max(value) + 0.5 high, round(count(distinct event_type) / count(*), 6) novelty from events where value is not null group by 1 having count(*) >= 2")
def taste_band_novelty(spark, d):
    return taste.bands(table(spark, d, "events"))


@query("taste_centroid", f"""with s as ({_SIGNALS}), x as (select user_id, w, generate_subscripts(embedding, 1) - 1 i, unnest(embedding)::double v from s join embeddings on vec_id = k),
  m as (select user_id, i, sum(v * w) filter (where w > 0) / sum(w) filter (where w > 0) p, sum(v * -w) filter (where w < 0) / sum(-w) filter (where w < 0) n from x group by 1, 2)
  select user_id, i, round(greatest(0, least(1, p - 0.4 * coalesce(n, 0))), 3)::double x from m where p is not null and greatest(0, least(1, p - 0.4 * coalesce(n, 0))) > 0""")
def taste_centroid(spark, d):
    c = taste.centroids(taste.signals(table(spark, d, "events")), table(spark, d, "embeddings").select(F.col("vec_id").alias("k"), "embedding"), "embedding")
    return c.select("user_id", F.posexplode("centroid").alias("i", "x")).where("x > 0").select("user_id", "i", F.round("x", 3).alias("x"))


@query("rank_catalog", f"""with s as ({_SIGNALS}), x as (select user_id, w, generate_subscripts(embedding, 1) i, unnest(embedding)::double v from s join embeddings on vec_id = k),
  m as (select user_id, i, sum(v * w) filter (where w > 0) / sum(w) filter (where w > 0) p, sum(v * -w) filter (where w < 0) / sum(-w) filter (where w < 0) n from x group by 1, 2),
  c as (select user_id, list(greatest(0, least(1, p - 0.4 * coalesce(n, 0))) order by i) c from m where p is not null group by 1 having max(p - 0.4 * coalesce(n, 0)) > 0),
  r as (select c.user_id, e.vec_id, round(greatest(0, least(1, 0.5 + 0.5 * ({_COS.format('c.c', 'e.embedding::double[]')}))), 9) sc from c, embeddings e where not exists (select 1 from s where s.user_id = c.user_id and s.k = e.vec_id)),
  t as (select *, row_number() over (partition by user_id order by sc desc, vec_id) rank from r) select user_id, rank, vec_id, round(sc, 6) score from t where rank <= 10""")
def rank_catalog(spark, d):
    s = taste.signals(table(spark, d, "events"))
    items = table(spark, d, "embeddings").select(F.col("vec_id").alias("k"), "embedding")
    c = taste.centroids(s, items, "embedding")
    return ranking.rank_for_users(c, items, s, 10).select("user_id", "rank", F.col("k").alias("vec_id"), F.round("score", 6).alias("score"))
