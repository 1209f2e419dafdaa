"""Queries of profiles and of lists ranked for them, each with its SQL.

Events carry no product id, so a product is a vector of ``embeddings``: a purchase is a rating, an error
withdraws it, a signup adds to a list, views and clicks are looks, clicks also answer the quiz.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellarium.functions import vectors as V
from cellarium.operators import identity, profiles, ranking
from cellarium.plans.registry import query
from cellarium.plans.relational import PRODUCTS, entities, products
from cellarium.session import table

# ---- profiles

_EVENTS = """ev as (select user_id, event_id seq, case when event_id % 7 = 0 then null else (event_id // 2)::varchar end eid, event_type t, value v, k, case when k % 10 = 9 then k - 1 else k end product from (select *, json_extract_string(props, '$.k')::int k from events) where user_id is not null)"""
_SIGNALS = """sig as (select user_id, product, coalesce(case when lt = 'purchase' then lw end, s) w from
   (select user_id, product, arg_max(t, seq) lt, arg_max(greatest(-1, least(1, (1 + floor(v)::int % 5 - 3) / 2.0)), seq) lw from ev where t in ('purchase', 'error') group by 1, 2)
   full join (select user_id, product, least(1, sum(case k % 4 when 0 then 0.6 when 1 then 0.5 else 0.3 end)) s from ev where t = 'signup' group by 1, 2) using (user_id, product) where coalesce(case when lt = 'purchase' then lw end, s) <> 0)"""
_LOOKS = """looks as (select user_id, product, count(*) n from (select user_id, coalesce(eid, 's' || seq) e, arg_min(product, seq) product from ev where t in ('view', 'click') group by 1, 2) group by 1, 2)"""
_QUIZ = "quiz as (select user_id, f family, w from (select user_id, k % 10 f, arg_max(floor(v)::int % 3 - 1, seq) w from ev where t = 'click' group by 1, 2) where w <> 0)"
_ALL = "al as (select user_id, product, w from sig union all select user_id, product, least(0.15 * n, 0.6) from looks anti join sig using (user_id, product))"


def _bound(spark: SparkSession, d: str) -> DataFrame:
    """Events as ``user_id, seq, event_id, name, t, product, k, v``, about the products left after merges."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, d, "events").where("user_id is not null").select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 7 != 0, F.floor(F.col("event_id") / 2).cast("string")).alias("event_id"), F.col("event_type").alias("t"), F.col("value").alias("v"), k.alias("k"), k.alias("product"))
    merged = table(spark, d, "embeddings").where("vec_id % 10 = 9").select(F.col("vec_id").cast("int").alias("id"), (F.col("vec_id") - 1).cast("int").alias("target"))
    return profiles.canonical_events(e, "product", identity.flatten_redirects(merged))


def _signals(e: DataFrame) -> DataFrame:
    list_weight = F.when(F.col("k") % 4 == 0, 0.6).when(F.col("k") % 4 == 1, 0.5).otherwise(0.3)
    name = F.create_map(*[F.lit(x) for x in ("purchase", "rating", "error", "withdrawn", "signup", "list")])[F.col("t")]
    weight = F.when(F.col("t") == "signup", list_weight).otherwise(profiles.rating_weight(1 + F.floor("v") % 5))
    return profiles.product_signals(e.select("user_id", "product", "seq", name.alias("name"), weight.alias("weight")))


def _looks(e: DataFrame) -> DataFrame:
    return profiles.considerations(e.where("t in ('view', 'click')"))


def _quiz(e: DataFrame) -> DataFrame:
    return profiles.quiz_answers(e.where("t = 'click'").select("user_id", (F.col("k") % 10).alias("family"), "seq", (F.floor("v") % 3 - 1).cast("double").alias("weight")))


@query("prf_signals", f"with {_EVENTS}, {_SIGNALS} select user_id, product, round(w, 6)::double w from sig")
def prf_signals(spark, d):
    return _signals(_bound(spark, d)).select("user_id", "product", F.round("w", 6).alias("w"))


@query("prf_quiz", f"with {_EVENTS}, {_QUIZ} select user_id, family, w::double w from quiz")
def prf_quiz(spark, d):
    return _quiz(_bound(spark, d))


@query("prf_considered", f"with {_EVENTS}, {_LOOKS} select user_id, product, n from looks")
def prf_considered(spark, d):
    return _looks(_bound(spark, d))


@query("prf_canonical", f"with {_EVENTS} select product, count(*) n from ev group by 1")
def prf_canonical(spark, d):
    return _bound(spark, d).groupBy("product").agg(F.count("*").alias("n"))


_ITEMS = "items as (select vec_id product, label::varchar style, vec_id % 20 + 0.5 abv, embedding vector from embeddings), fam as (select label family, 'family ' || label style, null abv, arg_min(embedding, vec_id) vector from embeddings group by 1)"
_BOTH = "ba as (select user_id, w, style, abv, vector from al join items using (product) union all select user_id, w * 0.5, style, null, vector from quiz join fam using (family))"


@query("prf_profiles", f"""with {_EVENTS}, {_SIGNALS}, {_LOOKS}, {_QUIZ}, {_ALL}, {_ITEMS}, {_BOTH},
  x as (select user_id, w, generate_subscripts(vector, 1) i, unnest(vector)::double x from ba), m as (select user_id, i, sum(x * w) filter (where w > 0) / sum(w) filter (where w > 0) p, sum(x * -w) filter (where w < 0) / sum(-w) filter (where w < 0) q from x group by 1, 2),
  ideal as (select user_id, list(round(greatest(0, least(1, p - 0.4 * coalesce(q, 0))), 3)::double order by i) ideal from m where p is not null group by 1)
  select user_id, count(*) n, round(least(0.9, 0.3 + 0.08 * count(*)), 3)::double confidence, case when count(abv) filter (where w > 0) >= 2 then round(greatest(0, min(abv) filter (where w > 0) - 0.5), 1)::double end abv_min,
    case when count(abv) filter (where w > 0) >= 2 then round(max(abv) filter (where w > 0) + 0.5, 1)::double end abv_max, case when count(style) filter (where w > 0) >= 2 then round(count(distinct style) filter (where w > 0) / count(style) filter (where w > 0), 3)::double end novelty, any_value(ideal.ideal) ideal
  from ba left join ideal using (user_id) group by 1""")
def prf_profiles(spark, d):
    e = _bound(spark, d)
    signals, (items, families) = profiles.all_signals(_signals(e), _looks(e)), _items(spark, d)
    return profiles.build_profiles(signals, items, _quiz(e), families)


def _items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    items = e.select(F.col("vec_id").cast("int").alias("product"), F.col("label").cast("string").alias("style"), (F.col("vec_id") % 20 + 0.5).cast("double").alias("abv"), F.col("embedding").alias("vector"))
    first = e.groupBy(F.col("label").alias("family")).agg(F.min_by("embedding", "vec_id").alias("vector"))
    return items, first.select("family", F.concat(F.lit("family "), F.col("family").cast("string")).alias("style"), "vector")


@query("prf_affinities", f"with {_EVENTS}, {_SIGNALS}, {_LOOKS}, {_ALL} select user_id, label::varchar style, round(round(greatest(-1, least(1, avg(w))), 9), 3)::double affinity from al join embeddings on vec_id = product group by 1, 2")
def prf_affinities(spark, d):
    e = _bound(spark, d)
    return profiles.style_affinities(profiles.all_signals(_signals(e), _looks(e)), _items(spark, d)[0])


@query("prf_recent", f"with {_EVENTS} select user_id, product, row_number() over (partition by user_id order by seq desc) rank from (select user_id, product, max(seq) seq from ev where t = 'view' group by 1, 2) qualify rank <= 12")
def prf_recent(spark, d):
    return profiles.latest_list(_bound(spark, d).where("t = 'view'"), "product", 12)


# ---- ranked lists

_P = f"""p as (select p.id, coalesce(p.name, '') as name, m.name maker, p.sensory s, p.category, p.src, coalesce(json_extract_string(g.record, '$.sensory.confidence')::double, 0) conf, p.src is not null and p.src <> 'style_prior' known,
    case when p.src in ('review_consensus', 'reconciled') then 0 when p.src in ('llm_profile', 'chemistry_prior') and json_extract_string(g.record, '$.sensory.confidence')::double >= 0.45 then 1 else 2 end tier
    from ({PRODUCTS}) p join gold g on g.id = p.id left join (select id, name from gold where entity_type = 'producer') m on m.id = p.producer_id where p.sensory is not null and len(list_filter(p.sensory, lambda x: x is null)) = 0 and len(list_filter(p.sensory, lambda x: x <> 0)) > 0)"""
_IDEAL = "u as (select category user_id, list(a order by i) ideal from (select category, i, round(avg(x), 6) a from (select category, unnest(s) x, generate_subscripts(s, 1) i from p where known) group by 1, 2) group by 1)"
_SEEN = "seen as (select id_a id, count(*) n from match_pairs where id_a is not null group by 1)"
_KIND = "(?i)\\b(tequila|mezcal|mescal|rum|ron|rhum|cacha[cç]a|vodka|gin|whisky|whiskey|scotch|bourbon|rye|soju|shochu|baijiu|sake|agave|spirit|spirits|liqueur|beer|ale|lager|stout|ipa|cider|blanco|plata|plato|silver|white|joven|reposado|a[ñn]ejo|cristalino|gold|dark|light|aged|old|extra|spiced|flavou?red|single|malt|blend|blended|straight|premium|proof|pure|dry|kentucky|tennessee|irish|japanese|canadian|american|london|caribbean|100|de|of|the|and|y)\\b"
_TRADE = "(?i)\\b(brewing|brewery|brewers|distillery|distilling|co\\.?|company|inc\\.?|llc|ltd\\.?)\\b"
_NAMED = f"""pn as (select *, case when length(regexp_replace(lower(regexp_replace(name, '{_KIND}', ' ', 'g')), '[^a-z0-9]', '', 'g')) < 3 then 2 when contains(name, ' ,') then 1 else 0 end legible,
     case when short <> '' and lower(short) <> lower(maker) then regexp_replace(b1, '(?i)\\b' || regexp_escape(short) || '\\b', ' ', 'g') else b1 end b2 from (select *, trim(regexp_replace(maker, '{_TRADE}', ' ', 'g')) short, case when maker <> '' then regexp_replace(name, '(?i)\\b' || regexp_escape(maker) || '\\b', ' ', 'g') else name end b1 from p)),
  pp as (select *, case when trim(regexp_replace(b2, '\\s+', ' ', 'g')) = '' then name else trim(regexp_replace(b2, '\\s+', ' ', 'g')) end plain from pn)"""
_COS = "list_dot_product({0}, {1}) / sqrt(list_dot_product({0}, {0}) * list_dot_product({1}, {1}))"


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    m = entities(spark, d, "producer").select(F.col("id").alias("producer_id"), F.col("name").alias("maker"))
    p = products(spark, d).withColumnRenamed("src", "source")
    conf = entities(spark, d, "product").select("id", F.get_json_object("record", "$.sensory.confidence").cast("double").alias("confidence"))
    known = F.col("source").isNotNull() & (F.col("source") != "style_prior")
    whole = F.col("sensory").isNotNull() & ~F.exists("sensory", lambda x: x.isNull()) & V.usable(F.col("sensory"))
    return p.where(whole).join(m, "producer_id", "left").join(conf, "id").select("id", "name", "maker", "sensory", "category", "source", "confidence", known.alias("known"))


def _ideals(p: DataFrame) -> DataFrame:
    a = p.where("known").select("category", F.posexplode("sensory").alias("i", "x")).groupBy("category", "i").agg(F.round(F.avg("x"), 6).alias("a"))
    return a.groupBy(F.col("category").alias("user_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda v: v["a"]).alias("ideal"))


def _seen(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "match_pairs").where("id_a is not null").groupBy(F.col("id_a").alias("id")).agg(F.count("*").alias("n"))


@query("rnk_catalog", f"""with {_P}, {_IDEAL}, {_SEEN}, {_NAMED}, v as (select s, min(id) filter (where known) fk from p group by 1), c as (select user_id, s, fk, round({_COS.format("u.ideal", "v.s")}, 9) c from u, v),
  nk as (select user_id, s, c from c where fk is not null qualify row_number() over (partition by user_id order by c desc, fk) <= 30), mem as (select s, id from p where known qualify row_number() over (partition by s order by length(name), name, id) <= 16),
  ra as (select user_id, id, c from c join p using (s) qualify row_number() over (partition by user_id order by c desc, id) <= 30), pool as (select user_id, id, c from nk join mem using (s) union select user_id, id, c from ra),
  e as (select pool.user_id, pp.id, pp.name, pp.s, pp.tier, pp.conf, pp.legible, pp.plain, case when pp.category = pool.user_id then coalesce(seen.n, 0) else 0 end n, pp.category = pool.user_id and d.gold_id is not null judged, round(greatest(0, least(1, 0.5 + 0.5 * c)), 3) score
     from pool join pp using (id) left join seen using (id) left join (select distinct gold_id from dup_groups) d on d.gold_id = id),
  g as (select *, case when score >= 0.8 then 0 when score >= 0.6 then 1 else 2 end band, bool_or(judged) over (partition by user_id, s) bad from e),
  st as (select * from g where not bad qualify row_number() over (partition by user_id, s order by band, -n, tier, -score, -conf, legible, len(string_split(plain, ' ')), length(plain), name, id) = 1)
  select user_id, row_number() over (partition by user_id order by band, -n, tier, -score, -conf, name, id) rank, id, score::double score, ['rated', 'known', 'guessed'][tier + 1] evidence from st qualify rank <= 10""")
def rnk_catalog(spark, d):
    p = _ranked(spark, d)
    own = p.select("id", F.col("category").alias("user_id"))
    judged = table(spark, d, "dup_groups").select(F.col("gold_id").alias("id")).distinct().join(own, "id")
    return ranking.rank_catalog(_ideals(p), p, _seen(spark, d).join(own, "id"), judged, 10)


@query("rnk_shelves", f"""with {_P}, {_IDEAL}, {_SEEN}, me as (select ideal from u where user_id = 'beer'), r as (select category shelf, id, s, {_COS.format("s", "ideal")} cos, category = 'beer' rated_in, category = 'cider' is_cross, tier, conf, name from p, me where category is not null),
  pl as (select *, row_number() over (partition by shelf order by case when rated_in or is_cross then -round(cos, 9) else 0 end, tier, conf desc, name, id) place from r qualify place <= 24),
  o as (select pl.*, coalesce(n, 0) n from pl left join seen using (id) where id not in (select gold_id from dup_groups where gold_id is not null)), f as (select * from o qualify row_number() over (partition by shelf, s order by n desc, place) = 1)
  select shelf, row_number() over (partition by shelf order by n desc, place) rank, id, case when rated_in then 'yours' when is_cross then 'cross' else 'unrated' end basis, case when rated_in or is_cross then round(greatest(0, least(1, 0.5 + 0.5 * cos)), 3)::double end score from f qualify rank <= 6""")
def rnk_shelves(spark, d):
    p = _ranked(spark, d)
    ideal = _ideals(p).where("user_id = 'beer'").select("ideal").scalar()
    tier = ranking.evidence_tier(F.col("source"), F.col("confidence"))
    r = p.where("category is not null").withColumn("ideal", ideal).select(F.col("category").alias("shelf"), "id", "sensory", V.cosine(F.col("sensory"), F.col("ideal")).alias("cos"), (F.col("category") == "beer").alias("rated_in"), (F.col("category") == "cider").alias("cross"), tier.alias("tier"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("name", F.lit("")).alias("name"))
    toward = F.when(F.col("rated_in") | F.col("cross"), -F.round("cos", 9)).otherwise(0.0)
    placed = r.withColumn("place", F.row_number().over(Window.partitionBy("shelf").orderBy(toward, "tier", F.desc("confidence"), "name", "id"))).where("place <= 24")
    return ranking.rank_shelves(placed, _seen(spark, d), table(spark, d, "dup_groups").select(F.col("gold_id").alias("id")), 6)
