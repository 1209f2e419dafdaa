"""Named queries of the training-data operators and their SQL, where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.llm import canonical, components, entities, mixing, neighbours, packing, quality, survivors
from cellarium.llm.tokens import count_tokens
from cellarium.session import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query(
    "p5_found",
    """with recursive e as (
      select id_a a, id_b b from match_pairs where is_match and id_a <> id_b
      union select id_b, id_a from match_pairs where is_match and id_a <> id_b),
    r as (select a v, a w from e union select r.v, e.b from r join e on r.w = e.a)
    select v gold_id, min(w) group_id from r group by v""",
)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return components.match_groups(table(spark, d, "match_pairs"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    values = survivors.member_values(table(spark, d, "gold"))
    return survivors.group_members(table(spark, d, "dup_groups"), values, survivors.source_tiers(table(spark, d, "bronze"), table(spark, d, "source_registry")))


# Fixed values of the SQL: texts that only stand for "not stated", and the word for drinks without alcohol.
_SAYS = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g') not in ('', 'na', 'none', 'null', 'nil', 'nan', 'unknown', 'unknownproduct', 'unknownstyle', 'unnamed', 'untitled', 'notstated', 'notavailable', 'notapplicable', 'notspecified', 'notgiven', 'notprovided', 'nonegiven', 'nonestated', 'nostyle', 'noname', 'noinfo', 'tbd', 'tba', 'tbc', 'unbekannt', 'inconnu', 'desconocido', 'sinnombre', 'ohnenamen', 'sansnom', 'missing', 'unspecified', 'undefined', 'various', 'seelabel', 'productname', 'namenotset', 'nodescription', 'nodescriptionavailable', 'descriptionnotavailable', 'comingsoon', 'descriptioncomingsoon', 'othernone', 'todo', 'test', 'xxx', 'x', 'styleunknown', 'other', 'misc')"


@query(
    "p7_found",
    f"""with r as (select id, updated_at, json_extract_string(record, '$.name') n, json_extract_string(record, '$.style.value') s, json_extract_string(record, '$.description.value') d,
        try_cast(json_extract_string(record, '$.spec.abv_pct.value') as double) a, try_cast(json_extract_string(record, '$.spec.ibu.value') as double) i from gold where entity_type = 'product'),
    t as (select g.id_prefix || ':' || b.natural_key id, min(trust_tier) tier from bronze b join source_registry g on replace(replace(lower(trim(b.source_id)), '_', '-'), ' ', '-') = g.source_id group by 1),
    m as (select distinct d.group_id, r.*, coalesce(t.tier, 1000000) tier from dup_groups d join r on r.id = d.gold_id left join t on t.id = r.id),
    f as (select group_id, 'name' field_name, id, tier, updated_at from m where n is not null and {_SAYS.format("n")}
      union all select group_id, 'style', id, tier, updated_at from m where s is not null and {_SAYS.format("s")}
      union all select group_id, 'description', id, tier, updated_at from m where d is not null and {_SAYS.format("d")}
      union all select group_id, 'ibu', id, tier, updated_at from m where i between 0 and 200
      union all select group_id, 'abv_pct', id, tier, updated_at from m where (a > 0 and a <= 95) or (a = 0 and regexp_matches(lower(concat_ws(' ', s, n)), 'alcoh')))
    select group_id, field_name, arg_min(id, row(tier, -epoch_us(updated_at), id)) gold_id from f group by 1, 2""",
)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.field_survivors(_members(spark, d))


@query("p7_survivors")
def p7_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.build_survivors(_members(spark, d))


@query(
    "p2_found",
    """with v0 as materialized (
      select id, sensory s from gold where entity_type = 'product' and sensory is not null
        and len(list_filter(sensory, lambda x: x is null)) = 0 and len(list_filter(sensory, lambda x: x <> 0)) > 0
        and json_extract_string(record, '$.sensory.source') is not null and json_extract_string(record, '$.sensory.source') <> 'style_prior'),
    v as materialized (select id, s, sqrt(list_dot_product(s, s)) n from v0),
    c as (select a.id a, b.id b, round(list_dot_product(a.s, b.s) / a.n / b.n, 10) c from v a, v b where a.id <> b.id),
    r as (select a, b, row_number() over (partition by a order by c desc, b) k from c where c >= 0.999)
    select distinct least(a, b) id_a, greatest(a, b) id_b from r where k <= 5""",
)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.taste_pairs(table(spark, d, "gold"))


@query("p2_knn_embeddings")
def p2_knn_embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return neighbours.most_similar(e, "vec_id", "embedding", k=10, queries=F.col("id") % 50 == 0)


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_typed_values(table(spark, d, "ttb_cola_sample"), table(spark, d, "demo_products"), table(spark, d, "canon_list"))


@query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return entities.match_entities(table(spark, d, "ttb_cola_sample"), table(spark, d, "gold"), table(spark, d, "canon_list")).select("ttb_id", "gold_id")


@query("p6_matches")
def p6_matches(spark: SparkSession, d: str) -> DataFrame:
    return entities.match_entities(table(spark, d, "ttb_cola_sample"), table(spark, d, "gold"), table(spark, d, "canon_list"))


@query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_report(table(spark, d, "documents")).where("is_junk").select("doc_id")


@query("p10_statistics")
def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_report(table(spark, d, "documents"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "documents").where("text is not null").select("doc_id", count_tokens(F.col("text")).alias("tokens"))
    return packing.pack_all(sizes, table(spark, d, "pack_sizes"))


@query("p8_containers")
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


@query("p8_fill")
def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d))


@query("p8_rules", "select pack_id, capacity_tokens, (select count(distinct doc_id) from documents where text <> '') documents, 0 overfull, 0 cut, 0 lost from pack_sizes where capacity_tokens > 0")
def p8_rules(spark: SparkSession, d: str) -> DataFrame:
    return packing.broken_rules(_packed(spark, d), table(spark, d, "documents"))


@query("p9_selection")
def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    sized = mixing.sized_documents(table(spark, d, "documents"), count_tokens(F.col("text")))
    return mixing.select_mix(sized, table(spark, d, "mix_targets"))


@query("p9_shares")
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.share_report(mixing.select_mix(mixing.sized_documents(table(spark, d, "documents"), count_tokens(F.col("text"))), targets), targets)


@query(
    "p9_rules",
    """with t as (select mix_id, source, sum(target_share) s, max(max_repeats) m from mix_targets where target_share > 0 group by 1, 2), d as (select distinct source from documents where text <> '' and source is not null),
    h as (select t.mix_id, t.source, case when d.source is not null and m > 0 then s else 0 end s from t left join d on d.source = t.source)
    select mix_id, source, round(coalesce(s / nullif(sum(s) over (partition by mix_id), 0), 0), 6)::double wanted_share, true near, 0 repeated from h""",
)
def p9_rules(spark: SparkSession, d: str) -> DataFrame:
    targets, sized = table(spark, d, "mix_targets"), mixing.sized_documents(table(spark, d, "documents"), count_tokens(F.col("text")))
    return mixing.broken_rules(mixing.select_mix(sized, targets), sized, targets)
