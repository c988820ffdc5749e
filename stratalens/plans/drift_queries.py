"""The drift ledger and the ranked scan as they are, over observations made of all orders.

An order is an observation of its customer's scope. Urgent orders report a figi, high ones a cusip, medium ones a ticker, all by customer; others report
nothing. Orders that are pending share one description, others have their customer's: one weak group is hot. No observation has two strong
keys, so that a chain is a key and SQL needs no recursion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.operators import ledger
from stratalens.plans import scan
from stratalens.plans.catalog import Tables, query
from stratalens.streaming import timeline


def order_observations(spark: SparkSession, root: str) -> DataFrame:
    o = Tables(spark, root).orders
    text = lambda c: F.col(c).cast("string")
    only = lambda start, value: F.when(F.col("o_orderpriority").startswith(start), value).otherwise("")
    ids = F.struct(only("1", F.concat(F.lit("F"), text("o_custkey"))).alias("figi"), only("2", F.concat(F.lit("C"), text("o_custkey"))).alias("cusip"), F.lit("").alias("isin"), F.lit("").alias("sedol"), only("3", F.concat(F.lit("T"), text("o_custkey"))).alias("ticker"), F.array().cast("array<struct<id_type:string,value:string>>").alias("others"))
    title = F.when(F.col("o_orderstatus") == "P", F.lit("pending")).otherwise(F.concat(F.lit("customer "), text("o_custkey")))
    weak = F.array(F.struct(F.lit("title_or_description").alias("key"), title.alias("value")))
    return o.select(
        F.sha2(text("o_orderkey"), 256).alias("observation_id"), F.concat(F.lit("c"), text("o_custkey")).alias("scope_key"), F.lit("csv").alias("source_family"), F.lit("orders").alias("source_adapter"),
        F.concat(F.lit("o"), text("o_orderkey")).alias("source_id"), F.lit("").alias("accession"), F.concat(F.lit("o"), text("o_orderkey")).alias("source_record_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("report_period"),
        F.lit("").alias("filed_date"), F.col("o_orderkey").cast("bigint").alias("ordinal"), F.array(F.lit("orders")).alias("paths"), ids.alias("ids"), weak.alias("weak"),
    )


#: Fields of a signature as name=value with separators inside values escaped; an order's observation, its groups, and the events of both.
EVENTS = """
with obs as (
    select sha256(o_orderkey::varchar) as id, 'c' || o_custkey::varchar as scope, 'o' || o_orderkey::varchar as source, strftime(o_orderdate, '%Y-%m-%d') as period, o_orderkey as ordinal,
        case left(o_orderpriority, 1) when '1' then 'figi' when '2' then 'cusip' else '' end as kind,
        case left(o_orderpriority, 1) when '1' then 'F' || o_custkey::varchar when '2' then 'C' || o_custkey::varchar else '' end as value,
        case when left(o_orderpriority, 1) = '3' then 'T' || o_custkey::varchar else '' end as ticker,
        case when o_orderstatus = 'P' then 'pending' else 'customer ' || o_custkey::varchar end as title
    from orders),
refs as (
    select *, case when kind <> '' then 'key_type=' || kind || ';source=reported;value=' || value else '' end as sig,
        'basis_type=' || case when kind <> '' then kind || ';basis_value=' || value when ticker <> '' then 'ticker;basis_value=' || ticker else 'weak_descriptive' end as basis,
        'P009:weak|' || case when ticker <> '' then 'ticker=' || ticker || ';' else '' end || 'title_or_description=' || title as weak_key
    from obs),
chained as (select *, case when sig <> '' then sha256('v1|P009:chain|' || sig) else '' end as chain_id from refs),
members as (
    select 'chain' as kind_of, chain_id as grp, * from chained where sig <> '' union all select 'weak', weak_key, * from chained),
groups as (
    select kind_of, grp, count(*) as n_refs, max(period) as newest, arg_min(scope, o) as scope_key, arg_min(basis, o) as b, arg_max(basis, o) as a,
        min(case when sig <> '' then o end) as first_keyed, max(case when sig = '' then o end) as last_keyless, count(distinct nullif(chain_id, '')) as n_chains,
        string_agg(id, ',' order by period, source, scope, ordinal, id) as ids,
        list_sort(list_distinct(list(struct_pack(k := kind, v := value, s := sig)) filter (where sig <> ''))) as keys
    from (select *, struct_pack(p := period, s := source, c := scope, n := ordinal, i := id) as o from members) group by all having count(*) > 1),
events as (
    select 'identifier_basis_transition' as codes, 'proven_transition' as class, 2 as rank, 'snapshot_absent' as status, '' as weak_key, grp as chain_id, * exclude (kind_of) from groups where kind_of = 'chain' and a <> b
    union all
    select 'weak_key_temporal_collision', 'weak_collision', 4, '', grp, '', * exclude (kind_of) from groups where kind_of = 'weak' and n_chains > 1
    union all
    select case when first_keyed < last_keyless then 'strong_identifier_removed,' else '' end || 'weak_continuity_only', 'weak_unresolved', 5, 'snapshot_absent', grp, '', * exclude (kind_of, keys), [] from groups
    where kind_of = 'weak' and (n_chains = 0 or last_keyless is not null)),
named as (
    select *, sha256('v1|P009:event|basis_after=' || replace(a, '=', '%3D') || ';basis_before=' || replace(b, '=', '%3D') || case when chain_id <> '' then ';chain_id=' || chain_id else '' end
        || ';continuity_class=' || class || case when len(keys) > 0 then ';identity_keys=' || replace(array_to_string(list_transform(keys, lambda k: k.s), ','), '=', '%3D') else '' end
        || ';issue_codes=' || codes || ';observation_ids=' || ids || case when status <> '' then ';registry_status=' || status else '' end || ';source_scope_key=' || scope_key
        || case when weak_key <> '' then ';weak_key=' || replace(replace(weak_key, '|', '%7C'), '=', '%3D') else '' end) as event_id
    from events),
kept as (
    select * from (select *, row_number() over (partition by split_part(codes, ',', 1) order by rank, codes, newest desc, event_id) as r from named) where r <= 1000)
"""


@query(EVENTS + "select event_id, codes as issue_codes, class as continuity_class, scope_key, status as registry_status, weak_key, chain_id, n_refs, len(keys)::bigint as n_keys, newest, b as basis_before, a as basis_after from kept")
def identity_drift_events(spark, root):
    d = ledger.drift_tables(order_observations(spark, root))
    side = lambda c: F.concat(F.lit("basis_type="), F.col(f"{c}.basis_type"), F.when(F.col(f"{c}.basis_value") != "", F.concat(F.lit(";basis_value="), F.col(f"{c}.basis_value"))).otherwise("")).alias(c)
    return d.events.select("event_id", F.array_join("issue_codes", ",").alias("issue_codes"), "continuity_class", "scope_key", "registry_status", "weak_key", "chain_id", "n_refs", "n_keys", "newest", side("basis_before"), side("basis_after"))


@query(EVENTS + "select 'P009-LEDGER-E002' as code, event_id as subject_id, scope_key from named where not exists (select 1 from kept where kept.event_id = named.event_id)")
def identity_drift_diagnostics(spark, root):
    return ledger.drift_tables(order_observations(spark, root)).diagnostics.select("code", "subject_id", "scope_key")


@query(EVENTS + """,
of_event as (
    select k.event_id, m.* from kept k join members m on m.kind_of = case when k.chain_id <> '' then 'chain' else 'weak' end and m.grp = k.grp),
seeds as (
    select event_id, kind, value, '{"id_type":"' || kind || '","observation_ids":[' || string_agg('"' || id || '"', ',' order by id) || '],"value":"' || value || '"}' as s
    from of_event where sig <> '' group by event_id, kind, value),
seed_lists as (select event_id, string_agg(s, ',' order by kind, value) as seeds from seeds group by event_id),
lists as (
    select event_id, count(distinct period) as n_periods, string_agg('"' || id || '"', ',' order by id) as obs_ids, string_agg('"' || source || '"', ',' order by source) as source_ids from of_event group by event_id),
scored as (
    select k.event_id, codes as issue_codes, scope_key as source_scope_key, n_periods, newest,
        (case when contains(codes, 'strong_identifier_removed') then 800 else 0 end + case when contains(codes, 'weak_key_temporal_collision') then 700 else 0 end + case when contains(codes, 'weak_continuity_only') then 400 else 0 end + 10 * n_periods)::bigint as score,
        sha256('v1|P009:scan-candidate|{"continuity_class":"' || class || '","event_ids":["' || k.event_id || '"],"issue_codes":["' || replace(codes, ',', '","') || '"],"observation_ids":[' || obs_ids || '],"seed_identifiers":[' || coalesce(seeds, '')
            || '],"source_ids":[' || source_ids || '],"source_scope_key":"' || scope_key || '"}') as candidate_id
    from kept k join lists using (event_id) left join seed_lists using (event_id))
select *, row_number() over (order by score desc, n_periods desc, newest desc, issue_codes, candidate_id) as rank from scored
""")
def identity_scan(spark, root):
    d = ledger.drift_tables(order_observations(spark, root))
    return scan.ranked_candidates(d).select("event_id", F.array_join("issue_codes", ",").alias("issue_codes"), "source_scope_key", "n_periods", "newest", "score", "candidate_id", F.col("rank").cast("bigint").alias("rank"))


@query("""
with o as (
    select o_custkey, 'c' || o_custkey::varchar as scope_key, strftime(o_orderdate, '%Y-%m-%d') as report_period, 'o' || o_orderkey::varchar as source_id, o_orderkey, sha256(o_orderkey::varchar) as observation_id, o_orderpriority as basis from orders),
l as (select *, lag(basis) over (partition by scope_key order by report_period, source_id, o_orderkey, observation_id) as before from o)
select scope_key, report_period, observation_id, before, basis as after from l where before <> basis
""")
def timeline_transitions(spark, root):
    """The result in which the stream of ``streaming.timeline`` ends."""
    rows = order_observations(spark, root).join(Tables(spark, root).orders.select(F.col("o_orderkey").alias("ordinal"), F.col("o_orderpriority").alias("basis")), "ordinal")
    return timeline.transitions(rows)
