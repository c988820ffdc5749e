"""Registries, ledgers, alias graphs, drift and candidates over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalens.functions import text as T
from stratalens.operators import findings, graph, history, ledger, registry
from stratalens.plans.catalog import Tables, query


@query("""
with r as (select c_mktsegment || '|' || floor(c_acctbal / 100)::bigint::varchar as id_value, 'F' || c_nationkey::varchar as figi, 'n' || c_nationkey::varchar as row_id from customer),
k as (select o_orderkey, case when o_orderstatus = 'F' then 'BUILDING' else 'MACHINERY' end || '|' || floor(o_totalprice / 5000)::bigint::varchar as id_value from orders)
select o_orderkey, case when count(row_id) = 0 then 'missing' when count(distinct figi) > 1 then 'ambiguous' when count(row_id) > count(distinct row_id) then 'duplicate_identical' else 'resolved' end as status,
    count(distinct row_id) as n_candidates
from k left join r using (id_value) group by o_orderkey
""")
def registry_exact_lookup(spark, root):
    t = Tables(spark, root)
    table = t.customer.select(F.concat_ws("|", "c_mktsegment", F.floor(F.col("c_acctbal") / 100).cast("string")).alias("id_value"), F.concat(F.lit("F"), "c_nationkey").alias("figi"), F.concat(F.lit("n"), "c_nationkey").alias("row_id"))
    kind = F.when(F.col("o_orderstatus") == "F", "BUILDING").otherwise("MACHINERY")
    keys = t.orders.select("o_orderkey", F.concat_ws("|", kind, F.floor(F.col("o_totalprice") / 5000).cast("string")).alias("id_value"))
    return registry.resolve(keys, table, ["o_orderkey"], ["id_value"]).select("o_orderkey", "status", F.size("candidates").cast("bigint").alias("n_candidates"))


@query("""
with r as (
    select 'order' as id_type, o_orderkey as id_value, 'O' || o_custkey::varchar as figi, 'o' || o_orderkey::varchar as row_id from orders where o_orderstatus = 'P'
    union all select 'part', p_partkey, 'P' || p_brand, 'p' || p_partkey::varchar from part where p_size > 25
    union all select 'supplier', s_suppkey, 'S' || s_suppkey::varchar, 's' || s_suppkey::varchar from supplier where s_acctbal > 0),
k as (
    select distinct l_orderkey, l_partkey, l_suppkey from lineitem),
hit as (
    select l_orderkey, l_partkey, l_suppkey, case when o.row_id is not null then 'order' when p.row_id is not null then 'part' when s.row_id is not null then 'supplier' end as id_type,
        coalesce(o.figi, p.figi, s.figi) as figi
    from k left join r o on o.id_type = 'order' and o.id_value = l_orderkey left join r p on p.id_type = 'part' and p.id_value = l_partkey left join r s on s.id_type = 'supplier' and s.id_value = l_suppkey)
select l_orderkey, l_partkey, l_suppkey, coalesce(id_type, 'none') as id_type, coalesce(figi, '') as figi from hit
""")
def registry_precedence_lookup(spark, root):
    t = Tables(spark, root)
    part = lambda kind, value, figi, row: F.struct(F.lit(kind).alias("id_type"), value.alias("id_value"), figi.alias("figi"), row.alias("row_id"))
    sides = [
        t.orders.where("o_orderstatus = 'P'").select(part("order", F.col("o_orderkey"), F.concat(F.lit("O"), "o_custkey"), F.concat(F.lit("o"), "o_orderkey")).alias("r")),
        t.part.where("p_size > 25").select(part("part", F.col("p_partkey"), F.concat(F.lit("P"), "p_brand"), F.concat(F.lit("p"), "p_partkey")).alias("r")),
        t.supplier.where("s_acctbal > 0").select(part("supplier", F.col("s_suppkey"), F.concat(F.lit("S"), "s_suppkey"), F.concat(F.lit("s"), "s_suppkey")).alias("r")),
    ]
    table = sides[0].union(sides[1]).union(sides[2]).select("r.*")
    # dealt by order first, which serves the distinct rows and the first join
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey").repartition("l_orderkey").distinct()
    found = registry.by_columns(rows, table, [("order", "l_orderkey"), ("part", "l_partkey"), ("supplier", "l_suppkey")])
    hit = F.col("status") != "missing"
    return found.select(*rows.columns, F.when(hit, F.col("id_type")).otherwise("none").alias("id_type"), F.coalesce(F.try_element_at("candidates", F.lit(1))["figi"], F.lit("")).alias("figi"))


@query("""
with r as (select p_partkey as row_id, p_brand || p_size::varchar as figi, p_name, p_brand, p_type, p_size from part where p_size > 25),
m as (
    select p.p_partkey, 1 as tier, r.row_id, r.figi from part p join r on r.p_name = p.p_name and r.p_size = p.p_size and r.p_brand = p.p_brand
    union all select p.p_partkey, 2, r.row_id, r.figi from part p join r on r.p_name = p.p_name and r.p_size = p.p_size
    union all select p.p_partkey, 3, r.row_id, r.figi from part p join r on r.p_type = p.p_type),
b as (select p_partkey, min(tier) as tier from m group by p_partkey)
select p_partkey, b.tier, case when count(distinct figi) > 1 then 'ambiguous' when count(*) > count(distinct row_id) then 'duplicate_identical' else 'resolved' end as status, count(distinct row_id) as n_candidates
from m join b using (p_partkey) where m.tier = b.tier group by all
""")
def registry_tiered_lookup(spark, root):
    """The name with size and brand, the name with size, the type; the last has few keys, each resolved once."""
    part = Tables(spark, root).part
    r = part.where("p_size > 25").select(F.col("p_partkey").alias("row_id"), F.concat("p_brand", F.col("p_size").cast("string")).alias("figi"), "p_name", "p_brand", "p_type", "p_size")
    tiers = [(c, c) for c in (["p_name", "p_size", "p_brand"], ["p_name", "p_size"], ["p_type"])]
    return registry.tiered_keys(part, r, ["p_partkey"], tiers).select("p_partkey", "tier", "status", "n_candidates")


@query("select l_orderkey, count(*) as n from lineitem where not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus = 'F') group by l_orderkey")
def manifest_unmatched(spark, root):
    t = Tables(spark, root)
    done = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.select("l_orderkey").join(done, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""
select c_custkey, case when c_custkey % 7 = 0 then 'figi' when c_custkey % 5 = 0 then 'cusip' when c_custkey % 3 = 0 then 'isin' when c_custkey % 2 = 0 then 'ticker' when c_acctbal > 0 then 'weak_descriptive' else 'absent' end as basis_type,
    case when c_custkey % 7 = 0 or c_custkey % 5 = 0 or c_custkey % 3 = 0 then c_name when c_custkey % 2 = 0 then c_mktsegment else '' end as basis_value
from customer
""")
def strongest_basis(spark, root):
    k = F.col("c_custkey")
    ids = F.struct(
        *(F.when(k % m == 0, F.col("c_name")).otherwise("").alias(n) for n, m in (("figi", 7), ("cusip", 5), ("isin", 3))), F.lit("").alias("sedol"),
        F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("ticker"), F.lit(None).cast("array<struct<id_type:string,value:string>>").alias("others"),
    )
    rows = Tables(spark, root).customer.select("c_custkey", ledger.basis(ids, F.col("c_acctbal") > 0).alias("b"))
    return rows.select("c_custkey", "b.basis_type", "b.basis_value")


@query("select event_id, user_id from (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as r from events) where r <= 50")
def ledger_scope_cap(spark, root):
    kept, _ = ledger.cap_rows(Tables(spark, root).events.select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"], 50)
    return kept.select("event_id", "user_id")


FIRST_LAST = "select o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) as before, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) as after, count(*) as n from orders group by o_custkey"


@query(f"select o_custkey, before, after, n from ({FIRST_LAST}) where n > 1 and before <> after")
def basis_transition(spark, root):
    at = F.struct("o_orderdate", "o_orderkey")
    rows = Tables(spark, root).orders.groupBy("o_custkey").agg(F.min_by("o_orderpriority", at).alias("before"), F.max_by("o_orderpriority", at).alias("after"), F.count("*").alias("n"))
    return rows.where("n > 1 and before <> after")


@query("""
select user_id from (
    select user_id, min(case when event_type = 'purchase' then ts end) as first_strong, max(case when event_type <> 'purchase' then ts end) as last_weak from events group by user_id)
where first_strong < last_weak
""")
def strong_removed(spark, root):
    strong = F.col("event_type") == "purchase"
    rows = Tables(spark, root).events.groupBy("user_id").agg(F.min(F.when(strong, F.col("ts"))).alias("s"), F.max(F.when(~strong, F.col("ts"))).alias("w"))
    return rows.where("s < w").select("user_id")


@query("""
select c_mktsegment, c_nationkey, count(*) as n, count(distinct cast(floor(c_acctbal / 3000) as bigint)) as n_classes
from customer group by all having count(*) > 1 and count(distinct cast(floor(c_acctbal / 3000) as bigint)) > 1
""")
def weak_collision(spark, root):
    rows = Tables(spark, root).customer.select("c_mktsegment", "c_nationkey", F.floor(F.col("c_acctbal") / 3000).alias("c"))
    return rows.groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.count_distinct("c").alias("n_classes")).where("n > 1 and n_classes > 1")


@query()
def alias_components(spark, root):
    """Components of orders and parts over all rows of lineitem; most of them are one component, for which SQL's recursion is too slow."""
    items = Tables(spark, root).lineitem.where("l_orderkey is not null and l_partkey is not null")
    edges = items.select(F.concat(F.lit("o"), "l_orderkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b")).distinct()
    return graph.components(edges, "a", "b")


@query("select o_orderkey, o_orderpriority from (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as r from orders) where r <= 100")
def event_caps(spark, root):
    kept, _ = ledger.cap_rows(Tables(spark, root).orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority"], [F.desc("o_totalprice"), "o_orderkey"], 100)
    return kept.select("o_orderkey", "o_orderpriority")


CANDIDATE_SQL = """
with o as (
    select o_custkey, count(distinct date_trunc('month', o_orderdate)) as n_periods, max(cast(o_orderdate as date)) as newest, max(o_totalprice) as top,
        count(distinct o_orderpriority) as n_priorities, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) as before, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) as after,
        bool_or(o_orderstatus = 'P') as ambiguous
    from orders group by o_custkey),
s as (
    select o_custkey as c_custkey, n_periods, newest,
        (case when before <> after then 1000 else 0 end + case when ambiguous then 900 else 0 end + case when c_acctbal < 0 then 800 else 0 end + case when n_priorities > 3 then 700 else 0 end
        + 400 + n_periods * 10 + least(cast(floor(top / 10000) as bigint), 99))::bigint as score
    from o join customer on c_custkey = o_custkey)
select c_custkey, score, n_periods, newest, row_number() over (order by score desc, n_periods desc, newest desc, c_custkey) as rank from s
"""


@query(CANDIDATE_SQL)
def candidate_rank(spark, root):
    from stratalens.plans.scan import ranked, score

    t = Tables(spark, root)
    at = F.struct("o_orderdate", "o_orderkey")
    o = t.orders.groupBy("o_custkey").agg(
        F.count_distinct(F.date_trunc("month", "o_orderdate")).alias("n_periods"), F.max(F.col("o_orderdate").cast("date")).alias("newest"), F.max("o_totalprice").alias("top"),
        F.count_distinct("o_orderpriority").alias("n_priorities"), F.min_by("o_orderpriority", at).alias("before"), F.max_by("o_orderpriority", at).alias("after"), F.bool_or(F.col("o_orderstatus") == "P").alias("ambiguous"),
    )
    rows = o.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey")
    codes = F.array_compact(F.array(
        F.when(F.col("before") != F.col("after"), F.lit("registry_bridge_available")), F.when(F.col("ambiguous"), F.lit("registry_bridge_ambiguous")),
        F.when(F.col("c_acctbal") < 0, F.lit("strong_identifier_removed")), F.when(F.col("n_priorities") > 3, F.lit("weak_key_temporal_collision")), F.lit("weak_continuity_only"),
    ))
    value = F.least(F.floor(F.col("top") / 10000), F.lit(99))
    rows = rows.withColumn("score", score(codes, F.col("n_periods"), value))
    out = ranked(rows, [F.desc("score"), F.desc("n_periods"), F.desc("newest"), F.col("o_custkey")])
    return out.select(F.col("o_custkey").alias("c_custkey"), "score", "n_periods", "newest", "rank")


@query("""
select o_custkey, coalesce(arg_min(s, r), '') as status from (
    select o_custkey, case o_orderstatus when 'P' then 'ambiguous' when 'F' then 'resolved' else 'missing' end as s, case o_orderstatus when 'P' then 0 when 'F' then 1 else 3 end as r from orders) group by o_custkey
""")
def dominant_status(spark, root):
    status = T.mapped(F.col("o_orderstatus"), {"P": "ambiguous", "F": "resolved"}, F.lit("missing"))
    return Tables(spark, root).orders.groupBy("o_custkey").agg(registry.dominant_status(status).alias("status"))


@query("""
with ranked as (
    select o_orderkey, o_custkey, lag(o_orderkey) over w as prior_order, lag(cast(o_orderdate as date)) over w as prior_date from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey))
select o_orderkey, o_custkey, prior_order, prior_date from ranked where prior_order is not null
""")
def prior_snapshot_asof(spark, root):
    rows = Tables(spark, root).orders.select("o_orderkey", "o_custkey", "o_orderdate")
    out = history.prior(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderdate"]).where("prior_o_orderkey is not null")
    return out.select("o_orderkey", "o_custkey", F.col("prior_o_orderkey").alias("prior_order"), F.col("prior_o_orderdate").cast("date").alias("prior_date"))


@query("""
select a.o_orderkey, arg_max(b.o_orderkey, (b.o_orderdate, b.o_orderkey)) as comparator
from orders a join orders b on a.o_custkey = b.o_custkey and quarter(a.o_orderdate) = quarter(b.o_orderdate) and year(b.o_orderdate) < year(a.o_orderdate)
group by a.o_orderkey
""")
def same_quarter_prior_year(spark, root):
    rows = Tables(spark, root).orders.select("o_custkey", F.quarter("o_orderdate").alias("q"), F.year("o_orderdate").alias("y"), "o_orderkey", "o_orderdate")
    # the newest order of each customer, quarter and year before: a running maximum over years
    best = rows.groupBy("o_custkey", "q", "y").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"))
    w = Window.partitionBy("o_custkey", "q").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("prior", F.max("m").over(w)).where("prior is not null").select("o_custkey", "q", "y", F.col("prior.o_orderkey").alias("comparator"))
    return rows.join(best, ["o_custkey", "q", "y"]).select("o_orderkey", "comparator")


@query("""
select o_custkey, o_orderkey, pos - 1 as pos from (
    select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as pos from orders) where pos between 2 and 6
""")
def history_window_5(spark, root):
    rows = Tables(spark, root).orders.select("o_custkey", "o_orderkey", "o_orderdate")
    out = history.window(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], history.WINDOW + 1).where("pos > 1")
    return out.select("o_custkey", "o_orderkey", (F.col("pos") - 1).alias("pos"))


@query("""
select o_custkey, string_agg(o_orderstatus || '=' || n::varchar, '|' order by o_orderstatus) as histogram from (
    select o_custkey, o_orderstatus, count(*) as n from orders group by all) group by o_custkey
""")
def status_histogram(spark, root):
    counts = Tables(spark, root).orders.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("o_orderstatus", "n")))
    return counts.groupBy("o_custkey").agg(F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["o_orderstatus"], p["n"].cast("string"))), "|").alias("histogram"))


@query("select c_nationkey, arg_min(c_custkey, (case c_mktsegment when 'BUILDING' then 1 when 'MACHINERY' then 4 else 99 end, c_mktsegment, c_custkey)) as winner from customer group by c_nationkey")
def priority_winner(spark, root):
    rows = Tables(spark, root).customer.select("c_nationkey", "c_custkey", "c_mktsegment", T.mapped(F.col("c_mktsegment"), {"BUILDING": "P001", "MACHINERY": "P002"}, F.lit("P999")).alias("pattern_id"))
    rows = rows.withColumn("finding_id", F.concat_ws("-", "c_mktsegment", F.lpad(F.col("c_custkey").cast("string"), 12, "0")))
    rank = F.struct(findings.priority(F.col("pattern_id")), F.col("finding_id"))
    return rows.groupBy("c_nationkey").agg(F.min_by("c_custkey", rank).alias("winner"))
