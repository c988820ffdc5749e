"""The library's detectors and the comparator, as they are, over facts, contexts, concepts and filings made of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import anchoring, collapse, detection, facts, history, rules, taxonomy
from stratalens.plans.catalog import Tables, query

SCHEME = "http://entities"
UNIT = "named_struct('id', 'usd', 'measures', array('iso4217:USD'), 'denominators', cast(null as array<string>))"
NO_UNIT = "cast(null as struct<id:string,measures:array<string>,denominators:array<string>>)"


def name(namespace: str, local: str) -> str:
    return f"named_struct('clark', concat('{{', {namespace}, '}}', {local}), 'namespace', {namespace}, 'local_name', {local}, 'prefixed', cast(null as string))"


def line_facts(t: Tables):
    """A fact per line: its part is the filing, its supplier the context's entity, its flag the concept."""
    return t.lineitem.selectExpr(
        "concat('a', l_partkey) as accession", "l_orderkey * 10 + l_linenumber as fact_id", f"{name(repr('urn:t'), 'l_returnflag')} as qname", "cast(cast(l_quantity as bigint) as string) as value", "cast(null as string) as raw_value",
        "true as is_numeric", "false as is_nil", "cast(null as string) as decimals", "cast(null as string) as precision", "cast(null as string) as concept_type", "concat('c', l_suppkey) as context_ref", f"{UNIT} as unit",
    )


def line_contexts(t: Tables):
    rows = t.lineitem.select("l_partkey", "l_suppkey").distinct()
    return rows.selectExpr(
        "concat('a', l_partkey) as accession", "concat('c', l_suppkey) as context_ref", f"'{SCHEME}' as entity_scheme", "concat('s', l_suppkey) as entity_identifier", "'instant' as period_kind", "'2024-12-31' as instant",
        "cast(null as string) as start", "cast(null as string) as `end`", "cast(array() as array<struct<dim:string,kind:string,member:string,typed_value:string>>) as dims",
    )


@query(f"""
with f as (select 'a' || l_partkey as accession, 'v1|P001|{{urn:t}}' || l_returnflag || '|{SCHEME}|s' || l_suppkey || '|instant:2024-12-31||iso4217:USD' as signature, l_quantity::bigint as v from lineitem)
select accession, signature, sha256(signature) as instance_id, count(*) as n_facts from f group by accession, signature having count(*) > 1 and count(distinct v) > 1
""")
def detect_duplicate_facts(spark, root):
    t = Tables(spark, root)
    return facts.detect(line_facts(t), line_contexts(t), "strict").select("accession", "signature", "instance_id", "n_facts")


@query("""
with p as (
    select 'a' || p_brand as accession, 'c' || p_partkey as context_ref, '{urn:p}' || p_name as concept, p_size > 10 as has_unit,
        case when p_type = 'ECONOMY' then 'x' when p_type = 'PROMO' then '2' end as decimals, case when p_size > 15 then p_size end as prec from part),
c as (
    select *, unnest(list_filter([
        case when decimals is not null and prec is not null then 'decimals_precision_conflict' end, case when decimals = 'x' then 'invalid_decimals' end,
        case when prec > 20 then 'invalid_precision' end, case when not has_unit then 'missing_unit' end], lambda x: x is not null)) as issue_code from p)
select accession, context_ref, concept, issue_code, sha256('v1|P004|' || concept || '|' || context_ref || '|' || case when has_unit then 'iso4217:USD' else '' end || '|' || issue_code) as instance_id from c
""")
def detect_fact_rules(spark, root):
    rows = Tables(spark, root).part.selectExpr(
        "concat('a', p_brand) as accession", "p_partkey as fact_id", f"{name(repr('urn:p'), 'p_name')} as qname", "'1' as value", "true as is_numeric", "case p_type when 'ECONOMY' then 'x' when 'PROMO' then '2' end as decimals",
        "case when p_size > 15 then cast(p_size as string) end as precision", "cast(null as string) as concept_type", "concat('c', p_partkey) as context_ref", f"case when p_size > 10 then {UNIT} else {NO_UNIT} end as unit",
    )
    return rules.detect(rows).select("accession", "context_ref", "concept", "issue_code", "instance_id")


@query("""
with u as (select distinct 'o' || l_orderkey as accession, 'http://t/' || l_returnflag as base, year(l_shipdate) || '-01-31' as version, l_linestatus = 'F' as declared from lineitem),
n as (select accession, base || '/' || version as namespace, bool_or(declared) as declared from u group by all),
declaring as (select accession from n group by accession having bool_or(declared)),
missing as (select accession, 'namespace_schema_ref_mismatch' as issue_code, string_agg(namespace, ' ' order by namespace) as details from n semi join declaring using (accession) where not declared group by accession),
v as (select accession, base, string_agg(distinct version, ',' order by version) as versions from u group by all having count(distinct version) > 1)
select * from missing union all select accession, 'mixed_taxonomy_versions', string_agg(base || '=' || versions, ' ' order by base || '=' || versions) from v group by accession
""")
def detect_taxonomy(spark, root):
    t = Tables(spark, root)
    names = t.lineitem.selectExpr("concat('o', l_orderkey) as accession", "concat('http://t/', l_returnflag, '/', year(l_shipdate), '-01-31') as namespace", "l_linestatus = 'F' as declared")
    refs = t.orders.selectExpr("concat('o', o_orderkey) as accession", "'t.xsd' as href")
    found = taxonomy.detect(refs, names.where("declared").select("accession", "namespace").distinct(), names.select("accession", "namespace"))
    return found.select("accession", "issue_code", F.array_join("details", " ").alias("details"))


def part_concepts(t: Tables):
    return t.part.selectExpr(
        "'a' as accession", "concat('{', case when p_type = 'ECONOMY' then 'urn:own' else 'http://fasb.org/us-gaap/2024' end, '}p', p_partkey) as clark",
        "case when p_type = 'ECONOMY' then 'urn:own' else 'http://fasb.org/us-gaap/2024' end as namespace", "p_name as type", "case when p_size > 25 then 'instant' else 'duration' end as period_type", "p_size > 45 as abstract",
        "p_partkey", "p_type", "p_size",
    )


@query("""
with c as (
    select p_partkey as k, '{' || case when p_type = 'ECONOMY' then 'urn:own' else 'http://fasb.org/us-gaap/2024' end || '}p' || p_partkey as clark, p_type = 'ECONOMY' as own, p_name as type, p_size > 25 as instant, p_size > 45 as abstract, p_size from part),
j as (select a.clark, a.own, b.k as target, b.abstract as x1, a.instant <> b.instant as x2, a.type <> b.type as x3, b.own as x4 from c a left join c b on b.k = a.k + 1 and a.p_size > 10 where a.own),
codes as (
    select clark, list_sort(list_distinct(flatten(list([
        case when target is null then 'unanchored' end, case when x1 then 'anchor_target_abstract' end, case when x2 then 'period_type_mismatch' end, case when x3 then 'type_mismatch' end, case when x4 then 'anchor_to_extension' end])))) as l
    from j group by clark)
select clark, array_to_string(list_filter(l, lambda x: x is not null), ',') as issue_codes, sha256('v1|P002|' || clark || '|' || array_to_string(list_filter(l, lambda x: x is not null), ',')) as instance_id
from codes where len(list_filter(l, lambda x: x is not null)) > 0
""")
def detect_anchoring(spark, root):
    """Concepts are parts, those of one type are extensions; an extension's anchor is the part after it, and small ones have none."""
    t = Tables(spark, root)
    concepts = part_concepts(t)
    target = concepts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("clark").alias("to_clark"))
    arcs = concepts.where("p_size > 10").join(target, "p_partkey").select("accession", F.lit(anchoring.ARC_ROLES[0]).alias("arcrole"), F.col("clark").alias("from_clark"), "to_clark")
    shown = concepts.select("accession", F.struct(F.col("clark")).alias("qname"), F.lit("c").alias("context_ref"), F.lit("1").alias("value"))
    return anchoring.detect(concepts.drop("p_partkey", "p_type", "p_size"), arcs, shown).select("clark", F.array_join("issue_codes", ",").alias("issue_codes"), "instance_id")


def customer_securities(t: Tables):
    """Notes by customer: the nation is the filing, the customer the context, the segment the symbol."""
    rows = t.customer.selectExpr("concat('n', c_nationkey) as accession", "concat('c', c_custkey) as context_ref", "explode(array(named_struct('l', 'Security12bTitle', 'v', concat(1 + cast(abs(c_acctbal) / 1000 as bigint), '.125% Notes due ', 2030 + length(c_mktsegment))), named_struct('l', 'TradingSymbol', 'v', c_mktsegment), named_struct('l', 'SecurityExchangeName', 'v', 'NYSE'))) as f")
    return rows.selectExpr("accession", "context_ref", f"{name(repr('urn:dei'), 'f.l')} as qname", "f.v as value", "cast(null as string) as raw_value")


@query("""
select 'n' || c_nationkey as accession, 'P008:weak|ticker=' || c_mktsegment || '|exchange=NYSE' as weak_key, count(*)::integer as n_members, 'registry_snapshot_missing,weak_identity_collision' as issue_codes
from customer group by c_nationkey, c_mktsegment having count(*) > 1
""")
def detect_collapse(spark, root):
    found = collapse.detect(customer_securities(Tables(spark, root)), max_contexts=None, max_groups=None, max_members=None)
    return found.select("accession", "weak_key", F.col("n_members").cast("int").alias("n_members"), F.array_join("issue_codes", ",").alias("issue_codes"))


FORMS = "case o_orderpriority when '1-URGENT' then '10-Q' when '2-HIGH' then '10-K' when '3-MEDIUM' then '8-K' when '4-NOT SPECIFIED' then '10-Q/A' else '20-F' end"


@query(f"""
with f as (
    select o_custkey as cik, o_orderkey as k, {FORMS} as form, o_orderdate::date as filed, (o_orderdate::date - interval 30 day)::date as period from orders),
b as (select *, case when form like '10-Q%' then '10-Q' else form end as base from f where form <> '8-K'),
p as (
    select a.k, 'a' || lpad(c.k::varchar, 12, '0') as comparator, c.filed as p_filed,
        case when a.base = '10-Q' and quarter(a.period) = quarter(c.period) and year(c.period) < year(a.period) then 0 when c.period < a.period then 1 else 2 end as r
    from b a join b c on a.cik = c.cik and a.base = c.base and c.filed < a.filed and c.filed >= (a.filed - interval 36 month)::date),
best as (select k, arg_min(struct_pack(c := comparator, r := r), (r, date '9999-12-31' - p_filed, comparator)) as x from p group by k)
select 'a' || lpad(k::varchar, 12, '0') as accession, x.c as comparator, ['same_quarter', 'previous_period', 'newest'][x.r + 1] as rule from best
""")
def comparator_by_form(spark, root):
    rows = Tables(spark, root).orders.selectExpr(
        "cast(o_custkey as string) as cik", "concat('a', lpad(cast(o_orderkey as string), 12, '0')) as accession", f"{FORMS} as form", "cast(cast(o_orderdate as date) as string) as filed_date",
        "cast(date_sub(cast(o_orderdate as date), 30) as string) as period_end",
    )
    return history.comparator(rows)


@query(f"""
with f as (select 'a' || l_partkey as accession, l_returnflag, l_suppkey, l_quantity::bigint as v from lineitem),
g as (select accession from f group by accession, l_returnflag, l_suppkey having count(*) > 1 and max(v) > min(v))
select accession, 'F-' || accession || '-P001' as finding_id, 'P001' as pattern_id, count(*) as instance_count_total, least(count(*), 100)::bigint as instance_count_included, 'selected' as selection from g group by accession
""")
def detection_findings(spark, root):
    """The driver over all detectors whose tables are there: one finding per filing and pattern."""
    t = Tables(spark, root)
    rows = line_facts(t).withColumn("decimals", F.lit("INF"))
    filings = t.part.selectExpr("concat('a', p_partkey) as accession", "'10-K' as form")
    found = detection.run({"facts": rows, "contexts": line_contexts(t)}, filings)
    return found.select("accession", "finding_id", "pattern_id", "instance_count_total", F.col("instance_count_included").cast("bigint").alias("instance_count_included"), "selection")
