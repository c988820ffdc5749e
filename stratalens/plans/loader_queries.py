"""The observation loader as it is: all orders go out as JSON lines into the shared folder and come back through the reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens import storage
from stratalens.functions import json_schema
from stratalens.operators import incremental
from stratalens.plans.catalog import Tables, query
from stratalens.sources import closure, observations, packs, registry_files
from stratalens.sources.rows import EMPTY


def loaded(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Families go by priority (one has no adapter), accessions and cusips of some statuses have another form, scopes are nested or flat."""
    o = Tables(spark, root).orders
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    status, scope = F.col("o_orderstatus"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    family = F.when(F.col("o_orderpriority").startswith("1"), "SEC_Filing").when(F.col("o_orderpriority").startswith("3"), "nport").when(F.col("o_orderpriority").startswith("4"), "xml").when(F.col("o_orderpriority").startswith("5"), "csv")
    rows = o.select(
        family.alias("source_family"), F.when(status == "F", F.struct(scope.alias("scope_key"))).alias("source_scope"), F.when(status != "F", scope).alias("scope_key"),
        F.when(status == "P", F.concat(F.lit("x"), key)).otherwise(F.concat(F.lpad(key, 10, "0"), F.lit("-24-000001"))).alias("accession"), F.concat(F.lit("r"), key).alias("record_id"),
        F.floor("o_totalprice").cast("bigint").alias("fair_value"), F.col("o_orderpriority").alias("asset_category"), F.when(status == "F", F.lpad(customer, 9, "0")).otherwise(F.concat(F.lit("c-"), customer)).alias("cusip"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("report_date"), F.lit("orders").alias("source_path"), (F.col("o_orderkey") + 1).alias("row_number"), (F.col("o_orderkey") + 1).alias("holding_ordinal"),
    )
    path = f"{storage.fresh_dir(spark, 'order-lines')}/lines"
    rows.write.json(path)
    found, bad = observations.load_observations(spark, path)
    # Spark writes its first part file even where that part has no rows: no input that anyone gave is empty
    return found, bad.where(F.col("message") != EMPTY)


LOADED = """
with raw as (
    select o_orderkey + 1 as n, o_orderkey as k, 'c' || o_custkey::varchar as scope_key, strftime(o_orderdate, '%Y-%m-%d') as report_period, o_orderpriority as p, floor(o_totalprice)::bigint::varchar as v,
        case left(o_orderpriority, 1) when '1' then 'sec_filing' when '3' then 'nport' when '4' then 'xml' when '5' then 'csv' else 'local_export' end as family,
        case when o_orderstatus = 'P' then '' else lpad(o_orderkey::varchar, 10, '0') || '-24-000001' end as accession,
        case when o_orderstatus = 'F' then lpad(o_custkey::varchar, 9, '0') when length('c' || o_custkey::varchar) = 9 then 'C' || o_custkey::varchar else '' end as cusip, 'C' || o_custkey::varchar as given_cusip
    from orders)
"""


@query(LOADED + """,
named as (select *, coalesce(nullif(accession, ''), 'r' || k::varchar) as source_id from raw where family <> 'nport')
select family as source_family, scope_key, source_id, accession, report_period, n::bigint as ordinal, cusip, 'orders#row=' || n::varchar as place,
    sha256('v1|P009:observation|' || family || '|p009_rows_v1|' || source_id || '|' || report_period || '|' || scope_key || '|' || n::varchar || '|orders#row%3D' || n::varchar || '|' || case when cusip <> '' then 'cusip%3D' || cusip else '' end
        || '|asset_type%3D' || p || ';value%3D' || v) as observation_id
from named
""")
def observation_rows(spark, root):
    rows, _ = loaded(spark, root)
    return rows.select("source_family", "scope_key", "source_id", "accession", "report_period", "ordinal", F.col("ids.cusip").alias("cusip"), F.col("paths")[0].alias("place"), "observation_id")


@query(LOADED + """
select code, field, value, count(*) as n from (
    select 'P009-OBS-E002' as code, 'source_family' as field, family as value from raw where family = 'nport'
    union all select 'P009-OBS-E007', 'accession', 'x' || k::varchar from raw where family <> 'nport' and accession = ''
    union all select 'P009-OBS-E006', 'cusip', given_cusip from raw where family <> 'nport' and cusip = '')
group by all
""")
def observation_diagnostics(spark, root):
    _, bad = loaded(spark, root)
    return bad.groupBy("code", "field", "value").agg(F.count("*").alias("n"))


#: A document per order; pending ones, low priorities, high totals, early dates and some lines break it.
ORDER_SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["key", "status", "priority", "lines", "comment"],
    "properties": {
        "key": {"type": "integer", "minimum": 0}, "status": {"enum": ["F", "O"]}, "priority": {"type": "string", "pattern": "^[1-3]-"}, "total": {"type": "number", "maximum": 200000},
        "date": {"type": "string", "format": "date"}, "comment": {"type": "string"},
        "lines": {"type": "array", "minItems": 2, "items": {"type": "object", "required": ["flag"], "properties": {"flag": {"const": "N"}, "tax": {"$ref": "#/$defs/tax"}}}},
    },
    "$defs": {"tax": {"type": "number", "maximum": 0.07}},
}


@query("""
with items as (
    select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as i from lineitem),
sized as (select l_orderkey, count(*) as n from items group by l_orderkey),
found as (
    select o_orderkey, '$.comment' as path, 'required' as keyword from orders
    union all select o_orderkey, '$.clerk', 'additionalProperties' from orders where o_orderpriority like '5%'
    union all select o_orderkey, '$.status', 'enum' from orders where o_orderstatus not in ('F', 'O')
    union all select o_orderkey, '$.priority', 'pattern' from orders where not regexp_matches(o_orderpriority, '^[1-3]-')
    union all select o_orderkey, '$.total', 'maximum' from orders where o_totalprice > 200000
    union all select o_orderkey, '$.date', 'format' from orders where o_orderdate < timestamp '1995-01-01'
    union all select o_orderkey, '$.lines', 'minItems' from orders left join sized on l_orderkey = o_orderkey where coalesce(n, 0) < 2
    union all select l_orderkey, '$.lines[' || i::varchar || '].flag', 'const' from items where l_returnflag <> 'N'
    union all select l_orderkey, '$.lines[' || i::varchar || '].tax', 'maximum' from items where l_tax > 0.07)
select found.o_orderkey, path, keyword from found join orders using (o_orderkey)
""")
def schema_violations(spark, root):
    t = Tables(spark, root)
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.col("l_returnflag").alias("flag"), F.col("l_tax").alias("tax"))
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("l"))  # an order's lines
    rows = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    day = F.when(F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz"), F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    text = F.to_json(F.struct(
        F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("total"), day.alias("date"),
        F.when(F.col("o_orderpriority").startswith("5"), F.lit("x")).alias("clerk"), F.transform(F.coalesce("l", F.array()), lambda x: F.struct(x["flag"].alias("flag"), x["tax"].alias("tax"))).alias("lines"),
    ))
    # an outer generator, as the condition that Spark infers of an inner one would check each document twice
    each = rows.select("o_orderkey", F.explode_outer(json_schema.violations(text, ORDER_SCHEMA)).alias("v")).where("v is not null")
    return each.select("o_orderkey", "v.path", "v.keyword")


@query("""
with facts as (
    select o_custkey, y, list_sort(list_distinct(list(p))) as v from (
        select o_custkey, left(o_orderpriority, 1) || o_orderstatus as p, o_orderdate >= timestamp '1996-01-01' as y from orders) group by all),
early as (select o_custkey, v from facts where not y),
late as (select o_custkey, v from facts where y),
changed as (
    select coalesce(e.o_custkey, l.o_custkey) as k, case when e.v is null then 'added' when l.v is null then 'removed' else 'changed' end as change, l.v as v
    from early e full join late l on e.o_custkey = l.o_custkey where e.v is distinct from l.v)
select k::varchar as input, change, coalesce(len(v), 0)::bigint as n_rows from changed
""")
def registry_increment(spark, root):
    """Facts of the orders before 1996, then of those since: the inputs that the second version builds anew, with their rows in it."""
    value = F.concat(F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus"))
    rows = Tables(spark, root).orders.select(F.col("o_custkey").cast("string").alias("input"), value.alias("v"), (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")).alias("late"))
    facts = lambda late: rows.where(F.col("late") == late).groupBy("input").agg(F.array_sort(F.collect_set("v")).alias("values")).select("input", F.lit("figi").alias("target"), "values")  # noqa: E731  of a few kinds
    build = lambda f: registry_files.snapshot_from_mappings(f, None, "cusip")
    second, diff = incremental.advance(incremental.full(facts(False), build), facts(True), build)
    counts = second.view.groupBy("input").agg(F.count("*").alias("n"))
    return diff.join(counts, "input", "left").select("input", "change", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_rows"))


@query("""
with files as (
    select c_nationkey as n, 'artifacts/' || lower(c_mktsegment) || '.txt' as path, string_agg(c_custkey::varchar || ' ' || c_name, chr(10) order by c_custkey) as content from customer group by all
    union all select c_nationkey, 'findings.json', '{"count":' || count(*)::varchar || '}' from customer group by all
    union all select distinct c_nationkey, 'toolchain/toolchain.json', '{}' from customer),
hashed as (select n, path, sha256(content) as sha, octet_length(encode(content)) as bytes from files)
select 'nation-' || n::varchar as pack_id, sha256(string_agg(path || chr(9) || sha || chr(10), '' order by path)) as pack_sha256, count(*) as n_files, sum(bytes)::bigint as n_bytes from hashed group by n
""")
def pack_assembly(spark, root):
    """A pack for each nation with a list of its customers by segment, through the sink; rows come from the committed entries."""
    c = Tables(spark, root).customer.select("c_nationkey", F.lower("c_mktsegment").alias("segment"), F.struct("c_custkey", F.concat_ws(" ", F.col("c_custkey").cast("string"), "c_name").alias("line")).alias("x"))
    pages = c.groupBy("c_nationkey", "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("content"))  # a page's lines
    pages = pages.select("c_nationkey", F.concat(F.lit("artifacts/"), "segment", F.lit(".txt")).alias("path"), "content")
    counts = c.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    found = counts.select("c_nationkey", F.lit("findings.json"), F.concat(F.lit('{"count":'), F.col("n").cast("string"), F.lit("}")))
    tools = counts.select("c_nationkey", F.lit("toolchain/toolchain.json"), F.lit("{}"))
    files = pages.union(found).union(tools).select(F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("pack_id"), "path", "content")
    where = storage.fresh_dir(spark, "packs")
    done = packs.assemble(files, where)
    sizes = packs.entries(spark, where).where(F.col("path") != packs.Layout().manifest).groupBy("pack_id").agg(F.count("*").alias("n_files"), F.sum("bytes").alias("n_bytes"))
    return done.select("pack_id", "pack_sha256").join(sizes, "pack_id")


@query("""
with recursive d as (select c_custkey as k, 'n' || c_nationkey::varchar || '/c' || c_custkey::varchar || '.xsd' as path, c_nationkey as n from customer),
links as (select a.k, a.path, b.path as into_path, b.k as into_k from d a join d b on b.k = a.k // 2 where a.k <> b.k),
r as (
    select path as root, path, k, 0 as depth from d
    union all select root, into_path, into_k, depth + 1 from r join links using (path, k))
select root, r.path, depth, case depth when 0 then 'primary' else 'artifact' end as role from r
""")
def artifact_closure(spark, root):
    """A schema file per customer, in its nation's folder, that includes the one of half its number; the closures of all files."""
    c = Tables(spark, root).customer.select("c_custkey", "c_nationkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("/c"), F.col("c_custkey").cast("string"), F.lit(".xsd")).alias("path"))
    half = c.select(F.col("c_custkey").alias("half"), F.col("path").alias("to"))
    rows = c.withColumn("half", F.expr("c_custkey div 2")).join(half, "half", "left")
    content = F.when(F.col("to").isNotNull(), F.concat(F.lit('<xs:include schemaLocation="./../'), "to", F.lit('#part"/><xs:import schemaLocation="http://standard/x.xsd"/>'))).otherwise("")
    docs = rows.select("path", content.alias("content"))
    files = docs.select("path", F.sha2("content", 256).alias("sha256"), F.length("content").alias("bytes"))
    artifacts, _ = closure.collect(docs, files, c.select("path"))
    return artifacts.select("root", "path", "depth", "role")
