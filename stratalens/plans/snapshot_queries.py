"""The marker driver as it is, over snapshots of all lineitem rows: an issuer is a supplier, a filing a year of shipping.

Sets of a year: pairs of return flag and line number (schema references), parts (extensions), parts of open lines (anchored), return flag, quarter
and quantity (dimensions), orders with returned lines (duplicates); contexts are lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.operators import snapshots
from stratalens.plans.catalog import Tables, query


def shipping(spark: SparkSession, root: str, kinds: tuple[str, ...] = snapshots.KINDS) -> tuple[DataFrame, DataFrame]:
    """Filings of all lines, and the members of the sets that are asked for."""
    items = Tables(spark, root).lineitem.where("l_suppkey is not null and l_shipdate is not null")
    cik, year = F.col("l_suppkey").cast("string"), F.date_format("l_shipdate", "yy")
    rows = items.select(cik.alias("cik"), F.concat(F.lpad(cik, 10, "0"), F.lit("-"), year, F.lit("-000001")).alias("accession"), "l_shipdate", "l_partkey", "l_orderkey", "l_linestatus", "l_returnflag", "l_linenumber", "l_quantity")
    text = lambda c: F.col(c).cast("string")
    sets = {
        "schema": F.concat_ws("|", "l_returnflag", text("l_linenumber")), "extension": text("l_partkey"), "anchored": F.when(F.col("l_linestatus") == "O", text("l_partkey")),
        "dimension": F.concat_ws("|", "l_returnflag", F.quarter("l_shipdate").cast("string"), F.col("l_quantity").cast("int").cast("string")), "duplicate": F.when(F.col("l_returnflag") == "R", text("l_orderkey")),
    }
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), sets[k].alias("member")) for k in kinds))
    members = rows.select("cik", "accession", F.explode(pairs).alias("s")).select("cik", "accession", "s.kind", "s.member").where("member is not null")
    return rows.groupBy("cik", "accession").agg(F.count("*").alias("context_count")), members


#: Sets of each supplier and year, the comparator of each filing, and what is new or retired against it.
SNAPSHOTS = """
with rows as (
    select l_suppkey::varchar as cik, lpad(l_suppkey::varchar, 10, '0') || '-' || strftime(l_shipdate, '%y') || '-000001' as accession, * from lineitem where l_suppkey is not null and l_shipdate is not null),
filings as (select cik, accession, count(*) as contexts from rows group by all),
m as (
    select distinct cik, accession, kind, member from (
        select cik, accession, 'schema' as kind, concat_ws('|', l_returnflag, l_linenumber::varchar) as member from rows union all select cik, accession, 'extension', l_partkey::varchar from rows
        union all select cik, accession, 'anchored', l_partkey::varchar from rows where l_linestatus = 'O'
        union all select cik, accession, 'dimension', concat_ws('|', l_returnflag, quarter(l_shipdate)::varchar, l_quantity::integer::varchar) from rows
        union all select cik, accession, 'duplicate', l_orderkey::varchar from rows where l_returnflag = 'R') where member is not null),
grid as (
    select f.*, k.kind, coalesce(n, 0) as n_now, (select count(*) from m where m.cik = f.cik and m.accession = f.accession and m.kind = 'extension') as n_extension
    from filings f, (select unnest(['schema', 'extension', 'anchored', 'dimension', 'duplicate']) as kind) k
    left join (select cik, accession, kind, count(*) as n from m group by all) s on s.cik = f.cik and s.accession = f.accession and s.kind = k.kind),
flagged as (select *, case kind when 'anchored' then n_extension > 0 when 'dimension' then n_now > 0 or contexts > 0 else n_now > 0 end as there from grid),
pairs as (
    select a.*, b.accession as prior_accession, b.n_now as n_prior, b.contexts as prior_contexts, b.n_extension as prior_n_extension from flagged a join flagged b on a.cik = b.cik and a.kind = b.kind and b.there
    and b.accession = (select max(c.accession) from flagged c where c.cik = a.cik and c.kind = a.kind and c.there and c.accession < a.accession)),
news as (
    select p.cik, p.kind, p.accession, m.member from pairs p join m on m.cik = p.cik and m.kind = p.kind and m.accession = p.accession
    where not exists (select 1 from m o where o.cik = p.cik and o.kind = p.kind and o.accession = p.prior_accession and o.member = m.member)),
gone as (
    select p.cik, p.kind, p.accession, m.member from pairs p join m on m.cik = p.cik and m.kind = p.kind and m.accession = p.prior_accession
    where not exists (select 1 from m o where o.cik = p.cik and o.kind = p.kind and o.accession = p.accession and o.member = m.member)),
counted as (
    select p.*, coalesce(n.c, 0) as n_new, coalesce(g.c, 0) as n_retired, coalesce(n.l, '') as new_examples, coalesce(g.l, '') as retired_examples from pairs p
    left join (select cik, kind, accession, count(*) as c, array_to_string(list_sort(list(member))[1:10], ',') as l from news group by all) n using (cik, kind, accession)
    left join (select cik, kind, accession, count(*) as c, array_to_string(list_sort(list(member))[1:10], ',') as l from gone group by all) g using (cik, kind, accession))
"""

FIRES = {
    "M001": "kind = 'schema' and n_prior >= 1 and n_new + n_retired >= 1 and (n_new + n_retired)::double / n_prior >= 0.2",
    "M002": "kind = 'extension' and n_prior >= 10 and n_new >= 5 and n_retired >= 5 and (n_new + n_retired)::double / n_prior >= 0.25",
    "M003": "kind = 'anchored' and prior_n_extension >= 25 and n_now - n_prior >= 10 and n_now::double / n_extension - n_prior::double / prior_n_extension >= 0.2",
    "M004": "kind = 'dimension' and (prior_contexts >= 50 and abs(contexts - prior_contexts) >= 25 and abs(contexts - prior_contexts)::double / prior_contexts >= 0.4 or n_prior >= 25 and n_new + n_retired >= 10 and (n_new + n_retired)::double / n_prior >= 0.4)",
    "M005": "kind = 'duplicate' and n_prior >= 20 and n_prior - n_now >= 10 and (n_prior - n_now)::double / n_prior >= 0.5",
}


def _register(marker: str) -> None:
    sql = SNAPSHOTS + f"select '{marker}' as marker, cik, accession, prior_accession, n_prior, n_now, n_new, n_retired, new_examples, retired_examples from counted where {FIRES[marker]}"

    def run(spark: SparkSession, root: str) -> DataFrame:
        found = snapshots.marker_rows(*shipping(spark, root, snapshots.kinds_of((marker,))), only=(marker,))
        return found.select("marker", "cik", "accession", "prior_accession", "n_prior", "n_now", "n_new", "n_retired", *(F.array_join(c, ",").alias(c) for c in ("new_examples", "retired_examples")))

    query(sql, f"snapshot_marker_{marker.lower()}")(run)


for _marker in FIRES:
    _register(_marker)
