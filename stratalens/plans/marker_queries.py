"""Markers, sets, manifests and documents over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalens.functions import numbers as N
from stratalens.functions import signatures as S
from stratalens.functions import text as T
from stratalens.operators import integrity, markers, sets
from stratalens.plans.catalog import Tables, query
from stratalens.sources import documents as D

DAYS = """
with d as (select distinct cast(ts as date) as day, {cols} from events),
days as (select day, lag(day) over (order by day) as prior from (select distinct day from d)),
n as (select day, count(*) as n from d group by day),
added as (select a.day, count(*) as n from d a join days using (day) where prior is not null and not exists (select 1 from d b where b.day = prior and {same}) group by a.day),
removed as (select days.day, count(*) as n from d b join days on b.day = prior where not exists (select 1 from d a where a.day = days.day and {same}) group by days.day)
"""


def daily(t: Tables, *columns: str):
    """One set of members per day, with the day before. Days are few; members are distinct before they are gathered."""
    rows = t.events.select(F.col("ts").cast("date").alias("day"), F.concat_ws("|", *columns).alias("member")).distinct()
    days = rows.groupBy("day").agg(F.array_sort(F.collect_list("member")).alias("members"))
    return markers.with_prior(days, [], "day", ["members"]).where("prior_members is not null")


@query(DAYS.format(cols="user_id", same="a.user_id = b.user_id") + """
select days.day, coalesce(added.n, 0) as n_added, coalesce(removed.n, 0) as n_removed, p.n as n_prior
from days join n p on p.day = prior left join added on added.day = days.day left join removed on removed.day = days.day
""")
def marker_schema_churn(spark, root):
    rows = daily(Tables(spark, root), "user_id")
    return rows.select("day", F.size(markers.added(F.col("members"), F.col("prior_members"))).cast("bigint").alias("n_added"), F.size(markers.added(F.col("prior_members"), F.col("members"))).cast("bigint").alias("n_removed"), F.size("prior_members").cast("bigint").alias("n_prior"))


@query(DAYS.format(cols="user_id || '|' || event_type as member", same="a.member = b.member") + """,
e as (
    select a.day, a.member, row_number() over (partition by a.day order by a.member) as r from d a join days using (day)
    where prior is not null and not exists (select 1 from d b where b.day = prior and a.member = b.member))
select days.day, coalesce(added.n, 0) as n_new, coalesce(removed.n, 0) as n_retired, coalesce((select string_agg(member, ',' order by member) from e where e.day = days.day and r <= 10), '') as examples
from days left join added on added.day = days.day left join removed on removed.day = days.day where prior is not null
""")
def marker_extension_churn(spark, root):
    rows = daily(Tables(spark, root), "user_id", "event_type")
    new = markers.added(F.col("members"), F.col("prior_members"))
    return rows.select("day", F.size(new).cast("bigint").alias("n_new"), F.size(markers.added(F.col("prior_members"), F.col("members"))).cast("bigint").alias("n_retired"), F.array_join(F.slice(new, 1, markers.EXAMPLES), ",").alias("examples"))


@query("""
select cast(ts as date) as day, count(distinct user_id) as n_active, count(distinct case when event_type = 'purchase' then user_id end) as n_anchored,
    cast(count(distinct case when event_type = 'purchase' then user_id end) * 10000 // count(distinct user_id) as bigint) as coverage_bp
from events group by 1
""")
def marker_coverage(spark, root):
    rows = Tables(spark, root).events.groupBy(F.col("ts").cast("date").alias("day")).agg(F.count_distinct("user_id").alias("n_active"), F.count_distinct(F.when(F.col("event_type") == "purchase", F.col("user_id"))).alias("n_anchored"))
    return rows.withColumn("coverage_bp", F.expr("n_anchored * 10000 div n_active"))


@query("""
with c as (select cast(ts as date) as day, count(*) as n, count(distinct (user_id, event_type)) as n_pairs from events group by 1),
l as (select day, n, n_pairs, lag(n) over (order by day) as prior_n, lag(n_pairs) over (order by day) as prior_pairs from c)
select day, abs(n - prior_n) as context_change, abs(n_pairs - prior_pairs) as pair_change, (prior_n >= 50 and abs(n - prior_n) >= 25 and abs(n - prior_n) * 10 >= prior_n * 4) as fires from l where prior_n is not null
""")
def marker_context_rewrite(spark, root):
    t = markers.ContextRewrite()
    rows = Tables(spark, root).events.groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id", "event_type").alias("n_pairs"))
    rows = markers.with_prior(rows, [], "day", ["n", "n_pairs"]).where("prior_n is not null")
    change = F.abs(F.col("n") - F.col("prior_n"))
    fires = (F.col("prior_n") >= t.min_previous_context_count) & (change >= t.min_context_count_change) & (N.ratio(change, F.col("prior_n")) >= t.min_context_count_change_ratio)
    return rows.select("day", change.alias("context_change"), F.abs(F.col("n_pairs") - F.col("prior_n_pairs")).alias("pair_change"), fires.alias("fires"))


@query("""
with g as (select cast(ts as date) as day, user_id, event_type from events group by all having count(*) > 1),
c as (select days.day, count(g.day) as n from (select distinct cast(ts as date) as day from events) days left join g on g.day = days.day group by days.day),
l as (select day, n, lag(n) over (order by day) as prior_n from c)
select day, n, prior_n, prior_n - n as dropped from l where prior_n is not null
""")
def marker_duplicate_drop(spark, root):
    groups = Tables(spark, root).events.groupBy(F.col("ts").cast("date").alias("day"), "user_id", "event_type").agg(F.count("*").alias("c"))
    days = groups.groupBy("day").agg(F.count_if(F.col("c") > 1).alias("n"))
    rows = markers.with_prior(days, [], "day", ["n"]).where("prior_n is not null")
    return rows.select("day", "n", "prior_n", (F.col("prior_n") - F.col("n")).alias("dropped"))


YEARS = "with a as (select distinct l_partkey as k from lineitem where year(l_shipdate) = 1995), b as (select distinct l_partkey as k from lineitem where year(l_shipdate) = 1996)"


def year_keys(t: Tables, year: int):
    return t.lineitem.where(f"l_shipdate >= timestamp_ntz '{year}-01-01' and l_shipdate < timestamp_ntz '{year + 1}-01-01'").select(F.col("l_partkey").alias("k"))


@query(YEARS + " select k, 'added' as change from b where k not in (select k from a) union all select k, 'removed' from a where k not in (select k from b)")
def set_added_removed(spark, root):
    t = Tables(spark, root)
    return sets.changes(year_keys(t, 1995), year_keys(t, 1996), ["k"])


@query(YEARS + " select k from a intersect select k from b")
def set_intersection(spark, root):
    t = Tables(spark, root)
    return sets.common(year_keys(t, 1995), year_keys(t, 1996), ["k"])


@query(YEARS + " select k from a union select k from b")
def set_union(spark, root):
    t = Tables(spark, root)
    return sets.union_distinct(year_keys(t, 1995), year_keys(t, 1996))


@query("""
with s as (
    select distinct unnest(['part', 'supplier']) as id_type, unnest([l_partkey::varchar, l_suppkey::varchar]) as value from lineitem)
select id_type, value from s where not exists (select 1 from part where id_type = 'part' and p_partkey::varchar = value and p_size <= 25)
    and not exists (select 1 from supplier where id_type = 'supplier' and s_suppkey::varchar = value and s_acctbal > 0)
""")
def incremental_seeds(spark, root):
    t = Tables(spark, root)
    # distinct pairs first: normalising runs on keys, not on rows
    rows = t.lineitem.select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"))
    one = lambda c: sets.seeds(rows.select(c).distinct(), [c])
    existing = t.part.where("p_size <= 25").select(F.lit("part").alias("id_type"), F.col("p_partkey").cast("string").alias("value")).union(t.supplier.where("s_acctbal > 0").select(F.lit("supplier"), F.col("s_suppkey").cast("string")))
    found = one("part").union(one("supplier"))
    return sets.new_seeds(found, existing, ["id_type", "value"])


@query("select sha256(string_agg(n_name || chr(9) || sha256(n_name) || chr(10), '' order by n_name)) as pack_sha256, count(*) as n_files from nation")
def integrity_hash(spark, root):
    rows = Tables(spark, root).nation.select(F.col("n_name").alias("path"), S.sha(F.col("n_name")).alias("sha256"))
    return integrity.pack_hash(rows)


@query("""
select case when s_suppkey % 10 = 0 then 'missing' when s_suppkey % 10 = 1 then 'size_mismatch' when s_suppkey % 10 = 2 then 'sha_mismatch' else 'ok' end as status, count(*) as n from supplier group by 1
""")
def verify_manifest(spark, root):
    rows = Tables(spark, root).supplier.select(F.col("s_suppkey").alias("path"), F.length("s_name").alias("bytes"), S.sha(F.col("s_name")).alias("sha256"))
    k = F.col("path") % 10
    found = rows.where(k != 0).select("path", F.when(k == 1, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"), F.when(k == 2, S.sha(F.lit("changed"))).otherwise(F.col("sha256")).alias("sha256"))
    return integrity.verify(rows, found).groupBy("status").agg(F.count("*").alias("n"))


@query("""select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href from pages""")
def inline_attr_extract(spark, root):
    return D.attribute_values(Tables(spark, root).pages, ["page_id"], "html", "href")


@query(r"""
with m as (select page_id, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) as title, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) as h1 from pages)
select page_id, case when title <> '' then title else h1 end as name, case when title <> '' then 'title' when h1 <> '' then 'h1' else '' end as provenance from m
""")
def metadata_first_match(spark, root):
    fields = {"title": r"(?s)<title>(.*?)</title>", "h1": r"(?s)<h1[^>]*>(.*?)</h1>"}
    return D.first_match(Tables(spark, root).pages, ["page_id"], "html", fields, "name")


@query(r"select page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))) as n_chars, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))) as text_sha from pages")
def strip_tags_normalize(spark, root):
    text = T.collapsed(T.without_tags(F.col("html")))
    return Tables(spark, root).pages.select("page_id", text.alias("t")).select("page_id", F.length("t").cast("bigint").alias("n_chars"), S.sha(F.col("t")).alias("text_sha"))


#: Turns of one submission: a longer conversation becomes several, so that no task holds all of it.
SUBMISSION_TURNS = 20


@query()
def sgml_udtf(spark, root):
    """Conversations as tagged submissions, parsed back to one row per document. A null turn has an empty sequence; null roles and texts are empty."""
    c = Tables(spark, root).conversations
    turn = F.coalesce(F.col("turn").cast("string"), F.lit(""))
    text = lambda name: F.coalesce(name, F.lit(""))
    record = F.concat(F.lit("<DOCUMENT>\n<TYPE>"), text("role"), F.lit("\n<SEQUENCE>"), turn, F.lit("\n<FILENAME>"), F.lit("t"), turn, F.lit(".txt\n<TEXT>\n"), text("text"), F.lit("\n</TEXT>\n</DOCUMENT>\n"))
    # equal turns share a submission, where repeated names are found
    parts = c.groupBy("conv_id", F.floor(F.col("turn") / SUBMISSION_TURNS).alias("part")).agg(F.array_sort(F.collect_list(F.struct("turn", record.alias("r")))).alias("p"))
    whole = parts.select(F.col("conv_id").cast("string").alias("path"), F.concat(F.lit("<SUBMISSION>\n<ACCESSION-NUMBER>0000000000-24-000001\n"), F.array_join(F.transform("p", lambda x: x["r"]), ""), F.lit("</SUBMISSION>\n")).alias("content"))
    return D.parse_submissions(whole).select("path", "sequence", "type", "filename", F.length("text").alias("n_chars"), "error")


@query("""
with g as (select c_mktsegment, cast(floor(c_acctbal / 1000) as bigint) as bucket, count(*) as n from customer group by all)
select c_mktsegment, bucket, n, rank() over (partition by c_mktsegment order by n desc) as rank,
    sum(n) over (partition by c_mktsegment order by bucket rows between 2 preceding and current row)::bigint as moving from g
""")
def window_frames_bonus(spark, root):
    rows = Tables(spark, root).customer.groupBy("c_mktsegment", F.floor(F.col("c_acctbal") / 1000).alias("bucket")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("c_mktsegment")
    return rows.withColumns({"rank": F.rank().over(w.orderBy(F.desc("n"))), "moving": F.sum("n").over(w.orderBy("bucket").rowsBetween(-2, 0))})
