"""The scan for collapsed instruments over many filings: one summary row per filing, ranked.

Defined results: filings without groups have counts of 0; filings that ``failed`` names have the status ``skipped`` with their error and come last;
null numbers count as 0; ties go by accession; a null or negative limit means all or none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.operators import collapse
from stratalens.plans.scan import ranked

COUNTS = ("collapse_group_count", "max_member_count", "member_count", "resolved_or_ambiguous_member_count", "distinct_instrument_kind_count")


def summaries(facts: DataFrame, lookups: DataFrame | None = None) -> DataFrame:
    """accession, the counts, member_titles and registry_status_counts (status=n, sorted) of filings with groups."""
    found = collapse.groups(facts, lookups, None)
    sizes = found.groupBy("accession").agg(F.count("*").alias("collapse_group_count"), F.max("n_members").alias("max_member_count"), F.sum("n_members").alias("member_count"))
    each = found.select("accession", F.explode("members").alias("m")).select("accession", "m.*")
    kinds = each.groupBy("accession").agg(F.count_if(F.col("status").isin("resolved", "ambiguous")).alias("resolved_or_ambiguous_member_count"), F.count_distinct("instrument_kind").alias("distinct_instrument_kind_count"), F.array_sort(F.collect_set("normalized_title")).alias("member_titles"))
    status = each.groupBy("accession", "status").agg(F.count("*").alias("n")).groupBy("accession").agg(F.array_sort(F.collect_list(F.concat_ws("=", "status", F.col("n").cast("string")))).alias("registry_status_counts"))
    return sizes.join(kinds, "accession").join(status, "accession")


def scan(facts: DataFrame, filings: DataFrame, lookups: DataFrame | None = None, failed: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """rank, status, error, filings' columns (accession, filed_date and others), counts. More resolved or ambiguous members come first, then larger
    groups, more kinds, newer filings. failed: accession, error. ``limit`` takes the first filings by accession, as a manifest's limit does."""
    rows = filings if limit is None else filings.orderBy("accession").limit(max(0, limit))
    rows = rows.join(summaries(facts, lookups), "accession", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in COUNTS})
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("member_titles", "registry_status_counts")})
    if failed is None:
        rows = rows.withColumns({"status": F.lit("scanned"), "error": F.lit("")})
    else:
        rows = rows.join(failed.groupBy("accession").agg(F.min("error").alias("error")), "accession", "left").withColumn("status", F.when(F.col("error").isNull(), "scanned").otherwise("skipped")).withColumn("error", F.coalesce("error", F.lit("")))
    digits = F.regexp_replace(F.coalesce("filed_date", F.lit("")), "-", "")
    newest = F.when(digits.rlike("^[0-9]{8}$"), digits.cast("int")).otherwise(0)
    order = [F.col("status"), F.desc("resolved_or_ambiguous_member_count"), F.desc("max_member_count"), F.desc("distinct_instrument_kind_count"), newest.desc(), F.col("accession")]
    return ranked(rows, order)


def fragility(scanned: DataFrame) -> DataFrame:
    """One row over a scan: filings, filings with groups, groups, members, the largest group, members that a registry resolves or finds ambiguous, and the distinct titles."""
    titles = scanned.select(F.explode("member_titles").alias("t")).agg(F.count_distinct("t").alias("n_titles"))
    counts = scanned.agg(
        F.count("*").alias("n_filings"), F.count_if(F.col("status") == "skipped").alias("n_skipped"), F.count_if(F.col("collapse_group_count") > 0).alias("n_fragile"), F.coalesce(F.sum("collapse_group_count"), F.lit(0)).alias("n_groups"),
        F.coalesce(F.sum("member_count"), F.lit(0)).alias("n_members"), F.coalesce(F.max("max_member_count"), F.lit(0)).alias("max_member_count"), F.coalesce(F.sum("resolved_or_ambiguous_member_count"), F.lit(0)).alias("n_resolved_or_ambiguous"),
    )
    return counts.join(titles)  # one row by one row
