"""Findings: gate, priority, suppression, truncation, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns in the order of their priority.
PRIORITY = {"P001": 1, "P004": 2, "P005": 3, "P002": 4, "P008": 5, "P009": 6}
INSTANCE_LIMIT, EXAMPLE_LIMIT = 100, 10
#: Texts that a citation's source can hold, tested in this order, and the kinds that they name.
SOURCES = {
    "XBRL SPECIFICATION 2.1": "XBRL_SPEC",
    "XBRL_21": "XBRL_SPEC",
    "XBRL SPEC": "XBRL_SPEC",
    "SEC EFM": "SEC_EFM",
    "EFM": "SEC_EFM",
    "ARELLE": "ARELLE_VALIDATION",
    "DQCRT": "DQCRT",
    "OTHER": "OTHER",
}


def priority(pattern: Column) -> Column:
    out = F.when(F.lit(False), F.lit(99))
    for name, rank in PRIORITY.items():
        out = out.when(pattern == name, F.lit(rank))
    return out.otherwise(F.lit(99))


def valid_citation(c: Column) -> Column:
    """A source, a time with T and Z, 64 hex digits, and an address or a title."""
    filled = lambda name: F.coalesce(c[name], F.lit("")) != ""
    time = F.coalesce(c["retrieved_at"], F.lit(""))
    return filled("source") & F.contains(time, F.lit("T")) & F.contains(time, F.lit("Z")) & F.coalesce(c["sha256"], F.lit("")).rlike("^[0-9a-fA-F]{64}$") & (filled("url") | filled("title"))


def gate(findings: DataFrame, citations: str = "citations") -> DataFrame:
    """Findings without a valid citation are suppressed."""
    good = F.exists(F.col(citations), valid_citation)
    return findings.withColumn("status", F.when(F.coalesce(good, F.lit(False)), F.col("status")).otherwise("suppressed"))


def citation_source(text: Column) -> Column:
    """The kind of the first text that the source holds; a kind's own name stays; OTHER without one."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    out = F.when(F.trim(upper).isin(*sorted(set(SOURCES.values()))), F.trim(upper))
    for name, kind in SOURCES.items():
        out = out.when(F.contains(upper, F.lit(name)), F.lit(kind))
    return out.otherwise(F.lit("OTHER"))


def normal_citation(c: Column) -> Column:
    """struct(source, citation, url, retrieved_at, sha256, notes) of a citation; null without a citation or a title. Empty fields and
    digests that aren't 64 hex digits are null."""
    text = lambda name: F.nullif(F.coalesce(c[name], F.lit("")), F.lit(""))
    name = F.coalesce(c["citation"], c["title"], F.lit(""))
    sha = F.when(text("sha256").rlike("^[0-9a-fA-F]{64}$"), F.lower(text("sha256")))
    out = F.struct(citation_source(c["source"]).alias("source"), name.alias("citation"), text("url").alias("url"), text("retrieved_at").alias("retrieved_at"), sha.alias("sha256"), text("notes").alias("notes"))
    return F.when(name != "", out)


def ranked(findings: DataFrame, key: list[str], pattern: str = "pattern_id", finding: str = "finding_id", eligible: Column | None = None) -> DataFrame:
    """rank 1 is the finding to report: by priority, pattern and id; suppression marks the other eligible ones."""
    test = F.lit(True) if eligible is None else eligible
    w = Window.partitionBy(*key).orderBy((~test).cast("int"), priority(F.col(pattern)), pattern, finding)
    rows = findings.withColumn("rank", F.row_number().over(w)).withColumn("__e", test)
    state = F.when(F.col("__e") & (F.col("rank") > 1), "suppressed").when(F.col("__e"), "selected").otherwise("not_eligible")
    return rows.withColumn("selection", state).drop("__e")


def winner(findings: DataFrame, key: list[str], pattern: str = "pattern_id", finding: str = "finding_id") -> DataFrame:
    """The finding of highest priority per key, by one aggregation."""
    best = F.min_by(F.struct(pattern, finding), F.struct(priority(F.col(pattern)), F.col(pattern), F.col(finding)))
    return findings.groupBy(*key).agg(best.alias("b")).select(*key, "b.*")


def truncated(rows: DataFrame, key: list[str], order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows of each key with total, included and truncated."""
    w = Window.partitionBy(*key)
    out = rows.withColumns({"total": F.count("*").over(w), "pos": F.row_number().over(w.orderBy(*order))}).where(F.col("pos") <= limit)
    return out.withColumns({"included": F.least("total", F.lit(limit)), "truncated": F.col("total") > limit})


def documents(instances: DataFrame, key: list[str], payload: Column, limit: int = INSTANCE_LIMIT) -> DataFrame:
    """key, instance_count_total, instance_count_included, instances_truncated, instances (by id, at most ``limit``)."""
    kept = truncated(instances.withColumn("payload", payload), key, ["instance_id"], limit)
    lists = kept.groupBy(*key, "total", "included", "truncated").agg(F.array_sort(F.collect_list(F.struct("instance_id", "payload"))).alias("instances"))
    return lists.withColumnsRenamed({"total": "instance_count_total", "included": "instance_count_included", "truncated": "instances_truncated"})


def break_trigger(triggers: Column) -> Column:
    """The smallest trigger id."""
    return F.array_min(F.transform(triggers, lambda t: t["id"]))


def code_counts(rows: DataFrame, codes: Column) -> DataFrame:
    return rows.select(F.explode(codes).alias("issue_code")).groupBy("issue_code").agg(F.count("*").alias("n"))


def ordered(rows: DataFrame, *keys: str) -> DataFrame:
    """A total order: the keys, then the whole row as text."""
    return rows.orderBy(*keys, F.to_json(F.struct(*rows.columns)))
