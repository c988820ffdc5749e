"""Instruments that collapse under one weak key (pattern P008)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions import signatures as S
from stratalens.functions import text as T

#: Local names of registered-security facts by field.
FIELDS = {
    "security_title": ("Security12bTitle", "SecurityTitle"),
    "trading_symbol": ("TradingSymbol",),
    "exchange": ("SecurityExchangeName",),
    "no_trading_symbol": ("NoTradingSymbolFlag",),
    "cusip": ("SecurityCUSIP", "SecurityCusip", "CUSIP", "Cusip"),
    "isin": ("SecurityISIN", "SecurityIsin", "ISIN", "Isin"),
}
MAX_CONTEXTS, MAX_GROUPS, MAX_MEMBERS = 500, 100, 25
#: Fixed value: what the processor writes for a value that it couldn't transform.
TRANSFORM_ERROR = "(ixTransformValueError)"


def field_of(local_name: Column) -> Column:
    return T.mapped(local_name, {n: field for field, names in FIELDS.items() for n in names}, F.lit(""))


def security_fields(facts: DataFrame, max_contexts: int | None = MAX_CONTEXTS) -> DataFrame:
    """accession, context_ref and sorted distinct values per field, of the first contexts; ``diagnostics`` tells of the others."""
    value = F.when(F.col("value") == TRANSFORM_ERROR, F.col("raw_value")).otherwise(F.col("value"))
    rows = facts.select("accession", "context_ref", field_of(F.col("qname.local_name")).alias("field"), value.alias("v")).where("field <> '' and v <> ''")
    rows = rows.withColumn("v", T.normalized(T.decoded("v"))).where("v <> ''")
    if max_contexts is not None:
        first = rows.select("accession", "context_ref").distinct().withColumn("__c", F.row_number().over(Window.partitionBy("accession").orderBy("context_ref")))
        rows = rows.join(first.where(F.col("__c") <= max_contexts), ["accession", "context_ref"], "left_semi")
    return rows.groupBy("accession", "context_ref").pivot("field", list(FIELDS)).agg(F.array_sort(F.collect_set("v")))


def candidates(fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Instruments with a parsed title, one per distinct title of a context; and unsupported titles."""
    low = lambda c: F.coalesce(F.array_min(c), F.lit(""))
    rows = fields.select(
        "accession", "context_ref", F.explode("security_title").alias("raw_title"), T.key_token(low("trading_symbol")).alias("ticker"), T.exchange_key(low("exchange")).alias("exchange"),
        F.coalesce(F.exists("no_trading_symbol", lambda v: F.lower(v).isin("true", "1", "yes", "y")), F.lit(False)).alias("no_trading_symbol"),
        T.identifier(low("cusip")).alias("cusip"), T.identifier(low("isin")).alias("isin"),
    ).withColumn("t", T.title(F.col("raw_title")))
    rows = rows.withColumn("weak_key", S.weak_instrument(F.col("ticker"), F.col("exchange"), F.col("no_trading_symbol")))
    good = rows.where("t is not null").select("accession", "context_ref", "raw_title", "ticker", "exchange", "no_trading_symbol", "cusip", "isin", "weak_key", F.col("t.kind").alias("instrument_kind"), F.col("t.normalized").alias("normalized_title"), F.col("t.par").alias("par_value"), F.col("t.coupon").alias("coupon_percent"), F.col("t.maturity").alias("maturity_year"))
    sig = S.instrument(
        "instrument", context_ref=T.key_token(F.col("context_ref")), kind=F.col("instrument_kind"), title=F.col("normalized_title"), par_value=F.col("par_value"), coupon_percent=F.col("coupon_percent"),
        maturity_year=F.col("maturity_year"), ticker=F.col("ticker"), exchange=F.col("exchange"), no_trading_symbol=F.col("no_trading_symbol").cast("string"), cusip=F.col("cusip"), isin=F.col("isin"),
    )
    good = good.withColumn("canonical_signature", sig)
    good = good.withColumn("identity_key", F.coalesce(F.nullif("cusip", F.lit("")), F.nullif("isin", F.lit("")), F.col("canonical_signature")))
    return good, rows.where("t is null").select("accession", "context_ref", "raw_title", "weak_key")


def collapse_groups(rows: DataFrame, key: list[str], identity: str, member: Column) -> DataFrame:
    """key, n_members, members of keys with more than one identity; of rows with one identity the smallest stays."""
    one = rows.groupBy(*key, identity).agg(F.min(member).alias("m"))
    return one.groupBy(*key).agg(F.count("*").alias("n_members"), F.array_sort(F.collect_list("m")).alias("members")).where("n_members > 1")


def groups(facts: DataFrame, lookups: DataFrame | None = None, max_contexts: int | None = MAX_CONTEXTS) -> DataFrame:
    """accession, weak_key, n_members, members, issue_codes of every collapsed key. lookups: canonical_signature and registry status."""
    good, unsupported = candidates(security_fields(facts, max_contexts))
    rows = good.where("weak_key <> ''")
    if lookups is None:
        rows = rows.withColumn("status", F.lit("snapshot_missing"))
    else:
        rows = rows.join(lookups.select("canonical_signature", "status"), "canonical_signature", "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    member = F.struct("identity_key", "context_ref", "normalized_title", "instrument_kind", "canonical_signature", "status")
    found = collapse_groups(rows, ["accession", "weak_key"], "identity_key", member)
    odd = unsupported.where("weak_key <> ''").groupBy("accession", "weak_key").agg(F.array_sort(F.collect_set("raw_title")).alias("unsupported"))
    found = found.join(odd, ["accession", "weak_key"], "left")
    has = lambda s: F.exists("members", lambda m: m["status"] == s)
    codes = F.array_sort(F.array_compact(F.array(
        F.lit("weak_identity_collision"), F.when(has("snapshot_missing"), F.lit("registry_snapshot_missing")), F.when(has("ambiguous"), F.lit("registry_snapshot_ambiguous")),
        F.when(F.col("unsupported").isNotNull(), F.lit("unsupported_security_title")),
    )))
    return found.withColumn("issue_codes", codes)


def detect(facts: DataFrame, lookups: DataFrame | None = None, max_contexts: int | None = MAX_CONTEXTS, max_groups: int | None = MAX_GROUPS, max_members: int | None = MAX_MEMBERS) -> DataFrame:
    """accession, weak_key, n_members, members, members_truncated, issue_codes, instance_id: the first groups of each filing with their first
    members. n_members counts all; a limit of None lifts it; ``diagnostics`` names the filings that a limit touches."""
    out = groups(facts, lookups, max_contexts)
    if max_groups is not None:
        out = out.withColumn("__g", F.row_number().over(Window.partitionBy("accession").orderBy("weak_key"))).where(F.col("__g") <= max_groups).drop("__g")
    shown = F.col("members") if max_members is None else F.slice("members", 1, max_members)
    return out.withColumns({"members_truncated": F.size("members") > F.size(shown), "members": shown, "instance_id": S.sha(F.col("weak_key"))})


def diagnostics(facts: DataFrame, lookups: DataFrame | None = None, max_contexts: int | None = MAX_CONTEXTS, max_groups: int | None = MAX_GROUPS, max_members: int | None = MAX_MEMBERS) -> DataFrame:
    """accession, issue_code, message, n_total, n_kept of the filings in which ``detect`` leaves something out."""
    none = facts.select("accession", F.lit("").alias("issue_code"), F.lit("").alias("message"), F.lit(0).cast("bigint").alias("n_total"), F.lit(0).cast("bigint").alias("n_kept")).limit(0)
    say = lambda counts, code, text, limit: counts.where(F.col("n") > limit).select("accession", F.lit(code).alias("issue_code"), F.lit(text).alias("message"), F.col("n").alias("n_total"), F.lit(limit).cast("bigint").alias("n_kept"))
    out = none
    if max_contexts is not None:
        counts = security_fields(facts, None).groupBy("accession").agg(F.count("*").alias("n"))
        out = out.union(say(counts, "detector_context_cap_exceeded", f"P008 context cap {max_contexts} exceeded; remaining contexts left out.", max_contexts))
    found = groups(facts, lookups, max_contexts)
    if max_groups is not None:
        out = out.union(say(found.groupBy("accession").agg(F.count("*").alias("n")), "detector_group_cap_exceeded", f"P008 group cap {max_groups} exceeded; remaining groups suppressed.", max_groups))
    if max_members is not None:
        out = out.union(say(found.select("accession", F.col("n_members").alias("n")), "detector_member_cap_exceeded", f"P008 member cap {max_members} exceeded; remaining members left out of the instance.", max_members))
    return out


def rollup(members: DataFrame, key: list[str], group: list[str]) -> DataFrame:
    """key, n_groups, max_members, n_resolved, n_kinds, titles of (group, kind, status, title) rows."""
    sizes = members.groupBy(*key, *group).agg(F.count("*").alias("n"))
    top = sizes.groupBy(*key).agg(F.count("*").alias("n_groups"), F.max("n").alias("max_members"))
    facts = members.groupBy(*key).agg(F.count_if(F.col("status").isin("resolved", "ambiguous")).alias("n_resolved"), F.count_distinct("kind").alias("n_kinds"), F.array_sort(F.collect_set("title")).alias("titles"))
    return top.join(facts, key)
