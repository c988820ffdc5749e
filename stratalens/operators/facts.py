"""Duplicate facts (pattern P001): grouping by signature, strict and rounding-aware conflicts, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions import numbers as N
from stratalens.functions import signatures as S

CODES = ("duplicate_fact", "value_conflict")


def duplicate_groups(facts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_facts of groups with more than one fact."""
    return facts.groupBy(*keys).agg(F.count("*").alias("n_facts")).where("n_facts > 1")


def strict_conflicts(facts: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Groups whose facts have more than one value; n_facts, n_values."""
    groups = facts.withColumn("__v", value).groupBy(*keys).agg(F.count("*").alias("n_facts"), F.count_distinct("__v").alias("n_values"))
    return groups.where("n_facts > 1 and n_values > 1")


def rounded_conflicts(facts: DataFrame, keys: list[str], low: Column, high: Column) -> DataFrame:
    """Groups whose rounding intervals have no common point; n_facts, max_low, min_high."""
    groups = facts.withColumns({"__l": low, "__h": high}).groupBy(*keys).agg(F.count("*").alias("n_facts"), F.max("__l").alias("max_low"), F.min("__h").alias("min_high"))
    return groups.where("n_facts > 1 and max_low > min_high")


def signed(facts: DataFrame, contexts: DataFrame) -> DataFrame:
    """Facts with their signature; facts without a context or with an unknown kind of period have none and are dropped."""
    own = contexts.select(
        "accession", "context_ref", "entity_scheme", "entity_identifier",
        S.period(F.col("period_kind"), F.col("instant"), F.col("start"), F.col("end")).alias("period_sig"),
        S.dimensions(F.transform(F.coalesce("dims", F.array()), lambda d: F.struct(d["dim"].alias("dim"), F.when(d["kind"] == "typed", S.typed_member(d["typed_value"])).otherwise(d["member"]).alias("member")))).alias("dim_sig"),
    )
    unit = S.unit(F.col("unit.measures"), F.col("unit.denominators"), F.col("unit.id"))
    joined = facts.join(own, ["accession", "context_ref"])
    sig = S.duplicate_fact(F.col("qname.clark"), F.col("entity_scheme"), F.col("entity_identifier"), F.col("period_sig"), F.col("dim_sig"), unit)
    return joined.withColumn("signature", sig).where("signature is not null")


def detect(facts: DataFrame, contexts: DataFrame, mode: str = "rounded") -> DataFrame:
    """accession, signature, instance_id, n_facts, issue_codes, facts: one row per conflicting group. Any mode but
    ``strict`` compares rounding intervals where all values are numbers."""
    rows = signed(facts, contexts)
    numeric = F.coalesce("is_numeric", F.lit(False)) | F.col("unit").isNotNull()
    nil = F.coalesce("is_nil", F.lit(False))
    value = N.number(F.col("value"))
    text = N.value_text(F.col("value"), numeric, nil)
    span = N.interval(value, F.col("decimals"), F.col("precision"))
    ref = F.struct("context_ref", F.col("qname.clark").alias("concept"), "value", "decimals", "precision", "fact_id")
    rows = rows.withColumns({"__text": text, "__nil": nil, "__plain": ~nil & (~numeric | value.isNull()), "__low": F.when(~nil, span["low"]), "__high": F.when(~nil, span["high"])})
    groups = rows.groupBy("accession", "signature").agg(
        F.count("*").alias("n_facts"), F.min("__text").alias("least"), F.max("__text").alias("most"), F.bool_or("__plain").alias("plain"),
        F.bool_or("__nil").alias("some_nil"), F.bool_and("__nil").alias("all_nil"), F.max("__low").alias("low"), F.min("__high").alias("high"),
        F.array_sort(F.collect_list(ref)).alias("facts"),
    )
    strict = F.coalesce(F.col("least") != F.col("most"), F.lit(False))  # two values, without a count of distinct ones, which would group by the text too
    rounded = (F.col("some_nil") & ~F.col("all_nil")) | F.coalesce(F.col("low") > F.col("high"), F.lit(False))
    conflict = strict if mode == "strict" else F.when(F.col("plain"), strict).otherwise(rounded)
    found = groups.where((F.col("n_facts") > 1) & conflict)
    return found.select("accession", "signature", S.sha(F.col("signature")).alias("instance_id"), "n_facts", F.array(*map(F.lit, CODES)).alias("issue_codes"), "facts")


def duplicate_contexts(contexts: DataFrame) -> DataFrame:
    """Planned pattern P007: contexts of one entity, period and dimension set."""
    sig = S.duplicate_context(F.col("entity_scheme"), F.col("entity_identifier"), S.period(F.col("period_kind"), F.col("instant"), F.col("start"), F.col("end")), S.dimensions(F.transform(F.coalesce("dims", F.array()), lambda d: F.struct(d["dim"].alias("dim"), F.coalesce(d["member"], d["typed_value"]).alias("member")))))
    groups = contexts.withColumn("signature", sig).where("signature is not null").groupBy("accession", "signature")
    return groups.agg(F.count("*").alias("n_contexts"), F.array_sort(F.collect_set("context_ref")).alias("contexts")).where("n_contexts > 1")


def inconsistent_dimensions(facts: DataFrame, contexts: DataFrame) -> DataFrame:
    """Planned pattern P003: a concept that is reported with several dimension sets in one period."""
    rows = signed(facts, contexts)
    return rows.groupBy("accession", F.col("qname.clark").alias("concept"), "entity_identifier", "period_sig").agg(F.count_distinct("dim_sig").alias("n_dimension_sets")).where("n_dimension_sets > 1")
