"""Type, unit and numeric rules of facts (pattern P004)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions import numbers as N
from stratalens.functions import signatures as S

MAX_PRECISION = 20


def codes(numeric: Column, measures: Column, concept_type: Column, decimals: Column, precision: Column) -> Column:
    """The sorted distinct codes that a fact violates; measures is null without a unit."""
    has_unit = measures.isNotNull()
    kind = F.lower(F.coalesce(concept_type, F.lit("")))
    any_of = lambda *words: F.exists(measures, lambda m: F.lower(m).rlike("|".join(words)))
    infinite = F.upper(F.trim(decimals)).isin("INF", "INFINITY")
    bad_decimals = decimals.isNotNull() & (F.trim(decimals) != "") & ~infinite & N.attribute(decimals).isNull()
    bad_precision = precision.isNotNull() & (N.attribute(precision).isNull() | (N.attribute(precision) > MAX_PRECISION))
    money = kind.rlike("monetary|money") & ~any_of("iso4217", "currency")
    pure = kind.rlike("decimal|integer|pure") & ((F.size(measures) > 1) | ((F.size(measures) > 0) & ~F.lower(F.get(measures, 0)).contains("pure")))
    table = [
        ("decimals_precision_conflict", numeric & decimals.isNotNull() & precision.isNotNull()),
        ("invalid_decimals", numeric & bad_decimals),
        ("invalid_precision", numeric & bad_precision),
        ("missing_unit", numeric & ~has_unit),
        ("non_numeric_with_unit", ~numeric & has_unit),
        ("unit_incompatible", numeric & has_unit & concept_type.isNotNull() & (money | pure)),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in table)))


def violations(facts: DataFrame, **columns: Column) -> DataFrame:
    """One row per fact and code: the facts' columns with issue_code."""
    return facts.withColumn("issue_code", F.explode(codes(**columns)))


def detect(facts: DataFrame) -> DataFrame:
    """accession, context_ref, concept, issue_code, signature, instance_id; facts without a context have no instance."""
    found = codes(F.coalesce("is_numeric", F.lit(False)), F.col("unit.measures"), F.col("concept_type"), F.col("decimals"), F.col("precision"))
    unit = S.unit(F.col("unit.measures"), F.col("unit.denominators"), F.col("unit.id"))
    # nested columns are read before the codes are taken apart
    flat = facts.where("context_ref is not null").select("accession", "context_ref", F.col("qname.clark").alias("concept"), unit.alias("__unit"), found.alias("__codes"))
    rows = flat.select("accession", "context_ref", "concept", "__unit", F.explode("__codes").alias("issue_code"))
    sig = S.fact_rule(F.col("concept"), F.col("context_ref"), F.col("__unit"), F.col("issue_code"))
    return rows.select("accession", "context_ref", "concept", "issue_code", sig.alias("signature"), S.sha(sig).alias("instance_id"))
