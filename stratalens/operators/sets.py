"""Set operations on keys: added, removed, common, union, incremental seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.functions import text as T


def changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """key, change (added or removed) of keys on one side only."""
    a, b = before.select(*key).distinct(), after.select(*key).distinct()
    return b.join(a, key, "left_anti").withColumn("change", F.lit("added")).union(a.join(b, key, "left_anti").withColumn("change", F.lit("removed")))


def common(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.select(*key).distinct().join(b.select(*key), key, "left_semi")


def union_distinct(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.distinct()


def seeds(rows: DataFrame, columns: list[str]) -> DataFrame:
    """id_type, value: distinct non-empty normalised identifiers of the columns, whose names are their types."""
    wide = rows.select(*(T.identifier(F.col(c)).alias(c) for c in columns))
    return wide.unpivot([], columns, "id_type", "value").where("value <> ''").distinct()


def new_seeds(found: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Seeds that the registry doesn't have yet."""
    return found.join(existing.select(*key), key, "left_anti")


def diagnostics(*parts: DataFrame) -> DataFrame:
    """Diagnostics of all stages with an id over their sorted fields."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.withColumn("diagnostic_id", F.sha2(F.to_json(F.struct(*sorted(out.columns))), 256))
