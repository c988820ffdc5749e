"""Sinks with a fixed order of rows and fields: JSON documents, JSON lines, CSV, and the scan's set of tables.

Files are folders of part files, as Spark writes them; names of parts are in the order of the rows. ``one_file`` gathers a small result in one part.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def sorted_fields(name: str | Column, schema, path: Column | None = None) -> Column:
    """A value with the fields of every struct inside it in the order of their names."""
    value = path if path is not None else F.col(name)
    if isinstance(schema, StructType):
        return F.when(value.isNotNull(), F.struct(*(sorted_fields("", f.dataType, value[f.name]).alias(f.name) for f in sorted(schema.fields, key=lambda f: f.name))))
    if isinstance(schema, ArrayType) and isinstance(schema.elementType, (StructType, ArrayType)):
        return F.transform(value, lambda x: sorted_fields("", schema.elementType, x))
    if isinstance(schema, MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(value)))
    return value


def row_json(df: DataFrame) -> Column:
    """Each row as JSON with sorted fields; nulls are kept."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    return F.to_json(F.struct(*(sorted_fields(f"`{f.name}`", f.dataType).alias(f.name) for f in fields)), {"ignoreNullFields": "false"})


def _ordered(df: DataFrame, order: list, one_file: bool) -> DataFrame:
    return df.coalesce(1).sortWithinPartitions(*order) if one_file else df.orderBy(*order)


def write_jsonl(df: DataFrame, path: str, order: list[str], one_file: bool = False) -> None:
    """JSON lines in the order of the columns ``order`` and then of the text."""
    rows = _ordered(df.select(*order, row_json(df).alias("__json")), [*order, "__json"], one_file)
    rows.select("__json").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, order: list, one_file: bool = False) -> None:
    """CSV with a header; lists as texts joined by a semicolon, other nested values as JSON."""
    flat = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, ArrayType) and not isinstance(f.dataType.elementType, (StructType, ArrayType, MapType)):
            flat[f.name] = F.array_join(F.col(f.name).cast("array<string>"), ";")
        elif isinstance(f.dataType, (StructType, ArrayType, MapType)):
            flat[f.name] = F.to_json(F.col(f.name))
    rows = _ordered(df, order, one_file)
    (rows.withColumns(flat) if flat else rows).write.mode("overwrite").option("header", True).option("emptyValue", "").option("quote", '"').option("escape", '"').csv(path)


def write_documents(docs: DataFrame, path: str) -> None:
    """(accession, document) rows as one text each, by accession."""
    docs.orderBy("accession").select("document").write.mode("overwrite").text(path)


def write_scan(candidates: DataFrame, seeds: DataFrame, pack_inputs: DataFrame, diagnostics: DataFrame, root: str) -> Mapping[str, str]:
    """The scan's outputs below ``root``; returns their paths."""
    paths = {n: f"{root}/{n}" for n in ("candidates.jsonl", "summary.csv", "seeds.jsonl", "pack_inputs.jsonl", "diagnostics.jsonl")}
    write_jsonl(candidates, paths["candidates.jsonl"], ["rank"])
    columns = ["rank", "candidate_id", "source_scope_key", "issue_codes", "continuity_class", "registry_status", "score", "report_periods"]
    write_csv(candidates.select(*(c for c in columns if c in candidates.columns)), paths["summary.csv"], ["rank"])
    write_jsonl(seeds, paths["seeds.jsonl"], ["rank", "id_type", "value"])
    write_jsonl(pack_inputs, paths["pack_inputs.jsonl"], ["rank"])
    write_jsonl(diagnostics, paths["diagnostics.jsonl"], [])
    return paths
