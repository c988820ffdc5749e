"""Taxonomy consistency (pattern P005), required content (planned P006), namespace resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions import signatures as S

VERSION = r"^(.*)/(\d{4}-\d{2}-\d{2})$"


def undeclared(used: DataFrame, declared: DataFrame, key: list[str], name: str) -> DataFrame:
    """Used names that are not declared, of keys that declare anything at all."""
    some = declared.select(*key).distinct()
    return used.select(*key, name).distinct().join(some, key, "left_semi").join(declared.select(*key, name).distinct(), [*key, name], "left_anti")


def mixed_versions(rows: DataFrame, key: list[str], base: Column, version: Column) -> DataFrame:
    """key, base, versions where a base has more than one version."""
    own = rows.select(*key, base.alias("base"), version.alias("version")).where("base <> '' and version <> ''")
    return own.groupBy(*key, "base").agg(F.array_sort(F.collect_set("version")).alias("versions")).where(F.size("versions") > 1)


def detect(schema_refs: DataFrame, declared: DataFrame, fact_namespaces: DataFrame) -> DataFrame:
    """accession, issue_code, details, signature, instance_id; at most one row for each of the two codes. Both look at the namespaces
    that facts use; a schema that imports another version isn't mixed by that."""
    key = ["accession"]
    used = fact_namespaces.select("accession", "namespace").distinct()
    missing = undeclared(used, declared, key, "namespace").groupBy(*key).agg(F.array_sort(F.collect_set("namespace")).alias("details")).withColumn("issue_code", F.lit("namespace_schema_ref_mismatch"))
    mixed = mixed_versions(used, key, F.regexp_extract("namespace", VERSION, 1), F.regexp_extract("namespace", VERSION, 2))
    mixed = mixed.groupBy(*key).agg(F.array_sort(F.collect_set(F.concat_ws("=", "base", F.array_join("versions", ",")))).alias("details")).withColumn("issue_code", F.lit("mixed_taxonomy_versions"))
    lists = used.groupBy(*key).agg(F.collect_set("namespace").alias("namespaces")).join(schema_refs.where("href <> ''").groupBy(*key).agg(F.collect_set("href").alias("refs")), key, "left")
    found = missing.unionByName(mixed).join(lists, key, "left")
    sig = S.taxonomy(F.col("issue_code"), F.coalesce("refs", F.array().cast("array<string>")), F.coalesce("namespaces", F.array().cast("array<string>")))
    return found.select("accession", "issue_code", "details", sig.alias("signature"), S.sha(sig).alias("instance_id"))


def missing_content(filings: DataFrame, required: DataFrame, present: DataFrame) -> DataFrame:
    """Planned P006: required names of a filing's form that it doesn't hold."""
    return filings.select("accession", "form").join(required, "form").join(present.select("accession", "name"), ["accession", "name"], "left_anti")


def resolve_packages(namespaces: DataFrame, packages: DataFrame) -> DataFrame:
    """Pinned packages for namespaces: exact first, then the longest prefix. A namespace is joined by its prefixes of the lengths that
    packages have, by equality."""
    lengths = packages.select(F.length("package_namespace").alias("n")).distinct().agg(F.collect_set("n").alias("lengths"))  # lengths of addresses: a few hundred at most
    own = namespaces.select("namespace").distinct().join(F.broadcast(lengths))
    prefixes = own.select("namespace", F.explode(F.filter("lengths", lambda n: n <= F.length("namespace"))).alias("n")).select("namespace", F.expr("left(namespace, n)").alias("package_namespace"))
    hits = prefixes.join(packages, "package_namespace").groupBy("namespace").agg(F.max_by("package", F.struct(F.length("package_namespace"), F.col("package"))).alias("package"))
    return namespaces.select("namespace").distinct().join(hits, "namespace", "left")
