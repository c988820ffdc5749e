"""Raw filing documents: attributes, first matches, inline facts, references, complete submissions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.functions import text as T

#: Prefix of a document in which a schema reference is looked for.
PREFIX = 64 * 1024


def attribute_values(rows: DataFrame, key: list[str], html: str, attribute: str) -> DataFrame:
    """key and each quoted value of the attribute, in a column of its name."""
    return rows.select(*key, F.explode(F.regexp_extract_all(html, F.lit(rf'{attribute}="([^"]*)"'), F.lit(1))).alias(attribute))


def first_match(rows: DataFrame, key: list[str], html: str, fields: dict[str, str], name: str) -> DataFrame:
    """key, ``name``, provenance: the first pattern, in order, with a non-empty match."""
    found = F.array(*(F.struct(T.collapsed(T.without_tags(F.regexp_extract(html, p, 1))).alias("value"), F.lit(f).alias("field")) for f, p in fields.items()))
    some = F.try_element_at(F.filter(found, lambda x: x["value"] != ""), F.lit(1))
    return rows.select(*key, some.alias("m")).select(*key, F.coalesce("m.value", F.lit("")).alias(name), F.coalesce("m.field", F.lit("")).alias("provenance"))


ELEMENT = r"(?is)<ix:(?:nonNumeric|nonFraction)\b[^>]*>.*?</ix:(?:nonNumeric|nonFraction)>"


def attribute(element: Column, name: str) -> Column:
    return F.regexp_extract(element, rf"(?is)^<[^>]*?\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)


def inline_facts(pages: DataFrame, key: list[str], html: str) -> DataFrame:
    """key, pos, name, context_ref, unit_ref, decimals, value of every inline element."""
    rows = pages.select(*key, F.posexplode(F.regexp_extract_all(html, F.lit(ELEMENT), F.lit(0))).alias("pos", "e"))
    body = T.normalized(T.without_tags(F.regexp_replace("e", r"(?is)^<[^>]*>", "")))
    return rows.select(*key, "pos", attribute(F.col("e"), "name").alias("name"), attribute(F.col("e"), "contextRef").alias("context_ref"), attribute(F.col("e"), "unitRef").alias("unit_ref"), attribute(F.col("e"), "decimals").alias("decimals"), body.alias("value"))


def metadata(facts: DataFrame, key: list[str], priorities: dict[str, list[str]]) -> DataFrame:
    """key, field, value, concept: per field the first fact of the first concept, by local name, that the document has."""
    rules = [F.struct(F.lit(f).alias("field"), F.lit(c).alias("concept"), F.lit(i).alias("rank")) for f, names in priorities.items() for i, c in enumerate(names)]
    rows = facts.withColumn("local", F.regexp_extract("name", r"([^:]+)$", 1)).withColumn("r", F.explode(F.filter(F.array(*rules), lambda r: r["concept"] == F.col("local"))))
    best = F.min_by(F.struct(F.col("value"), F.col("local").alias("concept")), F.struct(F.col("r.rank").alias("rank"), F.col("pos").alias("pos")))
    return rows.where("value <> ''").groupBy(*key, F.col("r.field").alias("field")).agg(best.alias("b")).select(*key, "field", "b.value", "b.concept")


def schema_refs(pages: DataFrame, key: list[str], html: str, kind: str = "schemaRef") -> DataFrame:
    """key, href of schemaRef or linkbaseRef elements, in document order and without repeats."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<(?:\w+:)?{kind}\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    return pages.select(*key, F.explode(F.array_distinct(found)).alias("href")).where("trim(href) <> ''")


def first_schema_ref(pages: DataFrame, key: list[str], html: str) -> DataFrame:
    return pages.select(*key, F.regexp_extract(F.substring(html, 1, PREFIX), r"(?is)<(?:\w+:)?schemaRef\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']", 1).alias("href")).where("href <> ''")


def unwrapped(text: Column) -> Column:
    """Without an <XBRL> wrapper, also one whose head is cut off."""
    return F.regexp_replace(F.regexp_replace(text, r"(?is)^\s*(?:<XBRL>|RL>)\s*", ""), r"(?is)\s*</XBRL>\s*$", "")


def declared_namespaces(schemas: DataFrame) -> DataFrame:
    """path, target_namespace, imports, includes of schema documents (path, content)."""
    text = F.col("content")
    names = lambda element, attr: F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?is)<(?:\w+:)?{element}\b[^>]*?\b{attr}\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1)))
    return schemas.select("path", F.regexp_extract(text, r"(?is)<(?:\w+:)?schema\b[^>]*?\btargetNamespace\s*=\s*[\"']([^\"']*)[\"']", 1).alias("target_namespace"), names("import", "namespace").alias("imports"), names("(?:include|redefine)", "schemaLocation").alias("includes"))


def closure(schemas: DataFrame, roots: DataFrame, max_rounds: int = 50) -> DataFrame:
    """root, path of all schemas that a root includes, over any number of steps; cycles end where nothing is new."""
    from stratalens import storage

    edges = schemas.select("path", F.explode("includes").alias("to")).where("to not like '%://%'").distinct()
    known = schemas.select("path")
    seen = roots.select("root", "path").join(known, "path").select("root", "path").distinct()
    base = storage.fresh_dir(schemas.sparkSession, "closure")
    front = seen = storage.written(seen, f"{base}/0")
    for k in range(1, max_rounds + 1):
        new = front.join(edges, "path").select("root", F.col("to").alias("path")).distinct().join(known, "path", "left_semi").select("root", "path").join(seen, ["root", "path"], "left_anti")
        front = storage.written(new, f"{base}/{k}")
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


SUBMISSION = "path string, accession string, sequence int, type string, filename string, description string, text string, error string"
_TAG = re.compile(r"^<([A-Z0-9\-]+)>(.*)$")


def _documents(content: str) -> Iterator[tuple]:
    """A submission's documents, or one row that says what is wrong."""
    accession, state, fields, lines, names = "", "submission", {}, [], set()
    for line in content.split("\n"):
        tag = _TAG.match(line.strip()) if state != "text" else None
        upper = line.strip().upper()
        if state == "submission":
            if upper == "<DOCUMENT>":
                state, fields, lines = "header", {}, []
            elif tag and tag[1] == "ACCESSION-NUMBER":
                accession = tag[2].strip()
        elif state == "header":
            if upper.startswith("<TEXT>"):
                state = "text"
            elif upper == "</DOCUMENT>":
                state = "submission"
            elif tag:
                fields[tag[1]] = tag[2].strip()
        elif state == "text":
            if upper == "</TEXT>":
                state = "after"
            else:
                lines.append(line)
        elif upper == "</DOCUMENT>":
            name = fields.get("FILENAME", "")
            sequence = fields.get("SEQUENCE", "")
            unsafe = not name or "/" in name or "\\" in name or name in (".", "..") or any(ord(c) < 32 for c in name)
            error = "unsafe_name" if unsafe else "duplicate_name" if name in names else ""
            names.add(name)
            yield accession, int(sequence) if sequence.isdigit() else None, fields.get("TYPE", ""), name, fields.get("DESCRIPTION", ""), "\n".join(lines), error
            state = "submission"
    if state != "submission":
        yield accession, None, fields.get("TYPE", ""), fields.get("FILENAME", ""), "", "", "unterminated_document"


def parse_submissions(files: DataFrame) -> DataFrame:
    """Files (path, content) to one row per document; a row's error is '' where nothing is wrong."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = [(path, *d) for d in _documents(content or "")]
                yield pd.DataFrame(rows, columns=["path", "accession", "sequence", "type", "filename", "description", "text", "error"]).astype({"sequence": "Int32"})

    return files.select("path", "content").mapInPandas(parse, SUBMISSION)


def register_udtf(spark: SparkSession) -> None:
    """parse_submission(content) as a table function for LATERAL joins in SQL."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="accession string, sequence int, type string, filename string, description string, text string, error string")
    class ParseSubmission:
        def eval(self, content: str):
            yield from _documents(content or "")

    spark.udtf.register("parse_submission", ParseSubmission)
