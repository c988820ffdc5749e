"""Artifacts that a document leads to: relative references resolved as Columns, and their closure as a fixpoint over rows.

A reference is resolved against the path of the file that holds it: fragments and queries fall away, dot segments are taken out, and a step
above the root is told, not followed. References are extracted and resolved once per file; each round joins only what the round before found new. What a
limit on depth leaves out is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens import storage
from stratalens.functions import text as T

#: Elements that name other files, and the attribute that does.
KINDS = {"schemaRef": "href", "linkbaseRef": "href", "include": "schemaLocation", "redefine": "schemaLocation", "import": "schemaLocation"}
MAX_DEPTH = 50
FOUND = "root string, path string, depth int"


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))


def resolved(base: Column, href: Column) -> Column:
    """struct(path, status) of a reference in the file ``base`` (a path below the root): ok, external, empty, absolute, escapes; only ok has a path."""
    bare = F.regexp_replace(T.collapsed(href), r"[?#].*$", "")
    whole = T.collapsed(href)
    folder = F.regexp_replace(base, r"[^/]*$", "")
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(False).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        up = s == ".."
        stack = F.when(~up, F.concat(acc["stack"], F.array(s))).when(F.size(acc["stack"]) > 0, F.slice(acc["stack"], 1, F.size(acc["stack"]) - 1)).otherwise(acc["stack"])
        return F.struct(stack.alias("stack"), (acc["out"] | (up & (F.size(acc["stack"]) == 0))).alias("out"))

    walked = F.aggregate(F.concat(segments(folder), segments(bare)), start, step)
    status = (
        F.when(whole.rlike(r"^([A-Za-z][A-Za-z0-9+.\-]*:|//)"), "external").when(bare == "", "empty").when(bare.startswith("/"), "absolute").when(walked["out"] | (F.size(walked["stack"]) == 0), "escapes").otherwise("ok")
    )
    return F.struct(F.when(status == "ok", F.array_join(walked["stack"], "/")).otherwise("").alias("path"), status.alias("status"))


def references(documents: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """path, kind, href, to, status of the references in documents (path, content); repeated ones count once."""
    parts = None
    for kind, attribute in (kinds or KINDS).items():
        pattern = rf"(?is)<(?:[\w.\-]+:)?{kind}\b[^>]*?\b{attribute}\s*=\s*[\"']([^\"']*)[\"']"
        own = documents.select("path", F.lit(kind).alias("kind"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)))).alias("href"))
        parts = own if parts is None else parts.union(own)
    return parts.withColumn("r", resolved(F.col("path"), F.col("href"))).select("path", "kind", "href", F.col("r.path").alias("to"), F.col("r.status").alias("status"))


def closure(links: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """links: path, to. Every (root, path, depth) that is reached, the root's own path (depth 0) included, at its least depth; and the links (root, path, to)
    that the limit leaves out. Cycles end where nothing is new.

    What is reached again is taken out where the depth is a power of two, and at the limit: all rows before are read that often only, and what follows from
    rows in between that are no news isn't news either. In between a step has no row twice."""
    base = storage.fresh_dir(links.sparkSession, "closure")
    links = storage.written(links.select("path", "to").where("path <> to").distinct(), f"{base}/links")
    front = storage.written(roots.select("root", "path", F.lit(0).alias("depth")).distinct(), f"{base}/0")
    seen, fresh, depth, check = front, None, 0, 1
    while True:
        if depth == max_depth:
            step = front.join(links, "path").select("root", F.col("path").alias("by"), F.col("to").alias("path")).join(seen.select("root", "path"), ["root", "path"], "left_anti")
            return seen, storage.written(step.select("root", F.col("by").alias("path"), F.col("path").alias("to")), f"{base}/beyond")
        depth += 1
        step = front.join(links, "path").select("root", F.col("to").alias("path")).distinct().withColumn("depth", F.lit(depth))
        front = storage.written(step, f"{base}/{depth}")
        fresh = front if fresh is None else fresh.union(front)
        over = front.isEmpty()
        if over or depth in (check, max_depth):
            least = fresh.groupBy("root", "path").agg(F.min("depth").alias("depth")) if fresh is not front else fresh
            new = storage.written(least.join(seen.select("root", "path"), ["root", "path"], "left_anti"), f"{base}/{depth}-new")
            seen, fresh, check = seen.union(new), None, 2 * check
            front = new.where(F.col("depth") == depth)
            if over or front.isEmpty():
                return seen, links.select(F.lit("").alias("root"), "path", "to").limit(0)


def collect(documents: DataFrame, files: DataFrame, primaries: DataFrame, max_depth: int = MAX_DEPTH, kinds: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Artifacts (root, path, role, depth, sha256, bytes) of each primary document (path), with hashes from files (path, sha256, bytes); and problems (root, path, href, problem):
    references of other kinds than relative ones (external ones are none), files that are missing, and what lies beyond the depth."""
    refs = storage.written(references(documents, kinds), storage.fresh_dir(documents.sparkSession, "references"))
    good = refs.where("status = 'ok'")
    there = good.join(files.select(F.col("path").alias("to")), "to", "left_semi")
    found, beyond = closure(there, primaries.select(F.col("path").alias("root"), "path"), max_depth)
    found = storage.written(found, storage.fresh_dir(documents.sparkSession, "artifacts"))
    role = F.when(F.col("path") == F.col("root"), "primary").otherwise("artifact")
    artifacts = found.join(files.select("path", "sha256", "bytes"), "path").select("root", "path", role.alias("role"), "depth", "sha256", "bytes")
    odd = found.join(refs.where(~F.col("status").isin("ok", "external")), "path").select("root", "path", "href", F.col("status").alias("problem"))
    lost = found.join(good.join(files.select(F.col("path").alias("to")), "to", "left_anti"), "path").select("root", "path", "href", F.lit("missing").alias("problem"))
    deep = beyond.select("root", "path", F.col("to").alias("href"), F.lit("beyond_depth").alias("problem"))
    return artifacts, odd.union(lost).union(deep).distinct()
