"""Packs of files: a sink that stores contents by their hash and commits in two phases, with manifests written last.

Rows (pack_id, path, content) are written with ``df.write.format("evidence_pack").option("path", ...)``. A task puts each content at the place that its sha256 names, so
that a repeated or lost task changes nothing, and lists its rows in a staged file of its own. Only the driver's commit, after all tasks, names the
staged files that count; a job that fails leaves contents and staged files that nothing refers to, and no manifest. Commit messages are one name a
task. Empty contents have no file. ``assemble`` writes the files first, builds each pack's manifest from what was committed, and writes the manifests as a second commit.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from stratalens import storage
from stratalens.functions import signatures as S
from stratalens.functions import text as T
from stratalens.operators import integrity

COMMIT = "_committed.json"
ENTRY = "pack_id string, path string, sha256 string, bytes bigint"


@dataclass(frozen=True)
class Layout:
    """Files that a pack must have, and roles by the start of a path."""

    findings: str = "findings.json"
    toolchain: str = "toolchain/toolchain.json"
    artifacts: str = "artifacts/"
    manifest: str = integrity.MANIFEST_NAME
    roles: tuple[tuple[str, str], ...] = (("findings.json", "output"), ("toolchain/toolchain.json", "toolchain"), ("reproduction_steps.json", "reproduction_steps"), ("artifacts/", "artifact"))


@dataclass
class Staged(WriterCommitMessage):
    name: str


def _filesystem(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


class PackWriter(DataSourceArrowWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite = root.rstrip("/"), overwrite

    def write(self, iterator: Iterator) -> Staged:
        import hashlib

        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        target, base = _filesystem(self.root)
        name, out = f"{uuid.uuid4().hex}.parquet", None
        schema = pa.schema([("pack_id", pa.string()), ("path", pa.string()), ("sha256", pa.string()), ("bytes", pa.int64())])
        target.create_dir(f"{base}/_staged", recursive=True)
        for batch in iterator:
            rows = []
            for pack, path, content in zip(*(batch.column(c).to_pylist() for c in ("pack_id", "path", "content"))):
                content = content or b""
                sha = hashlib.sha256(content).hexdigest()
                place = f"{base}/objects/{sha[:2]}/{sha}"
                if content and target.get_file_info(place).type != fs.FileType.File:
                    target.create_dir(f"{base}/objects/{sha[:2]}", recursive=True)
                    part = f"{place}.{name}"
                    with target.open_output_stream(part, compression=None) as f:
                        f.write(content)
                    target.move(part, place)  # whole or not there
                rows.append((pack, path, sha, len(content)))
            if out is None:
                out = pq.ParquetWriter(f"{base}/_staged/{name}", schema, filesystem=target)
            out.write_table(pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema))
        if out is None:
            return Staged("")
        out.close()
        return Staged(name)

    def commit(self, messages: list) -> None:
        target, base = _filesystem(self.root)
        names = [] if self.overwrite else committed(self.root)
        names = sorted({*names, *(m.name for m in messages if m is not None and m.name)})
        target.create_dir(base, recursive=True)
        part = f"{base}/{COMMIT}.{uuid.uuid4().hex}"
        with target.open_output_stream(part, compression=None) as f:
            f.write(json.dumps(names).encode())
        target.move(part, f"{base}/{COMMIT}")

    def abort(self, messages: list) -> None:
        target, base = _filesystem(self.root)
        for m in messages:
            if m is not None and m.name:
                target.delete_file(f"{base}/_staged/{m.name}")


class PackSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "evidence_pack"

    def writer(self, schema, overwrite: bool) -> PackWriter:
        missing = {"pack_id", "path", "content"} - set(schema.names)
        if missing:
            raise ValueError(f"rows of packs need the columns {sorted(missing)}")
        return PackWriter(self.options["path"], overwrite)


def committed(root: str) -> list[str]:
    """Names of the staged files that count."""
    from pyarrow import fs

    target, base = _filesystem(root.rstrip("/"))
    if target.get_file_info(f"{base}/{COMMIT}").type != fs.FileType.File:
        return []
    with target.open_input_file(f"{base}/{COMMIT}") as f:
        return json.loads(f.read())


def write_files(files: DataFrame, root: str, mode: str = "append") -> None:
    spark = files.sparkSession
    storage.ship(spark)
    spark.dataSource.register(PackSink)
    files.select("pack_id", "path", F.col("content").cast("binary").alias("content")).write.format("evidence_pack").option("path", root).mode(mode).save()


def entries(spark: SparkSession, root: str) -> DataFrame:
    """pack_id, path, sha256, bytes of all that was committed; rows written twice count once."""
    names = committed(root)
    if not names:
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).parquet(*(f"{root.rstrip('/')}/_staged/{n}" for n in names)).distinct()


def problems(found: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """pack_id, path, problem: paths that leave the pack, paths with several contents, and required files that are missing."""
    safe = (F.length("path") > 0) & ~F.col("path").rlike(r"^/|\\|[\x00-\x1f]|(^|/)\.{0,2}(/|$)")
    unsafe = found.where(~F.coalesce(safe, F.lit(False))).select("pack_id", "path", F.lit("unsafe_path").alias("problem"))
    twice = found.groupBy("pack_id", "path").agg(F.count_distinct("sha256").alias("n")).where("n > 1").select("pack_id", "path", F.lit("several_contents").alias("problem"))
    has = found.groupBy("pack_id").agg(*(F.bool_or(test).alias(name) for name, test in ((layout.findings, F.col("path") == layout.findings), (layout.toolchain, F.col("path") == layout.toolchain), (layout.artifacts, F.col("path").startswith(layout.artifacts)))))
    lacks = F.array_compact(F.array(*(F.when(~F.col(f"`{n}`"), F.lit(n)) for n in (layout.findings, layout.toolchain, layout.artifacts))))
    missing = has.select("pack_id", F.explode(lacks).alias("path"), F.lit("missing").alias("problem"))
    return unsafe.union(twice).union(missing)


def manifests(found: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """pack_id, pack_sha256, document: one JSON text per pack over its files in the order of their paths; the manifest itself isn't among them."""
    role = F.lit("other")
    for start, name in reversed(layout.roles):
        role = F.when(F.col("path").startswith(start) if start.endswith("/") else F.col("path") == start, name).otherwise(role)
    rows = found.where(F.col("path") != layout.manifest).select("pack_id", F.struct("path", "bytes", role.alias("role"), "sha256").alias("f"))
    lists = rows.groupBy("pack_id").agg(F.array_sort(F.collect_list("f")).alias("files"))  # one pack's files
    sha = S.list_hash(F.transform("files", lambda f: F.struct(f["path"].alias("path"), f["sha256"].alias("sha"))))
    files = F.transform("files", lambda f: F.struct(f["bytes"].alias("bytes"), f["path"].alias("path"), f["role"].alias("role"), f["sha256"].alias("sha256")))
    out = lists.select("pack_id", T.let(sha, lambda x: x).alias("pack_sha256"), files.alias("files"))
    return out.select("pack_id", "pack_sha256", F.to_json(F.struct("files", "pack_id", "pack_sha256", F.lit("1.0").alias("schema_version"))).alias("document"))


def assemble(files: DataFrame, root: str, layout: Layout = Layout()) -> DataFrame:
    """Write packs into an empty or new root: contents first, then the manifests of packs without problems. Returns pack_id, pack_sha256, document of these."""
    spark = files.sparkSession
    if committed(root):
        raise ValueError(f"packs were committed to {root} before")
    write_files(files, root)
    found = entries(spark, root)
    good = manifests(found, layout).join(problems(found, layout).select("pack_id").distinct(), "pack_id", "left_anti")
    good = storage.written(good, storage.fresh_dir(spark, "manifests"))
    write_files(good.select("pack_id", F.lit(layout.manifest).alias("path"), F.encode("document", "UTF-8").alias("content")), root)
    return good


def verify(spark: SparkSession, root: str) -> DataFrame:
    """sha256, status of stored contents: ok, missing (listed, not there), sha_mismatch (changed), unlisted (there, listed by no commit)."""
    listed = entries(spark, root).select("sha256").distinct()
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "?" * 64).load(f"{root.rstrip('/')}/objects")
    there = there.select(F.regexp_extract("path", "([^/]+)$", 1).alias("sha256"), F.sha2("content", 256).alias("__now"))
    both = listed.withColumn("__listed", F.lit(True)).join(there, "sha256", "full_outer")
    status = F.when(F.col("sha256") == F.sha2(F.lit(""), 256), "ok").when(F.col("__listed").isNull(), "unlisted").when(F.col("__now").isNull(), "missing").when(F.col("__now") != F.col("sha256"), "sha_mismatch").otherwise("ok")
    return both.select("sha256", status.alias("status"))
