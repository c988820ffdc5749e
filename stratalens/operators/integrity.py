"""Manifests of files with hashes, and their verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.functions import signatures as S

MANIFEST_NAME = "pack_manifest.json"
MAX_BYTES = 10 << 20
ARCHIVES = r"(?i)\.(zip|tar|tgz|tar\.gz|7z)$"


def scan_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path (below root), sha256, bytes of all files; contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.split(":", 1)[-1].rstrip("/").lstrip("/")
    return files.select(F.regexp_replace("path", rf"^.*?\Q{base}\E/", "").alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def pack_hash(files: DataFrame, path: str = "path", sha: str = "sha256") -> DataFrame:
    """One row: sha256 over path<tab>sha lines in order of path, without the manifest itself."""
    rows = files.where(F.col(path) != MANIFEST_NAME).select(F.struct(F.col(path).alias("path"), F.col(sha).alias("sha")).alias("e"))
    return rows.agg(S.list_hash(F.collect_list("e")).alias("pack_sha256"), F.count("*").alias("n_files"))


def verify(manifest: DataFrame, found: DataFrame, key: str = "path") -> DataFrame:
    """The manifest's rows with status: missing, size_mismatch, sha_mismatch or ok."""
    m = manifest.select(key, F.col("bytes").alias("__mb"), F.col("sha256").alias("__ms"))
    f = found.select(key, F.col("bytes").alias("__fb"), F.col("sha256").alias("__fs"))
    status = F.when(F.col("__fs").isNull(), "missing").when(F.col("__mb") != F.col("__fb"), "size_mismatch").when(F.col("__ms") != F.col("__fs"), "sha_mismatch").otherwise("ok")
    return m.join(f, key, "left").select(key, status.alias("status"))


def split_redistributable(files: DataFrame, own_hosts: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Files to keep, and files to name by reference only: of a foreign host, over the size limit with an address, or archives."""
    host = F.lower(F.coalesce(F.expr("try_parse_url(source_url, 'HOST')"), F.lit("")))
    foreign = (host != "") & ~host.isin(*own_hosts)
    large = (F.coalesce("source_url", F.lit("")) != "") & (F.col("bytes") > MAX_BYTES)
    out = foreign | large | F.col("path").rlike(ARCHIVES)
    rows = files.withColumn("__out", F.coalesce(out, F.lit(False)))
    return rows.where("not __out").drop("__out"), rows.where("__out").drop("__out")
