"""Shared folders, bounded Arrow batches and table loading for the operators of this subpackage."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.storage import fresh_dir, remove, shared_root, written  # noqa: F401  the operators take them from here


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a SparkContext, so that Python workers can import it wherever they run."""
    context = spark.sparkContext
    if not getattr(context, "_stratalens_shipped", False):
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="stratalens-code-")  # the driver serves it as long as the context lives
        shutil.copytree(package, Path(folder, "tree", package.name), ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", f"{folder}/tree"))
        context._stratalens_shipped = True


def bucketed(df: DataFrame, path: str, column: str, buckets: int) -> DataFrame:
    """Like ``written``, in buckets of a column, so that a later join or grouping by it reads the rows where they are. The session's catalog names the table."""
    name = f"bucketed_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", path).bucketBy(buckets, column).saveAsTable(name)
    return df.sparkSession.table(name)


def bounded_batches(spark: SparkSession, rows: int = 1000, mb: int = 16) -> None:
    """For plans with Python: workers find this package, and Arrow batches stay small in rows and bytes, so that a worker's memory doesn't grow with the texts."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{mb}m")
    except Exception as e:  # a Spark that doesn't know it, or holds it fixed, keeps to the bound on rows
        if "CANNOT_MODIFY" not in str(e):
            raise


def most_frequent(counted: DataFrame, limit: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``limit`` tokens with the highest counts from ``least`` on (token, n rows), sorted, and the place of each in their order from rare to frequent."""
    sums = counted.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    top = sums.orderBy(F.desc("n"), "token").limit(limit).toArrow()
    tokens, counts = top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy()
    ranks = np.empty(len(tokens), np.int32)
    ranks[np.lexsort((tokens, counts))] = np.arange(len(tokens))
    order = np.argsort(tokens)
    return tokens[order], ranks[order]
