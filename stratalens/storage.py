"""The folder that driver and executors share, and tables in it that cut a plan's lineage."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Whether a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or an own folder where it is unset and driver and executors are one process (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.stratalens.shared", "")
    if not root:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stratalens-")
        spark.conf.set("spark.stratalens.shared", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files behind; otherwise they lie on the executors' disks until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
    except Exception as e:  # a Spark that doesn't know it, or holds it fixed, keeps the files longer
        if "CANNOT_MODIFY" not in str(e):
            raise
        yield
        return
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame, path: str) -> DataFrame:
    schema = df.schema
    with shuffles_removed(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a SparkContext, so that Python workers can import it wherever they run."""
    context = spark.sparkContext
    if not getattr(context, "_stratalens_shipped", False):
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="stratalens-code-")  # the driver serves it as long as the context lives
        shutil.copytree(package, Path(folder, "tree", package.name), ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", f"{folder}/tree"))
        context._stratalens_shipped = True
