"""Tables in the shared folder."""

from pathlib import Path

from pyspark.sql import functions as F

from stratalens import storage


def shuffle_files(spark) -> set[str]:
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {str(p) for d in dirs for p in Path(d.getPath()).rglob("shuffle_*")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(storage.CLEANUP)
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    out = storage.written(counts, storage.fresh_dir(spark, "counts"))
    assert shuffle_files(spark) <= before
    assert spark.conf.get(storage.CLEANUP) == setting
    assert {r["n"] for r in out.collect()} == {142, 143}
