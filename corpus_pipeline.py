"""Corpus pipeline: quality, near duplicates, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns that ``docs`` has. ``run``
writes each stage's rows as Parquet in the shared folder and reads them again for the next. Rows with a null doc_id pass the
near-duplicate stage; rows repeated with one doc_id count as one document there and stay together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm import decontaminate, group_matrix, hash_tree, line_crf, mixing, shared

#: The mixture takes this share of the tokens that reach it, each document once.
MIX_SHARE, SHARDS = 0.9, 8


#: Columns that the operators read; others are out of their sight under names that no operator uses.
READ = ("doc_id", "text", "lang", "source")


def shielded(docs: DataFrame) -> DataFrame:
    return docs.toDF(*(c if c in READ else f"extra_{i}" for i, c in enumerate(docs.columns)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF rejects go. Null and empty texts have a score like any other; repeated rows share a fate; with labels of one
    kind only every score is 0.5 and all stay; an empty table stays empty."""
    own = shielded(docs)
    scored = line_crf.score_documents(own, shared.load(spark, sf_dir, "labels"), keep=tuple(own.columns))
    return scored.where(F.col("__score") >= line_crf.THRESHOLD).select(*own.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays. Texts without words and rows with a null doc_id link with nothing
    and stay; rows repeated with one doc_id stay or go together."""
    found = group_matrix.similarity_components(docs.select("doc_id", "text"))
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, edited or not, go. Null and empty texts hold none; without test items all stay."""
    own = shielded(docs)
    checked = decontaminate.decontaminate(own, shared.load(spark, sf_dir, "benchmark"), keep=tuple(own.columns))
    return checked.where(~F.col("__contaminated")).select(*own.columns).toDF(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their target weights: a seeded choice of whole documents. Null sources and languages are leaves of their own; texts without words
    take no budget."""
    own = shielded(docs)
    return mixing.mix(own, MIX_SHARE, max_epochs=1).select(*own.columns).toDF(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document that is left. Null and repeated doc_ids share a shard and have slots of their own."""
    return hash_tree.shard_documents(docs.select("doc_id", "text"), SHARDS)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixture", mixture),
    ("sharding", sharding),
]

#: The quality model is no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.load(spark, sf_dir, "documents")
    root = shared.fresh_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = shared.written(stage(spark, docs, sf_dir), f"{root}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
