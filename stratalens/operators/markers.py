"""Cross-filing markers M001-M005 over snapshots of sets, one prior snapshot each."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalens.functions.numbers import ratio
from stratalens.functions.text import valid_accession


@dataclass(frozen=True)
class SchemaRefresh:
    min_change_count: int = 1
    min_change_ratio: float = 0.2
    min_previous_count: int = 1


@dataclass(frozen=True)
class ExtensionRefactor:
    min_churn_ratio: float = 0.25
    min_new_count: int = 5
    min_retired_count: int = 5
    min_previous_count: int = 10


@dataclass(frozen=True)
class AnchoringRetrofit:
    min_coverage_increase: float = 0.2
    min_anchored_increase_count: int = 10
    min_previous_extension_count: int = 25


@dataclass(frozen=True)
class ContextRewrite:
    min_context_count_change_ratio: float = 0.4
    min_context_count_change: int = 25
    min_previous_context_count: int = 50
    min_dim_member_churn_ratio: float = 0.4
    min_dim_member_churn_count: int = 10
    min_previous_dim_member_count: int = 25


@dataclass(frozen=True)
class DuplicateCleanup:
    min_drop_ratio: float = 0.5
    min_drop_count: int = 10
    min_previous_count: int = 20


THRESHOLDS = {"M001": SchemaRefresh(), "M002": ExtensionRefactor(), "M003": AnchoringRetrofit(), "M004": ContextRewrite(), "M005": DuplicateCleanup()}
EXAMPLES = 10


def thresholds_table(spark: SparkSession) -> DataFrame:
    rows = [(m, k, float(v)) for m, t in THRESHOLDS.items() for k, v in sorted(asdict(t).items())]
    return spark.createDataFrame(rows, "marker string, threshold string, value double")


def normal_set(values: Column) -> Column:
    """Sorted, distinct, without blanks."""
    trimmed = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v))
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda v: v.isNotNull() & (v != ""))))


def with_prior(snapshots: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """The latest earlier snapshot's columns as prior_*; null without one."""
    w = Window.partitionBy(*key).orderBy(order)
    return snapshots.withColumns({f"prior_{c}": F.lag(c).over(w) for c in columns})


def added(now: Column, prior: Column) -> Column:
    return F.array_sort(F.array_except(now, prior))


def _ready(snapshots: DataFrame, columns: list[str]) -> DataFrame:
    good = snapshots.where(valid_accession(F.col("accession"))).withColumns({c: normal_set(F.col(c)) for c in columns})
    return good


def schema_refresh(snapshots: DataFrame, t: SchemaRefresh = SchemaRefresh()) -> DataFrame:
    rows = with_prior(_ready(snapshots, ["schema_refs"]), ["cik"], "accession", ["accession", "schema_refs"]).where("prior_accession is not null")
    new, gone = added(F.col("schema_refs"), F.col("prior_schema_refs")), added(F.col("prior_schema_refs"), F.col("schema_refs"))
    rows = rows.select("cik", "accession", "prior_accession", new.alias("added"), gone.alias("removed"), F.size("prior_schema_refs").alias("n_prior"))
    rows = rows.withColumn("n_changed", F.size("added") + F.size("removed")).withColumn("change_ratio", ratio(F.col("n_changed"), F.col("n_prior")))
    return rows.where((F.col("n_prior") >= t.min_previous_count) & (F.col("n_changed") >= t.min_change_count) & (F.col("change_ratio") >= t.min_change_ratio)).withColumn("marker", F.lit("M001"))


def extension_refactor(snapshots: DataFrame, t: ExtensionRefactor = ExtensionRefactor()) -> DataFrame:
    rows = with_prior(_ready(snapshots, ["extension_qnames"]), ["cik"], "accession", ["accession", "extension_qnames"]).where("prior_accession is not null")
    rows = rows.select("cik", "accession", "prior_accession", added(F.col("extension_qnames"), F.col("prior_extension_qnames")).alias("new"), added(F.col("prior_extension_qnames"), F.col("extension_qnames")).alias("retired"), F.size("prior_extension_qnames").alias("n_prior"))
    rows = rows.withColumn("churn_ratio", ratio(F.size("new") + F.size("retired"), F.col("n_prior")))
    fires = (F.col("n_prior") >= t.min_previous_count) & (F.size("new") >= t.min_new_count) & (F.size("retired") >= t.min_retired_count) & (F.col("churn_ratio") >= t.min_churn_ratio)
    return rows.where(fires).select("cik", "accession", "prior_accession", F.size("new").alias("n_new"), F.size("retired").alias("n_retired"), "n_prior", "churn_ratio", F.slice("new", 1, EXAMPLES).alias("new_examples"), F.slice("retired", 1, EXAMPLES).alias("retired_examples"), F.lit("M002").alias("marker"))


def anchoring_retrofit(snapshots: DataFrame, t: AnchoringRetrofit = AnchoringRetrofit()) -> DataFrame:
    rows = _ready(snapshots, ["extension_qnames", "anchored_qnames"])
    rows = rows.withColumn("own", F.array_intersect("anchored_qnames", "extension_qnames")).withColumns({"n_anchored": F.size("own"), "n_extensions": F.size("extension_qnames")})
    rows = rows.withColumn("coverage", F.coalesce(F.try_divide(F.col("n_anchored").cast("double"), F.col("n_extensions")), F.lit(0.0)))
    rows = with_prior(rows, ["cik"], "accession", ["accession", "own", "n_anchored", "n_extensions", "coverage"]).where("prior_accession is not null")
    rise = F.bround(F.col("coverage") - F.col("prior_coverage"), 6)
    fires = (F.col("prior_n_extensions") >= t.min_previous_extension_count) & (F.col("n_anchored") - F.col("prior_n_anchored") >= t.min_anchored_increase_count) & (rise >= t.min_coverage_increase)
    return rows.where(fires).select("cik", "accession", "prior_accession", "n_anchored", "prior_n_anchored", F.bround("coverage", 6).alias("coverage"), F.bround("prior_coverage", 6).alias("prior_coverage"), rise.alias("coverage_increase"), F.slice(added(F.col("own"), F.col("prior_own")), 1, EXAMPLES).alias("examples"), F.lit("M003").alias("marker"))


def context_rewrite(snapshots: DataFrame, t: ContextRewrite = ContextRewrite()) -> DataFrame:
    rows = _ready(snapshots, ["dimension_signatures"]).withColumn("context_count", F.greatest(F.coalesce("context_count", F.lit(0)), F.lit(0)))
    rows = with_prior(rows, ["cik"], "accession", ["accession", "context_count", "dimension_signatures"]).where("prior_accession is not null")
    change = F.abs(F.col("context_count") - F.col("prior_context_count"))
    churn = F.size(F.array_except("dimension_signatures", "prior_dimension_signatures")) + F.size(F.array_except("prior_dimension_signatures", "dimension_signatures"))
    rows = rows.withColumns({"context_change": change, "context_ratio": ratio(change, F.col("prior_context_count")), "dimension_churn": churn, "dimension_ratio": ratio(churn, F.size("prior_dimension_signatures"))})
    by_count = (F.col("prior_context_count") >= t.min_previous_context_count) & (F.col("context_change") >= t.min_context_count_change) & (F.col("context_ratio") >= t.min_context_count_change_ratio)
    by_set = (F.size("prior_dimension_signatures") >= t.min_previous_dim_member_count) & (F.col("dimension_churn") >= t.min_dim_member_churn_count) & (F.col("dimension_ratio") >= t.min_dim_member_churn_ratio)
    return rows.where(by_count | by_set).select("cik", "accession", "prior_accession", "context_change", "context_ratio", "dimension_churn", "dimension_ratio", F.slice(added(F.col("dimension_signatures"), F.col("prior_dimension_signatures")), 1, EXAMPLES).alias("examples"), F.lit("M004").alias("marker"))


def duplicate_cleanup(snapshots: DataFrame, t: DuplicateCleanup = DuplicateCleanup()) -> DataFrame:
    rows = with_prior(_ready(snapshots, ["duplicate_signature_ids"]), ["cik"], "accession", ["accession", "duplicate_signature_ids"]).where("prior_accession is not null")
    before, now = F.size("prior_duplicate_signature_ids"), F.size("duplicate_signature_ids")
    drop = before - now
    fires = (before >= t.min_previous_count) & (drop >= t.min_drop_count) & (ratio(drop, before) >= t.min_drop_ratio)
    return rows.where(fires).select("cik", "accession", "prior_accession", before.alias("n_prior"), now.alias("n_now"), ratio(drop, before).alias("drop_ratio"), F.slice(added(F.col("prior_duplicate_signature_ids"), F.col("duplicate_signature_ids")), 1, EXAMPLES).alias("examples"), F.lit("M005").alias("marker"))


MARKERS = {"M001": schema_refresh, "M002": extension_refactor, "M003": anchoring_retrofit, "M004": context_rewrite, "M005": duplicate_cleanup}
