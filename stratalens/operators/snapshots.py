"""Snapshots of sets as a change log, and the markers M001-M005 over all boundaries between filings.

A filing's sets (schema references, extension concepts, anchored ones, dimension signatures, duplicate signatures) are rows (cik, accession, kind,
member). Filings with a set form its sequence per issuer; the log holds, for each member, the runs of positions at which it is there (gaps and islands: one
window per member). What is new or retired at a boundary are the runs that start or end there, so a boundary costs the size of its change and no set
is ever gathered. A filing's comparator is the latest earlier filing of the sequence; filings without a set are no comparators.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens import storage
from stratalens.functions.text import valid_accession
from stratalens.operators import markers as T

SCHEMA, EXTENSION, ANCHORED, DIMENSION, DUPLICATE = KINDS = ("schema", "extension", "anchored", "dimension", "duplicate")
SERIES = ["cik", "kind"]
#: The sets that a marker reads; the last one's changes are what it tells.
NEEDS = {"M001": (SCHEMA,), "M002": (EXTENSION,), "M003": (EXTENSION, ANCHORED), "M004": (DIMENSION,), "M005": (DUPLICATE,)}


@dataclass(frozen=True)
class Log:
    """``runs``: cik, kind, member, valid_from, valid_to (positions). ``boundaries``: one row per filing and kind with the counts at it."""

    runs: DataFrame
    boundaries: DataFrame


def members_of(snapshots: DataFrame) -> DataFrame:
    """cik, accession, kind, member from filings that hold their sets as arrays."""
    names = {"schema_refs": SCHEMA, "extension_qnames": EXTENSION, "anchored_qnames": ANCHORED, "dimension_signatures": DIMENSION, "duplicate_signature_ids": DUPLICATE}
    parts = [snapshots.select("cik", "accession", F.lit(k).alias("kind"), F.explode(c).alias("member")) for c, k in names.items() if c in snapshots.columns]
    return reduce(DataFrame.union, parts)


def runs_of(placed: DataFrame) -> DataFrame:
    """Runs of consecutive positions of each member, from (cik, kind, member, pos)."""
    w = Window.partitionBy(*SERIES, "member").orderBy("pos")
    island = placed.withColumn("__i", F.col("pos") - F.row_number().over(w))
    return island.groupBy(*SERIES, "member", "__i").agg(F.min("pos").alias("valid_from"), F.max("pos").alias("valid_to")).drop("__i")


def change_log(filings: DataFrame, members: DataFrame, kinds: tuple[str, ...] = KINDS, logged: tuple[str, ...] = KINDS) -> Log:
    """filings: cik, accession, context_count; members: cik, accession, kind, member. Blank members and malformed accessions are left out; repeated rows count
    once; anchored concepts count where they are extension concepts of the filing. The log has the sets of ``kinds``; without extension concepts
their numbers in its boundaries are 0."""
    root = storage.fresh_dir(filings.sparkSession, "snapshots")
    f = filings.where(valid_accession(F.col("accession"))).groupBy("cik", "accession").agg(F.greatest(F.coalesce(F.max("context_count"), F.lit(0)), F.lit(0)).cast("bigint").alias("contexts"))
    m = members.select("cik", "accession", "kind", F.trim("member").alias("member")).where("member <> ''").where(F.col("kind").isin(*kinds)).distinct()
    m = storage.written(m.join(f.select("cik", "accession"), ["cik", "accession"], "left_semi"), f"{root}/members")
    extension = m.where(F.col("kind") == EXTENSION).select("cik", "accession", "member")
    m = m.where(F.col("kind") != ANCHORED).unionByName(m.where(F.col("kind") == ANCHORED).join(extension, ["cik", "accession", "member"], "left_semi"))
    sizes = m.groupBy("cik", "accession", "kind").agg(F.count("*").alias("n_now"))
    grid = f.withColumn("kind", F.explode(F.array(*map(F.lit, kinds)))).join(sizes, ["cik", "accession", "kind"], "left").fillna(0, ["n_now"])
    n_extension = F.max(F.when(F.col("kind") == EXTENSION, F.col("n_now")).otherwise(0)).over(Window.partitionBy("cik", "accession"))
    grid = grid.withColumn("n_extension", n_extension)
    there = F.when(F.col("kind") == ANCHORED, F.col("n_extension") > 0).when(F.col("kind") == DIMENSION, (F.col("n_now") > 0) | (F.col("contexts") > 0)).otherwise(F.col("n_now") > 0)
    w = Window.partitionBy(*SERIES).orderBy("accession")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("there", there)
    last = lambda c: F.last(F.when(F.col("there"), F.col(c)), ignorenulls=True).over(before)
    grid = grid.withColumns({"pos": F.sum(F.col("there").cast("bigint")).over(w), **{f"prior_{c}": last(c) for c in ("accession", "n_now", "contexts", "n_extension")}})
    grid = storage.written(grid, f"{root}/grid")
    grid = grid.where(F.col("kind").isin(*logged))
    placed = m.where(F.col("kind").isin(*logged)).join(grid.where("there").select("cik", "accession", "kind", "pos"), ["cik", "accession", "kind"])
    runs = storage.written(runs_of(placed.select("cik", "kind", "member", "pos")), f"{root}/runs")
    starts = runs.groupBy(*SERIES, F.col("valid_from").alias("pos")).agg(F.count("*").alias("n_starts"))
    ends = runs.groupBy(*SERIES, F.col("valid_to").alias("prior_pos")).agg(F.count("*").alias("n_ends"))
    grid = grid.where("prior_accession is not null").withColumn("prior_pos", F.col("pos") - F.col("there").cast("bigint"))
    out = grid.join(starts, [*SERIES, "pos"], "left").join(ends, [*SERIES, "prior_pos"], "left").fillna(0, ["n_starts", "n_ends"])
    # a filing without the set has lost all of the comparator's
    out = out.withColumns({"n_new": F.when(F.col("there"), F.col("n_starts")).otherwise(0), "n_retired": F.when(F.col("there"), F.col("n_ends")).otherwise(F.col("prior_n_now"))}).withColumnRenamed("prior_n_now", "n_prior")
    return Log(runs, storage.written(out.drop("n_starts", "n_ends"), f"{root}/boundaries"))


def compare(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """n_both, n_new, n_retired for any comparator pairs (cik, kind, prior_pos, pos), such as the same quarter a year before, from the runs that cover either end."""
    covers = lambda c: (F.col("valid_from") <= F.col(c)) & (F.col(c) <= F.col("valid_to"))
    hit = pairs.join(runs, SERIES, "inner").where(covers("pos") | covers("prior_pos"))
    # a member may come in two runs, one at each end
    each = hit.groupBy(*SERIES, "prior_pos", "pos", "member").agg(F.bool_or(covers("pos")).alias("now"), F.bool_or(covers("prior_pos")).alias("then"))
    count = lambda c: F.sum(c.cast("bigint"))
    return each.groupBy(*SERIES, "prior_pos", "pos").agg(count(F.col("now") & F.col("then")).alias("n_both"), count(F.col("now") & ~F.col("then")).alias("n_new"), count(F.col("then") & ~F.col("now")).alias("n_retired"))


def examples(log: Log, fired: DataFrame, which: str, limit: int) -> DataFrame:
    """cik, kind, accession, list of the first members that are new or retired at the boundaries; at most ``limit`` each."""
    rows = fired.select(*SERIES, "accession", "pos", "prior_pos", "there").join(log.runs, SERIES)
    at = F.col("there") & (F.col("valid_from") == F.col("pos")) if which == "new" else (F.col("valid_from") <= F.col("prior_pos")) & F.when(F.col("there"), F.col("valid_to") == F.col("prior_pos")).otherwise(F.col("valid_to") >= F.col("prior_pos"))
    w = Window.partitionBy(*SERIES, "accession").orderBy("member")
    first = rows.where(at).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= limit)
    return first.groupBy(*SERIES, "accession").agg(F.array_sort(F.collect_list("member")).alias(f"{which}_examples"))


def validated(config: dict[str, dict[str, float]]) -> dict[str, object]:
    """Thresholds by marker: the defaults with the given values. Unknown markers and names, and values that are no numbers, are errors."""
    out = dict(T.THRESHOLDS)
    wrong = [f"{m}: unknown marker" for m in config if m not in out]
    for m, values in config.items():
        known = asdict(out[m]) if m in out else {}
        wrong += [f"{m}.{k}: unknown threshold" for k in values if m in out and k not in known]
        wrong += [f"{m}.{k}: not a number of 0 or more" for k, v in values.items() if k in known and (isinstance(v, bool) or not isinstance(v, (int, float)) or v < 0)]
        if not wrong:
            out[m] = replace(out[m], **values)
    if wrong:
        raise ValueError("; ".join(wrong))
    return out


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def evidence(**values: Column) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.bround(v.cast("double"), 6))))


def detect(log: Log, config: dict[str, dict[str, float]] | None = None, limit: int = T.EXAMPLES, only: tuple[str, ...] = tuple(NEEDS)) -> DataFrame:
    """marker, cik, accession, prior_accession, n_prior, n_now, n_new, n_retired, evidence, new_examples, retired_examples of all boundaries that fire the markers of ``only``."""
    t = validated(config or {})
    b, c = log.boundaries, F.col
    churn = c("n_new") + c("n_retired")
    by_kind = lambda k: b.where(c("kind") == k)
    at = lambda m, rows, fires, found: rows.where(fires).select(F.lit(m).alias("marker"), "*", found.alias("evidence"))
    m1, m2, m3, m4, m5 = (t[m] for m in ("M001", "M002", "M003", "M004", "M005"))
    coverage, prior_coverage = share(c("n_now"), c("n_extension")), share(c("n_prior"), c("prior_n_extension"))
    rise, drop, moved = coverage - prior_coverage, c("n_prior") - c("n_now"), F.abs(c("contexts") - c("prior_contexts"))
    ratio = share(churn, c("n_prior"))
    by_count = (c("prior_contexts") >= m4.min_previous_context_count) & (moved >= m4.min_context_count_change) & (share(moved, c("prior_contexts")) >= m4.min_context_count_change_ratio)
    by_set = (c("n_prior") >= m4.min_previous_dim_member_count) & (churn >= m4.min_dim_member_churn_count) & (ratio >= m4.min_dim_member_churn_ratio)
    rows = {
        "M001": at("M001", by_kind(SCHEMA), (c("n_prior") >= m1.min_previous_count) & (churn > 0) & (churn >= m1.min_change_count) & (ratio >= m1.min_change_ratio), evidence(schema_ref_change_count=churn, schema_ref_change_ratio=ratio)),
        "M002": at("M002", by_kind(EXTENSION), (c("n_prior") >= m2.min_previous_count) & (c("n_new") >= m2.min_new_count) & (c("n_retired") >= m2.min_retired_count) & (ratio >= m2.min_churn_ratio), evidence(churn_count=churn, churn_ratio=ratio)),
        "M003": at("M003", by_kind(ANCHORED), (c("prior_n_extension") >= m3.min_previous_extension_count) & (c("n_now") - c("n_prior") >= m3.min_anchored_increase_count) & (rise >= m3.min_coverage_increase),
           evidence(anchoring_coverage=coverage, previous_anchoring_coverage=prior_coverage, coverage_increase=rise, anchored_increase=c("n_now") - c("n_prior"))),
        "M004": at("M004", by_kind(DIMENSION), by_count | by_set, evidence(context_count_change=moved, context_count_change_ratio=share(moved, c("prior_contexts")), dimension_member_churn_count=churn, dimension_member_churn_ratio=ratio)),
        "M005": at("M005", by_kind(DUPLICATE), (c("n_prior") >= m5.min_previous_count) & (drop >= m5.min_drop_count) & (share(drop, c("n_prior")) >= m5.min_drop_ratio), evidence(drop_count=drop, drop_ratio=share(drop, c("n_prior")))),
    }
    fired = storage.written(reduce(DataFrame.unionByName, (rows[m] for m in only)), storage.fresh_dir(b.sparkSession, "markers"))
    none = F.array().cast("array<string>")
    key = [*SERIES, "accession"]
    out = fired.join(examples(log, fired, "new", limit), key, "left").join(examples(log, fired, "retired", limit), key, "left")
    shown = (F.coalesce(f"{w}_examples", none).alias(f"{w}_examples") for w in ("new", "retired"))
    return out.select("marker", "cik", "accession", "prior_accession", "n_prior", "n_now", "n_new", "n_retired", "evidence", *shown)


def kinds_of(only: tuple[str, ...]) -> tuple[str, ...]:
    """The sets that the markers read, in the order of KINDS."""
    return tuple(k for k in KINDS if any(k in NEEDS[m] for m in only))


def marker_rows(filings: DataFrame, members: DataFrame, config: dict[str, dict[str, float]] | None = None, only: tuple[str, ...] = tuple(NEEDS)) -> DataFrame:
    """Filings and their sets to markers; the log is built of the sets whose changes these markers tell."""
    return detect(change_log(filings, members, kinds_of(only), tuple(NEEDS[m][-1] for m in only)), config, only=only)
