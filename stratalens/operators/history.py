"""Comparators and history: prior filings, the same quarter of an earlier year, the last N."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions import text as T

#: Forms, their base forms, and base forms that need a comparator.
BASE_FORMS = {"10-Q": "10-Q", "10-Q/A": "10-Q", "10-K": "10-K", "10-K/A": "10-K", "20-F": "20-F", "20-F/A": "20-F", "6-K": "6-K", "6-K/A": "6-K", "8-K": "8-K", "8-K/A": "8-K"}
REQUIRED = ("10-Q", "10-K", "20-F")
LOOKBACK_MONTHS, WINDOW = 36, 5


def base_form(form: Column) -> Column:
    return T.mapped(F.upper(F.trim(form)), BASE_FORMS, F.lit(None).cast("string"))


def comparator_required(form: Column) -> Column:
    return F.coalesce(base_form(form).isin(*REQUIRED), F.lit(False))


def prior(rows: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The row before, as prior_*, in a total order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumns({f"prior_{c}": F.lag(c).over(w) for c in columns})


def compatible(filings: DataFrame) -> DataFrame:
    """Pairs of a filing and an earlier one of its issuer and base form, at most LOOKBACK_MONTHS back (clamped at month ends)."""
    a = filings.withColumns({"base": base_form(F.col("form")), "filed": F.expr("try_to_date(filed_date)")})
    b = a.select("cik", "base", *(F.col(c).alias(f"p_{c}") for c in ("accession", "form", "filed", "period_end")))
    return a.join(b, ["cik", "base"]).where("p_filed < filed and p_filed >= add_months(filed, -%d)" % LOOKBACK_MONTHS)


def comparator(filings: DataFrame) -> DataFrame:
    """accession, comparator, rule for forms that need one: for 10-Q the newest filing of the same quarter in an earlier year, else the newest
    of an earlier period, else the newest. Event-driven forms have none."""
    pairs = compatible(filings).where(comparator_required(F.col("form"))).withColumns({"end": F.expr("try_to_date(period_end)"), "p_end": F.expr("try_to_date(p_period_end)")})
    same = (F.col("base") == "10-Q") & (F.quarter("end") == F.quarter("p_end")) & (F.year("p_end") < F.year("end"))
    rank = F.when(same, 0).when(F.col("p_end") < F.col("end"), 1).otherwise(2)
    best = F.min_by(F.struct(F.col("p_accession").alias("comparator"), F.element_at(F.array(F.lit("same_quarter"), F.lit("previous_period"), F.lit("newest")), rank + 1).alias("rule")), F.struct(rank.alias("r"), F.datediff(F.lit("9999-12-31").cast("date"), "p_filed").alias("age"), F.col("p_accession")))
    return pairs.groupBy("accession").agg(best.alias("b")).select("accession", "b.*")


def window(rows: DataFrame, key: list[str], newest_first: list, n: int = WINDOW) -> DataFrame:
    """The newest ``n`` rows of each key."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*key).orderBy(*newest_first))).where(F.col("pos") <= n)


def select_history(entries: DataFrame, current: DataFrame, explicit: DataFrame | None = None, n: int = WINDOW) -> DataFrame:
    """cik, accession (current), history (ascending): the last ``n`` entries below the current accession, and the comparator: the
    explicit one, else the nearest prior where the form needs one."""
    rows = current.select("cik", F.col("accession").alias("current"), "form").join(entries.select("cik", "accession"), "cik").where("accession < current").where(T.valid_accession(F.col("accession")))
    last = window(rows, ["cik", "current"], [F.desc("accession")], n)
    lists = last.groupBy("cik", "current", "form").agg(F.array_sort(F.collect_list("accession")).alias("history"), F.max("accession").alias("nearest"))
    if explicit is not None:
        lists = lists.join(explicit.select("cik", F.col("accession").alias("current"), "comparator"), ["cik", "current"], "left")
    else:
        lists = lists.withColumn("comparator", F.lit(None).cast("string"))
    chosen = F.coalesce("comparator", F.when(comparator_required(F.col("form")), F.col("nearest")))
    lists = lists.withColumn("comparator", chosen)
    full = F.array_sort(F.array_distinct(F.concat("history", F.array_compact(F.array("comparator")))))
    return lists.select("cik", F.col("current").alias("accession"), "comparator", full.alias("history"))


def current_and_history(sources: DataFrame, key: list[str]) -> DataFrame:
    """is_current marks the newest source of each key; the rest is history."""
    order = [F.desc(c) for c in ("filed_date", "report_period", "accession", "source_record_id", "artifact_sha256")]
    return sources.withColumn("is_current", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) == 1)


def metadata_conflicts(found: DataFrame, given: DataFrame) -> DataFrame:
    """Fields (cik, form, filed_date) whose given and extracted values differ."""
    pair = found.alias("f").join(given.alias("g"), "accession")
    rows = [F.struct(F.lit(c).alias("field"), F.col(f"f.{c}").alias("found"), F.col(f"g.{c}").alias("given")) for c in ("cik", "form", "filed_date")]
    return pair.select("accession", F.explode(F.array(*rows)).alias("d")).select("accession", "d.*").where("given <> '' and found <> given")
