"""The flagship plan: observations to ranked drift candidates, with registry seeds and inputs for evidence packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens import storage
from stratalens.functions import signatures as S
from stratalens.operators import ledger

#: Weights of issue codes, of a report period, and the cap of the value's part.
WEIGHTS = {"registry_bridge_available": 1000, "registry_bridge_ambiguous": 900, "strong_identifier_removed": 800, "weak_key_temporal_collision": 700, "weak_continuity_only": 400}
PERIOD_WEIGHT, VALUE_CAP, VALUE_MAX, VALUE_UNIT = 10, 99, 999_999_999, 1_000_000


def score(codes: Column, periods: Column, value: Column) -> Column:
    """The sum of the codes' weights, ten for each period, and the value's part."""
    total = F.lit(0).cast("bigint")
    for code, weight in WEIGHTS.items():
        total = total + F.when(F.array_contains(codes, code), F.lit(weight)).otherwise(0)
    return total + periods * PERIOD_WEIGHT + value


def value_score(texts: Column) -> Column:
    """From the values of an event's references: digits, capped, in millions, capped."""
    digits = F.transform(texts, lambda v: F.regexp_replace(F.coalesce(v, F.lit("")), "[^0-9]", ""))
    # numbers of more than nine digits exceed the cap anyway
    some = F.transform(F.filter(digits, lambda d: d != ""), lambda d: F.when(F.length(F.ltrim(d, F.lit("0"))) > 9, F.lit(VALUE_MAX).cast("bigint")).otherwise(F.coalesce(d.try_cast("bigint"), F.lit(0).cast("bigint"))))
    return F.least(F.coalesce(F.floor(F.array_max(some) / VALUE_UNIT), F.lit(0)), F.lit(VALUE_CAP)).cast("bigint")


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """rank 1..n in a total order, without gathering all rows in one task: a range exchange sorts them, then positions inside
    a range are added to the counts of the ranges before, of which there is one row per range."""
    spark = rows.sparkSession
    placed = rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    placed = storage.written(placed, f"{storage.fresh_dir(spark, 'ranked')}/rows")
    counts = placed.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    inside = placed.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    return inside.join(before, "__p").withColumn("rank", F.col("__b") + F.col("__r")).drop("__p", "__r", "__b")


def unique(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(values, lambda v: F.coalesce(v, F.lit("")) != "")))


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), S.json_ascii(text), F.lit('"'))


def seeds_of(refs: DataFrame) -> DataFrame:
    """kind, group, id_type, value, observation_id of the reported identifiers of an event's references."""
    keys = refs.select("kind", "group", "observation_id", F.explode("strong_keys").alias("k")).where("k.source = 'reported'")
    parted = (F.col("k.key_type") == "other_typed_identifier") & F.col("k.value").contains(":")
    kind = F.when(parted, F.substring_index("k.value", ":", 1)).otherwise(F.col("k.key_type"))
    value = F.when(parted, F.expr("substring(k.value, instr(k.value, ':') + 1)")).otherwise(F.col("k.value"))
    return keys.select("kind", "group", kind.alias("id_type"), value.alias("value"), "observation_id").distinct()


def candidate_ids(rows: DataFrame, refs: DataFrame, seeds: DataFrame) -> DataFrame:
    """kind, group, candidate_id: the hash of a candidate's JSON with sorted names, streamed over its references and seeds."""
    names = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, quoted), ","), F.lit("]"))
    start = F.concat(F.lit('v1|P009:scan-candidate|{"continuity_class":'), quoted(F.col("continuity_class")), F.lit(',"event_ids":['), quoted(F.col("event_id")), F.lit('],"issue_codes":'), names(F.col("issue_codes")), F.lit(',"observation_ids":['))
    end = F.concat(F.lit('],"source_scope_key":'), quoted(F.col("source_scope_key")), F.lit("}"))
    each = lambda c: refs.where(F.coalesce(F.col(c), F.lit("")) != "").select("kind", "group", F.col(c).alias("v")).distinct()
    seed = seeds.select("kind", "group", "id_type", "value").distinct()
    at = lambda k: {"o1": F.col("id_type"), "o2": F.col("value"), "o5": F.lit(k)}
    p, item = ledger.pieces, {"o1": F.col("v")}
    parts = [
        p(rows, 0, ledger.LITERAL, start), p(each("observation_id"), 1, ledger.ITEM, quoted(F.col("v")), item), p(rows, 2, ledger.LITERAL, F.lit('],"seed_identifiers":[')),
        p(seed, 3, ledger.HEAD, F.concat(F.lit('{"id_type":'), quoted(F.col("id_type")), F.lit(',"observation_ids":[')), at(0)),
        p(seeds, 3, ledger.INNER, quoted(F.col("observation_id")), at(1) | {"o6": F.col("observation_id")}),
        p(seed, 3, ledger.TAIL, F.concat(F.lit('],"value":'), quoted(F.col("value")), F.lit("}")), at(2)),
        p(rows, 4, ledger.LITERAL, F.lit('],"source_ids":[')), p(each("source_id"), 5, ledger.ITEM, quoted(F.col("v")), item), p(rows, 6, ledger.LITERAL, end),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return ledger.streamed_sha(out).withColumnRenamed("sha", "candidate_id")


def candidates(d: ledger.Drift) -> DataFrame:
    """Events that are findings, as candidates with score and id, without lists and ranks; kind and group name an event's references in ``d.refs``."""
    rows = d.events.where("array_join(issue_codes, ',') <> 'registry_bridge_available'").withColumnRenamed("scope_key", "source_scope_key")
    rows = storage.written(rows, storage.fresh_dir(rows.sparkSession, "candidates"))
    refs = d.refs.join(rows.select("kind", "group"), ["kind", "group"], "left_semi")
    value = F.try_element_at(F.transform(F.filter(F.coalesce("weak", F.array().cast("array<struct<key:string,value:string>>")), lambda p: p["key"] == "value"), lambda p: p["value"]), F.lit(1))
    # periods are counted after one row a period; the largest value merges
    each = refs.select("kind", "group", "report_period", "filed_date", value_score(F.array(value)).alias("v")).groupBy("kind", "group", "report_period").agg(F.max("filed_date").alias("f"), F.max("v").alias("v"))
    some = F.coalesce(F.col("report_period"), F.lit("")) != ""
    counted = each.groupBy("kind", "group").agg(F.sum(some.cast("bigint")).alias("n_periods"), F.max("f").alias("newest_filed"), F.max("v").alias("affected_value"))
    seeds = seeds_of(refs)
    out = rows.join(counted, ["kind", "group"]).join(candidate_ids(rows, refs, seeds), ["kind", "group"])
    out = out.withColumn("score", score(F.col("issue_codes"), F.col("n_periods"), F.col("affected_value")))
    return out.withColumn("newest_date", F.coalesce(F.nullif("newest_filed", F.lit("")), F.col("newest"), F.lit("")))


def ranked_candidates(d: ledger.Drift, limit: int | None = None) -> DataFrame:
    """Candidates with ranks, best first; a negative limit counts as 0."""
    digits = F.replace(F.col("newest_date"), F.lit("-"), F.lit(""))
    late = F.when(digits.rlike("^[0-9]{8}$"), digits).otherwise("00000000")
    out = ranked(candidates(d).withColumn("__late", late), [F.desc("score"), F.desc("n_periods"), F.desc("__late"), F.array_join("issue_codes", ","), F.col("candidate_id"), F.col("kind"), F.col("group")]).drop("__late")
    return out if limit is None else out.where(F.col("rank") <= max(0, limit))


def run(observations: DataFrame, registry_rows: DataFrame | None = None, limit: int | None = None, caps: ledger.Caps = ledger.Caps()) -> tuple[DataFrame, DataFrame]:
    """Ranked candidates with the lists that their documents show, and the diagnostics of what the caps leave out."""
    d = ledger.drift_tables(observations, registry_rows, caps)
    chosen = storage.written(ranked_candidates(d, limit), storage.fresh_dir(observations.sparkSession, "ranked"))
    refs = d.refs.join(chosen.select("kind", "group"), ["kind", "group"], "left_semi")
    lists = {"observation_ids": "observation_id", "source_ids": "source_id", "accessions": "accession", "report_periods": "report_period", "filed_dates": "filed_date"}
    shown = refs.groupBy("kind", "group").agg(*(unique(F.collect_set(c)).alias(n) for n, c in lists.items()))
    seeds = seeds_of(refs).select("kind", "group", "id_type", "value").distinct().groupBy("kind", "group").agg(F.array_sort(F.collect_list(F.struct("id_type", "value"))).alias("seeds"))
    out = chosen.join(shown, ["kind", "group"]).join(seeds, ["kind", "group"], "left").withColumn("seeds", F.coalesce("seeds", F.array().cast("array<struct<id_type:string,value:string>>")))
    return out.drop("kind", "group", "n_keys", "n_candidates"), d.diagnostics


def scan(observations: DataFrame, registry_rows: DataFrame | None = None, limit: int | None = None, caps: ledger.Caps = ledger.Caps()) -> DataFrame:
    """The candidates of ``run``."""
    return run(observations, registry_rows, limit, caps)[0]


def seed_rows(ranked_candidates: DataFrame) -> DataFrame:
    """rank, candidate_id, id_type, value of the identifiers to look up."""
    return ranked_candidates.select("rank", "candidate_id", F.explode("seeds").alias("s")).select("rank", "candidate_id", "s.id_type", "s.value").orderBy("rank", "id_type", "value", "candidate_id")


def pack_inputs(ranked_candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Each candidate's manifest rows, of its own scope; candidates without any stay with an empty list."""
    own = ranked_candidates.select("rank", "candidate_id", F.col("source_scope_key").alias("scope_key"), F.explode("source_ids").alias("source_id"))
    hits = own.join(sources, ["scope_key", "source_id"]).groupBy("rank", "candidate_id").agg(F.array_sort(F.collect_list(F.struct("filed_date", "source_id", "local_path"))).alias("sources"))
    return ranked_candidates.select("rank", "candidate_id", "source_scope_key", "source_ids").join(hits, ["rank", "candidate_id"], "left")
