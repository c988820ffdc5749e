"""Registry lookups: exact, by precedence, tiered; and how matches resolve.

A lookup table is the registry unpivoted to (id_type, value, row). It is a dimension; joins are plain equi-joins, and Spark
broadcasts it where its measured size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions import text as T

STATUS_RANK = {"ambiguous": 0, "resolved": 1, "duplicate_identical": 2, "missing": 3, "snapshot_absent": 4}
PRECEDENCE = ("figi", "cusip", "isin", "sedol", "other_typed_identifier")


def lookup_table(registry: DataFrame) -> DataFrame:
    """id_type, id_value, figi, row_id of every identifier that a registry row answers to."""
    own = F.array(*(F.struct(F.lit(t).alias("id_type"), F.coalesce(T.identifier(F.col(c)), F.lit("")).alias("id_value")) for t, c in (("figi", "figi"), ("figi", "composite_figi"), ("figi", "share_class_figi"), ("cusip", "cusip"), ("isin", "isin"), ("sedol", "sedol"))))
    others = F.transform(F.coalesce("other_identifiers", F.array()), lambda o: F.struct(F.concat(F.lit("other:"), T.key_token(o["id_type"])).alias("id_type"), T.key_token(o["value"]).alias("id_value")))
    each = registry.select("figi", "row_id", F.explode(F.array_distinct(F.concat(own, others))).alias("k"))
    return each.select("k.id_type", "k.id_value", "figi", "row_id").where("id_value <> ''")


def resolution(rows: Column, entries: Column, figis: Column) -> Column:
    """rows: matches; entries: different ones; figis: different figis among them."""
    return F.when(rows == 0, "missing").when(figis > 1, "ambiguous").when(rows > entries, "duplicate_identical").otherwise("resolved")


def resolved_table(table: DataFrame, on: list[str], figi: str = "figi", row_id: str = "row_id") -> DataFrame:
    """on, status, n_candidates, candidates (sorted distinct figi and row_id): what each key of the table resolves to. One row per key. A
    plan that doesn't use the list doesn't gather it."""
    each = table.groupBy(*on, figi, row_id).agg(F.count("*").alias("__n"))  # duplicates counted, so that no distinct count is needed
    one = each.groupBy(*on).agg(F.sum("__n").alias("__n"), F.count("*").alias("__r"), F.min(figi).alias("__a"), F.max(figi).alias("__b"), F.array_sort(F.collect_list(F.struct(figi, row_id))).alias("candidates"))
    figis = F.when(F.col("__a").eqNullSafe(F.col("__b")), 1).otherwise(2)
    return one.select(*on, resolution(F.col("__n"), F.col("__r"), figis).alias("status"), F.col("__r").alias("n_candidates"), "candidates")


def resolve(keys: DataFrame, table: DataFrame, key: list[str], on: list[str], figi: str = "figi", row_id: str = "row_id") -> DataFrame:
    """key, status, candidates of the left rows, by the resolved table: each key of the registry is resolved once, however many rows ask for it."""
    none = F.array().cast(f"array<struct<{figi}:{table.schema[figi].dataType.simpleString()},{row_id}:{table.schema[row_id].dataType.simpleString()}>>")
    found = keys.join(resolved_table(table, on, figi, row_id), on, "left")
    return found.select(*key, F.coalesce("status", F.lit("missing")).alias("status"), F.coalesce("candidates", none).alias("candidates"))


def by_precedence(keys: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """keys: key, pos, id_type, id_value. The first position that isn't missing wins. A left row whose keys are all missing stays
    missing; with a blank type among them it is unsupported_id_type."""
    each = resolve(keys, table, [*key, "pos", "id_type", "id_value"], ["id_type", "id_value"])
    none = F.coalesce("id_type", F.lit("")) == ""
    each = each.withColumn("status", F.when(none, "unsupported_id_type").otherwise(F.col("status")))
    rank = F.struct(F.when(none, 1).when(F.col("status") == "missing", 2).otherwise(0).alias("m"), F.col("pos"))
    best = F.min_by(F.struct("status", "id_type", "id_value", "candidates"), rank)
    return each.groupBy(*key).agg(best.alias("b")).select(*key, "b.*")


def by_columns(rows: DataFrame, table: DataFrame, kinds: list[tuple[str, str]], figi: str = "figi", row_id: str = "row_id") -> DataFrame:
    """``by_precedence`` for keys that are columns: kinds are (id_type, column) in the order of precedence. The rows with status, id_type, id_value
    and candidates: those of the first kind that isn't missing, else of the first. A row stays one row, and meets each kind's resolved keys in a
    join of its own; nothing is unfolded and put together again. A repeated row stays repeated."""
    none = F.array().cast(f"array<struct<{figi}:{table.schema[figi].dataType.simpleString()},{row_id}:{table.schema[row_id].dataType.simpleString()}>>")
    out, best = rows, None
    for k, (kind, column) in enumerate(kinds):
        own = resolved_table(table.where(F.col("id_type") == kind), ["id_value"], figi, row_id)
        found = F.struct("status", F.lit(kind).alias("id_type"), F.col("id_value"), "candidates")
        out = out.join(own.select(F.col("id_value").alias(f"__v{k}"), found.alias(f"__f{k}")), F.col(column) == F.col(f"__v{k}"), "left")
        out = out.withColumn("__best", F.col(f"__f{k}") if best is None else F.coalesce("__best", f"__f{k}")).drop(f"__v{k}", f"__f{k}")
        best = "__best"
    first = F.struct(F.lit("missing").alias("status"), F.lit(kinds[0][0]).alias("id_type"), F.col(kinds[0][1]).cast(table.schema["id_value"].dataType).alias("id_value"), none.alias("candidates"))
    return out.withColumn("__best", F.coalesce("__best", first)).select(*rows.columns, "__best.*")


def invalid_snapshot(keys: DataFrame, key: list[str], error: str) -> DataFrame:
    """What every left row gets from a registry that can't be read: key, status, candidates, diagnostic."""
    none = F.array().cast("array<struct<figi:string,row_id:string>>")
    return keys.select(*key).distinct().select(*key, F.lit("snapshot_invalid").alias("status"), none.alias("candidates"), F.lit(error).alias("diagnostic"))


def tiered(tiers: list[DataFrame], key: list[str]) -> DataFrame:
    """Each tier has key, figi, row_id of its matches; a left row takes those of its lowest tier. key, tier, status, candidates."""
    rows = None
    for k, t in enumerate(tiers, start=1):
        part = t.select(*key, "figi", "row_id", F.lit(k).alias("tier"))
        rows = part if rows is None else rows.unionByName(part)
    each = resolved_table(rows, [*key, "tier"])
    return each.groupBy(*key).agg(F.min_by(F.struct("tier", "status", "candidates"), "tier").alias("b")).select(*key, "b.*")


def tiered_keys(rows: DataFrame, table: DataFrame, key: list[str], tiers: list[tuple[list[str], list[str]]]) -> DataFrame:
    """Lookup by columns, tier by tier: (left columns, table columns). The table is resolved once per tier and key, and a tier sees only
    the rows that no lower one matched. key, tier, status, n_candidates, candidates of the rows with a match."""
    left, out = rows, None
    for k, (own, theirs) in enumerate(tiers, start=1):
        names = [f"__k{i}" for i in range(len(own))]
        filled = table.select(*(F.col(c).alias(n) for c, n in zip(theirs, names)), "figi", "row_id").dropna(subset=names)
        found = left.select(*key, *(F.col(c).alias(n) for c, n in zip(own, names))).join(resolved_table(filled, names), names).select(*key, F.lit(k).alias("tier"), "status", "n_candidates", "candidates")
        out = found if out is None else out.union(found)
        left = left.join(found.select(*key), key, "left_anti")
    return out


def instrument_lookup(instruments: DataFrame, registry: DataFrame, key: list[str]) -> DataFrame:
    """Tier 1: cusip or isin; tier 2: the canonical signature; tier 3: the title with ticker and exchange equal or blank in the registry; a
    registry row without a normalised title answers to its upper-cased security title. A row that matches by both ids counts once,
    equal rows each count."""
    title = F.nullif(F.coalesce("normalized_title", F.lit("")), F.lit(""))
    if "security_title" in registry.columns:
        title = F.coalesce(title, T.key_token(F.col("security_title")))
    r = registry.select("figi", "row_id", *(F.col(c).alias(f"r_{c}") for c in ("cusip", "isin", "canonical_signature", "ticker", "exchange")), title.alias("r_title"))
    equal = lambda c: (F.col(c) == F.col(f"r_{c}")) & (F.coalesce(F.col(c), F.lit("")) != "")
    by_cusip = instruments.join(r, equal("cusip"))
    by_isin = instruments.join(r, equal("isin")).where(~F.coalesce(equal("cusip"), F.lit(False)))
    one = by_cusip.select(*key, "figi", "row_id").union(by_isin.select(*key, "figi", "row_id"))
    two = instruments.join(r, equal("canonical_signature")).select(*key, "figi", "row_id")
    blank = lambda a, b: (F.col(a) == F.col(b)) | (F.coalesce(F.col(b), F.lit("")) == "")
    three = instruments.join(r, F.col("normalized_title") == F.col("r_title")).where(blank("ticker", "r_ticker") & blank("exchange", "r_exchange")).select(*key, "figi", "row_id")
    found = tiered([one, two, three], key)
    return instruments.select(*key).join(found, key, "left").select(*key, "tier", F.coalesce("status", F.lit("missing")).alias("status"), "candidates")


def dominant_status(status: Column) -> Column:
    """An aggregate: the status of the highest rank."""
    rank = T.mapped(status, {k: str(v) for k, v in STATUS_RANK.items()}, F.lit("9"))
    return F.coalesce(F.min_by(status, rank), F.lit(""))
