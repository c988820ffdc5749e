"""Instrument observations and corpus manifests: typed rows with diagnostics from tolerant inputs.

A row is checked in a fixed order; a fatal finding ends it and drops the row, others blank or keep the value and go on. Rows that are kept have an id: the sha256 of a
canonical signature over source, place, identifiers and weak evidence. Source families choose an adapter; the row adapter reads all
families of FAMILIES, and others can be registered in ADAPTERS.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens import storage
from stratalens.functions import signatures as S
from stratalens.functions import text as T
from stratalens.sources.rows import DIAGNOSTIC, first_given, first_of, normalized_values, read_rows

#: Versions and families that the row reader takes, its defaults, and the names under which it finds weak evidence.
VERSIONS = ("", "1.0", "p009_observations.v1", "p009_observations.v1.jsonl")
FAMILIES = ("csv", "ixbrl", "jsonl", "local_export", "sec_filing", "test_fixture", "xml")
DEFAULT_FAMILY, DEFAULT_ADAPTER = "local_export", "p009_rows_v1"
WEAK_NAMES = {
    "issuer_name": ("issuer_name", "issuer", "name"),
    "title_or_description": ("title_or_description", "title", "description", "investment_description", "security_title"),
    "value": ("value", "fair_value", "market_value"),
    "pct_value": ("pct_value", "percent_value"),
    "currency": ("currency",),
    "asset_type": ("asset_type", "asset_category"),
    "issuer_type": ("issuer_type",),
    "balance": ("balance",),
    "units": ("units", "unit"),
    "maturity_date": ("maturity_date",),
    "coupon": ("coupon", "coupon_percent"),
}
#: Versions and families of corpus manifests, and the shape of a record id.
MANIFEST_VERSIONS = ("", "1.0", "p009_corpus_manifest.v1", "p009_corpus_manifest.v1.jsonl")
MANIFEST_FAMILIES = ("csv", "external", "external_observation", "ixbrl", "jsonl", "local_export", "sec_filing", "test_fixture", "xml")
RECORD_ID = r"^[A-Za-z0-9][A-Za-z0-9._:/#=+\-@]{0,255}$"
#: The corpus code of an observation's code; those with E007 go by field.
CORPUS_CODES = {"P009-OBS-E002": "P009-CORPUS-E005", "P009-OBS-E003": "P009-CORPUS-E002", "P009-OBS-E004": "P009-CORPUS-E008", "P009-OBS-E006": "P009-CORPUS-E008"}
CORPUS_FIELDS = {"filed_date": "P009-CORPUS-E003", "report_period": "P009-CORPUS-E003", "accession": "P009-CORPUS-E004", "source_record_id": "P009-CORPUS-E004"}
KINDS = ("figi", "cusip", "isin", "sedol", "ticker")
DATE, ACCESSION = r"^\d{4}-\d{2}-\d{2}$", r"^\d{10}-\d{2}-\d{6}$"
PROBLEM = "array<struct<code:string,field:string,value:string,message:string,fatal:boolean>>"

Loaded = tuple[DataFrame, DataFrame]


def integer(text: Column) -> Column:
    """A whole number, or null."""
    return T.let(F.trim(text), lambda t: F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint")))


def problem(code: str, field: str, value: Column, message: str, fatal: bool = False) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), value.alias("value"), F.lit(message).alias("message"), F.lit(fatal).alias("fatal"))


def in_order(tests: list[tuple[Column, Column, bool]]) -> Column:
    """The findings of the tests that hold, up to and with the first fatal one. A test is (condition, finding, fatal); a finding may be an array."""
    over, out = F.lit(False), []
    for condition, found, fatal in tests:
        holds = F.coalesce(condition, F.lit(False))
        out.append(F.when(holds & ~over, found).otherwise(F.array().cast(PROBLEM)))
        if fatal:
            over = over | holds
    return F.concat(*out)


def told(rows: DataFrame) -> DataFrame:
    each = rows.select("path", "row_number", F.explode("problems").alias("p"))
    return each.select("p.code", "p.message", "path", "row_number", "p.field", "p.value")


def present(row: Column, name: str) -> Column:
    return F.map_contains_key(row, F.lit(name))


def nested(row: Column, kind: Column, name: str, opening: str) -> Column:
    """The text of a nested value of JSON rows, else null."""
    value = F.try_element_at(row, F.lit(name))
    return F.when((kind != "csv") & value.startswith(opening), value)


def nested_scope(row: Column, kind: Column) -> Column:
    return normalized_values(F.from_json(nested(row, kind, "source_scope", "{"), "map<string,string>"))


def scope(data: Column, given: Column) -> Column:
    """struct(scope_key, cik, series_id, series_name): from the nested scope, then flat names, then a scope given as text. Both maps have normalised values."""
    inner = lambda n: first_given(data, n)
    plain = F.when(data.isNull(), first_given(given, "source_scope")).otherwise(F.lit(""))
    pick = lambda *values: F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))
    key = pick(inner("scope_key"), first_given(given, "scope_key"), first_given(given, "source_scope_key"), plain)
    return F.struct(key.alias("scope_key"), *(pick(inner(n), first_given(given, n)).alias(n) for n in ("cik", "series_id", "series_name")))


def source_refs(row: Column, given: Column, kind: Column, path: Column, row_number: Column) -> Column:
    """References in the order of their place, from a nested list or from flat names."""
    items = F.filter(F.transform(F.from_json(nested(row, kind, "source_refs", "["), "array<string>"), lambda x: F.from_json(x, "map<string,string>")), lambda m: m.isNotNull())
    pick = lambda v, other: F.coalesce(F.nullif(v, F.lit("")), other)
    text = lambda m, n: T.normalized(F.try_element_at(m, F.lit(n)))
    number = lambda m, n: integer(F.try_element_at(m, F.lit(n)))

    def ref(p, pointer, at, line, column, field, sha):
        key = F.struct(p.alias("path"), pointer.alias("pointer"), F.coalesce(at, F.lit(0).cast("bigint")).alias("r"), F.coalesce(line, F.lit(0).cast("bigint")).alias("l"), column.alias("column"), field.alias("field"))
        return F.struct(key.alias("key"), at.alias("row_number"), line.alias("line_number"), sha.alias("sha256"))

    listed = F.transform(items, lambda m: ref(pick(first_of(m, "path", "source_path"), path), first_of(m, "pointer", "xpath", "json_pointer"), number(m, "row_number"), number(m, "line_number"), text(m, "column"), text(m, "field"), T.identifier(F.try_element_at(m, F.lit("sha256")))))
    own = F.coalesce(F.nullif(number(row, "row_number"), F.lit(0)), row_number.cast("bigint"))
    single = F.array(ref(pick(first_given(given, "source_path", "path"), path), first_given(given, "source_pointer", "pointer", "xpath"), own, number(row, "line_number"), first_given(given, "column"), first_given(given, "field"), T.letters_and_digits(F.upper(first_given(given, "source_sha256")))))
    chosen = F.when(F.size(listed) > 0, F.array_sort(listed)).otherwise(single)
    return F.transform(chosen, lambda r: F.struct(r["key"]["path"].alias("path"), r["key"]["pointer"].alias("pointer"), r["row_number"].alias("row_number"), r["line_number"].alias("line_number"), r["key"]["column"].alias("column"), r["key"]["field"].alias("field"), r["sha256"].alias("sha256")))


def signature_path(ref: Column) -> Column:
    """path#pointer=...#row=...#line=...#column=...#field=... with what there is."""
    part = lambda name, value: F.when(value.isNotNull() & (value.cast("string") != ""), F.concat(F.lit(f"{name}="), value.cast("string")))
    return F.concat_ws("#", ref["path"], part("pointer", ref["pointer"]), part("row", ref["row_number"]), part("line", ref["line_number"]), part("column", ref["column"]), part("field", ref["field"]))


def other_identifiers(row: Column, given: Column, kind: Column) -> tuple[Column, Column, Column]:
    """(type, value) pairs in order, the number of list items that are no objects, and whether a pair lacks its type or value."""
    items = F.from_json(nested(row, kind, "other_identifiers", "["), "array<string>")
    maps = F.transform(items, lambda x: F.when(F.ltrim(x).startswith("{"), F.from_json(x, "map<string,string>")))
    pair = lambda t, v: F.struct(T.key_token(t).alias("id_type"), T.key_token(v).alias("value"))
    listed = F.transform(F.filter(maps, lambda m: m.isNotNull()), lambda m: pair(first_of(m, "id_type", "type"), F.try_element_at(m, F.lit("value"))))
    own = [first_given(given, f"other_id_{n}", f"other_identifier_{n}") for n in ("type", "value")]
    single = F.when((own[0] != "") | (own[1] != ""), F.array(pair(*own)))
    none = F.array().cast("array<struct<id_type:string,value:string>>")
    pairs = F.concat(F.coalesce(listed, none), F.coalesce(single, none))
    whole = lambda p: (p["id_type"] != "") & (p["value"] != "")
    odd = F.coalesce(F.size(F.filter(maps, lambda m: m.isNull())), F.lit(0))
    lacking = F.size(F.filter(pairs, lambda p: ~whole(p)))
    return F.array_sort(F.array_distinct(F.filter(pairs, whole))), odd, lacking


def load_observations(spark: SparkSession, path: str | list[str], metadata: dict[str, str] | None = None) -> Loaded:
    """Observations and diagnostics. ``metadata`` gives schema_version, source_family, source_adapter and source_path for rows without their own."""
    given = lambda n: F.lit((metadata or {}).get(n, ""))
    rows, unread = read_rows(spark, path)
    rows = rows.withColumns({"given": normalized_values(F.col("row")), "nested_scope": nested_scope(F.col("row"), F.col("kind"))})
    r, g, kind = F.col("row"), F.col("given"), F.col("kind")
    pick = lambda *values: F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))
    at = pick(T.normalized(given("source_path")), F.col("path"))
    others, odd, lacking = other_identifiers(r, g, kind)
    ordinal = F.coalesce(integer(F.try_element_at(r, F.lit("observation_ordinal"))), F.nullif(integer(F.try_element_at(r, F.lit("holding_ordinal"))), F.lit(0)), F.col("row_number") - 1)
    token = lambda n: F.upper(first_given(g, n))
    weak = {n: first_given(g, *names) for n, names in WEAK_NAMES.items()} | {"currency": token("currency")}
    staged = rows.select(
        "path", "row_number", F.when(present(r, "schema_version"), first_given(g, "schema_version")).otherwise(T.normalized(given("schema_version"))).alias("schema_version"),
        F.lower(T.key_token(pick(first_given(g, "source_family"), T.normalized(given("source_family")), F.lit(DEFAULT_FAMILY)))).alias("source_family"),
        F.lower(T.key_token(pick(first_given(g, "source_adapter"), T.normalized(given("source_adapter")), F.lit(DEFAULT_ADAPTER)))).alias("source_adapter"),
        scope(F.col("nested_scope"), g).alias("scope"), first_given(g, "accession").alias("given_accession"), first_given(g, "source_record_id", "record_id").alias("source_record_id"),
        first_given(g, "filed_date").alias("filed_date"), first_given(g, "report_period", "period_end", "report_date").alias("report_period"), ordinal.cast("bigint").alias("ordinal"),
        *((token(n) if n == "ticker" else T.letters_and_digits(token(n))).alias(f"given_{n}") for n in KINDS), others.alias("others"), odd.alias("odd"), lacking.alias("lacking"),
        F.filter(F.array(*(F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in weak.items())), lambda p: p["value"] != "").alias("weak"),
        source_refs(r, g, kind, at, F.col("row_number")).alias("refs"),
    )
    c = F.col
    valid = {n: T.valid_identifier(F.lit(n), c(f"given_{n}")) for n in KINDS}
    staged = staged.select("*", *(F.when(valid[n], c(f"given_{n}")).otherwise("").alias(n) for n in KINDS), F.when(c("given_accession").rlike(ACCESSION), c("given_accession")).otherwise("").alias("accession"), c("scope.*"))
    staged = staged.withColumn("source_id", pick(c("accession"), c("source_record_id")))
    one = lambda *args: F.array(problem(*args))
    many = lambda n, p: F.array_repeat(p, n)
    nothing = F.forall(F.array(*KINDS), lambda v: v == "") & (F.size("others") == 0) & (F.size("weak") == 0)
    tests = [
        (~c("schema_version").isin(*VERSIONS), one("P009-OBS-E007", "schema_version", c("schema_version"), "schema version is unknown", True), True),
        (~c("source_family").isin(*FAMILIES), one("P009-OBS-E002", "source_family", c("source_family"), "source family has no row adapter", True), True),
        (c("scope_key") == "", one("P009-OBS-E003", "scope_key", F.lit(""), "row names no source scope", True), True),
        ((c("given_accession") != "") & (c("accession") == ""), one("P009-OBS-E007", "accession", c("given_accession"), "accession has another form"), False),
        (c("source_id") == "", one("P009-OBS-E007", "accession", F.lit(""), "row has neither accession nor record id", True), True),
        *(((c(n) != "") & ~c(n).rlike(DATE), one("P009-OBS-E007", n, c(n), "date is not YYYY-MM-DD"), False) for n in ("filed_date", "report_period")),
        (c("report_period") == "", one("P009-OBS-E008", "report_period", F.lit(""), "row has no report period"), False),
        *((~valid[n], one("P009-OBS-E006", n, c(f"given_{n}"), "identifier has another form"), False) for n in KINDS),
        (c("odd") > 0, many(c("odd"), problem("P009-OBS-E007", "other_identifiers", F.lit(""), "entry is no object")), False),
        (c("lacking") > 0, many(c("lacking"), problem("P009-OBS-E006", "other_identifiers", F.lit(""), "entry lacks its type or value")), False),
        (nothing, one("P009-OBS-E004", "identity", F.lit(""), "row has neither identifier nor description", True), True),
    ]
    staged = staged.withColumn("problems", in_order(tests))
    staged = storage.written(staged, storage.fresh_dir(spark, "observations"))  # parsed once, read for rows and for diagnostics
    clean = staged.where(~F.exists("problems", lambda p: p["fatal"]))
    clean = clean.withColumn("ids", F.struct(*KINDS, "others")).withColumn("paths", F.transform("refs", signature_path))
    strong = S.fields(F.concat(F.array(*(F.struct(F.lit(n).alias("key"), c(n).alias("value")) for n in KINDS)), F.transform("others", lambda o: F.struct(F.concat(F.lit("other:"), o["id_type"]).alias("key"), o["value"].alias("value")))))
    parts = [c("source_family"), c("source_adapter"), c("source_id"), c("report_period"), c("scope_key"), c("ordinal").cast("string"), F.coalesce(F.try_element_at("paths", F.lit(1)), F.lit("")), strong, S.fields(c("weak"))]
    out = clean.withColumn("canonical_signature", F.concat_ws("|", F.lit("P009:observation"), *(S.token(p) for p in parts)))
    out = out.withColumn("observation_id", S.sha(F.concat(F.lit("v1|"), "canonical_signature")))
    names = ("observation_id", "scope_key", "source_family", "source_adapter", "source_id", "accession", "source_record_id", "report_period", "filed_date", "ordinal", "paths", "ids", "weak", "path", "row_number", "cik", "series_id", "series_name", "refs", "canonical_signature")
    return out.select(*names), unread.unionByName(told(staged))


#: Adapters by source family: (spark, path, metadata) to observations and diagnostics.
ADAPTERS: dict[str, Callable[[SparkSession, str, dict[str, str] | None], Loaded]] = dict.fromkeys(FAMILIES, load_observations)


def load_family(spark: SparkSession, family: str, path: str, metadata: dict[str, str] | None = None) -> Loaded:
    """Read an input with its family's adapter; a family without one gives a diagnostic and no observations. A blank family counts as the default."""
    name = " ".join(family.split()).lower() or DEFAULT_FAMILY
    if name in ADAPTERS:
        return ADAPTERS[name](spark, path, metadata)
    none = no_observations(spark)
    return none, spark.createDataFrame([("P009-OBS-E009", "source family has no adapter", (metadata or {}).get("source_path", path), None, "source_family", name)], DIAGNOSTIC)


def no_observations(spark: SparkSession) -> DataFrame:
    """No observations, with their columns."""
    ids = "struct<figi:string,cusip:string,isin:string,sedol:string,ticker:string,others:array<struct<id_type:string,value:string>>>"
    refs = "array<struct<path:string,pointer:string,row_number:bigint,line_number:bigint,column:string,field:string,sha256:string>>"
    text = "observation_id string, scope_key string, source_family string, source_adapter string, source_id string, accession string, source_record_id string, report_period string, filed_date string"
    return spark.createDataFrame([], f"{text}, ordinal bigint, paths array<string>, ids {ids}, weak array<struct<key:string,value:string>>, path string, row_number bigint, cik string, series_id string, series_name string, refs {refs}, canonical_signature string")


def load_manifest(spark: SparkSession, path: str) -> Loaded:
    """Corpus sources and diagnostics. Wrong dates, ids and hashes are blanked; a row needs a family, a scope, an id, and a local path, a store's address or a bucket with key."""
    rows, unread = read_rows(spark, path, "P009-CORPUS-E001")
    r, c, kind = F.col("row"), F.col, F.col("kind")
    pick = lambda *values: F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))
    inner = T.normalized(F.get_json_object(nested(r, kind, "source_scope", "{"), "$.scope_key"))
    token = lambda n: T.key_token(F.try_element_at(r, F.lit(n)))
    plain = ("schema_version", "primary_document_url", "bucket", "date_partition", "source_layout", "source_name", "source_export_id")
    staged = rows.select(
        "path", "row_number", *(first_of(r, n).alias(n) for n in plain), F.lower(token("source_family")).alias("source_family"), F.lower(token("source_adapter")).alias("source_adapter"), token("form").alias("form"),
        pick(first_of(r, "scope_key", "source_scope_key"), inner).alias("scope_key"), first_of(r, "accession").alias("given_accession"), first_of(r, "source_record_id", "record_id").alias("given_record"),
        first_of(r, "filed_date").alias("given_filed_date"), first_of(r, "report_period").alias("given_report_period"), first_of(r, "local_path", "path", "cached_path").alias("local_path"),
        first_of(r, "s3_uri", "uri").alias("s3_uri"), first_of(r, "key", "s3_key").alias("key"), F.lower(T.identifier(first_of(r, "source_artifact_sha256", "artifact_sha256", "sha256"))).alias("given_sha256"), S.row_id(r).alias("row_id"),
    )
    fits = lambda n, shape: F.when(c(n).rlike(shape), c(n)).otherwise("")
    staged = staged.withColumns({
        "accession": fits("given_accession", ACCESSION), "source_record_id": fits("given_record", RECORD_ID), "filed_date": fits("given_filed_date", DATE), "report_period": fits("given_report_period", DATE),
        "source_artifact_sha256": fits("given_sha256", "^[a-f0-9]{64}$"),
    }).withColumn("source_id", pick(c("accession"), c("source_record_id")))
    one = lambda *args: F.array(problem(*args))
    lost = lambda given, kept: (c(given) != "") & (c(kept) == "")
    missing = lambda field: one("P009-CORPUS-E002", field, F.lit(""), "required field is missing", True)
    tests = [
        (~c("schema_version").isin(*MANIFEST_VERSIONS), one("P009-CORPUS-E001", "schema_version", c("schema_version"), "schema version is unknown", True), True),
        (c("source_family") == "", missing("source_family"), True),
        (~c("source_family").isin(*MANIFEST_FAMILIES), one("P009-CORPUS-E005", "source_family", c("source_family"), "source family is unknown", True), True),
        (c("scope_key") == "", missing("scope_key"), True),
        (lost("given_accession", "accession"), one("P009-CORPUS-E004", "accession", c("given_accession"), "accession has another form"), False),
        (lost("given_record", "source_record_id"), one("P009-CORPUS-E004", "source_record_id", c("given_record"), "record id has other signs"), False),
        (c("source_id") == "", missing("accession_or_source_record_id"), False),  # the row goes on to its other findings
        *((lost(f"given_{n}", n), one("P009-CORPUS-E003", n, c(f"given_{n}"), "date is not YYYY-MM-DD"), False) for n in ("filed_date", "report_period")),
        ((c("local_path") == "") & (c("s3_uri") == "") & ((c("bucket") == "") | (c("key") == "")), one("P009-CORPUS-E006", "artifact", F.lit(""), "row names no artifact", True), True),
        (lost("given_sha256", "source_artifact_sha256"), one("P009-CORPUS-E006", "source_artifact_sha256", c("given_sha256"), "hash is not 64 hex digits"), False),
    ]
    staged = storage.written(staged.withColumn("problems", in_order(tests)), storage.fresh_dir(spark, "manifest"))
    good = staged.where(~F.exists("problems", lambda p: p["fatal"]))
    return good.drop("problems", *(n for n in staged.columns if n.startswith("given_"))), unread.unionByName(told(staged))


def load_corpus(spark: SparkSession, manifest: str, observations: str | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Sources, observations and all diagnostics under the corpus codes; an observation without its source has one too, where there are sources."""
    sources, found = load_manifest(spark, manifest)
    if observations is None:
        return sources, None, found
    rows, bad = load_observations(spark, observations)
    by_field = T.mapped(F.col("field"), CORPUS_FIELDS, F.lit("P009-CORPUS-E002"))
    code = F.when(F.col("code") == "P009-OBS-E007", by_field).otherwise(T.mapped(F.col("code"), CORPUS_CODES, F.lit("P009-CORPUS-E001")))
    told_all = found.unionByName(bad.withColumn("code", code))
    return sources, rows, told_all if sources.isEmpty() else told_all.unionByName(unmatched(rows, sources))


def unmatched(observations: DataFrame, sources: DataFrame) -> DataFrame:
    """Diagnostics of observations whose (scope, source) isn't in the manifest; the observations stay."""
    gone = observations.join(sources.select("scope_key", "source_id"), ["scope_key", "source_id"], "left_anti")
    return gone.select(F.lit("P009-CORPUS-E007").alias("code"), F.lit("observation has no manifest source").alias("message"), "path", "row_number", F.lit("source_scope").alias("field"), F.concat_ws("|", "scope_key", "source_id").alias("value"))


def check_artifacts(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Diagnostics of local artifacts that are missing or whose declared hash differs. files: path, sha256."""
    own = sources.where("local_path <> ''").join(files.select(F.col("path").alias("local_path"), F.col("sha256").alias("found")), "local_path", "left")
    bad = own.where("found is null or (source_artifact_sha256 <> '' and lower(source_artifact_sha256) <> found)")
    return bad.select(F.lit("P009-CORPUS-E006").alias("code"), F.when(F.col("found").isNull(), "artifact is missing").otherwise("artifact hash differs").alias("message"), F.col("local_path").alias("path"), "row_number", "source_id")
