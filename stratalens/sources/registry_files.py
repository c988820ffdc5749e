"""Registry snapshots, mapping directories, overlays; index listings and responses of filing services."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalens.functions import signatures as S
from stratalens.functions import text as T

FIELDS = ("figi", "ticker", "exchange", "security_title", "normalized_title", "canonical_signature", "cusip", "isin", "sedol", "composite_figi", "share_class_figi", "market_sector", "security_type", "name")
ROW = "array<struct<" + ",".join(f"{f}:string" for f in FIELDS) + ",other_identifiers:array<struct<id_type:string,value:string>>>>"


def load_snapshot(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Normalised registry rows with row_id. A row whose FIGI isn't twelve signs fails the whole snapshot, at run time."""
    document = spark.read.format("binaryFile").load(path).select(F.decode("content", "UTF-8").alias("d"))
    rows = document.select(F.from_json(F.get_json_object("d", "$.rows"), ROW).alias("rows"), F.coalesce(F.get_json_object("d", "$.snapshot_id"), F.lit("")).alias("snapshot_id"))
    rows = rows.select("snapshot_id", F.posexplode("rows").alias("pos", "r")).select("snapshot_id", "pos", "r.*")
    ids = ("figi", "cusip", "isin", "sedol", "composite_figi", "share_class_figi")
    rows = rows.withColumns({f: T.identifier(F.col(f)) if f in ids else T.exchange_key(F.col(f)) if f == "exchange" else T.key_token(F.col(f)) if f == "ticker" else T.normalized(F.col(f)) for f in FIELDS})
    if strict:
        bad = ~F.col("figi").rlike("^[A-Z0-9]{12}$")
        rows = rows.withColumn("figi", F.when(bad, F.raise_error(F.concat(F.lit("registry row without a valid FIGI: "), F.col("pos").cast("string")))).otherwise(F.col("figi")))
    rows = rows.withColumn("row_id", S.registry_row_id(F.struct(*FIELDS), list(FIELDS)))
    return rows.drop("pos")


def snapshot_metadata(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """One row: the snapshot's hash and counts."""
    sha = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("snapshot_sha256"))
    return sha.join(rows.agg(F.count("*").alias("n_rows"), F.count_distinct("figi").alias("n_figi"), F.max("snapshot_id").alias("snapshot_id")), how="inner")


def load_overlay(spark: SparkSession, path: str, columns: tuple[str, ...] = FIELDS) -> DataFrame:
    """seed and columns of overlay rows (an array, or rows inside an object); the last row of a seed wins."""
    text = spark.read.format("binaryFile").load(path).select(F.decode("content", "UTF-8").alias("d"))
    items = F.coalesce(F.from_json(F.get_json_object("d", "$.rows"), "array<map<string,string>>"), F.from_json("d", "array<map<string,string>>"))
    rows = text.select(F.posexplode(items).alias("pos", "r"))
    seed = F.coalesce(*(F.nullif(T.identifier(F.try_element_at("r", F.lit(c))), F.lit("")) for c in ("seed", "cusip", "isin", "sedol")))
    rows = rows.select("pos", seed.alias("seed"), *(T.normalized(F.try_element_at("r", F.lit(c))).alias(c) for c in columns)).where("seed is not null")
    last = rows.withColumn("__r", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("pos")))).where("__r = 1")
    return last.drop("__r", "pos")


def load_mappings(spark: SparkSession, folder: str) -> DataFrame:
    """input, target, values (in order) from files named <seed>-to-<target>.json, arrays of {input, output}."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*-to-*.json").load(folder)
    rows = files.select(F.regexp_extract("path", r"-to-([^/]+)\.json$", 1).alias("target"), F.posexplode(F.from_json(F.decode("content", "UTF-8"), "array<struct<input:string,output:string>>")).alias("pos", "m"))
    rows = rows.select("target", "pos", T.identifier(F.col("m.input")).alias("input"), T.normalized(F.col("m.output")).alias("value")).where("input <> '' and value <> ''")
    lists = rows.groupBy("input", "target").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v"))
    return lists.select("input", "target", F.transform("v", lambda x: x["value"]).alias("values"))


def snapshot_from_mappings(mappings: DataFrame, overlay: DataFrame | None, seed_column: str) -> DataFrame:
    """One row per FIGI of an input; other targets give their first value; the overlay wins where it has a value."""
    figis = mappings.where("target = 'figi'").select("input", F.explode("values").alias("figi"))
    firsts = mappings.where("target <> 'figi'").groupBy("input").pivot("target", [f for f in FIELDS if f != "figi"]).agg(F.first(F.get("values", 0)))
    rows = figis.join(firsts, "input", "left").withColumn(seed_column, F.coalesce(F.nullif(F.coalesce(F.col(seed_column), F.lit("")), F.lit("")), F.col("input")))
    if overlay is not None:
        extra = overlay.select(F.col("seed").alias("input"), *(F.nullif(F.col(c), F.lit("")).alias(f"o_{c}") for c in overlay.columns if c != "seed" and c in FIELDS))
        rows = rows.join(extra, "input", "left")
        rows = rows.withColumns({c: F.coalesce(f"o_{c}", c) for c in FIELDS if f"o_{c}" in rows.columns}).drop(*(c for c in rows.columns if c.startswith("o_")))
    return rows.select("input", *(F.coalesce(F.col(f), F.lit("")).alias(f) for f in FIELDS))


def normalize_response(response: DataFrame, column: str = "body") -> tuple[DataFrame, DataFrame]:
    """Filings of a service's JSON answers, newest first, and rejected rows. Content may be nested text; rows stand under
    filings, rows, data or results."""
    inner = F.coalesce(F.get_json_object(column, "$.data.content"), F.get_json_object(column, "$.content"), F.col(column))
    lists = [F.from_json(F.get_json_object(inner, f"$.{k}"), "array<map<string,string>>") for k in ("filings", "rows", "data", "results")]
    rows = response.select(F.explode(F.coalesce(*lists, F.from_json(inner, "array<map<string,string>>"))).alias("m"))
    low = F.transform_keys("m", lambda k, v: F.lower(k))
    get = lambda *n: T.normalized(F.coalesce(*(F.try_element_at(F.col("m"), F.lit(x)) for x in n)))
    rows = rows.select(low.alias("m")).select(T.accession(get("accession", "accession_number")).alias("accession"), get("cik").alias("cik"), T.iso_date(get("filed_date", "filing_date")).alias("filed_date"), get("form", "form_type").alias("form"), get("ticker").alias("ticker"))
    complete = (F.col("accession") != "") & (F.col("cik") != "") & (F.col("filed_date") != "") & (F.col("form") != "")
    good = rows.where(complete).withColumn("cik", T.cik(F.col("cik"))).orderBy(F.desc("filed_date"), "ticker", "accession")
    return good, rows.where(~complete)


def index_items(listings: DataFrame, column: str = "body") -> DataFrame:
    """accession, name, size of an index listing: its JSON, else the links of its page."""
    items = F.from_json(F.get_json_object(column, "$.directory.item"), "array<struct<name:string,size:string>>")
    links = F.transform(F.regexp_extract_all(column, F.lit(r'(?i)href="[^"]*/([^"/]+\.\w+)"'), F.lit(1)), lambda n: F.struct(n.alias("name"), F.lit("").alias("size")))
    return listings.select("accession", F.explode(F.coalesce(items, links)).alias("i")).select("accession", "i.name", F.coalesce(F.col("i.size").try_cast("long"), F.lit(0).cast("long")).alias("size"))


def primary_document(items: DataFrame) -> DataFrame:
    """The primary page of each accession: named like a schema, no report page, the largest, then by name."""
    stems = items.where(F.lower("name").endswith(".xsd")).select("accession", F.regexp_replace(F.lower("name"), r"\.xsd$", "").alias("stem")).distinct()
    pages = items.where(F.lower("name").rlike(r"\.html?$")).withColumn("stem", F.regexp_replace(F.lower("name"), r"\.html?$", ""))
    pages = pages.join(stems.withColumn("match", F.lit(True)), ["accession", "stem"], "left")
    rank = F.struct((~F.coalesce("match", F.lit(False))).alias("a"), F.col("name").rlike(r"(?i)^R\d+\.htm").alias("b"), (-F.col("size")).alias("c"), F.col("name").alias("d"))
    return pages.groupBy("accession").agg(F.min_by("name", rank).alias("primary"))


def extension_artifacts(items: DataFrame) -> DataFrame:
    return items.where(F.lower("name").rlike(r"(\.xsd|_(cal|def|lab|pre)\.xml)$")).select("accession", "name").distinct().orderBy("accession", "name")
