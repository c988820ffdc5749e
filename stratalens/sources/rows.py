"""Tolerant readers: JSON lines, a JSON array or CSV with a header, told apart by a file's first non-blank line.

JSON lines and CSV are read with Spark's text source, which splits files by byte ranges and names each row's block. A first pass counts the lines of
every block (one row a block); line numbers are then positions inside a block plus the counts of the file's blocks before it. A file of any
size is so read by many tasks, and the numbers don't depend on how it was split. A CSV record may span lines inside quotes: whether a line starts
inside a quoted field follows from the number of quotes before it, counted in the same way; a quote that is neither around a field nor doubled
inside one isn't supported there. A JSON array is one value and is parsed by one task.

Every row comes as a map of field names, as written, to text, with the input's path, its kind and a stable row number (physical line for JSON
lines, index for arrays; for CSV the header is 1, and rows count from 2 without empty lines). Of fields with one name the last counts. Rows that can't be
read become diagnostics, as do empty inputs. Values that are nested JSON stay JSON text; in others HTML's character references are decoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalens import storage
from stratalens.functions import text as T

MAP = "map<string,string>"
#: Up to so many blocks their counts are sent to all tasks; beyond, Spark chooses the join.
MOST_BLOCKS = 200_000
EMPTY = "input is empty"
DIAGNOSTIC = "code string, message string, path string, row_number bigint, field string, value string"


def plain_path(path: Column) -> Column:
    """Without the scheme of local files."""
    return F.regexp_replace(path, "^file:/+", "/")


def decoded_path(file: Column) -> Column:
    """The plain path of a file whose name comes as an address (percent-encoded)."""
    return plain_path(F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B"))))


def whole_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, sha256, content (UTF-8, wrong bytes replaced) of the files; also paths that only Spark can read."""
    files = spark.read.format("binaryFile").load([path] if isinstance(path, str) else path)
    return files.select(plain_path(F.col("path")).alias("path"), F.sha2("content", 256).alias("sha256"), F.decode(F.col("content"), "UTF-8").alias("content"))


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file (its address), block (its first byte), seq (consecutive inside a block), line."""
    lines = spark.read.text(path)
    line = F.regexp_replace(F.expr("make_valid_utf8(value)"), r"^\x{FEFF}", "")
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), line.alias("line"))


def block_counts(lines: DataFrame) -> DataFrame:
    """One row a block: its lines, and the file's lines before it; kind, header and whether its lines are records hold for the file."""
    blank = F.trim(F.regexp_replace("line", r"\s", "")) == ""
    quotes = F.length("line") - F.length(F.replace(F.col("line"), F.lit('"'), F.lit("")))
    counts = lines.groupBy("file", "block").agg(
        F.count("*").alias("n"), F.min("seq").alias("first"), F.min_by(F.when(~blank, F.substring(F.ltrim(F.col("line")), 1, 1)), F.when(~blank, F.col("seq"))).alias("sign"),
        F.min_by("line", "seq").alias("top"), F.sum(quotes).alias("quotes"), F.sum((quotes % 2 == 1).cast("int")).alias("odd"), F.sum((F.col("line") == "").cast("int")).alias("empty"),
    )
    file = Window.partitionBy("file").orderBy("block")
    whole = file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sign = F.first("sign", ignorenulls=True).over(whole)
    return counts.select(
        "file", "block", "n", "first", (F.sum("n").over(file) - F.col("n")).alias("before"), (F.sum("quotes").over(file) - F.col("quotes")).alias("quotes_before"),
        F.when(sign == "[", "array").when(sign == "{", "lines").when(sign.isNotNull(), "csv").alias("kind"),
        F.first("top").over(whole).alias("header"), (F.sum(F.col("odd") + F.col("empty")).over(whole) == 0).alias("plain"),
    )


def last_wins(row: Column) -> Column:
    """A map whose last entry of each key counts."""
    entries = F.map_entries(row)
    kept = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda x: x["key"] == e["key"]))
    keys = F.map_keys(row)
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.map_from_entries(kept)).otherwise(row)


def cells(record: Column) -> Column:
    field = r'(?s),("(?:[^"]|"")*"|[^,]*)'
    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(field), F.lit(1)), lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, r'(?s)^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c))


def csv_row(header: Column, record: Column) -> Column:
    """Header and record as a map; missing cells are empty, cells beyond the header are left out."""
    names, values = cells(header), cells(record)
    at = lambda i: F.coalesce(F.try_element_at(values, i + 1), F.lit(""))
    later = lambda n, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), n)
    pairs = F.transform(names, lambda n, i: F.when(later(n, i), F.struct(n.alias("k"), at(i).alias("v"))))
    return F.map_from_entries(F.array_compact(pairs))


def read_rows(spark: SparkSession, path: str | list[str], code: str = "P009-OBS-E001") -> tuple[DataFrame, DataFrame]:
    """(path, kind, row_number, row) and diagnostics (code, message, path, row_number, field, value)."""
    lines = text_lines(spark, path)
    root = storage.fresh_dir(spark, "rows")
    blocks = storage.written(block_counts(lines), f"{root}/blocks")
    side = F.broadcast(blocks) if blocks.count() <= MOST_BLOCKS else blocks
    at = F.col("seq") - F.col("first")
    # both passes list the same splits; a file that changes in between must not shift numbers
    number = F.when((at >= 0) & (at < F.col("n")), F.col("before") + at + 1).otherwise(F.raise_error(F.lit("an input changed while it was read")).cast("bigint"))
    numbered = lines.join(side, ["file", "block"]).withColumn("number", number).withColumn("path", decoded_path(F.col("file")))
    parsed = numbered.where("kind = 'lines'").where(F.trim("line") != "").select("path", F.lit("lines").alias("kind"), F.col("number").alias("row_number"), F.col("line").alias("raw"))
    told = []
    # names of files, which Spark's listing holds on the driver too; signs of patterns in them stand for themselves
    literal = F.regexp_replace(decoded_path(F.col("file")), r"([\[\]{}*?\\])", r"\\$1")
    arrays = [r["file"] for r in blocks.where("kind = 'array'").select(F.when(F.col("file").startswith("file:"), literal).otherwise(F.col("file")).alias("file")).distinct().collect()]
    if arrays:
        whole = whole_files(spark, [f"file://{a}" if a.startswith("/") else a for a in arrays])
        whole = whole.select("path", F.from_json(F.regexp_replace("content", r"^\x{FEFF}", ""), "array<string>").alias("items"), F.substring("content", 1, 200).alias("head"))
        told.append(whole.where("items is null").select("path", F.lit(1).cast("bigint").alias("row_number"), F.col("head").alias("value")))
        items = whole.select("path", F.posexplode("items").alias("pos", "raw"))
        parsed = parsed.union(items.select("path", F.lit("array"), (F.col("pos") + 1).cast("bigint"), "raw"))
    parsed = parsed.withColumn("row", F.when(F.ltrim("raw").startswith("{"), F.from_json("raw", MAP)))
    told.append(parsed.where("row is null").select("path", "row_number", F.coalesce("raw", F.lit("")).alias("value")))
    # a generator leaves nulls out: as a condition, the optimizer would move the parsing below and do it twice
    objects = parsed.select("path", "kind", "row_number", F.explode(F.array_compact(F.array("row"))).alias("row")).withColumn("row", last_wins(F.col("row")))
    rows = objects.unionByName(_csv_rows(numbered.where("kind = 'csv'")))
    nested = "(v like '{%' or v like '[%')"
    rows = rows.withColumn("row", F.expr(f"transform_values(row, (k, v) -> case when v is null then '' when kind <> 'csv' and {nested} then v else {T.references('v')} end)"))
    full = blocks.where("kind is not null").select(decoded_path(F.col("file")).alias("path")).distinct()
    names = spark.createDataFrame([(f,) for f in lines.inputFiles()], "file string").select(decoded_path(F.col("file")).alias("path"))
    void = names.distinct().join(full, "path", "left_anti")
    out = void.select(F.lit(code), F.lit(EMPTY), "path", F.lit(None).cast("bigint"), F.lit(""), F.lit(""))
    for t in told:
        out = out.union(t.select(F.lit(code), F.lit("row cannot be read"), "path", "row_number", F.lit(""), "value"))
    return rows, out.toDF(*(f.split(" ")[0] for f in DIAGNOSTIC.split(", ")))


def _csv_rows(lines: DataFrame) -> DataFrame:
    """Lines that are records go straight on; only files with records over several lines or empty lines are put together."""
    one = lines.where("plain and number > 1").select("path", "header", F.col("number").alias("row_number"), F.col("line").alias("record"))
    quotes = F.length("line") - F.length(F.replace(F.col("line"), F.lit('"'), F.lit("")))
    inside = F.coalesce(F.sum(quotes).over(Window.partitionBy("path", "block").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = lines.where("not plain").withColumn("quotes", quotes).withColumn("start", (F.col("quotes_before") + inside) % 2 == 0)
    starts = starts.where("not (start and line = '')")
    # records by block, then over a file's blocks: no task holds a file
    local = Window.partitionBy("path", "block").orderBy("number")
    ranked = starts.withColumn("local", F.sum(F.col("start").cast("int")).over(local))
    per_block = ranked.groupBy("path", "block").agg(F.sum(F.col("start").cast("bigint")).alias("c"))
    earlier = per_block.select("path", "block", (F.sum("c").over(Window.partitionBy("path").orderBy("block")) - F.col("c")).alias("earlier"))
    records = ranked.join(earlier, ["path", "block"]).withColumn("record_number", F.col("earlier") + F.col("local"))
    joined = records.groupBy("path", "record_number").agg(F.array_sort(F.collect_list(F.struct("number", "line"))).alias("l"))
    joined = joined.select("path", "record_number", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("record"))
    heads = joined.where("record_number = 1").select("path", F.col("record").alias("header"))
    many = joined.where("record_number > 1").join(heads, "path").select("path", "header", F.col("record_number").alias("row_number"), "record")
    return one.union(many).select("path", F.lit("csv").alias("kind"), "row_number", csv_row(F.col("header"), F.col("record")).alias("row"))


def normalized_values(row: Column) -> Column:
    """The map with its values normalised, each once, however many names are looked for in it. Texts without a reference need no decoding."""
    text = lambda v: F.when(F.contains(v, F.lit("&")), T.unescaped(v)).otherwise(F.coalesce(v, F.lit("")))
    return F.transform_values(row, lambda k, v: T.collapsed(text(v)))


def first_given(given: Column, *names: str) -> Column:
    """``first_of`` in a map whose values are normalised."""
    return F.coalesce(*(F.nullif(F.try_element_at(given, F.lit(n)), F.lit("")) for n in names), F.lit(""))


def first_of(row: Column, *names: str) -> Column:
    """The first non-empty value, normalised; ''."""
    values = [F.nullif(T.normalized(F.try_element_at(row, F.lit(n))), F.lit("")) for n in names]
    return F.coalesce(*values, F.lit(""))
