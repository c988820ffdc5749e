"""Canonical signatures and ids: sha256 over version-tagged text with sorted parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalens.functions import text as T


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def ascii_only(text: Column) -> Column:
    """Null where a sign lies outside ASCII: such signatures don't exist."""
    return T.let(text, lambda t: F.when(t.rlike(r"^[\x00-\x7F]*$"), t))


def json_ascii(text: Column) -> Column:
    """The inside of a JSON string in ASCII: quotes and backslashes escaped, other signs as \\uXXXX of UTF-16."""
    return T.let(text, _json_ascii)


def _json_ascii(text: Column) -> Column:
    plain = F.regexp_replace(text, r'(["\\])', r"\\$1")
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit(".{4}"), F.lit(0))
    sign = lambda h: F.char(F.conv(h, 16, 10).cast("int"))
    coded = F.transform(
        units,
        lambda h: F.when(h.isin("0022", "005C"), F.concat(F.lit("\\"), sign(h))).when((h >= "0020") & (h <= "007E"), sign(h)).otherwise(F.concat(F.lit("\\u"), F.lower(h))),
    )
    return F.when(text.rlike(r"^[ -~]*$"), plain).otherwise(F.array_join(coded, ""))


def token(value: Column) -> Column:
    """Normalised, JSON-escaped text whose separators are escaped too."""
    return F.replace(F.replace(json_ascii(T.normalized(value)), F.lit("|"), F.lit("%7C")), F.lit("="), F.lit("%3D"))


def fields(pairs: Column) -> Column:
    """k=v;k=v of array<struct<key,value>> with values, in the order of (key, value)."""
    some = F.filter(F.array_sort(pairs), lambda p: p["value"] != "")
    return F.array_join(F.transform(some, lambda p: F.concat(token(p["key"]), F.lit("="), token(p["value"]))), ";")


def pairs(**columns: Column) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("key"), F.coalesce(v, F.lit("")).alias("value")) for k, v in columns.items()))


def joined_sorted(values: Column, separator: str = ",") -> Column:
    return F.array_join(F.array_sort(F.array_distinct(values)), separator)


def versioned(pattern: str, *parts: Column) -> Column:
    return ascii_only(F.concat_ws("|", F.lit("v1"), F.lit(pattern), *(F.coalesce(p, F.lit("")) for p in parts)))


def period(kind: Column, instant: Column, start: Column, end: Column) -> Column:
    """instant:d or duration:s..e; null for any other kind."""
    return F.when(kind == "instant", F.concat(F.lit("instant:"), instant)).when(kind == "duration", F.concat(F.lit("duration:"), start, F.lit(".."), end))


def dimensions(dims: Column) -> Column:
    """dim=member;... in the order of (dim, member)."""
    return F.array_join(F.transform(F.array_sort(dims), lambda d: F.concat(d["dim"], F.lit("="), d["member"])), ";")


def typed_member(value: Column) -> Column:
    unix = F.trim(F.regexp_replace(value, "\r\n?", "\n"))
    return F.concat(F.lit("typed:"), sha(unix))


def unit(measures: Column, denominators: Column, unit_id: Column) -> Column:
    """Sorted measures; a ratio stands for itself by its id; '' without a unit."""
    ratio = F.coalesce(F.size(denominators) > 0, F.lit(False))
    return F.coalesce(F.when(ratio, unit_id).otherwise(F.array_join(F.array_sort(measures), ";")), F.lit(""))


def same_unit(a: Column, b: Column) -> Column:
    return F.array_sort(a).eqNullSafe(F.array_sort(b))


def duplicate_fact(concept: Column, scheme: Column, entity: Column, period_sig: Column, dim_sig: Column, unit_sig: Column) -> Column:
    return F.when(period_sig.isNotNull(), versioned("P001", concept, scheme, entity, period_sig, dim_sig, unit_sig))


def anchoring(concept: Column, codes: Column) -> Column:
    return versioned("P002", concept, joined_sorted(codes))


def fact_rule(concept: Column, context: Column, unit_sig: Column, code: Column) -> Column:
    return versioned("P004", concept, context, unit_sig, code)


def taxonomy(code: Column, refs: Column, namespaces: Column) -> Column:
    """The sorted lists enter as digests."""
    digest = lambda values: sha(F.array_join(F.array_sort(values), "\n"))
    return versioned("P005", code, F.concat(F.lit("schemaRefSha256="), digest(refs)), F.concat(F.lit("nsSha256="), digest(namespaces)))


def duplicate_context(scheme: Column, entity: Column, period_sig: Column, dim_sig: Column) -> Column:
    return versioned("P007", scheme, entity, period_sig, dim_sig)


def instrument(prefix: str, **values: Column) -> Column:
    """P008:prefix|k=v|...; empty values stay."""
    safe = lambda v: F.replace(F.replace(T.normalized(v), F.lit("|"), F.lit("%7C")), F.lit("="), F.lit("%3D"))
    return F.concat_ws("|", F.lit(f"P008:{prefix}"), *(F.concat(F.lit(f"{k}="), safe(v)) for k, v in values.items()))


def weak_instrument(ticker: Column, exchange: Column, no_symbol: Column) -> Column:
    """'' without a trading symbol or an exchange."""
    key = instrument("weak", ticker=ticker, exchange=exchange)
    return F.when((ticker == "") | (exchange == "") | F.coalesce(no_symbol, F.lit(False)), F.lit("")).otherwise(key)


def finding_id(accession: Column, pattern: Column, prefix: str = "F") -> Column:
    """prefix-accession-pattern; the prefix names the issuer of findings."""
    return F.concat_ws("-", F.lit(prefix), accession, pattern)


def finding_parts(finding: Column, prefix: str = "F") -> Column:
    shape = rf"^{prefix}-(\d{{10}}-\d{{2}}-\d{{6}})-(.*P\d{{3}})$"
    return F.struct(F.regexp_extract(finding, shape, 1).alias("accession"), F.regexp_extract(finding, shape, 2).alias("pattern"))


def row_id(row: Column) -> Column:
    """sha256 of a map's entries as sorted [key, value] pairs in compact JSON, without row_number."""
    entries = F.array_sort(F.filter(F.map_entries(row), lambda e: e["key"] != "row_number"))
    quoted = lambda v: F.concat(F.lit('"'), json_ascii(v), F.lit('"'))
    parts = F.transform(entries, lambda e: F.concat(F.lit("["), quoted(F.lower(e["key"])), F.lit(","), quoted(T.normalized(e["value"])), F.lit("]")))
    return sha(F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")))


def registry_row_id(row: Column, names: list[str]) -> Column:
    """sha256 of a registry row as JSON with sorted keys, blanks after separators, and without empty values."""
    quoted = lambda v: F.concat(F.lit('"'), json_ascii(v), F.lit('"'))
    parts = [F.when(F.coalesce(row[n], F.lit("")) != "", F.concat(F.lit(f'"{n}": '), quoted(row[n]))) for n in sorted(names)]
    return sha(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")))


def list_hash(entries: Column) -> Column:
    """sha256 over path<tab>sha lines of array<struct<path,sha>>, in order of path."""
    return sha(F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(e["path"], F.lit("\t"), e["sha"], F.lit("\n"))), ""))
