"""Scalar text functions as Columns: normalisation, identifiers, titles, names and addresses."""

from __future__ import annotations

import html
import json
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Exchange names and their keys.
EXCHANGE_KEYS = {
    "NASDAQ STOCK MARKET LLC": "NASDAQ",
    "THE NASDAQ STOCK MARKET LLC": "NASDAQ",
    "NASDAQ GLOBAL SELECT MARKET": "NASDAQ",
    "NASDAQ": "NASDAQ",
    "NYSE": "NYSE",
    "NEW YORK STOCK EXCHANGE": "NYSE",
}

#: Names of identifier types and the types that they stand for.
ID_TYPES = {
    "BB_GLOBAL": "figi",
    "COMPOSITE_FIGI": "figi",
    "FIGI": "figi",
    "ID_BB_GLOBAL": "figi",
    "ID_CUSIP": "cusip",
    "CUSIP": "cusip",
    "CUSIP_NUMBER": "cusip",
    "ID_ISIN": "isin",
    "ISIN": "isin",
    "ID_SEDOL": "sedol",
    "SEDOL": "sedol",
    "ID_TICKER": "ticker",
    "TICKER": "ticker",
}

#: Shapes of identifiers.
ID_SHAPES = {"figi": "^[A-Z0-9]{12}$", "cusip": "^[A-Z0-9]{9}$", "isin": "^[A-Z]{2}[A-Z0-9]{10}$", "sedol": "^[A-Z0-9]{7}$"}

def let(value: Column, f) -> Column:
    """f of a value that is computed once, which keeps deep expressions small."""
    return F.get(F.transform(F.array(value), f), 0)


@lru_cache(maxsize=1)
def _entities() -> tuple[str, str, str]:
    """HTML's named entities as JSON, the names that stand without a semicolon as a pattern of the longest first, and the code points
    that numeric references stand for in place of their own, as JSON. The standard library has the tables."""
    numbers = {}
    for k in range(0x80, 0xA0):
        numbers[str(k)] = html.unescape(f"&#{k};")
    numbers |= {"0": "\ufffd", "13": "\r"}
    bare = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return json.dumps(html5), "^(" + "|".join(bare) + ")", json.dumps(numbers)


#: References that stay in texts that are decoded already, or that come from elsewhere; the ampersand's comes last so that nothing is unescaped twice.
ENTITIES = {"&nbsp;": " ", "&#160;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def quoted(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@lru_cache(maxsize=64)
def references(name: str) -> str:
    """SQL for a text column (or lambda variable) with HTML's character references, named and numeric, decoded once each. It is one SQL text,
    so that a plan that decodes many fields is quick to build."""
    names, bare, numbers = (quoted(x) for x in _entities())
    table = lambda text: f"from_json({text}, 'map<string,string>')"
    shape = quoted(r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
    digits = f"regexp_extract(ref, {quoted('^#[xX]?([0-9a-fA-F]+)')}, 1)"
    value = f"case when length(ltrim('0', {digits})) > 8 then {1 << 40} when ref rlike '^#[xX]' then try_cast(conv({digits}, 16, 10) as bigint) else try_cast({digits} as bigint) end"
    gone = "n between 1 and 8 or n = 11 or n between 14 and 31 or n between 127 and 159 or n between 64976 and 65007 or (n & 65534) = 65534"
    numeric = f"""transform(array({value}), n -> coalesce(try_element_at({table(numbers)}, cast(n as string)),
        case when n > 1114111 or n between 55296 and 57343 then '\ufffd' when {gone} then '' else decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32') end))[0]"""
    named = f"get(array_compact(transform(array(ref, regexp_extract(ref, {bare}, 1)), c -> concat(try_element_at({table(names)}, c), substr(p, length(c) + 1)))), 0)"
    part = f"""transform(array(regexp_extract(p, {shape}, 1)), ref -> case when ref like '#%' then concat({numeric}, substr(p, length(ref) + 1))
        when ref <> '' then coalesce({named}, concat('&', p)) else concat('&', p) end)[0]"""
    return f"""case when contains({name}, '&') then concat(split({name}, '&')[0], array_join(transform(slice(split({name}, '&'), 2, {1 << 30}), p -> {part}), '')) else {name} end"""


def decoded(name: str) -> Column:
    """A column, by its name, with its character references decoded. Texts are decoded where they enter."""
    return F.expr(references(name))


def unescaped(text: Column) -> Column:
    for entity, sign in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def collapsed(text: Column) -> Column:
    """Runs of white space (Unicode's) to one blank, trimmed; null to ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x{A0}]+", " "))


def normalized(text: Column) -> Column:
    return collapsed(unescaped(F.coalesce(text.cast("string"), F.lit(""))))


def key_token(text: Column) -> Column:
    return F.upper(normalized(text))


def mapped(key: Column, table: dict[str, str], otherwise: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, value in table.items():
        out = out.when(key == name, F.lit(value))
    return out.otherwise(otherwise)


def exchange_key(text: Column) -> Column:
    token = key_token(text)
    return mapped(token, EXCHANGE_KEYS, token)


def letters_and_digits(token: Column) -> Column:
    return F.regexp_replace(token, r"[^\p{L}\p{N}]", "")


def identifier(text: Column) -> Column:
    """Letters and digits only, upper case."""
    return letters_and_digits(key_token(text))


def id_type(text: Column) -> Column:
    return mapped(key_token(text), ID_TYPES, F.lit("other_typed_identifier"))


def typed_identifier(kind: Column, value: Column) -> Column:
    """Tickers and other types keep their punctuation."""
    return F.when(kind.isin("ticker", "other_typed_identifier"), key_token(value)).otherwise(identifier(value))


def valid_identifier(kind: Column, value: Column) -> Column:
    """Empty values and types without a shape are valid."""
    out = F.lit(True)
    for name, shape in ID_SHAPES.items():
        out = F.when(kind == name, value.rlike(shape)).otherwise(out)
    return (value == "") | out


def decimal_text(value: Column) -> Column:
    """Plain notation without trailing zeros; null where the text is no number."""

    def short(plain):
        cut = F.when(F.contains(plain, F.lit(".")), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
        return let(cut, lambda s: F.when(s.isin("-0", ""), F.lit("0")).otherwise(s))

    return let(value.try_cast("decimal(38,18)").cast("string"), short)


#: Titles of registered securities (stock with a par value; notes with a decimal or a fractional coupon).
STOCK = r"(?i)^common\s+stock\s*,\s*\$?\s*([0-9]+(?:\.[0-9]+)?)\s+par\s+value\s+per\s+share$"
NOTE = r"(?i)^([0-9]+(?:\.[0-9]+)?)\s*%\s+notes?\s+due\s+([0-9]{4})$"
FRACTION = r"(?i)^([0-9]+)\s+([0-9]+)\s*/\s*([0-9]+)\s*%\s+notes?\s+due\s+([0-9]{4})$"


def title(raw: Column) -> Column:
    """struct(kind, normalized, par, coupon, maturity) of a supported title, else null."""
    return let(normalized(raw), _title)


def _title(text: Column) -> Column:
    part = lambda pattern, k: F.regexp_extract(text, pattern, k)
    par = decimal_text(part(STOCK, 1))
    coupon = decimal_text(part(NOTE, 1))
    whole, num, den = (part(FRACTION, k).try_cast("decimal(18,0)") for k in (1, 2, 3))
    mixed = decimal_text((whole + F.try_divide(num, den)).cast("decimal(38,18)").cast("string"))
    empty = F.lit("")

    def built(kind, name, par, coupon, maturity):
        return F.struct(F.lit(kind).alias("kind"), name.alias("normalized"), par.alias("par"), coupon.alias("coupon"), maturity.alias("maturity"))

    def note(rate, maturity):
        return built("debt_note", F.concat(F.lit("NOTE "), rate, F.lit("% DUE "), maturity), empty, rate, maturity)

    return (
        F.when(text.rlike(STOCK), built("common_stock", F.concat(F.lit("COMMON STOCK PAR "), par), par, empty, empty))
        .when(text.rlike(NOTE), note(coupon, part(NOTE, 2)))
        .when(text.rlike(FRACTION) & (den != 0), note(mixed, part(FRACTION, 4)))
    )


def cik(text: Column) -> Column:
    return F.lpad(F.regexp_replace(normalized(text), "[^0-9]", ""), 10, "0")


def accession(text: Column) -> Column:
    """Eighteen digits get their dashes."""
    return F.regexp_replace(normalized(text), r"^(\d{10})(\d{2})(\d{6})$", "$1-$2-$3")


def valid_accession(text: Column) -> Column:
    return text.rlike(r"^\d{10}-\d{2}-\d{6}$")


def iso_date(text: Column) -> Column:
    return F.regexp_replace(normalized(text), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")


def date_rank(text: Column) -> Column:
    """yyyymmdd as a number, 0 where it isn't one."""
    return F.coalesce(F.replace(text, F.lit("-"), F.lit("")).try_cast("int"), F.lit(0))


def clark(namespace: Column, local: Column) -> Column:
    return F.concat(F.lit("{"), namespace, F.lit("}"), local)


def clark_parts(name: Column) -> Column:
    pattern = r"^\{([^}]+)\}(.+)$"
    return F.struct(F.regexp_extract(name, pattern, 1).alias("namespace"), F.regexp_extract(name, pattern, 2).alias("local_name"))


def base_url(url: Column) -> Column:
    """The address up to its last slash; null where there is no host."""
    return F.when(url.rlike("^https?://[^/]+/"), F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "[^/]*$", ""))


def redacted(options: Column) -> Column:
    """A map of options without the values of keys, tokens and secrets."""
    return F.transform_values(options, lambda k, v: F.when(F.lower(k).rlike("key|token|secret|password"), F.lit("***")).otherwise(v))


def safe_name(name: Column) -> Column:
    """A plain relative file name: no directories, no parent steps, no control signs."""
    return (F.length(name) > 0) & ~name.rlike(r"[/\\\x00-\x1f]") & ~name.isin(".", "..")


def without_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")
