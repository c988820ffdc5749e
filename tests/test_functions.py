"""Scalar functions against literal values."""

import hashlib
import html
import json
import re

import pytest
from pyspark.sql import functions as F

from stratalens.functions import numbers as N
from stratalens.functions import signatures as S
from stratalens.functions import text as T


def values(spark, rows, expr, schema="x string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).coalesce(1)
    return [r[0] for r in df.select(expr.alias("y")).collect()]


def test_normalized(spark):
    rows = ["  a \t b\n", "x&nbsp;y", "A&amp;lt;", " q r ", None, "AT&amp;T &quot;z&quot;"]
    assert values(spark, rows, T.normalized(F.col("x"))) == [re.sub(r"\s+", " ", html.unescape(r or "").replace(" ", " ")).strip() for r in rows]


def test_character_references(spark):
    """All that the standard library's decoder does, once each."""
    import html
    import random

    rnd = random.Random(1)
    bits = ["&", "#", "x", "38", ";", "amp", "reg", "notit", " ", "lt;", "&#189;", "&#x41;", "&#150;", "&#0;", "&#99999999;", "&#xD800;", "&#11;", "&eacute", "&nbsp;", "a", "&CounterClockwiseContourIntegral;", "&#13;", "&#xFFFE;", "&#000000000000065;"]
    texts = ["AT&#38;T &reg; 4&#189;%", "&amp;amp; x", "none", "", *("".join(rnd.choices(bits, k=rnd.randint(0, 9))) for _ in range(800))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.decoded("t")).collect()
    assert [r[0] for r in rows] == [html.unescape(t) for t in texts]


def test_identifiers(spark):
    assert values(spark, ["12-34 56ab7", "é1", ""], T.identifier(F.col("x"))) == ["123456AB7", "É1", ""]
    assert values(spark, ["The NASDAQ Stock  Market LLC", "nyse", "Other"], T.exchange_key(F.col("x"))) == ["NASDAQ", "NYSE", "OTHER"]
    assert values(spark, ["id_cusip", "BB_GLOBAL", "lei"], T.id_type(F.col("x"))) == ["cusip", "figi", "other_typed_identifier"]
    pairs = [("cusip", "123456AB7"), ("cusip", "123"), ("figi", "BBG000000001"), ("isin", "US1234567890"), ("isin", "1S1234567890"), ("lei", "x"), ("sedol", "")]
    assert values(spark, pairs, T.valid_identifier(F.col("t"), F.col("v")), "t string, v string") == [True, False, True, True, False, True, True]


def test_titles(spark):
    rows = ["Common stock, $0.00000625 par value per share", "3.125% Notes due 2028", "2.6250 % note due 2033", "4 1/4% Notes due 2030", "4 1/0% Notes due 2030", "Preferred A", ""]
    got = [None if t is None else (t["kind"], t["normalized"]) for t in values(spark, rows, T.title(F.col("x")))]
    assert got == [("common_stock", "COMMON STOCK PAR 0.00000625"), ("debt_note", "NOTE 3.125% DUE 2028"), ("debt_note", "NOTE 2.625% DUE 2033"), ("debt_note", "NOTE 4.25% DUE 2030"), None, None, None]


def test_decimal_text(spark):
    assert values(spark, ["1.500", "-0.0", "100", "1.23E+3", "abc", None, "0.10"], T.decimal_text(F.col("x"))) == ["1.5", "0", "100", "1230", None, None, "0.1"]


def test_names_and_addresses(spark):
    assert values(spark, ["000012345624000001", "0000123456-24-000001"], T.accession(F.col("x"))) == ["0000123456-24-000001"] * 2
    assert values(spark, ["320193", "CIK 320193"], T.cik(F.col("x"))) == ["0000320193"] * 2
    assert values(spark, ["20240131", "2024-01-31"], T.iso_date(F.col("x"))) == ["2024-01-31"] * 2
    assert values(spark, ["2024-01-31", "x"], T.date_rank(F.col("x"))) == [20240131, 0]
    assert values(spark, ["https://h.org/a/b.htm?q#f", "ftp://x"], T.base_url(F.col("x"))) == ["https://h.org/a/", None]
    assert values(spark, ["a.htm", "../a", "a/b", "", "..", "a\x01"], T.safe_name(F.col("x"))) == [True, False, False, False, False, False]
    assert values(spark, ["{u:a}B"], T.clark_parts(F.col("x")))[0].asDict() == {"namespace": "u:a", "local_name": "B"}


@pytest.mark.parametrize("text", ["plain", 'q"b\\s', "é漢", "😀x", "tab\x01", "del\x7f", ""])
def test_json_ascii(spark, text):
    assert values(spark, [text], S.json_ascii(F.col("x"))) == [json.dumps(text)[1:-1]]


def test_golden_signatures(spark):
    one = spark.range(1)
    period = S.period(F.lit("instant"), F.lit("2023-12-31"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    dims = S.dimensions(F.array(F.struct(F.lit("segment").alias("dim"), F.lit("Commercial").alias("member")), F.struct(F.lit("product").alias("dim"), F.lit("Software").alias("member"))))
    unit = S.unit(F.array(F.lit("{iso4217}USD")), F.lit(None).cast("array<string>"), F.lit("u1"))
    sig = S.duplicate_fact(F.lit("{http://example.com/gaap/2023}Revenue"), F.lit("http://www.sec.gov/CIK"), F.lit("0000123456"), period, dims, unit)
    # dimensions are sorted by name
    assert one.select(sig).first()[0] == "v1|P001|{http://example.com/gaap/2023}Revenue|http://www.sec.gov/CIK|0000123456|instant:2023-12-31|product=Software;segment=Commercial|{iso4217}USD"
    anchoring = S.anchoring(F.lit("{http://company.com/ext/2023}CustomRevenue"), F.array(F.lit("weak_calculation_link"), F.lit("missing_standard_anchor")))
    assert one.select(anchoring).first()[0] == "v1|P002|{http://company.com/ext/2023}CustomRevenue|missing_standard_anchor,weak_calculation_link"
    assert one.select(S.period(F.lit("duration"), F.lit(None).cast("string"), F.lit("2023-01-01"), F.lit("2023-12-31"))).first()[0] == "duration:2023-01-01..2023-12-31"
    assert one.select(S.period(F.lit("forever"), F.lit("x"), F.lit("x"), F.lit("x"))).first()[0] is None
    assert one.select(S.typed_member(F.lit(" a\r\nb "))).first()[0] == "typed:" + hashlib.sha256(b"a\nb").hexdigest()
    assert one.select(S.anchoring(F.lit("é"), F.array(F.lit("x")))).first()[0] is None
    assert one.select(S.fields(S.pairs(b=F.lit("1=2"), a=F.lit("x|y"), c=F.lit("")))).first()[0] == "a=x%7Cy;b=1%3D2"
    weak = S.weak_instrument(F.lit("MSFT"), F.lit("NASDAQ"), F.lit(False))
    assert one.select(weak).first()[0] == "P008:weak|ticker=MSFT|exchange=NASDAQ"
    assert one.select(S.unit(F.array(F.lit("a")), F.array(F.lit("b")), F.lit("perShare"))).first()[0] == "perShare"


def test_row_id(spark):
    row = F.create_map(F.lit("B"), F.lit(" x "), F.lit("a"), F.lit("é"), F.lit("row_number"), F.lit("7"))
    want = json.dumps([["b", "x"], ["a", "é"]], separators=(",", ":"))
    assert spark.range(1).select(S.row_id(row)).first()[0] == hashlib.sha256(want.encode()).hexdigest()


def test_intervals(spark):
    rows = [("14176000", "-3", None), ("5", "INF", None), ("1234", None, "2"), ("7", None, None), ("0", None, "3")]
    span = N.interval(F.col("v").cast(N.DECIMAL), F.col("d"), F.col("p"))
    got = [tuple(float(x) for x in r) for r in values(spark, rows, span, "v string, d string, p string")]
    assert got == [(14175500.0, 14176500.0), (5.0, 5.0), (1184.0, 1284.0), (7.0, 7.0), (0.0, 0.0)]
    assert values(spark, ["1", "x", "", " 2 "], N.number(F.col("x")))[1:3] == [None, None]
    assert spark.range(1).select(N.ratio(F.lit(1), F.lit(3)), N.ratio(F.lit(1), F.lit(0))).first()[:] == (0.333333, 0.0)


def test_doubles_as_sql_casts_them(spark):
    """As DuckDB casts a double to decimal(38,18): with the noise of its product, not by its shortest text."""
    import duckdb

    given = [18.33, 18.43, -18.43, 0.0, 0.1, 5e-19, 99.99, 123456789.01, 1e16 + 2, 7.9e19, 2.675, 1e-5]
    want = [duckdb.execute("select cast(cast(? as double) as decimal(38,18))", [x]).fetchone()[0] for x in given]
    got = [r["d"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x double").select("i", N.of_double(F.col("x")).alias("d")).orderBy("i").collect()]
    assert got == want
