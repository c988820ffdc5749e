"""The splitting row reader and the observation loader: literal values, and ids against an independent version."""

import csv
import hashlib
import html
import io
import json
import random
import re

import pytest

from stratalens.sources import observations, rows


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "997", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def numbered(spark, path):
    good, bad = rows.read_rows(spark, f"file://{path}")
    return {r["row_number"]: r["row"] for r in good.collect()}, sorted((r["row_number"], r["code"]) for r in bad.collect())


def test_lines_keep_their_numbers_over_splits(spark, tmp_path, small_splits):
    rnd = random.Random(2)
    texts, want, broken = [], {}, []
    for n in range(1, 1500):
        kind = rnd.randrange(12)
        if kind == 0:
            texts.append("")
        elif kind == 1:
            texts.append("{broken")
            broken.append((n, "P009-OBS-E001"))
        elif kind == 2:
            texts.append("[1]")
            broken.append((n, "P009-OBS-E001"))
        else:
            row = {"k": str(n), "t": "x" * rnd.choice([1, 10, 2500 if n % 100 == 0 else 5])}
            want[n] = row
            texts.append(json.dumps(row))
    texts[0] = json.dumps({"k": "1"})
    want[1], broken = {"k": "1"}, [b for b in broken if b[0] != 1]
    for name, end in (("a.jsonl", "\n"), ("b.jsonl", "\r\n"), ("c.jsonl", "\r")):
        (tmp_path / name).write_bytes(end.join(texts).encode())
        assert rows.text_lines(spark, f"file://{tmp_path}/{name}").rdd.getNumPartitions() > 20
        assert numbered(spark, tmp_path / name) == (want, broken)


def test_csv_records_over_lines_and_splits(spark, tmp_path, small_splits):
    rnd = random.Random(3)
    table = [["id", "note", "note"]]
    for n in range(600):
        table.append([str(n), rnd.choice(["", "plain", "with, comma", 'a "quote"', "two\nlines", '"\n\n"', "x" * 40]), rnd.choice(["", "last"])][: rnd.choice([3, 3, 3, 2])])
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(table)
    body = out.getvalue().replace("\n7,", "\n\n\n7,", 1)
    (tmp_path / "t.csv").write_text(body)
    (tmp_path / "plain.csv").write_text("id,note\n" + "".join(f"{n},{'y' * (n % 70)}\n" for n in range(300)))
    want = {n: {k: (v or "") for k, v in r.items() if k} for n, r in enumerate(csv.DictReader(io.StringIO(body)), start=2)}
    assert numbered(spark, tmp_path / "t.csv") == (want, [])
    assert numbered(spark, tmp_path / "plain.csv")[0] == {n + 2: {"id": str(n), "note": "y" * (n % 70)} for n in range(300)}


def test_kinds_of_inputs_in_one_folder(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n  [{"a": 1, "a": 2}, 5, {"b": {"c": "&amp;"}, "d": "&amp;"}]')
    (tmp_path / "b [x]+%20ü.json").write_text("[1, 2")
    (tmp_path / "c d.csv").write_text("a\n1\n")
    (tmp_path / "d.jsonl").write_text("")
    (tmp_path / "e.jsonl").write_text(" \n\n")
    good, bad = rows.read_rows(spark, f"file://{tmp_path}")
    name = lambda r: r["path"].rsplit("/", 1)[1]
    assert {(name(r), r["kind"], r["row_number"], json.dumps(r["row"], sort_keys=True)) for r in good.collect()} == {
        ("a.json", "array", 1, '{"a": "2"}'), ("a.json", "array", 3, '{"b": "{\\"c\\":\\"&amp;\\"}", "d": "&"}'), ("c d.csv", "csv", 2, '{"a": "1"}')}
    assert {(name(r), r["row_number"], r["message"]) for r in bad.collect()} == {
        ("a.json", 2, "row cannot be read"), ("b [x]+%20ü.json", 1, "row cannot be read"), ("d.jsonl", None, "input is empty"), ("e.jsonl", None, "input is empty")}


def load(spark, path, items, **metadata):
    path.write_text("\n".join(json.dumps(x) for x in items))
    good, bad = observations.load_observations(spark, f"file://{path}", metadata)
    return {r["row_number"]: r for r in good.collect()}, sorted((r["row_number"], r["code"], r["field"]) for r in bad.collect())


BASE = {"scope_key": "s", "source_record_id": "r", "report_period": "2024-03-31", "fair_value": "10"}
ACC = "0001234567-24-000001"


def test_families_defaults_and_codes(spark, tmp_path):
    families = ["csv", "ixbrl", "jsonl", "local_export", "SEC_Filing", "test_fixture", "xml", "", "nport", "bloomberg"]
    cases = [{**BASE, "source_family": f} for f in families] + [
        {**BASE, "schema_version": "2.0"},  # 11
        {"source_record_id": "r", "cusip": "1"},
        {**BASE, "accession": "1-2-3"},
        {**BASE, "accession": "1-2-3", "source_record_id": ""},
        {**BASE, "accession": ACC, "filed_date": "20240101", "report_period": "March"},  # 15
        {**BASE, "report_period": ""},
        {"scope_key": "s", "source_record_id": "r", "report_period": "2024-03-31"},
        {**BASE, "cusip": "12", "isin": "US0378331005", "figi": "bbg000b9xry4"},
        {**BASE, "other_identifiers": [{"type": "lei", "value": "abc"}, 5, {"id_type": "x"}], "other_identifier_type": "wkn", "other_identifier_value": "865985"},
        {"scope_key": "s", "source_record_id": "r", "cusip": "12"},  # 20
    ]
    got, bad = load(spark, tmp_path / "o.jsonl", cases)
    assert [got[n]["source_family"] for n in range(1, 9)] == ["csv", "ixbrl", "jsonl", "local_export", "sec_filing", "test_fixture", "xml", "local_export"]
    assert {got[n]["source_adapter"] for n in range(1, 9)} == {"p009_rows_v1"}
    assert set(got) == {*range(1, 9), 13, 15, 16, 18, 19}
    assert bad == [
        (9, "P009-OBS-E002", "source_family"), (10, "P009-OBS-E002", "source_family"), (11, "P009-OBS-E007", "schema_version"), (12, "P009-OBS-E003", "scope_key"), (13, "P009-OBS-E007", "accession"),
        (14, "P009-OBS-E007", "accession"), (14, "P009-OBS-E007", "accession"), (15, "P009-OBS-E007", "filed_date"), (15, "P009-OBS-E007", "report_period"), (16, "P009-OBS-E008", "report_period"),
        (17, "P009-OBS-E004", "identity"), (18, "P009-OBS-E006", "cusip"), (19, "P009-OBS-E006", "other_identifiers"), (19, "P009-OBS-E007", "other_identifiers"),
        (20, "P009-OBS-E004", "identity"), (20, "P009-OBS-E006", "cusip"), (20, "P009-OBS-E008", "report_period"),
    ]
    assert (got[13]["accession"], got[13]["source_id"], got[15]["source_id"]) == ("", "r", ACC)
    assert (got[18]["ids"]["figi"], got[18]["ids"]["cusip"], got[18]["ids"]["isin"]) == ("BBG000B9XRY4", "", "US0378331005")
    assert [tuple(o) for o in got[19]["ids"]["others"]] == [("LEI", "ABC"), ("WKN", "865985")]
    named, _ = load(spark, tmp_path / "m.jsonl", [BASE, {**BASE, "source_family": "csv"}], source_family="xml", source_adapter="Mine", source_path="given.xml")
    assert [(named[n]["source_family"], named[n]["source_adapter"], named[n]["paths"]) for n in (1, 2)] == [("xml", "mine", [f"given.xml#row={n}"]) if n == 1 else ("csv", "mine", ["given.xml#row=2"]) for n in (1, 2)]


def test_weak_names_scopes_ordinals_and_references(spark, tmp_path):
    rows_ = [
        {**BASE, "issuer": "I", "investment_description": "D", "percent_value": 1.5, "asset_category": "EC", "coupon_percent": "5", "unit": "NS", "currency": " usd ", "issuer_type": "CORP"},
        {"source_scope": {"scope_key": "inner", "cik": "7"}, "scope_key": "outer", "record_id": "x", "report_date": "2024-01-01", "name": "N", "market_value": "3", "holding_ordinal": 9},
        {"source_scope": "text scope", "source_record_id": "x", "period_end": "2024-01-01", "title": "T", "observation_ordinal": 0, "holding_ordinal": 4},
        {**BASE, "source_refs": [{"path": "b", "row_number": 3}, {"source_path": "a", "xpath": "/x", "line_number": "2", "column": "c", "field": "f"}, "odd"]},
        {**BASE, "source_path": "p", "xpath": "/y", "row_number": 77, "line_number": 5, "holding_ordinal": 0},
        {**BASE, "value": "", "fair_value": "4", "val_usd": "5", "cur_cd": "EUR", "annualized_rt": "6"},
    ]
    got, bad = load(spark, tmp_path / "o.jsonl", rows_)
    assert bad == []
    weak = {n: {p["key"]: p["value"] for p in r["weak"]} for n, r in got.items()}
    assert weak[1] == {"issuer_name": "I", "title_or_description": "D", "value": "10", "pct_value": "1.5", "currency": "USD", "asset_type": "EC", "issuer_type": "CORP", "units": "NS", "coupon": "5"}
    assert weak[6] == {"value": "4"} and weak[2] == {"issuer_name": "N", "value": "3"}
    assert [(got[n]["scope_key"], got[n]["cik"], got[n]["ordinal"], got[n]["report_period"]) for n in (2, 3)] == [("inner", "7", 9, "2024-01-01"), ("text scope", "", 0, "2024-01-01")]
    assert got[4]["paths"] == ["a#pointer=/x#line=2#column=c#field=f", "b#row=3"]
    assert got[5]["paths"] == ["p#pointer=/y#row=77#line=5"] and got[5]["ordinal"] == 4


def independent_id(family, adapter, source, period, scope, ordinal, place, strong, weak):
    """sha256 over the escaped parts."""
    def token(value):
        text = re.sub(r"\s+", " ", html.unescape(value)).strip()
        return json.dumps(text, ensure_ascii=True)[1:-1].replace("|", "%7C").replace("=", "%3D")

    listed = lambda d: ";".join(f"{token(k)}={token(v)}" for k, v in sorted(d.items()) if v)
    parts = ["P009:observation", family, adapter, source, period, scope, str(ordinal), place, listed(strong), listed(weak)]
    return hashlib.sha256(("v1|" + "|".join(token(p) for p in parts)).encode("ascii")).hexdigest()


def test_observation_ids(spark, tmp_path):
    got, _ = load(spark, tmp_path / "o.jsonl", [
        {**BASE, "cusip": "037833100", "source_path": "in.csv", "title": 'Größe "A|B"=\\ x', "other_id_type": "lei", "other_id_value": "q"},
        {**BASE, "ticker": "t.x", "accession": ACC, "source_family": "xml", "source_adapter": "n 1"},
    ])
    assert got[1]["observation_id"] == independent_id("local_export", "p009_rows_v1", "r", "2024-03-31", "s", 0, "in.csv#row=1", {"cusip": "037833100", "other:LEI": "Q"}, {"title_or_description": 'Größe "A|B"=\\ x', "value": "10"})
    assert got[2]["observation_id"] == independent_id("xml", "n 1", ACC, "2024-03-31", "s", 1, f"{tmp_path}/o.jsonl#row=2", {"ticker": "T.X"}, {"value": "10"})


def test_adapters_by_family(spark, tmp_path):
    (tmp_path / "o.csv").write_text("scope_key,record_id,fair_value,report_date\ns,r,1,2024-01-01\n")
    read = observations.load_family(spark, " CSV ", f"file://{tmp_path}/o.csv")[0]
    assert read.count() == 1
    none, bad = observations.load_family(spark, "nport", "x")
    assert none.count() == 0 and none.columns == read.columns
    assert [(r["code"], r["value"]) for r in bad.collect()] == [("P009-OBS-E009", "nport")]
    observations.ADAPTERS["own"] = lambda spark, path, metadata: observations.load_observations(spark, path, {"source_family": "xml"})
    try:
        assert observations.load_family(spark, "own", f"file://{tmp_path}/o.csv")[0].first()["source_family"] == "xml"
    finally:
        del observations.ADAPTERS["own"]


MANIFEST = [
    {"source_family": "external", "scope_key": "s", "source_record_id": "r", "cached_path": "x", "artifact_sha256": "A" * 64, "form": " 10-k "},
    {"source_family": "csv", "source_scope": {"scope_key": "t"}, "accession": ACC, "bucket": "b", "s3_key": "k"},
    {"source_family": "csv", "scope_key": "s", "source_record_id": "r", "bucket": "b"},
    {"source_family": "csv", "scope_key": "s", "source_record_id": "r", "primary_document_url": "http://x"},
    {"source_family": "csv", "scope_key": "s", "source_record_id": "r", "uri": "s3://b/k", "sha256": "12", "filed_date": "bad"},
    {"source_family": "nport", "scope_key": "s", "source_record_id": "r", "path": "x"},
    {"scope_key": "s", "source_record_id": "r", "path": "x"},
    {"source_family": "csv", "scope_key": "s", "source_record_id": "!r", "accession": "1", "path": "x"},
    {"source_family": "csv", "scope_key": "s", "source_record_id": "r", "path": "x", "schema_version": "9"},
]


def test_manifest_rules(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(MANIFEST))
    sources, bad = observations.load_manifest(spark, f"file://{tmp_path}/m.json")
    got = {r["row_number"]: r for r in sources.collect()}
    assert set(got) == {1, 2, 5}
    assert (got[1]["local_path"], got[1]["source_artifact_sha256"], got[1]["form"]) == ("x", "a" * 64, "10-K")
    assert (got[2]["scope_key"], got[2]["key"], got[2]["source_id"]) == ("t", "k", ACC) and (got[5]["s3_uri"], got[5]["source_artifact_sha256"], got[5]["filed_date"]) == ("s3://b/k", "", "")
    assert sorted((r["row_number"], r["code"], r["field"]) for r in bad.collect()) == [
        (3, "P009-CORPUS-E006", "artifact"), (4, "P009-CORPUS-E006", "artifact"), (5, "P009-CORPUS-E003", "filed_date"), (5, "P009-CORPUS-E006", "source_artifact_sha256"),
        (6, "P009-CORPUS-E005", "source_family"), (7, "P009-CORPUS-E002", "source_family"), (8, "P009-CORPUS-E002", "accession_or_source_record_id"), (8, "P009-CORPUS-E004", "accession"),
        (8, "P009-CORPUS-E004", "source_record_id"), (9, "P009-CORPUS-E001", "schema_version"),
    ]


def test_corpus_codes(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(MANIFEST[:1]))
    (tmp_path / "o.jsonl").write_text("\n".join(json.dumps(x) for x in [BASE, {**BASE, "scope_key": "other"}, {**BASE, "source_family": "nport"}, {**BASE, "report_period": "x"}, {**BASE, "accession": "1"}, {**BASE, "schema_version": "8"}, {**BASE, "cusip": "1"}]))
    sources, rows_, bad = observations.load_corpus(spark, f"file://{tmp_path}/m.json", f"file://{tmp_path}/o.jsonl")
    assert sources.count() == 1 and rows_.count() == 5
    assert sorted((r["row_number"], r["code"]) for r in bad.collect()) == [(2, "P009-CORPUS-E007"), (3, "P009-CORPUS-E005"), (4, "P009-CORPUS-E003"), (5, "P009-CORPUS-E004"), (6, "P009-CORPUS-E002"), (7, "P009-CORPUS-E008")]
    assert observations.load_corpus(spark, f"file://{tmp_path}/m.json")[1] is None


def test_values_are_parsed_and_normalised_once(spark, tmp_path):
    texts = ["", "  a   b ", "x &amp;lt; y", "&amp;amp;nbsp;", "\t", "plain", "&#39;q&#39;"]
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"a": t, "c": None}) for t in texts))
    good, _ = rows.read_rows(spark, f"file://{tmp_path}/a.jsonl")
    assert good._jdf.queryExecution().optimizedPlan().toString().count("from_json(MapType(StringType,StringType,true), raw") <= 1
    both = good.withColumn("given", rows.normalized_values(good.row))
    got = both.select(*(f(m, "b", "c", "a") for f, m in ((rows.first_of, both.row), (rows.first_given, both.given)))).collect()
    assert len(got) == len(texts) and all(r[0] == r[1] for r in got) and {r[0] for r in got} >= {"a b", "plain", "'q'", ""}
