"""Readers, the flagship scan on a small corpus, and streams."""

import json

from pyspark.sql import functions as F

from stratalens.operators import ledger
from stratalens.plans import scan
from stratalens.sources import documents, observations, registry_files, rows

JAN, FEB = "2024-01-31", "2024-02-29"


def observation(scope, period, n, **ids):
    return {"schema_version": "1.0", "source_family": "jsonl", "source_adapter": "a", "source_scope": {"scope_key": scope}, "source_record_id": f"{scope}-{period}", "report_period": period, "filed_date": period, "observation_ordinal": n, "title_or_description": f"Position {scope}", "value": "5000000", **ids}


MAR, APR = "2024-03-31", "2024-04-30"
#: A chain over two scopes that only the registry ties; one of reported keys alone; an identifier that goes; two registry rows for one key; a steady one.
CORPUS = [
    observation("ledger-a", JAN, 1, cusip="37833X10Q"), observation("ledger-b", MAR, 1, figi="BBG00KESTREL"),
    observation("desk-1", JAN, 1, isin="XS7712340065", sedol="B7RT3K9"), observation("desk-1", APR, 1, sedol="B7RT3K9"),
    observation("desk-2", JAN, 1, ticker="QUILL", cusip="55503W20Z"), observation("desk-2", FEB, 1, ticker="QUILL"),
    observation("desk-3", MAR, 1, isin="DE000HERON12"),
    observation("desk-4", JAN, 1, sedol="C0FFEE7"), observation("desk-4", FEB, 1, sedol="C0FFEE7"),
]
REGISTRY = {"snapshot_id": "kept", "rows": [{"figi": "BBG00KESTREL", "cusip": "37833X10Q"}, {"figi": "BBG00HERON01", "isin": "DE000HERON12"}, {"figi": "BBG00HERON02", "isin": "DE000HERON12"}, {"figi": "BBG00STEADY1", "sedol": "C0FFEE7"}]}


def load(spark, path, items):
    path.write_text("\n".join(json.dumps(x) for x in items))
    return observations.load_observations(spark, f"file://{path}")


def test_scan_with_registry(spark, tmp_path):
    obs, bad = load(spark, tmp_path / "o.jsonl", CORPUS)
    (tmp_path / "r.json").write_text(json.dumps(REGISTRY))
    registry = registry_files.load_snapshot(spark, f"file://{tmp_path}/r.json")
    assert bad.count() == 0 and registry.count() == 4
    ranked = scan.scan(obs, registry)
    got = ranked.orderBy("rank").collect()
    found = {r["source_scope_key"]: r for r in got}
    # the steady scope has a resolved registry row and nothing else to tell
    assert set(found) == {"ledger-a", "desk-1", "desk-2", "desk-3"}
    assert found["ledger-a"]["issue_codes"] == ["identifier_basis_transition", "registry_bridge_available"] and found["ledger-a"]["continuity_class"] == "registry_bridged"
    assert found["ledger-a"]["report_periods"] == [JAN, MAR] and found["ledger-a"]["score"] == 1000 + 20 + 5
    assert found["desk-1"]["issue_codes"] == ["identifier_basis_transition"] and found["desk-1"]["continuity_class"] == "proven_transition"
    assert found["desk-2"]["issue_codes"] == ["registry_bridge_missing", "strong_identifier_removed", "weak_continuity_only"]
    assert found["desk-3"]["continuity_class"] == "registry_ambiguous" and found["desk-3"]["registry_status"] == "ambiguous"
    assert [r["rank"] for r in got] == [1, 2, 3, 4] and [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True)
    again = scan.scan(obs.orderBy(F.rand(3)).repartition(7), registry).orderBy("rank").collect()
    assert [r["candidate_id"] for r in again] == [r["candidate_id"] for r in got]
    top = ranked.where("source_scope_key = 'ledger-a'")
    assert [r[:] for r in scan.seed_rows(top).select("id_type", "value").collect()] == [("cusip", "37833X10Q"), ("figi", "BBG00KESTREL")]
    sources = spark.createDataFrame([("ledger-a", f"ledger-a-{JAN}", JAN, "a.json")], "scope_key string, source_id string, filed_date string, local_path string")
    assert [s["local_path"] for s in scan.pack_inputs(top, sources).first()["sources"]] == ["a.json"]


def test_scan_without_registry(spark, tmp_path):
    obs, _ = load(spark, tmp_path / "o.jsonl", CORPUS)
    got = {(r["source_scope_key"], tuple(r["issue_codes"])) for r in scan.scan(obs).collect()}
    assert got == {("desk-1", ("identifier_basis_transition",)), ("desk-2", ("strong_identifier_removed", "weak_continuity_only"))}


def test_caps(spark, tmp_path):
    obs, _ = load(spark, tmp_path / "o.jsonl", [observation("s", JAN, k, ticker="T") for k in range(1, 6)])
    kept, omitted = ledger.build_ledger(obs, caps=ledger.Caps(observations_per_scope=3))
    assert kept.count() == 3 and [r["code"] for r in omitted.collect()] == ["P009-LEDGER-E001"] * 2
    mixed = [observation(f"s{k}", p, 1, ticker=f"T{k}") for k in range(3) for p in (JAN, FEB)]
    obs, _ = load(spark, tmp_path / "p.jsonl", mixed)
    events, told = ledger.drift(obs, caps=ledger.Caps(events_per_code=1))
    assert events.count() == 1 and sorted(r["code"] for r in told.collect()) == ["P009-LEDGER-E002"] * 2


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Scope_Key,cusip,value\nx,"1,2","say ""hi"""\ny,3,4\nz,1,2,3\n')
    good, bad = rows.read_rows(spark, f"file://{tmp_path}/a.csv")
    # names as they are written; cells beyond the header are left out
    assert {r["row_number"]: r["row"] for r in good.collect()} == {2: {"Scope_Key": "x", "cusip": "1,2", "value": 'say "hi"'}, 3: {"Scope_Key": "y", "cusip": "3", "value": "4"}, 4: {"Scope_Key": "z", "cusip": "1", "value": "2"}}
    assert bad.count() == 0
    (tmp_path / "b.json").write_text(json.dumps([{"a": 1}, {"a": {"b": 2}}]))
    good, _ = rows.read_rows(spark, f"file://{tmp_path}/b.json")
    assert {r["row_number"]: r["row"]["a"] for r in good.collect()} == {1: "1", 2: '{"b":2}'}
    (tmp_path / "c.jsonl").write_text('\n{"a": "x"}\nnot json\n')
    good, bad = rows.read_rows(spark, f"file://{tmp_path}/c.jsonl")
    assert [r["row_number"] for r in good.collect()] == [2] and [r["row_number"] for r in bad.collect()] == [3]


def test_observation_diagnostics(spark, tmp_path):
    items = [observation("s", JAN, 1, cusip="12"), observation("", JAN, 1), {**observation("s", JAN, 1), "source_family": "other"}, {**observation("s", "soon", 1), "schema_version": "1.0"}, {**observation("s", JAN, 0), "source_scope": "plain"}]
    obs, bad = load(spark, tmp_path / "o.jsonl", items)
    assert sorted((r["row_number"], r["code"]) for r in bad.collect()) == [(1, "P009-OBS-E006"), (2, "P009-OBS-E003"), (3, "P009-OBS-E002"), (4, "P009-OBS-E007"), (4, "P009-OBS-E007")]
    got = {r["row_number"]: r for r in obs.collect()}
    assert set(got) == {1, 4, 5} and got[1]["ids"]["cusip"] == "" and got[5]["scope_key"] == "plain" and got[5]["ordinal"] == 0
    (tmp_path / "m.csv").write_text(f"source_family,scope_key,source_record_id,filed_date,local_path\ncsv,s,s-{JAN},bad,x\ncsv,,r,,y\n")
    sources, found = observations.load_manifest(spark, f"file://{tmp_path}/m.csv")
    assert [r["filed_date"] for r in sources.collect()] == [""] and sorted(r["code"] for r in found.collect()) == ["P009-CORPUS-E002", "P009-CORPUS-E003"]  # a scope is missing, a date has another form
    assert sorted(r["row_number"] for r in observations.unmatched(obs, sources).collect()) == [4, 5]


def test_registry_files(spark, tmp_path):
    (tmp_path / "cusip-to-figi.json").write_text(json.dumps([{"input": "123456AB7", "output": "BBG000000001"}, {"input": "123456AB7", "output": "BBG000000002"}]))
    (tmp_path / "cusip-to-ticker.json").write_text(json.dumps([{"input": "123456AB7", "output": "AAA"}, {"input": "123456AB7", "output": "BBB"}]))
    (tmp_path / "overlay.json").write_text(json.dumps({"rows": [{"cusip": "123456AB7", "name": "old"}, {"cusip": "123456AB7", "name": "new"}]}))
    snapshot = registry_files.snapshot_from_mappings(registry_files.load_mappings(spark, f"file://{tmp_path}"), registry_files.load_overlay(spark, f"file://{tmp_path}/overlay.json"), "cusip")
    assert sorted((r["figi"], r["ticker"], r["name"], r["cusip"]) for r in snapshot.collect()) == [("BBG000000001", "AAA", "new", "123456AB7"), ("BBG000000002", "AAA", "new", "123456AB7")]
    body = json.dumps({"data": {"content": json.dumps({"filings": [{"Accession": "000012345624000001", "CIK": "12", "Filing_Date": "20240131", "Form": "10-K"}, {"cik": "1"}]})}})
    good, rejected = registry_files.normalize_response(spark.createDataFrame([(body,)], "body string"))
    assert [tuple(r)[:4] for r in good.collect()] == [("0000123456-24-000001", "0000000012", "2024-01-31", "10-K")] and rejected.count() == 1
    listing = json.dumps({"directory": {"item": [{"name": n, "size": s} for n, s in (("R1.htm", "900"), ("co-2024.htm", "500"), ("big.htm", "800"), ("co-2024.xsd", "5"), ("co-2024_cal.xml", ""))]}})
    items = registry_files.index_items(spark.createDataFrame([("a", listing)], "accession string, body string"))
    assert registry_files.primary_document(items).first()["primary"] == "co-2024.htm"
    assert [r["name"] for r in registry_files.extension_artifacts(items).collect()] == ["co-2024.xsd", "co-2024_cal.xml"]


PAGE = """<html><link:schemaRef xlink:href="co.xsd"/><ix:nonNumeric name="dei:DocumentType" contextRef='c1'>10-<b>K</b></ix:nonNumeric>
<ix:nonFraction name="g:Rev" contextRef="c2" unitRef="usd" decimals="-3">1 000</ix:nonFraction></html>"""


def test_documents(spark):
    pages = spark.createDataFrame([("a", PAGE)], "accession string, html string")
    found = documents.inline_facts(pages, ["accession"], "html")
    assert [(r["name"], r["context_ref"], r["value"]) for r in found.orderBy("pos").collect()] == [("dei:DocumentType", "c1", "10-K"), ("g:Rev", "c2", "1 000")]
    assert [r[:] for r in documents.metadata(found, ["accession"], {"form": ["Other", "DocumentType"]}).select("field", "value").collect()] == [("form", "10-K")]
    assert [r["href"] for r in documents.schema_refs(pages, ["accession"], "html").collect()] == ["co.xsd"] == [r["href"] for r in documents.first_schema_ref(pages, ["accession"], "html").collect()]
    schema = lambda name, to: (name, f'<xs:schema targetNamespace="urn:{name}"><xs:import namespace="urn:x"/><xs:include schemaLocation="{to}"/></xs:schema>')
    schemas = documents.declared_namespaces(spark.createDataFrame([schema("a", "b"), schema("b", "c"), schema("c", "a")], "path string, content string"))
    assert {r["target_namespace"] for r in schemas.collect()} == {"urn:a", "urn:b", "urn:c"}
    assert documents.closure(schemas, spark.createDataFrame([("a", "a")], "root string, path string")).count() == 3


def test_submissions(spark):
    text = "<SUBMISSION>\n<ACCESSION-NUMBER>1-2-3\n<DOCUMENT>\n<TYPE>10-K\n<SEQUENCE>1\n<FILENAME>a.htm\n<TEXT>\none\n<TYPE>inside\n</TEXT>\n</DOCUMENT>\n<DOCUMENT>\n<FILENAME>../b\n<TEXT>\n</TEXT>\n</DOCUMENT>\n<DOCUMENT>\n<FILENAME>c\n<TEXT>\n"
    rows_ = documents.parse_submissions(spark.createDataFrame([("p", text)], "path string, content string")).collect()
    assert [(r["filename"], r["sequence"], r["text"], r["error"]) for r in rows_] == [("a.htm", 1, "one\n<TYPE>inside", ""), ("../b", None, "", "unsafe_name"), ("c", None, "", "unterminated_document")]
    documents.register_udtf(spark)
    spark.createDataFrame([(text,)], "content string").createOrReplaceTempView("submissions")
    assert spark.sql("select d.filename from submissions, lateral parse_submission(content) d").count() == 3


def test_streams(spark, tmp_path):
    from stratalens.streaming import churn

    df = spark.createDataFrame([("s", JAN, "cusip=1"), ("s", FEB, "figi=2"), ("t", JAN, "x")], "scope_key string, report_period string, basis string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = churn.basis_changes(stream).writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert [r[:] for r in spark.sql("select * from changes").collect()] == [("s", FEB, "cusip=1", "figi=2")]
    events = spark.range(10).select(F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,id,0,0)").alias("ts"), F.lit("a").alias("event_type"), F.col("id").alias("user_id"))
    assert churn.daily_counts(events).first()["n"] == 10
