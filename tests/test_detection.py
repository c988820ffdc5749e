"""The detection driver, findings documents and sinks on a small filing."""

import json

import pytest
from pyspark.sql import functions as F

from stratalens.operators import detection, findings
from stratalens.sources import sinks
from tests.test_detectors import ACC, CONTEXT, FACT, context, fact

OTHER = "0000123456-24-000002"


@pytest.fixture(scope="module")
def tables(spark):
    rows = [fact(1, "1000000"), fact(2, "2000000"), fact(3, "5", "c2", unit=None, local="Bare"), fact(4, "7", acc=OTHER)]
    rows += [fact(10 + k, str(k), "c1", local=f"Many{k // 2:03d}", acc="0000123456-24-000003") for k in range(240)]
    return {"facts": spark.createDataFrame(rows, FACT), "contexts": spark.createDataFrame([context(), context("c2"), context(acc=OTHER), context(acc="0000123456-24-000003")], CONTEXT)}


@pytest.fixture(scope="module")
def filings(spark):
    return spark.createDataFrame([(ACC, "123456", "10-K", "2024-02-01"), (OTHER, "123456", "10-Q", "2024-05-01"), ("0000123456-24-000003", "123456", "8-K", "2024-05-02")], "accession string, cik string, form string, filed_date string")


def test_run(spark, tables, filings):
    assert detection.skipped(tables) == {"P002": ["concepts", "relationships"], "P005": ["schema_refs", "declared"], "P009": ["observations"]}
    got = {(r["accession"][-1], r["pattern_id"]): r for r in detection.run(tables, filings).collect()}
    assert set(got) == {("1", "P001"), ("1", "P004"), ("3", "P001")}
    first = got["1", "P001"]
    assert first["finding_id"] == f"F-{ACC}-P001" and first["instance_count_total"] == 1 and first["selection"] == "selected" and first["break_triggers"] == ["BT001", "BT004"]
    assert got["1", "P004"]["selection"] == "suppressed" and got["1", "P004"]["instances"][0]["issue_codes"] == ["missing_unit"]
    many = got["3", "P001"]
    assert (many["instance_count_total"], many["instance_count_included"], many["instances_truncated"]) == (120, 100, True)
    assert [i["instance_id"] for i in many["instances"]] == sorted(i["instance_id"] for i in many["instances"]) and all(i["primary"] for i in many["instances"])
    assert json.loads(first["instances"][0]["data"])["n_facts"] == 2


def test_gate_and_registry(spark, tables, filings):
    basis = spark.createDataFrame([("P001", "SEC EFM 6.5", "rule", "u", "2024-01-01T00:00:00Z", "A" * 64), ("P001", "other", "another", None, None, None), ("P004", "EFM", "rule", None, "soon", "12")], "pattern_id string, source string, citation string, url string, retrieved_at string, sha256 string")
    got = {(r["accession"][-1], r["pattern_id"]): r for r in detection.run(tables, filings, basis).collect()}
    assert got["1", "P001"]["status"] == "detected" and [c["source"] for c in got["1", "P001"]["rule_basis"]] == ["OTHER", "SEC_EFM"]
    assert (got["1", "P004"]["status"], got["1", "P004"]["selection"], got["1", "P004"]["suppression_reason"]) == ("suppressed", "not_eligible", "no valid citation")
    own = detection.Registry([detection.DETECTORS.get("P001")])
    own.register(detection.Detector("X1", "Every fact", "any", ("facts",), lambda t: t["facts"].select("accession", F.col("fact_id").cast("string").alias("instance_id"), F.array(F.lit("x")).alias("issue_codes"), F.lit("{}").alias("data")), alert_eligible=False, forms=("10-Q",)))
    assert own.patterns() == ["P001", "X1"] and own.patterns(alert_eligible=True) == ["P001"]
    rows = detection.run(tables, filings, registry=own, patterns=["X1"]).collect()
    assert [(r["accession"], r["pattern_name"], r["selection"]) for r in rows] == [(OTHER, "Every fact", "not_eligible")]
    own.unregister("X1")
    with pytest.raises(ValueError):
        own.get("X1")
    assert detection.run({}, filings).count() == 0 and detection.run(tables, filings.limit(0)).count() == 0


def test_documents_and_sinks(spark, tables, filings, tmp_path):
    found = detection.run(tables, filings)
    markers = spark.createDataFrame([("M002", OTHER, ACC), ("M001", OTHER, ACC)], "marker string, accession string, prior_accession string")
    docs = {r["accession"]: json.loads(r["document"]) for r in detection.documents(found, filings, "2024-06-01T00:00:00Z", {"engine": "t"}, markers).collect()}
    assert [f["pattern_id"] for f in docs[ACC]["findings"]] == ["P001", "P004"] and docs[OTHER]["findings"] == []
    assert [m["marker_id"] for m in docs[OTHER]["markers"]] == ["M001", "M002"] and docs[ACC]["input"]["form"] == "10-K"
    texts = [r["document"] for r in detection.documents(found, filings, "t").orderBy("accession").collect()]
    assert texts == [r["document"] for r in detection.documents(found.repartition(5), filings.repartition(3), "t").orderBy("accession").collect()]
    sinks.write_documents(detection.documents(found, filings, "t"), f"file://{tmp_path}/docs")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/docs").collect()] == texts
    rows = spark.createDataFrame([(2, ["b", "a"], ("z", None)), (1, [], ("y", "q"))], "rank int, codes array<string>, s struct<b:string,a:string>")
    sinks.write_jsonl(rows, f"file://{tmp_path}/j", ["rank"], one_file=True)
    assert [r[0] for r in spark.read.text(f"{tmp_path}/j").collect()] == ['{"codes":[],"rank":1,"s":{"a":"q","b":"y"}}', '{"codes":["b","a"],"rank":2,"s":{"a":null,"b":"z"}}']
    sinks.write_csv(rows, f"file://{tmp_path}/c", ["rank"], one_file=True)
    assert [r[0] for r in spark.read.text(f"{tmp_path}/c").collect()] == ["rank,codes,s", '1,,"{""b"":""y"",""a"":""q""}"', '2,b;a,"{""b"":""z""}"']


def test_drift_instances(spark, tmp_path):
    from stratalens.operators import ledger
    from tests.test_sources_and_scan import JAN, MAR, load, observation

    items = [{**observation("s", p, 1, **ids), "accession": a} for p, ids, a in ((JAN, {"isin": "XS7712340065", "sedol": "B7RT3K9"}, ACC), (MAR, {"sedol": "B7RT3K9"}, OTHER))]
    obs, _ = load(spark, tmp_path / "o.jsonl", items)
    rows = detection.drift_instances(ledger.drift_events(obs)).collect()
    assert sorted(r["accession"] for r in rows) == [ACC, OTHER] and len({r["instance_id"] for r in rows}) == 1
    data = json.loads(rows[0]["data"])
    assert data["basis_before"]["basis_type"] == "isin" and data["basis_after"]["basis_type"] == "sedol" and len(data["refs"]) == 2
    assert findings.INSTANCE_LIMIT == 100


def test_collapse_scan(spark):
    from stratalens.plans import collapse_scan

    def note(acc, ref, title, symbol):
        return [fact(k, v, ref, numeric=False, unit=None, local=n, acc=acc) for k, (n, v) in enumerate((("Security12bTitle", title), ("TradingSymbol", symbol), ("SecurityExchangeName", "NYSE")))]

    rows = [*note("a", "1", "2.125% Notes due 2030", "X"), *note("a", "2", "3.125% Notes due 2031", "X"), *note("b", "1", "2.125% Notes due 2030", "X"), *note("b", "2", "3.125% Notes due 2031", "X"), *note("b", "3", "4.5% Notes due 2032", "X"), *note("c", "1", "4.5% Notes due 2032", "Y")]
    filings = spark.createDataFrame([("a", "2024-01-01"), ("b", "bad"), ("c", "2023-01-01"), ("d", None), ("e", "2024-02-01")], "accession string, filed_date string")
    failed = spark.createDataFrame([("d", "unreadable")], "accession string, error string")
    facts = spark.createDataFrame(rows, FACT)
    got = collapse_scan.scan(facts, filings, failed=failed).orderBy("rank").collect()
    assert [(r["accession"], r["status"], r["collapse_group_count"], r["max_member_count"]) for r in got] == [("b", "scanned", 1, 3), ("a", "scanned", 1, 2), ("e", "scanned", 0, 0), ("c", "scanned", 0, 0), ("d", "skipped", 0, 0)]
    assert got[0]["registry_status_counts"] == ["snapshot_missing=3"] and len(got[0]["member_titles"]) == 3
    total = collapse_scan.fragility(collapse_scan.scan(facts, filings, failed=failed)).first()
    assert (total["n_filings"], total["n_skipped"], total["n_fragile"], total["n_members"], total["max_member_count"], total["n_titles"]) == (5, 1, 2, 5, 3, 3)
    assert collapse_scan.scan(facts, filings, limit=0).count() == 0


def test_sql_functions(spark):
    from stratalens.functions import sql

    assert "sl_key" in sql.register(spark)
    row = spark.sql(r"select sl_unescaped('a &reg; &#189; &amp;amp;') as a, sl_normalized('  x &nbsp; y ') as b, sl_key('at&amp;t') as c, sl_identifier(' 123-ab ') as d, sl_is_cusip('37833X10Q') as e, sl_is_isin(null) as f, sl_normalized(null) as g").first()
    assert tuple(row) == ("a ® ½ &amp;", "x y", "AT&T", "123AB", True, False, "")
