"""Detectors of single filings on small fixtures."""

from pyspark.sql import functions as F

from stratalens.operators import anchoring, collapse, facts, findings, history, integrity, markers, registry, rules, sets, taxonomy

FACT = "accession string, fact_id long, qname struct<clark:string,namespace:string,local_name:string,prefixed:string>, value string, raw_value string, is_numeric boolean, is_nil boolean, decimals string, precision string, concept_type string, period_type string, context_ref string, unit struct<id:string,measures:array<string>,denominators:array<string>>"
CONTEXT = "accession string, context_ref string, entity_scheme string, entity_identifier string, period_kind string, instant string, start string, `end` string, dims array<struct<dim:string,kind:string,member:string,typed_value:string>>"
ACC = "0000123456-24-000001"
USD = ("usd", ["{iso4217}USD"], None)


def fact(i, value, context="c1", decimals=None, unit=USD, numeric=True, local="Revenue", nil=False, precision=None, kind=None, acc=ACC):
    return (acc, i, (f"{{urn:g}}{local}", "urn:g", local, None), value, value, numeric, nil, decimals, precision, kind, None, context, unit)


def context(ref="c1", instant="2023-12-31", entity="0000123456", kind="instant", acc=ACC, dims=None):
    return (acc, ref, "http://www.sec.gov/CIK", entity, kind, instant, None, None, dims or [])


def conflicts(spark, rows, mode="rounded", contexts=None):
    return facts.detect(spark.createDataFrame(rows, FACT), spark.createDataFrame(contexts or [context(), context("c2", "2022-12-31")], CONTEXT), mode).collect()


def test_duplicate_facts(spark):
    assert conflicts(spark, [fact(1, "1000000"), fact(2, "1000000.0")]) == []
    (found,) = conflicts(spark, [fact(1, "1000000"), fact(2, "2000000")])
    assert found["n_facts"] == 2 and found["issue_codes"] == ["duplicate_fact", "value_conflict"] and len(found["facts"]) == 2
    close = [fact(1, "14176000", decimals="-3"), fact(2, "14200000", decimals="-5")]
    assert conflicts(spark, close) == [] and len(conflicts(spark, close, "strict")) == 1
    assert conflicts(spark, [fact(1, "1"), fact(2, "2", context="c2")]) == []
    assert conflicts(spark, [fact(1, "1"), fact(2, "2", unit=("eur", ["{iso4217}EUR"], None))]) == []
    assert len(conflicts(spark, [fact(1, "1"), fact(2, None, nil=True)])) == 1
    assert len(conflicts(spark, [fact(1, "a b", numeric=False, unit=None), fact(2, "a c", numeric=False, unit=None)])) == 1
    assert conflicts(spark, [fact(1, "a b", numeric=False, unit=None), fact(2, " a  b ", numeric=False, unit=None)]) == []
    assert conflicts(spark, [fact(1, "1"), fact(2, "2")], contexts=[context(kind="other")]) == []


def test_duplicate_contexts_and_dimensions(spark):
    dim = [("d", "explicit", "m", None)]
    contexts = spark.createDataFrame([context("a"), context("b"), context("c", dims=dim)], CONTEXT)
    (dup,) = facts.duplicate_contexts(contexts).collect()
    assert dup["contexts"] == ["a", "b"]
    (odd,) = facts.inconsistent_dimensions(spark.createDataFrame([fact(1, "1", "a"), fact(2, "1", "c")], FACT), contexts).collect()
    assert odd["n_dimension_sets"] == 2


def test_fact_rules(spark):
    def codes(**k):
        rows = rules.detect(spark.createDataFrame([fact(1, "1", **k)], FACT)).collect()
        return sorted(r["issue_code"] for r in rows)

    assert codes(decimals="-6") == codes(decimals="INF") == []
    assert codes(decimals="x") == ["invalid_decimals"]
    assert codes(unit=None) == ["missing_unit"]
    assert codes(kind="xbrli:monetaryItemType", unit=("sh", ["{xbrli}shares"], None)) == ["unit_incompatible"]
    assert codes(numeric=False, kind="stringItemType") == ["non_numeric_with_unit"]
    assert codes(precision="21") == codes(precision="INF") == ["invalid_precision"]
    assert codes(decimals="2", precision="3") == ["decimals_precision_conflict"]
    assert codes(kind="pureItemType", unit=("p", ["{xbrli}pure"], None)) == []
    assert codes(unit=None, context=None) == []


def test_anchoring(spark):
    ext, std = "http://company.com/2023", "http://fasb.org/us-gaap/2023"
    concepts = spark.createDataFrame(
        [(ACC, f"{{{ext}}}A", ext, "A", "t1", "instant", False), (ACC, f"{{{ext}}}B", ext, "B", "t1", "instant", False), (ACC, f"{{{ext}}}C", ext, "C", "t1", "instant", False), (ACC, f"{{{std}}}S", std, "S", "t2", "duration", True)],
        "accession string, clark string, namespace string, local_name string, type string, period_type string, abstract boolean",
    )
    arcs = spark.createDataFrame([(ACC, anchoring.ARC_ROLES[0], f"{{{ext}}}B", f"{{{std}}}S"), (ACC, anchoring.ARC_ROLES[1], f"{{{ext}}}C", f"{{{ext}}}A"), (ACC, "other", f"{{{ext}}}A", f"{{{std}}}S")], "accession string, arcrole string, from_clark string, to_clark string")
    rows = [(ACC, i, (f"{{{ext}}}{c}", ext, c, None), str(i), None, True, False, None, None, None, None, f"c{i}", None) for i, c in enumerate("AAAABC")]
    got = {r["clark"][-1]: r for r in anchoring.detect(concepts, arcs, spark.createDataFrame(rows, FACT)).collect()}
    assert {k: r["issue_codes"] for k, r in got.items()} == {"A": ["unanchored"], "B": ["anchor_target_abstract", "period_type_mismatch", "type_mismatch"], "C": ["anchor_to_extension"]}
    assert [e["context_ref"] for e in got["A"]["examples"]] == ["c0", "c1", "c2"]


def test_taxonomy(spark):
    pair = "accession string, namespace string"
    refs = spark.createDataFrame([(ACC, "x.xsd"), (ACC, " ")], "accession string, href string")
    used = spark.createDataFrame([(ACC, "urn:ext"), (ACC, "urn:undeclared"), (ACC, "http://g/2023-01-31"), (ACC, "http://g/2024-01-31"), (ACC, "http://g/2024"), ("b", "urn:z")], pair)
    declared = spark.createDataFrame([(ACC, "urn:ext"), (ACC, "urn:unused"), (ACC, "http://g/2023-01-31"), (ACC, "http://g/2024-01-31"), (ACC, "http://g/2024")], pair)
    got = {(r["accession"], r["issue_code"]): r["details"] for r in taxonomy.detect(refs, declared, used).collect()}
    assert got == {(ACC, "namespace_schema_ref_mismatch"): ["urn:undeclared"], (ACC, "mixed_taxonomy_versions"): ["http://g=2023-01-31,2024-01-31"]}
    # facts of one version, schemas that declare two: not mixed
    one = spark.createDataFrame([(ACC, "http://g/2024-01-31")], pair)
    assert taxonomy.detect(refs, declared, one).count() == 0
    packages = spark.createDataFrame([("http://g", "short"), ("http://g/2024", "long"), ("http://other", "x")], "package_namespace string, package string")
    resolved = {r["namespace"]: r["package"] for r in taxonomy.resolve_packages(used.select("namespace"), packages).collect()}
    assert resolved == {"urn:ext": None, "urn:undeclared": None, "urn:z": None, "http://g/2023-01-31": "short", "http://g/2024-01-31": "long", "http://g/2024": "long"}
    filings, required = spark.createDataFrame([("a", "S-1")], "accession string, form string"), spark.createDataFrame([("S-1", "fee"), ("S-1", "total")], "form string, name string")
    assert [r["name"] for r in taxonomy.missing_content(filings, required, spark.createDataFrame([("a", "fee")], "accession string, name string")).collect()] == ["total"]


def security(spark):
    rows = []
    for i, (ref, title) in enumerate([("stock", "Common stock, $0.00000625 par value per share"), ("note-2028", "3.125% Notes due 2028"), ("note-2033", "2.625% Notes due 2033"), ("odd", "Depositary things")]):
        for local, value in (("Security12bTitle", title), ("TradingSymbol", "msft"), ("SecurityExchangeName", "NASDAQ Global Select Market")):
            rows.append(fact(i, value, ref, numeric=False, unit=None, local=local))
    return spark.createDataFrame(rows, FACT)


def test_collapse(spark):
    (group,) = collapse.detect(security(spark)).collect()
    assert group["weak_key"] == "P008:weak|ticker=MSFT|exchange=NASDAQ" and group["n_members"] == 3
    assert sorted(m["normalized_title"] for m in group["members"]) == ["COMMON STOCK PAR 0.00000625", "NOTE 2.625% DUE 2033", "NOTE 3.125% DUE 2028"]
    assert group["issue_codes"] == ["registry_snapshot_missing", "unsupported_security_title", "weak_identity_collision"]


def test_collapse_caps_are_told(spark):
    """More contexts, groups and members than the limits: what is left out has a diagnostic, and no limit leaves nothing out."""
    rows = []
    for g in range(4):
        for m in range(5 if g == 0 else 2):
            for local, value in (("Security12bTitle", f"{m + 1}.125% Notes due 20{30 + m}"), ("TradingSymbol", f"T{g}"), ("SecurityExchangeName", "NYSE")):
                rows.append(fact(len(rows), value, f"c{g}-{m}", numeric=False, unit=None, local=local))
    facts = spark.createDataFrame(rows, FACT)
    all_ = collapse.detect(facts, max_contexts=None, max_groups=None, max_members=None).collect()
    assert sorted(r["n_members"] for r in all_) == [2, 2, 2, 5] and not any(r["members_truncated"] for r in all_)
    limits = {"max_contexts": 9, "max_groups": 2, "max_members": 3}
    some = collapse.detect(facts, **limits).collect()
    assert sorted((r["n_members"], len(r["members"]), r["members_truncated"]) for r in some) == [(2, 2, False), (5, 3, True)]
    told = sorted((r["issue_code"], r["n_total"], r["n_kept"]) for r in collapse.diagnostics(facts, **limits).collect())
    assert told == [("detector_context_cap_exceeded", 11, 9), ("detector_group_cap_exceeded", 3, 2), ("detector_member_cap_exceeded", 5, 3)]
    assert collapse.diagnostics(facts).count() == 0


REGISTRY = "figi string, composite_figi string, share_class_figi string, cusip string, isin string, sedol string, other_identifiers array<struct<id_type:string,value:string>>, canonical_signature string, normalized_title string, ticker string, exchange string, row_id string"


def registry_rows(spark):
    row = lambda figi, cusip, row_id, **k: (figi, "", "", cusip, "", "", k.get("others"), k.get("sig", ""), k.get("title", ""), k.get("ticker", ""), "", row_id)
    return spark.createDataFrame([row("BBG000000001", "123456AB7", "r1"), row("BBG000000002", "999999AB9", "r2", title="T"), row("BBG000000003", "222222AB2", "r3"), row("BBG000000004", "222222AB2", "r4", others=[("lei", "x-1")])], REGISTRY)


def test_lookups(spark):
    table = registry.lookup_table(registry_rows(spark))
    keys = spark.createDataFrame([("a", 0, "figi", "ZZZ"), ("a", 1, "cusip", "123456AB7"), ("b", 0, "cusip", "222222AB2"), ("c", 0, "cusip", "1"), ("d", 0, "other:LEI", "X-1")], "id string, pos int, id_type string, id_value string")
    got = {r["id"]: r for r in registry.by_precedence(keys, table, ["id"]).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a": "resolved", "b": "ambiguous", "c": "missing", "d": "resolved"}
    assert got["a"]["id_type"] == "cusip" and [c["figi"] for c in got["b"]["candidates"]] == ["BBG000000003", "BBG000000004"]
    instruments = spark.createDataFrame([("i", "123456AB7", "", "s", "q", "t", "e"), ("j", "", "", "s", "T", "t", "e"), ("k", "", "", "s", "q", "t", "e")], "id string, cusip string, isin string, canonical_signature string, normalized_title string, ticker string, exchange string")
    tiers = {r["id"]: (r["tier"], r["status"]) for r in registry.instrument_lookup(instruments, registry_rows(spark), ["id"]).collect()}
    assert tiers == {"i": (1, "resolved"), "j": (3, "resolved"), "k": (None, "missing")}
    # equal registry rows count each, a row that matches by both ids once; a row without a normalised title answers to its own
    one = registry_rows(spark).where("row_id = 'r1'").withColumns({"isin": F.lit("US1234567890"), "security_title": F.lit(" Plain &amp; simple ")})
    both = spark.createDataFrame([("i", "123456AB7", "US1234567890", "s", "q", "t", "e"), ("l", "", "", "s", "PLAIN & SIMPLE", "t", "e")], instruments.schema)
    states = lambda table: {r["id"]: (r["tier"], r["status"]) for r in registry.instrument_lookup(both, table, ["id"]).collect()}
    assert states(one) == {"i": (1, "resolved"), "l": (3, "resolved")}
    assert states(one.union(one)) == {"i": (1, "duplicate_identical"), "l": (3, "duplicate_identical")}
    odd = spark.createDataFrame([("a", 0, "", "1"), ("a", 1, "cusip", "1"), ("b", 0, "", "1"), ("b", 1, "cusip", "123456AB7")], keys.schema)
    assert {r["id"]: r["status"] for r in registry.by_precedence(odd, table, ["id"]).collect()} == {"a": "unsupported_id_type", "b": "resolved"}
    assert [r["status"] for r in registry.invalid_snapshot(odd, ["id"], "unreadable").collect()] == ["snapshot_invalid"] * 2


def test_markers(spark):
    acc = lambda k: f"0000123456-24-{k:06d}"
    names = lambda p, a, b: [f"{p}{i:03d}" for i in range(a, b)]
    rows = [
        ("1", acc(1), ["a.xsd", " "], names("e", 0, 30), names("e", 0, 5), 100, names("d", 0, 30), names("s", 0, 30)),
        ("1", acc(2), ["b.xsd"], names("e", 10, 40), names("e", 10, 30), 10, names("d", 0, 5), names("s", 0, 5)),
        ("1", "bad", ["z"], [], [], 0, [], []),
        ("2", acc(1), ["a"], names("e", 0, 3), [], 1, [], []),
        ("2", acc(2), ["a"], names("e", 0, 3), [], 1, [], []),
    ]
    df = spark.createDataFrame(rows, "cik string, accession string, schema_refs array<string>, extension_qnames array<string>, anchored_qnames array<string>, context_count int, dimension_signatures array<string>, duplicate_signature_ids array<string>")
    got = {m: f(df).collect() for m, f in markers.MARKERS.items()}
    assert {m: [(r["cik"], r["prior_accession"]) for r in rows] for m, rows in got.items()} == {m: [("1", acc(1))] for m in markers.MARKERS}
    assert got["M001"][0]["added"] == ["b.xsd"] and got["M002"][0]["new_examples"] == names("e", 30, 40)
    assert got["M003"][0]["coverage"] == 0.666667 and got["M005"][0]["drop_ratio"] == 0.833333
    assert markers.thresholds_table(spark).count() == 19 - 0


def test_history(spark):
    rows = [("1", f"0000000001-{y}-{k:06d}", form, f"20{y}-{m:02d}-15", f"20{y}-{m - 1:02d}-28") for k, (y, m, form) in enumerate([(22, 5, "10-Q"), (22, 8, "10-Q/A"), (23, 2, "10-K"), (23, 5, "10-Q"), (19, 5, "10-Q")])]
    filings = spark.createDataFrame(rows, "cik string, accession string, form string, filed_date string, period_end string")
    got = {r["accession"]: (r["comparator"], r["rule"]) for r in history.comparator(filings).collect()}
    assert got[rows[3][1]] == (rows[0][1], "same_quarter") and got[rows[1][1]] == (rows[0][1], "previous_period") and rows[2][1] not in got
    # annual forms take no quarter; event-driven ones have no comparator
    more = [("2", f"0000000002-{y}-{k:06d}", form, f"20{y}-{m:02d}-15", f"20{y}-{m - 1:02d}-28") for k, (y, m, form) in enumerate([(22, 3, "10-K"), (22, 9, "10-K"), (23, 3, "10-K"), (22, 4, "8-K"), (23, 4, "8-K"), (22, 4, "6-K"), (23, 4, "6-K/A")])]
    got = {r["accession"]: (r["comparator"], r["rule"]) for r in history.comparator(spark.createDataFrame(more, filings.schema)).collect()}
    assert got == {more[1][1]: (more[0][1], "previous_period"), more[2][1]: (more[1][1], "previous_period")}
    entries = spark.createDataFrame([("1", f"0000000001-22-{k:06d}") for k in range(8)] + [("1", "junk")], "cik string, accession string")
    current = spark.createDataFrame([("1", "0000000001-22-000007", "10-K"), ("1", "0000000001-22-000003", "8-K")], "cik string, accession string, form string")
    picked = {r["accession"][-1]: (r["comparator"], [h[-1] for h in r["history"]]) for r in history.select_history(entries, current).collect()}
    assert picked == {"7": ("0000000001-22-000006", list("23456")), "3": (None, list("012"))}


def test_findings(spark):
    good = ("EDGAR", "2024-01-01T00:00:00Z", "a" * 64, "u", None)
    rows = [("f1", "P009", "detected", [good]), ("f2", "P001", "detected", [("EDGAR", "2024", "a" * 64, "u", None)]), ("f3", "P004", "detected", [])]
    df = spark.createDataFrame(rows, "finding_id string, pattern_id string, status string, citations array<struct<source:string,retrieved_at:string,sha256:string,url:string,title:string>>").withColumn("accession", F.lit("a"))
    gated = findings.gate(df)
    assert {r["finding_id"]: r["status"] for r in gated.collect()} == {"f1": "detected", "f2": "suppressed", "f3": "suppressed"}
    ranked = findings.ranked(gated, ["accession"], eligible=F.col("status") == "detected").collect()
    assert {r["finding_id"]: r["selection"] for r in ranked} == {"f1": "selected", "f2": "not_eligible", "f3": "not_eligible"}
    assert findings.winner(df, ["accession"]).first()["finding_id"] == "f2"
    many = spark.range(130).select(F.lit("a").alias("accession"), F.lpad(F.col("id").cast("string"), 4, "0").alias("instance_id"))
    doc = findings.documents(many, ["accession"], F.lit(1)).first()
    assert (doc["instance_count_total"], doc["instance_count_included"], doc["instances_truncated"], doc["instances"][0]["instance_id"]) == (130, 100, True, "0000")
    assert [r[0] for r in spark.createDataFrame([("XBRL_SPEC",), ("sec efm 6.5",), ("none",), ("XBRL Specification 2.1",), ("Arelle validation",), ("dqcrt rule",), (None,)], "s string").select(findings.citation_source(F.col("s"))).collect()] == ["XBRL_SPEC", "SEC_EFM", "OTHER", "XBRL_SPEC", "ARELLE_VALIDATION", "DQCRT", "OTHER"]
    cites = spark.createDataFrame([("EFM 6", None, "T", "", "2024", "A" * 64, ""), ("x", "c", None, "u", None, "12", "n"), ("x", None, None, "u", None, "12", "n")], "source string, citation string, title string, url string, retrieved_at string, sha256 string, notes string")
    assert [r[0] and tuple(r[0]) for r in cites.select(findings.normal_citation(F.struct("*"))).collect()] == [("SEC_EFM", "T", None, "2024", "a" * 64, None), ("OTHER", "c", "u", None, None, "n"), None]


def test_integrity(spark, tmp_path):
    import hashlib

    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.txt").write_text("one")
    (tmp_path / "y.txt").write_text("two")
    files = integrity.scan_files(spark, f"file://{tmp_path}")
    rows = {r["path"]: r["sha256"] for r in files.collect()}
    assert rows == {"a/x.txt": hashlib.sha256(b"one").hexdigest(), "y.txt": hashlib.sha256(b"two").hexdigest()}
    lines = "".join(f"{p}\t{s}\n" for p, s in sorted(rows.items()))
    assert integrity.pack_hash(files).first()["pack_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
    manifest = files.union(spark.createDataFrame([("gone", "x", 1)], "path string, sha256 string, bytes long"))
    manifest = manifest.withColumn("sha256", F.when(F.col("path") == "y.txt", "bad").otherwise(F.col("sha256")))
    assert {r["path"]: r["status"] for r in integrity.verify(manifest, files).collect()} == {"a/x.txt": "ok", "y.txt": "sha_mismatch", "gone": "missing"}
    own = spark.createDataFrame([("a.htm", None, 5), ("b.zip", None, 5), ("c.xsd", "https://other.org/c.xsd", 5), ("d.htm", "https://www.sec.gov/d.htm", 20 << 20)], "path string, source_url string, bytes long")
    kept, named = integrity.split_redistributable(own, ("www.sec.gov",))
    assert [r["path"] for r in kept.collect()] == ["a.htm"] and named.count() == 3


def test_sets(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert sorted(r[:] for r in sets.changes(a, b, ["k"]).collect()) == [(1, "removed"), (3, "added")]
    assert [r["k"] for r in sets.common(a, b, ["k"]).collect()] == [2]
    rows = spark.createDataFrame([("12-3", None), ("123", "x")], "cusip string, isin string")
    assert sorted(r[:] for r in sets.seeds(rows, ["cusip", "isin"]).collect()) == [("cusip", "123"), ("isin", "X")]


def test_duplicates_count_no_distinct_values(spark):
    """A count of distinct texts groups by signature and text first, in one more exchange."""
    rows = spark.createDataFrame([fact(1, "5"), fact(2, "6"), fact(3, None)], FACT)
    found = facts.detect(rows, spark.createDataFrame([context()], CONTEXT), "strict")
    assert "distinct" not in found._jdf.queryExecution().analyzed().toString()
    assert [r["n_facts"] for r in found.collect()] == [3]
