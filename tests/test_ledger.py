"""Drift events and candidates over random corpora with a hot weak key, against a version that holds every group in memory."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from stratalens.operators import ledger
from stratalens.plans import scan

OBSERVATION = """observation_id string, scope_key string, source_family string, source_adapter string, source_id string, accession string, source_record_id string, report_period string, filed_date string,
    ordinal bigint, paths array<string>, ids struct<figi:string,cusip:string,isin:string,sedol:string,ticker:string,others:array<struct<id_type:string,value:string>>>, weak array<struct<key:string,value:string>>"""
REGISTRY = {("cusip", "C1"): ["G1"], ("isin", "I2"): ["G2", "G2b"], ("figi", "F3"): ["G3"]}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def token(v):
    return json.dumps(v)[1:-1].replace("|", "%7C").replace("=", "%3D")


def fields(d):
    return ";".join(f"{token(k)}={token(v)}" for k, v in sorted(d.items()) if v)


def corpus(n=260):
    rnd = random.Random(11)
    rows = []
    for i in range(n):
        ids = {k: "" for k in ("figi", "cusip", "isin", "sedol", "ticker")}
        for kind in ("figi", "cusip", "isin", "sedol", "ticker"):
            if rnd.random() < 0.25:
                ids[kind] = f"{kind[0].upper()}{rnd.randrange(40)}"
        others = [("LEI", f"L{rnd.randrange(9)}")] if rnd.random() < 0.1 else []
        weak = {"title_or_description": "hot" if i % 3 == 0 else f"t{rnd.randrange(30)}", "value": rnd.choice(["", "5,000,000", "n/a", "12345678901"])}
        if rnd.random() < 0.1:
            weak = {}
        period, filed = rnd.choice(["2024-03-31", "2024-06-30", "", "2023-12-31"]), rnd.choice(["", "2024-07-01", "2024-01-05"])
        rows.append((sha(str(i)), f"s{rnd.randrange(4)}", "csv", "a", f"src{rnd.randrange(25)}", rnd.choice(["", f"acc{rnd.randrange(4)}"]), "r", period, filed, rnd.randrange(5), [f"p{rnd.randrange(3)}"], (*ids.values(), others), [(k, v) for k, v in weak.items() if v]))
    return rows + rows[:6]  # repeated rows


def brute(rows):
    """Events and candidates of rows without a registry."""
    refs = []
    for r in rows:
        figi, cusip, isin, sedol, ticker, others = r[11]
        keys = sorted({(k, v, "reported") for k, v in zip(("figi", "cusip", "isin", "sedol"), (figi, cusip, isin, sedol)) if v} | {("other_typed_identifier", f"{t}:{v}", "reported") for t, v in others})
        basis = next(((k, v) for k, v in (("figi", figi), ("cusip", cusip), ("isin", isin), ("sedol", sedol)) if v), None) or (("other_typed_identifier", ":".join(others[0])) if others else ("ticker", ticker) if ticker else ("weak_descriptive", "") if r[12] else ("absent", ""))
        weak = fields(dict(r[12]) | {"ticker": ticker})
        refs.append({"sort": (r[7], r[4], r[1], r[10][0], r[9], r[0]), "id": r[0], "scope": r[1], "source": r[4], "period": r[7], "filed": r[8], "keys": keys, "basis": basis, "weak": weak and f"P009:weak|{weak}", "value": dict(r[12]).get("value", "")})
    refs.sort(key=lambda x: x["sort"])
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for x in refs:
        for k in x["keys"]:
            parent[find(k)] = find(x["keys"][0])
    chains = {}
    for k in parent:
        chains.setdefault(find(k), []).append(k)
    sig = lambda k: fields({"key_type": k[0], "value": k[1], "source": k[2]})
    names = {root: sha("v1|P009:chain|" + ",".join(sig(k) for k in sorted(keys))) for root, keys in chains.items()}
    by_chain, by_weak = {}, {}
    for x in refs:
        if x["keys"]:
            x["chain"] = names[find(x["keys"][0])]
            by_chain.setdefault(x["chain"], []).append(x)
        if x["weak"]:
            by_weak.setdefault(x["weak"], []).append(x)
    keys_of = {names[root]: sorted(keys) for root, keys in chains.items()}
    events = []

    def add(codes, klass, group, status, keys=(), weak="", chain=""):
        side = lambda b: fields({"basis_type": b[0], "basis_value": b[1]})
        signature = fields({
            "issue_codes": ",".join(codes), "continuity_class": klass, "source_scope_key": group[0]["scope"], "observation_ids": ",".join(x["id"] for x in group), "basis_before": side(group[0]["basis"]),
            "basis_after": side(group[-1]["basis"]), "registry_status": status, "identity_keys": ",".join(sig(k) for k in keys), "weak_key": weak, "chain_id": chain,
        })
        events.append({"id": sha("v1|P009:event|" + signature), "codes": codes, "class": klass, "refs": group})

    for chain, group in by_chain.items():
        if len(group) > 1 and group[0]["basis"] != group[-1]["basis"]:
            add(["identifier_basis_transition"], "proven_transition", group, "snapshot_absent", keys_of[chain], chain=chain)
    for weak, group in by_weak.items():
        if len(group) < 2:
            continue
        own = {x["chain"] for x in group if x["keys"]}
        if len(own) > 1:
            add(["weak_key_temporal_collision"], "weak_collision", group, "", sorted({k for c in own for k in keys_of[c]}), weak=weak)
        if not own or any(not x["keys"] for x in group):
            seen = removed = False
            for x in group:
                removed |= seen and not x["keys"]
                seen |= bool(x["keys"])
            add((["strong_identifier_removed"] if removed else []) + ["weak_continuity_only"], "weak_unresolved", group, "snapshot_absent", weak=weak)
    weights = {"strong_identifier_removed": 800, "weak_key_temporal_collision": 700, "weak_continuity_only": 400}
    out = []
    for e in events:
        group = e["refs"]
        unique = lambda n: sorted({x[n] for x in group if x[n]})
        seeds = {}
        for x in group:
            for kind, value, _ in x["keys"]:
                pair = tuple(value.split(":", 1)) if kind == "other_typed_identifier" else (kind, value)
                seeds.setdefault(pair, set()).add(x["id"])
        listed = [{"id_type": a, "value": b, "observation_ids": sorted(s)} for (a, b), s in sorted(seeds.items())]
        body = {"source_scope_key": group[0]["scope"], "issue_codes": e["codes"], "continuity_class": e["class"], "event_ids": [e["id"]], "observation_ids": unique("id"), "source_ids": unique("source"), "seed_identifiers": listed}
        digits = [min(int(d), 999_999_999) for d in ("".join(c for c in x["value"] if c.isdigit()) for x in group) if d]
        score = sum(weights.get(c, 0) for c in e["codes"]) + 10 * len(unique("period")) + (min(max(digits) // 1_000_000, 99) if digits else 0)
        newest = (unique("filed") or unique("period") or [""])[-1]
        out.append((-score, -len(unique("period")), 99999999 - int(newest.replace("-", "") or 0), ",".join(e["codes"]), sha("v1|P009:scan-candidate|" + json.dumps(body, sort_keys=True, separators=(",", ":"))), e["id"]))
    return events, sorted(out)


def test_events_and_candidates(spark):
    rows = corpus()
    obs = spark.createDataFrame(rows, OBSERVATION).repartition(5)
    d = ledger.drift_tables(obs)
    events, ranked = brute(rows)
    assert sorted(r["event_id"] for r in d.events.select("event_id").collect()) == sorted(e["id"] for e in events)
    assert {c for e in events for c in e["codes"]} == {"identifier_basis_transition", "weak_key_temporal_collision", "strong_identifier_removed", "weak_continuity_only"}
    got = scan.ranked_candidates(d).orderBy("rank").select("score", "candidate_id", "event_id").collect()
    assert [tuple(r) for r in got] == [(-c[0], c[4], c[5]) for c in ranked]
    assert [r["rank"] for r in scan.ranked_candidates(d, limit=2).orderBy("rank").collect()] == [1, 2]
    sizes = {r["event_id"]: r["n_refs"] for r in d.events.collect()}
    assert sizes == {e["id"]: len(e["refs"]) for e in events} and d.diagnostics.count() == 0
    per_event = {r["event_id"]: r["c"] for r in d.refs.groupBy("event_id").agg(F.count("*").alias("c")).collect()}
    assert per_event == sizes


def test_summaries_merge_whatever_the_partitions(spark):
    """First and last, and a keyless reference after one with keys, from any split of a hot group."""
    rows = [("weak", "hot", f"2024-{1 + i // 2000:02d}-01", f"s{i:05d}", "c", "p", i, f"o{i}", ("cusip", str(i)), "missing" if i == 777 else "snapshot_absent", i != 9_999, f"chain{i}" if i != 9_999 else None) for i in range(10_000)]
    rows += [("weak", "kept", "2024-01-01", f"k{i}", "c", "p", i, f"k{i}", ("figi", "1"), "resolved", i > 0, "one" if i else None) for i in range(3)]
    schema = "kind string, `group` string, report_period string, source_id string, scope_key string, path string, ordinal bigint, observation_id string, reported_basis struct<basis_type:string,basis_value:string>, status string, keyed boolean, chain_id string"
    refs = spark.createDataFrame(rows, schema)
    for n in (1, 13):
        got = {r["group"]: r for r in ledger.summaries(refs.repartition(n)).collect()}
        hot, kept = got["hot"], got["kept"]
        assert (hot["n_refs"], hot["first"]["ordinal"], hot["last"]["ordinal"], hot["missing"], hot["bridged"]) == (10_000, 0, 9_999, True, False)
        assert hot["first_keyed"] < hot["last_keyless"] and hot["chain_low"] != hot["chain_high"]
        assert not kept["first_keyed"] < kept["last_keyless"] and kept["chain_low"] == kept["chain_high"] == "one" and kept["best"]["status"] == "resolved"
        plan = ledger.summaries(refs.repartition(n))._jdf.queryExecution().executedPlan().toString()
        assert "collect" not in plan and plan.count("partial_min") > 0


def test_scopes_within_the_cap_are_not_ranked(spark):
    """Of scopes beyond the cap the first observations stay, null scopes too; the others keep all of theirs."""
    sizes = {"a": 1_003, "b": 999, "c": 1_000, None: 1_002}
    rows = [(s, i) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "scope_key string, ordinal long")
    kept, omitted = ledger.cap_scopes(df, ["ordinal"], 1_000)
    assert sorted(map(str, kept.collect())) == sorted(map(str, df.where("ordinal < 1000").collect()))
    assert sorted((r["scope_key"] or "", r["ordinal"]) for r in omitted.collect()) == [("", 1000), ("", 1001), ("a", 1000), ("a", 1001), ("a", 1002)]
    assert all(len(x.collect()) == len(y.collect()) for x, y in zip(ledger.cap_scopes(df, ["ordinal"], 1_001), ledger.cap_rows(df, ["scope_key"], ["ordinal"], 1_001)))


def test_summaries_are_classified_in_one_pass(spark, tmp_path):
    """The plan reads the summaries once for all kinds of events."""
    basis = "struct<basis_type:string,basis_value:string>"
    order = "report_period:string,source_id:string,scope_key:string,path:string,ordinal:bigint,observation_id:string"
    schema = f"kind string, `group` string, n_refs long, first struct<{order},reported_basis:{basis}>, last struct<{order},reported_basis:{basis}>, first_keyed struct<{order}>, last_keyless struct<{order}>, chain_low string, chain_high string, missing boolean, bridged boolean, best struct<rank:string,status:string>, newest string"
    at = lambda p, b: (p, "s", "x", "", 1, "i", ("cusip", b))
    none = ("9", "")
    groups = [
        ("chain", "c1", 2, at("1", "A"), at("2", "B"), at("1", "")[:6], None, "c1", "c1", False, False, none, "2"), ("chain", "c2", 2, at("1", "A"), at("2", "A"), at("1", "")[:6], None, "c2", "c2", False, False, none, "2"),
        ("weak", "w", 3, at("1", "A"), at("3", "B"), at("1", "")[:6], at("3", "")[:6], "c1", "c2", False, False, none, "3"),
    ]
    spark.createDataFrame(groups, schema).write.parquet(f"{tmp_path}/g")
    out = ledger.classified(spark.read.parquet(f"{tmp_path}/g"))
    got = {(r["kind"], r["group"], ",".join(r["issue_codes"])) for r in out.collect()}
    assert got == {("chain", "c1", "identifier_basis_transition"), ("collision", "w", "weak_key_temporal_collision"), ("continuity", "w", "strong_identifier_removed,weak_continuity_only")}
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
