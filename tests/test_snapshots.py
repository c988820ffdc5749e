"""The change log and the markers over random sets, against sets held in memory."""

import random

import pytest
from pyspark.sql import functions as F

from stratalens.operators import snapshots

KINDS = snapshots.KINDS


def acc(n):
    return f"0000123456-24-{n:06d}"


def corpus():
    rnd = random.Random(6)
    filings, members = [], []
    for cik in range(6):
        pool = {k: [f"{k[:1]}{i:03d}" for i in range(60)] for k in KINDS}
        pool["anchored"] = pool["extension"]
        for n in range(rnd.randint(1, 9)):
            filings.append((str(cik), acc(n), rnd.choice([None, -3, 0, 60, 150])))
            for kind in KINDS:
                size = rnd.choice([0, 0, 3, 25, 55])
                members += [(str(cik), acc(n), kind, x) for x in rnd.sample(pool[kind], size)]
    filings += [("8", acc(1), 1), ("8", acc(2), 1)]
    members += [("8", acc(n), "extension", f"x{i:03d}") for n in (1, 2) for i in range(12 * n, 12 * n + 30)]
    members += members[:50] + [("0", acc(0), "schema", " "), ("0", acc(0), "schema", "  s001 "), ("0", acc(0), "other", "x"), ("77", acc(1), "schema", "no filing"), ("0", "bad", "schema", "x"), (None, acc(0), "schema", "x")]
    return filings + filings[:3] + [("0", "bad", 5), ("9", acc(4), 3), (None, acc(0), 1)], members


def brute(filings, members):
    sets, contexts = {}, {}
    for cik, a, c in filings:
        if cik is not None and len(a) == 20:
            contexts[cik, a] = max(contexts.get((cik, a), 0), c or 0)
    for cik, a, kind, x in members:
        if (cik, a) in contexts and kind in KINDS and x.strip():
            sets.setdefault((cik, a, kind), set()).add(x.strip())
    get = lambda cik, a, kind: (sets.get((cik, a, kind), set()) & sets.get((cik, a, "extension"), set())) if kind == "anchored" else sets.get((cik, a, kind), set())

    def there(cik, a, kind):
        return bool(get(cik, a, "extension")) if kind == "anchored" else bool(get(cik, a, kind)) or kind == "dimension" and contexts[cik, a] > 0

    out = {}
    for (cik, a), now in contexts.items():
        for kind in KINDS:
            earlier = [b for c, b in contexts if c == cik and b < a and there(cik, b, kind)]
            if not earlier:
                continue
            b = max(earlier)
            new, old = get(cik, a, kind), get(cik, b, kind)
            out[cik, kind, a] = (b, len(old), len(new), sorted(new - old), sorted(old - new), now, contexts[cik, b], len(get(cik, a, "extension")), len(get(cik, b, "extension")))
    return out


def fires(key, row):
    _, prior, now, new, gone, c, pc, e, pe = row
    n = len(new) + len(gone)
    ratio = n / prior if prior else 0.0
    return {
        "schema": prior >= 1 and n >= 1 and ratio >= 0.2,
        "extension": prior >= 10 and len(new) >= 5 and len(gone) >= 5 and ratio >= 0.25,
        "anchored": pe >= 25 and now - prior >= 10 and (now / e if e else 0.0) - (prior / pe if pe else 0.0) >= 0.2,
        "dimension": pc >= 50 and abs(c - pc) >= 25 and abs(c - pc) / pc >= 0.4 or prior >= 25 and n >= 10 and ratio >= 0.4,
        "duplicate": prior >= 20 and prior - now >= 10 and (prior - now) / prior >= 0.5,
    }[key[1]]


def test_log_and_markers(spark):
    filings, members = corpus()
    log = snapshots.change_log(spark.createDataFrame(filings, "cik string, accession string, context_count int"), spark.createDataFrame(members, "cik string, accession string, kind string, member string").repartition(3))
    want = {k: v for k, v in brute(filings, members).items()}
    got = {(r["cik"], r["kind"], r["accession"]): (r["prior_accession"], r["n_prior"], r["n_now"], r["n_new"], r["n_retired"]) for r in log.boundaries.where("cik is not null").collect()}
    assert got == {k: (v[0], v[1], v[2], len(v[3]), len(v[4])) for k, v in want.items()}
    name = dict(zip(KINDS, ("M001", "M002", "M003", "M004", "M005")))
    marks = {(r["cik"], {v: k for k, v in name.items()}[r["marker"]], r["accession"]): r for r in snapshots.detect(log).collect()}
    expected = {k: v for k, v in want.items() if fires(k, v)}
    assert set(marks) == set(expected) and {name[k[1]] for k in expected} == set(name.values())
    for k, v in expected.items():
        assert (marks[k]["new_examples"], marks[k]["retired_examples"]) == (v[3][:10], v[4][:10])
    churn = next(r for r in marks.values() if r["marker"] == "M002")
    assert churn["evidence"]["churn_count"] == churn["n_new"] + churn["n_retired"] and churn["evidence"]["churn_ratio"] == round((churn["n_new"] + churn["n_retired"]) / churn["n_prior"], 6)
    # any comparator pair
    pos = {(r["cik"], r["accession"]): r["pos"] for r in log.boundaries.where("kind = 'schema' and there").collect()}
    sets = {}
    for cik, a, kind, x in members:
        if kind == "schema" and (cik, a) in pos and x.strip():
            sets.setdefault((cik, a), set()).add(x.strip())
    pairs = [(c1, "schema", pos[c1, a], pos[c2, b], a, b) for c1, a in pos for c2, b in pos if c1 == c2 and a < b]
    found = snapshots.compare(log.runs, spark.createDataFrame([p[:4] for p in pairs], "cik string, kind string, prior_pos long, pos long")).collect()
    assert {(r["cik"], r["prior_pos"], r["pos"]): (r["n_both"], r["n_new"], r["n_retired"]) for r in found} == {(c, p, q): (len(sets[c, a] & sets[c, b]), len(sets[c, b] - sets[c, a]), len(sets[c, a] - sets[c, b])) for c, _, p, q, a, b in pairs}
    assert len(pairs) > 5


def test_thresholds(spark):
    assert snapshots.validated({"M001": {"min_change_count": 3}})["M001"].min_change_count == 3
    for wrong in ({"M009": {}}, {"M001": {"min": 1}}, {"M001": {"min_change_count": "1"}}, {"M001": {"min_change_count": True}}, {"M001": {"min_change_ratio": -0.1}}):
        with pytest.raises(ValueError):
            snapshots.validated(wrong)


def test_arrays_become_members(spark):
    df = spark.createDataFrame([("1", acc(1), ["a"], None)], "cik string, accession string, schema_refs array<string>, extension_qnames array<string>").withColumn("n", F.lit(1))
    assert [tuple(r) for r in snapshots.members_of(df).collect()] == [("1", acc(1), "schema", "a")]


def test_one_marker_alone_reads_its_own_sets(spark):
    """Each marker alone gives its rows of all five together, from a log that holds no other sets."""
    filings, members = corpus()
    f, m = spark.createDataFrame(filings, "cik string, accession string, context_count int"), spark.createDataFrame(members, "cik string, accession string, kind string, member string")
    rows = lambda df: sorted(map(str, df.collect()))
    every = snapshots.marker_rows(f, m).persist()
    for marker, kinds in snapshots.NEEDS.items():
        assert rows(snapshots.marker_rows(f, m, only=(marker,))) == rows(every.where(F.col("marker") == marker))
        log = snapshots.change_log(f, m, snapshots.kinds_of((marker,)), kinds[-1:])
        assert [r["kind"] for r in log.runs.select("kind").distinct().collect()] == [kinds[-1]]
