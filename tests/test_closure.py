"""Relative references and closures over nested folders, cycles and limits."""

import posixpath
import random

from pyspark.sql import functions as F

from stratalens.sources import closure

CASES = [
    ("a.htm", "b.xsd", ("b.xsd", "ok")), ("x/y/a.htm", "../b.xsd#id", ("x/b.xsd", "ok")), ("x/y/a.htm", "./../../c/./d//e.xml?q=1#f", ("c/d/e.xml", "ok")), ("x/a.htm", "../../b", ("", "escapes")),
    ("x/a.htm", "../x/../y/b", ("y/b", "ok")), ("a", " http://h/b.xsd ", ("", "external")), ("a", "//h/b.xsd", ("", "external")), ("a", "urn:x", ("", "external")), ("a", "/b", ("", "absolute")),
    ("a", "#part", ("", "empty")), ("a", "  ", ("", "empty")), ("a", "..", ("", "escapes")), ("x/a", ".", ("x", "ok")), ("é ü/a", "ö.xsd", ("é ü/ö.xsd", "ok")), ("a", None, ("", "empty")),
]


def test_references_are_resolved(spark):
    df = spark.createDataFrame([(i, b, h) for i, (b, h, _) in enumerate(CASES)], "i int, base string, href string")
    got = {r["i"]: tuple(r["r"]) for r in df.select("i", closure.resolved(F.col("base"), F.col("href")).alias("r")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(CASES)}


def test_random_paths_as_the_standard_library_does(spark):
    rnd = random.Random(3)
    rows = [("/".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))), "/".join(rnd.choice(["..", ".", "a", "b"]) for _ in range(rnd.randint(1, 5))) + "/f") for _ in range(300)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, base string, href string")
    for r in df.select("base", "href", closure.resolved(F.col("base"), F.col("href")).alias("r")).collect():
        whole = posixpath.join(posixpath.dirname(r["base"]), r["href"])
        depth, out = 0, False
        for s in whole.split("/"):
            depth += {"..": -1, ".": 0}.get(s, 1)
            out |= depth < 0
        assert tuple(r["r"]) == (("", "escapes") if out else (posixpath.normpath(whole), "ok"))


def test_collect(spark):
    page = '<link:schemaRef xlink:href="t/co.xsd#x"/><link:linkbaseRef xlink:href=\'t/lab.xml\'/><link:schemaRef xlink:href="http://std/x.xsd"/><link:linkbaseRef xlink:href="gone.xml"/><link:schemaRef xlink:href="../up.xsd"/>'
    docs = [
        ("f/p.htm", page), ("f/t/co.xsd", '<xs:include schemaLocation="sub/a.xsd"/><xs:import namespace="n" schemaLocation="../../std/b.xsd"/><link:linkbaseRef xlink:href="pre.xml"/>'),
        ("f/t/sub/a.xsd", '<xs:include schemaLocation="../co.xsd"/><xs:redefine schemaLocation="/abs.xsd"/><xs:include schemaLocation="../../../../out.xsd"/>'), ("std/b.xsd", '<xs:include schemaLocation="b.xsd"/>'),
        ("f/t/lab.xml", ""), ("f/t/pre.xml", None), ("up.xsd", ""), ("g/q.htm", "<schemaRef href='q.xsd'/>"), ("g/q.xsd", ""), ("other.xsd", ""),
    ]
    table = spark.createDataFrame(docs, "path string, content string")
    files = table.select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("sha256"), F.length(F.coalesce("content", F.lit(""))).alias("bytes"))
    primaries = spark.createDataFrame([("f/p.htm",), ("g/q.htm",), ("none.htm",)], "path string")
    artifacts, problems = closure.collect(table, files, primaries)
    got = {(r["root"], r["path"]): (r["role"], r["depth"]) for r in artifacts.collect()}
    assert got == {
        ("f/p.htm", "f/p.htm"): ("primary", 0), ("f/p.htm", "f/t/co.xsd"): ("artifact", 1), ("f/p.htm", "f/t/lab.xml"): ("artifact", 1), ("f/p.htm", "up.xsd"): ("artifact", 1), ("f/p.htm", "f/t/sub/a.xsd"): ("artifact", 2),
        ("f/p.htm", "std/b.xsd"): ("artifact", 2), ("f/p.htm", "f/t/pre.xml"): ("artifact", 2), ("g/q.htm", "g/q.htm"): ("primary", 0), ("g/q.htm", "g/q.xsd"): ("artifact", 1)}
    assert {(r["path"], r["href"], r["problem"]) for r in problems.collect()} == {("f/p.htm", "gone.xml", "missing"), ("f/t/sub/a.xsd", "/abs.xsd", "absolute"), ("f/t/sub/a.xsd", "../../../../out.xsd", "escapes")}
    cut, told = closure.collect(table, files, primaries.limit(1), max_depth=1)
    assert {r["path"] for r in cut.collect()} == {"f/p.htm", "f/t/co.xsd", "f/t/lab.xml", "up.xsd"}
    assert {(r["path"], r["href"]) for r in told.where("problem = 'beyond_depth'").collect()} == {("f/t/co.xsd", p) for p in ("f/t/sub/a.xsd", "std/b.xsd", "f/t/pre.xml")}
    assert closure.collect(table.limit(0), files, primaries)[0].count() == 2


def test_rows_before_are_read_at_powers_of_two_only(spark, monkeypatch):
    """A ring with a way across and a tail: least depths, and few anti-joins."""
    links = spark.createDataFrame([(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [("r0", "r3"), ("r5", "t0")] + [(f"t{i}", f"t{i + 1}") for i in range(9)], "path string, to string")
    written = []
    monkeypatch.setattr(closure.storage, "written", lambda df, path, real=closure.storage.written: written.append(df._jdf.queryExecution().logical().toString().count("LeftAnti")) or real(df, path))
    found, beyond = closure.closure(links, spark.createDataFrame([("r0", "r0")], "root string, path string"))
    want = {"r0": 0, "r1": 1, "r2": 2, "r3": 1, "r4": 2, "r5": 3, "r6": 4, "t0": 4} | {f"t{i}": 4 + i for i in range(1, 10)}
    assert sorted((r["path"], r["depth"]) for r in found.collect()) == sorted(want.items()) and beyond.count() == 0
    assert sum(written) == 5  # at depths 1, 2, 4, 8 and the end
