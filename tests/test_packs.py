"""The pack sink: commits, failing tasks, reruns, layouts."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from stratalens.sources import packs

FILES = "pack_id string, path string, content binary"


def rows(n=6):
    out = []
    for i in range(n):
        out += [(f"p{i}", "findings.json", b"{}"), (f"p{i}", "toolchain/toolchain.json", b'{"v": 1}'), (f"p{i}", "artifacts/a.htm", f"page {i % 3}".encode()), (f"p{i}", "artifacts/empty", b""), (f"p{i}", "notes.txt", None)]
    return out


def sha(b):
    return hashlib.sha256(b or b"").hexdigest()


def test_packs_and_their_hashes(spark, tmp_path):
    files = spark.createDataFrame(rows(), FILES).repartition(4)
    root = f"file://{tmp_path}/one"
    good = {r["pack_id"]: r for r in packs.assemble(files, root).collect()}
    assert set(good) == {f"p{i}" for i in range(6)}
    own = sorted((p, sha(c)) for k, p, c in rows() if k == "p2")
    assert good["p2"]["pack_sha256"] == sha("".join(f"{p}\t{s}\n" for p, s in own).encode())
    document = json.loads(good["p2"]["document"])
    assert [(f["path"], f["role"]) for f in document["files"]] == [("artifacts/a.htm", "artifact"), ("artifacts/empty", "artifact"), ("findings.json", "output"), ("notes.txt", "other"), ("toolchain/toolchain.json", "toolchain")]
    listed = packs.entries(spark, root)
    assert listed.where("path = 'pack_manifest.json'").count() == 6
    # equal contents are stored once
    stored = [f for _, _, fs in os.walk(tmp_path / "one" / "objects") for f in fs if not f.startswith(".")]
    assert sorted(stored) == sorted({r["sha256"] for r in listed.collect()} - {sha(b"")})
    assert {r["status"] for r in packs.verify(spark, root).collect()} == {"ok"}
    again = {r["pack_id"]: r["pack_sha256"] for r in packs.assemble(files.orderBy(F.rand(2)).repartition(2), f"file://{tmp_path}/two").collect()}
    assert again == {k: r["pack_sha256"] for k, r in good.items()}
    with pytest.raises(ValueError):
        packs.assemble(files, root)


def test_failed_tasks_leave_no_manifest(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    files = spark.createDataFrame(rows(), FILES).repartition(3)
    broken = files.withColumn("content", F.when((F.col("pack_id") == "p3") & (F.col("path") == "notes.txt"), F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        packs.assemble(broken, root)
    assert packs.committed(root) == [] and packs.entries(spark, root).count() == 0
    done = {r["pack_id"]: r["pack_sha256"] for r in packs.assemble(files, root).collect()}
    fresh = {r["pack_id"]: r["pack_sha256"] for r in packs.assemble(files, f"file://{tmp_path}/s").collect()}
    assert done == fresh


def test_layouts_and_damage(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    bad = [("x", "findings.json", b"1"), ("x", "../out", b"2"), ("x", "/abs", b"3"), ("x", "a//b", b"4"), ("y", "findings.json", b"1"), ("y", "toolchain/toolchain.json", b"1"), ("y", "artifacts/a", b"1"), ("y", "artifacts/a", b"2")]
    good = packs.assemble(spark.createDataFrame(bad + rows(1), FILES), root)
    assert [r["pack_id"] for r in good.collect()] == ["p0"]
    found = {(r["pack_id"], r["path"], r["problem"]) for r in packs.problems(packs.entries(spark, root)).collect()}
    assert found == {("x", "../out", "unsafe_path"), ("x", "/abs", "unsafe_path"), ("x", "a//b", "unsafe_path"), ("x", "artifacts/", "missing"), ("x", "toolchain/toolchain.json", "missing"), ("y", "artifacts/a", "several_contents")}
    place = lambda b: tmp_path / "r" / "objects" / sha(b)[:2] / sha(b)
    place(b"page 0").write_bytes(b"changed")
    place(b"3").unlink()
    (tmp_path / "r" / "objects" / "ff").mkdir(exist_ok=True)
    (tmp_path / "r" / "objects" / "ff" / ("f" * 64)).write_bytes(b"stray")
    state = {r["sha256"]: r["status"] for r in packs.verify(spark, root).collect()}
    assert (state[sha(b"page 0")], state[sha(b"3")], state["f" * 64], state[sha(b"{}")]) == ("sha_mismatch", "missing", "unlisted", "ok")
    with pytest.raises(Exception, match="content"):
        spark.createDataFrame([("a", "b")], "pack_id string, path string").write.format("evidence_pack").option("path", root).mode("append").save()
