"""Each stage on its predecessor's rows against the operators' brute-force checks, at a small size."""

import random
import zlib

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from stratalens.llm import line_crf
from tests.llm.test_operators import brute_components


def test_pipeline(spark, docs, corpus, tmp_path):
    path = f"{tmp_path}/sf"
    docs.write.parquet(f"{path}/documents.parquet")
    item = corpus[100][1] if len(corpus[100][1].split()) > 8 else corpus[20][1]
    spark.createDataFrame([(i, int(not (t or "").startswith("x")), 0) for i, t, *_ in corpus], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    (_, quality), (_, near), (_, decontaminated), (_, mixed), (_, sharded) = corpus_pipeline.STAGES
    kept = quality(spark, docs, path)
    assert kept.columns == docs.columns and kept.count() == len(corpus)  # one kind of label: nothing can be told apart
    own = sorted(((r["doc_id"], r["text"]) for r in kept.collect()))
    roots, _ = brute_components([t for _, t in own])
    left = near(spark, kept, path)
    assert sorted(r["doc_id"] for r in left.collect()) == [i for (i, _), root in zip(own, roots) if own[root][0] == i]
    clean = decontaminated(spark, left, path)
    dropped = {r["doc_id"] for r in left.collect()} - {r["doc_id"] for r in clean.collect()}
    assert dropped and all(item.lower() in dict(own)[i].lower() for i in dropped)
    mix = mixed(spark, clean, path)
    assert mix.columns == docs.columns
    ids = [r["doc_id"] for r in mix.collect()]
    assert len(set(ids)) == len(ids) and set(ids) <= {r["doc_id"] for r in clean.collect()}
    out = sharded(spark, mix, path).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(ids)
    assert all(r["text_crc32"] == zlib.crc32((dict(own)[r["doc_id"]] or "").encode()) for r in out)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, path).collect()} == set(ids)
    assert "pipeline" in __spark_entry__.queries()


def test_pipeline_with_both_labels(spark, docs, empty, tmp_path):
    """A fitted classifier, null and repeated ids, clashing columns; and empty tables."""
    rnd = random.Random(4)
    good = lambda: "\n".join(" ".join(rnd.choice(["river", "stone", "walks", "slowly", "under", "light"]) + str(rnd.randrange(900)) for _ in range(9)) + "." for _ in range(4))
    bad = lambda: "\n".join(" ".join(rnd.choice(["BUY", "NOW", "$$$"]) + "!!" for _ in range(rnd.randint(3, 12))) for _ in range(rnd.randint(1, 5)))
    rows = [(i, good() if i % 3 else bad(), "en", f"src{i % 4}") for i in range(240)]
    twin = rows[1][1]
    rows += [(500, twin, "en", "src1"), (501, None, None, None), (502, "", "en", "src0"), (None, good(), "en", "src2"), (1, twin, "en", "src1")]
    own = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(-1) for c in ("n", "score", "shard", "__score", "component_id", "key")})
    path = f"{tmp_path}/sf"
    own.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(rows[4][1].split()[:12]))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    kept = corpus_pipeline.quality(spark, own, path)
    assert kept.columns == own.columns
    scores = {(r["doc_id"], r["text"]): r["score"] for r in line_crf.classify(own.select("doc_id", "text"), spark.read.parquet(f"{path}/labels.parquet")).join(own.select("doc_id", "text").distinct(), "doc_id").collect()}
    found = kept.collect()
    assert {r["doc_id"] for r in found if r["doc_id"] is not None} == {i for (i, _), s in scores.items() if s >= line_crf.THRESHOLD}
    assert sum(i % 3 > 0 for i in range(240)) * 0.95 < sum(r["doc_id"] is not None and r["doc_id"] < 240 and r["doc_id"] % 3 > 0 for r in found)
    assert sum(r["doc_id"] is not None and r["doc_id"] < 240 and r["doc_id"] % 3 == 0 for r in found) <= 4
    left = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, kept, path).collect()}
    assert 1 in left and 500 not in left and None in left
    out = corpus_pipeline.run(spark, path).collect()
    assert 4 not in {r["doc_id"] for r in out} and len(out) > 100 and {r["doc_id"] for r in out} <= left
    nothing = f"{tmp_path}/nothing"
    empty.write.parquet(f"{nothing}/documents.parquet")
    for table, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{nothing}/{table}.parquet")
    assert corpus_pipeline.run(spark, nothing).count() == 0
