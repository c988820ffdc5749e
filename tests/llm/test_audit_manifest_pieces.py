"""Operators 11 to 13 against brute force and against the library."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from stratalens.llm import filter_audit, merkle, piece_table, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# 11
def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    parts = {}
    for i, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }
        parts.setdefault(lang or "", []).append((fails, i in good, i in toxic))
    out = {}
    for part, docs in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                shapley[f] += len(gone)
                all_fails = sum(d[0][f] for d in docs)
                alone = sum(d[0][f] and sum(d[0].values()) == 1 for d in docs)
                out[part, "".join(order), step] = [len(left), len(gone), all_fails - len(gone), alone, sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for key, row in out.items():
            if key[0] == part:
                row.append(shapley[key[1][key[2] - 1]])
    return out


def audit_rows():
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(60):
        n = rnd.choice([1, 50, 199, 200, 260])
        pool = words[: rnd.choice([40, 300])]
        text = " ".join(rnd.choice(pool) for _ in range(n))
        text += rnd.choice(["", " #", "\n\n&|", " " + "ABC" * rnd.randint(0, 40)])
        rows.append((i, text, rnd.choice(["en", "de", "", None])))
    rows += [(100 + k, rows[k][1], "en") for k in range(10)] + [(100, rows[0][1], "de"), (None, rows[1][1], "en"), (None, rows[1][1], "en")]
    return rows + [(7, rows[7][1], "en"), (200, None, None), (201, "", "fr"), (202, " \n\x0b ", "fr"), (203, "ÀÉ x" * 50_000, "fr"), (204, "a b", "fr")]


def test_filter_audit(spark):
    rows = audit_rows()
    labels = [(i, i % 2, i % 5 == 0) for i in range(0, 60, 3)] + [(100, 0, 1), (100, 1, None), (None, 1, 1), (201, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("mask", F.lit(5)).withColumn("part", F.lit("z")).withColumn("n", F.lit(9)).repartition(3)
    marks = spark.createDataFrame([(i, q, None if t is None else int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int").withColumn("good", F.lit(3))
    got = filter_audit.audit(filter_audit.cells(docs, marks)).collect()
    want = brute_audit(rows, labels)
    assert len(got) == len(want) == 4 * 600
    for r in got:
        assert list(r)[3:] == want[r["part"], r["filter_order"], r["step"]], r
    assert filter_audit.audit(filter_audit.cells(docs.limit(0), marks)).count() == 0
    alone = filter_audit.audit(filter_audit.cells(docs.where("doc_id = 204"), marks.limit(0))).collect()
    assert len(alone) == 600 and {(r["good_lost"], r["toxic_lost"]) for r in alone} == {(0, 0)}


@pytest.mark.parametrize("n", range(1, 7))
def test_plain_changes(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for i in filter_audit.plain_changes(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.add(tuple(order))
    assert seen == set(itertools.permutations(range(n))) and sum(1 for _ in filter_audit.plain_changes(n)) == len(seen) - 1


# 12
def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def brute_tree(nodes, fanout):
    """Root, and each node's proof as (siblings before, siblings after) a level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            first = i - i % fanout
            proofs[leaf].append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + fanout])))
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], proofs


def brute_manifest(rows, fanout=2):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
        trees[g] = own, *brute_tree([brute_leaf(r) for r in own], fanout)
    root, tops = brute_tree([trees[g][1] for g in langs], fanout)
    out = []
    for g, top in zip(langs, tops):
        own, subroot, proofs = trees[g]
        for r, proof in zip(own, proofs):
            steps = proof + top
            cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = brute_leaf((*r[:4], r[4] + 1) if cut and r[4] is not None else r)
            for before, after in steps:
                folded = sha(before + folded + after)
            out.append((r[0], brute_leaf(r), subroot, root, sha("".join(a + b for a, b in steps)), folded, folded == root))
    return out


def merkle_rows():
    rnd = random.Random(9)
    rows = [(i, f"text {i % 50} é😀", rnd.choice(["en", "en", "de", "é", "z", "", None]), f"s{i % 3}" if i % 5 else None, rnd.choice([None, 0, i])) for i in range(700)]
    rows += [(i, None, "one" + str(i), None, 1) for i in (7, 20)] + [(None, None, None, None, None)] * 3 + [(5, "same", "en", "s", 4)] * 4 + [(5, "other", "en", "s", 4)]
    rnd.shuffle(rows)
    return rows + [(2**62 + 1, "x" * 200_000, "en", "s", 2**63 - 1)]


def test_merkle_query(spark, tmp_path):
    rows = merkle_rows()
    docs = spark.createDataFrame(rows, DOCS).withColumn("g", F.lit("clash")).withColumn("leaf", F.lit("clash")).withColumn("pos", F.lit(1))
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.op12_merkle_manifest(spark, str(tmp_path)).collect()]
    order = lambda rows: sorted(rows, key=str)
    assert order(got) == order(brute_manifest(rows))
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize(("fanout", "levels"), [(2, 1), (2, 3), (3, 2), (16, 1)])
def test_merkle_blocks(spark, fanout, levels):
    rows = merkle_rows()[:330]
    docs = spark.createDataFrame(rows, DOCS)
    got = merkle.manifest(docs, fanout=fanout, levels=levels).withColumn("folded", merkle.fold(F.col("leaf"), F.col("steps"))).withColumn("proof", F.sha2(merkle.siblings(F.col("steps")), 256)).collect()
    want = brute_manifest(rows, fanout)
    assert sorted(str((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"])) for r in got) == sorted(str(w[:5]) for w in want)
    assert all(r["folded"] == r["root"] for r in got)


def test_merkle_small_tables(spark):
    docs = spark.createDataFrame([(3, "a", "en", None, 1)], DOCS)
    (row,) = merkle.manifest(docs).collect()
    assert row["leaf"] == row["subroot"] == row["root"] and row["steps"] == []
    assert merkle.manifest(docs.limit(0)).count() == 0


# 13
def piece_texts():
    rnd = random.Random(4)
    signs = [" ", "  ", "▁", "▁▁", "\n", "\t", "\0", "\1", "\2", "a", "the", "ing", "é", "漢", "字", "1", "42", "%", "$$$", "<s>", "</s>", "<unk>", "<0x0A>", "😀", "́", "�", "\x85", " ", "Ünder", "ſ"]
    texts = ["".join(rnd.choices(signs, k=rnd.randint(0, 25))) for _ in range(400)]
    texts += ["", None, " ", "   ", "▁", "\n", "x" * 30_000, "漢" * 5_000, " a" * 20_000, " " * 3000, "word\nword word\n\nword", "\0" * 200] + ["copied text, copied"] * 30
    return texts


@pytest.mark.parametrize("size", [1, 300, piece_table.BLOCK])
def test_pieces_equal_library(spark, size):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=piece_table.default_model())
    rows = [(i if i % 9 else None, t, f"name {i}") for i, t in enumerate(piece_texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string").withColumn("block", F.lit(1)).withColumn("row", F.lit(2)).withColumn("ids", F.lit("clash")).repartition(3)
    out = piece_table.decode(piece_table.encode(docs, keep=("doc_id", "name", "block"), block_size=size)).collect()
    assert len(out) == len(rows)
    texts = {r[2]: r for r in rows}
    for r in out:
        doc_id, text, _ = texts[r["name"]]
        ids = own.encode(text or "")
        assert (r["doc_id"], r["block"], list(r["ids"]), r["decoded"]) == (doc_id, 1, ids, own.decode(ids)), text
    assert piece_table.encode(docs.limit(0)).count() == 0


def test_pieces_query(spark, tmp_path):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=piece_table.default_model())
    rows = list(enumerate(piece_texts()[:100] + [None, ""]))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_sentence_pieces(spark, str(tmp_path)).collect()}
    for i, t in rows:
        ids = own.encode(t or "")
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(own.decode(ids)))


def test_whole_texts_without_the_form(monkeypatch):
    own = piece_table.Model(piece_table.default_model())
    assert own.parted and own.chunks("a  b\nc") == ["▁a", "▁▁b", "\n", "c"]
    monkeypatch.setattr(own, "parted", False)
    assert own.chunks("a  b\nc") == ["a  b\nc"] and own.segment(["a  b\nc"]) == [own.library.encode("a  b\nc")]
