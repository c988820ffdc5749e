import random
import re

from pyspark.sql import functions as F

from stratalens.llm import line_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, hashes=None):
    """Removed lines by (doc_id, text, line number); texts of one doc_id are in the order of their hash."""
    lines = []
    for i, t in sorted({(i, t or "") for i, t in rows if i is not None}, key=lambda r: (r[0], hashes[r[1]] if hashes else r[1])):
        lines += [((i, t, k), frozenset(w for w in re.split(r"[ \t\n\x0b\f\r]+", line.translate(LOWER)) if w)) for k, line in enumerate(t.split("\n"))]
    gone = set()
    for x, (at, s) in enumerate(lines):
        for other, o in lines[:x]:
            if s and o and 100 * len(s & o) >= 80 * len(s | o):
                gone.add(at)
                break
    return gone


def test_line_dedup(spark, docs, corpus, empty):
    rnd = random.Random(11)
    base = [[f"v{rnd.randrange(60)}" for _ in range(rnd.randint(1, 25))] for _ in range(40)]

    def line():
        own = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 5])):
            own[rnd.randrange(len(own))] = f"v{rnd.randrange(60)}"
        return " ".join(own)

    rows = [(i, "\n".join(line() for _ in range(rnd.randint(0, 8)))) for i in range(60)]
    rows += [(100 + i, t) for i, (_, t, *_) in enumerate(corpus)] + [(7, rows[7][1]), (7, "totally other words here\nhot line here"), (8, None), (None, rows[7][1]), (99, "A b\n\n \t\nb a\nhot line here")] + [(1000 + i, "hot line here") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hashes = {r["text"] or "": r["h"] for r in line_dedup.identified(df).collect()}
    want = brute(rows, hashes)
    got = line_dedup.removals(df).collect()
    assert len(got) == len(rows)
    removed = {}
    for i, t, k in want:
        removed.setdefault((i, t), []).append(k)
    expected = sorted((str(i), (t or "").count("\n") + 1, sorted(removed.get((i, t or ""), []))) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_lines"], r["removed"]) for r in got) == expected and len(want) > 60
    assert all(r["n_removed"] == len(r["removed"]) and (r["doc_id"] is not None or not r["removed"]) for r in got)
    texts = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df.where("doc_id < 60 and doc_id not in (7, 8)")).collect()}
    part = brute([r for r in rows if r[0] is not None and r[0] < 60 and r[0] not in (7, 8)])
    for i, t in [r for r in rows[:60] if r[0] not in (7, 8)]:
        assert texts[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if (i, t, k) not in part)
    assert line_dedup.removals(empty).count() == 0
    assert line_dedup.dedup_lines(docs).columns == docs.columns


def test_texts_of_one_id_keep_their_own_lines(spark):
    rows = [(1, "alpha beta gamma delta"), (2, "alpha beta gamma delta"), (2, "totally other words here")]
    got = {r["text"]: r["removed"] for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id", "h").agg(F.collect_list("line_no").alias("removed")).join(line_dedup.identified(spark.createDataFrame(rows, "doc_id long, text string")), ["doc_id", "h"]).collect()}
    assert got == {"alpha beta gamma delta": [0]}
    kept = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["text"] for r in kept) == ["", "alpha beta gamma delta", "totally other words here"]


def test_group_of_near_copies(spark, monkeypatch):
    """One large group of lines with a few words changed: all found, without a join over its pairs."""
    rnd = random.Random(3)
    base = [f"b{k}" for k in range(40)]
    rows = []
    for i in range(300):
        own = list(base)
        for _ in range(rnd.randint(0, 4)):
            own[rnd.randrange(40)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sizes = []
    real = line_dedup.candidates
    monkeypatch.setattr(line_dedup, "candidates", lambda c: (lambda p: sizes.append(p.count()) or p)(real(c)))
    got = {(r["doc_id"], k) for r in line_dedup.removals(df).collect() for k in r["removed"]}
    assert got == {(i, k) for i, _, k in brute(rows)} and len(got) > 250
    assert sizes[0] < 300 * 299 / 2 / 3


def test_long_lines_that_share_words_are_no_candidates(spark, monkeypatch):
    """Unlike lines of 150 of 600 words: nearly all pairs share a word among their first ones, and none has to be verified."""
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.sample([f"w{k}" for k in range(600)], 150))) for i in range(60)]
    near = rows[0][1].split(" ")
    near[::15] = [f"x{k}" for k in range(10)]
    rows.append((60, " ".join(near)))
    sizes = []
    real = line_dedup.candidates
    monkeypatch.setattr(line_dedup, "candidates", lambda c: (lambda p: sizes.append(p.count()) or p)(real(c)))
    got = {(r["doc_id"], k) for r in line_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect() for k in r["removed"]}
    assert got == {(i, k) for i, _, k in brute(rows)} == {(60, 0)}
    assert sizes[0] <= 30


def test_later_line_that_is_gone_is_no_candidate(spark):
    """Two near lines of which the later is gone: nothing to find. Of which the earlier is gone: the later may go for its sake."""
    rows = [(i, 0, 0, "alpha beta gamma delta epsilon zeta eta theta iota " + w) for i, w in enumerate(["x", "y"])]
    df = spark.createDataFrame(rows, "doc_id long, h long, l int, text string").select("doc_id", "h", "text")
    classes = line_dedup.split_lines(df, "0" * line_dedup.SLOTS)
    found = lambda at: [tuple(r) for r in line_dedup.candidates(classes.withColumn("gone", F.col("doc_id") == at)).collect()]
    assert found(1) == [] and found(0) == [(0, 0, 1, 0)] and found(-1) == [(0, 0, 1, 0)]


def test_near_lines_at_one_place_of_two_texts(spark):
    rows = [(1, "a b c d e f g h i j"), (1, "a b c d e f g h i k"), (1, "q\na b c d e f g h i l"), (2, "Ä b\tc"), (3, "ä b c"), (4, "Ä B c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    hashes = {r["text"]: r["h"] for r in line_dedup.identified(df).collect()}
    texts = {h: t for t, h in hashes.items()}
    assert {(r["doc_id"], texts[r["h"]], r["line_no"]) for r in line_dedup.removed_lines(df).collect()} == brute(rows, hashes)
