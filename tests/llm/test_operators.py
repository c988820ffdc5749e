"""Each operator against a brute-force version, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.llm import bpe, chat, decontaminate, edit_counts, exact_dedup, group_matrix, hash_tree, line_crf, mixing, shared, textnum, token_frames

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


# 1
def fresh():
    """The library's tokenizer as a user would load it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_frames.default_tokenizer())


def test_encoder_equals_library(monkeypatch):
    path = token_frames.default_tokenizer()
    assert bpe.aligned(path)
    own, plain = bpe.Encoder(path), fresh()
    rnd = random.Random(1)
    signs = ["'", "s", "re", "ll", " ", "  ", "\n", "\t", "a", "é", "1", "²", "!", "’", " ", "漢", "́", "<|endoftext|>", "<|end", "oftext|>", "'ve", "\x85", "😀", "T"]
    texts = ["".join(rnd.choices(signs, k=rnd.randint(0, 14))) for _ in range(3000)]
    texts += ["hello <|endoftext|> world", "<|endoftext|>", "<|endoftext|><|endoftext|>x", " a  <|endoftext|>  b"]
    for points in (bpe.POINTS, 2000):  # with a table that starts anew, too
        monkeypatch.setattr(bpe, "POINTS", points)
        for at in range(0, len(texts), 500):
            got = own.encode(texts[at : at + 500])
            assert all(g.tolist() == plain.encode(t, add_special_tokens=False).ids for g, t in zip(got, texts[at : at + 500]))
    assert own.encode(["hello <|endoftext|> world"])[0].tolist() == [31373, 220, 50256, 995]


def thue_morse(n, a, b):
    out = a
    while len(out) < n:
        out += out.translate(str.maketrans({a: b, b: a}))
    return out


def test_equal_hashes_do_not_share_ids(monkeypatch):
    own, plain = bpe.Encoder(token_frames.default_tokenizer()), fresh()
    texts = [thue_morse(n, *x) for n in (1024, 2048, 4096) for x in ("ab", "ba")]
    assert [g.tolist() for g in own.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    # a table in which all pre-tokens of a length have one hash
    monkeypatch.setattr(bpe.Encoder, "hashes", lambda self, points, starts: np.diff(np.append(starts, len(points))).astype(np.uint64) << np.uint64(20))
    own = bpe.Encoder(token_frames.default_tokenizer())
    rnd = random.Random(4)
    for _ in range(20):
        texts = [" ".join("".join(rnd.choices("abcd", k=rnd.randint(1, 5))) for _ in range(30)) for _ in range(10)]
        assert [g.tolist() for g in own.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_hashes():
    import itertools

    words = ["".join(w) for k in (1, 2, 3) for w in itertools.product("abcde", repeat=k)] + ["x" * k for k in range(1, 200)] + [thue_morse(n, *x) for n in (64, 1024, 4096) for x in ("ab", "ba")]
    rnd = random.Random(5)
    words += ["".join(rnd.choices("abcdefghij", k=rnd.randint(7, 70))) for _ in range(3000)]
    words = list(dict.fromkeys(words))
    raw = " ".join(words).encode()
    hashes, starts, stops, _ = textnum.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert [raw[a:b].decode() for a, b in zip(starts, stops)] == words and len(set(hashes.tolist())) == len(words)
    other = ("\n".join(reversed(words))).upper().encode()
    again, *_ = textnum.words(np.frombuffer(other, np.uint8), np.array([0, len(other)]))
    assert again.tolist()[::-1] == hashes.tolist()


def test_token_frames(spark, docs, corpus, empty, tmp_path):
    root = f"file://{tmp_path}/frames"
    manifest = token_frames.write_frames(docs, root)
    got = {r["doc_id"]: r for r in token_frames.read_digests(manifest, root).collect()}
    library = fresh()
    start = 0
    for doc_id, text, *_ in corpus:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        r = got[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    some = token_frames.read_documents(spark, root, spark.createDataFrame([(3,), (170,), (10**6,)], "doc_id long")).collect()
    assert {r["doc_id"]: r["ids"] for r in some} == {k: [*library.encode(corpus[k][1] or "", add_special_tokens=False).ids, 0] for k in (3, 170)}
    assert token_frames.token_output(empty).count() == 0


def test_frame_checksum(tmp_path):
    from pyarrow import fs

    path = f"{tmp_path}/x.zst"
    with open(path, "wb") as f:
        w = token_frames.FrameWriter(f, 2)
        w.add(1, np.array([1, 2, 3]))
        w.add(2, np.array([7]))
        w.close()
    with fs.LocalFileSystem().open_input_file(path) as source:
        r = token_frames.FrameReader(source)
        assert r.ids(1).tolist() == [7] and r.find(2) == [1] and r.find(3) == []
        r.table[0, 2] ^= 1
        with pytest.raises(ValueError):
            r.ids(0)
    import zstandard

    # any zstandard reader passes over the skippable frames
    with open(path, "rb") as f:
        assert np.frombuffer(zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read(), "<u2").tolist() == [1, 2, 3, 7]


# 2
def brute_marginals(unary, transitions):
    import itertools

    n = len(unary)
    weights = np.zeros(n)
    total = 0.0
    for y in itertools.product((0, 1), repeat=n):
        s = np.exp(sum(u for u, l in zip(unary, y) if l) + sum(transitions[a][b] for a, b in zip(y, y[1:])))
        total += s
        weights += s * np.array(y)
    return weights / total


def test_forward_backward():
    rnd = np.random.default_rng(3)
    bounds = np.array([0, 1, 5, 12, 14])
    unary, transitions = rnd.normal(size=14), rnd.normal(size=(2, 2))
    p, _ = line_crf.forward_backward(unary, bounds, transitions)
    for a, b in zip(bounds, bounds[1:]):
        assert np.allclose(p[a:b], brute_marginals(unary[a:b], transitions))


def test_line_features_bounds():
    texts = ["a\nb\n", "", "x", "\n\n", "", "last"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in raw])))
    x, lengths, bounds = line_crf.line_features(data, offsets)
    assert np.diff(bounds).tolist() == [2, 1, 1, 2, 1, 1]
    assert lengths.tolist() == [2, 2, 0, 1, 1, 1, 0, 4]


def test_classifier(spark, docs, empty):
    rnd = random.Random(2)
    good = lambda: "\n".join(" ".join(rnd.choice(["the", "line", "reads", "well", "and"]) for _ in range(9)) + "." for _ in range(4))
    bad = lambda: "\n".join(" ".join(rnd.choice(["BUY", "NOW", "$$$"]) + "!!" for _ in range(9)) for _ in range(4))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)]
    own = spark.createDataFrame([*rows, (None, "x"), (1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in line_crf.classify(own, labels).collect()}
    assert len(got) == 303 and all(0 <= r["score"] <= 1 for r in got.values())
    test = [r for r in got.values() if r["held_out"] and r["doc_id"] < 300]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in test]) > 0.97
    assert {r["score"] for r in line_crf.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert line_crf.classify(empty.select("doc_id", "text"), labels).count() == 0


# 4
def test_pour_and_budgets():
    from fractions import Fraction

    assert mixing.pour(100, [("a", Fraction(1), 10), ("b", Fraction(1), 1000), ("c", Fraction(2), 1000)]) == {"a": 10, "b": 30, "c": 60}
    assert mixing.pour(100, [("a", Fraction(1), 10), ("b", Fraction(0), 10)]) == {"a": 10, "b": 0}
    leaves = {("x", "p"): 10, ("x", "q"): 1000, ("y", "p"): 1000}
    # p's shortage is met by its sibling q; y keeps its half
    assert mixing.budgets(leaves, 400, {}, 1) == {("x", "p"): 10, ("x", "q"): 190, ("y", "p"): 200}
    # x as a whole falls short: its ancestor's sibling takes the rest
    assert mixing.budgets({("x", "p"): 10, ("x", "q"): 20, ("y", "p"): 1000}, 400, {}, 1) == {("x", "p"): 10, ("x", "q"): 20, ("y", "p"): 370}


@pytest.mark.parametrize("share", [0.4, 2.5])
def test_mixing(spark, docs, corpus, empty, share):
    got = mixing.mix(docs, share, max_epochs=4).select("doc_id", F.col("__n").alias("n_tokens"), F.col("__epoch").alias("epoch")).collect()
    count = lambda t: len((t or "").split())
    leaf = {}
    for i, t, lang, source in corpus:
        leaf[i] = (f"d{zlib.crc32((source or '').encode()) % 4}", lang or "", source or "")
    have = Counter()
    for i, t, *_ in corpus:
        have[leaf[i]] += count(t)
    plan = mixing.budgets(have, int(share * 10) * sum(have.values()) // 10, mixing.WEIGHTS, 4)
    hashes = {}
    epochs = sorted({b // max(1, have[p]) for p, b in plan.items()})
    for e in epochs:
        for r in docs.select("doc_id", mixing.position(7, F.lit(e), F.col("doc_id")).alias("u")).collect():
            hashes[e, r["doc_id"]] = r["u"]
    want = set()
    for p, b in plan.items():
        own = [i for i in leaf if leaf[i] == p]
        whole = b // max(1, have[p])
        want |= {(i, e) for i in own for e in range(whole)}
        left = b - whole * have[p]
        for i in sorted(own, key=lambda i: (hashes[whole, i], i)):
            left -= count(corpus[i][1])
            if left < 0:
                break
            want.add((i, whole))
    assert {(r["doc_id"], r["epoch"]) for r in got} == want and len(got) == len(want)
    assert all(r["n_tokens"] == count(corpus[r["doc_id"]][1]) for r in got)
    assert mixing.mix(empty, share).count() == 0


# 5
def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max() / (2 * len(a))


def test_align():
    rnd = np.random.default_rng(4)
    for _ in range(60):
        a, b = rnd.integers(0, 5, rnd.integers(1, 12)), rnd.integers(0, 5, rnd.integers(1, 20))
        assert decontaminate.align(a, b) == smith_waterman(a, b)


def test_decontaminate(spark, docs, corpus, empty, monkeypatch):
    rnd = random.Random(9)
    item = [" ".join(f"q{rnd.randrange(10**6)}" for _ in range(30)) for _ in range(5)]
    edited = item[1].split()
    for k in range(2, 30, 6):
        edited[k] = "changed"
    del edited[10:12]
    extra = [(1000, "Intro. " + item[0].upper() + " and more"), (1001, "before, " + ", ".join(edited) + "! after"), (1002, "only " + " ".join(item[2].split()[:8]) + " quoted"), (1003, item[0])]
    own = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    bench = spark.createDataFrame([*enumerate(item), (5, None), (6, ""), (7, "zz9 zz8")], "item_id long, text string")

    def run():
        out = decontaminate.decontaminate(own, bench).select("doc_id", F.col("__contaminated").alias("contaminated"), F.col("__item").alias("item_id"), F.col("__score").alias("score"))
        return {r["doc_id"]: r for r in out.collect()}

    got = run()
    assert {i: r["item_id"] for i, r in got.items() if r["contaminated"]} == {1000: 0, 1001: 1, 1003: 0}
    assert got[1000]["score"] == 1.0 and 0.5 < got[1001]["score"] < 1
    words = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    assert got[1001]["score"] == smith_waterman(words(item[1]), words(extra[1][1]))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert {(i, r["item_id"], r["score"]) for i, r in run().items()} == {(i, r["item_id"], r["score"]) for i, r in got.items()}
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert not any(r["__contaminated"] for r in decontaminate.decontaminate(docs, bench.limit(0)).collect())


# 6
def test_edits_equal_full_counts(spark, docs, corpus, empty):
    own, plain = bpe.encoder(token_frames.default_tokenizer()), fresh()
    count = lambda t: len(plain.encode(t, add_special_tokens=False).ids)
    rnd = random.Random(6)
    signs = [" ", "  ", "\n", "'", "s", "ll", "x", "yz", "7", "!", "é", "word", " long words here", "<|endoftext|>", "<|endof", "text|>", "|>"]
    for _ in range(250):
        text = "".join(rnd.choices(signs, k=rnd.randint(0, 400)))
        starts, _, sizes, _ = own.spans([text])
        tree = edit_counts.Tree(edit_counts.leaves_of(starts, sizes, len(text)))
        for _ in range(4):
            a = rnd.randint(0, len(text) + 2)
            tree, text, _ = edit_counts.edit(tree, text, a, a + rnd.choice([0, 0, 1, 3, 80]), "".join(rnd.choices(signs, k=rnd.choice([0, 1, 3, 200]))), own)
            assert tree.tokens == count(text)
            assert tree.sums[1, 0] == len(text)
    text = " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(1, 9))) for _ in range(20000))
    starts, _, sizes, _ = own.spans([text])
    tree = edit_counts.Tree(edit_counts.leaves_of(starts, sizes, len(text)))
    for at in (50000, 50100, 0, len(text)):  # a leaf that grows too large is split, the rest isn't encoded
        tree, text, encoded = edit_counts.edit(tree, text, at, at, " ".join("x!" for _ in range(270)), own)
        assert tree.tokens == count(text) and encoded < 5000
    rows = edit_counts.apply_edits(edit_counts.build_trees(docs.select("doc_id", "text")), edit_counts.sample_edits(F.col("doc_id"), F.col("text"))).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        assert r["n_tokens"] == count(corpus[r["doc_id"]][1] or "") and r["new_tokens"] == count(r["text"])
    long = max(rows, key=lambda r: len(r["text"]))
    assert long["encoded_chars"] < len(long["text"]) / 20  # only regions around the edits
    trees = edit_counts.build_trees(docs.select("doc_id", "text"))
    edits = spark.createDataFrame([(5, 1, 0, 3, "zz"), (5, 0, 0, 0, "first "), (None, 0, 0, 0, "x")], "doc_id long, ordinal int, first int, end int, text string")
    five = edit_counts.apply_edits(edit_counts.with_edits(trees, edits)).where("doc_id = 5").first()
    assert five["text"] == "zz" + ("first " + corpus[5][1])[3:]
    assert edit_counts.apply_edits(edit_counts.build_trees(empty), edit_counts.sample_edits(F.col("doc_id"), F.col("text"))).count() == 0


# 7
def test_sharding(spark, docs, corpus, empty):
    rows = hash_tree.shard_documents(docs).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        raw = (corpus[r["doc_id"]][1] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
        assert r["grown_shard"] in (r["shard"], 8)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    twice = docs.union(docs).withColumn("doc_id", F.when(F.col("doc_id") > 5, F.col("doc_id")))
    assert hash_tree.shard_documents(twice).count() == 2 * len(corpus)
    assert hash_tree.shard_documents(empty).count() == 0


def test_movement_stays_in_changed_subtrees(spark):
    ids = spark.range(20000).withColumnRenamed("id", "doc_id")
    a, b, c, d = (hash_tree.Node(f"s{i}", shard=i) for i in range(4))
    grown = hash_tree.Node("s0", shard=0, leaf_weight=2.0)
    tree = lambda x: hash_tree.Node("root", (hash_tree.Node("r0", (x, b)), hash_tree.Node("r1", (c, d))))
    rows = hash_tree.placed(hash_tree.placed(ids, "doc_id", tree(a), "old"), "doc_id", tree(grown), "new").collect()
    moved = [(r["old"], r["new"]) for r in rows if r["old"] != r["new"]]
    assert moved and all(new in (0, 1) and (old in (2, 3) or new == 0) for old, new in moved)
    assert abs(sum(r["new"] == 0 for r in rows) / 20000 - 0.4) < 0.02


# 8
def brute_components(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def test_decontaminate_finds_what_brute_force_finds(spark, monkeypatch):
    """Copies with every 4th and every 3rd word changed, beside a verbatim copy, insertions, gaps and texts of common words only."""
    rnd = random.Random(21)
    vocabulary = [f"v{i}" for i in range(60)]
    item = [[f"q{rnd.randrange(10**6)}" if rnd.random() < 0.5 else rnd.choice(vocabulary) for _ in range(rnd.choice((9, 30, 31)))] for _ in range(8)]
    item[0] = [f"q{k}" for k in range(30)]
    every = lambda words, n, at: [f"x{rnd.randrange(10**6)}" if k % n == at else w for k, w in enumerate(words)]
    texts = [every(item[0], 4, 3), item[0], every(item[1], 4, 3)]  # item 0 has a verbatim copy elsewhere, item 1 has none
    texts += [every(w, n, at) for w in item for n, at in ((3, 2), (4, 0), (2, 0))]
    texts += [[x for w in i for x in ((w,) if rnd.random() < 0.5 else (w, "y"))] for i in item]
    texts += [[w for w in i if rnd.random() < 0.7] for i in item]
    texts += [[rnd.choice(vocabulary) for _ in range(rnd.randint(0, 150))] for _ in range(40)]
    pad = lambda t: [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 30))] + t + [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 30))]
    texts = [pad(t) for t in texts]
    want = {}
    for d, t in enumerate(texts):
        best = max((smith_waterman(i, t), -k) for k, i in enumerate(item))
        want[d] = (best[0], -best[1]) if best[0] >= 0.5 else (0, None)
    assert want[0] != (0, None) and want[2] != (0, None) and 20 < sum(k is not None for _, k in want.values()) < len(texts) - 20
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(item)], "item_id long, text string")
    for pairs in (1 << 21, 5):
        monkeypatch.setattr(decontaminate, "PAIRS", pairs, raising=False)
        got = decontaminate.decontaminate(docs, bench).collect()
        assert {r["doc_id"]: (r["__score"], r["__item"]) for r in got} == want


def test_shingle_sets():
    texts = ["A b c d e f", "a b c", "", "x  y\tz", "a b c d e a b c d e", "ü B\nc"]
    import pyarrow as pa

    (_, _, data, offsets), = textnum.chunks(pa.array(texts))
    tokens, bounds = textnum.shingle_sets(data, offsets)
    assert np.diff(bounds).tolist() == [len(shingles(t)) for t in texts]
    again, _ = textnum.shingle_sets(np.frombuffer(b"zz a B c D e f", np.uint8), np.array([0, 14]))
    assert set(tokens[:2].tolist()) <= set(again.tolist())


def test_similarity_components(spark, docs, corpus, empty, monkeypatch):
    want, sizes = brute_components([t for _, t, *_ in corpus])
    assert max(Counter(want).values()) > 3

    def check(frame):
        got = {r["doc_id"]: r for r in group_matrix.similarity_components(frame).collect()}
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (sizes[i], want[i]) for i in range(len(corpus))}

    check(docs)
    monkeypatch.setattr(group_matrix, "PIECE", 500)
    check(docs.repartition(2))
    assert group_matrix.similarity_components(empty).count() == 0
    odd = docs.select(F.when(F.col("doc_id") > 2, F.col("doc_id")).alias("doc_id"), "text")
    rows = group_matrix.similarity_components(odd.union(odd.where("doc_id = 7"))).collect()
    assert len(rows) == len(corpus) + 1 and all(r["component_id"] is None for r in rows if r["doc_id"] is None)


def test_prefix_is_exact_without_groups(spark, docs, corpus, monkeypatch):
    """The matrix alone finds every link when no document is grouped beforehand."""
    want, _ = brute_components([t for _, t, *_ in corpus])
    real = group_matrix.components
    calls = []

    def late(links, a, b):
        calls.append(1)
        return real(links.limit(0) if len(calls) == 1 else links, a, b)

    monkeypatch.setattr(group_matrix, "components", late)
    monkeypatch.setattr(group_matrix, "fitting", lambda a, b: F.lit(False) if not calls else (F.col(a) * 100 >= F.col(b) * 80) & (F.col(b) * 100 >= F.col(a) * 80))
    got = {r["doc_id"]: r["component_id"] for r in group_matrix.similarity_components(docs).collect()}
    assert got == dict(enumerate(want))


def test_first_shared_tokens_count():
    """Of any two sets that link, MIN_SHARED shared tokens stand in both prefixes with enough tokens left behind them."""
    rnd = random.Random(12)
    linked = 0
    for _ in range(30000):
        n = rnd.randint(3, 60)
        x = set(rnd.sample(range(1000), n))
        y = set(rnd.sample(sorted(x), rnd.randint(max(1, 7 * n // 10), n))) | {rnd.randrange(1000) for _ in range(rnd.randint(0, n // 3))}
        if x == y or 100 * len(x & y) < 80 * len(x | y):
            continue
        linked += 1
        a, b = sorted(x), sorted(y)
        enough = group_matrix.overlap(len(a), len(b)) - group_matrix.MIN_SHARED + 1
        prefix = lambda s: s[: len(s) - int(group_matrix.need(np.int64(len(s)))) + group_matrix.MIN_SHARED]
        counted = [t for t in prefix(a) if t in prefix(b) and len(a) - a.index(t) >= enough and len(b) - b.index(t) >= enough]
        assert len(counted) >= group_matrix.MIN_SHARED
    assert linked > 3000


def test_frequent_tokens_are_counted_within_the_bound(spark, monkeypatch):
    monkeypatch.setattr(group_matrix, "PIECE", 400)
    monkeypatch.setattr(group_matrix, "SUMMARY", 60)
    monkeypatch.setattr(group_matrix, "HOT_COUNT", 1)
    rnd = random.Random(2)
    texts = [" ".join(f"u{rnd.randrange(10**9)}" for _ in range(20)) + " | a b c d e f" * (k % 2) for k in range(400)]
    import pyarrow as pa

    (batch,) = pa.table({"text": texts}).to_batches()
    rows = pa.Table.from_batches(list(group_matrix.frequent(iter([batch]))))
    got = dict(zip(rows.column("token").to_numpy().view(np.uint64).tolist(), rows.column("n").to_pylist()))
    (_, _, data, offsets), = textnum.chunks(pa.array(texts))
    tokens, counts = np.unique(textnum.shingle_sets(data, offsets)[0], return_counts=True)
    short = counts.sum() / 60
    assert len(got) <= 60 and all(0 <= c - got.get(t, 0) <= short for t, c in zip(tokens.tolist(), counts.tolist()))
    assert {t for t, c in zip(tokens.tolist(), counts.tolist()) if c > short} <= set(got)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hot, ranks = group_matrix.hot_tokens(docs)
    assert hot.tolist() == sorted(hot.tolist()) and sorted(ranks.tolist()) == list(range(len(hot)))


def test_link_with_one_size_of_a_group(spark):
    """A query of 13 shingles links with the member of 14 only, in a group of 13 to 15."""
    rnd = random.Random(3)
    rows = []
    for c in range(600):
        w = [f"c{c}w{rnd.randrange(10**6)}" for _ in range(25)]
        y = w[:16] + w[17:19]
        rows += [" ".join(t) for t in (y, y + [w[19]], y[2:] + [w[20]], w[:17])]
    want, _ = brute_components(rows)
    assert all(want[i] == i // 4 * 4 for i in range(len(rows)))
    got = group_matrix.similarity_components(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(want))


# 9
def brute_chat(rows):
    convs = defaultdict(set)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].add((-1 if turn is None else turn, role or "", text or ""))
    lists = {c: sorted(t) for c, t in convs.items()}
    prefixes = set()
    for t in lists.values():
        last = t[-1][0]
        prefixes |= {tuple(x for x in t if x[0] <= k) for k in {x[0] for x in t} if k < last}
    first = {}
    for c in sorted(lists):
        first.setdefault(tuple(lists[c]), c)
    return {c: "".join(f"<|{r}|>\n{x}<|end|>\n" for _, r, x in t) for t, c in first.items() if t not in prefixes}


def test_chat(spark):
    rnd = random.Random(8)
    rows = []
    for c in range(60):
        base = [(k, ["user", "assistant"][k % 2], f"text {rnd.randrange(3)}") for k in range(rnd.randint(1, 5))]
        rows += [(c, *t) for t in base]
    long = [(900, k, "user", f"t{k}") for k in range(700)]
    rows += long + [(901, *t[1:]) for t in long[:300]] + [(902, *t[1:]) for t in long]
    rows += [(None, 0, "user", "x"), (903, None, None, None), (904, 0, "user", ""), (904, 0, "user", ""), (905, 2, "a", "x"), (905, 2, "b", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("copies", F.lit(1)).repartition(3)
    got = {r["conv_id"]: r["rendered"] for r in chat.render(df).collect()}
    assert got == brute_chat(rows)
    assert chat.render(df.limit(0)).count() == 0


# 10
@pytest.mark.parametrize(("capacity", "bits"), [(1 << 14, 60), (16, 60), (8, 5), (4, 1)])
def test_exact_dedup(spark, docs, corpus, empty, capacity, bits):
    """Short keys collide: different texts then meet in one chain."""
    import hashlib

    rows = exact_dedup.exact_dedup(docs, capacity=capacity, bits=bits).collect()
    groups = defaultdict(list)
    for i, t, *_ in corpus:
        groups[(t or "").translate(LOWER)].append(i)
    assert len(rows) == len(corpus)
    for r in rows:
        text = (corpus[r["doc_id"]][1] or "").translate(LOWER)
        own = groups[text]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), r["doc_id"] == max(own))
        assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert (max(r["links"] for r in rows) > 1) == (bits < 60)
    buckets = Counter(b for b, _ in {(r["bucket"], r["keep_id"]) for r in rows})
    assert bits < 60 or capacity > 100 or max(buckets.values()) <= capacity and len(buckets) > 4
    assert exact_dedup.exact_dedup(empty, bits=bits).count() == 0


def test_exact_dedup_null_and_repeated_ids(docs, corpus):
    for bits in (60, 3):
        some = exact_dedup.exact_dedup(docs.withColumn("doc_id", F.when(F.col("doc_id") > 10, F.col("doc_id"))).union(docs.where("doc_id = 20")), bits=bits).collect()
        assert len(some) == len(corpus) + 1
        assert all(r["kept"] for r in some if r["doc_id"] == 20 and r["keep_id"] == 20)
        assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in some)


def test_directory_splits_what_is_overfull(spark):
    """Keys that share their first bits: the directory goes deeper there and keeps one bucket elsewhere."""
    keys = spark.createDataFrame([(k,) for k in [*range(100), (1 << 59) + 5, (1 << 60) - 1]], "key long")
    slots, depth = exact_dedup.directory(keys, capacity=10)
    rows = keys.withColumn("slot", F.shiftright("key", exact_dedup.KEY_BITS - depth)).join(slots, "slot").collect()
    sizes = Counter(r["bucket"] for r in rows)
    assert depth > 50 and max(sizes.values()) <= 10 and len(rows) == 102
    assert {r["depth"] for r in rows if r["key"] >= 1 << 59} == {1}


def test_shared_root_is_read_from_the_session(spark):
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    assert shared.shared_root(spark) == root.rstrip("/") if root else shared.shared_root(spark).startswith("file://")
