"""N-gram Jaccard join with a token-group matrix.

Documents are sets of word shingles; two link when 100 * intersection >= 80 * union. The join is exact:

1.  Shingles are counted over all documents, by summaries of bounded size. The most frequent ones (at most HOT_TOKENS, a bound on what
    is sent to the workers) go last in the token order, from rare to frequent, the others go by hash; any order that all documents
    share gives the same result, this one keeps common passages out of the prefixes.
2.  Documents with identical sets become one representative.
3.  Similar documents are partitioned into groups: representatives with a common pair of minimum hashes are compared with the
    first of them, and linked ones are joined into groups (connected components). A group of near copies is one group. The
    others are grouped by four common minimum hashes, so that copies with many edits stand together too.
4.  The matrix holds each group's union of prefix tokens, as sorted blobs by token range. A document's own prefix is looked up in the
    rows of other groups of fitting sizes. A shared token counts where enough tokens are left behind it in both sets; a group
    with fewer than MIN_SHARED such tokens stays closed.
5.  Groups of several members are then bounded by their whole union of tokens, in slices of at most about SLICE members: a
    slice is opened only for queries that share enough tokens with its union.
6.  Members of open groups and slices with fitting sizes are compared with the query, on the whole texts. Inside a
    linked group nothing is left to do, so near copies are not expanded into pairs; a document of a group that isn't linked also
    queries its own group, under the bound on the slices' unions without the query's own tokens.
7.  Links between groups are joined to the final components.

Prefix argument: sets of n and m tokens link only with an overlap of a = ceil(80 (n + m) / 180) or more, and a >= need(n) =
ceil(0.8 n). The k-th token that they share, in the common order, has at least a - k + 1 tokens from its place to the end in
both sets, itself included. So each of the first MIN_SHARED shared tokens has at least a - MIN_SHARED + 1 of them: it stands in both prefixes of
n - need(n) + MIN_SHARED tokens, and counts. Common passages that fill most of two documents are no shared tokens in this sense
unless what goes before them is short enough for a link.

Defined results: null and empty texts have no shingles and link with nothing, like rows with a null doc_id; identical sets link;
rows with one doc_id and several texts take part once per text; an empty table gives no rows; further columns are ignored. Memory: a
chunk of texts, and one token range of the matrix (RANGE_TOKENS on average).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm import shared, textnum
from stratalens.operators.graph import components

K, MIN_SHARED = 5, 3
#: Frequent tokens that are told apart, the count from which one is frequent, and the tokens of a task's summary.
HOT_TOKENS, HOT_COUNT, SUMMARY = 1 << 18, 24, 1 << 17
SLICE = 256
#: Tokens of one range of the matrix, on average.
RANGE_TOKENS = 1 << 18
#: Tokens that a worker gathers before it hands a piece on.
PIECE = 1 << 20
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def pack(a: np.ndarray) -> bytes:
    """Byte planes of an integer array, compressed."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def need(n: np.ndarray) -> np.ndarray:
    """Tokens that a set of n must share to link with any other."""
    return (80 * n + 99) // 100


def bucket_of(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return ((tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's summary of frequent tokens."""
    summary = textnum.Summary(SUMMARY, PIECE)
    for batch in batches:
        for _, _, data, offsets in textnum.chunks(batch.column("text")):
            summary.add(textnum.shingle_sets(data, offsets, K)[0])
    yield from summary.batches()


def hot_tokens(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, sorted, and the place of each in their order from rare to frequent."""
    return shared.most_frequent(docs.select("text").mapInArrow(frequent, "token long, n long"), HOT_TOKENS, HOT_COUNT)


def set_maker(hot: np.ndarray, ranks: np.ndarray):
    """Per document: size, fingerprint, minimum-hash keys and prefix."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in textnum.chunks(batch.column("text")):
                tokens, bounds = textnum.shingle_sets(data, offsets, K)
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                f = [np.zeros(b - a, np.int64) for _ in range(5)]
                prefixes: list[bytes | None] = [None] * (b - a)
                if len(some):
                    at = bounds[:-1][some]
                    mixed = textnum.mix(tokens)
                    f[0][some] = np.add.reduceat(mixed, at).view(np.int64)
                    f[1][some] = np.bitwise_xor.reduceat(mixed * np.uint64(0xC2B2AE3D27D4EB4F), at).view(np.int64)
                    low = [np.minimum.reduceat(mixed * s, at) for s in _SEEDS]
                    for k in range(3):
                        f[2 + k][some] = textnum.mix(low[2 * k] * np.uint64(3) + low[2 * k + 1] + np.uint64(k)).view(np.int64)
                    where = np.minimum(np.searchsorted(hot, tokens), max(len(hot) - 1, 0))
                    common = hot[where] == tokens if len(hot) else np.zeros(len(tokens), bool)
                    lengths = np.minimum(n, n - need(n) + MIN_SHARED)
                    for d in some.tolist():
                        own, late = tokens[bounds[d] : bounds[d + 1]], common[bounds[d] : bounds[d + 1]]
                        p = int(lengths[d])
                        rare = own[~late][:p]
                        if len(rare) < p:
                            order = np.argsort(ranks[where[bounds[d] : bounds[d + 1]][late]])
                            rare = np.concatenate((rare, own[late][order[: p - len(rare)]]))
                        prefixes[d] = rare.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(n, pa.int64()), *(pa.array(x) for x in f), pa.array(prefixes, pa.binary())],
                    ["doc_id", "n", "f1", "f2", "k1", "k2", "k3", "prefix"],
                )

    return make


def fitting(a: str, b: str):
    """Sizes that allow a link."""
    return (F.col(a) * 100 >= F.col(b) * 80) & (F.col(b) * 100 >= F.col(a) * 80)


def verifier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare whole texts; keep the pairs that link."""
    for batch in batches:
        ids = [batch.column(c).to_numpy() for c in ("a", "b")]
        keep = np.zeros(batch.num_rows, bool)
        size = max(1, textnum.CHUNK_BYTES // max(1, batch.nbytes // max(1, batch.num_rows)))
        for at in range(0, batch.num_rows, size):
            sets = []
            for c in ("text_a", "text_b"):
                parts, bounds = [], [np.zeros(1, np.int64)]
                for _, _, data, offsets in textnum.chunks(batch.column(c).slice(at, size)):
                    tokens, own = textnum.shingle_sets(data, offsets, K)
                    parts.append(tokens)
                    bounds.append(own[1:] + bounds[-1][-1])
                sets.append((np.concatenate(parts), np.concatenate(bounds)))
            (x, xb), (y, yb) = sets
            # both sides are sorted inside a pair: equal neighbours in the merged order are shared tokens
            pair = np.concatenate((np.repeat(np.arange(len(xb) - 1), np.diff(xb)), np.repeat(np.arange(len(yb) - 1), np.diff(yb))))
            both = np.concatenate((x, y))
            order = np.lexsort((both, pair))
            both, pair = both[order], pair[order]
            same = (both[1:] == both[:-1]) & (pair[1:] == pair[:-1])
            shared_tokens = np.bincount(pair[1:][same], minlength=len(xb) - 1)
            keep[at : at + size] = (100 * shared_tokens >= 80 * (np.diff(xb) + np.diff(yb) - shared_tokens)) & (shared_tokens > 0)
        yield pa.RecordBatch.from_pydict({"a": pa.array(ids[0][keep], pa.int64()), "b": pa.array(ids[1][keep], pa.int64())})


FILTER_BITS = 1 << 24


def id_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(FILTER_BITS, bool)
    for batch in batches:
        ids = batch.column("id").to_numpy().astype(np.uint64)
        bits[(textnum.mix(ids) % np.uint64(FILTER_BITS)).astype(np.int64)] = True
    yield pa.RecordBatch.from_pydict({"bits": [zstandard.ZstdCompressor(level=1).compress(np.packbits(bits).tobytes())]})


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text of the documents in ``ids`` (column id). A bit filter of fixed size (2 MB) drops most other rows before
    their texts are shuffled."""
    parts = ids.select("id").coalesce(4).mapInArrow(id_filter, "bits binary").collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in parts:
        bits |= np.frombuffer(zstandard.ZstdDecompressor().decompress(row["bits"]), np.uint8)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (textnum.mix(batch.column("doc_id").to_numpy().astype(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)
            yield batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1, pa.uint8()).cast(pa.bool_()))

    return docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(narrow, "doc_id long, text string")


def verified(docs: DataFrame, pairs: DataFrame, path: str) -> DataFrame:
    """The pairs (a, b) of representatives that link, by their whole texts."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = shared.written(texts_of(docs, ids), f"{path}-texts")
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    full = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    out = shared.written(full.select("a", "b", "text_a", "text_b").mapInArrow(verifier, "a long, b long").distinct(), path)
    shared.remove(docs.sparkSession, f"{path}-texts")
    return out


def matrix_rows(buckets: int):
    """Rows of the matrix: prefix tokens of a piece of documents by token range, with document, group, size and the tokens from there on."""

    def flush(rows: list[tuple[np.ndarray, int, int, int]]) -> Iterator[pa.RecordBatch]:
        lens = np.array([len(r[0]) for r in rows])
        tokens = np.concatenate([r[0] for r in rows])
        doc, group, n = (np.repeat(np.array([r[k] for r in rows], dtype=np.int64), lens) for k in (1, 2, 3))
        left = n - (np.arange(len(tokens)) - np.repeat(np.cumsum(lens) - lens, lens))
        # prefixes hold the small tokens, so ranges are those of a mixed value
        bucket = bucket_of(textnum.mix(tokens), buckets)
        order = np.lexsort((tokens, bucket))
        tokens, doc, group, n, left = tokens[order], doc[order], group[order], n[order], left[order]
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out = []
        for b in np.flatnonzero(np.diff(bounds)):
            s = slice(bounds[b], bounds[b + 1])
            out.append((int(b), pack(tokens[s]), pack(doc[s]), pack(doc[s] - group[s]), pack(n[s].astype(np.int32)), pack(left[s].astype(np.int32))))
        cols = list(zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "tokens", "docs", "groups", "sizes", "left"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, int, int, int]] = []
        held = 0
        for batch in batches:
            for doc, group, n, blob in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "group", "n", "prefix"))):
                rows.append((np.frombuffer(blob, np.uint64), doc, group, n))
                held += len(blob) // 8
                if held >= PIECE:
                    yield from flush(rows)
                    rows, held = [], 0
        if held:
            yield from flush(rows)

    return make


def overlap(n, m):
    """Tokens that sets of n and m must share to link."""
    return (80 * (n + m) + 179) // 180


def lookup(pieces: pd.DataFrame) -> pd.DataFrame:
    """Queries against the matrix rows of one token range: (q, g, shared tokens) of documents and other, smaller groups, for shared
    tokens behind which enough is left in both sets."""
    read = lambda c, t: np.concatenate([unpack(b, t) for b in pieces[c]])
    tokens, doc, n, left = read("tokens", np.uint64), read("docs", np.int64), read("sizes", np.int32).astype(np.int64), read("left", np.int32).astype(np.int64)
    group = doc - read("groups", np.int64)
    order = np.lexsort((group, tokens))
    tokens, doc, n, left, group = tokens[order], doc[order], n[order], left[order], group[order]
    first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    last = np.append(first[1:], len(tokens))
    mixed = group[first] != group[last - 1]
    first, last = first[mixed], last[mixed]
    qs, gs, held, sums = [], [], 0, []

    def settle() -> None:
        nonlocal qs, gs, held
        if qs:
            pairs = np.stack((np.concatenate(qs), np.concatenate(gs)), axis=1)
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            at = np.flatnonzero(np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(axis=1))))
            sums.append(np.column_stack((pairs[at], np.diff(np.append(at, len(pairs))))))
            qs, gs, held = [], [], 0

    for a, b in zip(first.tolist(), last.tolist()):
        # cells: one per token and group, with the range of sizes of its members that hold the token, and the most that is left
        g, d, size, rest = group[a:b], doc[a:b], n[a:b], left[a:b]
        cells = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        low, high, most, of = np.minimum.reduceat(size, cells), np.maximum.reduceat(size, cells), np.maximum.reduceat(rest, cells), g[cells]
        # by size, so that a query reads the cells with fitting sizes only
        by = np.argsort(low, kind="stable")
        low, high, most, of = low[by], high[by], most[by], of[by]
        reach = np.maximum.accumulate(high)
        ends, starts = np.searchsorted(low, size * 100 // 80, side="right"), np.searchsorted(reach, need(size))
        at = 0
        turn = np.argsort(size, kind="stable")
        while at < b - a:
            step = max(1, (1 << 20) // len(cells))
            s = turn[at : at + step]
            at += step
            x, y = int(starts[s].min()), int(ends[s].max())
            if x >= y:
                continue
            m = np.maximum(low[None, x:y], need(size[s])[:, None])
            enough = overlap(size[s, None], m) - MIN_SHARED + 1
            # a query opens groups before its own; the other direction finds the same links
            ok = (of[None, x:y] < g[s, None]) & (m <= high[None, x:y]) & (100 * size[s, None] >= 80 * low[None, x:y]) & (rest[s, None] >= enough) & (most[None, x:y] >= enough)
            q, c = np.nonzero(ok)
            if len(q):
                qs.append(d[s][q])
                gs.append(of[x:y][c])
                held += len(q)
        if held > 1 << 21:
            settle()
    settle()
    rows = np.concatenate(sums) if sums else np.zeros((0, 3), np.int64)
    return pd.DataFrame({"q": rows[:, 0], "g": rows[:, 1], "shared": rows[:, 2]})


def union_maker(members: pd.DataFrame) -> pd.DataFrame:
    """The union of a slice's tokens, those that several members hold marked by their lowest bit, and the smallest size."""
    sets = [textnum.shingle_sets(d, o, K) for _, _, d, o in textnum.chunks(pa.array(members["text"], pa.string()))]
    union, counts = np.unique(np.concatenate([t for t, _ in sets]), return_counts=True)
    marked = np.unique((union & ~np.uint64(1)) | (counts > 1))  # without the lowest bit a bound may only grow
    return pd.DataFrame({"g": members["g"].iloc[:1], "slice": members["slice"].iloc[:1], "low": [min(int(np.diff(b).min()) for _, b in sets)], "tokens": [pack(marked)]})


def union_bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries (q, text) and slices (g, slice, low, tokens): those whose overlap allows a link."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        lows, blobs, inside = batch.column("low").to_numpy(), batch.column("tokens"), batch.column("inside").to_pylist()
        for a, b, data, offsets in textnum.chunks(batch.column("text")):
            tokens, bounds = textnum.shingle_sets(data, offsets, K)
            for i in range(a, b):
                own, union = tokens[bounds[i - a] : bounds[i - a + 1]], unpack(blobs[i].as_py(), np.uint64)
                n = len(own)
                own = own & ~np.uint64(1)
                at = np.minimum(np.searchsorted(union, own), len(union) - 1)
                hit = union[at] == own  # held by one member, who may be the query itself
                more = np.minimum(np.searchsorted(union, own + np.uint64(1)), len(union) - 1)
                overlap = int(((hit & (not inside[i])) | (union[more] == own + np.uint64(1))).sum())
                keep[i] = 180 * overlap >= 80 * (n + max(int(lows[i]), int(need(np.int64(n)))))
        yield batch.filter(pa.array(keep)).select(["q", "g", "slice"])


def open_groups(docs: DataFrame, bound: DataFrame, grouped: DataFrame, root: str) -> DataFrame:
    """Pairs (a, b) of queries and members of the groups that stay open under the bound on whole unions."""
    sizes = grouped.groupBy(F.col("group").alias("g")).agg(F.count("*").alias("members"))
    slot = lambda c: F.pmod(F.xxhash64(c), F.ceil(F.col("members") / SLICE)).cast("int")
    loose = grouped.where("not linked").select(F.col("doc_id").alias("q"), F.col("group").alias("g"), "n", F.lit(True).alias("own"))
    queries = bound.join(grouped.select(F.col("doc_id").alias("q"), "n"), "q").select("q", "g", "n", F.lit(False).alias("own")).union(loose).join(sizes, "g")
    queries = shared.written(queries.where("members > 1 or not own").withColumn("q_slice", F.when(F.col("own"), slot("q"))), f"{root}/queries")
    single = queries.where("members = 1").select(F.col("q").alias("a"), F.col("g").alias("b"))
    several = queries.where("members > 1").select("q", "g", "n", "own", "q_slice")
    wanted = several.select("g").distinct().join(sizes, "g")
    members = shared.written(grouped.select(F.col("group").alias("g"), F.col("doc_id").alias("b"), F.col("n").alias("m")).join(wanted, "g").select("g", "b", "m", slot("b").alias("slice")), f"{root}/members")
    ids = members.select(F.col("b").alias("id")).union(several.select(F.col("q").alias("id"))).distinct()
    texts = shared.written(texts_of(docs, ids), f"{root}/texts")
    unions = members.join(texts.select(F.col("doc_id").alias("b"), "text"), "b").groupBy("g", "slice").applyInPandas(union_maker, "g long, slice int, low long, tokens binary")
    tests = several.join(unions, "g").join(texts.select(F.col("doc_id").alias("q"), "text"), "q")
    tests = tests.select("q", "g", "slice", "low", "tokens", "text", F.coalesce(F.col("q_slice") == F.col("slice"), F.lit(False)).alias("inside"))
    opened = shared.written(tests.mapInArrow(union_bound, "q long, g long, slice int"), f"{root}/opened")
    pairs = opened.join(several, ["q", "g"]).join(members, ["g", "slice"]).where(fitting("n", "m")).where("not own or b < q").select(F.col("q").alias("a"), "b")
    return single.union(pairs)


def similarity_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per input row."""
    spark: SparkSession = docs.sparkSession
    shared.bounded_batches(spark, rows=1000, mb=8)
    root = shared.fresh_dir(spark, "group-matrix")
    docs = docs.select("doc_id", "text")
    sets = shared.written(docs.mapInArrow(set_maker(*hot_tokens(docs)), "doc_id long, n long, f1 long, f2 long, k1 long, k2 long, k3 long, prefix binary"), f"{root}/sets")
    real = sets.where("n > 0 and doc_id is not null")
    classes = real.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("doc_id"))
    reps = shared.written(real.join(classes, ["doc_id", "f1", "f2", "n"]).dropDuplicates(["doc_id", "f1", "f2", "n"]), f"{root}/reps")
    keys = reps.select("doc_id", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("family"), F.col(f"k{k}").alias("key")) for k in (1, 2, 3)))).alias("k")).select("doc_id", "n", "k.family", "k.key")
    leaders = keys.groupBy("family", "key").agg(F.min(F.struct("doc_id", "n")).alias("l"), F.count("*").alias("members")).where("members > 1")
    stars = keys.join(leaders.select("family", "key", F.col("l.doc_id").alias("b"), F.col("l.n").alias("m")), ["family", "key"]).where((F.col("doc_id") != F.col("b")) & fitting("n", "m"))
    stars = shared.written(stars.select(F.col("doc_id").alias("a"), "b").distinct(), f"{root}/stars")
    links = verified(docs, stars, f"{root}/links")
    groups = components(links, "a", "b")
    grouped = shared.written(reps.join(groups.select(F.col("node").alias("doc_id"), F.col("component").alias("group")), "doc_id", "left"), f"{root}/linked")
    alike = grouped.where("group is null").groupBy("k1", "k2").agg(F.min("doc_id").alias("leader"), F.count("*").alias("members")).where("members > 1").drop("members")
    loose = grouped.where("group is null").join(alike, ["k1", "k2"], "left").select("doc_id", F.coalesce("leader", "doc_id").alias("group"), F.lit(False).alias("linked"), "n", "prefix")
    grouped = shared.written(grouped.where("group is not null").select("doc_id", "group", F.lit(True).alias("linked"), "n", "prefix").union(loose), f"{root}/grouped")
    buckets = max(1, -(-(grouped.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0) // (8 * RANGE_TOKENS)))
    rows = grouped.mapInArrow(matrix_rows(buckets), "bucket int, tokens binary, docs binary, groups binary, sizes binary, left binary")
    bound = rows.groupBy("bucket").applyInPandas(lookup, "q long, g long, shared long").groupBy("q", "g").agg(F.sum("shared").alias("shared")).where(F.col("shared") >= MIN_SHARED).select("q", "g")
    opened = open_groups(docs, shared.written(bound, f"{root}/bound"), grouped, root)
    more = verified(docs, shared.written(opened.distinct(), f"{root}/pairs"), f"{root}/more")
    final = components(links.union(more), "a", "b")
    by_set = reps.select("doc_id", "f1", "f2", "n").join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("f1", "f2", "n", F.coalesce("component", "doc_id").alias("component_id"))
    real_rows = sets.select("doc_id", "n", "f1", "f2").where("n > 0 and doc_id is not null").join(by_set, ["f1", "f2", "n"])
    rest = sets.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return real_rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(rest)
