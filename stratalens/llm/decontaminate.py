"""Benchmark decontamination: n-gram and rare-word seeds, then Smith-Waterman alignment.

Words are lower-cased runs between ASCII punctuation and white space. All SEED-word runs of the test items are seeds, looked
up in all documents; a document and an item that share a seed are aligned over the window around the hits: a match scores 2, a
mismatch or gap -1. The score is divided by that of the whole item, and a document is contaminated at MIN_SCORE or more.
Paraphrased or edited copies keep some runs and lose little score, while a short quotation from an item scores its share of the item only.

Copies in which no run is left whole (every third word changed) can still reach MIN_SCORE. They are found by the item's rarest
words: a score of MIN_SCORE matches at least ``needed`` of an item's n words within ``reach`` words of the document, so of any n - needed + t
words of the item at least t are matched there. A first pass counts in how many documents each word of the items occurs; the rarest n - needed + t
words are looked up with the seeds, and where t of them stand within that reach the document is aligned too. Every document
that reaches MIN_SCORE with an item of SEED words or more is therefore aligned with it.

An item with fewer than SEED words is one run of its own length, met only as a whole. Items go to the workers in blocks of bounded bytes, one
pass a block; documents are never shuffled. Before a window is aligned, the score is bounded by its runs of words of the item, and by the
item's words that occur in it.

Defined results: null and empty texts are clean, with score 0 and no item; items without words match nothing; of items with
equal scores the smallest item_id is named; repeated rows get equal results; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm import shared, textnum

SEED, MIN_SCORE, BLOCK_BYTES, FILTER_BITS = 3, 0.5, 16 << 20, 22
#: (hit, item) pairs that a worker holds at once, beyond those of one document.
PAIRS = 1 << 21


def needed(n: int) -> int:
    """Words of an item of n that a score of MIN_SCORE matches at least: 2 for each."""
    return math.ceil(MIN_SCORE * n)


def reach(n: int) -> int:
    """Words of a document that such an alignment spans at most: n matches, and gaps that cost no more than what they leave over."""
    return math.ceil((3 - 2 * MIN_SCORE) * n)


def threshold(n: int) -> int:
    """Rare words that must stand together; any number from 1 to needed(n) finds all copies."""
    return max(1, needed(n) // 3)


@dataclass
class Items:
    ids: list[int]
    words: list[np.ndarray]

    @staticmethod
    def of(rows: list[tuple[int, str]]) -> "Items":
        out = Items([], [])
        for item, text in rows:
            raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
            hashes, *_ = textnum.words(raw, np.array([0, len(raw)]), textnum.PUNCTUATED)
            if len(hashes):
                out.ids.append(item)
                out.words.append(hashes)
        return out

    def runs(self) -> list[np.ndarray]:
        """Each item's n-gram hashes by position."""
        return [textnum.ngrams(w, np.array([0, len(w)]), min(SEED, len(w)))[0] for w in self.words]


class Lookup:
    """Which positions of an array of hashes are in a set."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.mask = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.mask[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.mask[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        hit = self.keys[key] == hashes[at]
        return at[hit], key[hit]


def hits(data: np.ndarray, offsets: np.ndarray, lookups: dict[int, Lookup]):
    """Word hashes, bounds, and for each run length the first words, keys."""
    words, _, _, bounds = textnum.words(data, offsets, textnum.PUNCTUATED)
    found = []
    for k, lookup in lookups.items():
        grams, first, _ = textnum.ngrams(words, bounds, k)
        at, key = lookup.find(grams)
        found.append((k, first[at], key))
    return words, bounds, found


def counter(lookup: Lookup):
    """In how many texts each word of the lookup occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(lookup.keys), np.int64)
        for batch in batches:
            for _, _, data, offsets in textnum.chunks(batch.column("text")):
                words, _, _, bounds = textnum.words(data, offsets, textnum.PUNCTUATED)
                at, key = lookup.find(words)
                doc = np.searchsorted(bounds, at, side="right") - 1
                sums += np.bincount(np.unique(doc * len(sums) + key) % len(sums), minlength=len(sums))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"key": pa.array(some, pa.int64()), "n": pa.array(sums[some], pa.int64())})

    return count


def align(item: np.ndarray, window: np.ndarray) -> float:
    """Smith-Waterman's best local score over twice the item's length."""
    return float(align_all([item], [window])[0])


def align_all(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """The score of each pair, for words as numbers from 0 on (or -1: not in the item). Pairs of similar sizes go side by side; one row of their matrices for each word of the windows."""
    out = np.zeros(len(items))
    order = sorted(range(len(items)), key=lambda i: (len(items[i]) > 64, len(windows[i])))
    while order:
        some = [order.pop()]
        width = len(items[some[0]])
        while order and len(some) < 512 and max(width, len(items[order[-1]])) * (len(some) + 1) <= 1 << 15:
            width = max(width, len(items[order[-1]]))
            some.append(order.pop())
        own, others = np.full((width, len(some)), -2, np.int64), np.full((max(len(windows[i]) for i in some), len(some)), -1, np.int64)
        for c, i in enumerate(some):
            own[: len(items[i]), c], others[: len(windows[i]), c] = items[i], windows[i]
        steps = np.arange(width + 1, dtype=np.int32)[:, None]
        row, best = np.zeros((width + 1, len(some)), np.int32), np.zeros((width + 1, len(some)), np.int32)
        for words in others:
            new = np.maximum(row - 1, 0)
            np.maximum(new[1:], row[:-1] + (own == words) * np.int32(3) - 1, out=new[1:])
            row = np.maximum.accumulate(new + steps, axis=0) - steps  # gaps along the item
            np.maximum(best, row, out=best)
        out[some] = best.max(axis=0) / np.array([2 * len(items[i]) for i in some])
    return out


class Bound:
    """Which windows could reach the score: a word of the item gives 2 at most, any other word between two of them costs 1."""

    def __init__(self, items: Items):
        self.lookup = Lookup(np.concatenate(items.words))
        self.codes = [np.searchsorted(self.lookup.keys, w) for w in items.words]
        self.own = np.unique(np.concatenate([c + i * len(self.lookup.keys) for i, c in enumerate(self.codes)]))
        self.sizes = np.array([len(w) for w in items.words], np.int64)

    def coded(self, words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), -1, np.int64)
        at, key = self.lookup.find(words)
        out[at] = key
        return out

    def passing(self, codes: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(item), bool)
        total = np.concatenate(([0], np.cumsum(high - low)))
        a = 0
        while a < len(item):
            b = max(a + 1, int(np.searchsorted(total, total[a] + PAIRS, side="right")) - 1)
            n = (high - low)[a:b]
            segment = np.repeat(np.arange(b - a), n)
            code = codes[np.arange(len(segment)) + np.repeat(low[a:b] - (total[a:b] - total[a]), n)]
            key = code + item[a:b][segment] * len(self.lookup.keys)
            mine = (code >= 0) & (self.own[np.minimum(np.searchsorted(self.own, key), len(self.own) - 1)] == key)
            value = np.where(mine, 2, -1)
            sums = np.cumsum(value)
            apart = segment * (4 * len(segment) + 4)  # no window reaches into the next one
            gain = sums - apart - np.minimum.accumulate(sums - value - apart)
            keep[a:b] = np.maximum.reduceat(gain, total[a:b] - total[a]) >= 2 * MIN_SCORE * self.sizes[item[a:b]]
            a = b
        return keep


class RareWords:
    """For each word the items that have it among their rarest; where enough of an item's stand together."""

    def __init__(self, items: Items, counts: dict[int, int]):
        pairs = []
        for i, own in enumerate(items.words):
            n = len(own)
            if n >= SEED:
                df = np.array([counts.get(w, 0) for w in own.tolist()])
                rare = own[np.lexsort((own, df))[: n - needed(n) + threshold(n)]]
                pairs.append(np.stack((np.unique(rare), np.full(len(np.unique(rare)), i, np.uint64))))
        words, item = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.uint64)
        order = np.lexsort((item, words))
        self.lookup, self.items = Lookup(words), item[order].astype(np.int64)
        self.starts = np.searchsorted(words[order], self.lookup.keys)
        self.sizes = np.diff(np.append(self.starts, len(words)))
        self.least = np.array([threshold(len(w)) for w in items.words], np.int64)
        self.reach = np.array([reach(len(w)) for w in items.words], np.int64)

    def together(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, word, item) from which on enough of the item's rare words follow within its reach."""
        at, key = self.lookup.find(words)
        doc = np.searchsorted(bounds, at, side="right") - 1
        ends = np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) + 1 if len(doc) else np.zeros(0, np.int64)
        total = np.concatenate(([0], np.cumsum(self.sizes[key])))
        a = 0
        while a < len(at):
            b = max(int(ends[np.searchsorted(ends, a, side="right")]), int(ends[max(0, np.searchsorted(total[ends], total[a] + PAIRS, side="right") - 1)]))
            n = self.sizes[key[a:b]]
            hit = np.repeat(np.arange(a, b), n)
            item = self.items[np.arange(len(hit)) + np.repeat(self.starts[key[a:b]] - (total[a:b] - total[a]), n)]
            group = doc[hit] * len(self.least) + item
            order = np.argsort(group, kind="stable")  # hits stay in the order of their places
            group, item, place = group[order], item[order], at[hit[order]]
            last = np.arange(len(group)) + self.least[item] - 1
            far = np.minimum(last, len(group) - 1)
            ok = (last < len(group)) & (group[far] == group) & (place[far] - place < self.reach[item])
            yield from zip(doc[hit[order]][ok].tolist(), place[ok].tolist(), item[ok].tolist())
            a = b


def scan(items: Items, seeds: dict[int, Lookup], places: dict[int, list[list[int]]], rare: RareWords):
    """places: for each seed the items that have it."""
    bound = Bound(items)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            best, named, counts = np.zeros(n), np.full(n, -1, np.int64), np.zeros(n, np.int64)
            for a, _, data, offsets in textnum.chunks(batch.column("text")):
                words, bounds, found = hits(data, offsets, seeds)
                meets: dict[tuple[int, int], set[int]] = {}
                for k, first, key in found:
                    doc = np.searchsorted(bounds, first, side="right") - 1
                    for d, w, s in zip(doc.tolist(), first.tolist(), key.tolist()):
                        for item in places[k][s]:
                            meets.setdefault((d, item), set()).add(w)
                for (d, _), at in meets.items():
                    counts[a + d] += len(at)
                for d, w, item in rare.together(words, bounds):
                    meets.setdefault((d, item), set()).add(w)
                windows = []
                for (d, item), together in meets.items():
                    at = sorted(together)
                    low, high, wide = bounds[d], bounds[d + 1], reach(len(items.words[item]))
                    start = 0
                    for i in range(1, len(at) + 1):
                        if i < len(at) and at[i] - at[i - 1] <= wide:
                            continue
                        windows.append((d, item, max(low, at[start] - wide), min(high, at[i - 1] + wide + SEED)))
                        start = i
                if not windows:
                    continue
                codes = bound.coded(words)
                of, item, low, high = np.array(windows, np.int64).T
                some = np.flatnonzero(bound.passing(codes, item, low, high))
                some = [i for i in some.tolist() if np.isin(bound.codes[item[i]], codes[low[i] : high[i]]).sum() >= needed(len(bound.codes[item[i]]))]
                scores = align_all([bound.codes[item[i]] for i in some], [codes[low[i] : high[i]] for i in some])
                for i, score in zip(some, scores.tolist()):
                    d, named_here = a + of[i], items.ids[item[i]]
                    if score > best[d] or score == best[d] and score > 0 and named_here < named[d]:
                        best[d], named[d] = score, named_here
            low = best < MIN_SCORE
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(low, 0, best), pa.float64()), pa.array(named, pa.int64(), mask=low), pa.array(counts, pa.int64())], [*batch.schema.names, "__score", "__item", "__hits"])

    return find


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and text with __score, __item (null where clean), __hits and __contaminated."""
    spark = docs.sparkSession
    shared.bounded_batches(spark, rows=1000, mb=8)
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    rows = docs.select(*keep, *(["text"] if "text" not in keep else []))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = rows.withColumns({"__score": F.lit(0.0), "__item": F.lit(None).cast("long"), "__hits": F.lit(0).cast("long")})
    for b in range(blocks):
        part = benchmark.select("item_id", "text").where("item_id is not null").distinct().where(block == b)
        items = Items.of(sorted((r["item_id"], r["text"] or "") for r in part.collect()))  # BLOCK_BYTES on average
        runs = items.runs()
        widths = [min(SEED, len(w)) for w in items.words]
        if not runs:
            continue
        words = Lookup(np.concatenate(items.words))
        counted = docs.select("text").mapInArrow(counter(words), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()  # one row per word of the items
        rare = RareWords(items, {int(words.keys[r["key"]]): r["n"] for r in counted})
        seeds = {k: Lookup(np.concatenate([r for r, w in zip(runs, widths) if w == k])) for k in sorted(set(widths))}
        places: dict[int, list[list[int]]] = {k: [[] for _ in x.keys] for k, x in seeds.items()}
        for i, (run, k) in enumerate(zip(runs, widths)):
            for s in np.unique(np.searchsorted(seeds[k].keys, run)).tolist():
                places[k][s].append(i)
        found = rows if blocks == 1 else out.withColumnsRenamed({"__score": "__s", "__item": "__i", "__hits": "__h"})
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) if blocks > 1 else fields
        out = found.mapInArrow(scan(items, seeds, places, rare), f"{kinds}, __score double, __item long, __hits long")
        if blocks > 1:
            better = F.struct(F.col("__score"), -F.col("__item")) >= F.struct(F.col("__s"), -F.col("__i"))
            better = F.col("__item").isNotNull() & (F.col("__i").isNull() | better)
            pick = lambda new, old: F.when(better, F.col(new)).otherwise(F.col(old)).alias(new)
            out = out.select(*rows.columns, pick("__score", "__s"), pick("__item", "__i"), (F.col("__hits") + F.col("__h")).alias("__hits"))
    return out.withColumn("__contaminated", F.col("__item").isNotNull())
