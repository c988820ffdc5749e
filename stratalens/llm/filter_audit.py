"""Audit of how filters interact, over every order in which they can run.

Each document gives a mask of the filters that it fails, whatever their order. Documents are counted by (part, mask): at most 2^f cells a
part tell everything about any order. The orders are visited by adjacent transpositions (plain changes): one swap of neighbours leads
from an order to the next, so that only the two swapped steps are worked out anew, from the mask cells; the other steps' figures stand. A filter's
Shapley total gathers along the walk: what a step removes counts once for each order through which it stands.

Everything up to the cells is a DataFrame plan: the filters on texts are expressions, equal texts meet as digests (SHA-256 and length) with
partial aggregation, and no row holds more than the cells of one part. The walk runs part by part in ``mapInArrow``.

Defined results: null texts are empty; null languages are the part '' and meet documents whose language is the empty string; a null doc_id is never
smaller than another and has none smaller; equal doc_ids are not smaller than each other; labels of one doc_id
count as 1 where any is 1; documents without labels are neither good nor toxic; repeated rows count one by one; an empty table
has no parts and no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.llm import shared

WORD_BREAK = r"[\x20\x09-\x0D]+"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SIGNS = 200, 50, 3, "[#$%&*|]"
TALLIES = ("n", "good", "toxic")
OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that a text decides alone, by letter."""
    words = F.array_remove(F.split(text, WORD_BREAK), "")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < MIN_DISTINCT * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > MAX_CAPITALS * F.char_length(text).cast("long"),
        "D": text.rlike(SIGNS),
    }


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit k: fails the k-th filter of A to E), n, good, toxic."""
    text = F.coalesce(F.col("text"), F.lit(""))
    fails = text_filters(text)
    own = sum((F.when(c, F.lit(1 << k)).otherwise(0) for k, c in enumerate(fails.values())), F.lit(0))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), own.alias("mask"), F.sha2(text, 256).alias("digest"), F.octet_length(text).alias("size"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("int(quality <=> 1)")).alias("good"), F.max(F.expr("int(toxic <=> 1)")).alias("toxic"))
    marked = rows.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    # rows of one doc_id first, so that those with a text's smallest doc_id can be told from the others without gathering its copies
    one = marked.groupBy("digest", "size", "doc_id", "part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    alike = one.groupBy("digest", "size", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest", "size"))
    spared = F.col("nameless") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0)
    split = alike.withColumn("spared", spared).select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask"), F.col("spared").alias("c")), F.struct((F.col("mask") + (1 << len(fails))).alias("mask"), (F.col("n") - F.col("spared")).alias("c")))).alias("x"))
    return split.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.c").alias("n"), F.sum(F.col("x.c") * F.col("good")).alias("good"), F.sum(F.col("x.c") * F.col("toxic")).alias("toxic"))


def plain_changes(n: int) -> Iterator[int]:
    """Places i of the swaps (i, i + 1) that lead through all n! orders: the last item sweeps to and fro, the others move by one swap in between."""
    if n < 2:
        return
    others, front = plain_changes(n - 1), False
    while True:
        yield from range(n - 1) if front else range(n - 2, -1, -1)
        front = not front
        swap = next(others, None)
        if swap is None:
            return
        yield swap + front


def walk(names: Sequence[str], table: np.ndarray) -> Iterator[tuple]:
    """(order, step, filter, alive before and after the step in each tally) of all orders; ``table`` has the tallies by mask."""
    n = len(names)
    masks = np.arange(len(table))
    left = lambda gone: table[masks & gone == 0].sum(axis=0)  # noqa: E731  tallies of the documents that fail none of these filters
    order = list(range(n))
    alive, gone = [left(0)], 0
    for k in order:
        gone |= 1 << k
        alive.append(left(gone))
    swaps = plain_changes(n)
    while True:
        label = "".join(names[k] for k in order)
        yield from ((label, i, order[i], alive[i], alive[i + 1]) for i in range(n))
        i = next(swaps, None)
        if i is None:
            return
        order[i], order[i + 1] = order[i + 1], order[i]
        # steps i and i + 1 change; the filters up to i + 1 together are the same as before
        alive[i + 1] = left(sum(1 << k for k in order[: i + 1]))


def audited(names: Sequence[str]):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist()):
                table = np.zeros((1 << len(names), len(TALLIES)), np.int64)
                for c in found:
                    table[c["mask"]] = [c[t] for t in TALLIES]
                masks = np.arange(len(table))
                fails = [int(table[masks >> k & 1 == 1, 0].sum()) for k in range(len(names))]
                alone = [int(table[1 << k, 0]) for k in range(len(names))]
                shapley = [0] * len(names)
                rows = []
                for label, i, k, before, after in walk(names, table):
                    removed, good, toxic = (int(x) for x in before - after)
                    shapley[k] += removed
                    rows.append((k, label, i + 1, int(after[0]), removed, fails[k] - removed, alone[k], good, toxic))
                which, *columns = zip(*rows)
                types = [pa.string(), pa.int32(), *[pa.int64()] * 6]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(rows)), *(pa.array(c, t) for c, t in zip(columns, types)), pa.array([shapley[k] for k in which], pa.int64())],
                    [f.split(" ")[0] for f in OUT.split(", ")],
                )

    return apply


def audit(counted: DataFrame, names: Sequence[str] = "ABCDE") -> DataFrame:
    """All orders and steps of every part, from cells (part, mask, n, good, toxic)."""
    shared.ship(counted.sparkSession)
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *TALLIES)).alias("cells"))  # at most 2^f a part
    return parts.mapInArrow(audited(names), OUT)
