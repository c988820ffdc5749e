"""Merkle manifest of a table: a hash tree over its rows, with a proof for each.

Rows are leaves of their group's tree, in the order of their id; the groups' roots are the leaves of a last tree. At every level runs
of ``fanout`` nodes become the digest of their digests, put together as hex text; a last run may be shorter.

Superblock reduction: with a block of fanout^k nodes, ``applyInPandas`` takes one block (group, position div fanout^k), collapses k levels in it and gives each of
its nodes the steps up to the block's root. The blocks' roots are the next round's nodes, so that n leaves take
log n / log(block) rounds; each round is written to the shared folder. A leaf's proof is the lower steps of its own block and
the upper steps of the block's root, joined by block, from the last round down.

A step of a proof holds the siblings before and after a node, as text; folding a proof is an aggregation over its steps.

Defined results: nulls have a digest of their own in every column; a null group comes first, then groups by UTF-8 bytes; null ids come first in their group;
rows with one id are ordered by their digest, so that equal rows may change places without effect; empty and long texts are hashed whole; an
empty table has no rows and no root; a table with one row has its leaf as root and an empty proof; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.llm import shared

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<before:string,after:string>>"
#: Levels that one round collapses.
LEVELS = 8


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def group_key(value: Column) -> Column:
    """A text without nulls in the order of the groups: null first, then by UTF-8 bytes."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value.cast("string")))


def placed(rows: DataFrame, order: Sequence[str], root: str) -> DataFrame:
    """pos (from 0) and n of each row in its group ``g``: a range exchange sorts the rows, and ranks in a range are added to
    the counts of the group's earlier ranges."""
    by = [F.col("g"), *(F.col(c).asc_nulls_first() for c in order)]
    ranged = shared.written(rows.repartitionByRange(*by, F.col("tie")).withColumn("range", F.spark_partition_id()), root)
    counts = ranged.groupBy("g", "range").agg(F.count("*").alias("c"))
    group = Window.partitionBy("g")
    before = counts.select("g", "range", (F.sum("c").over(group.orderBy("range")) - F.col("c")).alias("before"), F.sum("c").over(group).alias("n"))
    inside = ranged.withColumn("rank", F.row_number().over(Window.partitionBy("g", "range").orderBy(*by[1:], "tie")))
    return inside.join(before, ["g", "range"]).withColumn("pos", F.col("before") + F.col("rank") - 1).drop("range", "rank", "before", "tie")


def collapsed(fanout: int, levels: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def collapse(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos", ignore_index=True)
        single = int(block["n"].iloc[0]) <= fanout**levels  # the group's only block: up to its root
        now, at = block["digest"].tolist(), list(range(len(block)))
        steps: list[list[dict]] = [[] for _ in at]
        for _ in range(levels):
            if single and len(now) == 1:
                break
            sides = []
            for i in range(len(now)):
                first = i - i % fanout
                sides.append({"before": "".join(now[first:i]), "after": "".join(now[i + 1 : first + fanout])})
            for leaf, i in enumerate(at):
                steps[leaf].append(sides[i])
            now = [hashlib.sha256("".join(now[i : i + fanout]).encode()).hexdigest() for i in range(0, len(now), fanout)]
            at = [i // fanout for i in at]
        return block.assign(steps=steps, top=now[0])

    return collapse


def reduced(nodes: DataFrame, fanout: int, levels: int, root: str) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """Roots (g, digest) of all groups, and each round's (nodes with steps, nodes that already were their group's root)."""
    size, rounds, done = fanout**levels, [], []
    while True:
        single, more = nodes.where("n = 1"), nodes.where("n > 1").withColumn("block", F.expr(f"pos div {size}"))
        done.append(single.select("g", "digest"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in more.schema) + f", steps {STEPS}, top string"
        blocks = shared.written(more.groupBy("g", "block").applyInPandas(collapsed(fanout, levels), schema), f"{root}/round{len(rounds)}")
        rounds.append((blocks, single))
        if blocks.isEmpty():
            break
        nodes = blocks.where(f"pos % {size} = 0").select("g", F.col("block").alias("pos"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("top").alias("digest"))
    roots = done[0]
    for d in done[1:]:
        roots = roots.union(d)
    return roots, rounds


def proved(rounds: list[tuple[DataFrame, DataFrame]], above: DataFrame) -> DataFrame:
    """The first round's nodes with the steps from each to the last root; ``above`` has what follows a group's root: g, upper (steps) and further columns."""
    carried = [c for c in above.columns if c not in ("g", "upper")]
    below = None
    for blocks, single in reversed(rounds):
        ends = single.join(above, "g").withColumnRenamed("upper", "steps")
        if below is not None:
            lower = blocks.drop("n", "top").withColumnRenamed("block", "up")
            upper = below.select(F.col("g"), F.col("pos").alias("up"), F.col("steps").alias("upper"), *carried)
            inner = lower.join(upper, ["g", "up"]).withColumn("steps", F.concat("steps", "upper")).drop("up", "upper")
            ends = ends.drop("n").unionByName(inner)
        below = ends.drop("n")
    return below


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf's digest leads to."""
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def siblings(steps: Column) -> Column:
    """A proof's siblings level by level, from left to right, as one text."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(rows: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "lang", variants: dict[str, Sequence[Column]] | None = None, fanout: int = 2, levels: int = LEVELS) -> DataFrame:
    """key, leaf, subroot, root, steps (the proof) of every row. ``variants`` names further digests of a row that are carried along, such as that of
    an altered row."""
    spark = rows.sparkSession
    shared.bounded_batches(spark, rows=10_000)
    root = shared.fresh_dir(spark, "merkle")
    others = {name: digest(values) for name, values in (variants or {}).items()}
    leaves = rows.select(F.col(key).alias("key"), group_key(F.col(group)).alias("g"), digest([F.col(f) for f in fields]).alias("digest"), *(c.alias(n) for n, c in others.items()))
    leaves = shared.written(leaves, f"{root}/leaves").withColumn("tie", F.monotonically_increasing_id())
    nodes = placed(leaves, ["key", "digest"], f"{root}/ranges").withColumn("key", F.col("key").cast("string"))  # pandas has no whole numbers with nulls
    roots, rounds = reduced(nodes, fanout, levels, f"{root}/rows")
    # the groups' roots are one more group of nodes
    tops = shared.written(roots.select(F.lit("").alias("g"), F.col("g").alias("key"), "digest", F.lit(0).alias("tie")), f"{root}/roots")
    last, last_rounds = reduced(placed(tops, ["key"], f"{root}/root-ranges"), fanout, levels, f"{root}/groups")
    end = last.select("g", F.col("digest").alias("root"), F.array().cast(STEPS).alias("upper"))
    groups = proved(last_rounds, end).select(F.col("key").alias("g"), F.col("digest").alias("subroot"), "root", F.col("steps").alias("upper"))
    out = proved(rounds, shared.written(groups, f"{root}/above"))
    return out.select(F.col("key").cast(rows.schema[key].dataType).alias(key), F.col("digest").alias("leaf"), "subroot", "root", "steps", *others)
