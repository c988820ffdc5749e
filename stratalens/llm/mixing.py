"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain, language, source. A node's budget goes to its children in proportion to their weights; a child
takes no more than it holds (its tokens times ``max_epochs``), and what it can't take goes to its siblings by their
weights. Since a node never gets more than its subtree holds, a shortage is met by siblings first and reaches the
ancestors' siblings only when a whole subtree is used up. Budgets are whole tokens.

A leaf with budget B over T tokens runs B // T whole epochs, then the prefix of the next epoch with at most B % T tokens, in the
order of a hash of (seed, epoch, doc_id). The end of the prefix is found from sums by hash range, then inside one range
only, so no task sorts a whole leaf; a row is then chosen by comparing its hash with its leaf's end, without a shuffle of texts.

Defined results: null tree columns count as ''; a null text has no tokens; rows with equal doc_id are taken or left together
within a leaf; texts without tokens are taken when their hash lies in the prefix; an empty table gives no rows; further columns are kept.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.llm import shared

LEVELS = ("domain", "lang", "source")
RANGES = 10  # bits: 1024 hash ranges a leaf
MAX_BROADCAST_LEAVES = 50_000
#: The production target: weights of domains and languages; all else weighs 1 among its siblings.
WEIGHTS = {("d0",): 4, ("d1",): 3, ("d2",): 2, ("d3",): 1} | {(f"d{d}", lang): w for d in range(4) for lang, w in (("en", 5), ("de", 2), ("fr", 2), ("es", 1))}


def tokens(text: Column) -> Column:
    """Words between white space."""
    inner = F.btrim(text, F.lit(" \t\n\r\f\x0b"))
    return F.when(F.length(inner) > 0, F.size(F.split(inner, r"\s+"))).otherwise(0).cast("long")


def domain(source: Column) -> Column:
    """Four domains of sources, by the crc32 of the source's name."""
    return F.concat(F.lit("d"), (F.crc32(F.coalesce(source, F.lit("")).cast("binary")) % 4).cast("string"))


def pour(budget: int, children: list[tuple[str, Fraction, int]]) -> dict[str, int]:
    """Share a budget among (name, weight, capacity) by weight; what one can't hold goes to the others."""
    out = {name: 0 for name, _, _ in children}
    budget = min(budget, sum(c for _, w, c in children if w > 0))
    left, active = budget, [x for x in children if x[1] > 0]
    while active:
        total = sum(w for _, w, _ in active)
        full = [x for x in active if x[2] <= left * x[1] / total]
        if not full:
            parts = [(name, left * w / total) for name, w, _ in active]
            for name, part in parts:
                out[name] = int(part)
            rest = left - sum(int(part) for _, part in parts)
            for name, _ in sorted(parts, key=lambda x: (int(x[1]) - x[1], x[0]))[:rest]:
                out[name] += 1
            break
        for name, _, capacity in full:
            out[name] = capacity
            left -= capacity
        active = [x for x in active if x not in full]
    return out


def budgets(leaves: Mapping[tuple[str, ...], int], budget: int, weights: Mapping[tuple[str, ...], float], max_epochs: int) -> dict[tuple[str, ...], int]:
    """Tokens to take from each leaf (path -> tokens it has)."""
    below: dict[tuple[str, ...], int] = defaultdict(int)
    kids: dict[tuple[str, ...], set] = defaultdict(set)
    for path, n in leaves.items():
        for k in range(len(path) + 1):
            # a child of weight 0 takes nothing, so it holds nothing for its ancestors
            if all(weights.get(path[:j], 1) > 0 for j in range(k + 1, len(path) + 1)):
                below[path[:k]] += n * max_epochs
        for k in range(len(path)):
            kids[path[:k]].add(path[: k + 1])
    out = {}

    def go(path: tuple[str, ...], amount: int) -> None:
        if path in leaves and path not in kids:
            out[path] = amount
            return
        shares = pour(amount, [(c, Fraction(str(weights.get(c, 1))), below[c]) for c in sorted(kids[path])])
        for child, share in shares.items():
            go(child, share)

    go((), min(budget, below[()]))
    return out


def position(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.xxhash64(F.lit(seed), epoch.cast("int"), doc_id).bitwiseAND(F.lit((1 << 63) - 1))


def mix(docs: DataFrame, share: float, weights: Mapping[tuple[str, ...], float] = WEIGHTS, max_epochs: int = 4, seed: int = 7, domain_col: Column | None = None) -> DataFrame:
    """The documents' columns with __domain, __n (tokens) and __epoch, a row for each time that a document is taken; the budget is ``share`` of all tokens."""
    spark = docs.sparkSession
    leaf = {"__domain": F.coalesce(domain(F.col("source")) if domain_col is None else domain_col, F.lit("")), "__lang": F.coalesce("lang", F.lit("")), "__source": F.coalesce("source", F.lit(""))}
    keys = list(leaf)
    path = shared.fresh_dir(spark, "mixing")
    facts = docs.withColumns(leaf).select("doc_id", *keys, tokens(F.col("text")).alias("n"))
    facts = shared.written(facts, path)
    totals = facts.groupBy(*keys).agg(F.sum("n").alias("total")).collect()  # one row per leaf
    have = {tuple(r[k] for k in keys): r["total"] for r in totals}
    plan = budgets(have, int(Fraction(str(share)) * sum(have.values())), weights, max_epochs)
    rows = [(*p, b // have[p] if have[p] else 0, b % have[p] if have[p] else 0) for p, b in plan.items()]
    table = spark.createDataFrame(rows, ", ".join(f"`{k}` string" for k in keys) + ", whole int, rest long")
    small = len(rows) <= MAX_BROADCAST_LEAVES
    side = (lambda x: F.broadcast(x)) if small else (lambda x: x)
    u = position(seed, F.col("whole"), F.col("doc_id"))
    at = facts.join(side(table), keys).withColumn("u", u).withColumn("range", F.shiftright("u", 63 - RANGES).cast("int"))
    sums = at.groupBy(*keys, "rest", "range").agg(F.sum("n").alias("n"))
    run = Window.partitionBy(*keys).orderBy("range")
    sums = sums.withColumn("upto", F.sum("n").over(run))
    # the first range that the prefix doesn't hold whole; where it holds all, the end is open
    cut = sums.where("upto > rest").groupBy(*keys).agg(F.min_by(F.struct("range", (F.col("upto") - F.col("n")).alias("before")), "range").alias("c"))
    cut = cut.select(*keys, F.col("c.range").alias("range"), F.col("c.before").alias("before"))
    inside = at.join(side(cut), [*keys, "range"])
    order = Window.partitionBy(*keys).orderBy("u", "doc_id")  # a 1024th of a leaf
    inside = inside.withColumn("upto", F.col("before") + F.sum("n").over(order)).where("upto <= rest")
    ends = inside.groupBy(*keys).agg(F.max(F.struct("u", "doc_id")).alias("end"))
    final = table.join(cut.select(*keys, "range"), keys, "left").join(ends, keys, "left")
    final = final.select(*keys, "whole", F.col("range").alias("__range"), F.col("end").alias("__end")).withColumnRenamed("whole", "__whole")
    final = spark.createDataFrame(final.collect(), final.schema)  # one row per leaf
    chosen = docs.withColumns(leaf | {"__n": tokens(F.col("text"))}).join(side(final), keys)
    v = position(seed, F.col("__whole"), F.col("doc_id"))
    taken = F.col("__range").isNull() | (F.shiftright(v, 63 - RANGES) < F.col("__range")) | F.coalesce(F.struct(v.alias("u"), F.col("doc_id").alias("doc_id")) <= F.col("__end"), F.lit(False))
    epochs = F.when(taken, F.sequence(F.lit(0), F.col("__whole"))).otherwise(F.when(F.col("__whole") > 0, F.sequence(F.lit(0), F.col("__whole") - 1)))
    return chosen.withColumn("__epoch", F.explode(epochs)).select(*docs.columns, "__domain", "__n", "__epoch")
