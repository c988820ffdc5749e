"""Sharding by a hierarchical weighted hash tree (region, rack, shard).

A row descends the tree from the root. At each level every child draws ``ln(u) / weight`` with
u uniform in (0, 1) from a hash of the row's key and the child's name; the largest draw wins, so a child is
taken in proportion to its weight (weighted rendezvous hashing). A draw depends on nothing but the key, the child
and the child's weight. A change of one leaf's weight therefore alters the draws of this leaf and its ancestors
only: rows move within, into or out of those subtrees, and never between two others. A leaf that is added as a
region of its own takes rows only into itself.

Everything is a DataFrame expression: no shuffle is needed to place a row. ``slots`` numbers the rows of
each shard without gaps in two steps (counts by shard and hash bucket, then ranks inside a bucket), so that no task
holds a whole shard.

Defined results: a null key draws as the text 'null'; null and empty texts have size 1 and
checksum 0; repeated rows keep one slot each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash buckets per shard for numbering; counts of at most shards * BUCKETS rows are joined back.
BUCKETS = 1024


@dataclass(frozen=True)
class Node:
    """A leaf has a shard number and a weight; an inner node has children, and their sum as its weight."""

    name: str
    children: tuple["Node", ...] = ()
    shard: int = -1
    leaf_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.leaf_weight


def topology(shards: int, racks_per_region: int = 2, shards_per_rack: int = 2, base: int = 8) -> Node:
    """The first ``base`` shards fill regions of racks; each later shard is a region of its own, so that it takes
    rows only into itself."""
    regions: dict[str, dict[str, list[Node]]] = {}
    for s in range(shards):
        region, rack = (f"r{s // (racks_per_region * shards_per_rack)}", f"k{s // shards_per_rack}") if s < base else (f"x{s}", f"y{s}")
        regions.setdefault(region, {}).setdefault(rack, []).append(Node(f"s{s}", shard=s))
    return Node("root", tuple(Node(r, tuple(Node(k, tuple(leaves)) for k, leaves in racks.items())) for r, racks in regions.items()))


def uniform(key: Column, node: str) -> Column:
    """(0, 1) with 52 bits from the md5 of key and node."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("null")), F.lit(node))), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def placed(df: DataFrame, key: str, tree: Node, into: str) -> DataFrame:
    """The draws are taken once a row, then compared level by level."""
    names: dict[str, str] = {}

    def walk(node: Node) -> None:
        for i, c in enumerate(node.children):
            if len(node.children) > 1:
                names[c.name] = f"__draw_{len(names)}"
            walk(c)

    walk(tree)
    weights = {}

    def weigh(node: Node) -> None:
        for c in node.children:
            weights[c.name] = c.weight
            weigh(c)

    weigh(tree)
    drawn = df.withColumns({col: F.ln(uniform(F.col(key), n)) / F.lit(float(weights[n])) for n, col in names.items()})

    def pick(node: Node) -> Column:
        if not node.children:
            return F.lit(node.shard)
        if len(node.children) == 1:
            return pick(node.children[0])
        best = F.greatest(*[F.col(names[c.name]) for c in node.children])
        out = pick(node.children[-1])
        for c in node.children[-2::-1]:
            out = F.when(F.col(names[c.name]) == best, pick(c)).otherwise(out)
        return out

    return drawn.withColumn(into, pick(tree).cast("int")).drop(*names.values())


def slots(rows: DataFrame, shard: str, key: str, order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Number each shard's rows from 0 without gaps, by (hash bucket, order)."""
    b = rows.withColumn("__bucket", F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int"))
    counts = b.groupBy(shard, "__bucket").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col(shard), F.col("__bucket"), F.coalesce("__before", F.lit(0)).alias("__before"))
    ranked = b.withColumn("__rank", F.row_number().over(Window.partitionBy(shard, "__bucket").orderBy(*order)))
    # at most (shards * buckets) rows: a proven bound
    joined = ranked.join(F.broadcast(before), [shard, "__bucket"])
    return joined.withColumn("slot", (F.col("__before") + F.col("__rank") - 1).cast("long")).drop("__bucket", "__before", "__rank")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document under the law ``key``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    rows = placed(rows, "doc_id", topology(shards), "shard")
    rows = placed(rows, "doc_id", topology(shards + 1), "grown_shard")
    out = slots(rows, "shard", "doc_id", ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
