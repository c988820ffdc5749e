"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is an aggregation and a join on a node. A node's smallest neighbour is found by partial aggregation; the edges of nodes that have very
many get it by a broadcast of at most MOST_HUBS rows where they lie, so that no task gets all of a node's edges. Steps are written
to the shared folder, which cuts the lineage; the number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens import storage

#: A node is a hub from so many edges on, and from this part of all edges on; so there are fewer hubs than MOST_HUBS.
HUB_EDGES, MOST_HUBS = 10_000, 10_000


def _least(rows: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """rows (u, v) with m, the smallest v of their u; and (u, m) of every u."""
    low = storage.written(rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), path)
    total, most = low.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    limit = max(HUB_EDGES, total // MOST_HUBS)
    if most <= limit:
        return rows.join(low.select("u", "m"), "u"), low
    hubs = F.broadcast(low.where(F.col("n") > limit).select("u", "m"))
    rest = rows.join(hubs, "u", "left_anti").join(low.where(F.col("n") <= limit).select("u", "m"), "u")
    return rows.join(hubs, "u").unionByName(rest), low


def _large(edges: DataFrame, path: str) -> DataFrame:
    """Each node hands its smallest neighbour (or itself) to its larger neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both, path)[0].where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))


def _small(edges: DataFrame, path: str) -> DataFrame:
    """Each node hands its smallest neighbour to its other smaller neighbours and itself."""
    found, low = _least(edges, path)
    return found.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))


def _directed(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node that it reaches) of all nodes with an edge to another node."""
    spark = edges.sparkSession
    root = storage.fresh_dir(spark, "components")
    now = storage.written(_directed(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))), f"{root}/0")
    state = None
    for k in range(1, max_rounds + 1):
        half = storage.written(_directed(_large(now, f"{root}/{k}-low")), f"{root}/{k}-large")
        storage.remove(spark, f"{root}/{k}-low", f"{root}/{k - 1}")
        now = storage.written(_directed(_small(half, f"{root}/{k}-least")), f"{root}/{k}")
        storage.remove(spark, f"{root}/{k}-least", f"{root}/{k}-large")
        new = tuple(now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components didn't settle")
    # stars now: every node points at its component's smallest node
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def node_components(nodes: DataFrame, edges: DataFrame, node: str, a: str, b: str) -> DataFrame:
    """node, component of all nodes; one without edges is its own component."""
    found = components(edges, a, b).withColumnRenamed("node", node)
    return nodes.select(node).distinct().join(found, node, "left").select(node, F.coalesce("component", node).alias("component"))
