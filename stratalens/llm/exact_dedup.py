"""Exact dedup through an extendible-hash index on shared files; DataFrame functions only.

A text's key is the low ``key_bits`` bits of its normal form's hash. Keys are written first, with doc_id and sha256, and then:

1.  Directory. It starts with one bucket. As long as a bucket holds more than ``capacity`` different keys it is split by its next
    key bit, and the directory doubles when the bucket's depth is the directory's. The splits follow from the counts of keys per
    slot, at the depth that an even spread needs plus three bits; while a slot there is still overfull, the counts are taken
    three bits deeper, as far as keys have bits. A bucket is a contiguous range of keys.
2.  Insertion. Each row finds its bucket through the directory. Inside a bucket, rows of one key are compared by their bytes; each
    different text becomes one entry with the largest doc_id and the count of its rows.
3.  Chains. Owner tasks take ranges of buckets and keys and chain the entries that share a key. The index (bucket, key, chain, links,
    keep_id, group_size) and the directory lie in the shared folder.
4.  Look-up. A row goes through the directory to its bucket and key. A chain of one entry is the row's, as every row was inserted;
    in longer chains the row's bytes are compared with those of the entries.

Copies meet as one entry per map task and text (partial aggregation), so a text that a third of all rows share is not gathered
anywhere; looking up is an equi-join whose hot side Spark can split. The directory is broadcast up to MAX_BROADCAST slots only.

Defined results: null counts as the empty text; empty texts are equal; of equal texts the largest doc_id stays (null
ids lose); rows repeated with the same doc_id are all marked kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.llm import shared

KEY_BITS = 60
#: Keys per bucket before it splits.
CAPACITY = 1 << 14
#: Slots of a directory that is sent to every task, and colliding keys.
MAX_BROADCAST = 1 << 16


def normal(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty. ``lower`` does that, and faster, where there are no other signs than ASCII."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(whole) == F.length(whole), F.lower(whole)).otherwise(F.translate(whole, string.ascii_uppercase, string.ascii_lowercase))


def key_of(norm: Column, bits: int) -> Column:
    return F.xxhash64(norm).bitwiseAND(F.lit((1 << bits) - 1))


def slot_counts(keys: DataFrame, depth: int, bits: int) -> DataFrame:
    return keys.groupBy(F.shiftright("key", bits - depth).alias("slot")).agg(F.count("*").alias("n"))


def directory(keys: DataFrame, capacity: int = CAPACITY, bits: int = KEY_BITS) -> tuple[DataFrame, int]:
    """slot, depth, bucket of the slots in use, and the directory's depth; a slot is the first bits of a key, a bucket its first slot."""
    total = keys.count()
    depth = min(bits, max(0, math.ceil(math.log2(max(total, 1) / capacity))) + 3)
    while depth < bits and slot_counts(keys, depth, bits).where(F.col("n") > capacity).limit(1).count():
        depth = min(bits, depth + 3)
    levels = slot_counts(keys, depth, bits).select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(slot, {depth} - depth)"))
    sums = levels.groupBy("depth", "prefix").agg(F.sum("n").alias("keys"))
    fit = levels.join(sums, ["depth", "prefix"]).where(f"keys <= {capacity} or depth = {depth}")
    out = fit.groupBy("slot").agg(F.min("depth").alias("depth"))
    return out.select("slot", "depth", F.expr(f"shiftleft(shiftright(slot, {depth} - depth), {depth} - depth)").alias("bucket")), depth


class Index:
    """The written tables: directory, entries in chains, and the keys whose chains have several entries."""

    def __init__(self, slots: DataFrame, depth: int, entries: DataFrame, bits: int):
        self.slots, self.depth, self.entries, self.bits = slots, depth, entries, bits

    def routed(self, rows: DataFrame) -> DataFrame:
        """The rows with their bucket, through the directory."""
        side = self.slots.select("slot", "bucket")
        if side.count() <= MAX_BROADCAST:
            side = F.broadcast(side)
        return rows.withColumn("slot", F.shiftright("key", self.bits - self.depth)).join(side, "slot").drop("slot")


def texts_of(docs: DataFrame, bits: int) -> DataFrame:
    return docs.select("doc_id", normal(F.col("text")).alias("norm")).withColumn("key", key_of(F.col("norm"), bits))


def build_index(docs: DataFrame, rows: DataFrame, path: str, capacity: int = CAPACITY, bits: int = KEY_BITS) -> Index:
    """Write directory and index below ``path``. rows: the written keys of ``docs``."""
    keys = shared.written(rows.select("key").distinct(), f"{path}/keys")
    slots, depth = directory(keys, capacity, bits)
    index = Index(shared.written(slots, f"{path}/directory"), depth, keys, bits)
    # grouping inside bucket and key compares the bytes of the texts
    entries = index.routed(texts_of(docs, bits)).groupBy("bucket", "key", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    entries = shared.written(entries.select("bucket", "key", F.octet_length("norm").alias("n_bytes"), F.xxhash64(F.lit(1), "norm").alias("check"), "keep_id", "group_size"), f"{path}/entries")
    owners = entries.repartitionByRange("bucket", "key")
    chain = Window.partitionBy("bucket", "key")
    chained = owners.withColumns({"chain": F.row_number().over(chain.orderBy("n_bytes", "check", "keep_id")), "links": F.count("*").over(chain)})
    index.entries = shared.written(chained.select("bucket", "key", "chain", "links", "keep_id", "group_size"), f"{path}/index")
    shared.remove(docs.sparkSession, f"{path}/keys", f"{path}/entries")
    return index


def look_up(docs: DataFrame, rows: DataFrame, index: Index) -> DataFrame:
    """rows with bucket, chain, keep_id and group_size of their entries."""
    names = ["doc_id", "text_sha256", "bucket", "links", "keep_id", "group_size"]
    one = index.routed(rows).join(index.entries.where("links = 1"), ["bucket", "key"]).select(*names)
    several = index.entries.where("links > 1").select("bucket", "key", "links").distinct()
    n = several.count()
    if not n:
        return one
    keys = F.broadcast(several) if n <= MAX_BROADCAST else several
    own = index.routed(texts_of(docs, index.bits)).join(keys, ["bucket", "key"])
    same = own.groupBy("bucket", "key", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return one.union(own.join(same, ["bucket", "key", "norm"]).withColumn("text_sha256", F.sha2("norm", 256)).select(*names))


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, bits: int = KEY_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, bucket, links (entries of the row's chain): one row per document, dropped ones too."""
    docs = docs.select("doc_id", "text")
    path = path or shared.fresh_dir(docs.sparkSession, "exact-dedup")
    rows = shared.written(texts_of(docs, bits).select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256")), f"{path}/rows")
    found = look_up(docs, rows, build_index(docs, rows, path, capacity, bits))
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket", "links")
