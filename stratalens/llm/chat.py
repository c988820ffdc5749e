"""Chat formatting with a cumulative-snapshot collapse.

Loggers write a conversation again after each turn, so many logged conversations are prefixes of longer ones. Each turn
gets a 128-bit hash of (turn, role, text); the rolling hash of a prefix is the exclusive or of its turns' hashes, which
is order-aware because the turn number is hashed too, and which needs no list of turns: it is a running
aggregate. A conversation whose full hash is a shorter prefix of another one is dropped by an anti-join; of
conversations that are equal, the smallest conv_id stays. The rest is rendered.

A conversation may be long: running hashes go by blocks of BLOCK turns, then over the blocks. Prefix hashes are
distinct before the anti-join, so a very common first turn is one row on that side.

Defined results: rows with a null conv_id are ignored; a null turn counts as -1; null role or text count as
empty; repeated (conv_id, turn) rows all belong to the conversation, ordered by role and text, where exact repeats
count once; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with defaults, exact repeats once, and the hash halves h1 and h2."""
    rows = conversations.where("conv_id is not null").select(
        "conv_id", F.coalesce(F.col("turn").cast("bigint"), F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    digest = F.sha2(F.concat(F.col("turn").cast("string"), F.lit("|"), F.length("role").cast("string"), F.lit("|"), F.col("role"), F.col("text")), 256)
    half = lambda at: F.conv(F.substring(F.col("__d"), at, 15), 16, 10).cast("bigint")
    rows = rows.withColumn("__d", digest).dropDuplicates(["conv_id", "turn", "__d"])
    return rows.withColumns({"h1": half(1), "h2": half(16)}).drop("__d")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, turn, p1, p2: the rolling hash of all rows up to and including the turn."""
    by_turn = turns.groupBy("conv_id", "turn").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    by_turn = by_turn.withColumn("__block", F.floor(F.col("turn") / BLOCK))
    blocks = by_turn.groupBy("conv_id", "__block").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"))
    before = Window.partitionBy("conv_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "__block", F.coalesce(F.bit_xor("b1").over(before), F.lit(0)).alias("b1"), F.coalesce(F.bit_xor("b2").over(before), F.lit(0)).alias("b2"))
    upto = Window.partitionBy("conv_id", "__block").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    inside = by_turn.select("conv_id", "__block", "turn", F.bit_xor("h1").over(upto).alias("i1"), F.bit_xor("h2").over(upto).alias("i2"))
    return inside.join(blocks, ["conv_id", "__block"]).select("conv_id", "turn", F.col("i1").bitwiseXOR(F.col("b1")).alias("p1"), F.col("i2").bitwiseXOR(F.col("b2")).alias("p2"))


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies, p1, p2 of the conversations that no other one extends; of equal ones the smallest id."""
    turns = turns_of(conversations)
    whole = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.max("turn").alias("last"), F.bit_xor("h1").alias("p1"), F.bit_xor("h2").alias("p2"))
    single = whole.groupBy("last", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.min("n_turns").alias("n_turns"), F.count("*").alias("copies"))
    prefixes = prefix_hashes(turns).join(whole.select("conv_id", "last"), "conv_id").where("turn < last")
    prefixes = prefixes.select(F.col("turn").alias("last"), "p1", "p2").distinct()
    return single.join(prefixes, ["last", "p1", "p2"], "left_anti")


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def render(conversations: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, copies, rendered (the turns in order in the chat template)."""
    kept = maximal(conversations).select("conv_id", "n_turns", "copies")
    turns = turns_of(conversations).join(kept, "conv_id")
    part = F.struct("turn", "role", "text")
    lists = turns.groupBy("conv_id", "n_turns", "copies").agg(F.array_sort(F.collect_list(part)).alias("__t"))
    return lists.select("conv_id", "n_turns", "copies", F.array_join(F.transform("__t", lambda t: rendered_turn(t["role"], t["text"])), "").alias("rendered"))
