"""Line dedup by an exact set-similarity join.

A line is the set of its words (between white space, A-Z lower-cased). A line is removed when an earlier line, by (doc_id, the
text's hash, line number), has a Jaccard similarity of at least 0.8 with it. Lines without words stay.

1.  Words are counted over all texts in SLOTS slots of their hash. A line's words are ordered by the level of their slot's count, from rare
    to frequent, then by hash. Any order that depends on the word alone gives the same result.
2.  Lines with the same set become one class, named by its first line; so repeated lines, however common, are one row in the join.
3.  Prefix filter: similar sets share a word among the first n - ceil(0.8 n) + 1. The shorter side needs only its
    first n - ceil(8 n / 9) + 1 words. Length filter: 0.8 n <= m. Positional filter: with a shared word at
    positions i and j, min(n - i, m - j) must reach the overlap that 0.8 asks for. A sketch of 64 parity bits bounds the
    sets' difference from below.
4.  Candidates are verified on the words of the lines themselves.
5.  Before the join, each class is compared with the first class that has the same smallest hash of a word, and the same largest. In a
    large group of near copies that removes nearly all of them, and the join passes over pairs of which both are removed already, so a
    group isn't expanded into all its pairs.

All steps are DataFrame functions. Two tables of fixed size ride in the plan as literals: the levels of the SLOTS slots, and the bits of
LINE_BITS slots of lines that verification asks for.

Defined results: null and empty texts have one line without words; rows with a null doc_id neither remove nor lose lines;
repeated rows with one doc_id and text count as one document; different texts with one doc_id are documents of their own, in the
order of their hash; an empty table gives no rows; further columns are ignored. Memory: a text and its lines.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.llm import shared

#: Slots of the words' counts, and the factor between the levels 0 to 9 of a slot's count.
SLOT_BITS, STEP = 19, 4
SLOTS = 1 << SLOT_BITS
#: Lines of so many words have a sketch of 128 bits, others of 64.
WIDE = 64
#: Bits of the filter on the lines that are fetched for verification: a fixed size, six a sign.
LINE_BITS = 6 << 18
#: Letters and signs outside A-Z that have a lower case: lower() would change them, and only A-Z counts.
CASED = r"[[^\x00-\x7F]&&[\p{Lu}\p{Lt}\p{Nl}\p{So}]]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ID = ["doc_id", "h", "line_no"]
#: A line's place: its identity where a doc_id has one text.
AT = ["doc_id", "line_no"]


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, h, text: a document is its id and its text's hash."""
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")


def plain(word: Column) -> Column:
    """A word with A-Z lower-cased."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).when(word.rlike(CASED), F.translate(word, UPPER, LOWER)).otherwise(F.lower(word))


def spaced(text: Column) -> Column:
    """Blanks in place of other white space within a line."""
    odd = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\f")) | F.contains(text, F.lit("\r"))
    return F.when(odd, F.regexp_replace(text, r"[\t\x0B\f\r]", " ")).otherwise(text)


def words(line: Column) -> Column:
    """The words of a ``spaced`` line, A-Z lower-cased, with empty ones where blanks are doubled. They are looked at one by one only where lower() may change more than A-Z."""
    low = F.lower(line)
    same = (F.octet_length(line) == F.char_length(line)) | (low == line) | ~line.rlike(CASED)
    return F.when(same, F.split(low, " ")).otherwise(F.transform(F.split(line, " "), plain))


def word_set(line: Column) -> Column:
    return F.array_remove(F.array_distinct(words(line)), "")


def signs(values: DataFrame, size: int) -> str:
    """One ASCII sign for each slot below ``size``: that of ``values`` (slot, sign), else 0."""
    every = values.sparkSession.range(size).withColumnRenamed("id", "slot").join(values, "slot", "left").select("slot", F.coalesce("sign", F.lit("0")).alias("sign"))
    pieces = every.groupBy(F.expr("slot div 4096").alias("piece")).agg(F.array_sort(F.collect_list(F.struct("slot", "sign"))).alias("s"))
    return "".join(r["s"] for r in pieces.select("piece", F.array_join(F.col("s.sign"), "").alias("s")).orderBy("piece").collect())  # size / 4096 rows


def levels(texts: DataFrame) -> str:
    """A digit for each slot of word hashes: how often its words occur, on a scale of powers of STEP from a hundredth of the mean on. Words are
    cut at blanks and line feeds alone here: the digits order words, no result depends on them."""
    slot = F.shiftrightunsigned(F.xxhash64(plain(F.col("word"))), 64 - SLOT_BITS).cast("int")
    counts = texts.select(F.explode_outer(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("word")).groupBy(slot.alias("slot")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # SLOTS rows
    unit = F.greatest(F.lit(16.0), total / (100.0 * SLOTS))
    level = F.least(F.lit(9), F.greatest(F.lit(0), F.floor(F.log(F.col("n") / unit) / math.log(STEP)) + 1))
    return signs(counts.select(F.col("slot").cast("long").alias("slot"), level.cast("int").cast("string").alias("sign")), SLOTS)


def parity(hashes: Column) -> Column:
    """64 bits: how many words have each, modulo 2. A shift counts modulo 64."""
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.hash(h))))


def split_lines(docs: DataFrame, table: str) -> DataFrame:
    """One row for each line: its size (0 without words), fingerprints, sketch, extreme hashes and prefix. No condition on the words stands here or
    in ``levels``, as the optimizer would move it below and split each text twice; so the generators are outer ones."""
    level = F.split(F.lit(table), "").cast("array<tinyint>")  # a literal once the plan is optimized

    def key(h: Column) -> Column:
        return F.shiftleft(F.get(level, F.shiftrightunsigned(h, 64 - SLOT_BITS).cast("int")).cast("long"), 59).bitwiseOR(F.shiftrightunsigned(h, 5))

    each = docs.select("doc_id", "h", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
    each = each.select(*ID, spaced(F.col("line")).alias("line"))
    each = each.select(*ID, F.transform(word_set(F.col("line")), lambda w: F.xxhash64(w)).alias("hashes"))
    each = each.select(*ID, "hashes", F.size("hashes").alias("n"), F.sort_array(F.transform("hashes", key)).alias("keys"))
    return each.select(
        *ID, "n", F.xxhash64("keys").alias("f1"), F.xxhash64(F.lit(1), "keys").alias("f2"),
        F.when(F.col("n") < WIDE, parity(F.col("hashes"))).otherwise(parity(F.filter("hashes", lambda h: h.bitwiseAND(F.lit(64)) == 0))).alias("sketch"),
        F.when(F.col("n") < WIDE, F.lit(0).cast("long")).otherwise(parity(F.filter("hashes", lambda h: h.bitwiseAND(F.lit(64)) != 0))).alias("more"),
        F.array(F.array_min("hashes"), F.array_max("hashes")).alias("lows"),
        F.slice("keys", 1, F.expr("n - (80 * n + 99) div 100 + 1").cast("int")).alias("prefix"),
    ).withColumn("prefix", F.transform("prefix", lambda k: F.hash(k)))


def least(n: str, m: str) -> str:
    """The overlap that a similarity of 0.8 needs."""
    return f"((80 * ({n} + {m}) + 179) div 180)"


def possible(n: str, m: str, x: str, y: str) -> Column:
    """Sizes and sketches (columns of x and of y) that allow a similarity of 0.8. Sets differ by at least as many words as their sketches by bits."""
    s, t = f"{x}sketch ^ {y}sketch", f"{x}more ^ {y}more"
    bits = f"if(least({n}, {m}) >= {WIDE}, bit_count({s}) + bit_count({t}), bit_count({s} ^ {t}))"
    return F.expr(f"100 * least({n}, {m}) >= 80 * greatest({n}, {m}) and {bits} <= {n} + {m} - 2 * {least(n, m)}")


def leaders(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of places: each class b with the first one, a, that has the same minimum hash, and each place of several classes with itself."""
    own = [*AT, "n", "sketch", "more"]
    rows = classes.select(F.posexplode("lows").alias("family", "low"), *own).select(F.xxhash64("family", "low").alias("k"), *own)
    first = rows.groupBy("k").agg(F.min(F.struct(*own)).alias("l"), F.count("*").alias("c")).where("c > 1").select("k", *(F.col(f"l.{c}").alias(f"l_{c}") for c in own))
    found = rows.join(first, "k").where("doc_id <> l_doc_id or line_no <> l_line_no").where(possible("n", "l_n", "", "l_"))
    pairs = found.select(F.col("l_doc_id").alias("a_doc"), F.col("l_line_no").alias("a_line"), F.col("doc_id").alias("b_doc"), F.col("line_no").alias("b_line"))
    # texts that share a doc_id have lines at one place; no later step tells these apart before it has their hashes
    shared_places = classes.groupBy(*AT).agg(F.count("*").alias("c")).where("c > 1").select("doc_id", "line_no", "doc_id", "line_no")
    return pairs.union(shared_places).distinct()


def candidates(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of places, a not after b, whose sets pass all filters and whose later one isn't gone. A side is cut to its own prefix before it is
    shuffled, as Spark doesn't share an exchange above a generator. A row's numbers are packed: line and size, place of the word and gone."""

    def side(s: str, most: str) -> DataFrame:
        rows = classes.select(*AT, "sketch", "more", "n", "gone", F.posexplode(F.slice("prefix", 1, F.expr(f"cast({most} as int)"))).alias("i", "word"))
        at = F.expr("shiftleft(cast(line_no as bigint), 32) | n")
        return rows.select("word", F.col("doc_id").alias(f"{s}_doc"), F.col("sketch").alias(f"{s}_sketch"), F.col("more").alias(f"{s}_more"), at.alias(f"{s}_at"), F.expr("i * 2 + if(gone, 1, 0)").alias(f"{s}_i"))

    n, i, line, gone = (lambda s: f"({s}_at & 2147483647)"), (lambda s: f"shiftright({s}_i, 1)"), (lambda s: f"shiftright({s}_at, 32)"), (lambda s: f"({s}_i & 1)")
    # of two texts of one doc_id the later is known by their hashes alone
    open_ = f"if(x_doc < y_doc, {gone('y')}, if(x_doc > y_doc, {gone('x')}, x_i & y_i & 1)) = 0"
    fits = (
        F.expr(f"({n('x')} < {n('y')} or {n('x')} = {n('y')} and (x_doc < y_doc or x_doc = y_doc and x_at < y_at)) and {open_}")
        & F.expr(f"least({n('x')} - {i('x')}, {n('y')} - {i('y')}) >= {least(n('x'), n('y'))}") & possible(n("x"), n("y"), "x_", "y_")
    )
    found = side("x", "n - (160 * n + 179) div 180 + 1").join(side("y", "n"), "word").where(fits)
    x, y = (f"{line(s)}" for s in "xy")
    first = F.expr(f"x_doc < y_doc or x_doc = y_doc and {x} <= {y}")
    pick = lambda p, q, name: F.when(first, F.expr(p)).otherwise(F.expr(q)).alias(name)
    return found.select(pick("x_doc", "y_doc", "a_doc"), pick(x, y, "a_line"), pick("y_doc", "x_doc", "b_doc"), pick(y, x, "b_line")).select("a_doc", F.col("a_line").cast("int").alias("a_line"), "b_doc", F.col("b_line").cast("int").alias("b_line")).distinct()


def line_filter(ids: DataFrame) -> Column:
    """Whether a line's slot holds a wanted one. Six bits a sign."""
    slot = F.pmod(F.xxhash64(*AT), F.lit(LINE_BITS)).cast("int")
    packed = ids.select(slot.alias("s")).distinct().groupBy(F.expr("s div 6").cast("long").alias("slot")).agg(F.bit_or(F.expr("shiftleft(1, s % 6)")).alias("bits"))
    table = signs(packed.select("slot", F.chr(F.lit(48) + F.col("bits")).alias("sign")), LINE_BITS // 6)
    sign = F.ascii(F.substring(F.lit(table.encode()), (F.floor(slot / 6) + 1).cast("int"), F.lit(1)).cast("string"))
    return F.call_function("shiftright", sign - 48, slot % 6).bitwiseAND(F.lit(1)) == 1


def verified(docs: DataFrame, pairs: DataFrame, path: str) -> DataFrame:
    """doc_id, h, line_no of the later lines of similar pairs. Where texts share a doc_id, a place means the lines of all of them."""
    ids = pairs.select(F.col("a_doc").alias("doc_id"), F.col("a_line").alias("line_no")).union(pairs.select("b_doc", "b_line")).distinct()
    ids = shared.written(ids, f"{path}-ids")
    each = docs.where("doc_id is not null").select("doc_id", "h", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = shared.written(each.where(line_filter(ids)).join(ids, AT).select(*ID, spaced(F.col("line")).alias("line")).distinct(), f"{path}-lines")
    side = lambda s: lines.select(F.col("doc_id").alias(f"{s}_doc"), F.col("line_no").alias(f"{s}_line"), F.struct(*ID).alias(s), F.col("line").alias(f"line_{s}"))
    both = pairs.join(side("b"), ["b_doc", "b_line"]).join(side("a"), ["a_doc", "a_line"]).where("a <> b")
    both = both.select(F.greatest("a", "b").alias("later"), word_set(F.col("line_a")).alias("s"), word_set(F.col("line_b")).alias("t"))
    both = both.select("later", (F.size("s") + F.size("t")).alias("total"), F.size(F.array_intersect("s", "t")).alias("common"))
    # written before the condition, which the optimizer would move into the join and split both lines several times for
    scores = shared.written(both, f"{path}-scores")
    shared.remove(docs.sparkSession, f"{path}-ids", f"{path}-lines")
    return scores.where("100 * common >= 80 * (total - common)").select("later.*").distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, h, line_no of all lines that an earlier one matches."""
    spark = docs.sparkSession
    root = shared.fresh_dir(spark, "line-dedup")
    docs = identified(docs)
    real = docs.where("doc_id is not null and text is not null")
    rows = shared.written(split_lines(real, levels(real)), f"{root}/lines").where("n > 0")
    # payload after the line's id: what a set gives is the same for all its lines
    first = F.min(F.struct(*ID, "sketch", "more", "lows", "prefix")).alias("c")
    classes = shared.written(rows.groupBy("f1", "f2", "n").agg(first).select("f1", "f2", "n", "c.*"), f"{root}/classes")
    # from here on the lines' sets are those of their classes: what a later step doesn't read doesn't stay on disk
    members = shared.written(rows.select(*ID, "f1", "f2", "n"), f"{root}/members")
    shared.remove(spark, f"{root}/lines")
    early = verified(docs, shared.written(leaders(classes), f"{root}/leaders"), f"{root}/early").withColumn("gone", F.lit(True))
    flagged = classes.drop("lows").join(early, ID, "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    pairs = shared.written(candidates(flagged), f"{root}/pairs")
    names = shared.written(classes.select("f1", "f2", "n", *ID), f"{root}/names")
    shared.remove(spark, f"{root}/classes")
    late = verified(docs, pairs, f"{root}/late").withColumn("gone", F.lit(True))
    # every line of a class that an earlier class matches goes; of the others all but the first go
    gone = early.union(late).distinct()
    state = names.join(gone, ID, "left").select("f1", "f2", "n", F.struct(*ID).alias("first"), F.coalesce("gone", F.lit(False)).alias("gone"))
    marked = members.join(state, ["f1", "f2", "n"])
    return marked.where(F.col("gone") | (F.struct(*ID) > F.col("first"))).select(*ID).distinct()


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (sorted line numbers) of every document."""
    gone = removed_lines(docs).groupBy("doc_id", "h").agg(F.array_sort(F.collect_list("line_no")).alias("removed"))  # lines of one document
    text = F.coalesce("text", F.lit(""))
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    counts = identified(docs).select("doc_id", "h", breaks.cast("long").alias("n_lines"))
    out = counts.join(gone, ["doc_id", "h"], "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents' columns with the remaining lines as text."""
    gone = removed_lines(docs).groupBy("doc_id", "h").agg(F.collect_set("line_no").alias("__gone")).withColumnsRenamed({"doc_id": "__id", "h": "__h"})
    joined = docs.join(gone, (docs.doc_id == F.col("__id")) & (F.xxhash64(F.coalesce(docs.text, F.lit(""))) == F.col("__h")), "left")
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("__gone", i))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn("text", text).select(*docs.columns)
