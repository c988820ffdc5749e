"""A registry kept up to date: only the inputs whose facts changed are built anew, what went leaves a tombstone, and the version's digest depends on content only.

Facts are mapping rows (input, target, values); the view has the registry rows of each input. An increment compares the facts' digests by input, so the
view's unchanged rows are neither read by the builder nor written differently. The digest is a sum over the rows' hashes: it merges, doesn't depend on an
order, and is kept up by what an increment takes away and adds, so that any chain of increments ends in the digest of a full build.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens import storage

Builder = Callable[[DataFrame], DataFrame]
#: Parts of a row's sha256 that are summed, in hexadecimal digits each, and the modulus of the sums.
PARTS, DIGITS = 4, 15
MODULUS = 1 << 60


@dataclass(frozen=True)
class Version:
    """facts (input, target, values); view (rows with ``input``); tombstones (input, version); sums of the digest and their number of rows; the version's number."""

    facts: DataFrame
    view: DataFrame
    tombstones: DataFrame
    sums: tuple[int, ...]
    n_rows: int
    number: int

    @property
    def digest(self) -> str:
        return "-".join(f"{s:015x}" for s in self.sums) + f"-{self.n_rows}"


def row_sums(rows: DataFrame) -> tuple[tuple[int, ...], int]:
    """Sums of the rows' hash parts, and the number of rows: one row comes to the driver."""
    text = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    part = lambda k: F.conv(F.substring(F.sha2(text, 256), 1 + DIGITS * k, DIGITS), 16, 10).cast("decimal(20,0)")
    r = rows.agg(F.count("*").alias("n"), *(F.sum(part(k)).alias(f"s{k}") for k in range(PARTS))).first()
    return tuple(int(r[f"s{k}"] or 0) % MODULUS for k in range(PARTS)), r["n"]


def fact_digests(facts: DataFrame) -> DataFrame:
    """input, d: an input's few facts as one digest, whatever their order and repetition."""
    one = F.sha2(F.to_json(F.struct("target", "values"), {"ignoreNullFields": "false"}), 256)
    return facts.where("input is not null").groupBy("input").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(one)), ","), 256).alias("d"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """input, change (added, changed, removed) between two states of the facts."""
    a, b = fact_digests(old).withColumnRenamed("d", "__old"), fact_digests(new).withColumnRenamed("d", "__new")
    change: Column = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old") != F.col("__new"), "changed")
    return a.join(b, "input", "full_outer").select("input", change.alias("change")).where("change is not null")


def full(facts: DataFrame, build: Builder, number: int = 1) -> Version:
    """Everything built from the facts."""
    spark = facts.sparkSession
    root = storage.fresh_dir(spark, "registry")
    facts = storage.written(facts.where("input is not null"), f"{root}/facts")
    view = storage.written(build(facts), f"{root}/view")
    sums, n = row_sums(view)
    return Version(facts, view, spark.createDataFrame([], f"input {dict(facts.dtypes)['input']}, version int"), sums, n, number)


def advance(prior: Version, facts: DataFrame, build: Builder) -> tuple[Version, DataFrame]:
    """The next version, and its changes. Inputs that come back lose their tombstone."""
    root = storage.fresh_dir(facts.sparkSession, "registry")
    facts = storage.written(facts.where("input is not null"), f"{root}/facts")
    diff = storage.written(changes(prior.facts, facts), f"{root}/changes")
    there = lambda df, how, of=diff: df.join(of.select("input"), "input", how)
    fresh = storage.written(build(there(facts, "left_semi", diff.where("change <> 'removed'"))), f"{root}/fresh")
    out = there(prior.view, "left_semi")
    view = storage.written(there(prior.view, "left_anti").unionByName(fresh), f"{root}/view")
    number = prior.number + 1
    gone = diff.where("change = 'removed'").select("input", F.lit(number).alias("version"))
    tombstones = there(prior.tombstones, "left_anti", diff.where("change = 'added'")).unionByName(gone)
    (minus, less), (plus, more) = row_sums(out), row_sums(fresh)
    sums = tuple((s - m + p) % MODULUS for s, m, p in zip(prior.sums, minus, plus))
    return Version(facts, view, storage.written(tombstones, f"{root}/tombstones"), sums, prior.n_rows - less + more, number), diff


def merged(facts: DataFrame, updates: DataFrame) -> DataFrame:
    """Facts after a batch of updates (input, target, values): values replace those of their input and target; null values take them away."""
    kept = facts.join(updates.select("input", "target"), ["input", "target"], "left_anti")
    return kept.unionByName(updates.where("values is not null").select(*facts.columns))
