"""Timelines of scopes that late observations can change: events come with +1, and with -1 where a late row takes them back.

A scope's observations are map state, by their place in the order (report_period, source_id, ordinal, observation_id). An event is a change of basis
between neighbours of that order. A micro-batch may bring rows of any age; the scope's events before and after are compared, and the difference goes out, so that
the sum over all changes is the batch result (``transitions``) whatever the order of arrival. State can be given a time to live; a scope that has expired starts anew.

Needs the session's state store to be RocksDB (``state_store`` sets it). Rows that come again with one place count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stratalens import storage

PLACE = ["report_period", "source_id", "ordinal", "observation_id"]
CHANGE = "scope_key string, report_period string, observation_id string, before string, after string, change int"
SEPARATOR = "\x1f"


def state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def transitions(observations: DataFrame) -> DataFrame:
    """scope_key, report_period, observation_id, before, after: the batch result, from one window by scope."""
    one = observations.dropDuplicates(["scope_key", *PLACE])
    before = F.lag("basis").over(Window.partitionBy("scope_key").orderBy(*PLACE))
    return one.withColumn("before", before).where("before <> basis").select("scope_key", "report_period", "observation_id", "before", F.col("basis").alias("after"))


class Timeline(StatefulProcessor):
    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getMapState("rows", "place string", "basis string", ttlDurationMs=self.ttl_ms)

    @staticmethod
    def events(rows: dict[str, str]) -> set[tuple[str, str, str, str]]:
        out, last = set(), None
        for place in sorted(rows):
            if last is not None and rows[place] != last:
                period, _, _, observation = place.split(SEPARATOR)
                out.add((period, observation, last, rows[place]))
            last = rows[place]
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {k[0]: v[0] for k, v in self.rows.iterator()}
        now = dict(known)
        for batch in rows:
            for period, source, ordinal, observation, basis in zip(*(batch[c] for c in (*PLACE, "basis"))):
                place = SEPARATOR.join((period, source, f"{int(ordinal):020d}", observation))
                if place not in now:
                    now[place] = basis
                    self.rows.updateValue((place,), (basis,))
        old, new = self.events(known), self.events(now)
        changes = [(key[0], *e, -1) for e in sorted(old - new)] + [(key[0], *e, 1) for e in sorted(new - old)]
        if changes:
            yield pd.DataFrame(changes, columns=[f.split(" ")[0] for f in CHANGE.split(", ")])

    def close(self) -> None:
        pass


def changes(observations: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A stream of observations (scope_key, places, basis) to event changes; write it in update mode."""
    spark = observations.sparkSession
    storage.ship(spark)
    rows = observations.select("scope_key", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c != "ordinal" else F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in PLACE), F.coalesce("basis", F.lit("")).alias("basis"))
    return rows.groupBy("scope_key").transformWithStateInPandas(Timeline(ttl_ms), CHANGE, "Update", "processingtime" if ttl_ms else "none")
