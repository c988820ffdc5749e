"""Streaming counterparts: windowed counts with a watermark, timelines per scope, new seeds by micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.operators import sets


def daily_counts(events: DataFrame, time: str = "ts", key: str = "event_type", delay: str = "1 day") -> DataFrame:
    """Events and members per day and key; late rows are taken up to the delay."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return rows.groupBy(F.window(time, "1 day").alias("w"), key).agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("n_members")).select(F.col("w.start").cast("date").alias("day"), key, "n", "n_members")


STATE = "last string, n long"
CHANGES = "scope_key string, report_period string, before string, after string"


def basis_changes(observations: DataFrame) -> DataFrame:
    """Changes of the reported basis per scope, as observations arrive in order of their period: scope_key, report_period,
    basis. One state row a scope; observations older than the state's are counted, not compared."""

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        period, basis = last.split("\x1f", 1) if last else ("", "")
        out = []
        for rows in batches:
            for p, b in sorted(zip(rows["report_period"], rows["basis"])):
                n += 1
                if p < period:
                    continue
                if period and b != basis:
                    out.append((key[0], p, basis, b))
                period, basis = p, b
        state.update((f"{period}\x1f{basis}", n))
        yield pd.DataFrame(out, columns=["scope_key", "report_period", "before", "after"])

    return observations.groupBy("scope_key").applyInPandasWithState(update, CHANGES, STATE, "append", "NoTimeout")


def seed_sink(registry: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], columns: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the batch's identifiers that the registry doesn't have yet."""

    def batch(rows: DataFrame, epoch: int) -> None:
        write(sets.new_seeds(sets.seeds(rows, columns), registry(), ["id_type", "value"]), epoch)

    return batch
