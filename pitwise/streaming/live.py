"""Structured Streaming forms: late results set aside, latest rows by key, rolling features with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Matches that a rolling feature looks back on.
LOOK_BACK = 5


def with_availability(stream: DataFrame, event_time: str, delay: str = "3 hours") -> DataFrame:
    """A watermark as long as the time after which a result counts as available."""
    return stream.withWatermark(event_time, delay)


def windowed_totals(stream: DataFrame, event_time: str, key: str, value: str, width: str = "1 day") -> DataFrame:
    """Counts and sums by tumbling window and key, emitted once the watermark has passed a window."""
    return stream.groupBy(F.window(event_time, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def unique_events(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Repeats of an event within the watermark go."""
    return stream.dropDuplicatesWithinWatermark(keys)


def split_late(available: str, cutoff: str, accept: Callable[[DataFrame, int], None], quarantine: Callable[[DataFrame, int], None]):
    """A ``foreachBatch`` that keeps rows known before their cutoff and sets the others aside; none is lost."""

    def run(batch: DataFrame, batch_id: int) -> None:
        early = F.coalesce(F.col(available) < F.col(cutoff), F.lit(False))
        batch = batch.persist()
        accept(batch.filter(early), batch_id)
        quarantine(batch.filter(~early), batch_id)
        batch.unpersist()

    return run


def merge_latest(path: str, keys: list[str], version: str):
    """A ``foreachBatch`` that keeps the newest version of each key, as one folder per batch with a pointer-free read.

    Batches are appended under their id, which makes a repeated batch overwrite itself; ``read_latest``
    picks the newest rows.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct("*"), version).alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run


def read_latest(spark, path: str, keys: list[str], version: str) -> DataFrame:
    rows = spark.read.parquet(path).drop("batch")
    return rows.groupBy(*keys).agg(F.max_by(F.struct("*"), version).alias("r")).select("r.*")


class RollingSums(StatefulProcessor):
    """Per key the last values by time; each row gets the sum over the rows before it and itself."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getValueState("rows", "times array<long>, amounts array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.rows.get() if self.rows.exists() else None
        times, values = (list(held[0]), list(held[1])) if held else ([], [])
        for part in rows:
            part = part.sort_values(["t", "id"])
            out = []
            for t, v in zip(part.t, part.amount, strict=True):
                times.append(int(t))
                values.append(float(v))
                del times[:-LOOK_BACK], values[:-LOOK_BACK]
                out.append(sum(values))
            self.rows.update((times, values))
            yield pd.DataFrame({"key": [key[0]] * len(part), "id": part.id.to_numpy(), "rolling": out})

    def close(self) -> None:
        pass


def rolling_stream(stream: DataFrame, key: str, identity: str, time: str, value: str) -> DataFrame:
    """(key, id, rolling): sums over the last rows of each key, kept in state across batches."""
    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(identity).cast("long").alias("id"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.col(value).cast("double").alias("amount"))
    return rows.groupBy("key").transformWithStateInPandas(RollingSums(), "key long, id long, rolling double", "append", "none")
