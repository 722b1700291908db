"""Paired block bootstrap: block means are resampled together for all models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_intervals(df: DataFrame, block: list[str], model: str, reference: str, loss: str, replicates: int = 300, seed: int = 1, level: float = 0.95) -> DataFrame:
    """(model, blocks, difference, low, high): mean loss less that of the reference model, with percentile bounds.

    A block counts for a model where both have losses; its difference is that of the block means.
    Replicates are spread over tasks and each draws the blocks' multiplicities itself, so tasks get
    one row per model and block and return one number per model and replicate.
    """
    spark = df.sparkSession
    means = df.groupBy(*block, model).agg(F.avg(loss).alias("mean"))
    base = means.filter(F.col(model) == reference).select(*block, F.col("mean").alias("base"))
    key = F.concat_ws("\x1f", *[F.col(b).cast("string") for b in block])
    pairs = means.filter(F.col(model) != reference).join(base, block).select(key.alias("block"), F.col(model).alias("model"), (F.col("mean") - F.col("base")).alias("difference"))

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, rows in batch.groupby("model"):
                values = rows.sort_values("block")["difference"].to_numpy()
                for r in sorted(set(rows["replicates"].iloc[0])):
                    rng = np.random.default_rng([seed, r])
                    yield pd.DataFrame({"model": [name], "replicate": [r], "mean": [values[rng.integers(0, len(values), len(values))].mean()]})

    chunk = 25
    starts = spark.range(0, replicates, chunk).select(F.col("id").alias("start"), F.sequence(F.col("id"), F.least(F.col("id") + chunk - 1, F.lit(replicates - 1))).alias("replicates"))
    work = pairs.crossJoin(F.broadcast(starts)).repartition("model", "start")  # blocks times a fixed number of chunks

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(list(resample(iter([rows]))), ignore_index=True)

    draws = work.groupBy("model", "start").applyInPandas(one, "model string, replicate long, mean double")
    tail = (1 - level) / 2
    bounds = draws.groupBy("model").agg(F.percentile("mean", F.lit(tail)).alias("low"), F.percentile("mean", F.lit(1 - tail)).alias("high"))
    point = pairs.groupBy("model").agg(F.count(F.lit(1)).alias("blocks"), F.avg("difference").alias("difference"))
    return point.join(bounds, "model")
