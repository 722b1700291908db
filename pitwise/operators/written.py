"""Results that several branches of a plan read: written once to the shared folder and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, else the one given to ``setCheckpointDir``.

    A local session, where driver and executors are one process, may do without; on a cluster this
    raises, since no machine's own folder is seen by the others.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/pitwise-shared"


def once(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table: computed once, however often it is read; a lost executor costs a re-read."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
