"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructField, StructType

#: Bytes of text that a task works on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the cluster names it.

    That is ``spark.checkpoint.dir``, else the folder given to ``setCheckpointDir``. A local
    session, where driver and executors are one process, may do without: then the machine's own
    temporary folder serves. On a cluster without such a folder this raises.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/pitwise-shared"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read again.

    Lineage ends at the table, so a lost executor costs a re-read and no recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """``wanted``, with underscores added until no name of ``taken`` is like it (Spark ignores case)."""
    used = {t.lower() for t in taken}
    while wanted.lower() in used:
        wanted += "_"
    return wanted


def field(df: DataFrame, name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return df["`" + name.replace("`", "``") + "`"]


def packed(df: DataFrame) -> Column:
    """All columns as one struct, so that they ride along under one name."""
    return F.struct(*[field(df, c) for c in df.columns])


def unpacked(df: DataFrame, row: str, names: list[str]) -> DataFrame:
    """The columns of a packed row again, and nothing else."""
    return df.select(*[F.col(row).getField(c).alias(c) for c in names])


def columns_of(**types: DataType | str) -> StructType:
    """A schema from names and types; types as text are DDL."""
    return StructType([StructField(n, t if isinstance(t, DataType) else DataType.fromDDL(t)) for n, t in types.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column | str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as the empty text."""
    value = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary")) % by


def text_list(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def decoded(raw: bytes) -> str:
    """The text of UTF-8 bytes; what is not valid becomes U+FFFD."""
    return raw.decode("utf-8", "replace")


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about ``limit`` bytes of ``text`` at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([len(t) for t in text_list(batch.column(batch.schema.get_field_index(text)))])
        part = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def scan(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: StructType, text: str = "text", limit: int = CHUNK_BYTES) -> DataFrame:
    """``work`` on bounded chunks of rows inside the tasks; it returns columns by the names of ``schema``."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, text, limit):
            made = work(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if not isinstance(made[f.name], pa.Array) else made[f.name].cast(f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
