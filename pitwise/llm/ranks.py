"""Exact ranks within groups without a global sort, by a trie of key digits.

A key is a text whose byte order is the wanted order. Histograms over the digits that follow the
prefix which all rows of a bucket share give the rank at which each child bucket starts. Only
buckets with more rows than one task should sort are opened again, a trie level deeper; rows are
sorted within the small buckets that are left.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType

from .common import materialize
from .simhash import split_join

#: Hex digits that one histogram resolves: 16 ** DIGITS buckets below a node at most.
DIGITS = 3
#: Rows that are sorted together.
BUCKET_ROWS = 4096
#: Broadcast no more buckets than this; more are joined by shuffle.
MAX_BROADCAST_BUCKETS = 50_000
#: Copies of one row that are made at once.
COPIES = 4096


def digits(value: Column, kind: DataType) -> Column:
    """Hex digits whose order is that of the values: by size for integers, else by UTF-8 bytes; null is empty, before all."""
    if isinstance(kind, IntegralType):
        return F.coalesce(F.lpad(F.lower(F.hex(value.cast("long").bitwiseXOR(F.lit(-(1 << 63))))), 16, "0"), F.lit(""))
    return F.coalesce(F.concat(F.lit("1"), F.lower(F.hex(value.cast("string").cast("binary")))), F.lit(""))


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    lengths = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    return F.size(F.filter(lengths, lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))) - 1


def radix_ranks(rows: DataFrame, key: Column, label: str, most: int | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` with ``start``, the number of places before them in their group.

    ``rows`` is a written table with (g string, n long) and more; a row takes ``n`` places. Keys of
    a group differ (equal ones are ranked as they come). Rows that start at ``most`` or later get no
    rank. Read once for each trie level; the histograms alone are summed in order.
    """
    columns, n_rows = rows.columns, rows.count()
    opened = rows.withColumns({"node": F.concat(F.lit("0:"), "g"), "depth": F.lit(0), "base": F.lit(0).cast("long")})
    closed, level = [], 0
    while True:
        opened = opened.withColumn("bucket", F.concat("node", F.lit("/"), F.substring(key, F.lit(1), F.col("depth"))))
        hist = opened.groupBy("bucket").agg(F.min("node").alias("node"), F.min("g").alias("g"), F.min("base").alias("base"), F.sum("n").alias("held"), F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
        before = Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("from", F.col("base") + F.coalesce(F.sum("held").over(before), F.lit(0)))
        large = (F.col("n") > bucket_rows) & (F.col("low") < F.col("high"))
        if most is not None:
            large &= F.col("from") < most
        deeper = F.when(large, shared_prefix(F.col("low"), F.col("high")) + DIGITS)
        hist = materialize(hist.select("bucket", "n", F.col("from"), F.concat(F.col("from").cast("string"), F.lit(":"), "g").alias("child"), deeper.alias("deeper")), f"{label}-buckets-{level}")
        facts = F.struct("from", "child", "deeper").alias("facts")
        held = opened.drop("node", "depth", "base")
        if hist.count() <= MAX_BROADCAST_BUCKETS:
            joined = held.join(F.broadcast(hist.select("bucket", facts)), "bucket")
        else:
            joined = split_join(held.withColumn("by", F.xxhash64(key)), hist.select("bucket", facts, "n"), "bucket", "by", n_rows)
        more = not hist.filter("deeper is not null").isEmpty()
        if more:
            joined = materialize(joined.select(*columns, "facts"), f"{label}-{level}")
        ready = joined.filter("facts.deeper is null").select(*columns, "facts.from", F.concat_ws("/", F.lit(str(level)), "facts.child").alias("bucket"))
        closed.append(ready)
        if not more:
            break
        opened = joined.filter("facts.deeper is not null").select(*columns, F.col("facts.child").alias("node"), F.col("facts.deeper").alias("depth"), F.col("facts.from").alias("base"))
        level += 1
    every = functools.reduce(DataFrame.unionByName, closed)
    upto = Window.partitionBy("bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (every if most is None else every.filter(F.col("from") < most)).withColumn("start", F.col("from") + F.coalesce(F.sum("n").over(upto), F.lit(0)))
    if most is not None:
        ranked = ranked.unionByName(every.filter(F.col("from") >= most).withColumn("start", F.lit(None).cast("long")))
    return ranked.select(*columns, "start")


def copies(rows: DataFrame, most: int) -> DataFrame:
    """Each row ``n`` times, with ``copy`` from 0; a row that comes more than COPIES times is dealt out in blocks first.

    ``most`` is the largest ``n``.
    """
    blocks = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))))
    if most > COPIES:
        blocks = blocks.repartition(*rows.columns, "block")
    left = F.least(F.col("n") - F.col("block") * COPIES, F.lit(COPIES)) - 1
    made = blocks.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), left)))
    return made.withColumn("copy", F.col("block") * COPIES + F.col("copy")).drop("block")
