"""Line deduplication that returns keep bitmaps; DataFrame functions only.

Line hashes are dealt out by range over (hash, salt of the document) and sorted within partitions
by document and position, so the first line of each document streams by once; counts per salt are
then added up per hash. A very common line thus spreads over many partitions. What to drop comes
back as run-length bitmaps per document; texts are joined only by who wants the kept text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: ASCII whitespace but no other.
BLANKS = " \t\n\x0b\x0c\r"
#: Parts of one line hash, by document; counts of the parts are added up.
SALTS = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would change other letters)."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def long_lines(docs: DataFrame, least_chars: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tag, pos, h1, h2): lines whose key has ``least_chars`` code points or more.

    ``tag`` is a hash of the text: rows with one id but different texts stay apart.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("tag"), F.posexplode(split_lines(F.col(text))).alias("pos", "line"))
    key = rows.select("doc_id", "tag", "pos", F.btrim("line", F.lit(BLANKS)).alias("key")).filter(F.length("key") >= least_chars)
    return key.withColumn("key", ascii_lower(F.col("key"))).select("doc_id", "tag", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def repeated_lines(lines: DataFrame, least_docs: int) -> DataFrame:
    """(h1, h2, keep): hashes found in ``least_docs`` documents or more, and the largest id that has each."""
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    order = ["h1", "h2", "salt"]
    ranged = salted.repartitionByRange(*order).sortWithinPartitions(*order, "doc_id", "pos")
    stream = Window.partitionBy(*order).orderBy("doc_id", "pos")
    first = F.row_number().over(stream) == 1
    fresh = ranged.withColumn("fresh", (first | ~F.lag("doc_id").over(stream).eqNullSafe(F.col("doc_id"))).cast("int"))
    per_salt = fresh.groupBy(*order).agg(F.sum("fresh").alias("n"), F.max("doc_id").alias("keep"))
    return per_salt.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("keep").alias("keep")).filter(F.col("n") >= least_docs).select("h1", "h2", "keep")


def bitmaps(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tag, n_dropped, dropped): runs of line positions (from, to; inclusive) that go.

    Only documents that lose lines have a row; ``tag`` is xxhash64 of the text. A long line found
    in enough documents goes everywhere but in the largest id that has it. Null ids count as one
    document, smaller than all; equal rows share a bitmap; an empty table gives no rows.
    """
    lines = materialize(long_lines(docs, least_chars, doc_id, text), "lines")
    # written, so that both sides of the join are plain exchanges and Spark can split a very common line
    twice = materialize(repeated_lines(lines, least_docs), "line-keys")
    gone = lines.join(twice, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keep")))
    at = gone.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    starts = F.filter("at", lambda x, i: (i == 0) | (F.get("at", i - 1) != x - 1))
    ends = F.filter("at", lambda x, i: (i == F.size("at") - 1) | (F.get("at", i + 1) != x + 1))
    runs = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("from"), b.alias("to")))
    return at.select("doc_id", "tag", F.size("at").cast("long").alias("n_dropped"), runs.alias("dropped"))


def kept_texts(docs: DataFrame, maps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) for every row of ``docs``; null and empty texts are one empty line."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tag"))
    maps = maps.select(F.col("doc_id").alias("d"), F.col("tag").alias("t"), "n_dropped", "dropped")
    joined = rows.join(maps, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t")), "left")
    lines = split_lines(F.col("text"))
    # the runs as one flag for each line, in one pass over lines and runs; lines after the last run have no flag
    before = lambda i: F.when(i == 0, -1).otherwise(F.get("dropped", i - 1)["to"])
    flags = F.flatten(F.transform("dropped", lambda r, i: F.concat(F.array_repeat(F.lit(False), r["from"] - before(i) - 1), F.array_repeat(F.lit(True), r["to"] - r["from"] + 1))))
    stays = F.zip_with(lines, flags, lambda line, gone: F.when(~F.coalesce(gone, F.lit(False)), line))
    kept = F.when(F.col("dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(stays, "\n"))
    return joined.select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


#: The query in DuckDB.
ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keep AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
