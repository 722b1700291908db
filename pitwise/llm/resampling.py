"""Importance resampling towards a target corpus, on hashed n-grams found by word-id suffix arrays.

A task numbers the words of a chunk of texts and sorts its suffixes by their first few word ids.
Where neighbours of the suffix array share n words or more (LCP) they are one run: one n-gram, however
often it occurs. Each run is hashed once, its bucket is scattered back to all its occurrences. Bucket counts
of corpus and target give each bucket a gain; a document weighs the mean gain of its features.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import chunks, columns_of, field, materialize, packed, scan, text_list, unpacked
from .decontaminate import Texts, texts_of, word_hashes
from .duckdb_sql import ascii_lower_sql, crc32_sql
from .ranks import copies, digits, radix_ranks

#: Hash buckets of the features, and the longest n-gram.
BUCKETS, LONGEST = 10_000, 1
#: Text bytes whose words are sorted at once.
WORK_BYTES = 1 << 20
#: Documents with fewer words are never drawn; the share that is drawn, in percent; the draw's seed.
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024


# -------------------------------------------------------------- features of a chunk


def word_ids(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(id of each word, first place of each id); equal ids mean equal words, byte by byte."""
    _, first, ids = np.unique(word_hashes(texts), return_index=True, return_inverse=True)
    codes, starts = np.frombuffer(texts.raw, np.uint8), texts.starts
    sizes = texts.ends - starts
    same = (sizes == sizes[first][ids]).all()
    for a in range(0, len(ids) if same else 0, 1 << 18):
        part = slice(a, a + (1 << 18))
        n = sizes[part]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        same &= np.array_equal(codes[np.repeat(starts[part], n) + inside], codes[np.repeat(starts[first][ids[part]], n) + inside])
    if not same:  # two words of one hash
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(texts.raw[a:b], len(known)) for a, b in zip(starts.tolist(), texts.ends.tolist(), strict=True)])
        first = np.unique(ids, return_index=True)[1]
    return ids, first


def suffix_array(ids: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in the order of the suffixes' first ``depth`` words, words shared with the one before).

    ``ends`` is the end of each place's document; no suffix reads beyond it.
    """
    at = np.arange(len(ids))
    columns = [np.where(at + j < ends, ids[np.minimum(at + j, len(ids) - 1)], -1) for j in range(depth)]
    order = np.lexsort(columns[::-1])
    lcp, equal = np.zeros(len(ids), np.int64), np.ones(max(len(ids) - 1, 0), bool)
    for column in columns:
        equal &= column[order][1:] == column[order][:-1]
        lcp[1:] += equal
    return order, lcp


def feature_buckets(texts: Texts, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, bucket of the n-gram that starts there) for n = 1 to ``longest``; places rise."""
    n_words = len(texts.starts)
    if not n_words:
        return
    ids, _ = word_ids(texts)
    ends = np.repeat(texts.first[1:], np.diff(texts.first))
    order, lcp = suffix_array(ids, ends, longest)
    raw = texts.raw
    for n in range(1, longest + 1):
        fresh = lcp < n
        run = np.cumsum(fresh) - 1
        heads = order[fresh]
        whole = heads + n <= ends[heads]
        hashed = np.zeros(len(heads), np.int64)
        begin, end = texts.starts[heads[whole]].tolist(), texts.ends[heads[whole] + n - 1].tolist()
        # words of a run stand apart by one space and more
        grams = (raw[a:b] if n == 1 else b" ".join(raw[a:b].split()) for a, b in zip(begin, end, strict=True))
        hashed[whole] = [zlib.crc32(gram) % buckets for gram in grams]
        scattered = np.full(n_words, -1, np.int64)
        member = whole[run]
        scattered[order[member]] = hashed[run[member]]
        places = np.flatnonzero(scattered >= 0)
        yield places, scattered[places]


# ----------------------------------------------------------------------- the corpus


def bucket_counts(rows: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> dict[int, int]:
    """Features in each bucket over all texts: added up within tasks, then by bucket; ``buckets`` rows at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for chunk in chunks(batches, "text", WORK_BYTES):
            for _, found in feature_buckets(texts_of(text_list(chunk.column(0))), longest, buckets):
                total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    counted = rows.select(field(rows, text).cast("string").alias("text")).mapInArrow(work, "bucket long, n long")
    return {r.bucket: r.n for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln(odds)) of each bucket, smoothed by one feature a bucket."""
    held, wanted = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    odds = (((target.get(b, 0) + 1.0) * held) / ((corpus.get(b, 0) + 1.0) * wanted) for b in range(buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in odds], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """(doc_id, tag, n_words, n_features, weight) of every row; ``tag`` is xxhash64 of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def work(batch: pa.RecordBatch) -> dict:
        texts = texts_of(text_list(batch.column(1)))
        n_docs = batch.num_rows
        n, total = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
        for places, found in feature_buckets(texts, longest, len(shared.value)):
            upto = np.concatenate([[0], np.cumsum(shared.value[found])])
            edges = np.searchsorted(places, texts.first)
            n += np.diff(edges)
            total += np.diff(upto[edges])
        return {"doc_id": batch.column(0), "tag": batch.column(2), "n_words": np.diff(texts.first), "n_features": n, "weight": total // np.maximum(n, 1)}

    rows = docs.select(field(docs, doc_id).alias("doc_id"), field(docs, text).cast("string").alias("text"), F.xxhash64(field(docs, text)).alias("tag"))
    return scan(rows, work, columns_of(doc_id=docs.schema[doc_id].dataType, tag="bigint", n_words="bigint", n_features="bigint", weight="bigint"), limit=WORK_BYTES)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, longest: int = LONGEST, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tag, n_words, n_features, weight, score, rank) of every row; ``rank`` is null where it is not drawn.

    Scores are weights with Gumbel noise drawn from a hash of the id, so the highest are a sample
    without replacement by weight. Of the rows with ``least_words`` words or more, ``percent`` in a
    hundred are drawn, best first, ties to smaller ids (null first, then fewer features); repeated
    rows follow one another. Ranks come from digit histograms, not from a global sort. Null and
    empty texts have no features and weigh 0; an empty table gives no rows.
    """
    gain = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, "text", longest, buckets), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")
    rows = weigh(docs, gain, doc_id, text, longest).withColumn("score", F.col("weight") + noise)
    rows = materialize(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.lit("")), "resample")
    able = rows.filter(F.col("n_words") >= least_words)
    facts = able.agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
    drawn = (facts.total or 0) * percent // 100
    down = digits(-F.col("score"), LongType())
    key = F.concat(down, F.lit("/"), digits(F.col("doc_id"), rows.schema["doc_id"].dataType), *[F.concat(F.lit("/"), digits(F.col(c), LongType())) for c in ("n_features", "n_words", "tag")])
    ranked = radix_ranks(materialize(able, "resample-able"), key, "resample-ranks", most=drawn)
    columns = ["doc_id", "tag", "n_words", "n_features", "weight", "score"]
    place = F.col("start") + F.col("copy") + 1
    every = copies(ranked.unionByName(rows.filter(F.col("n_words") < least_words).withColumn("start", F.lit(None).cast("long"))), rows.agg(F.max("n")).first()[0] or 0)
    return every.select(*columns, F.when(place <= drawn, place).alias("rank"))


def sampled(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents that are drawn, with all their columns; rows of one id and text stay or go together."""
    drawn = resample(docs, target, text=text, doc_id=doc_id, **options).filter("rank is not null").select(F.col("doc_id").alias("i"), F.col("tag").alias("t")).distinct()
    rows = docs.select(packed(docs).alias("row"), field(docs, doc_id).alias("doc_id"), F.xxhash64(field(docs, text)).alias("tag"))
    return unpacked(rows.join(drawn, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("tag") == F.col("t")), "left_semi"), "row", docs.columns)


#: op12_resampling in DuckDB.
ORACLE = rf"""
WITH words AS (
  SELECT 0 AS origin, row_number() OVER () AS rid, doc_id, regexp_extract_all({ascii_lower_sql("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, NULL, NULL, regexp_extract_all({ascii_lower_sql("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
occurrences AS (SELECT origin, rid, unnest(w) AS word FROM words),
vocabulary AS (SELECT word, {crc32_sql("word")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT word FROM occurrences)),
counts AS (SELECT bucket, count(*) FILTER (origin = 0) AS s, count(*) FILTER (origin = 1) AS t FROM occurrences JOIN vocabulary USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(sum(s) OVER () AS DOUBLE) + {BUCKETS}) / ((CAST(s AS DOUBLE) + 1) * (CAST(sum(t) OVER () AS DOUBLE) + {BUCKETS})))) AS BIGINT) AS gain
  FROM counts),
weights AS (SELECT rid, CAST(sum(gain) AS BIGINT) AS total, count(*) AS n FROM occurrences JOIN vocabulary USING (word) JOIN gains USING (bucket) WHERE origin = 0 GROUP BY rid),
scores AS (
  SELECT doc_id, len(w) AS n_features, CASE WHEN n > 0 THEN CAST((total - ((total % n) + n) % n) // n AS BIGINT) ELSE 0 END AS weight,
         CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM words LEFT JOIN weights USING (rid) WHERE origin = 0),
drawn AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score, n_features >= {LEAST_WORDS} AS able FROM scores),
placed AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place, count(*) OVER (PARTITION BY able) AS total FROM drawn)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN able AND place <= {PERCENT} * total // 100 THEN place END AS rank
FROM placed
"""
