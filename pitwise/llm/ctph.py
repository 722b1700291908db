"""Context-triggered piecewise hashing: rolling-hash boundaries, chunk signatures, edit distance."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import CHUNK_BYTES, columns_of, field, mix

#: Bytes of the rolling window, least block size, longest signature, bytes that are rolled over at once.
WINDOW, LEAST_BLOCK, LONGEST, PIECE = 7, 3, 64, 1 << 20
#: Base of the hashes of windows.
BASE = 0xD6E8FEB86659FD93
#: One character for six bits of a chunk's hash.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Groups of neighbouring ids that are dealt to tasks for each shuffle partition, and ids sampled for each group.
GROUPS_PER_PARTITION, SAMPLE_PER_GROUP = 4, 16


def rolled(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(place, hashes) of the windows of a text, by their last byte, piece by piece."""
    codes = np.frombuffer(text, np.uint8)
    for a in range(0, len(text) - WINDOW + 1, PIECE):
        part = codes[a : a + PIECE + WINDOW - 1].astype(np.uint64) + np.uint64(1)
        n = len(part) - WINDOW + 1
        with np.errstate(over="ignore"):
            yield a, mix(sum(part[i : i + n] * np.uint64(pow(BASE, i, 1 << 64)) for i in range(WINDOW)))


def boundaries(text: bytes, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of chunks at the block size, and which of them are ends at twice the block size too."""
    ends, wide = [np.empty(0, np.int64)], [np.empty(0, bool)]
    for a, h in rolled(text):
        at = np.flatnonzero(h % np.uint64(block) == np.uint64(block - 1))
        ends.append(at + a + WINDOW)
        wide.append(h[at] % np.uint64(2 * block) == np.uint64(2 * block - 1))
    return np.concatenate(ends), np.concatenate(wide)


def _signature(text: bytes, ends: np.ndarray) -> str:
    """One character for each chunk; the last chunk takes all that is left beyond the longest signature."""
    cuts = [0, *ends[: LONGEST - 1].tolist()]
    if cuts[-1] < len(text):
        cuts.append(len(text))
    view = memoryview(text)
    return "".join(ALPHABET[xxhash.xxh64_intdigest(view[a:b]) >> 58] for a, b in zip(cuts, cuts[1:], strict=False))


def fingerprint(text: bytes) -> str:
    """``block size:signature:signature at twice the block size`` of a text; ``3::`` if it is empty.

    The block size is the least 3 * 2**k that would make a signature of the whole text fit, halved
    while it makes fewer than half as many chunks.
    """
    block = LEAST_BLOCK
    while block * LONGEST < len(text):
        block *= 2
    ends, wide = boundaries(text, block)
    while block > LEAST_BLOCK and len(ends) < LONGEST // 2:
        block //= 2
        ends, wide = boundaries(text, block)
    return f"{block}:{_signature(text, ends)}:{_signature(text, ends[wide])}"


def edit_distances(pairs: list[tuple[bytes, bytes]]) -> np.ndarray:
    """Levenshtein distances of strings of at most 64 bytes, all pairs at once by bit-parallel columns."""
    if not pairs:
        return np.empty(0, np.int64)
    n = len(pairs)
    size_a = np.array([len(a) for a, _ in pairs])
    size_b = np.array([len(b) for _, b in pairs])
    wide_b = max(int(size_b.max()), 1)
    a = np.frombuffer(b"".join(x.ljust(64, b"\0") for x, _ in pairs), np.uint8).reshape(n, 64)
    b = np.frombuffer(b"".join(x.ljust(wide_b, b"\1") for _, x in pairs), np.uint8).reshape(n, wide_b)
    one, bit = np.uint64(1), np.uint64(1) << np.arange(64, dtype=np.uint64)
    last = np.where(size_a > 0, np.uint64(1) << np.maximum(size_a - 1, 0).astype(np.uint64), np.uint64(0))
    up, down, score = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64), size_a.astype(np.int64)
    with np.errstate(over="ignore"):
        for j in range(wide_b):
            on = j < size_b
            equal = np.where(a == b[:, j : j + 1], bit, np.uint64(0)).sum(1, dtype=np.uint64)
            x = equal | down
            flat = (((equal & up) + up) ^ up) | equal
            plus, minus = down | ~(flat | up), up & flat
            score += np.where(on & ((plus & last) != 0), 1, 0) - np.where(on & ((minus & last) != 0), 1, 0)
            plus = plus << one | one
            minus = minus << one
            up = np.where(on, minus | ~(x | plus), up)
            down = np.where(on, plus & x, down)
    return np.where(size_a == 0, size_b, score)


def likeness(pairs: list[tuple[str, str]]) -> np.ndarray:
    """0 to 1 for pairs of fingerprints: 1 less edits over length, at the best block size that both have; 0 if there is none."""
    jobs, owner = [], []
    out = np.zeros(len(pairs))
    for i, (x, y) in enumerate(pairs):
        if x == y:
            out[i] = 1.0
            continue
        bx, x1, x2 = x.split(":")
        by, y1, y2 = y.split(":")
        at = {int(bx): x1, 2 * int(bx): x2}
        for size, sig in ((int(by), y1), (2 * int(by), y2)):
            if size in at and (at[size] or sig):
                jobs.append((at[size].encode(), sig.encode()))
                owner.append(i)
    if jobs:
        longest = np.array([max(len(a), len(b)) for a, b in jobs])
        np.maximum.at(out, owner, 1 - edit_distances(jobs) / longest)
    return out


def edited(text: str, after: str) -> str:
    """The text with its last quarter (of code points, rounded down) replaced by the first as many of ``after``."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def _groups(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, tag, text) with ``grp``: neighbours by id and tag share a group; null ids come first.

    Bounds come from a sample of (id, tag) by hash, some for each group and as many groups as the
    shuffle partitions ask for; a row finds its group by binary search. Ids may be of any type that
    can be ordered; rows of one id (or of none) are parted by their tags.
    """
    spark = docs.sparkSession
    n = GROUPS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = docs.select("doc_id", "tag")
    share = min(1.0, n * SAMPLE_PER_GROUP / max(keys.count(), 1))
    drawn = keys.filter(F.pmod(F.xxhash64("doc_id", "tag", F.lit("cut")), F.lit(1 << 30)) < int(share * (1 << 30))).distinct()
    sample = [((r.doc_id is not None, r.doc_id), r.tag) for r in drawn.sort(F.asc_nulls_first("doc_id"), "tag").collect()]
    cuts = spark.sparkContext.broadcast([sample[len(sample) * i // n] for i in range(1, n) if sample])

    @F.pandas_udf(IntegerType())
    def group(ids: pd.Series, missing: pd.Series, tags: pd.Series) -> pd.Series:
        known = zip(ids.tolist(), missing.tolist(), tags.tolist(), strict=True)
        return pd.Series([bisect.bisect_right(cuts.value, ((not none, None if none else i), tag)) for i, none, tag in known])

    # a null id would turn a column of whole numbers into one of floats: it is sent as any other id, marked
    some = sample[-1][0][1] if sample else None
    ids = F.coalesce("doc_id", F.lit(some).cast(docs.schema["doc_id"].dataType))
    return docs.withColumn("grp", group(ids, F.col("doc_id").isNull(), "tag"))


def _with_successors(docs: DataFrame) -> DataFrame:
    """(after, doc_id, text) by group and id; each group ends with a copy of the row that follows it.

    That row is the first of the next group (after the last group, of the first).
    """
    rows = _groups(docs)
    firsts = rows.groupBy("grp").agg(F.min(F.struct("doc_id", "tag")).alias("first"))
    order = Window.orderBy("grp")
    to = F.coalesce(F.lag("grp").over(order), F.max("grp").over(Window.partitionBy()))
    firsts = firsts.select("first", to.alias("to"))
    heads = docs.join(F.broadcast(firsts), (F.col("tag") == F.col("first.tag")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id")))
    heads = heads.dropDuplicates(["to"]).select(F.col("to").alias("grp"), F.lit(1).alias("after"), "doc_id", "tag", "text")
    own = rows.select("grp", F.lit(0).alias("after"), "doc_id", "tag", "text")
    return own.unionByName(heads).repartition("grp").sortWithinPartitions("grp", "after", "doc_id", "tag")


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The next document is that of the next larger id (of any type that can be ordered); after the
    last comes the first. Null texts count as empty, bytes that are not valid UTF-8 as U+FFFD; null ids come first; rows with one id follow
    each other by a hash of the text; a single document is its own successor. Texts are dealt out
    once, by ranges of ids.
    """
    kind = docs.schema[doc_id].dataType
    body = F.coalesce(F.make_valid_utf8(field(docs, text).cast("string")), F.lit(""))
    rows = docs.select(field(docs, doc_id).alias("doc_id"), F.xxhash64(body).alias("tag"), body.alias("text"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = columns_of(doc_id=kind, n_chars="bigint", edited_sha256="string", fingerprint="string", edited_fingerprint="string", near_edited="double", near_next="double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (after, doc_id, text, fingerprint)
        ids = None

        def flush() -> pa.RecordBatch:
            done = [(a, b) for a, b in zip(held, held[1:], strict=False) if not a[0]]
            changed = [edited(a[2], b[2]) for a, b in done]
            prints = [fingerprint(t.encode()) for t in changed]
            near = likeness([(a[3], p) for (a, _), p in zip(done, prints, strict=True)] + [(a[3], b[3]) for a, b in done])
            cols = [[a[1] for a, _ in done], [len(a[2]) for a, _ in done], [hashlib.sha256(t.encode()).hexdigest() for t in changed], [a[3] for a, _ in done], prints, near[: len(done)], near[len(done) :]]
            del held[:-1]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [ids, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], strict=True)], names)

        size = 0
        for batch in batches:
            ids = batch.schema.field("doc_id").type
            for after, own, body in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("after", "doc_id", "text")), strict=True):
                held.append((after, own, body, fingerprint(body.encode())))
                size += len(body)
                if size > CHUNK_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return _with_successors(rows).select("after", "doc_id", "text").mapInArrow(run, schema)
