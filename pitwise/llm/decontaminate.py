"""Benchmark decontamination: a broadcast set of normalised benchmark n-grams scans the token windows.

A task reads a chunk of texts as one array of bytes. Word boundaries, word hashes and the rolling
hashes of all windows are array operations; only windows whose hash is in the set are looked at as
text, and count if they are the very words of a benchmark window.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, field, free_name, materialize, mix, packed, scan, text_list, unpacked

#: Words of a window.
WINDOW = 13
#: Text bytes of benchmark items in one broadcast set; a larger benchmark is scanned in several blocks.
MAX_SET_BYTES = 16 << 20
#: Bytes and words that are hashed at once; words longer than LONG bytes are hashed one by one.
PIECE_BYTES, PIECE_WORDS, LONG = 1 << 20, 1 << 18, 4096
#: Base of the hashes of words and windows, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: A-Z to a-z; every other ASCII character that is no letter or digit to a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BYTE_VALUES = mix(np.arange(1, 257))


class Texts(NamedTuple):
    """Texts joined by a space, normalised, with the places of their words."""

    raw: bytes
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # the first word of each text, and the number of all words


class WindowSet(NamedTuple):
    """Windows of the benchmark by rising hash; windows of one hash are neighbours."""

    raw: bytes
    lengths: tuple[int, ...]
    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    items: tuple[str, ...]
    filter: np.ndarray  # by the top bits of a hash
    shift: np.uint64


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = PIECE_BYTES + LONG + 1
    with np.errstate(over="ignore"):
        up, down = (np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (BASE, INVERSE))
    return up, down


def texts_of(raws: list[bytes]) -> Texts:
    raw = b" ".join(t.translate(WORD_BYTES) for t in raws)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = np.frombuffer(raw, np.uint8) != 32
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    sizes = np.fromiter(map(len, raws), np.int64, len(raws)) + 1
    return Texts(raw, starts, ends, np.append(np.searchsorted(starts, np.cumsum(sizes) - sizes), len(starts)))


def word_hashes(texts: Texts) -> np.ndarray:
    raw, starts, ends, _ = texts
    up, down = _powers()
    codes, out = np.frombuffer(raw, np.uint8), np.empty(len(starts), np.uint64)
    cuts = np.searchsorted(starts, np.arange(0, len(raw) + PIECE_BYTES, PIECE_BYTES)).tolist()
    with np.errstate(over="ignore"):
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            low, high = int(starts[a]), int(min(ends[b - 1], starts[b - 1] + LONG))
            total = np.zeros(high - low + 1, np.uint64)
            np.cumsum(BYTE_VALUES[codes[low:high]] * up[: high - low], out=total[1:])
            at = starts[a:b] - low
            out[a:b] = (total[np.minimum(ends[a:b], high) - low] - total[at]) * down[at]
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]])
    return mix(out)


def window_hashes(words: np.ndarray, lengths: tuple[int, ...]):
    """(n, first window, hashes) of the runs of n words, piece by piece, for each length."""
    longest = max(lengths, default=0)
    for a in range(0, len(words), PIECE_WORDS):
        part = words[a : a + PIECE_WORDS + longest - 1]
        total, power = np.zeros(min(PIECE_WORDS, len(part)), np.uint64), 1
        for n in range(1, longest + 1):
            total = total[: len(part) - n + 1]
            with np.errstate(over="ignore"):
                total = total + part[n - 1 : n - 1 + len(total)] * np.uint64(power)
            power = power * BASE % (1 << 64)
            if n in lengths and len(total):
                yield n, a, mix(total + np.uint64(n))


def window_set(items: list[tuple[str, bytes]], window: int = WINDOW) -> WindowSet:
    texts = texts_of([b" ".join(t.translate(WORD_BYTES).split()) for _, t in items])
    counts = np.diff(texts.first)
    item_of = np.repeat(np.arange(len(items)), counts)
    own = np.minimum(counts, window)[item_of]  # words of a window of the word's item
    found = []
    for n, a, h in window_hashes(word_hashes(texts), tuple(sorted({int(n) for n in own}))):
        at = a + np.arange(len(h))
        at = at[(own[at] == n) & (at + n <= texts.first[item_of[at] + 1])]
        found.append((h[at - a], texts.starts[at], texts.ends[at + n - 1], item_of[at]))
    h, begin, end, owner = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    order = np.lexsort((owner, h))
    h, begin, end, owner = h[order], begin[order], end[order], owner[order]
    # of equal windows of one item the first is enough
    again = np.zeros(len(h), bool)
    for i in (np.flatnonzero((h[1:] == h[:-1]) & (owner[1:] == owner[:-1])) + 1).tolist():
        again[i] = texts.raw[begin[i] : end[i]] == texts.raw[begin[i - 1] : end[i - 1]]
    h, begin, end, owner = h[~again], begin[~again], end[~again], owner[~again]
    bits = min(max(int(16 * len(h)).bit_length(), 16), 24)
    near, shift = np.zeros(1 << bits, bool), np.uint64(64 - bits)
    near[h >> shift] = True
    lengths = tuple(sorted({int(min(n, window)) for n in counts if n}))
    return WindowSet(texts.raw, lengths, h, begin, end, owner, tuple(i for i, _ in items), near, shift)


def occurrences(texts: Texts, known: WindowSet) -> tuple[np.ndarray, list[set[str]]]:
    """Which words stand inside an occurrence of a window, and for each text the items whose windows occur."""
    n_words = len(texts.starts)
    edge, items = np.zeros(n_words + 1, np.int32), [set() for _ in texts.first[1:]]
    if not len(known.hashes) or not n_words:
        return np.zeros(n_words, bool), items
    for n, a, h in window_hashes(word_hashes(texts), known.lengths):
        at = np.flatnonzero(known.filter[h >> known.shift])
        low = np.searchsorted(known.hashes, h[at])
        is_in = known.hashes[np.minimum(low, len(known.hashes) - 1)] == h[at]
        at, low = at[is_in], low[is_in]
        high = np.searchsorted(known.hashes, h[at], "right")
        doc = np.searchsorted(texts.first, at + a, "right") - 1
        whole = at + a + n <= texts.first[doc + 1]
        for i, d, x, y in zip((at + a)[whole].tolist(), doc[whole].tolist(), low[whole].tolist(), high[whole].tolist(), strict=True):
            words = b" ".join(texts.raw[texts.starts[i] : texts.ends[i + n - 1]].split())
            owners = [known.items[known.owner[k]] for k in range(x, y) if known.raw[known.begin[k] : known.end[k]] == words]
            if owners:
                edge[i] += 1
                edge[i + n] -= 1
                items[d].update(owners)
    return np.cumsum(edge[:-1]) > 0, items


def _spans(hit: np.ndarray) -> list[int]:
    """Start, end, start, end ... of the runs of true."""
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).tolist()


def scan_windows(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, max_set_bytes: int = MAX_SET_BYTES, texts: bool = True) -> DataFrame:
    """(doc_id, text, n_words, spans, items) of every row: word spans that stand in the benchmark.

    ``spans`` holds start and end (exclusive) word positions in turn, ``items`` the ids (as text)
    of the benchmark items with occurring windows. The set is broadcast in blocks of at most
    ``max_set_bytes`` of item texts, one pass over the documents for each; there is no shuffle.
    Null and empty texts have no words; items that are null or without words have no windows; a null
    id counts as the empty one. A block is as large as the items whose ids are hashed to it, one item
    at least. ``texts=False`` leaves the text out.
    """
    spark = docs.sparkSession
    row = columns_of(doc_id=docs.schema[doc_id].dataType, text="string", n_words="bigint", spans="array<bigint>", items="array<string>")
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // max_set_bytes))
    bench = benchmark.filter("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    out = docs.select(field(docs, doc_id).alias("doc_id"), field(docs, text).cast("string").alias("text"))
    out = out.withColumns({"spans": F.array().cast("array<bigint>"), "items": F.array().cast("array<string>")})
    for block in range(n_blocks):
        part = bench.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block) if n_blocks > 1 else bench
        known = spark.sparkContext.broadcast(window_set([(r.item_id, r.text.encode()) for r in part.toLocalIterator()], window))

        def work(batch: pa.RecordBatch, known=known) -> dict:
            own = texts_of(text_list(batch.column(1)))
            hit, found = occurrences(own, known.value)
            olds, had = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            spans, items = [], []
            for d, (a, b) in enumerate(zip(own.first[:-1].tolist(), own.first[1:].tolist(), strict=True)):
                for x, y in zip(olds[d][::2], olds[d][1::2], strict=True):
                    hit[a + x : a + y] = True
                spans.append(_spans(hit[a:b]) if found[d] or olds[d] else [])
                items.append(sorted(found[d] | set(had[d])))
            return {"doc_id": batch.column(0), "text": batch.column(1), "n_words": np.diff(own.first), "spans": spans, "items": items}

        last = block == n_blocks - 1
        out = scan(out, work, type(row)([f for f in row if texts or not last or f.name != "text"]))
        if not last:
            out = materialize(out.drop("n_words"), "windows")
    return out


def verdicts(scanned: DataFrame, least: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated): hits make a ``least``-th of the words or more."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, edge: edge - total)  # end - (start - (end - ...))
    return scanned.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (least * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, least: int = 20, text: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with all their columns, whatever those are called."""
    held = docs.select(packed(docs).alias("row"), field(docs, text).alias("text"))
    done = verdicts(scan_windows(held, benchmark, doc_id="row", texts=False, **options), least)
    return unpacked(done.filter("not contaminated"), "doc_id", docs.columns)


def scan_rows(docs: DataFrame, benchmark: DataFrame, least: int = 20, text: str = "text", **options) -> DataFrame:
    """``docs`` with a column ``contaminated`` (underscores are added to the name while a column has it)."""
    held = docs.select(packed(docs).alias("row"), field(docs, text).alias("text"))
    done = verdicts(scan_windows(held, benchmark, doc_id="row", texts=False, **options), least)
    return done.select(*[F.col("doc_id").getField(c).alias(c) for c in docs.columns], F.col("contaminated").alias(free_name("contaminated", docs.columns)))


def without_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, text): the texts less the benchmark passages; words that stay are joined by spaces where a passage went."""
    scanned = scan_windows(docs, benchmark, **options)

    def work(batch: pa.RecordBatch) -> dict:
        out = []
        for t, raw, spans in zip(batch.column(1).to_pylist(), text_list(batch.column(1)), batch.column("spans").to_pylist(), strict=True):
            if not spans:
                out.append(t)
                continue
            own, kept, at = texts_of([raw]), [], 0
            for a, b in zip(spans[::2], spans[1::2], strict=True):
                kept.append(raw[at : own.starts[a]])
                at = own.ends[b - 1]
            out.append((b" ".join(kept) + raw[at:]).decode())
        return {"doc_id": batch.column(0), "text": out}

    return scan(scanned, work, columns_of(doc_id=scanned.schema["doc_id"].dataType, text="string"))
