"""Language ID by language-bitmask n-gram filters: bit-sliced Bloom filters.

Every slot of one table holds a bit per language. A lookup ANDs the slots of an n-gram's hashes
and so returns all languages that contain it; a text's hits per language are counted, corrected
for the false positives that the filter's fill predicts, and the most hits decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, field, mix, remainder, scan, text_list

#: Bytes of an n-gram, slots of the table (a power of two), hashes.
GRAM, SLOTS, HASHES = 4, 1 << 20, 3
#: Labelled documents to learn from (expected), n-grams a language keeps, least share of the best language's rate.
MAX_FIT, MAX_GRAMS, LEAST_RATE = 8000, 20_000, 0.3
#: Bytes of one text that are looked up at once.
PIECE = 1 << 20
#: A-Z to a-z; other ASCII that is no letter to a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


SPACES = re.compile(rb"  +")


class Filters(NamedTuple):
    languages: tuple[str, ...]
    table: np.ndarray  # SLOTS x words of 64 languages
    false_positive: np.ndarray  # per language
    common: str  # the language that most was learned from


def normal(text: bytes) -> bytes:
    """Words of letters, each with a single space before and after."""
    return SPACES.sub(b" ", b" " + text.translate(LETTERS) + b" ")


def grams(text: bytes) -> np.ndarray:
    """The n-grams of a normal text as numbers; none spans two spaces."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < GRAM:
        return np.empty(0, np.uint32)
    out = b[: len(b) - GRAM + 1].copy()
    for i in range(1, GRAM):
        out = out << np.uint32(8) | b[i : len(b) - GRAM + 1 + i]
    return out


def pieces(text: bytes) -> Iterator[bytes]:
    """A normal text in pieces of bounded size that have all its n-grams, each once."""
    for a in range(0, max(len(text) - GRAM + 1, 1), PIECE):
        yield text[a : a + PIECE + GRAM - 1]


def _slots(g: np.ndarray) -> list[np.ndarray]:
    h = mix(g.astype(np.uint64) + np.uint64(1))
    step = (h >> np.uint64(40)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(HASHES)]


def lookup(filters: Filters, g: np.ndarray) -> np.ndarray:
    """Bitmask of the languages that contain each n-gram (n-grams x words of 64 languages)."""
    found = None
    for s in _slots(g):
        found = filters.table[s] if found is None else found & filters.table[s]
    return found


def build(learned: dict[str, list[int]], common: str) -> Filters:
    languages = tuple(sorted(learned))
    table = np.zeros((SLOTS, max(1, -(-len(languages) // 64))), np.uint64)
    fills = np.zeros(len(languages))
    for i, lang in enumerate(languages):
        bit = np.uint64(1 << i % 64)
        for s in _slots(np.array(learned[lang], np.uint32)):
            table[s, i // 64] |= bit
        fills[i] = np.count_nonzero(table[:, i // 64] & bit) / SLOTS
    return Filters(languages, table, fills**HASHES, common)


def train(docs: DataFrame, max_fit: int = MAX_FIT, max_grams: int = MAX_GRAMS) -> Filters:
    """Learn from text and non-null lang of documents whose crc32 of the id modulo 4 is not 2.

    A hash of the id picks about ``max_fit`` of them. Tasks count n-grams, counts are added up per
    language, and a language keeps its ``max_grams`` most frequent ones that reach ``LEAST_RATE``
    of the rate in the language where they are most frequent: the driver gets no more than those.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).filter(remainder("doc_id", 4) != 2)
    share = max_fit / max(known.count(), 1)
    if share < 1:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) < int(share * (1 << 20)))

    def work(batch: pa.RecordBatch) -> dict:
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), text_list(batch.column(1)), strict=True):
            by.setdefault(lang, []).append(normal(text))
        out = {"lang": [], "gram": [], "n": []}
        for lang, texts in by.items():
            for part in _together(texts):
                kinds, n = np.unique(np.concatenate([grams(p) for _, p in part]), return_counts=True)
                out["lang"] += [lang] * len(kinds)
                out["gram"] += kinds.tolist()
                out["n"] += n.tolist()
        return out

    counts = scan(known.select(F.col("lang").cast("string").alias("lang"), "text"), work, columns_of(lang="string", gram="bigint", n="bigint"))
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("lang"))
    rates = counts.withColumn("total", total).withColumn("rate", F.col("n") / F.col("total"))
    rates = rates.withColumn("best", F.max("rate").over(Window.partitionBy("gram")))
    rates = rates.filter((F.col("n") > 1) & (F.col("rate") >= LEAST_RATE * F.col("best")))
    top = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    learned: dict[str, list[int]] = {}
    totals: dict[str, int] = {}
    for r in rates.withColumn("k", top).filter(F.col("k") <= max_grams).toLocalIterator():
        learned.setdefault(r.lang, []).append(r.gram)
        totals[r.lang] = r.total
    return build(learned, min(totals, key=lambda x: (-totals[x], x), default="und"))


def has_letters(text: bytes) -> bool:
    return any(c < 128 for c in text.translate(LETTERS).replace(b" ", b"")[:1]) or any(map(str.isalpha, text.decode()))


def _together(texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """Pieces of normal texts with the number of their text, some at a time: about ``PIECE`` bytes."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for piece in pieces(text):
            held.append((i, piece))
            size += len(piece)
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def decide(filters: Filters, texts: list[bytes]) -> tuple[list[str], list[float]]:
    """The language of each text, and its corrected hits as a share of those of all languages."""
    n_lang = len(filters.languages)
    sizes, hits = np.zeros(len(texts), np.int64), np.zeros((len(texts), max(n_lang, 1)))
    for part in _together([normal(t) if has_letters(t) else b"" for t in texts]):
        found = [grams(p) for _, p in part]
        n = np.array([len(g) for g in found])
        full = np.flatnonzero(n)
        if not len(full):
            continue
        owner, starts = np.array([i for i, _ in part])[full], (np.cumsum(n) - n)[full]
        np.add.at(sizes, owner, n[full])
        if n_lang:
            mask = lookup(filters, np.concatenate(found))
            for i in range(n_lang):
                bits = (mask[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(np.int64)
                np.add.at(hits[:, i], owner, np.add.reduceat(bits, starts))
    if n_lang:
        wrong = filters.false_positive
        hits = np.maximum(hits - sizes[:, None] * wrong, 0) / np.maximum(1 - wrong, 1e-9)
    langs, scores = [], []
    for text, own, n in zip(texts, hits, sizes, strict=True):
        if not n and not has_letters(text):
            langs.append("und")
            scores.append(0.0)
        elif own.sum() <= 0:
            langs.append(filters.common)
            scores.append(0.0)
        else:
            langs.append(filters.languages[int(own.argmax())])
            scores.append(float(own.max() / own.sum()))
    return langs, scores


def predict(docs: DataFrame, filters: Filters, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row, from the text alone.

    Null texts and texts without letters are ``und`` with score 0; a text with letters of which no
    filter knows an n-gram gets the language that most was learned from, with score 0; ties go to
    the language that sorts first. Repeated rows get equal answers.
    """
    model = docs.sparkSession.sparkContext.broadcast(filters)

    def work(batch: pa.RecordBatch) -> dict:
        langs, scores = decide(model.value, text_list(batch.column(1)))
        return {"doc_id": batch.column(0), "lang_pred": langs, "score": scores}

    rows = docs.select(field(docs, doc_id).alias("doc_id"), field(docs, text).cast("string").alias("text"))
    return scan(rows, work, columns_of(doc_id=docs.schema[doc_id].dataType, lang_pred="string", score="double"))
