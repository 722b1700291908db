"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(bias + w.x + 1/2 * sum_f((v_f.x)**2 - (v_f**2).(x**2))): the pairwise interactions
of all features with low-rank factors, in time linear in the features (sum-of-squares identity).
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, field, free_name, packed, remainder, scan, text_list, unpacked

#: Hashed word features, factors of an interaction, labelled documents to fit on, passes over them.
DIMENSIONS, RANK, MAX_FIT, EPOCHS = 1024, 8, 6000, 12
N_STATS = 14


class Machine(NamedTuple):
    bias: float
    linear: np.ndarray
    factors: np.ndarray  # features x RANK
    centre: np.ndarray  # of the statistics
    spread: np.ndarray


def _share(counts: np.ndarray, which: bytes) -> float:
    return float(counts[np.frombuffer(which, np.uint8)].sum())


_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_PLAIN = b" .,;:'\"?()-\n"
_SYMBOL = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _PLAIN)


def statistics(text: bytes, words: list[bytes], n_chars: float) -> list[float]:
    """Structure of a text (length, case, symbols, lines, repetition) and the length its metadata give."""
    n, k = max(len(text), 1), max(len(words), 1)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    pairs = len(set(zip(words, words[1:], strict=False))) if len(words) > 1 else 1
    lines = text.split(b"\n")
    return [
        np.log1p(len(words)),
        np.log1p(n_chars),
        n / k,
        _share(counts, _UPPER) / n,
        _share(counts, _LOWER) / n,
        _share(counts, _DIGIT) / n,
        _share(counts, _SYMBOL) / n,
        float(counts[128:].sum()) / n,
        np.log1p(len(lines)),
        len(set(lines)) / len(lines),
        len(set(words)) / k,
        len(set(words)) / k**0.75,
        pairs / max(len(words) - 1, 1),
        _share(counts, b".!?") / k,
    ]


def features(texts: list[bytes], n_chars: list[float | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed words of unit length, raw statistics) of each text; empty texts have no words."""
    hashed = np.zeros((len(texts), DIMENSIONS), np.float32)
    stats = np.zeros((len(texts), N_STATS))
    for i, (text, told) in enumerate(zip(texts, n_chars, strict=True)):
        words = text.split()
        stats[i] = statistics(text, words, float(len(text) if told is None else max(told, 0)))
        if words:
            kinds: dict[bytes, int] = {}
            for w in words:
                kinds[w] = kinds.get(w, 0) + 1
            at = np.fromiter(map(zlib.crc32, kinds), np.int64, len(kinds))
            sign = np.where(at >> 20 & 1, 1.0, -1.0)
            row = np.bincount(at % DIMENSIONS, np.sqrt(np.fromiter(kinds.values(), float, len(kinds))) * sign, DIMENSIONS)
            hashed[i] = row / max(np.sqrt((row**2).sum()), 1e-9)
    return hashed, stats


def raw_scores(x: np.ndarray, linear: np.ndarray, factors: np.ndarray, bias: float) -> np.ndarray:
    return bias + x @ linear + 0.5 * ((x @ factors) ** 2 - (x**2) @ (factors**2)).sum(1)


def _inputs(hashed: np.ndarray, stats: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.concatenate([hashed, np.clip((stats - centre) / spread, -4, 4) / np.sqrt(N_STATS)], 1).astype(np.float64)


def fit(hashed: np.ndarray, stats: np.ndarray, y: np.ndarray, rank: int = RANK, epochs: int = EPOCHS, rate: float = 0.03, decay: float = 1e-4, seed: int = 11) -> Machine:
    """Logistic loss, Adam on shuffled batches; the classes weigh the same. Without both classes: the share of 1."""
    share = float(y.mean()) if len(y) else 0.5
    centre, spread = (stats.mean(0), stats.std(0) + 1e-6) if len(y) else (np.zeros(N_STATS), np.ones(N_STATS))
    n = DIMENSIONS + N_STATS
    if not 0 < share < 1:
        bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return Machine(bias, np.zeros(n), np.zeros((n, rank)), centre, spread)
    x = _inputs(hashed, stats, centre, spread)
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(n), rng.normal(0, 0.05, (n, rank)), np.zeros(1)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    params = [w, v, b]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), 64):
            i = order[a : a + 64]
            xb, t = x[i], t + 1
            g = (1 / (1 + np.exp(-np.clip(raw_scores(xb, w, v, b[0]), -30, 30))) - y[i]) * weight[i] / len(i)
            gx, xv = xb * g[:, None], xb @ v
            grads = [gx.sum(0) + decay * w, gx.T @ xv - v * (gx * xb).sum(0)[:, None] + decay * v, np.array([g.sum()])]
            for p, m, s, d in zip(params, first, second, grads, strict=True):
                m += 0.1 * (d - m)
                s += 0.001 * (d * d - s)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return Machine(float(b[0]), w, v, centre, spread)


def train(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> Machine:
    """Fit on labelled documents whose crc32 of the id modulo 3 is not 1.

    A hash of the id picks about ``max_fit`` of them, so the driver gets about that many short
    feature rows, whatever the table's size. Of rows with one id the least text counts.
    """
    known = labels.filter("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.filter(remainder("doc_id", 3) != 1)
    share = max_fit / max(known.count(), 1)
    if share < 1:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) < int(share * (1 << 20)))
    told = field(docs, "n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    rows = docs.select("doc_id", F.struct(field(docs, "text").cast("string").alias("text"), told.alias("n_chars")).alias("seen")).join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("seen").alias("seen")).select("doc_id", "seen.text", "seen.n_chars", "quality")

    def work(batch: pa.RecordBatch) -> dict:
        hashed, stats = features(text_list(batch.column(1)), batch.column(2).to_pylist())
        return {"doc_id": batch.column(0).cast(pa.string()), "hashed": [h.astype(np.float16).tobytes() for h in hashed], "stats": list(stats), "quality": batch.column(3).cast(pa.int32())}

    made = scan(rows, work, columns_of(doc_id="string", hashed="binary", stats="array<double>", quality="int"))
    got = sorted(made.toLocalIterator(), key=lambda r: (r.doc_id or "", bytes(r.hashed)))
    hashed = np.array([np.frombuffer(r.hashed, np.float16) for r in got], np.float32).reshape(-1, DIMENSIONS)
    return fit(hashed, np.array([r.stats for r in got]).reshape(-1, N_STATS), np.array([r.quality for r in got], float))


def probabilities(machine: Machine, texts: list[bytes], n_chars: list[float | None], at_once: int = 512) -> np.ndarray:
    """Scores of texts; the dense rows of so many exist at once."""
    raw = np.zeros(len(texts))
    for a in range(0, len(texts), at_once):
        x = _inputs(*features(texts[a : a + at_once], n_chars[a : a + at_once]), machine.centre, machine.spread)
        raw[a : a + at_once] = raw_scores(x, machine.linear, machine.factors, machine.bias)
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def _scores(docs: DataFrame, machine: Machine) -> DataFrame:
    """(row, score): every row of ``docs`` as a struct, with its score."""
    model = docs.sparkSession.sparkContext.broadcast(machine)
    told = field(docs, "n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    rows = docs.select(packed(docs).alias("row"), field(docs, "text").cast("string").alias("text"), told.alias("n_chars"))

    def work(batch: pa.RecordBatch) -> dict:
        return {"row": batch.column(0), "score": probabilities(model.value, text_list(batch.column(1)), batch.column(2).to_pylist())}

    return scan(rows, work, columns_of(row=rows.schema["row"].dataType, score="double"))


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if the score is 0.5 or more) for every row.

    Only the text and its stated length are looked at. Null texts count as empty; an empty text
    gets a score like any other. Equal rows get equal scores. All columns of ``docs`` stay; where
    one has the name of a new column, the new one gets underscores after it.
    """
    score, predicted = free_name("score", docs.columns), free_name("predicted", docs.columns)
    verdict = F.when(F.col("score") >= 0.5, 1).otherwise(0).alias(predicted)
    return _scores(docs, machine).select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("score").alias(score), verdict)


def kept_documents(docs: DataFrame, machine: Machine) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns, whatever those are called."""
    return unpacked(_scores(docs, machine).filter("score >= 0.5"), "row", docs.columns)
