"""Personal data: exact patterns, and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy from labelled spans. It reads overlapping windows; a character's
emissions are averaged over the windows it stands in, and each stretch of a text is decoded over
those as a whole, so CRF transitions hold across window seams. Patterns come first: the network
adds spans where no pattern matched, of the same kinds (in other notations) and of a kind that no
pattern has: secrets, which are told from other codes by the words before them.
"""

from __future__ import annotations

import functools
import hashlib
import pickle
import re
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, decoded, field, scan, shared_folder, text_list

#: Kinds of the patterns in the order of results, and those that the network tags.
KINDS = ("email", "ip", "card", "phone")
TAGGED = (*KINDS, "secret")
#: Characters of a window, steps between windows, hidden units of each direction.
WIDTH, STRIDE, HIDDEN = 64, 32, 16
#: Windows that are read at once; characters decoded in one piece, and by how many pieces overlap.
BATCH, PIECE, SEAM = 2048, 1024, 128
SEED = 5

# The base patterns.
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: As the plain pattern: from inside a run of digits nothing matches that does not from its start.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Characters of a secret, and how many of them there are.
SECRET = re.compile(r"[A-Za-z0-9_+/=.-]{16,128}")
#: No span of any kind is without one of these.
TRIGGER = re.compile(rb"[0-9@]")

Span = tuple[str, int, int]

# ------------------------------------------------------------------- patterns


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        found = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append(("email", start, end))
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the exact patterns, by kind and start; matches that fail a check are dropped, not retried."""
    out = emails(text)
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = _digits(m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


# -------------------------------------------------------------------- network

#: Characters that the network tells apart besides letters (without case); digits are one class, so are other ASCII and all else.
SINGLE = " .@-+()_%:/\n\"'=#|,;!?[]{}<>&$*~"
N_CLASSES = len(SINGLE) + 26 + 3
N_TAGS = 1 + 2 * len(TAGGED)


def _class_table() -> np.ndarray:
    t = np.full(129, len(SINGLE) + 27, np.int8)
    t[128] = len(SINGLE) + 28
    for i, c in enumerate(SINGLE):
        t[ord(c)] = i
    for i in range(26):
        t[ord("a") + i] = t[ord("A") + i] = len(SINGLE) + i
    t[ord("0") : ord("9") + 1] = len(SINGLE) + 26
    return t


_CLASSES = _class_table()


def classes(text: str) -> np.ndarray:
    """The class of each code point."""
    return _CLASSES[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


class Tagger(NamedTuple):
    """Input tables and recurrent weights of both directions, emissions, CRF transitions."""

    inputs: tuple[np.ndarray, np.ndarray]
    hidden: tuple[np.ndarray, np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    moves: np.ndarray  # from x to
    first: np.ndarray


def _lstm(x: np.ndarray, table: np.ndarray, weights: np.ndarray, keep: bool = False):
    """Hidden states (steps x rows x units) over steps x rows of classes.

    Gates stand side by side: forget, add, show, new. A sigmoid is taken as a tanh of half its input.
    """
    steps, rows, u = *x.shape, weights.shape[0]
    half = np.ones(4 * u, np.float32)
    half[: 3 * u] = 0.5
    inputs, weights = (table * half)[x], weights * half
    h, c = np.zeros((rows, u), np.float32), np.zeros((rows, u), np.float32)
    out, cells, gates = np.empty((steps, rows, u), np.float32), [], []
    for t in range(steps):
        g = np.tanh(inputs[t] + h @ weights)
        g[:, : 3 * u] += 1
        g[:, : 3 * u] *= 0.5
        if keep:
            cells.append(c)
            gates.append(g)
        c = g[:, :u] * c + g[:, u : 2 * u] * g[:, 3 * u :]
        h = g[:, 2 * u : 3 * u] * np.tanh(c)
        out[t] = h
    return (out, cells, gates, c) if keep else out


def _lstm_back(x: np.ndarray, table: np.ndarray, weights: np.ndarray, run, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients by table and weights."""
    out, cells, gates, last = run
    u = weights.shape[0]
    dz = np.empty((*x.shape, 4 * u), np.float32)
    dh, dc, c, back = np.zeros_like(last), np.zeros_like(last), last, np.ascontiguousarray(weights.T)
    for t in range(len(x) - 1, -1, -1):
        g, before, d = gates[t], cells[t], dz[t]
        dh += d_out[t]
        tc = np.tanh(c)
        dc += dh * g[:, 2 * u : 3 * u] * (1 - tc * tc)
        d[:, :u], d[:, u : 2 * u], d[:, 2 * u : 3 * u] = dc * before, dc * g[:, 3 * u :], dh * tc
        d[:, : 3 * u] *= g[:, : 3 * u] * (1 - g[:, : 3 * u])
        d[:, 3 * u :] = dc * g[:, u : 2 * u] * (1 - g[:, 3 * u :] ** 2)
        dh, dc, c = d @ back, dc * g[:, :u], before
    of_class = np.zeros((x.size, len(table)), np.float32)
    of_class[np.arange(x.size), x.ravel()] = 1
    flat = dz.reshape(x.size, 4 * u)
    return of_class.T @ flat, out[:-1].reshape(-1, u).T @ flat[x.shape[1] :]


def emissions(model: Tagger, x: np.ndarray) -> np.ndarray:
    ahead = _lstm(x, model.inputs[0], model.hidden[0])
    back = _lstm(x[::-1], model.inputs[1], model.hidden[1])[::-1]
    return np.concatenate([ahead, back], 2) @ model.out + model.bias


def viterbi(model: Tagger, scores: np.ndarray) -> np.ndarray:
    """The best tags (steps x rows)."""
    steps, rows, _ = scores.shape
    best, came = scores[0] + model.first, []
    for t in range(1, steps):
        total = best[:, :, None] + model.moves
        came.append(total.argmax(1).astype(np.int8))
        best = total.max(1) + scores[t]
    tags = np.empty((steps, rows), np.int8)
    tags[-1] = best.argmax(1)
    for t in range(steps - 2, -1, -1):
        tags[t] = came[t][np.arange(rows), tags[t + 1]]
    return tags


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def _crf_gradients(scores: np.ndarray, tags: np.ndarray, moves: np.ndarray, first: np.ndarray):
    """Gradients of the mean negative log-likelihood by scores, moves and first tags (forward-backward, scaled at each step)."""
    steps, rows, k = scores.shape
    here = np.exp(scores - scores.max(2, keepdims=True))
    step, start = np.exp(moves - moves.max()), np.exp(first - first.max())
    ahead, back = np.empty_like(here), np.ones_like(here)
    ahead[0] = here[0] * start
    for t in range(1, steps):
        ahead[t - 1] /= ahead[t - 1].sum(1, keepdims=True)
        np.multiply(ahead[t - 1] @ step, here[t], out=ahead[t])
    for t in range(steps - 2, -1, -1):
        after = here[t + 1] * back[t + 1]
        np.matmul(after / after.sum(1, keepdims=True), step.T, out=back[t])
    d = ahead * back
    d /= d.sum(2, keepdims=True)
    after = here[1:] * back[1:]
    norm = np.einsum("trk,kl,trl->tr", ahead[:-1], step, after, optimize=True)
    d_moves = np.einsum("trk,trl->kl", ahead[:-1] / norm[:, :, None], after, optimize=True) * step
    np.add.at(d_moves, (tags[:-1].ravel(), tags[1:].ravel()), -1)
    d_first = d[0].sum(0) - np.bincount(tags[0], minlength=k)
    d[np.arange(steps)[:, None], np.arange(rows), tags] -= 1
    return d / rows, d_moves / rows, d_first / rows


def tags_of(n: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(n, np.int64)
    for kind, a, b in spans:
        tags[a:b] = 2 + 2 * TAGGED.index(kind)
        tags[a] -= 1
    return tags


def fit(examples: list[tuple[str, list[Span]]], epochs: int = 24, rate: float = 0.03, batch: int = 128, hidden: int = HIDDEN, seed: int = SEED) -> Tagger:
    """Train on labelled texts of ``WIDTH`` characters each (shorter ones are padded by line ends)."""
    rng = np.random.default_rng(seed)
    x = np.stack([classes(t[:WIDTH].ljust(WIDTH, "\n")) for t, _ in examples]).astype(np.int64)
    y = np.stack([tags_of(max(WIDTH, len(t)), s)[:WIDTH] for t, s in examples])
    normal = lambda *shape: rng.normal(0, 0.25, shape).astype(np.float32)
    p = [normal(N_CLASSES, 4 * hidden), normal(N_CLASSES, 4 * hidden), normal(hidden, 4 * hidden), normal(hidden, 4 * hidden)]
    p += [normal(2 * hidden, N_TAGS), np.zeros(N_TAGS, np.float32), np.zeros((N_TAGS, N_TAGS), np.float32), np.zeros(N_TAGS, np.float32)]
    for table in p[:2]:
        table[:, :hidden] += 1  # remember at first
    m, s, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            i = order[a : a + batch]
            xb, yb, step = x[i].T, y[i].T, step + 1
            ahead = _lstm(xb, p[0], p[2], True)
            back = _lstm(xb[::-1], p[1], p[3], True)
            both = np.concatenate([ahead[0], back[0][::-1]], 2)
            d, d_moves, d_first = _crf_gradients(both @ p[4] + p[5], yb, p[6], p[7])
            d_both = d @ p[4].T
            t0, w0 = _lstm_back(xb, p[0], p[2], ahead, d_both[:, :, :hidden])
            t1, w1 = _lstm_back(xb[::-1], p[1], p[3], back, d_both[::-1, :, hidden:])
            grads = [t0, t1, w0, w1, np.einsum("trh,trk->hk", both, d), d.sum((0, 1)), d_moves, d_first]
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads))
            pace = rate * (1 - epoch / epochs) * min(1.0, 5 / max(norm, 1e-9))
            for q, mm, ss, g in zip(p, m, s, grads, strict=True):
                mm += 0.1 * (g - mm)
                ss += 0.01 * (g * g - ss)
                q -= pace * (mm / (1 - 0.9**step)) / (np.sqrt(ss / (1 - 0.99**step)) + 1e-6)
    return Tagger((p[0], p[1]), (p[2], p[3]), p[4], p[5], p[6], p[7])


# ------------------------------------------------------------ labelled examples


def examples(n: int = 5000, seed: int = SEED) -> list[tuple[str, list[Span]]]:
    """Labelled windows by rule: invented words around personal data in many notations, and around what only looks like it."""
    rng = np.random.default_rng(seed)
    pick = lambda *options: options[rng.integers(len(options))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    letters = lambda k: "".join(chr(97 + c) for c in rng.integers(0, 26, k))

    def word() -> str:
        w = letters(rng.integers(1, 11))
        w = pick(w, w, w, w.capitalize(), w.upper(), w[:2] + "é" + w[2:])
        return w + pick("", "", "", "", "", ".", ",", ":", "!", "%%%", ")", '"')

    def email() -> str:
        local = pick(letters(6), f"{letters(4)}.{digits(2)}", f"{letters(3)}_{letters(5)}", f"{letters(5)}+{letters(3)}", letters(4) + digits(3))
        return local + "@" + pick(f"mail{digits(1)}.example.com", f"{letters(6)}.org", f"{letters(4)}-{letters(3)}.co.uk", f"{letters(8)}.net")

    def card() -> str:
        gap = pick("", "", " ", "-")
        return gap.join(digits(4) for _ in range(4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+44 {digits(2)} {c} {digits(4)}", f"+{digits(2)} {a} {b} {c}", f"+1-{a}-{b}-{c}")

    def code() -> str:
        kinds = ("0123456789abcdef", "0123456789ABCDEF", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")[rng.integers(3)]
        return "".join(pick(*kinds) for _ in range(pick(20, 24, 32, 32, 40, 40)))

    def name(*options: str) -> str:
        w = pick(*options)
        return pick(w, w, w.upper(), w.capitalize())

    def secret() -> tuple[str, str, str]:
        """What stands before a secret, the secret, and what stands after it."""
        quote = pick('"', '"', "'", "")
        before = name("token", "token", "secret", "password", "api_key", "apikey", "access_key", "passwd", "auth") + pick(" = ", " = ", "=", ": ", ":") + quote
        return before, code(), quote

    make = {"email": email, "ip": lambda: ".".join(str(v) for v in rng.integers(0, 256, 4)), "card": card, "phone": phone}

    def decoy() -> str:
        return pick(
            code(), f"{name('commit', 'sha', 'digest', 'build', 'checksum', 'id', 'file')}{pick(' ', ': ', ' = ')}{code()}", f"version {digits(1)}.", f"{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(2)}.{digits(1)}",
            f"20{digits(2)}-0{rng.integers(1, 10)}-{rng.integers(10, 29)}", digits(rng.integers(1, 9)), digits(rng.integers(9, 13)), f"{digits(2)}:{digits(2)}", f"${digits(3)}.{digits(2)}", f"@{letters(6)}",
            f"{digits(3)} {letters(4)} {digits(2)}", f"{letters(3)}{digits(3)}", f"{name('token', 'secret', 'password')} {letters(5)}", f"{name('token', 'secret')} = {letters(6)}",
        )

    out = []
    while len(out) < n:
        text, spans = "", []
        shift = int(rng.integers(0, 24))
        while len(text) < WIDTH + shift:
            kind = pick(*TAGGED, "decoy", "decoy", "word", "word", "word", "word")
            before, part, after = ("", word(), "") if kind == "word" else ("", decoy(), "") if kind == "decoy" else secret() if kind == "secret" else ("", make[kind](), "")
            if kind in TAGGED:
                spans.append((kind, len(text) + len(before), len(text) + len(before) + len(part)))
            text += before + part + after + (pick(".", ",", "!", "", "", "") if kind in make else "") + pick(" ", " ", " ", " ", "\n", " | ")
        # a span that a window cuts off is labelled as far as the window shows it; its start may lie before
        cut = [(k, max(a - shift, 0), min(b - shift, WIDTH)) for k, a, b in spans if b > shift and a - shift < WIDTH]
        if all(a >= shift for _, a, b in spans if b > shift):
            out.append((text[shift : shift + WIDTH], cut))
    return out


@functools.cache
def default_tagger() -> Tagger:
    """The network, fitted in this process (half a minute or so)."""
    return fit(examples())


def shared_tagger(spark: SparkSession) -> Tagger:
    """The network as kept in the shared folder; where it is not there yet, a task fits it and writes it.

    The folder's name is a digest of all that the fit depends on, and the fit is seeded, so
    sessions that fit at the same time write the same weights.
    """
    kept = f"{shared_folder(spark)}/pii-tagger-{hashlib.sha256(Path(__file__).read_bytes()).hexdigest()[:16]}"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(default_tagger())])], ["model"])

    try:
        row = spark.read.schema("model binary").parquet(kept).first()
    except AnalysisException:
        row = None
    if row is None:
        spark.range(1, numPartitions=1).mapInArrow(made, "model binary").write.mode("ignore").parquet(kept)
        row = spark.read.schema("model binary").parquet(kept).first()
    return pickle.loads(row.model)


# -------------------------------------------------------------------- decoding


def _read_spans(tags: np.ndarray) -> list[Span]:
    out: list[list] = []
    at = np.flatnonzero(tags)
    for i in at.tolist():
        kind, begins = TAGGED[(tags[i] - 1) // 2], tags[i] % 2 == 1
        if out and out[-1][2] == i and out[-1][0] == kind and not begins:
            out[-1][2] = i + 1
        else:
            out.append([kind, i, i + 1])
    return [tuple(s) for s in out]


def stands_alone(text: str, a: int, b: int) -> bool:
    """No letter or digit touches the span: parts of longer codes are no personal data."""
    return not (a and text[a - 1].isalnum() or text[b : b + 1].isalnum())


def plausible(kind: str, text: str) -> bool:
    """The exact check of a span that the network proposes."""
    digits = _digits(text)
    if kind == "secret":
        return len(digits) >= 4 and len(set(text)) >= 8 and SECRET.fullmatch(text) is not None
    if kind == "email":
        at = text.find("@")
        return at > 0 and all(c in EMAIL_LOCAL for c in text[:at]) and EMAIL_DOMAIN.fullmatch(text, at + 1) is not None
    if not digits or not (text[-1].isdigit() and set(text) <= set("0123456789 .-+()")):
        return False
    if kind == "ip":
        return IP.fullmatch(text) is not None and all(len(p) <= 3 and int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and text[0].isdigit() and set(text) <= set("0123456789 -")
    return 10 <= len(digits) <= 15 and (text[0] in "+(" or text[0].isdigit()) and any(c in "() .-+" for c in text)


def stretches(codes: np.ndarray) -> list[tuple[int, int]]:
    """Parts of a text that windows with a digit or an @ reach, and a window's width on either side of it."""
    digit, at = _CLASSES[ord("0")], _CLASSES[ord("@")]
    hot = np.unique(np.flatnonzero((codes == digit) | (codes == at)) // STRIDE)
    if not len(hot):
        return []
    first = np.flatnonzero(np.concatenate([[True], np.diff(hot) > 4]))
    last = np.append(first[1:], len(hot)) - 1
    return [(max(int(a) * STRIDE - WIDTH, 0), min(int(b) * STRIDE + STRIDE + WIDTH, len(codes))) for a, b in zip(hot[first], hot[last], strict=True)]


def averaged(model: Tagger, parts: list[np.ndarray]) -> list[np.ndarray]:
    """Emissions of each stretch (characters x tags), averaged over the windows that a character stands in."""
    jobs = [(i, s) for i, c in enumerate(parts) for s in range(0, max(len(c) - WIDTH + STRIDE, 1), STRIDE)]
    total = [np.zeros((len(c), N_TAGS), np.float32) for c in parts]
    seen = [np.zeros((len(c), 1), np.float32) for c in parts]
    pad = _CLASSES[ord("\n")]
    for a in range(0, len(jobs), BATCH):
        part = jobs[a : a + BATCH]
        x = np.full((len(part), WIDTH), pad, np.int64)
        for r, (i, s) in enumerate(part):
            window = parts[i][s : s + WIDTH]
            x[r, : len(window)] = window
        found = emissions(model, np.ascontiguousarray(x.T)).transpose(1, 0, 2)
        for r, (i, s) in enumerate(part):
            n = min(WIDTH, len(parts[i]) - s)
            total[i][s : s + n] += found[r, :n]
            seen[i][s : s + n] += 1
    return [t / n for t, n in zip(total, seen, strict=True)]


def decode(model: Tagger, scores: list[np.ndarray]) -> list[np.ndarray]:
    """The best tags of each stretch by Viterbi.

    Long stretches are decoded in overlapping pieces, all at once, and joined where both pieces
    read the same tag: there the best path is the left piece's up to the place and the right
    piece's after it. Where pieces never agree, both are decoded anew as one.
    """
    pieces = [(i, a, min(a + PIECE + SEAM, len(s))) for i, s in enumerate(scores) for a in range(0, max(len(s) - SEAM, 1), PIECE)]
    tags: dict[tuple[int, int], np.ndarray] = {}
    alike: dict[int, list[tuple[int, int]]] = {}
    for i, a, b in pieces:
        alike.setdefault(b - a, []).append((i, a))
    for n, places in alike.items():
        for k in range(0, len(places), BATCH):
            part = places[k : k + BATCH]
            found = viterbi(model, np.stack([scores[i][a : a + n] for i, a in part], 1)) if n else np.empty((0, len(part)), np.int8)
            tags |= {place: found[:, j] for j, place in enumerate(part)}
    out = []
    for i, s in enumerate(scores):
        done = tags[i, 0]
        for a in range(PIECE, max(len(s) - SEAM, 1), PIECE):
            right, shared = tags[i, a], len(done) - a
            agree = np.flatnonzero((done[a:] == right[:shared]) & (np.arange(shared) >= shared // 4))
            if len(agree):
                outside = agree[done[a + agree] == 0]
                at = int((outside if len(outside) else agree)[0])
                done = np.concatenate([done[: a + at], right[at:]])
            else:
                done = viterbi(model, s[: a + len(right), None])[:, 0]
        out.append(done)
    return out


def tag_texts(model: Tagger, texts: list[str]) -> list[list[Span]]:
    """Spans that the network reads in each text, checked.

    Only stretches around a digit or an @ are read: no span without one of them passes the check.
    """
    codes = [classes(t) for t in texts]
    where = [(i, a, b) for i, c in enumerate(codes) for a, b in stretches(c)]
    found = decode(model, averaged(model, [codes[i][a:b] for i, a, b in where]))
    out: list[list[Span]] = [[] for _ in texts]
    for (i, a, _), tags in zip(where, found, strict=True):
        spans = [(k, x + a, y + a) for k, x, y in _read_spans(tags)]
        out[i] += [(k, x, y) for k, x, y in spans if stands_alone(texts[i], x, y) and plausible(k, texts[i][x:y])]
    return out


def all_spans(model: Tagger, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, each by kind and start; added spans overlap no other."""
    out = []
    for text, more in zip(texts, tag_texts(model, texts), strict=True):
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        fresh = [s for s in more if not any(a < s[2] and s[1] < b for a, b in taken)]
        rank = lambda s: (TAGGED.index(s[0]), s[1])
        out.append((sorted(base, key=rank), sorted(base + fresh, key=rank)))
    return out


def find_personal_data(docs: DataFrame, model: Tagger | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base array<string>, spans array<string>) for every row: ``kind:start:end`` by kind and start.

    Code points, end exclusive. Null texts count as empty, bytes that are not valid UTF-8 as U+FFFD; texts without a digit or @ have no spans;
    repeated rows get equal answers. Whole texts are read; there is no shuffle.
    """
    tagger = docs.sparkSession.sparkContext.broadcast(model or shared_tagger(docs.sparkSession))

    def work(batch: pa.RecordBatch) -> dict:
        raw = text_list(batch.column(1))
        hot = [i for i, t in enumerate(raw) if TRIGGER.search(t)]
        base, spans = [[] for _ in raw], [[] for _ in raw]
        for i, (b, s) in zip(hot, all_spans(tagger.value, [decoded(raw[i]) for i in hot]), strict=True):
            base[i] = [f"{k}:{x}:{y}" for k, x, y in b]
            spans[i] = [f"{k}:{x}:{y}" for k, x, y in s]
        return {"doc_id": batch.column(0), "base": base, "spans": spans}

    rows = docs.select(field(docs, doc_id).alias("doc_id"), field(docs, text).cast("string").alias("text"))
    return scan(rows, work, columns_of(doc_id=docs.schema[doc_id].dataType, base="array<string>", spans="array<string>"))


def redact(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """(doc_id, text) with every span replaced by its kind in brackets."""
    tagger = docs.sparkSession.sparkContext.broadcast(model or shared_tagger(docs.sparkSession))

    def work(batch: pa.RecordBatch) -> dict:
        out = []
        texts = [decoded(t) for t in text_list(batch.column(1))]
        for text, (_, spans) in zip(texts, all_spans(tagger.value, texts), strict=True):
            parts, at = [], 0
            for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
                if a >= at:
                    parts += [text[at:a], f"[{kind}]"]
                    at = b
            out.append("".join(parts) + text[at:])
        return {"doc_id": batch.column(0), "text": out}

    return scan(docs.select("doc_id", "text"), work, columns_of(doc_id=docs.schema["doc_id"].dataType, text="string"))
