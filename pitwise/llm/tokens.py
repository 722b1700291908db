"""Token counts by finite-state transducers compiled from a tokenizer's vocabulary.

In the encoding of a text by byte-pair merges, the last token before any place is settled by the
text up to there, and two tokens may stand side by side exactly if merging the two of them alone
gives them back. So a machine can read the text once. Its state is the longest end of what it has
read that begins some token, with the last token before each place of that end; each transition
carries the change in the number of tokens. States and transitions are made when a text first
needs them and kept in one hash table per process.

Texts are cut at places that no token spans (a space after something else, characters outside the
vocabulary) and into chunks, which the machine reads in lockstep. A chunk maps the state before it
to the state after it and a count; the map of a chunk within a long stretch is made for a state
guessed from the characters before, and neighbouring maps compose where the states meet. Those
that do not meet are made anew for the right state.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, field, scan, text_list

#: Tokens above which a document is marked.
LIMIT = 4096
#: Characters of a chunk, and those read before it to guess its state.
CHUNK, BEFORE = 64, 32
#: Text bytes that are counted at once, and transitions after which a process starts its table anew.
WORK_BYTES, MOST_TRANSITIONS = 2 << 20, 1 << 22
SPACE = "▁"
#: A character outside the vocabulary, which separates what follows from the space that the library puts first.
OUTSIDE = "\n"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Transducer:
    """A deterministic machine that counts the tokens of a SentencePiece BPE model with byte fallback."""

    def __init__(self, model: bytes):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        kinds = (library.is_control, library.is_unknown, library.is_byte)
        plain = [i for i in range(library.get_piece_size()) if not any(kind(i) for kind in kinds)]
        self.pieces = {library.id_to_piece(i): i for i in plain}
        self.prefixes = {p[:n] for p in self.pieces for n in range(len(p) + 1)}
        alphabet = sorted({c for p in self.pieces for c in p})
        self._require(all(c in self.pieces for c in alphabet) and SPACE in self.pieces, "characters of pieces are pieces")
        self._require(all(SPACE not in p.lstrip(SPACE) for p in self.pieces), "no piece spans a space that follows something else")
        self._require(not any(library.is_unused(i) for i in plain) and sum(map(library.is_byte, range(library.get_piece_size()))) == 256 and OUTSIDE not in self.pieces, "all pieces are in use, and every byte has one")
        self._require(library.encode("  a ﬁ", out_type=str) == library.encode("  a ", out_type=str) + library.encode("ﬁ", out_type=str)[1:] and library.decode(library.encode("  a  Ⅳ ")) == "  a  Ⅳ ", "texts are taken as they are, behind one space")
        #: class of each code point: 1 and up for the alphabet, minus its UTF-8 length for any other
        self.classes = np.repeat(np.array([-1, -2, -3, -4], np.int32), [0x80, 0x780, 0xF800, 0x100000])
        self.classes[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.space = self.classes[ord(" ")] = int(self.classes[ord(SPACE)])
        self.alphabet = ["", *alphabet]
        self._valid: dict[tuple[str, str], bool] = {}
        self._library = library
        self.forget()

    @staticmethod
    def _require(holds: bool, what: str) -> None:
        if not holds:
            raise ValueError(f"this model can't be compiled; it has to be so that {what}")

    def forget(self) -> None:
        """An empty table; state 0 has read nothing since the last cut."""
        self.states, self.ids = [("", (None,), (0,))], {("", (None,), (0,)): 0}
        self.n_rows = 0
        self._table(1 << 16)

    def _table(self, size: int) -> None:
        self.keys, self.values = np.full(size, -1, np.int64), np.zeros((size, 2), np.int32)
        self.shift = np.uint64(64 - (size.bit_length() - 1))

    # ------------------------------------------------------------- pairs of tokens

    def follows(self, before: str | None, token: str) -> bool:
        """Whether ``token`` may stand after ``before`` (None: first after a cut): merging the two alone gives them back."""
        pair = (before or "", token)
        if pair not in self._valid:
            ids = self._library.encode(OUTSIDE + pair[0] + token)[2:]
            own = [self.pieces[t] for t in pair if t]
            self._valid[pair] = ids == own and (not before or self.follows(None, token))
        return self._valid[pair]

    # --------------------------------------------------------------- transitions

    def _add(self, state: int, char: int) -> tuple[int, int]:
        """(next state, change of the count) when ``state`` reads the character of class ``char``."""
        end, last, count = self.states[state]
        grown = end + self.alphabet[char]
        # the one token that may end here, tried from the longest
        at = next(j for j in range(len(grown)) if grown[j:] in self.pieces and self.follows(last[j], grown[j:]))
        change = count[at] + 1
        last, count = (*last, grown[at:]), (*(c - change for c in count), 0)
        drop = next(j for j in range(len(grown) + 1) if grown[j:] in self.prefixes)
        made = (grown[drop:], last[drop:], count[drop:])
        if made not in self.ids:
            self.ids[made] = len(self.states)
            self.states.append(made)
        return self.ids[made], change

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or the free one where it belongs."""
        mask = len(self.keys) - 1
        slots = (keys.astype(np.uint64) * MULTIPLIER >> self.shift).astype(np.int64)
        held = self.keys[slots]
        wrong = np.flatnonzero((held != keys) & (held >= 0))
        while len(wrong):
            slots[wrong] = slots[wrong] + 1 & mask
            held = self.keys[slots[wrong]]
            wrong = wrong[(held != keys[wrong]) & (held >= 0)]
        return slots

    def _grow(self, keys: np.ndarray) -> None:
        """Transitions for (new) keys; the table stays at most a quarter full."""
        width = len(self.alphabet)
        values = np.array([self._add(*divmod(k, width)) for k in keys.tolist()], np.int32)
        while 4 * (self.n_rows + len(keys)) > len(self.keys):
            used = self.keys >= 0
            old, kept = self.keys[used], self.values[used]
            self._table(2 * len(self.keys))
            self._put(old, kept)
        self._put(keys, values)
        self.n_rows += len(keys)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        left = np.arange(len(keys))
        while len(left):
            slots = self._slots(keys[left])
            _, first = np.unique(slots, return_index=True)  # one key a slot, the others look further
            self.keys[slots[first]] = keys[left[first]]
            self.values[slots[first]] = values[left[first]]
            left = np.delete(left, first)

    def step(self, states: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = states * len(self.alphabet) + chars
        slots = self._slots(keys)
        missing = self.keys[slots] != keys
        if missing.any():
            self._grow(np.unique(keys[missing]))
            slots = self._slots(keys)
        found = self.values[slots]
        return found[:, 0].astype(np.int64), found[:, 1]

    # --------------------------------------------------------------------- texts

    def read(self, chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state after, count) of chunks of ``chars`` read in lockstep from the given states."""
        order = np.argsort(-sizes, kind="stable")
        at, now, total = starts[order], states[order].astype(np.int64), np.zeros(len(order), np.int64)
        alive = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), "left")  # chunks longer than t
        for t, n in enumerate(alive.tolist()):
            now[:n], change = self.step(now[:n], chars[at[:n] + t])
            total[:n] += change
        after, count = np.empty_like(now), np.empty_like(total)
        after[order], count[order] = now, total
        return after, count

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text (UTF-8; what is not valid counts as U+FFFD each time)."""
        if self.n_rows > MOST_TRANSITIONS:
            self.forget()
        strings = [" " + t.decode("utf-8", "replace") if t else "" for t in texts]
        chars = self.classes[np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)].astype(np.int64)
        first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)))])
        out = np.zeros(len(texts), np.int64)
        if not len(chars):
            return out
        known, space = chars > 0, chars == self.space
        upto = np.concatenate([[0], np.cumsum(np.where(known, 0, -chars))])  # bytes of characters outside the vocabulary
        out += upto[first[1:]] - upto[first[:-1]]
        cut = ~known
        cut[1:] |= ~known[:-1] | (space[1:] & ~space[:-1])
        cut[first[:-1][first[:-1] < len(chars)]] = True
        edges = np.append(np.flatnonzero(cut), len(chars))
        begin, size = edges[:-1], np.diff(edges)
        begin, size = begin[known[begin]], size[known[begin]]
        # stretches as chunks: the first starts from state 0, later ones from a guess
        n = -(-size // CHUNK)
        stretch = np.repeat(np.arange(len(begin)), n)
        k = np.arange(len(stretch)) - np.repeat(np.cumsum(n) - n, n)
        starts = begin[stretch] + k * CHUNK
        sizes = np.minimum(CHUNK, size[stretch] - k * CHUNK)
        before, later = np.zeros(len(starts), np.int64), np.flatnonzero(k > 0)
        before[later] = self.read(chars, starts[later] - BEFORE, np.full(len(later), BEFORE), np.zeros(len(later), np.int64))[0]
        after, count = self.read(chars, starts, sizes, before)
        while len(later):
            # maps compose where the state after a chunk is the one that the next was read from
            apart = later[after[later - 1] != before[later]]
            if not len(apart):
                break
            before[apart] = after[apart - 1]
            after[apart], count[apart] = self.read(chars, starts[apart], sizes[apart], before[apart])
        doc = np.searchsorted(first, starts, "right") - 1
        return out + np.bincount(doc, count, len(texts)).astype(np.int64)


@functools.lru_cache(maxsize=2)
def _compiled(model: bytes) -> Transducer:
    return Transducer(model)


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; ``model`` is the path of a SentencePiece file.

    The driver reads the file (some hundred kilobytes) and broadcasts it, so executors need none.
    Null and empty texts have no tokens; repeated rows come back as often as they came; an empty
    table gives no rows. There is no shuffle.
    """
    with open(model, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def work(batch: pa.RecordBatch) -> dict:
        texts = text_list(batch.column(1))
        n = _compiled(shared.value).counts(texts)
        return {"doc_id": batch.column(0), "n_bytes": [len(t) for t in texts], "n_tokens": n, "over_limit": n > limit}

    rows = docs.select(field(docs, doc_id).alias("doc_id"), field(docs, text).cast("string").alias("text"))
    return scan(rows, work, columns_of(doc_id=docs.schema[doc_id].dataType, n_bytes="bigint", n_tokens="bigint", over_limit="boolean"), limit=WORK_BYTES)


def totals(counts: DataFrame, *by: str) -> DataFrame:
    """Documents, bytes, tokens and documents over the limit, by the given columns of ``counts``."""
    return counts.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"), F.count_if("over_limit").alias("n_over"))
