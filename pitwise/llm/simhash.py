"""SimHash near-duplicates, candidates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Two fingerprints that differ in at
most four bits have two segments with at most two differing bits between them (pigeonhole), and
then some pair of words lies within one bit of both. Its key is the Golay codeword index of the
first word (12 bits) with the second word as it is: a fingerprint gets, for each pair of segments,
the keys of its own words and of all words one bit away, where bits flipped in the first segment
fall onto six codewords at most. That makes 75 keys on average, of 30 or 35 bits, so that chance
meetings stay rare among billions. Equal keys are joined and the bits that differ are counted,
which makes the links exact.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, field, materialize, mix, packed, scan, text_list, unpacked

#: Generator polynomial of the binary Golay code [23, 12, 7].
GOLAY = 0b110001110101
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Fingerprints of one key that a task compares with each other; more are compared in blocks of this size.
BLOCK = 4096
#: Runs up to this length are compared all at once, as arrays.
SHORT = 8
#: Broadcast no more hot keys than this; more are joined by shuffle.
MAX_BROADCAST_KEYS = 100_000
#: Fingerprints whose keys one task makes (about 75 each).
FPS_PER_TASK = 20_000
#: A key of a join is split where it has more rows than this and more than a ten-thousandth of all: 10,000 keys at most.
LEAST_SPLIT, MOST_SPLIT_KEYS = 256, 10_000
#: Sample fingerprints of a text, and shingles of a sample.
SAMPLES, SAMPLE = 8, 3
#: Texts of one key that are compared each with each; likeness to a leader from which a text is no leader itself.
FEW, VERY = 12, 0.85
#: Text bytes whose shingles are held at once.
PRINT_BYTES = 1 << 20
#: Leaders that a new leader is linked to at first; what that leaves apart is compared in full (``rest_links``).
NEAREST = 8
#: Shingles of a block of texts that are compared in full: two such blocks are held at once, 8 bytes a shingle.
SET_BLOCK = 1 << 19
#: Sketches estimate likeness to 0.05 or so; that much below the bound and two more are looked at.
SLACK = 0.15


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of the k-word shingles of a text; of the whole sequence where words are fewer."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < k:
        return np.array([digest(joined, 42)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    spans = zip((ends - sizes)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], 42) for a, b in spans], np.uint64)


def simhash(text: bytes, k: int = 4) -> int:
    """Bits that are set in over half the shingle hashes; 0 for a text without words."""
    return simhash_of(shingle_hashes(text, k))


def simhash_of(h: np.ndarray) -> int:
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 65536):
        part = np.ascontiguousarray(h[a : a + 65536])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row; whitespace separates words, A-Z count as a-z."""

    def work(batch: pa.RecordBatch) -> dict:
        fps = np.array([simhash(t, k) for t in text_list(batch.column(1))], np.uint64)
        return {"doc_id": batch.column(0), "fp": pa.array(fps.view(np.int64))}

    rows = docs.select(field(docs, doc_id).alias("doc_id"), field(docs, text).cast("string").alias("text"))
    return scan(rows, work, columns_of(doc_id=docs.schema[doc_id].dataType, fp="bigint"))


# ------------------------------------------------------------------ Golay keys


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the three bytes of a word, and the error of at most three bits for each syndrome."""

    def syndrome(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY << (bit - 11)
        return word

    ones = [syndrome(1 << i) for i in range(23)]
    by_byte = []
    for shift in (0, 8, 16):
        t = np.zeros(256, np.uint32)
        for v in range(256):
            for i in range(min(8, 23 - shift)):
                t[v] ^= ones[shift + i] if v >> i & 1 else 0
        by_byte.append(t)
    errors = np.zeros(2048, np.uint32)
    for i in range(23):
        errors[ones[i]] = 1 << i
        for j in range(i):
            errors[ones[i] ^ ones[j]] = 1 << i | 1 << j
            for m in range(j):
                errors[ones[i] ^ ones[j] ^ ones[m]] = 1 << i | 1 << j | 1 << m
    return (*by_byte, errors)


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word (never over three bits away)."""
    low, mid, high, errors = _tables()
    w = words.astype(np.uint32)
    return (w ^ errors[low[w & 255] ^ mid[w >> 8 & 255] ^ high[w >> 16]]) >> 11


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position of the fingerprint) for every key of every fingerprint."""
    words, near = [], []
    for shift, width in SEGMENTS:
        word = (fps >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)
        around = word[:, None] ^ np.concatenate([[0], 1 << np.arange(width)])
        words.append(around)
        near.append(codeword_index(around).astype(np.int64))
    keys, rows = [], []
    for pair, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        decoded = np.sort(near[a], 1)
        fresh = np.ones(decoded.shape, bool)
        fresh[:, 1:] = decoded[:, 1:] != decoded[:, :-1]
        at = np.nonzero(fresh)[0]
        keys += [decoded[fresh] << 23 | words[b][at, 0] | pair << 35, (near[a][:, :1] << 23 | words[b][:, 1:] | pair << 35).ravel()]
        rows += [at, np.repeat(np.arange(len(fps)), words[b].shape[1] - 1)]
    return np.concatenate(keys), np.concatenate(rows)


def _golay_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for a in range(0, len(all_fps), 4096):
            fps = all_fps[a : a + 4096]
            keys, rows = keys_of(fps)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows].view(np.int64))], ["key", "fp"])


# ----------------------------------------------------------------------- links


def spanning_links(fps: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Links that connect what is connected among distinct fingerprints: fewer than there are fingerprints.

    Each fingerprint is compared once with those not reached yet, so no list of all pairs is made.
    """
    left, u, v = fps, [], []
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            at = reached.pop()
            hit = np.bitwise_count(left ^ at) <= bits
            if hit.any():
                found = left[hit]
                u += [int(at)] * len(found)
                v += found.tolist()
                reached += list(found)
                left = left[~hit]
    return u, v


def _links(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def found(unit: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]).any(1)]))
            sizes = np.diff(np.append(starts, len(fps)))
            of = np.repeat(np.arange(len(starts)), sizes)
            small = sizes[of] <= SHORT
            us, vs = [], []
            for d in range(1, SHORT):
                if len(fps) > d:
                    x, y = fps[:-d], fps[d:]
                    hit = (of[:-d] == of[d:]) & small[d:] & (x != y)
                    hit[hit] = np.bitwise_count(x[hit] ^ y[hit]) <= bits
                    us.append(x[hit])
                    vs.append(y[hit])
            for a, n in zip(starts[sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist(), strict=True):
                u, v = spanning_links(np.unique(fps[a : a + n]), bits)
                us.append(np.array(u, np.uint64))
                vs.append(np.array(v, np.uint64))
            edges = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], 1), axis=0) if us else np.empty((0, 2), np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(edges[:, i]).view(np.int64)) for i in (0, 1)], ["u", "v"])

        def arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            key, part, fp = (t.column(i).to_numpy() for i in range(3))
            return np.stack([key, part], 1), fp.view(np.uint64)

        for batch in batches:
            t = pa.Table.from_batches([batch]).combine_chunks()
            t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
            unit, fps = arrays(t)
            same = (unit == unit[-1]).all(1)
            last = len(fps) - int(np.argmin(same[::-1])) if not same.all() else 0
            if last:
                yield found(unit[:last], fps[:last])
            rest = t.slice(last)
        if rest is not None and rest.num_rows:
            yield found(*arrays(rest))

    return run


def links(fps: DataFrame, bits: int = 4, block: int = BLOCK) -> DataFrame:
    """(u, v): links between distinct fingerprints that differ in at most ``bits`` bits.

    Not all pairs, but enough that what all pairs connect stays connected. Keys with more than
    ``block`` fingerprints are dealt out as pairs of blocks, so no task gets a whole hot key.
    """
    if bits > 4:
        raise ValueError("segment pairs find at most 4 differing bits")
    single = fps.select("fp").distinct()
    # rows multiply here, so the tasks are counted by what they make and not by the bytes they read
    spread = single.repartition(max(1, -(-fps.count() // FPS_PER_TASK)), "fp")
    keys = spread.mapInArrow(_golay_rows, "key long, fp long")
    hot = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block), "golay-hot")
    hot = hot.select("key", F.ceil(F.col("n") / block).cast("int").alias("g"))
    n_hot = hot.count()
    if not n_hot:
        dealt = keys.withColumn("part", F.lit(0))
    else:
        side = F.broadcast(hot) if n_hot <= MAX_BROADCAST_KEYS else hot
        marked = keys.join(side, "key", "left").withColumn("g", F.coalesce("g", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
        marked = marked.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        dealt = marked.withColumn("part", F.least("own", "other") * F.col("g") + F.greatest("own", "other"))
    dealt = dealt.select("key", "part", "fp").repartition("key", "part").sortWithinPartitions("key", "part", "fp")
    return dealt.mapInArrow(_links(bits), "u long, v long").distinct()


# ------------------------------------------------------------------ components


def split_join(rows: DataFrame, found: DataFrame, key: str, by: str, n_rows: int) -> DataFrame:
    """``rows`` joined with ``found`` (one row for each ``key``, ``n`` rows of the key) without gathering a large key in one task.

    Keys above the split size are dealt out by a hash of ``by``, their row of ``found`` goes to
    every part. No more than MOST_SPLIT_KEYS keys can be above it, which bounds the broadcast.
    """
    most = max(LEAST_SPLIT, n_rows // MOST_SPLIT_KEYS + 1)
    parts = F.ceil(F.col("n") / most).cast("int")
    large = found.filter(F.col("n") > most).select(key, parts.alias("parts"))
    dealt = rows.join(F.broadcast(large), key, "left").withColumn("part", F.pmod(F.xxhash64(by), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copies = F.when(F.col("n") > most, parts - 1).otherwise(0)
    return dealt.join(found.withColumn("part", F.explode(F.sequence(F.lit(0), copies))).drop("n"), [key, "part"]).drop("part")


def components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, root): the smallest node that each linked node can reach.

    Alternates large-star and small-star rounds until nothing changes; every round is a few split
    joins and grouped minima over edges, so a hub is never gathered in one place. The rounds grow
    with the logarithm of the longest path; where ``max_rounds`` is given and not enough, this raises.
    """
    edges = materialize(edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).filter("a <> b").distinct(), "star")
    before, rounds = None, 0
    count = edges.count()
    while True:
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError(f"components are not complete after {rounds} rounds")
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")), "star-least")
        large = split_join(both.filter("b > a"), least, "a", "b", 2 * count).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(large.filter("a <> b").distinct(), "star")
        least = materialize(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "star-least")
        small = split_join(edges, least, "a", "b", count).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = materialize(small.filter("a <> b").distinct(), "star")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, count, rounds = now, now[0], rounds + 1


def near_duplicates(docs: DataFrame, k: int = 4, bits: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id) of every row: the smallest doc_id that links of fingerprints reach.

    Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows come back
    as often as they came; null ids never win a component unless it has no other (then it is null).
    """
    fps = materialize(fingerprints(docs, k, doc_id, text), "simhash")
    owners = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "simhash-owners")
    roots = components(links(owners.select("fp"), bits))
    # the root itself is no node of its own: each component has its nodes and one row for the root
    linked = materialize(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).join(owners, roots["node"] == owners["fp"]).select("fp", "root", "first"), "simhash-linked")
    least = materialize(linked.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n")), "simhash-least")
    moved = split_join(linked.select("fp", "root"), least, "root", "fp", linked.count()).select("fp", F.col("component_id").alias("moved"), F.lit(True).alias("linked"))
    of = owners.join(moved, "fp", "left").select("fp", F.when(F.col("linked"), F.col("moved")).otherwise(F.col("first")).alias("component_id"), "n")
    return split_join(fps, materialize(of, "simhash-of"), "fp", "doc_id", fps.count()).select("doc_id", "fp", "component_id")


def one_per_group(docs: DataFrame, k: int = 4, bits: int = 4) -> DataFrame:
    """One row of each near-duplicate group, with all its columns, whatever those are called: the one with the smallest doc_id.

    Rows of one id are told apart by a hash of the text; of equal rows one stays. A null id stays
    only where its group has no other.
    """
    return _first_of_groups(docs, lambda rows: near_duplicates(rows, k, bits))


def _first_of_groups(docs: DataFrame, groups: Callable[[DataFrame], DataFrame]) -> DataFrame:
    rank = F.struct(field(docs, "doc_id").isNull().alias("none"), field(docs, "doc_id").alias("id"), F.xxhash64(field(docs, "text")).alias("tag"))
    found = groups(docs.select(rank.alias("doc_id"), field(docs, "text").alias("text")))
    kept = found.filter("doc_id = component_id").select("doc_id").distinct()
    # equal rows are merged before they are dealt out by the same key that the join asks for
    single = docs.select(rank.alias("doc_id"), packed(docs).alias("row")).dropDuplicates(["doc_id"])
    return unpacked(single.join(kept, "doc_id", "left_semi"), "row", docs.columns)


# ----------------------------------------------------- groups by shared shingles


class Print(NamedTuple):
    """What stands for a set of shingles: two digests, its size, the fingerprint, sample fingerprints, a sketch."""

    low: int
    high: int
    size: int
    fp: int
    samples: list[int]
    sketch: bytes


def print_of(text: bytes, k: int = 5) -> Print:
    """SimHash of all shingles, and of SAMPLES samples: those few that a seed's scrambling puts first.

    Sets that share a share J of their shingles have one sample in common with chance J ** SAMPLE.
    The sketch holds a byte of the least scrambled hash in each of 64 ranges, 0 where there is none.
    """
    h = shingle_hashes(text, k)
    fp = simhash_of(h)
    h = np.unique(h)
    samples = []
    for seed in range(1, SAMPLES + 1):
        m = mix(h ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
        m = np.partition(m, SAMPLE - 1)[:SAMPLE] if len(m) > SAMPLE else m
        ones = np.unpackbits(m.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        samples.append(int(np.packbits(2 * ones > len(m), bitorder="little").view("<i8")[0]))
    m = np.sort(mix(h))
    at = np.searchsorted(m, np.arange(64, dtype=np.uint64) << np.uint64(58))
    held = np.append(m, np.uint64(0))[at]
    there = (at < len(m)) & (held >> np.uint64(58) == np.arange(64, dtype=np.uint64))
    sketch = np.where(there, (held >> np.uint64(16)) % np.uint64(255) + np.uint64(1), np.uint64(0)).astype(np.uint8).tobytes()
    raw = h.tobytes()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return Print(signed(xxhash.xxh64_intdigest(raw, 1)), signed(xxhash.xxh64_intdigest(raw, 2)), len(h), signed(fp), samples, sketch)


def prints(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, low, high, size, fp, samples, sketch) of every row."""

    def work(batch: pa.RecordBatch) -> dict:
        made = [print_of(t, k) for t in text_list(batch.column(1))]
        return {"doc_id": batch.column(0), **{n: [getattr(p, n) for p in made] for n in Print._fields}}

    types = {"low": "bigint", "high": "bigint", "size": "bigint", "fp": "bigint", "samples": "array<bigint>", "sketch": "binary"}
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return scan(rows, work, columns_of(doc_id=docs.schema["doc_id"].dataType, **types), limit=PRINT_BYTES)


def alike(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Estimated share of shingles that each of ``sketches`` has in common with ``one``."""
    both = ((sketches == one) & (one > 0)).sum(1)
    return both / np.maximum(((sketches > 0) | (one > 0)).sum(1), 1)


def likely_links(ids: np.ndarray, sketches: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    """Pairs of one key that seem at least ``least`` alike; ids rise.

    A few are compared each with each. Of many, each is compared with the leaders before it: it is
    linked to the one most like it where that is very like it, else it is a leader itself, linked to
    those most like it among those that seem alike. That joins most of what belongs together, with
    links that grow with the rows; what it leaves apart is for ``rest_links``.
    """
    u, v = [], []
    if len(ids) <= FEW:
        for i in range(1, len(ids)):
            hit = np.flatnonzero(alike(sketches[:i], sketches[i]) >= least)
            u += ids[hit].tolist()
            v += [int(ids[i])] * len(hit)
        return u, v
    leaders = [0]
    for i in range(1, len(ids)):
        near = alike(sketches[leaders], sketches[i])
        best = int(near.argmax())
        hit = np.array([best]) if near[best] >= VERY else np.argsort(-near, kind="stable")[:NEAREST]
        hit = hit[near[hit] >= least]
        u += ids[np.array(leaders)[hit]].tolist()
        v += [int(ids[i])] * len(hit)
        if near[best] < VERY:
            leaders.append(i)
    return u, v


def verified_links(ids: np.ndarray, groups: np.ndarray, sides: np.ndarray, sizes: np.ndarray, values: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    """Links between texts of different ``groups`` that share ``least`` of their shingles: as many as connect what all such links connect.

    ``values`` holds the texts' sets one after the other. Each text is compared once with those whose
    group is not reached yet, and where there are two sides with those of the other side. Texts so
    alike have a shingle in common among the rarest of both (their heads: all but ``least`` of a set,
    and one more), so only those are counted. No estimate is involved.
    """
    n, starts = len(ids), np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(n), sizes)
    _, code, often = np.unique(values, return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    code = rank[code]
    code = code[np.lexsort((code, owner))]  # each text's rarest shingles first
    heads = sizes - np.ceil(least * sizes - 1e-9).astype(np.int64) + 1
    at_head = np.flatnonzero(np.arange(len(code)) - starts[owner] < heads[owner])
    by_code = at_head[np.argsort(code[at_head], kind="stable")]
    holders, bounds = owner[by_code], np.searchsorted(code[by_code], np.arange(len(often) + 1))
    _, group, members = np.unique(groups, return_inverse=True, return_counts=True)
    of_group = np.split(np.argsort(group, kind="stable"), np.cumsum(members)[:-1])
    apart = len(np.unique(sides)) > 1
    left, mark, u, v = np.ones(n, bool), np.zeros(len(often), np.uint8), [], []
    for seed in range(len(of_group)):
        if not left[of_group[seed][0]]:
            continue
        reached = of_group[seed].tolist()
        left[reached] = False
        while reached and left.any():
            at = reached.pop()
            own = code[starts[at] : starts[at] + sizes[at]]
            seen = np.zeros(n, bool)
            seen[np.concatenate([holders[bounds[c] : bounds[c + 1]] for c in own[: heads[at]].tolist()])] = True
            near = seen & left & (sizes >= least * sizes[at]) & (least * sizes <= sizes[at])
            near = np.flatnonzero(near & (sides != sides[at]) if apart else near)
            if not len(near):
                continue
            ends = np.cumsum(sizes[near])
            begins = ends - sizes[near]
            mark[own] = 1
            shared = np.add.reduceat(mark[code[np.arange(ends[-1]) + np.repeat(starts[near] - begins, sizes[near])]], begins, dtype=np.int64)
            mark[own] = 0
            near = near[shared >= least * (sizes[at] + sizes[near] - shared)]
            for g, first in zip(*np.unique(group[near], return_index=True), strict=True):
                u.append(int(ids[at]))
                v.append(int(ids[near[first]]))
                reached += of_group[g].tolist()
                left[of_group[g]] = False
    return u, v


def _of_units(links_of: Callable[[pa.Table], tuple[list[int], list[int]]]):
    """A task's work: ``links_of`` on the rows of each (key, part), which come sorted; no more than one unit and a batch are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def found(t: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table | None]:
            unit = np.stack([t.column(i).to_numpy() for i in (0, 1)], 1)
            starts = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]).any(1)])).tolist()
            ends = [*starts[1:], len(unit)]
            if not last:  # the last key may go on
                keep = t.slice(starts[-1])
                starts, ends = starts[:-1], ends[:-1]
            u, v = [], []
            for a, b in zip(starts, ends, strict=True):
                if b - a > 1:
                    x, y = links_of(t.slice(a, b - a))
                    u += x
                    v += y
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"]), None if last else keep

        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch])
                made, rest = found((t if rest is None else pa.concat_tables([rest, t])).combine_chunks(), False)
                yield made
        if rest is not None:
            yield found(rest, True)[0]

    return run


def _likely(least: float):
    def links_of(t: pa.Table) -> tuple[list[int], list[int]]:
        sketches = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(t.num_rows, -1)
        return likely_links(t.column("id").to_numpy(), sketches, least)

    return _of_units(links_of)


def _verified(least: float):
    def links_of(t: pa.Table) -> tuple[list[int], list[int]]:
        ids, roots, sides = (t.column(c).to_numpy() for c in ("id", "root", "own"))
        sets = t.column("shingles").combine_chunks()
        return verified_links(ids, roots, sides, pc.list_value_length(sets).to_numpy().astype(np.int64), sets.flatten().to_numpy(), least)

    return _of_units(links_of)


def likely_pairs(owners: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(u, v): owners with a sample fingerprint in common whose sketches are at least ``least`` alike; hot keys are dealt out as pairs of blocks."""
    keys = sample_keys(owners, "sketch")
    sizes = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sample-keys")
    shared = split_join(keys, sizes.withColumn("g", F.ceil(F.col("n") / block).cast("int")), "key", "id", 8 * owners.count())
    own = F.pmod(F.xxhash64("id"), F.col("g")).cast("int")
    dealt = shared.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = dealt.withColumn("part", F.least("own", "other") * F.col("g") + F.greatest("own", "other")).select("key", "part", "id", "sketch")
    return dealt.repartition("key", "part").sortWithinPartitions("key", "part", "id").mapInArrow(_likely(least), "u long, v long").distinct()


def sample_keys(owners: DataFrame, *kept: str) -> DataFrame:
    """(key, id and the columns ``kept``): a row for each sample fingerprint of each text."""
    return owners.select("id", *kept, F.posexplode("samples").alias("nth", "sample")).select(F.xxhash64("nth", "sample").alias("key"), "id", *kept)


def rest_links(docs: DataFrame, owners: DataFrame, roots: DataFrame, sets: DataFrame, k: int, least: float) -> DataFrame | None:
    """(u, v): links between texts of one crowded key that ``roots`` has in different groups, by the sets themselves; None where there is no such key.

    Crowded keys are those whose texts ``likely_links`` does not compare each with each. Within a key
    no two texts of one group have to meet, so its largest group is dealt out once to blocks of
    SET_BLOCK shingles, and the others meet those blocks and each other as pairs of blocks.
    """
    grouped = owners.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    keys = sample_keys(grouped, "size", "root")
    groups = keys.groupBy("key", "root").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("n"))
    found = groups.groupBy("key").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.max(F.struct("weight", "root")).alias("main"), F.count(F.lit(1)).alias("groups"))
    blocks = lambda weight: F.ceil(weight / SET_BLOCK).cast("int")
    found = found.filter(f"n > {FEW} and groups > 1").select("key", "n", F.col("main.root").alias("main"), blocks(F.col("weight") - F.col("main.weight")).alias("a"), blocks(F.col("main.weight")).alias("b"))
    found = materialize(found, "crowded-keys")
    if found.isEmpty():
        return None
    place = F.when(F.col("root") == F.col("main"), F.col("a") + F.pmod(F.xxhash64("id"), F.col("b"))).otherwise(F.pmod(F.xxhash64("id"), F.col("a")))
    rows = split_join(keys, found, "key", "id", SAMPLES * owners.count())
    rows = materialize(rows.select("key", "id", "root", place.cast("int").alias("own"), "a", (F.col("a") + F.col("b")).alias("g")), "crowded-rows")
    missing = rows.select("id").distinct().join(sets, "id", "left_anti").join(owners.select("id", "first"), "id")
    held = sets.unionByName(sets_of(docs, missing.select(F.col("first").alias("doc_id"), "id", F.lit(1).cast("long").alias("n")), k)).select("id", "shingles")
    last = F.when(F.col("own") < F.col("a"), F.col("g") - 1).otherwise(F.col("a") - 1)
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    dealt = dealt.withColumn("part", F.least("own", "other") * F.col("g") + F.greatest("own", "other")).select("key", "part", "own", "id", "root")
    dealt = dealt.join(held, "id").select("key", "part", "own", "id", "root", "shingles").repartition("key", "part").sortWithinPartitions("key", "part", "id")
    return materialize(dealt.mapInArrow(_verified(least), "u long, v long").distinct(), "crowded-links")


def shingle_groups(docs: DataFrame, k: int = 5, least: float = 0.8, bits: int = 4) -> DataFrame:
    """(doc_id, component_id) of every row: groups of texts that share ``least`` of their ``k``-word shingles, pair by pair.

    Candidates are texts whose fingerprints differ in up to ``bits`` bits (by Golay keys) and texts
    with a sample fingerprint in common; each counts only if the sets of shingles themselves, as
    64-bit hashes, are alike enough. Where many texts have a sample in common, a first choice of
    links makes groups, then all texts of different groups are compared by their sets. Texts with equal sets are one. Null and empty texts have no
    shingles and form one group; repeated rows come back as often as they came.
    """
    made = materialize(prints(docs, k), "prints")
    one = made.groupBy("low", "high").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"), F.min("size").alias("size"), F.min("fp").alias("fp"), F.min("samples").alias("samples"), F.min("sketch").alias("sketch"))
    owners = materialize(one.withColumn("id", F.monotonically_increasing_id()), "print-owners")
    able = owners.filter("size > 0")
    by_fp = materialize(able.groupBy("fp").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "print-fps")
    fp_id = by_fp.select(F.col("fp").alias("f"), F.col("id").alias("i"))
    close = links(by_fp.select("fp"), bits).join(fp_id, F.col("u") == F.col("f")).select(F.col("i").alias("u"), "v").join(fp_id, F.col("v") == F.col("f")).select("u", F.col("i").alias("v"))
    same = split_join(able.select("fp", F.col("id").alias("v")), by_fp, "fp", "v", owners.count()).select(F.col("id").alias("u"), "v").filter("u <> v")
    pairs = close.unionByName(same).unionByName(likely_pairs(able, least - SLACK)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    pairs = materialize(pairs, "print-pairs")
    sizes = able.select("id", "size", "first")
    n_pairs = pairs.count()
    # the texts of candidates are read again for their shingles
    ends = materialize(pairs.select("u").unionByName(pairs.select(F.col("v").alias("u"))).groupBy("u").agg(F.count(F.lit(1)).alias("n")), "print-ends")
    sets = sets_of(docs, ends.join(sizes, ends["u"] == sizes["id"]).select(F.col("first").alias("doc_id"), "id", "n"), k)
    half = split_join(pairs, sets.select(F.col("id").alias("v"), F.col("shingles").alias("b"), "n"), "v", "u", n_pairs)
    whole = half.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u")
    shared = F.size(F.array_intersect("a", "b"))
    true = whole.filter(shared >= least * (F.size("a") + F.size("b") - shared)).select("u", "v")
    roots = components(true)
    rest = rest_links(docs, able, roots, sets, k, least)
    if rest is not None and not rest.isEmpty():
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(rest))
    linked = materialize(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).join(owners.select("id", "first"), F.col("node") == F.col("id")).select("id", "root", "first"), "print-linked")
    firsts = materialize(linked.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n")), "print-firsts")
    moved = split_join(linked.select("id", "root"), firsts, "root", "id", linked.count()).select("id", F.col("component_id").alias("moved"))
    of = owners.join(moved, "id", "left").select("low", "high", F.coalesce("moved", "first").alias("component_id"), "n")
    names = of.select(F.struct("low", "high").alias("at"), "component_id", "n")
    return split_join(made.select("doc_id", F.struct("low", "high").alias("at")), materialize(names, "print-of"), "at", "doc_id", made.count()).select("doc_id", "component_id")


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``shingle_sets`` of the texts that ``wanted`` (doc_id, id, n) names, as a table with one row for each id."""
    wanted = materialize(wanted, "print-wanted")
    few = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST_KEYS else wanted
    return materialize(shingle_sets(docs.join(few, "doc_id"), k).dropDuplicates(["id"]), "print-sets")


def shingle_sets(docs: DataFrame, k: int = 5) -> DataFrame:
    """(id, n, shingles) of rows (id, n, text): the distinct hashes of a text's shingles."""

    def work(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column(0), "n": batch.column(1), "shingles": [np.unique(shingle_hashes(t, k)).view(np.int64) for t in text_list(batch.column(2))]}

    rows = docs.select("id", "n", F.col("text").cast("string").alias("text"))
    return scan(rows, work, columns_of(id="bigint", n="bigint", shingles="array<bigint>"), limit=PRINT_BYTES)


def one_per_shingle_group(docs: DataFrame, k: int = 5, least: float = 0.8, bits: int = 4) -> DataFrame:
    """One row of each group of ``shingle_groups``, with all its columns, whatever those are called: the one with the smallest doc_id.

    Rows of one id are told apart by a hash of the text; of equal rows one stays. A null id stays
    only where its group has no other.
    """
    return _first_of_groups(docs, lambda rows: shingle_groups(rows, k, least, bits))
