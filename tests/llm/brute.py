"""Plain versions of the contracts."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TOKEN = re.compile("[^\x20\x09-\x0d]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def licenses(text):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    words, starts, labels = WORD.findall(low(text)), [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def simhash(text, k=4):
    words = TOKEN.findall(low(text))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, bits=4):
    """The index of the first of each component's values."""
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def shingle_sets(texts, k=5):
    out = []
    for text in texts:
        words = TOKEN.findall(low(text))
        out.append(frozenset(tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))) if words else frozenset())
    return out


def shingle_pairs(texts, least=0.8):
    """All pairs of different sets of shingles that are alike enough; of equal sets the first stands for all."""
    sets, first = shingle_sets(texts), {}
    for i, s in enumerate(sets):
        first.setdefault(s, i)
    seen = Counter(x for s in first for x in s)
    holders, pairs = defaultdict(list), set()
    for s, i in first.items():
        # alike sets share one of their rarest shingles
        rare = sorted(s, key=lambda x: (seen[x], x))[: len(s) - math.ceil(least * len(s)) + 1]
        pairs |= {(j, i) for x in rare for j in holders[x]}
        for x in rare:
            holders[x].append(i)
    return [(a, b) for a, b in sorted(pairs) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]


def shingle_groups(texts, pairs=None):
    """For each text the index of the first of its group."""
    first, sets = {}, shingle_sets(texts)
    parent = [first.setdefault(s, i) for i, s in enumerate(sets)]

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in shingle_pairs(texts) if pairs is None else pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def positions(found, ids):
    """Where the row stands whose id is the value found."""
    at = {d: i for i, d in enumerate(ids)}
    return [at[f] for f in found]


def contamination(text, items, window=13):
    windows = defaultdict(set)
    for item, t in items:
        w = WORD.findall(low(t))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    words = WORD.findall(low(text))
    hit, found = [False] * len(words), set()
    for key, owners in windows.items():
        for i in range(len(words) - len(key) + 1):
            if tuple(words[i : i + len(key)]) == key:
                found |= owners
                hit[i : i + len(key)] = [True] * len(key)
    n = sum(hit)
    return len(words), n, len(found), sha(",".join(sorted(found))), n > 0 and 20 * n >= len(words)


def personal(text):
    text = text or ""
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    find = lambda p: re.finditer(p, text)
    out = [("email", *m.span()) for m in find(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")]
    out += [("ip", *m.span()) for m in find(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in find(r"[0-9]([\x20-]?[0-9])+") if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [("phone", *m.span()) for m in find(r"\+[0-9][\x20().0-9-]+[0-9]") if 8 <= len(digits(m.group())) <= 15]
    return out


def lines(rows):
    blanks = " \t\n\x0b\x0c\r"
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[low(line.strip(blanks))].add(doc)
    out = []
    for doc, text in rows:
        own = (text or "").split("\n")
        keep = []
        for line in own:
            key = low(line.strip(blanks))
            h = holders[key]
            if not (len(key) >= 40 and len(h) >= 5 and doc != max((d for d in h if d is not None), default=None)):
                keep.append(line)
        out.append((doc, len(own), len(own) - len(keep), sha("\n".join(keep))))
    return out


def license_labels(text, notices, drift=3, coverage=0.8, gram=4):
    """(labels of the method alone, largest share) by plain loops over templates, diagonals and words."""
    words, labels, score = WORD.findall(low(text)), set(), 0.0
    places = defaultdict(list)
    for i in range(len(words) - gram + 1):
        places[tuple(words[i : i + gram])].append(i)
    for label, notice in notices:
        t = notice.split()
        diagonals = defaultdict(list)
        for j in range(len(t) - gram + 1):
            for i in places.get(tuple(t[j : j + gram]), ()):
                diagonals[i - j].append(i)
        before, seen = None, set()
        for start, diagonal in sorted((min(at), d) for d, at in diagonals.items()):
            if before is None or abs(diagonal - before[0]) > drift or start > before[1] + len(t):
                seen = set()
            seen |= {i - diagonal + w for i in diagonals[diagonal] for w in range(gram)}
            before = diagonal, max(diagonals[diagonal])
            score = max(score, len(seen) / len(t))
            if len(seen) >= coverage * len(t):
                labels.add(label)
    return labels, score


MASK = (1 << 64) - 1


def scramble(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def piecewise(text, window=7, base=0xD6E8FEB86659FD93):
    """The context-triggered fingerprint of a text (bytes), byte by byte."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rolls = [scramble(sum((text[i + j] + 1) * pow(base, j, 1 << 64) for j in range(window)) & MASK) for i in range(len(text) - window + 1)]

    def signature(block):
        chunks, at = [], 0
        for i, r in enumerate(rolls):
            if r % block == block - 1 and len(chunks) < 63:
                chunks.append(text[at : i + window])
                at = i + window
        if at < len(text):
            chunks.append(text[at:])
        return "".join(alphabet[xxhash.xxh64_intdigest(c) >> 58] for c in chunks)

    if not text:
        return "3::"
    block = 3
    while block * 64 < len(text):
        block *= 2
    while block > 3 and sum(r % block == block - 1 for r in rolls) < 32:
        block //= 2
    return f"{block}:{signature(block)}:{signature(2 * block)}"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def alike(x, y):
    """Likeness of two fingerprints."""
    if x == y:
        return 1.0
    (b, x1, x2), (c, y1, y2) = x.split(":"), y.split(":")
    mine, theirs = {int(b): x1, 2 * int(b): x2}, {int(c): y1, 2 * int(c): y2}
    shared = [(mine[n], theirs[n]) for n in mine if n in theirs and (mine[n] or theirs[n])]
    return max((1 - levenshtein(a, b) / max(len(a), len(b)) for a, b in shared), default=0.0)


def language(text, learned, false_positive, common):
    """(language, score) from plain sets of n-grams for each language, without any filter."""
    folded = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode())
    if not any(c.isalpha() for c in text):
        return "und", 0.0
    line = b" " + b" ".join(folded.split()) + b" "
    own = [int.from_bytes(line[i : i + 4], "big") for i in range(len(line) - 3)]
    hits = {k: max(sum(g in v for g in own) - len(own) * false_positive[k], 0) / (1 - false_positive[k]) for k, v in learned.items()}
    if not sum(hits.values()):
        return common, 0.0
    best = min(hits, key=lambda k: (-hits[k], k))
    return best, hits[best] / sum(hits.values())


def quality_score(machine, text, told, dimensions=1024):
    """The factorisation machine's score, one feature and one pair of features at a time."""
    words = text.split()
    n, k = max(len(text), 1), max(len(words), 1)
    share = lambda chars: sum(text.count(bytes([c])) for c in chars)
    symbols = [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in " .,;:'\"?()-\n"]
    lines = text.split(b"\n")
    pairs = len({(a, b) for a, b in zip(words, words[1:], strict=False)}) if len(words) > 1 else 1
    stats = [
        math.log1p(len(words)), math.log1p(len(text) if told is None else max(told, 0)), n / k, share(range(65, 91)) / n, share(range(97, 123)) / n, share(range(48, 58)) / n, share(symbols) / n,
        sum(c >= 128 for c in text) / n, math.log1p(len(lines)), len(set(lines)) / len(lines), len(set(words)) / k, len(set(words)) / k**0.75, pairs / max(len(words) - 1, 1), share(b".!?") / k,
    ]
    row = defaultdict(float)
    for w in set(words):
        h = zlib.crc32(w)
        row[h % dimensions] += math.sqrt(words.count(w)) * (1 if h >> 20 & 1 else -1)
    size = math.sqrt(sum(v * v for v in row.values())) or 1.0
    x = {i: v / size for i, v in row.items()}
    x |= {dimensions + i: max(-4, min(4, (v - machine.centre[i]) / machine.spread[i])) / math.sqrt(len(stats)) for i, v in enumerate(stats)}
    total = machine.bias + sum(machine.linear[i] * v for i, v in x.items())
    keys = sorted(x)
    total += sum(float(machine.factors[i] @ machine.factors[j]) * x[i] * x[j] for a, i in enumerate(keys) for j in keys[:a])
    return 1 / (1 + math.exp(-total))


def merkle(rows, columns=("doc_id", "source", "lang", "n_chars", "text"), fan=16):
    """(doc_id, leaf, subroot, root, proof digest, folded root, verified) of dict rows, by plain lists."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(enc(r[c]) for c in columns))
    bad = lambda r: zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0

    def tree(digests):
        """The top, and for each leaf its (left, right) siblings level by level."""
        at, level, paths = list(range(len(digests))), list(digests), [[] for _ in digests]
        while len(level) > 1:
            runs = [level[i : i + fan] for i in range(0, len(level), fan)]
            for k, i in enumerate(at):
                run = runs[i // fan]
                paths[k].append(("".join(run[: i % fan]), "".join(run[i % fan + 1 :])))
            at, level = [i // fan for i in at], [sha("".join(run)) for run in runs]
        return level[0], paths

    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in order:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        made[s] = tree([leaf(r) for r in groups[s]])
    root, above = tree([made[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for r, path in zip(groups[s], made[s][1], strict=True):
            path = path + above[k]
            folded = leaf({**r, "text": low(r["text"]) if r["text"] is not None else None}) if bad(r) else leaf(r)
            for left, right in path:
                folded = sha(left + folded + right)
            out.append((r["doc_id"], leaf(r), made[s][0], root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return out


def resampling(rows, target, longest=1, buckets=10000, percent=10, least=20, seed=2024):
    """(doc_id, features, weight, score, rank) of (doc_id, text) rows."""

    def features(text):
        w = WORD.findall(low(text))
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[0])
    for text in target:
        t.update(features(text)[0])
    held, wanted = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * held / ((s[b] + 1.0) * wanted)))
    out = []
    for doc, text in rows:
        f, n = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(sha(f"{seed}:{'' if doc is None else doc}")[:8], 16)
        out.append((doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    drawn = able[: percent * len(able) // 100]
    left = Counter()
    for r in drawn:
        left[r] += 1
    ranked = [(*r[:4], i + 1) for i, r in enumerate(drawn)]
    for r in out:
        if left[r]:
            left[r] -= 1
        else:
            ranked.append((*r[:4], None))
    return ranked
