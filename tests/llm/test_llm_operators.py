"""Operators against brute force, on documents with every odd case."""

import hashlib
import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import pytest

from pitwise.llm import ctph, decontaminate, langid, licenses, linededup, mixing, pii, quality, sharding, simhash


def got(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_licenses(docs, rows):
    want = Counter((r[0], *brute.licenses(r[1])) for r in rows)
    found = licenses.scan_licenses(docs)
    assert got(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    labels = {r.doc_id: r for r in found.collect()}
    assert labels[18].labels == "cc-by,cc-by-nc,mit" and 0 < labels[18].score <= 1


def test_license_notice_with_changed_words(spark):
    notice = dict((v, k) for k, v in reversed(licenses.NOTICES))
    text = next(t for t, label in notice.items() if label == "bsd").split()
    text[9] = "sometimes"
    del text[14]
    one = spark.createDataFrame([(1, "intro words here " + " ".join(text) + " and more")], "doc_id long, text string")
    row = licenses.scan_licenses(one).first()
    assert (row.labels, row.base_labels) == ("bsd", "") and licenses.COVERAGE <= row.score < 1


def test_license_labels_and_scores(spark):
    """Whole bodies, pieces, changed words, overlapping pieces: labels and score against plain loops."""
    rng = np.random.default_rng(4)
    texts = ["", None, "redistribution and use in source"]
    for _, notice in licenses.NOTICES:
        words = notice.split()
        for _ in range(6):
            w = list(words)
            for _ in range(rng.integers(0, 1 + len(w) // 8)):
                at = rng.integers(0, len(w))
                w[at : at + rng.integers(0, 3)] = ["other"] * rng.integers(0, 3)
            a = rng.integers(0, max(1, len(w) // 3))
            b = len(w) - rng.integers(0, max(1, len(w) // 3))
            texts.append(" ".join(["before"] * rng.integers(0, 5) + w[a:b] + ["after"] + words[: rng.integers(0, len(words))] + w[a : a + 9] * 2))
    bsd = next(n for v, n in licenses.NOTICES if v == "bsd" and len(n.split()) == 21).split()
    # 15 of 21 words, in three pieces that overlap
    texts.append(" ".join(bsd[:9] + bsd[6:12] + bsd[9:15]))
    found = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    many = 0
    for i, text in enumerate(texts):
        labels, score = brute.license_labels(text, licenses.NOTICES)
        base = brute.licenses(text)
        labels |= set(filter(None, base[4].split(",")))
        many += len(labels) > 0
        assert found[i].labels == ",".join(sorted(labels)), text
        assert found[i].score == pytest.approx(1.0 if base[1] else score), text
    assert many > 60 and found[len(texts) - 1].labels == "" and found[len(texts) - 1].score == pytest.approx(15 / 21)


def test_simhash_components(docs, rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    fps = [brute.simhash(rows[i][1]) for i in order]
    first = brute.roots(fps)
    want = Counter((rows[i][0], fps[k], rows[order[first[k]]][0]) for k, i in enumerate(order))
    found = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert found == want


def test_one_row_per_group(docs, rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first = brute.roots([brute.simhash(r[1]) for r in order])
    want = sorted(str(order[i][0]) for i in set(first))
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    found = kept.collect()
    assert sorted(str(r.doc_id) for r in found) == want
    assert all(tuple(r) in set(rows) for r in found)


@pytest.mark.parametrize("block", [4, 4096])
def test_links_of_close_fingerprints(spark, block):
    rng = np.random.default_rng(1)
    values = set()
    for centre in rng.integers(0, 1 << 63, 12, dtype=np.uint64).tolist():
        for _ in range(25):
            bits = rng.choice(64, rng.integers(0, 7), replace=False)
            values.add(centre ^ sum(1 << int(b) for b in bits))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 4, block)
    found = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(edges).collect()}
    want = brute.roots(values)
    groups, mine = defaultdict(set), defaultdict(set)
    for v, w in zip(values, want, strict=True):
        groups[w].add(v)
        mine[found.get(v, v)].add(v)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in mine.values()}
    assert edges.count() <= 12 * len(values)


def test_golay_decodes_to_the_nearest_codeword():
    words = np.random.default_rng(0).integers(0, 1 << 23, 500)
    index = simhash.codeword_index(words)
    code = np.array([m << 11 for m in range(4096)])
    code = code | (code ^ code)  # systematic part only; the distance test below uses encoded words
    encoded = {}
    for m in range(4096):
        rest = m << 11
        for bit in range(22, 10, -1):
            if rest >> bit & 1:
                rest ^= simhash.GOLAY << (bit - 11)
        encoded[m] = m << 11 | rest
    assert all((int(w) ^ encoded[int(i)]).bit_count() <= 3 for w, i in zip(words, index, strict=True))


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(docs, rows, benchmark, block_bytes):
    items = [tuple(r) for r in benchmark.collect()]
    want = Counter((r[0], *brute.contamination(r[1], items)) for r in rows)
    found = decontaminate.verdicts(decontaminate.scan_windows(docs, benchmark, max_set_bytes=block_bytes))
    assert got(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want


def test_decontaminated_documents(docs, rows, benchmark):
    items = [tuple(r) for r in benchmark.collect()]
    clean = decontaminate.clean_documents(docs, benchmark)
    assert clean.columns == docs.columns
    assert Counter(tuple(r) for r in clean.collect()) == Counter(r for r in rows if not brute.contamination(r[1], items)[-1])
    texts = decontaminate.without_spans(docs, benchmark)
    left = decontaminate.verdicts(decontaminate.scan_windows(texts, benchmark.filter("item_id = 1")))
    assert left.filter("n_hit > 0").count() == 0


def test_mixing_agrees_with_sql(docs, rows):
    con = duckdb.connect()
    documents = docs.select("doc_id", "text", "source").toPandas()  # noqa: F841
    con.register("documents", documents.astype({"doc_id": "Int64"}))
    want = Counter(tuple(r) for r in con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE})").fetchall())
    mixed = mixing.mix(docs)
    assert got(mixed, "doc_id", "size", "source_size", "target", "taken") == want
    assert all(r.taken <= 3 * r.size for r in mixed.collect())


def test_mixing_targets(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 500), (None, 90)], "source string, source_size long")
    target = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert target["b"] == 30 and sum(target.values()) == pytest.approx(1600)
    assert all(target[s] <= 3 * n + 1e-9 for s, n in (("a", 1000), ("c", 500), (None, 90)))
    rows = [(i, "x", 10, i * 7919 % (1 << 48)) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long, h long")
    goal = spark.createDataFrame([("x", 5000, 1234.0)], "source string, source_size long, target double")
    below = mixing.thresholds(docs, goal).first()
    assert abs(sum(r[2] for r in rows if r[3] < below.below) - 1234) <= 5


def test_mixed_documents_keep_all_columns(docs):
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = mixed.select(mixing.n_words(mixed.text).alias("n")).groupBy().sum("n").first()[0]
    assert words == sum(r.taken for r in mixing.mix(docs).collect())


def test_sharding(docs, rows):
    plan = sharding.plan(docs, group=5)
    found = plan.collect()
    assert len(found) == len(rows)
    slots, at = defaultdict(list), {}
    for r in found:
        slots[r.shard].append(r.slot)
        assert at.setdefault(r.doc_id, r.shard) == r.shard
        assert r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24 and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)


def test_sharding_moves_only_into_what_changed(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    before = {r.doc_id: r.p for r in ids.select("doc_id", sharding.place(ids.doc_id, sharding.layout(24)).alias("p")).collect()}
    heavier = [leaf._replace(weight=3.0) if leaf.shard == 5 else leaf for leaf in sharding.layout(24)]
    after = {r.doc_id: r.p for r in ids.select("doc_id", sharding.place(ids.doc_id, heavier).alias("p")).collect()}
    moved = [(before[i], after[i]) for i in before if before[i].shard != after[i].shard]
    assert moved
    # a move crosses regions only into the region whose weight grew, and racks only into the rack that grew
    assert all(b.region == a.region or a.region == "r0" for b, a in moved)
    assert all(b.rack == a.rack or a.rack == "k1" for b, a in moved if b.region == a.region)
    counts = Counter(p.shard for p in before.values())
    assert max(counts.values()) < 1.25 * 20_000 / 24 and min(counts.values()) > 0.75 * 20_000 / 24


def test_lines(docs, rows):
    want = Counter(brute.lines([(r[0], r[1]) for r in rows]))
    kept = linededup.kept_texts(docs, linededup.bitmaps(docs))
    found = Counter((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept.encode()).hexdigest()) for r in kept.collect())
    assert found == want and any(w[2] for w in want)


def test_fingerprints_and_successors(docs, rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    found = ctph.compare_with_next(docs).collect()
    assert len(found) == len(rows)
    by_id = defaultdict(list)
    for r in found:
        by_id[r.doc_id].append(r)
    single = [i for i, n in Counter(r[0] for r in rows).items() if n == 1]
    for k, row in enumerate(order):
        nxt = order[(k + 1) % len(order)]
        if row[0] in single and nxt[0] in single:
            text = row[1] or ""
            assert by_id[row[0]][0].n_chars == len(text)
            assert by_id[row[0]][0].edited_sha256 == brute.sha(ctph.edited(text, nxt[1] or ""))
            assert by_id[row[0]][0].fingerprint == ctph.fingerprint(text.encode())
            assert 0 <= by_id[row[0]][0].near_edited <= 1 and 0 <= by_id[row[0]][0].near_next <= 1


@pytest.mark.parametrize("kind", ["long", "string", "date", "decimal(20,2)"])
def test_fingerprints_by_any_orderable_id(spark, rows, kind):
    """Every column against loops over bytes, for ids of several types, with repeated and null ids."""
    some = spark.createDataFrame([(r[0], r[1]) for r in rows[:60]] + [(None, "no id"), (None, "nor this one"), (0, "again")], "doc_id long, text string")
    typed = some.selectExpr("date_add(DATE '2020-01-01', CAST(doc_id AS INT)) AS doc_id" if kind == "date" else f"CAST(doc_id AS {kind}) AS doc_id", "text", "xxhash64(coalesce(text, '')) AS tag")
    order = [(r.doc_id, r.text or "") for r in sorted(typed.collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.tag) if r.doc_id is not None else (False, 0, r.tag))]
    want = Counter()
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        k = len(text) // 4
        changed = text[: len(text) - k] + after[:k]
        own, other, following = (brute.piecewise(t.encode()) for t in (text, changed, after))
        want[i, len(text), brute.sha(changed), own, other, round(brute.alike(own, other), 9), round(brute.alike(own, following), 9)] += 1
    found = ctph.compare_with_next(typed.select("doc_id", "text")).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in found) == want


def test_edit_distance():
    rng = np.random.default_rng(0)
    pairs = [tuple(bytes(rng.integers(65, 69, rng.integers(0, 65)).astype(np.uint8)) for _ in "ab") for _ in range(300)]
    assert ctph.edit_distances(pairs).tolist() == [brute.levenshtein(a, b) for a, b in pairs]


def test_fingerprints_of_changed_texts_are_alike():
    rng = np.random.default_rng(0)
    text = bytes(rng.integers(97, 123, 20_000).astype(np.uint8))
    other = bytes(rng.integers(97, 123, 20_000).astype(np.uint8))
    prints = [ctph.fingerprint(t) for t in (text, text[:9000] + b"new words" + text[9000:], other, b"")]
    near = ctph.likeness([(prints[0], prints[0]), (prints[0], prints[1]), (prints[0], prints[2]), (prints[0], prints[3])])
    assert near[0] == 1 and near[1] > 0.9 and near[2] < 0.3 and near[3] == 0


def test_personal_data(docs, rows):
    want = Counter((r[0], ",".join(f"{k}:{a}:{b}" for k, a, b in brute.personal(r[1]))) for r in rows)
    found = pii.find_personal_data(docs).collect()
    assert Counter((r.doc_id, ",".join(r.base)) for r in found) == want
    assert all(set(r.base) <= set(r.spans) for r in found)


def test_patterns_without_retries():
    odd = ["a@b.c@d.e", "@x.y", "..@-.-", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "0000.1.1.1", "+1 +1 555 123 4567", "4111-1111-1111-1111-", "1" * 300, "é@b.co a@é.co", "a" * 3000 + "@", "1.2.3", "+12345678"]
    for text in odd:
        assert sorted(pii.base_spans(text)) == sorted(brute.personal(text)), text


def test_tagger_learns_held_out_spans():
    right = total = wrong = 0
    model = pii.default_tagger()
    held = pii.examples(300, seed=77)
    x = np.stack([pii.classes(t[: pii.WIDTH].ljust(pii.WIDTH, "\n")) for t, _ in held]).astype(int)
    for (_, spans), tags in zip(held, pii.viterbi(model, pii.emissions(model, x.T)).T, strict=True):
        read = set(pii._read_spans(tags))
        right, total, wrong = right + len(read & set(spans)), total + len(spans), wrong + len(read - set(spans))
    assert right >= 0.75 * total and wrong <= 0.25 * total
    text = "words before (132) 555-1352 and after " * 4
    assert pii.all_spans(model, [text])[0][1]
    assert pii.all_spans(model, ["no digits here at all"]) == [([], [])]
    # stretches of longer codes are no cards, nor are numbers that fail the card check
    code = 'token = "52c4f908198940453355" and 2c54c4021aa367982842368200 or 4111111111112 '
    assert not [s for s in pii.all_spans(model, [code * 3])[0][1] if s[0] == "card"]
    for n in (1, 5, 31, 32, 33, 47, 48, 64, 65, 200):
        assert len(pii.tag_texts(model, [("ab 1 @" * 40)[:n], "7" * n])) == 2


def test_tagger_recall_and_precision_on_held_out_spans():
    model, held = pii.default_tagger(), pii.examples(500, seed=78)
    right, total, read = Counter(), Counter(), Counter()
    x = np.stack([pii.classes(t[: pii.WIDTH].ljust(pii.WIDTH, "\n")) for t, _ in held]).astype(int)
    for (_, spans), tags in zip(held, pii.viterbi(model, pii.emissions(model, x.T)).T, strict=True):
        own = set(pii._read_spans(tags))
        right.update(k for k, *_ in own & set(spans))
        total.update(k for k, *_ in spans)
        read.update(k for k, *_ in own)
    assert set(total) == set(pii.TAGGED)
    assert right.total() >= 0.9 * total.total() and right.total() >= 0.9 * read.total()


def test_network_adds_spans_that_no_pattern_has():
    model = pii.default_tagger()
    texts = ['well then token = "a3f09b7c5d1e88f2046b9d7c3a5e1f00b2c4d6e8" and so on', "numbers 4465758382889437 4465758382889437 in a row"]
    added = [[s for s in more if s not in base] for base, more in pii.all_spans(model, texts)]
    assert [(k, texts[0][a:b]) for k, a, b in added[0]] == [("secret", texts[0].split('"')[1])]
    assert {k for k, *_ in added[1]} <= {"card"}


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    k = pii.N_TAGS
    model = pii.Tagger((), (), None, None, rng.normal(size=(k, k)), rng.normal(size=k))
    scores = rng.normal(size=(4, 3, k)) * 2
    for r, tags in enumerate(pii.viterbi(model, scores).T):
        worth = model.first[:, None, None, None] + scores[0, r][:, None, None, None] + (model.moves + scores[1, r])[:, :, None, None] + (model.moves + scores[2, r])[None, :, :, None] + (model.moves + scores[3, r])[None, None]
        assert tuple(tags) == np.unravel_index(worth.argmax(), worth.shape)


def test_long_stretches_decode_as_one():
    rng = np.random.default_rng(1)
    k = pii.N_TAGS
    model = pii.Tagger((), (), None, None, rng.normal(size=(k, k)), rng.normal(size=k))
    sizes = [0, 1, 100, pii.PIECE, pii.PIECE + pii.SEAM, pii.PIECE + pii.SEAM + 1, 5000]
    scores = [rng.normal(size=(n, k)) for n in sizes]
    for s, tags in zip(scores, pii.decode(model, scores), strict=True):
        assert len(tags) == len(s)
        if len(s):
            assert (tags == pii.viterbi(model, s[:, None])[:, 0]).all()


def test_emissions_are_averaged_over_windows():
    model = pii.default_tagger()
    codes = pii.classes("call (132) 555-1352 or token = 'ab12cd34ef56ab12cd34' " * 3)
    total, seen = np.zeros((len(codes), pii.N_TAGS)), np.zeros(len(codes))
    for s in range(0, len(codes) - pii.WIDTH + pii.STRIDE, pii.STRIDE):
        window = np.full(pii.WIDTH, pii._CLASSES[10], int)
        n = min(pii.WIDTH, len(codes) - s)
        window[:n] = codes[s : s + n]
        total[s : s + n] += pii.emissions(model, window[:, None])[:n, 0]
        seen[s : s + n] += 1
    assert seen.min() >= 1 and seen.max() == 2
    assert np.allclose(pii.averaged(model, [codes])[0], total / seen[:, None], atol=1e-4)


def test_stretches_without_digit_or_at_hold_no_spans(spark, monkeypatch):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    model = pii.default_tagger()
    some = pii.tag_texts(model, texts)
    read = sum(b - a for t in texts for a, b in pii.stretches(pii.classes(t)))
    monkeypatch.setattr(pii, "stretches", lambda codes: [(0, len(codes))])
    every = pii.tag_texts(model, texts)
    assert some == every and sum(map(len, some)) and read < sum(map(len, texts))


def test_tagger_gradients():
    rng = np.random.default_rng(0)
    x = rng.integers(0, pii.N_CLASSES, (6, 3))
    table, weights = rng.normal(0, 0.5, (pii.N_CLASSES, 16)), rng.normal(0, 0.5, (4, 16))
    out, moves, first = rng.normal(0, 0.5, (4, pii.N_TAGS)), rng.normal(0, 0.5, (pii.N_TAGS,) * 2), rng.normal(0, 0.5, pii.N_TAGS)
    tags = rng.integers(0, pii.N_TAGS, (6, 3))

    def loss(w):
        scores = (pii._lstm(x, table, w) @ out).astype(float)
        total = 0.0
        for r in range(3):
            a = scores[0, r] + first
            own = a[tags[0, r]]
            for t in range(1, 6):
                own += moves[tags[t - 1, r], tags[t, r]] + scores[t, r, tags[t, r]]
                a = pii._logsum(a[:, None] + moves, 0) + scores[t, r]
            total += pii._logsum(a[None], 1)[0] - own
        return total / 3

    run = pii._lstm(x, table, weights, True)
    d, _, _ = pii._crf_gradients(run[0] @ out, tags, moves, first)
    _, g = pii._lstm_back(x, table, weights, run, d @ out.T)
    step = np.zeros_like(weights)
    step[1, 5] = 1e-3
    assert g[1, 5] == pytest.approx((loss(weights + step) - loss(weights - step)) / 2e-3, rel=0.05, abs=2e-3)


def test_language_id(spark, docs, rows):
    learn = [(i, ("the water of that house and with the " if i % 2 else "le chat de la maison et dans la rue ") * 3, "en" if i % 2 else "fr") for i in range(200)]
    model = langid.train(spark.createDataFrame(learn, "doc_id long, text string, lang string"))
    texts = [(1, "that house with the water"), (2, "dans la maison le chat"), (3, None), (4, "12 34 !!"), (5, ""), (6, "zzzzqqq")]
    found = {r.doc_id: r for r in langid.predict(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["en", "fr", "und", "und", "und"]
    assert found[6].lang_pred in ("en", "fr") and found[3].score == 0 and 0 < found[1].score <= 1
    assert langid.predict(docs, model).count() == len(rows)


def test_language_filters_return_every_language_of_an_ngram():
    shared, own = [11, 12, 13], {"a": [1, 2, 3], "b": [4, 5]}
    filters = langid.build({k: v + shared for k, v in own.items()}, "a")
    mask = langid.lookup(filters, np.array([1, 4, 11, 999], np.uint32))[:, 0].tolist()
    assert mask == [1, 2, 3, 0]


def test_language_against_plain_sets(rows, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [r[1] or "" for r in rows]
    own = {k: set(rng.choice(np.concatenate([langid.grams(langid.normal(t.encode())) for t in texts]), 40).tolist()) for k in ("aa", "bb", "cc")}
    filters = langid.build({k: sorted(v) for k, v in own.items()}, "bb")
    every = {int(g) for t in texts for g in langid.grams(langid.normal(t.encode()))}
    # what a filter takes for its own, right or wrong, is part of the method: the plain sets get it too
    mask = langid.lookup(filters, np.array(sorted(every), np.uint32))[:, 0]
    learned = {k: {g for g, m in zip(sorted(every), mask.tolist(), strict=True) if m >> i & 1} for i, k in enumerate(filters.languages)}
    assert all(own[k] & every <= learned[k] for k in own)
    want = [brute.language(t, learned, dict(zip(filters.languages, filters.false_positive, strict=True)), "bb") for t in texts]
    for piece in (langid.PIECE, 50):
        monkeypatch.setattr(langid, "PIECE", piece)
        langs, scores = langid.decide(filters, [t.encode() for t in texts])
        assert langs == [w[0] for w in want] and scores == pytest.approx([w[1] for w in want])


def test_quality_scores_against_plain_loops(rows):
    rng = np.random.default_rng(6)
    n = quality.DIMENSIONS + quality.N_STATS
    machine = quality.Machine(0.3, rng.normal(size=n), rng.normal(size=(n, 3)) / 3, rng.normal(size=quality.N_STATS), rng.random(quality.N_STATS) + 0.5)
    texts = [(r[1] or "").encode() for r in rows if not r[1] or len(r[1]) < 2000]
    told = [None if i % 3 else i * 1.5 for i in range(len(texts))]
    want = [brute.quality_score(machine, t, n) for t, n in zip(texts, told, strict=True)]
    for at_once in (7, 512):
        assert quality.probabilities(machine, texts, told, at_once).tolist() == pytest.approx(want, rel=1e-4, abs=1e-6)


CLASHES = ["score", "predicted", "id", "tag", "_tag", "epochs", "below", "_n", "n", "h", "row", "size", "of", "copy", "spans", "items", "n_words", "contaminated", "_contaminated", "component_id", "fp", "rank", "a b:c", "x.y", "`q`"]


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with columns of every name that a stage might use inside."""
    texts = ["plain words stand here in order and end well.", "other words stand here, and they end well too.", "plain words stand here in order and end well.", None, "", "!! $$$ !! ###"] * 4
    rows = [(i, t, None if i % 5 == 0 else "en", f"s{i % 2}", len(t or ""), *[f"{c}-{i}" for c in CLASHES], "kept") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *CLASHES, "shard"])


@pytest.mark.parametrize("stage", ["quality", "simhash", "decontaminate", "mixing", "sharding"])
def test_stages_leave_columns_of_any_name_alone(spark, clashing, stage):
    labels = spark.createDataFrame([(i, int(i % 6 < 5)) for i in range(24)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "other words stand here")], "item_id long, text string")
    made = {
        "quality": lambda: quality.kept_documents(clashing, quality.train(clashing, labels)),
        "simhash": lambda: simhash.one_per_group(clashing),
        "decontaminate": lambda: decontaminate.clean_documents(clashing, items),
        "mixing": lambda: mixing.mixed_documents(clashing),
        "sharding": lambda: sharding.assign(clashing, sharding.layout(24)),
    }[stage]()
    assert made.columns[: len(clashing.columns)] == clashing.columns
    every = {tuple(r) for r in clashing.collect()}
    found = [tuple(r)[: len(clashing.columns)] for r in made.collect()]
    assert found and set(found) <= every
    if stage == "sharding":
        assert made.columns[-1] == "shard_" and len(found) == len(every)


def test_new_columns_get_free_names(spark, clashing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.scored(clashing, quality.train(clashing, none)).columns[-2:] == ["score_", "predicted_"]
    items = spark.createDataFrame([(1, "other words stand here")], "item_id long, text string")
    assert decontaminate.scan_rows(clashing, items).columns[-1] == "contaminated_"


def test_components_are_never_left_unfinished(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    with pytest.raises(RuntimeError):
        simhash.components(path, max_rounds=1)
    assert {(r.node, r.root) for r in simhash.components(path).collect()} == {(i, 0) for i in range(1, 61)}


def test_hubs_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAST_SPLIT", 8)
    edges = [(1000 + i, 5) for i in range(100)] + [(5, 2), (7, 8)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {5: 2, 8: 7, **{1000 + i: 2 for i in range(100)}}
    rows, n = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 1)], "k long, by long"), spark.createDataFrame([(1, 100, "a"), (2, 1, "b")], "k long, n long, v string")
    joined = simhash.split_join(rows, n, "k", "by", 101)
    assert joined.count() == 101 and joined.filter("v = 'a'").count() == 100


def test_factorisation_machine(spark):
    rng = np.random.default_rng(0)
    x, w, v = rng.normal(size=(5, 7)), rng.normal(size=7), rng.normal(size=(7, 3))
    plain = [sum(w[i] * r[i] for i in range(7)) + sum(v[i] @ v[j] * r[i] * r[j] for i in range(7) for j in range(i)) for r in x]
    assert quality.raw_scores(x, w, v, 0.0) == pytest.approx(plain)
    good = lambda i: f"plain words stand here in order number {i}. They end well."
    docs = spark.createDataFrame([(i, good(i) if i % 2 else good(i).upper().replace(" ", "!! "), 10) for i in range(300)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(5, None)], "doc_id long, quality int")
    made = quality.scored(docs, quality.train(docs, labels)).collect()
    assert sum(r.predicted == r.doc_id % 2 for r in made) >= 297 and all(0 <= r.score <= 1 for r in made)


def test_quality_without_labels_and_odd_rows(spark, docs, rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    made = quality.scored(docs, quality.train(docs, none))
    assert made.count() == len(rows)


def test_empty_tables(empty, benchmark, spark):
    assert licenses.scan_licenses(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert decontaminate.verdicts(decontaminate.scan_windows(empty, benchmark)).count() == 0
    assert mixing.mix(empty).count() == 0
    assert sharding.plan(empty).count() == 0
    assert linededup.kept_texts(empty, linededup.bitmaps(empty)).count() == 0
    assert ctph.compare_with_next(empty).count() == 0
    assert pii.find_personal_data(empty).count() == 0
    assert langid.predict(empty, langid.train(empty)).count() == 0
    assert quality.scored(empty, quality.train(empty, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0


@pytest.mark.parametrize("block", [1 << 19, 700])
def test_no_link_of_a_crowded_sample_is_lost(spark, monkeypatch, block):
    """Texts that only one text of many, itself no leader, connects with the rest."""
    monkeypatch.setattr(simhash, "SET_BLOCK", block)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base)]
    for i in range(12):
        near = [*base[: 30 * i + 10], *(f"x{i}q{j}" for j in range(4)), *base[30 * i + 14 :]]
        at = (30 * i + 110) % 340
        texts += [" ".join(near), " ".join([*near[:at], *(f"y{i}q{j}" for j in range(34)), *near[at + 34 :]])]
    pairs = brute.shingle_pairs(texts)
    assert all((0, 2 * i) not in pairs and (2 * i - 1, 2 * i) in pairs for i in range(1, 13)) and len(pairs) < 100
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in simhash.shingle_groups(docs).collect()}
    assert [found[i] for i in range(len(texts))] == brute.shingle_groups(texts, pairs)


@pytest.mark.parametrize("seed", range(6))
def test_verified_links_connect_what_all_links_connect(seed):
    r = np.random.default_rng(seed)
    n = 60
    sets = [np.unique(np.append(r.choice(40, r.integers(1, 9), replace=False) if i % 3 else np.r_[100 : 110 + i % 5], r.integers(0, 500))) for i in range(n)]
    groups, sides = r.integers(0, n if seed % 2 else 12, n) + 1000, r.integers(0, 1 + seed // 2, n)

    def roots(links):
        of = {int(g): int(g) for g in groups}
        for a, b in links:
            x, y = of[a], of[b]
            of = {g: min(x, y) if o in (x, y) else o for g, o in of.items()}
        return of

    meet = lambda a, b: len(set(sides)) == 1 or sides[a] != sides[b]
    alike = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))
    every = [(a, b) for b in range(n) for a in range(b) if groups[a] != groups[b] and meet(a, b) and alike(a, b)]
    u, v = simhash.verified_links(np.arange(n), groups, sides, np.array([len(s) for s in sets]), np.concatenate(sets), 0.8)
    assert every and len(u) < len(set(groups)) and all((min(p), max(p)) in every for p in zip(u, v, strict=True))
    assert roots((groups[a], groups[b]) for a, b in zip(u, v, strict=True)) == roots((groups[a], groups[b]) for a, b in every)
