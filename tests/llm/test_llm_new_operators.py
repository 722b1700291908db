"""Manifest, importance resampling and token counts against plain loops, on every odd case."""

import random
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from pitwise.llm import common, merkle, ranks, resampling, tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def as_dicts(rows):
    return [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=False)) for r in rows]


def proofs(docs):
    found = merkle.proofs(docs, tampered=common.remainder("doc_id", 5) == 0)
    return Counter(tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), "folded_root", "verified").collect())


@pytest.mark.parametrize("small", [False, True])
def test_merkle(docs, rows, monkeypatch, small):
    if small:  # many trie levels, blocks of copies, joins by shuffle
        monkeypatch.setattr(merkle, "radix_ranks", lambda r, key, label, most=None: ranks.radix_ranks(r, key, label, most, bucket_rows=2))
        monkeypatch.setattr(ranks, "COPIES", 1)
        monkeypatch.setattr(ranks, "MAX_BROADCAST_BUCKETS", 0)
    assert proofs(docs) == Counter(brute.merkle(as_dicts(rows)))


def test_merkle_of_many_levels_and_sources(spark):
    r = random.Random(5)
    rows = [(r.randrange(-(1 << 62), 1 << 62) if i % 3 else i, f"Text {i % 50}", None, r.choice(["é", "a", "ab", None, "", "z"]) if i % 4 else f"s{i % 37}", i) for i in range(900)]
    rows += [(7, "Same Row", "en", "a", 1)] * 40
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = brute.merkle(as_dicts(rows))
    assert proofs(made) == Counter(want)
    assert not all(w[-1] for w in want) and any(w[-1] for w in want)


def test_merkle_of_one_row_and_none(spark, empty):
    one = spark.createDataFrame([(1, "A", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    found = merkle.proofs(one).first()
    assert found.root == found.leaf == found.subroot and found.verified and found.path == []
    assert merkle.proofs(empty).count() == 0 and merkle.manifest(empty).count() == 0


def test_manifests_tell_changed_sources(docs, rows):
    before = merkle.manifest(docs)
    after = merkle.manifest(docs.withColumn("text", F.when(F.col("doc_id") == 30, "changed").otherwise(F.col("text"))))
    source = next(r[3] for r in rows if r[0] == 30)
    assert {r.source for r in merkle.changed_sources(before, after).collect()} == {source}
    assert {r.source: r.n_rows for r in before.collect()} == Counter(r[3] for r in rows)


@pytest.mark.parametrize(("most", "bucket"), [(None, 3), (25, 3), (None, 4096)])
def test_ranks(spark, most, bucket):
    r = random.Random(2)
    keys = [(g, f"{r.choice(['aa', 'ab', 'b'])}{r.randrange(200):04x}") for g in "xy" for _ in range(60)]
    keys = sorted(set(keys))
    rows = [(g, k, r.randrange(1, 4)) for g, k in keys]
    df = common.materialize(spark.createDataFrame(rows, "g string, k string, n long"), "rank-test")
    found = {(x.g, x.k): x.start for x in ranks.radix_ranks(df, F.col("k"), "rank-test", most, bucket).collect()}
    at = Counter()
    for g, k, n in rows:
        want = at[g]
        at[g] += n
        assert found[g, k] == want if most is None or want < most else found[g, k] is None or found[g, k] >= most
    assert len(found) == len(rows)


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling(docs, benchmark, rows, longest):
    target = [t for t in (r.text for r in benchmark.collect())]
    want = brute.resampling([(r[0], r[1]) for r in rows], target, longest, percent=30)
    found = resampling.resample(docs, benchmark, percent=30, longest=longest)
    assert Counter(tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()) == Counter(want)


def test_resampling_of_nothing(docs, empty, benchmark):
    assert resampling.resample(empty, benchmark).count() == 0
    assert resampling.resample(docs, benchmark.limit(0), percent=0).filter("rank is not null").count() == 0


def test_sampled_documents_keep_their_columns(docs, benchmark):
    kept = resampling.sampled(docs, benchmark, percent=30)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_words_of_one_hash_are_told_apart(monkeypatch):
    texts = resampling.texts_of([b"a bb cc a dd", b"bb a"])
    plain = resampling.word_ids(texts)[0]
    monkeypatch.setattr(resampling, "word_hashes", lambda t: (t.ends - t.starts).astype(np.uint64))
    ids, first = resampling.word_ids(texts)
    same = lambda x: [[a == b for b in x] for a in x]
    assert same(ids.tolist()) == same(plain.tolist()) and [int(ids[i]) for i in first] == sorted(set(ids.tolist()))


def test_suffix_array_is_sorted():
    r = np.random.default_rng(3)
    ids, ends = r.integers(0, 3, 60), np.repeat([20, 25, 60], [20, 5, 35])
    order, lcp = resampling.suffix_array(ids, ends, 4)
    runs = [tuple(ids[i : min(i + 4, ends[i])].tolist()) for i in order]
    assert runs == sorted(runs)
    padded = [(*x, *[-1] * (4 - len(x))) for x in runs]
    assert lcp[1:].tolist() == [next((k for k in range(4) if a[k] != b[k]), 4) for a, b in zip(padded, padded[1:], strict=False)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts(machine):
    r = random.Random(1)
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(r.randint(0, n)))
    alphabet, pieces = machine.alphabet[1:], sorted(machine.pieces)
    out = [some(alphabet[: r.randint(2, len(alphabet))], 300) for _ in range(100)] + [some("ab ▁\n", 400) for _ in range(100)]
    out += ["▁" * k for k in range(70)] + [" " * k + "x" for k in range(70)] + ["a" * k for k in range(0, 300, 7)]
    out += [some("abcdefghijklmnopqrstuvwxyz", 500) for _ in range(60)] + [some("0123456789abcdef", 500) for _ in range(40)] + [some(pieces, 80) for _ in range(100)]
    out += [chr(r.randint(1, 0xD7FF)) * 3 + "é" + chr(r.randint(0x10000, 0x10FFFF)) + "<s> </s>\x00 \t<0x0A>" for _ in range(50)]
    return out


def test_token_counts_are_the_library_s(library):
    with open(MODEL, "rb") as file:
        machine = tokens.Transducer(file.read())
    texts = odd_texts(machine)
    want = [len(x) for x in library.encode(texts)]
    assert machine.counts([t.encode() for t in texts]).tolist() == want
    machine.forget()
    assert [int(machine.counts([t.encode()])[0]) for t in texts[::5]] == want[::5]


def test_chunks_that_do_not_meet_are_read_again(library, monkeypatch):
    monkeypatch.setattr(tokens, "BEFORE", 1)
    monkeypatch.setattr(tokens, "CHUNK", 2)
    with open(MODEL, "rb") as file:
        machine = tokens.Transducer(file.read())
    texts = ["unbelievablyinternationalization" * 3, "aaaaaaaaaaaaaaaaaaaaaaa", "▁" * 40, "x y z"]
    assert machine.counts([t.encode() for t in texts]).tolist() == [len(x) for x in library.encode(texts)]


def test_token_counts(docs, rows, empty, library):
    found = Counter(tuple(r) for r in tokens.token_counts(docs, MODEL, limit=50).collect())
    n = lambda t: len(library.encode(t or ""))
    assert found == Counter((r[0], len((r[1] or "").encode()), n(r[1]), n(r[1]) > 50) for r in rows)
    assert tokens.token_counts(empty, MODEL).count() == 0
    total = tokens.totals(tokens.token_counts(docs, MODEL)).first()
    assert total.n_docs == len(rows) and total.n_tokens == sum(n(r[1]) for r in rows)


def test_token_counts_of_broken_utf8(spark, library):
    one = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("cast(X'61FF62' as string)").alias("text"))
    assert tokens.token_counts(one, MODEL).first().n_tokens == len(library.encode("a�b"))


def test_a_model_that_cannot_be_compiled_says_so(tmp_path):
    with pytest.raises(Exception, match="compiled|parse|model|invalid|Internal"):
        tokens.Transducer(b"no model at all")


@pytest.fixture(scope="module")
def broken(spark):
    """Texts with bytes that are no UTF-8, and one with the same text in valid form."""
    rows = spark.range(3).select(F.col("id").alias("doc_id"), F.expr("CASE id WHEN 0 THEN cast(X'61FF20612E62406D61696C2E6578616D706C652E636F6D' as string) WHEN 1 THEN concat('a', chr(65533), ' a.b@mail.example.com') ELSE 'plain' END").alias("text"))
    return rows.withColumn("text", F.when(F.col("doc_id") == 1, "a� a.b@mail.example.com").otherwise(F.col("text")))


def test_broken_utf8_counts_as_replaced(broken):
    from pitwise.llm import ctph, pii

    found = {r.doc_id: r.base for r in pii.find_personal_data(broken).collect()}
    assert found[0] == found[1] == ["email:3:23"] and found[2] == []
    prints = {r.doc_id: (r.fingerprint, r.n_chars) for r in ctph.compare_with_next(broken).collect()}
    assert prints[0] == prints[1] and prints[2][1] == 5


def test_benchmark_items_without_an_id(spark, docs, benchmark):
    from pitwise.llm import decontaminate

    twice = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    twice = twice.unionByName(twice.filter("item_id = '1'").withColumn("item_id", F.lit(None).cast("string"))).unionByName(twice.filter("item_id = '10'").withColumn("item_id", F.lit(None).cast("string")))
    plain = {r.doc_id: r for r in decontaminate.scan_windows(docs, benchmark).filter("size(spans) > 0").collect()}
    for size in (decontaminate.MAX_SET_BYTES, 50):
        found = {r.doc_id: r for r in decontaminate.scan_windows(docs, twice, max_set_bytes=size).filter("size(spans) > 0").collect()}
        assert plain and found.keys() == plain.keys()
        assert all(r.spans == plain[d].spans and [i for i in r["items"] if i] == plain[d]["items"] for d, r in found.items())
        assert any("" in r["items"] for r in found.values())


def test_rows_of_one_id_are_numbered_in_parts(spark):
    from pitwise.llm import sharding

    rows = spark.range(3000).select(F.when(F.col("id") % 2 == 0, F.lit(7).cast("long")).alias("doc_id"), F.col("id").cast("string").alias("text"))
    made = sharding.plan(rows, n=2, group=100)
    for shard, slots in ((r[0], r[1]) for r in made.groupBy("shard").agg(F.collect_list("slot")).collect()):
        assert sorted(slots) == list(range(len(slots))), shard
