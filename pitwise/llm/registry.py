"""The queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctph, decontaminate, langid, licenses, linededup, merkle, mixing, pii, quality, resampling, sharding, simhash, tokens
from .common import remainder, table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.plan(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = decontaminate.scan_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.verdicts(scanned)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.compare_with_next(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: F.substring_index(s, ":", 1))
    counts = [F.size(F.array_remove(kinds, kind)) for kind in pii.KINDS]
    counts = [(F.size("base") - n).cast("long").alias(f"n_{kind}") for n, kind in zip(counts, pii.KINDS, strict=True)]
    digest = F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, F.array_join("spans", ",").alias("spans"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = linededup.kept_texts(docs, linededup.bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, machine).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.proofs(table(spark, sf_dir, "documents"), tampered=remainder("doc_id", 5) == 0)
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict:
    every = (op1_language, op2_sharding, op3_licenses, op4_simhash, op5_decontamination, op6_fingerprints, op7_mixing, op8_pii, op9_lines, op10_quality, op11_merkle, op12_resampling, op13_tokens)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": mixing.ORACLE, "op9_lines": linededup.ORACLE, "op11_merkle": merkle.ORACLE, "op12_resampling": resampling.ORACLE}
