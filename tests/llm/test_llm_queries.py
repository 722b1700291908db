"""The registered queries and the pipeline on small tables."""

import sys
from collections import Counter
from pathlib import Path

import brute
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import differences, duck  # noqa: E402

import corpus_pipeline  # noqa: E402
from pitwise.llm import registry, sharding, simhash  # noqa: E402
from pitwise.llm.duckdb_sql import crc32_sql  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_sql(spark, name):
    assert differences(registry.queries()[name](spark, SF), duck(SF), registry.oracle_sql()[name]) == ""


def placement_sql(n=24, group=sharding.SLOT_GROUP):
    """The sharding query in DuckDB."""
    leaves = ", ".join(f"({m}, '{x.region}', '{x.rack}', 's{x.shard}', {float(x.weight)})" for m in (n, n + 1) for x in sharding.layout(m))
    draw = "CAST('0x' || substr(md5(k || '|' || {}), 1, 12) AS BIGINT)".format
    first = lambda node: f"QUALIFY row_number() OVER (PARTITION BY rid, n ORDER BY -ln(({draw(node)} + 0.5) / 281474976710656.0) / w, {node}) = 1"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, coalesce(text, '') AS text FROM documents),
leaf(n, region, rack, shard, w) AS (VALUES {leaves}),
regions AS (SELECT n, region, sum(w) AS w FROM leaf GROUP BY ALL),
racks AS (SELECT n, region, rack, sum(w) AS w FROM leaf GROUP BY ALL),
a AS (SELECT rid, k, n, region FROM d, regions {first('region')}),
b AS (SELECT rid, k, n, region, rack FROM a JOIN racks USING (n, region) {first('rack')}),
c AS (SELECT rid, k, n, region, rack, CAST(substr(shard, 2) AS INTEGER) AS shard FROM b JOIN leaf USING (n, region, rack) {first('shard')}),
g AS (SELECT greatest(16, count(*) // {n * group} + 1) AS g FROM documents),
x AS (
  SELECT doc_id, CAST(strlen(text) + 8 AS BIGINT) AS size, {crc32_sql('text')} AS text_crc32, c.shard, c.region, c.rack, e.shard AS grown_shard, {draw("'slot'").replace('k ||', "d.k || '|' || " + crc32_sql('text') + " ||")} % g AS part
  FROM d JOIN c ON c.rid = d.rid AND c.n = {n} JOIN c e ON e.rid = d.rid AND e.n = {n + 1}, g)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY part, doc_id, text_crc32, size) - 1 AS BIGINT) AS slot, grown_shard, region, rack
FROM x
"""


def test_placement_agrees_with_sql(spark):
    assert differences(registry.op2_sharding(spark, SF), duck(SF), placement_sql()) == ""


def test_language_on_held_out_documents(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in registry.op1_language(spark, SF).collect() if r.held_out and docs[r.doc_id]]
    assert held and sum(r.lang_pred == docs[r.doc_id] for r in held) >= 0.95 * len(held)


def test_quality_on_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in registry.op10_quality(spark, SF).collect() if r.held_out and r.doc_id in labels]
    assert held and sum(r.predicted == labels[r.doc_id] for r in held) >= 0.85 * len(held)


def test_sharding_reruns_agree(spark):
    first, again = (Counter(tuple(r) for r in registry.op2_sharding(spark, SF).collect()) for _ in range(2))
    assert first == again


def test_near_copies_of_a_larger_table(spark):
    """Of the pairs of different texts that share 0.8 of their five-word shingles, nine in ten and more are in one group; no others are."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    of = {r.doc_id: r.component_id for r in simhash.shingle_groups(docs).collect()}
    found = [of[i] for i, _ in rows]
    pairs = brute.shingle_pairs([t for _, t in rows])
    assert len(pairs) > 40 and sum(found[a] == found[b] for a, b in pairs) >= 0.9 * len(pairs)
    groups = brute.shingle_groups([t for _, t in rows], pairs)
    whole = {g: rows[g][0] for g in set(groups)}
    assert all(whole[groups[i]] <= found[i] for i in range(len(rows)))
    assert all(groups[i] == groups[j] for i, j in enumerate(brute.positions(found, [d for d, _ in rows])))


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "near_dedup":
            rows = sorted((r.doc_id, r.text) for r in before.select("doc_id", "text").collect())
            groups = brute.shingle_groups([t for _, t in rows])
            assert sorted(r.doc_id for r in docs.collect()) == [rows[i][0] for i in sorted(set(groups))]
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            clean = [r.doc_id for r in before.collect() if not brute.contamination(r.text, items)[-1]]
            assert sorted(r.doc_id for r in docs.collect()) == sorted(clean)
    assert counts[0] > counts[1] > counts[2] >= counts[3] and counts[5] == counts[4] and "shard" in docs.columns
    assert corpus_pipeline.run(spark, SF).count() == counts[5]
