"""Mixing sources to target weights by nested hash thresholds; DataFrame functions only.

Each document has a fixed 48-bit hash. A source's mix is the documents whose hash lies below a
threshold, so mixes for growing budgets are nested. The threshold is found from histograms: tokens
by source and the top 12 bits of the hash, then the next 12 bits within the boundary bucket alone,
and so on. Nothing is sorted but the histogram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import field, materialize, packed, unpacked

#: Bits of the hash that one histogram resolves, and histograms in a row.
LEVEL_BITS, LEVELS = 12, 4


def n_words(text: Column) -> Column:
    """Runs of characters that are not ASCII whitespace; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column) -> Column:
    """The 48-bit hash that places a document; equal ids share it, a null id counts as empty."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 12), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target): shares of the total by weight, none above ``most`` times its size.

    ``sizes`` has one row (source, source_size) per source. Sources by code point, null last, take
    the weights in turn. Water-filling in closed form: by rising size over weight, the sources that
    are full come first; the rest share what is left by weight. One row per source is all that the
    single ordered window sees.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    ranked = sizes.withColumn("k", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("k") % len(weights) + 1).cast("int")).cast("long")
    rows = ranked.withColumns({"w": w, "full": F.lit(most) * F.col("source_size")})
    fill = Window.orderBy((F.col("full").cast("double") / F.col("w")).asc(), F.col("k").asc())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "total": F.sum("source_size").over(Window.partitionBy()),
        "weight": F.sum("w").over(Window.partitionBy()),
        "full_before": F.coalesce(F.sum("full").over(before), F.lit(0)),
        "w_before": F.coalesce(F.sum("w").over(before), F.lit(0)),
    })
    level = (F.col("total") - F.col("full_before")).cast("double") / (F.col("weight") - F.col("w_before")).cast("double")
    rows = rows.withColumn("level", level).withColumn("fits", F.col("level") * F.col("w") <= F.col("full"))
    rows = rows.withColumn("shared", F.min(F.when(F.col("fits"), F.struct("w_before", "level"))).over(Window.partitionBy())["level"])
    target = F.least(F.coalesce(F.col("shared"), F.lit(float("inf"))) * F.col("w"), F.col("full").cast("double"))
    return rows.select("source", "source_size", target.alias("target"))


def thresholds(docs: DataFrame, goals: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``goals`` with ``epochs`` (whole passes) and ``below``: documents with a hash below it are taken once more.

    ``docs`` has (source, size, h). The boundary group of equal hashes is taken if that comes nearer.
    """
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    at = goals.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    at = at.withColumns({"prefix": F.lit(0).cast("long"), "taken_before": F.lit(0).cast("long")})
    for level in range(levels):
        unit = 1 << LEVEL_BITS * (levels - 1 - level)
        rows = docs.filter("size > 0").select("source", "size", F.expr(f"h div {unit}").alias("bucket"))
        if level:
            edge = at.select(F.col("source").alias("s"), F.col("prefix").alias("p"))
            rows = rows.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.expr(f"bucket div {1 << LEVEL_BITS}") == F.col("p"))).drop("s", "p")
        hist = rows.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("upto", F.sum("sum").over(upto)).select(F.col("source").alias("s"), "bucket", "sum", "upto")
        over = at.join(hist, F.col("source").eqNullSafe(F.col("s")) & (F.col("taken_before") + F.col("upto") > F.col("rest")), "left")
        edge = F.min(F.struct("bucket", (F.col("upto") - F.col("sum")).alias("before"), "sum"))
        keep = ["source", "source_size", "target", "epochs", "rest", "taken_before"]
        found = over.groupBy(*keep, "prefix").agg(edge.alias("edge"))
        # without an edge the budget covers the whole source: its rest is never above its size
        at = found.select(
            "source", "source_size", "target", "epochs", "rest",
            F.coalesce(F.col("edge.bucket"), (F.col("prefix") + 1) * (1 << LEVEL_BITS)).alias("prefix"),
            (F.col("taken_before") + F.coalesce(F.col("edge.before"), F.lit(0))).alias("taken_before"),
            F.coalesce(F.col("edge.sum"), F.lit(0)).alias("edge_sum"),
        )
        # a row per source, written, so that the next level plans on it and not on all levels before
        at = materialize(at, f"mix-level-{level}")
    nearer = F.col("taken_before") + F.col("edge_sum") - F.col("rest") < F.col("rest") - F.col("taken_before")
    return at.select("source", "source_size", "target", "epochs", (F.col("prefix") + F.when(nearer, 1).otherwise(0)).alias("below"))


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, h), written once: word counts need the texts, nothing after does."""
    narrow = docs.select(field(docs, doc_id).alias("doc_id"), field(docs, source).alias("source"), n_words(field(docs, text)).alias("size"), draw(field(docs, doc_id)).alias("h"))
    return materialize(narrow, "mix")


def budgets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target, epochs, below) from measured rows."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return thresholds(rows, materialize(targets(sizes, weights, most), "mix-targets"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, **columns: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row.

    ``taken`` is the words the mix takes of the document: its size times the passes it is in, so it
    never exceeds ``most`` times its size. Null texts have size 0; null is a source of its own,
    after all others; rows with equal ids stand or fall together; an empty table gives no rows.
    """
    rows = measured(docs, **columns)
    goals = budgets(rows, weights, most)
    joined = rows.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    passes = F.col("epochs") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * passes).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns, whatever those are called.

    Documents without words weigh nothing and stay once, so that no clean document is lost to size 0.
    """
    goals = budgets(measured(docs), weights, most).select(F.col("source").alias("of"), "epochs", "below")
    rows = docs.select(packed(docs).alias("row"), field(docs, "source").alias("source"), n_words(field(docs, "text")).alias("size"), draw(field(docs, "doc_id")).alias("h"))
    joined = rows.join(goals, F.col("source").eqNullSafe(F.col("of")))
    passes = F.when(F.col("size") == 0, 1).otherwise(F.col("epochs") + F.when(F.col("h") < F.col("below"), 1).otherwise(0))
    copies = joined.select("row", passes.cast("int").alias("n")).filter("n > 0")
    return unpacked(copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))), "row", docs.columns)


#: The query in DuckDB.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k FROM s),
w AS (SELECT *, CAST(k % 3 + 1 AS BIGINT) AS w, 3 * source_size AS f FROM k),
b AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(w) OVER () AS BIGINT) AS weight,
         CAST(coalesce(sum(f) OVER o, 0) AS BIGINT) AS fb, CAST(coalesce(sum(w) OVER o, 0) AS BIGINT) AS wb
  FROM w WINDOW o AS (ORDER BY CAST(f AS DOUBLE) / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CAST(total - fb AS DOUBLE) / CAST(weight - wb AS DOUBLE) AS level FROM b),
g AS (
  SELECT source, source_size,
         least(coalesce((SELECT level FROM l WHERE level * w <= f ORDER BY wb LIMIT 1), 'infinity'::DOUBLE) * w, CAST(f AS DOUBLE)) AS target
  FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM g),
r AS (SELECT *, target - epochs * source_size AS rest FROM e),
x AS (
  SELECT d.*, r.source_size, r.target, r.epochs, r.rest, sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN upto <= rest OR (upto - own <= rest AND upto - rest < rest - (upto - own)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM x
"""
