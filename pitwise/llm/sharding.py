"""Hierarchical weighted hash tree: region, rack and shard by weighted hash draws.

At each level every child of the chosen node draws -ln(u) / weight, u hashed from the document id
and the child's name; the least draw wins. A node's weight is the sum of those below it. A draw
depends on nothing but its own child, so a change of weights moves documents only into or out of
the nodes on the changed paths.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import field, free_name, materialize


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


#: A region of the first build-out has this many racks of this many shards.
RACKS, SHARDS, FIRST = 3, 4, 24
#: Documents that one numbering group of a shard gets on average.
SLOT_GROUP = 50_000


def layout(n: int) -> list[Leaf]:
    """The tree of ``n`` equal shards.

    The first 24 fill racks of four, three to a region. Each later one opens a region of its own:
    all other weights stay as they are, so growing by a shard moves documents only into that shard.
    """
    per = RACKS * SHARDS
    first = [Leaf(f"r{s // per}", f"k{s // SHARDS}", s) for s in range(min(n, FIRST))]
    return first + [Leaf(f"r+{s}", f"k+{s}", s) for s in range(FIRST, n)]


def _draw(doc_id: Column, node: str) -> Column:
    """A 48-bit number for the document and the node."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"|{node}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def _descend(doc_id: Column, children: dict[str, float]) -> Column:
    """The name of the child with the least weighted draw; names break ties."""
    draws = [F.struct((-F.ln((_draw(doc_id, name).cast("double") + 0.5) / float(1 << 48)) / F.lit(float(w))).alias("draw"), F.lit(name).alias("name")) for name, w in sorted(children.items()) if w > 0]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["name"]


def place(doc_id: Column, leaves: list[Leaf]) -> Column:
    """struct(region, rack, shard): the leaf that a document descends to."""
    by_region: dict[str, dict[str, dict[str, float]]] = {}
    for leaf in leaves:
        by_region.setdefault(leaf.region, {}).setdefault(leaf.rack, {})[f"s{leaf.shard}"] = leaf.weight
    region = _descend(doc_id, {r: sum(sum(k.values()) for k in racks.values()) for r, racks in by_region.items()})
    per_region = None
    for r, racks in sorted(by_region.items()):
        rack = _descend(doc_id, {k: sum(s.values()) for k, s in racks.items()})
        shard = None
        for k, shards in sorted(racks.items()):
            one = F.struct(F.lit(r).alias("region"), F.lit(k).alias("rack"), F.substring(_descend(doc_id, shards), 2, 20).cast("int").alias("shard"))
            shard = F.when(rack == k, one) if shard is None else shard.when(rack == k, one)
        per_region = F.when(region == r, shard) if per_region is None else per_region.when(region == r, shard)
    return per_region


def assign(docs: DataFrame, leaves: list[Leaf], doc_id: str = "doc_id", name: str = "shard") -> DataFrame:
    """``docs`` with a column ``shard``; no shuffle, and nothing but the id decides.

    Columns of ``docs`` stay as they are: where one has the name, the new one gets underscores
    after it. Null ids go where the empty id goes.
    """
    return docs.select("*", place(field(docs, doc_id), leaves)["shard"].alias(free_name(name, docs.columns)))


def plan(docs: DataFrame, n: int = 24, doc_id: str = "doc_id", text: str = "text", group: int = SLOT_GROUP) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, region, rack) for every row, by law ``key``.

    ``slot`` numbers the rows of a shard from 0 without gaps. Rows are numbered within hash groups
    of a shard (as many as the row count asks for), then moved up by the counts of the groups
    before, so no task holds a shard. A null text has no bytes; null ids go where the empty id goes;
    rows with equal ids share a shard and have slots of their own.
    """
    at = place(F.col("doc_id"), layout(n))
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(field(docs, doc_id).alias("doc_id"), field(docs, text).cast("string").alias("text")).select(
        "doc_id",
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        at.alias("at"),
        place(F.col("doc_id"), layout(n + 1))["shard"].alias("grown_shard"),
    )
    rows = materialize(rows.select("doc_id", "size", "text_crc32", "at.shard", "at.region", "at.rack", "grown_shard"), "shards")
    groups = max(16, rows.count() // (n * group) + 1)
    # the text's checksum has a say, so that rows of one id, or of none, don't meet in one group
    named = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"))
    rows = rows.withColumn("part", (_draw(named, "slot") % groups).cast("int"))
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = rows.withColumn("k", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1)
    slot = (F.col("start") + F.col("k")).cast("long").alias("slot")
    return numbered.join(counts, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard", "region", "rack")
