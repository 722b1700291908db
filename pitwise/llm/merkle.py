"""Merkle manifest of a dataset: a radix-ranked trie of row digests.

Rows of a source are leaves in the order of their ids. Their exact ranks come from digit
histograms (see ``ranks``), so nothing is sorted as a whole. The digits of a rank in base 16 are
the path of a leaf: leaves that share all digits but the last are one node, nodes that share all
but the last are one node above, and so on, which a grouping per level folds up. The way back down
hands each node the digests beside its path, so proofs need no join with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import field, materialize
from .duckdb_sql import ascii_lower_sql, crc32_sql
from .linededup import ascii_lower
from .ranks import copies, digits, radix_ranks

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node, as a power of two.
FANOUT_BITS = 4
FANOUT = 1 << FANOUT_BITS


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def as_hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def joined(kids: Column) -> Column:
    """The digests of nodes, as hex text, one after the other."""
    return F.array_join(F.transform(kids, lambda k: as_hex(k["digest"])), "")


def leaves(docs: DataFrame, tampered: Column | None = None, columns: tuple[str, ...] = COLUMNS, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(g, id_digits, doc_id, digest, other, n): each different row, and how often it comes.

    ``g`` is the source behind a letter, empty for null. ``other`` is the digest with the text's
    A-Z lower-cased where ``tampered`` holds, else null. Equal rows are counted before they are dealt out.
    """
    values = [encoded(field(docs, c)) for c in columns]
    changed = [encoded(ascii_lower(field(docs, c).cast("string")) if c == text else field(docs, c)) for c in columns]
    other = F.when(tampered, digest(F.concat(*changed))) if tampered is not None else F.lit(None).cast("binary")
    group = F.coalesce(F.concat(F.lit("v"), field(docs, source).cast("string")), F.lit(""))
    rows = docs.select(group.alias("g"), digits(field(docs, doc_id), docs.schema[doc_id].dataType).alias("id_digits"), field(docs, doc_id).alias("doc_id"), digest(F.concat(*values)).alias("digest"), other.alias("other"))
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


def _levels(rows: DataFrame, label: str) -> list[DataFrame]:
    """The levels of the tries of all groups, from the leaves' parents up.

    ``rows`` has (g, rank, digest, size) and more, ``size`` being the number of leaves of the group.
    A level has (g, node, size, kids, digest); a group is in no level above its top. A lone leaf is
    its group's top itself.
    """
    most, levels, k = rows.agg(F.max("size")).first()[0] or 0, [], 0
    while most and (not k or most > FANOUT**k):
        kid = F.struct("rank", "digest", *[c for c in rows.columns if c not in {"g", "rank", "digest", "size"}])
        nodes = rows.groupBy("g", F.shiftright("rank", FANOUT_BITS).alias("node")).agg(F.max("size").alias("size"), F.array_sort(F.collect_list(kid)).alias("kids"))
        folded = F.when(F.col("size") == 1, F.get("kids", F.lit(0))["digest"]).otherwise(digest(joined(F.col("kids"))))
        levels.append(materialize(nodes.withColumn("digest", folded), f"{label}-level-{k}"))
        k += 1
        rows = levels[-1].filter(F.col("size") > FANOUT**k).select("g", F.col("node").alias("rank"), "digest", "size")
    return levels


def _is_top(k: int) -> Column:
    """Whether the nodes of the k-th level (from 1) are the tops of their groups."""
    one = F.col("size") <= FANOUT**k
    return one if k == 1 else one & (F.col("size") > FANOUT ** (k - 1))


def _tops(levels: list[DataFrame]) -> DataFrame | None:
    """(g, digest, size): the top of each group."""
    found = None
    for k, level in enumerate(levels, 1):
        own = level.filter(_is_top(k)).select("g", "digest", "size")
        found = own if found is None else found.unionByName(own)
    return found


def _paths(levels: list[DataFrame], tops: DataFrame, carried: list[str], label: str) -> DataFrame:
    """(g, kid, path, carried ...) of every leaf: the digests left and right of its path, leaf's level first.

    ``tops`` has (g, path, carried ...), the path from the group's top up to the root of all.
    """
    above = None
    for k in range(len(levels), 0, -1):
        paths = tops.withColumn("node", F.lit(0).cast("long"))
        # a top gets its path from the groups' table, every other node from the level above
        at_top = levels[k - 1].filter(_is_top(k)).join(paths, ["g", "node"])
        below = levels[k - 1].filter(~_is_top(k)).join(above, ["g", "node"]) if above is not None else None
        nodes = at_top if below is None else at_top.unionByName(below)
        kids = nodes.select("g", "size", "kids", "path", *carried, F.posexplode("kids").alias("pos", "kid"))
        beside = F.struct(joined(F.slice("kids", F.lit(1), F.col("pos"))).alias("left"), joined(F.slice("kids", F.col("pos") + 2, F.lit(FANOUT))).alias("right"))
        path = F.when(F.col("size") == 1, F.col("path")).otherwise(F.concat(F.array(beside), F.col("path")))
        kids = kids.select("g", "kid", path.alias("path"), *carried)
        if k == 1:
            return kids
        above = materialize(kids.select("g", F.col("kid.rank").alias("node"), "path", *carried), f"{label}-paths-{k}")
    raise ValueError("a trie has a level at least")


def _source_tree(subroots: DataFrame) -> DataFrame:
    """(g, subroot, n_rows, root, path) of each source; ``subroots`` has (g, digest, size)."""
    rows = materialize(subroots.select(F.lit("").alias("g"), F.col("g").alias("source"), F.col("digest"), F.col("size").alias("n_rows"), F.lit(1).cast("long").alias("n")), "merkle-sources")
    n_sources = rows.count()
    ranked = radix_ranks(rows, F.hex(F.col("source").cast("binary")), "merkle-source-ranks")
    levels = _levels(ranked.select("g", F.col("start").alias("rank"), "digest", F.lit(n_sources).cast("long").alias("size"), "source", "n_rows"), "merkle-source")
    tops = _tops(levels).select("g", F.col("digest").alias("root"), F.expr("cast(array() as array<struct<left:string,right:string>>)").alias("path"))
    paths = _paths(levels, tops, ["root"], "merkle-source")
    return paths.select(F.col("kid.source").alias("g"), F.col("kid.digest").alias("subroot"), F.col("kid.n_rows").alias("n_rows"), "root", "path")


def _tries(rows: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The levels over the leaves, and (g, subroot, n_rows, root, path) of the sources."""
    rows = materialize(rows, "merkle-leaves")
    ranked = radix_ranks(rows, F.concat("id_digits", F.lit("/"), F.hex("digest")), "merkle-ranks")
    sizes = materialize(rows.groupBy("g").agg(F.sum("n").alias("size"), F.max("n").alias("most")), "merkle-sizes")
    most = sizes.agg(F.max("most")).first()[0] or 0
    placed = copies(ranked, most).select("g", (F.col("start") + F.col("copy")).alias("rank"), "digest", "other", "doc_id")
    # one row a source; Spark broadcasts it where its size allows
    sized = placed.join(sizes.select("g", "size"), "g")
    levels = _levels(sized, "merkle")
    return levels, (materialize(_source_tree(_tops(levels)), "merkle-tops") if levels else None)


def manifest(docs: DataFrame, **columns) -> DataFrame:
    """(source, n_rows, subroot, root): a row for each source, null for rows without one.

    Null ids come first in their source, equal ids by digest, repeated rows as often as they come.
    An empty table gives no rows.
    """
    levels, tops = _tries(leaves(docs, **columns))
    if tops is None:
        return docs.sparkSession.createDataFrame([], "source string, n_rows long, subroot string, root string")
    return tops.select(F.when(F.col("g") != "", F.substring("g", 2, 1 << 30)).alias("source"), "n_rows", as_hex(F.col("subroot")).alias("subroot"), as_hex(F.col("root")).alias("root"))


def changed_sources(one: DataFrame, other: DataFrame) -> DataFrame:
    """Sources of two manifests whose subroots differ or that only one of them has: (source, n_rows, other_n_rows)."""
    a = one.select(F.col("source").alias("a"), F.col("n_rows"), F.col("subroot").alias("was"))
    b = other.select(F.col("source").alias("b"), F.col("n_rows").alias("other_n_rows"), F.col("subroot").alias("now"))
    both = a.join(b, F.col("a").eqNullSafe(F.col("b")), "full").filter(~F.col("was").eqNullSafe(F.col("now")))
    return both.select(F.coalesce("a", "b").alias("source"), "n_rows", "other_n_rows")


def proofs(docs: DataFrame, tampered: Column | None = None, **columns) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, folded_root, verified) of every row.

    ``path`` holds the digests left and right of the row's own, level by level up to the root;
    ``folded_root`` is computed from them and the row's digest, or that of its tampered text where
    ``tampered`` holds. Nulls in any column are encoded as such; rows that are equal in all columns
    have places side by side; an empty table gives no rows.
    """
    levels, tops = _tries(leaves(docs, tampered, **columns))
    if tops is None:
        kind = docs.schema[columns.get("doc_id", "doc_id")].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, leaf string, subroot string, root string, path array<struct<left:string,right:string>>, folded_root string, verified boolean")
    below = _paths(levels, tops.select("g", "subroot", "root", "path"), ["subroot", "root"], "merkle")
    start = as_hex(F.coalesce(F.col("kid.other"), F.col("kid.digest")))
    folded = F.aggregate("path", start, lambda at, beside: F.sha2(F.concat(beside["left"], at, beside["right"]).cast("binary"), 256))
    rows = below.select(F.col("kid.doc_id").alias("doc_id"), as_hex(F.col("kid.digest")).alias("leaf"), as_hex(F.col("subroot")).alias("subroot"), as_hex(F.col("root")).alias("root"), "path", folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_digest(path: Column) -> Column:
    """sha256 of a proof's digests in order."""
    return F.sha2(F.array_join(F.transform(path, lambda b: F.concat(b["left"], b["right"])), "").cast("binary"), 256)


def _oracle(levels: int = 8) -> str:
    """op11_merkle in DuckDB, for sources of up to 16 ** ``levels`` rows and as many sources."""
    value = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(value(text if c == "text" else c) for c in COLUMNS) + ")"
    first = f"""
d AS (SELECT row_number() OVER () AS rid, *, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '')")} % 5 = 0 AS bad FROM documents),
l AS (SELECT rid, doc_id, source, {leaf('text')} AS leaf, CASE WHEN bad THEN {leaf(ascii_lower_sql('text'))} ELSE {leaf('text')} END AS begin FROM d),
n0 AS (SELECT source AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, count(*) OVER (PARTITION BY source) AS c, rid FROM l)"""
    ctes, at = [first], "SELECT rid, leaf AS h, begin AS f, '' AS proof FROM l"
    # a tree over groups g with nodes i: node tables n0, n1, ...; leaves carry their path as folds from level to level
    def tree(name: str, rows: str, path: str) -> None:
        ctes.append(f"{name}_p0 AS ({path})")
        for k in range(levels):
            source = rows if not k else f"{name}{k}"
            ctes.append(
                f"{name}_k{k} AS (SELECT *, string_agg(h, '') OVER run AS whole, coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft, "
                f"coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM (SELECT g, i, h, c, i // 16 AS up FROM {source}) "
                f"WINDOW run AS (PARTITION BY g, up ORDER BY i))"
            )
            ctes.append(f"{name}{k + 1} AS (SELECT g, i // 16 AS i, CASE WHEN c = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (c + 15) // 16 AS c FROM {source} GROUP BY g, i // 16, c)")
            ctes.append(
                f"{name}_p{k + 1} AS (SELECT rid, p.g, p.i // 16 AS i, CASE WHEN c = 1 THEN f ELSE sha256(lft || f || rgt) END AS f, CASE WHEN c = 1 THEN proof ELSE proof || lft || rgt END AS proof "
                f"FROM {name}_p{k} p JOIN {name}_k{k} k ON p.g IS NOT DISTINCT FROM k.g AND p.i = k.i)"
            )

    tree("t", "n0", "SELECT n0.rid, g, i, begin AS f, '' AS proof FROM n0 JOIN l USING (rid)")
    ctes.append(f"s0 AS (SELECT 1 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h, count(*) OVER () AS c, g AS source FROM t{levels})")
    tree("r", "s0", f"SELECT rid, 1 AS g, s0.i, f, proof FROM t_p{levels} p JOIN s0 ON p.g IS NOT DISTINCT FROM s0.source")
    return f"""WITH {", ".join(ctes)}
SELECT doc_id, leaf, s0.h AS subroot, r.h AS root, sha256(p.proof) AS proof_sha256, p.f AS folded_root, p.f = r.h AS verified
FROM l JOIN r_p{levels} p USING (rid) JOIN s0 ON l.source IS NOT DISTINCT FROM s0.source, r{levels} r"""


ORACLE = _oracle()
