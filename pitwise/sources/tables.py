"""Sources and sinks: seasons of Parquet, CSV and JSON, snapshots, live results."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One event-live snapshot: players with their fixtures and the points of each.
EVENT_LIVE = T.StructType([
    T.StructField("elements", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("stats", T.MapType(T.StringType(), T.StringType())),
        T.StructField("explain", T.ArrayType(T.StructType([
            T.StructField("fixture", T.LongType()),
            T.StructField("stats", T.ArrayType(T.StructType([
                T.StructField("identifier", T.StringType()),
                T.StructField("value", T.LongType()),
                T.StructField("points", T.LongType()),
                T.StructField("points_modification", T.LongType()),
            ]))),
        ]))),
    ]))),
])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Asks the file system that Spark uses, whichever it is."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_seasons(spark: SparkSession, root: str, table: str, seasons: list[str] | None = None) -> DataFrame:
    """A table partitioned as ``root/season=.../table``: all seasons asked for must be there."""
    if seasons is None:
        return spark.read.option("basePath", root).parquet(f"{root}/season=*/{table}")
    missing = [s for s in seasons if not path_exists(spark, f"{root}/season={s}/{table}")]
    if missing:
        raise FileNotFoundError(f"{table}: no season {', '.join(missing)}")
    return spark.read.option("basePath", root).parquet(*[f"{root}/season={s}/{table}" for s in seasons])


def write_seasons(df: DataFrame, root: str, table: str, mode: str = "errorifexists") -> list[str]:
    """Writes one folder per season; seasons that are there already are an error unless ``mode`` allows them."""
    seasons = sorted(r[0] for r in df.select("season").distinct().collect())
    for s in seasons:
        df.filter(F.col("season") == s).drop("season").write.mode(mode).parquet(f"{root}/season={s}/{table}")
    return seasons


def read_tree(spark: SparkSession, root: str, pattern: str = "*.parquet", without: str | None = None) -> DataFrame:
    """Every matching file below a folder, with its ``path``; paths that hold ``without`` are left out."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).parquet(root).withColumn("path", F.col("_metadata.file_path"))
    return df if without is None else df.filter(~F.col("path").contains(without))


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A CSV file with a header, by an explicit schema; without one every column is text and nothing is inferred."""
    reader = spark.read.option("header", "true")
    return (reader.schema(schema) if schema else reader).csv(path)


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """The header alone."""
    return spark.read.option("header", "true").csv(path).columns


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON document by its schema; a document that does not fit is an error."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet, CSV or JSON by suffix."""
    kind = path.rsplit(".", 1)[-1]
    writer = df.write.mode(mode)
    if kind == "csv":
        writer.option("header", "true").csv(path)
    elif kind == "json":
        writer.json(path)
    else:
        writer.parquet(path)


def latest_snapshots(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """(endpoint, path, taken): per endpoint the snapshot whose name ``endpoint__YYYYmmddTHHMMSSZ.json`` is the latest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    found = files.select("path", F.regexp_extract(name, r"^(.+)__(\d{8}T\d{6}Z)\.", 1).alias("endpoint"), F.regexp_extract(name, r"__(\d{8}T\d{6}Z)\.", 1).alias("taken")).filter("endpoint <> ''")
    return found.groupBy("endpoint").agg(F.max_by("path", "taken").alias("path"), F.max("taken").alias("taken"))


def with_digests(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, sha256) of every file below a folder, computed where the files are read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return df.select("path", "length", F.sha2("content", 256).alias("sha256"))


def event_live_rows(snapshot: DataFrame) -> DataFrame:
    """(player_id, fixture_id, identifier, value, points, points_modification): one row per scored item.

    Players without fixtures stay, with nulls; an identifier that occurs twice for a player and
    fixture is added up.
    """
    players = snapshot.select(F.explode("elements").alias("e")).select(F.col("e.id").alias("player_id"), F.explode_outer("e.explain").alias("x"))
    items = players.select("player_id", F.col("x.fixture").alias("fixture_id"), F.explode_outer("x.stats").alias("s"))
    return items.groupBy("player_id", "fixture_id", F.col("s.identifier").alias("identifier")).agg(
        F.sum("s.value").alias("value"), F.sum("s.points").alias("points"), F.sum(F.coalesce("s.points_modification", F.lit(0))).alias("points_modification")
    )


def event_live_table(rows: DataFrame, identifiers: list[str]) -> DataFrame:
    """One row per player and fixture with the value of each identifier and the points in all."""
    value = lambda i: F.coalesce(F.sum(F.when(F.col("identifier") == i, F.col("value"))), F.lit(0)).alias(i)
    points = F.coalesce(F.sum("points"), F.lit(0)).alias("event_points")
    return rows.groupBy("player_id", "fixture_id").agg(*[value(i) for i in identifiers], points)


def reconcile(events: DataFrame, reconstructed: DataFrame, keys: list[str], event: str, own: str) -> DataFrame:
    """Rows of both with a status: matched, mismatched, or on one side only."""
    joined = events.join(reconstructed, keys, "full")
    status = F.when(F.col(event).isNull(), "no_event").when(F.col(own).isNull(), "no_reconstruction").when(F.col(event) == F.col(own), "matched").otherwise("mismatched")
    return joined.withColumn("status", status)


def endpoint_slug(name: str) -> str:
    """A name fit for a file: lower case, other characters than letters and digits as single dashes."""
    return re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-")


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all by column name; columns that some lack are null there."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def html_table(df: DataFrame, rows: int = 100) -> str:
    """The first rows as an HTML table, escaped; for a page, so the number of rows is part of the feature."""
    from html import escape

    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in df.limit(rows).collect())
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"
