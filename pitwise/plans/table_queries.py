"""Queries on tables: joins, identities, quality, text, ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwise.functions import scoring, temporal, text
from pitwise.operators import quality, relational

from .league import FACT_SQL, FIXTURE_SQL, PANEL_SQL, facts, fixtures, panel, table

QUERIES: dict = {}


def query(sql: str | None = None, doubles: tuple[str, ...] = ()):
    def add(f):
        QUERIES[f.__name__] = (f, sql, list(doubles))
        return f

    return add


@query(PANEL_SQL + " SELECT season, gameweek, min(information_cutoff) AS information_cutoff, max(available_time) AS last_available, CAST(count(*) AS BIGINT) AS n FROM panel GROUP BY ALL")
def panel_cutoff_and_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel(spark, sf_dir).withColumn("available", temporal.available_time(F.col("kickoff_time")))
    return df.groupBy("season", "gameweek").agg(F.min("information_cutoff").alias("information_cutoff"), F.max("available").alias("last_available"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, n_name, CAST(count(*) AS BIGINT) AS n, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL", ["revenue"])
def fact_dims_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_suppkey", "l_extendedprice", "l_discount")
    dims = relational.small(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"))
    named = lines.join(dims, "l_suppkey").join(F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")), "s_nationkey", "left")
    return named.groupBy("l_returnflag", "n_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


@query(FIXTURE_SQL + " SELECT f.fixture_key, h.n_name AS home_n_name, a.n_name AS away_n_name FROM fixture f LEFT JOIN nation h ON f.home_team_uid = h.n_nationkey LEFT JOIN nation a ON f.away_team_uid = a.n_nationkey")
def two_role_dimension_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.join_roles(fixtures(spark, sf_dir), table(spark, sf_dir, "nation"), "n_nationkey", {"home": "home_team_uid", "away": "away_team_uid"}, ["n_name"]).select("fixture_key", "home_n_name", "away_n_name")


@query(FACT_SQL + " SELECT fixture_key, CASE WHEN was_home THEN team_uid ELSE opponent_uid END AS home_uid, CASE WHEN was_home THEN opponent_uid ELSE team_uid END AS away_uid FROM fact")
def side_opponent_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = facts(spark, sf_dir)
    home = F.col("was_home")
    return df.select("fixture_key", relational.opposite(home, F.col("opponent_uid"), F.col("team_uid")).alias("home_uid"), relational.opposite(home, F.col("team_uid"), F.col("opponent_uid")).alias("away_uid"))


@query(FIXTURE_SQL + ", s AS (SELECT fixture_key, true AS is_home, home_team_uid AS team, away_team_uid AS opponent_team, home_goals AS goals, away_goals AS opponent_goals FROM fixture UNION ALL SELECT fixture_key, false, away_team_uid, home_team_uid, away_goals, home_goals FROM fixture) SELECT team, is_home, CAST(count(*) AS BIGINT) AS n, CAST(sum(goals) AS BIGINT) AS goals_for, CAST(sum(opponent_goals) AS BIGINT) AS goals_against FROM s GROUP BY ALL")
def sided_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = relational.both_sides(fixtures(spark, sf_dir), ["fixture_key"], {"team": ("home_team_uid", "away_team_uid"), "goals": ("home_goals", "away_goals")})
    return df.groupBy("team", "is_home").agg(F.count(F.lit(1)).alias("n"), F.sum("goals").alias("goals_for"), F.sum("opponent_goals").alias("goals_against"))


@query("SELECT c_custkey, trim(regexp_replace(replace(lower(trim(c_name || ' & Co. City')), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS name, 'team_' || replace(trim(regexp_replace(replace(lower(trim(c_name)), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' ', '_') AS uid, regexp_replace(trim(regexp_replace(lower(trim(c_mktsegment || ' City')), '[^a-z0-9]+', ' ', 'g')), ' (town|city)$', '') AS short_name FROM customer")
def identity_normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", text.normalized_name(F.concat(name, F.lit(" & Co. City"))).alias("name"), text.slug_uid("team", name).alias("uid"), text.short_club_name(F.concat("c_mktsegment", F.lit(" City"))).alias("short_name"))


@query("WITH o AS (SELECT s_suppkey AS c_custkey, 'manual_' || s_suppkey AS manual FROM supplier WHERE s_suppkey % 5 = 0), k AS (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0) SELECT c.c_custkey, coalesce(o.manual, k.n_name, 'player_' || c.c_custkey) AS uid, CASE WHEN o.manual IS NOT NULL THEN 'override' WHEN k.n_name IS NOT NULL THEN 'stable_code' ELSE 'season_id' END AS method FROM customer c LEFT JOIN o USING (c_custkey) LEFT JOIN k ON c.c_nationkey = k.n_nationkey")
def identity_override_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    manual = table(spark, sf_dir, "supplier").filter("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("c_custkey"), F.concat(F.lit("manual_"), "s_suppkey").alias("manual"))
    codes = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    df = table(spark, sf_dir, "customer").join(relational.small(manual), "c_custkey", "left").join(F.broadcast(codes), "c_nationkey", "left")
    uid = F.coalesce("manual", "n_name", F.concat(F.lit("player_"), F.col("c_custkey").cast("string")))
    method = F.when(F.col("manual").isNotNull(), "override").when(F.col("n_name").isNotNull(), "stable_code").otherwise("season_id")
    return df.select("c_custkey", uid.alias("uid"), method.alias("method"))


@query("SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n_c_mktsegment, count(DISTINCT c_name) AS n_c_name FROM customer WHERE c_nationkey IS NOT NULL GROUP BY 1 HAVING greatest(count(DISTINCT c_mktsegment), count(DISTINCT c_name)) > 1")
def identity_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.identity_collisions(table(spark, sf_dir, "customer"), "c_nationkey", ["c_mktsegment", "c_name"])


@query("WITH c AS (SELECT count(*) FILTER (c_name IS NULL) AS a, count(*) FILTER (c_acctbal < 0) AS b, count(*) FILTER (NOT c_nationkey BETWEEN 0 AND 20) AS c, count(*) FILTER (c_mktsegment NOT IN ('MACHINERY', 'HOUSEHOLD')) AS d FROM customer) SELECT unnest(['null:c_name', 'negative:c_acctbal', 'range:c_nationkey', 'enum:c_mktsegment']) AS rule, unnest([a, b, c, d]) AS rows FROM c")
def dq_null_range_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {**quality.not_null("c_name"), **quality.not_negative("c_acctbal"), **quality.in_range("c_nationkey", 0, 20), **quality.one_of("c_mktsegment", "MACHINERY", "HOUSEHOLD")}
    return quality.violations(table(spark, sf_dir, "customer"), rules)


@query("SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def dq_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.surplus_rows(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_partkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size < 25)")
def dq_ref_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "part").filter("p_size < 25")
    return quality.orphans(table(spark, sf_dir, "lineitem"), known, [("l_partkey", "p_partkey")]).select("l_orderkey", "l_partkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, count(DISTINCT (l_partkey, l_suppkey)) AS versions FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT (l_partkey, l_suppkey)) > 1")
def dq_conflicting_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.conflicting_keys(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey", "l_linenumber"])


@query("WITH t AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'not a time' ELSE CAST(o_orderdate AS VARCHAR) END AS x, o_orderpriority AS p FROM orders), c AS (SELECT count(*) FILTER (x = 'not a time') AS a, count(*) FILTER (contains(lower(p), 'urgent')) AS b FROM t) SELECT unnest(['unreadable_time:x', 'marker:p']) AS rule, unnest([a, b]) AS rows FROM c")
def dq_times_and_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 7 == 0, "not a time").otherwise(F.col("o_orderdate").cast("string")).alias("x"), F.col("o_orderpriority").alias("p"))
    return quality.violations(df, {**quality.readable_time("x"), **quality.no_marker("p", "urgent")})


@query("SELECT o_orderkey, count(DISTINCT side) AS sides FROM (SELECT l_orderkey AS o_orderkey, l_linenumber % 2 AS side FROM lineitem) GROUP BY 1 HAVING count(DISTINCT side) <> 2")
def dq_incomplete_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") % 2).alias("side"))
    return quality.incomplete_sides(df, ["o_orderkey"], "side")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.keep_latest(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT p_brand, p_partkey, rank FROM (SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS rank FROM part) WHERE rank <= 3")
def top_three_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.top_per_group(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 3).select("p_brand", "p_partkey", "rank")


@query("SELECT user_id, CAST(extract(day FROM ts) AS INTEGER) AS day, string_agg(event_type, ', ' ORDER BY ts, event_type) AS line FROM events GROUP BY 1, 2")
def fixture_text_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("day", F.dayofmonth("ts"))
    return relational.collected_text(df, ["user_id", "day"], F.col("event_type"), [F.col("ts")], "line")


@query("SELECT o_orderpriority, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS F, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS O, CAST(count(*) FILTER (o_orderstatus = 'F') - count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS difference FROM orders GROUP BY 1")
def pivot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).count().na.fill(0, ["F", "O"])
    return wide.withColumn("difference", F.col("F") - F.col("O"))


@query("SELECT season, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (minutes > 0) AS BIGINT) AS played, count(DISTINCT player_uid) AS players FROM (" + FACT_SQL + " SELECT * FROM fact) GROUP BY ROLLUP (season)")
def coverage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).rollup("season").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("minutes") > 0).alias("played"), F.count_distinct("player_uid").alias("players"))


@query(FACT_SQL + " SELECT CAST(fixture_key AS VARCHAR) || ':' || season AS key, season || '_gw' || lpad(CAST(gameweek AS VARCHAR), 2, '0') AS fold, CAST(substr(season, 1, 4) AS BIGINT) AS start FROM fact")
def composite_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select(text.composite_key(F.col("fixture_key"), F.col("season")).alias("key"), text.fold_label(F.col("season"), F.col("gameweek")).alias("fold"), temporal.season_start(F.col("season")).alias("start"))


@query("SELECT o_orderkey, CASE WHEN extract(month FROM o_orderdate) >= 6 THEN extract(year FROM o_orderdate) ELSE extract(year FROM o_orderdate) - 1 END || '-' || lpad(CAST((CASE WHEN extract(month FROM o_orderdate) >= 6 THEN extract(year FROM o_orderdate) ELSE extract(year FROM o_orderdate) - 1 END + 1) % 100 AS VARCHAR), 2, '0') AS season FROM orders")
def season_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", temporal.season_of(F.col("o_orderdate")).alias("season"))


@query("SELECT p_partkey, sell FROM (SELECT p_partkey, CAST(p_retailprice AS BIGINT) AS buy, CAST(p_retailprice AS BIGINT) + p_size - 25 AS now, CAST(CASE WHEN CAST(p_retailprice AS BIGINT) + p_size - 25 <= CAST(p_retailprice AS BIGINT) THEN CAST(p_retailprice AS BIGINT) + p_size - 25 ELSE CAST(p_retailprice AS BIGINT) + floor((p_size - 25) * 0.5) END AS BIGINT) AS sell FROM (SELECT p_partkey, p_size, floor(p_retailprice) AS p_retailprice FROM part))")
def selling_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    buy = F.floor("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", scoring.selling_price(buy, buy + F.col("p_size") - 25).alias("sell"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest, length(text) AS n FROM documents")
def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"), F.length("text").cast("long").alias("n"))


@query("SELECT page_id, url FROM pages WHERE contains(lower(concat_ws(' ', url, html)), 'the') ")
def text_search_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").filter(text.contains_text(" The ", F.col("url"), F.col("html"))).select("page_id", "url")


@query("SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_custkey").intersect(chosen)


@query("SELECT user_id, CAST(extract(hour FROM ts) AS INTEGER) AS h, CAST(sum(k) AS BIGINT) AS total FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events) GROUP BY 1, 2")
def json_field_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("user_id", F.hour("ts").alias("h"), F.from_json("props", "k long")["k"].alias("k"))
    return df.groupBy("user_id", "h").agg(F.sum("k").alias("total"))
