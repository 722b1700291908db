"""Queries on contracts between tables: coercion, sides, candidates, completeness, rules, identities, fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwise.functions import temporal, text
from pitwise.operators import metrics, quality, relational, written

from . import decisions, features, lineups
from .decision_queries import POOL_SQL, pool
from .feature_queries import FEATURES_SQL
from .league import FIXTURE_SQL, PANEL_SQL, fixtures, panel, table

QUERIES: dict = {}


def query(sql: str | None = None, doubles: tuple[str, ...] = ()):
    def add(f):
        QUERIES[f.__name__] = (f, sql, list(doubles))
        return f

    return add


_TEXT = "CASE CAST({k} % 5 AS INTEGER) WHEN 0 THEN CAST({v} AS VARCHAR) WHEN 1 THEN ' ' || CAST({k} AS VARCHAR) || ' ' WHEN 2 THEN 'n/a' WHEN 3 THEN '' ELSE NULL END"


@query("SELECT event_id, TRY_CAST(t AS DOUBLE) AS value, coalesce(TRY_CAST(t AS DOUBLE), 0) AS value_or_zero, TRY_CAST(t AS BIGINT) IS NOT NULL AND t NOT LIKE '%.%' AS whole FROM (SELECT event_id, " + _TEXT.format(k="event_id", v="value") + " AS t FROM events)", ["value", "value_or_zero"])
def numeric_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that come as text, some of them unreadable: null or zero instead of an error."""
    raw = table(spark, sf_dir, "events").select("event_id", F.expr(_TEXT.format(k="event_id", v="value").replace("VARCHAR", "STRING")).alias("t"))
    whole = text.number_or_null(F.col("t"), "bigint").isNotNull() & ~F.coalesce(F.col("t").contains("."), F.lit(True))
    return raw.select("event_id", text.number_or_null(F.col("t")).alias("value"), text.number(F.col("t")).alias("value_or_zero"), whole.alias("whole"))


_SIDES = ", x AS (SELECT *, CASE WHEN fixture_key % 50 = 0 THEN (team_uid + 1) % 20 ELSE team_uid END AS home_team_uid, opponent_uid AS away_team_uid, CASE WHEN fixture_key % 70 = 0 THEN available_time ELSE kickoff_time END AS fixture_kickoff_time FROM panel)"


@query(PANEL_SQL + _SIDES + " SELECT 'team_side' AS rule, count(*) FILTER (team_uid IS DISTINCT FROM CASE WHEN was_home THEN home_team_uid ELSE away_team_uid END) AS rows FROM x UNION ALL SELECT 'kickoff', count(*) FILTER (kickoff_time IS DISTINCT FROM fixture_kickoff_time) FROM x")
def side_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel(spark, sf_dir).withColumns({
        "home_team_uid": F.when(F.col("fixture_key") % 50 == 0, (F.col("team_uid") + 1) % 20).otherwise(F.col("team_uid")),
        "away_team_uid": F.col("opponent_uid"),
        "fixture_kickoff_time": F.when(F.col("fixture_key") % 70 == 0, F.col("available_time")).otherwise(F.col("kickoff_time")),
    })
    return quality.side_faults(df)


_RAW_POOL = ", x AS (SELECT player_uid - CASE WHEN player_uid % 90 = 0 THEN 1 ELSE 0 END AS player_uid, CASE WHEN player_uid % 41 = 0 THEN 'COACH' WHEN player_uid % 43 = 0 THEN NULL ELSE position END AS position, CASE WHEN player_uid % 37 = 0 THEN 'free' WHEN player_uid % 31 = 0 THEN '45.5' ELSE CAST(price_tenths AS VARCHAR) END AS price_tenths, CASE WHEN player_uid % 29 = 0 THEN NULL ELSE CAST(expected_points AS VARCHAR) END AS expected_points FROM pool)"


@query(POOL_SQL + _RAW_POOL + ", p AS (SELECT *, TRY_CAST(price_tenths AS DOUBLE) AS c FROM x) SELECT 'position' AS rule, count(*) FILTER (position IS NULL OR position NOT IN ('GKP', 'DEF', 'MID', 'FWD')) AS rows FROM p UNION ALL SELECT 'price', count(*) FILTER (c IS NULL OR c <= 0 OR c % 1 <> 0) FROM p UNION ALL SELECT 'points', count(*) FILTER (TRY_CAST(expected_points AS DOUBLE) IS NULL) FROM p UNION ALL SELECT 'duplicate_player', count(*) - count(DISTINCT player_uid) FROM p")
def candidate_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("player_uid")
    df = pool(spark, sf_dir).select(
        (i - F.when(i % 90 == 0, 1).otherwise(0)).alias("player_uid"),
        F.when(i % 41 == 0, "COACH").when(i % 43 == 0, None).otherwise(F.col("position")).alias("position"),
        F.when(i % 37 == 0, "free").when(i % 31 == 0, "45.5").otherwise(F.col("price_tenths").cast("string")).alias("price_tenths"),
        F.when(i % 29 != 0, F.col("expected_points").cast("string")).alias("expected_points"),
    )
    return quality.candidate_faults(df, decisions.POSITIONS)


_SEASONS = ["2020-21", "2021-22", "2022-23", "2023-24", "2030-31"]


@query(
    FEATURES_SQL
    + ", s(season) AS (VALUES " + ", ".join(f"('{s}')" for s in _SEASONS) + ")"
    + " SELECT 'missing_key' AS rule, count(*) FILTER (season IS NULL OR player_uid IS NULL OR fixture_key IS NULL) AS rows FROM feature"
    + " UNION ALL SELECT 'missing_time', count(*) FILTER (available_time IS NULL OR information_cutoff IS NULL) FROM feature"
    + " UNION ALL SELECT 'target_before_cutoff', count(*) FILTER (available_time <= information_cutoff) FROM feature"
    + " UNION ALL SELECT 'season_not_asked', count(*) FILTER (season NOT IN (SELECT season FROM s)) FROM feature"
    + " UNION ALL SELECT 'history_after_cutoff:player_source_time', count(*) FILTER (player_source_time >= information_cutoff) FROM feature"
    + " UNION ALL SELECT 'season_absent', count(*) FROM s WHERE season NOT IN (SELECT season FROM feature)"
    + " UNION ALL SELECT 'duplicate_key', CAST((SELECT count(*) FROM feature) - (SELECT count(*) FROM (SELECT DISTINCT season, player_uid, fixture_key FROM feature)) AS BIGINT)"
)
def artifact_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.player_features(panel(spark, sf_dir))
    return quality.artifact_faults(df, ["season", "player_uid", "fixture_key"], _SEASONS, "available_time", "information_cutoff", ["player_source_time"])


_GATE = "TIMESTAMP '2000-01-01 00:00:00'"


@query(FIXTURE_SQL + f" SELECT 'missing_time' AS rule, count(*) FILTER (available_time IS NULL) AS rows FROM fixture UNION ALL SELECT 'after_cutoff', count(*) FILTER (available_time >= {_GATE}) FROM fixture UNION ALL SELECT 'not_completed', count(*) FILTER (NOT (home_goals > 0)) FROM fixture UNION ALL SELECT 'duplicate_key', CAST((SELECT count(*) FROM fixture) - (SELECT count(*) FROM (SELECT DISTINCT season, gameweek, home_team_uid FROM fixture)) AS BIGINT)")
def completed_input_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixtures(spark, sf_dir).withColumn("completed", F.col("home_goals") > 0)
    return quality.completed_faults(df, ["season", "gameweek", "home_team_uid"], "available_time", F.expr(_GATE.replace("TIMESTAMP", "TIMESTAMP_NTZ")), "completed")


@query("WITH f AS (SELECT r_name AS name, CAST(r_regionkey AS VARCHAR) AS value FROM region), w(name, expected) AS (VALUES ('AFRICA', '0'), ('ASIA', '7'), ('ATLANTIS', '5'), ('EUROPE', '3')) SELECT coalesce(w.name, f.name) AS name, w.expected, f.value AS found FROM w FULL JOIN f ON w.name = f.name WHERE w.expected IS DISTINCT FROM f.value")
def rule_schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("value"))
    return quality.rule_differences(found, {"AFRICA": "0", "ASIA": "7", "ATLANTIS": "5", "EUROPE": "3"})


@query(FIXTURE_SQL + ", c AS (SELECT * FROM fixture WHERE kickoff_time >= TIMESTAMP '1999-06-01' AND kickoff_time < TIMESTAMP '2000-06-01'), r AS (SELECT min(kickoff_time) AS a, max(kickoff_time) AS b, CAST(count(DISTINCT gameweek) AS BIGINT) AS events, count(*) AS matches FROM c), t AS (SELECT CAST(count(DISTINCT x) AS INTEGER) AS teams FROM (SELECT home_team_uid AS x FROM c UNION ALL SELECT away_team_uid FROM c)), i AS (SELECT *, year(a) - CASE WHEN month(a) < 6 THEN 1 ELSE 0 END AS y FROM r, t) SELECT y || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS inferred_season, teams, events, matches, y = 1999 AS season_ok, year(a) IN (1999, 2000) AND year(b) IN (1999, 2000) AS window_ok, teams = 20 AND events = 38 AND matches = 380 AS counts_ok FROM i")
def season_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The season of a year's fixtures, told from the kickoffs."""
    year = fixtures(spark, sf_dir).filter("kickoff_time >= TIMESTAMP_NTZ '1999-06-01' AND kickoff_time < TIMESTAMP_NTZ '2000-06-01'")
    return quality.season_identity(year, "1999-00")


@query("SELECT user_id, max(ts) AS latest FROM (SELECT user_id, event_type, max(ts) AS ts FROM events WHERE event_type <> 'error' GROUP BY ALL) GROUP BY 1")
def snapshot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest time in a map of snapshot times kept as text; unreadable ones don't count."""
    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("ts"))
    told = F.when(F.col("event_type") == "error", "unreadable").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    maps = last.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", told))).alias("times"))
    found = maps.select("user_id", temporal.latest_in_map(F.col("times")).cast("timestamp_ntz").alias("latest"))
    return found.filter("latest IS NOT NULL")


@query("WITH own AS (SELECT o_custkey, avg(o_totalprice) AS m, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), grp AS (SELECT c_nationkey, avg(o_totalprice) AS m, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) SELECT c_custkey, coalesce(own.m, grp.m) AS mean_price, coalesce(own.n, grp.n) AS n, own.m IS NULL AS is_fallback FROM customer LEFT JOIN own ON o_custkey = c_custkey LEFT JOIN grp USING (c_nationkey) WHERE own.m IS NOT NULL OR grp.m IS NOT NULL", ["mean_price"])
def fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's mean of pending orders; of those who have none, their nation's mean of all."""
    orders, customer = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    made = [F.avg("o_totalprice").alias("mean_price"), F.count(F.lit(1)).alias("n")]
    own = orders.filter("o_orderstatus = 'P'").groupBy("c_custkey").agg(*made)
    nation = orders.join(customer, "c_custkey").groupBy("c_nationkey").agg(*made)
    return relational.join_or_fallback(customer, own, ["c_custkey"], nation, ["c_nationkey"]).drop("c_nationkey")


@query("WITH b AS (SELECT s_suppkey AS c_custkey, 'supplier-' || s_suppkey AS uid FROM supplier) SELECT c_custkey, coalesce(uid, 'new-' || replace(lower(c_name), '#', '-')) AS uid FROM customer LEFT JOIN b USING (c_custkey)")
def identity_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    bridge = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("uid"))
    slug = F.concat(F.lit("new-"), F.translate(F.lower("c_name"), "#", "-"))
    return relational.bridged(table(spark, sf_dir, "customer"), bridge, ["c_custkey"], "uid", slug).select("c_custkey", "uid")


@query(PANEL_SQL + ", l AS (SELECT max(gameweek) AS g FROM panel WHERE season = '2024-25'), u AS (SELECT DISTINCT player_uid FROM panel), b AS (SELECT player_uid FROM u WHERE player_uid NOT IN (SELECT player_uid FROM panel, l WHERE season = '2024-25' AND gameweek = g)) SELECT player_uid, v AS variant, 0.0 AS expected_points, 0.0 AS p_appearance, 1.0 AS prob_eq_0 FROM b, (VALUES ('M3'), ('M5'), ('M7')) AS t(v)", ["expected_points", "p_appearance", "prob_eq_0"])
def blank_fixture_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero predictions of every model for players without a fixture in the last block."""
    df = panel(spark, sf_dir)
    season = df.filter("season = '2024-25'").select("gameweek", "player_uid")
    last = relational.small(season.agg(F.max("gameweek").alias("gameweek")))
    present = season.join(last, "gameweek").select("player_uid")
    zeros = {"expected_points": 0.0, "p_appearance": 0.0, "prob_eq_0": 1.0}
    return relational.blank_rows(df.select("player_uid").distinct(), present, ["player_uid"], ["M3", "M5", "M7"], zeros)


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'someone else' ELSE c_name END AS c_name, c_custkey % 11 <> 0 AND c_custkey % 7 <> 0 AS valid FROM customer")
def saved_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved rows whose id now stands for someone else, or for nobody, are no longer valid."""
    now = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    saved = now.withColumn("c_name", F.when(F.col("c_custkey") % 7 == 0, "someone else").otherwise(F.col("c_name")))
    return relational.still_the_same(saved, now.filter("c_custkey % 11 <> 0"), ["c_custkey"], ["c_name"])


_FORECAST = {"prob_ge_5": "CAST(fixture_key % 10 AS DOUBLE) / 10.0", "prob_eq_0": "CAST(fixture_key % 4 AS DOUBLE) / 4.0", "p10": "CAST(fixture_key % 3 AS DOUBLE)", "p90": "CAST(fixture_key % 3 + 6 AS DOUBLE)"}


@query(PANEL_SQL + ", x AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _FORECAST.items()) + " FROM panel) SELECT position, count(*) AS rows, avg((prob_ge_5 - CASE WHEN total_points >= 5 THEN 1 ELSE 0 END) ** 2) AS tail_brier, avg(prob_eq_0) AS zero_rate_predicted, avg(CASE WHEN total_points = 0 THEN 1.0 ELSE 0.0 END) AS zero_rate_actual, avg(CASE WHEN total_points BETWEEN p10 AND p90 THEN 1.0 ELSE 0.0 END) AS coverage, avg(p90 - p10) AS sharpness FROM x GROUP BY 1", ["tail_brier", "zero_rate_predicted", "zero_rate_actual", "coverage", "sharpness"])
def distribution_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel(spark, sf_dir).withColumns({k: F.expr(v) for k, v in _FORECAST.items()})
    made = metrics.distribution_metrics("total_points", {"tail_brier": ("prob_ge_5", 5)}, "prob_eq_0", ("p10", "p90"))
    return df.groupBy("position").agg(*[c.alias(n) for n, c in made.items()])


@query(PANEL_SQL + ", x AS (SELECT position, fixture_key % 3 / 4.0 AS xg, fixture_key % 4 / 5.0 AS xa, goals_scored, assists FROM panel), y AS (SELECT position, 'goals' AS component, xg AS p, goals_scored AS a FROM x UNION ALL SELECT position, 'assists', xa, assists FROM x) SELECT position, component, count(*) AS rows, avg(p) AS mean_prediction, avg(a) AS mean_actual, avg(abs(p - a)) AS mae, avg((least(greatest(p, 0), 1) - CASE WHEN a > 0 THEN 1 ELSE 0 END) ** 2) AS event_brier FROM y GROUP BY ALL", ["mean_prediction", "mean_actual", "mae", "event_brier"])
def component_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel(spark, sf_dir).withColumns({"xg": F.col("fixture_key") % 3 / 4.0, "xa": F.col("fixture_key") % 4 / 5.0})
    return metrics.component_metrics(df, ["position"], {"goals": ("xg", "goals_scored"), "assists": ("xa", "assists")})


@query(POOL_SQL + ", o AS (SELECT expected_points AS x, price_tenths AS c FROM pool WHERE player_uid = 7) SELECT player_uid, price_tenths, expected_points, expected_points / (price_tenths / 10.0) AS points_per_million, expected_points - x AS delta FROM pool, o WHERE price_tenths <= c + 5 AND position = 'MID' AND player_uid NOT IN (7, 12, 20) ORDER BY expected_points DESC, expected_points / (price_tenths / 10.0) DESC, p_appearance DESC, price_tenths, player_name, player_uid LIMIT 5", ["expected_points", "points_per_million", "delta"])
def player_finder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best replacements by all six keys, without those already selected, and what they gain."""
    df = pool(spark, sf_dir)
    out = relational.small(df.filter("player_uid = 7").select(F.col("expected_points").alias("out_points"), F.col("price_tenths").alias("out_price")))
    open_ = df.filter("position = 'MID'").filter(~F.col("player_uid").isin(7, 12, 20)).crossJoin(out)
    found = decisions.finder(open_, F.col("out_price") + 5, baseline=F.col("out_points"))
    return found.select("player_uid", "price_tenths", "expected_points", "points_per_million", "delta")


@query(POOL_SQL + " SELECT player_uid, expected_points FROM pool WHERE position = 'DEF' AND contains(lower(concat_ws(' ', player_name, club)), 're') AND player_uid % 5 <> 0 ORDER BY expected_points, player_uid LIMIT 10", ["expected_points"])
def replacement_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten matches of a search, lowest points first, without the selected ones."""
    df = pool(spark, sf_dir)
    chosen = df.filter("player_uid % 5 = 0").select("player_uid")
    found = df.filter((F.col("position") == "DEF") & text.contains_text("RE", F.col("player_name"), F.col("club"))).join(chosen, "player_uid", "left_anti")
    return decisions.sorted_projection(found, ascending=True).limit(10).select("player_uid", "expected_points")


@query("WITH d AS (SELECT max(date_trunc('month', o_orderdate)) AS m FROM orders) SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders, d WHERE date_trunc('month', o_orderdate) = m")
def players_without_recent_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that have no row in the latest block."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.trunc("o_orderdate", "month").alias("month"))
    last = relational.small(orders.agg(F.max("month").alias("month")))
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders.join(last, "month"), "c_custkey", "left_anti")


@query()
def squad_local_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact squad of each block bettered by single swaps with its whole pool."""
    return decisions.local_search(pool(spark, sf_dir).drop("player_name"), ["block"])


_QUOTA = dict(zip(decisions.POSITIONS, decisions.RULES.quota, strict=True))
_TAKEN = "CASE position " + " ".join(f"WHEN '{p}' THEN {q}" for p, q in _QUOTA.items()) + " END"
#: Squads of the cheapest players, and each one's six best replacements for a bank of 20.
_OPTIONS_SQL = (
    POOL_SQL.replace("WITH pool AS (", "WITH pool0 AS (") + ", pool AS (SELECT * REPLACE (round(expected_points, 9) AS expected_points) FROM pool0)"
    + f", squad AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY block, position ORDER BY price_tenths, player_uid) AS k FROM pool) WHERE k <= {_TAKEN})"
    + ", option AS (SELECT * FROM (SELECT o.block, o.player_uid AS out_uid, o.club AS out_club, o.price_tenths - i.price_tenths AS saved, i.player_uid AS in_uid, i.club AS in_club, i.expected_points - o.expected_points AS gain,"
    + " row_number() OVER (PARTITION BY o.block, o.player_uid ORDER BY i.expected_points - o.expected_points DESC, i.player_uid) AS k FROM squad o JOIN pool i ON i.block = o.block AND i.position = o.position AND i.price_tenths <= o.price_tenths + 20 AND i.player_uid NOT IN (SELECT player_uid FROM squad)) WHERE k <= 6)"
)
_SETS_SQL = (
    _OPTIONS_SQL
    + ", s0 AS (SELECT DISTINCT block, CAST(NULL AS BIGINT) AS last, CAST(0 AS DOUBLE) AS gain, CAST(20 AS BIGINT) AS bank, CAST([] AS STRUCT(o BIGINT, i BIGINT)[]) AS moves, CAST([] AS VARCHAR[]) AS gone, CAST([] AS VARCHAR[]) AS come FROM squad)"
    + "".join(f", s{n + 1} AS (SELECT s.block, out_uid AS last, s.gain + o.gain AS gain, bank + saved AS bank, list_append(moves, {{'o': out_uid, 'i': in_uid}}) AS moves, list_append(gone, out_club) AS gone, list_append(come, in_club) AS come FROM s{n} s JOIN option o ON o.block = s.block AND (last IS NULL OR out_uid > last) AND NOT list_contains(list_transform(moves, lambda m: m.i), in_uid))" for n in range(3))
    + ", every AS (SELECT row_number() OVER () AS id, * FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3) WHERE bank >= 0)"
    + ", own AS (SELECT block, club, count(*) AS n FROM squad GROUP BY ALL)"
    + ", change AS (SELECT id, block, club, sum(n) AS n FROM (SELECT id, block, unnest(gone) AS club, -1 AS n FROM every UNION ALL SELECT id, block, unnest(come), 1 FROM every) GROUP BY ALL)"
    + ", crowded AS (SELECT id FROM change c LEFT JOIN own o USING (block, club) WHERE coalesce(o.n, 0) + c.n > 3 UNION SELECT e.id FROM every e JOIN own o ON o.block = e.block AND o.n > 3 LEFT JOIN change c ON c.id = e.id AND c.club = o.club WHERE o.n + coalesce(c.n, 0) > 3)"
    + ", legal AS (SELECT *, round(gain, 9) AS g FROM every WHERE id NOT IN (SELECT id FROM crowded))"
)


def cheapest_squads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(squads, pool): the cheapest players of each position up to its quota, in each block."""
    df = pool(spark, sf_dir).drop("player_name").withColumn("expected_points", F.round("expected_points", 9))
    squad = None
    for p, q in _QUOTA.items():
        part = relational.top_per_group(df.filter(F.col("position") == p), ["block"], [F.asc("price_tenths"), F.asc("player_uid")], q).select(*df.columns)
        squad = part if squad is None else squad.unionByName(part)
    return written.once(squad, "squads"), df


@query(_SETS_SQL + " SELECT block, CAST(k AS INTEGER) AS rank, g AS gain, array_to_string(list_transform(moves, lambda m: m.o || '>' || m.i), '; ') AS moves FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY g DESC, moves) AS k FROM legal) WHERE k <= 5", ["gain"])
def transfer_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all legal sets of up to three transfers of each block's squad."""
    squad, df = cheapest_squads(spark, sf_dir)
    return decisions.transfer_sets(squad, df, ["block"], bank=20)


@query(_SETS_SQL + " SELECT block, CAST(len(moves) AS INTEGER) AS transfers, CAST(count(*) AS BIGINT) AS sets, max(g) AS best, max(bank) AS most_left FROM legal GROUP BY ALL", ["best"])
def transfer_set_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many legal sets of each size there are, the best gain and the most money left."""
    squad, df = cheapest_squads(spark, sf_dir)
    legal = decisions.legal_transfer_sets(squad, decisions.transfer_options(squad, df, ["block"], 20), ["block"], 20)
    return legal.groupBy("block", F.size("moves").alias("transfers")).agg(F.count(F.lit(1)).alias("sets"), F.max(F.round("gain", 9)).alias("best"), F.max("bank").alias("most_left"))


# ------------------------------------------------------- populations and what is shown

#: Current players from ``part``: kind of entity and flags, some of them unknown.
_CURRENT = {"player_uid": "p_partkey", "entity_type": "CASE WHEN p_size % 9 = 0 THEN 'manager' WHEN p_size % 31 = 0 THEN NULL ELSE 'player' END", "can_select": "CASE p_partkey % 7 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END", "removed": "CASE p_partkey % 11 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END"}


@query("SELECT player_uid, CASE WHEN coalesce(removed, false) THEN 'official_removed_true' WHEN NOT coalesce(can_select, true) THEN 'official_can_select_false' WHEN entity_type IS NULL OR entity_type <> 'player' THEN 'non_player_entity' END AS exclusion_reason FROM (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _CURRENT.items()) + " FROM part)")
def exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every current player with the reason, if any, for which the player can't be selected."""
    df = table(spark, sf_dir, "part").selectExpr(*[f"{v} AS {k}" for k, v in _CURRENT.items()])
    return df.select("player_uid", quality.exclusion_reason(df).alias("exclusion_reason"))


#: Projection rows as text, with values that are missing, out of bounds or no numbers. One text for Spark and DuckDB.
_PROJECTED = {
    "player_uid": "CASE WHEN p_partkey % 41 = 0 THEN '  ' ELSE CAST(p_partkey AS {t}) END", "player": "p_name", "team": "CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE p_brand END",
    "position": "CASE p_partkey % 5 WHEN 0 THEN 'GKP' WHEN 1 THEN 'DEF' WHEN 2 THEN 'MID' WHEN 3 THEN 'FWD' ELSE 'AM' END",
    "price_tenths": "CASE WHEN p_partkey % 13 = 0 THEN '45.5' WHEN p_partkey % 17 = 0 THEN 'n/a' ELSE CAST(40 + p_size AS {t}) END", "expected_points": "CASE WHEN p_partkey % 19 = 0 THEN '-0.5' WHEN p_partkey % 23 = 0 THEN 'NaN' ELSE CAST(p_size / 8.0 AS {t}) END",
    "expected_minutes": "CASE WHEN p_partkey % 29 = 0 THEN '95' ELSE CAST(p_size AS {t}) END", "p_appearance": "CASE WHEN p_partkey % 31 = 0 THEN 'Infinity' ELSE '0.75' END", "p_start": "CASE WHEN p_partkey % 7 = 0 THEN '0.8' ELSE '0.5' END", "prob_points_ge_5": "'0.25'",
}
_IN = "TRY_CAST({0} AS DOUBLE) IS NOT NULL AND NOT isnan(TRY_CAST({0} AS DOUBLE)) AND TRY_CAST({0} AS DOUBLE) BETWEEN {1} AND {2}".format


@query(
    "SELECT p_partkey, coalesce(trim(coalesce(player_uid, '')) <> '' AND trim(coalesce(player, '')) <> '' AND trim(coalesce(team, '')) <> '' AND position IN ('GKP', 'DEF', 'MID', 'FWD') AND "
    + " AND ".join([_IN("price_tenths", 0.5, 1e300), "TRY_CAST(price_tenths AS DOUBLE) = floor(TRY_CAST(price_tenths AS DOUBLE))", _IN("expected_points", 0, 1e300), _IN("expected_minutes", 0, 90), _IN("p_appearance", 0, 1), _IN("prob_points_ge_5", 0, 1), _IN("p_start", 0, 1e300), "TRY_CAST(p_start AS DOUBLE) <= TRY_CAST(p_appearance AS DOUBLE)"])
    + ", false) AS valid FROM (SELECT p_partkey, " + ", ".join(f"{v.format(t='VARCHAR')} AS {k}" for k, v in _PROJECTED.items()) + " FROM part)"
)
def valid_forecast_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which projection rows may be shown."""
    df = table(spark, sf_dir, "part").selectExpr("p_partkey", *[f"{v.format(t='STRING')} AS {k}" for k, v in _PROJECTED.items()])
    return df.select("p_partkey", quality.valid_forecast().alias("valid"))


@query(POOL_SQL + " SELECT player_uid, (rank() OVER w + (count(*) OVER (PARTITION BY block, position, p_appearance) - 1) / 2.0) / count(*) OVER (PARTITION BY block, position) AS share FROM pool WINDOW w AS (PARTITION BY block, position ORDER BY p_appearance)", ["share"])
def percent_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The average rank of each player's chance to play within block and position, over their number."""
    return metrics.with_percent_rank(pool(spark, sf_dir), ["block", "position"], "p_appearance", "share").select("player_uid", "share")


_POPULATIONS = ["history_active", "cold_start"]


@query(FEATURES_SQL + ", seen AS (SELECT season, CASE WHEN player_source_time IS NOT NULL THEN 'history_active' WHEN prior_season_minutes IS NULL THEN 'cold_start' ELSE 'other' END AS population FROM feature WHERE gameweek % 7 = 1), c AS (SELECT season, CAST(count(*) AS BIGINT) AS player_fixture_rows, CAST(count(DISTINCT player_uid) AS BIGINT) AS unique_players FROM panel GROUP BY 1), u AS (SELECT season, " + ", ".join(f"CAST(count(*) FILTER (population = '{p}') AS BIGINT) AS {p}_rows" for p in _POPULATIONS) + " FROM seen GROUP BY 1) SELECT c.*, " + ", ".join(f"coalesce({p}_rows, 0) AS {p}_rows" for p in _POPULATIONS) + " FROM c LEFT JOIN u USING (season)")
def coverage_with_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and players of each season beside the populations of its first blocks, 0 where a season has none."""
    rows = panel(spark, sf_dir)
    kind = F.when(F.col("player_source_time").isNotNull(), "history_active").when(F.col("prior_season_minutes").isNull(), "cold_start").otherwise("other")
    seen = features.player_features(rows).filter("gameweek % 7 = 1").select("season", kind.alias("population"))
    counts = rows.groupBy("season").agg(F.count(F.lit(1)).alias("player_fixture_rows"), F.countDistinct("player_uid").alias("unique_players"))
    found = relational.unstacked(seen, ["season"], "population", _POPULATIONS)
    return counts.join(relational.small(found), "season", "left").na.fill(0, [f"{p}_rows" for p in _POPULATIONS])


_SHEET_SQL = ", sheet AS (SELECT block, player_uid, CASE WHEN k = 1 THEN 'captain' WHEN k = 2 THEN 'vice_captain' WHEN k % 7 = 5 THEN 'squad' ELSE 'starter' END AS selected_role, CASE WHEN k > 11 THEN k - 11 WHEN k % 7 = 5 THEN NULL ELSE 0 END AS bench_order FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY expected_points DESC, player_uid) AS k FROM squad))"


@query(_OPTIONS_SQL + _SHEET_SQL + " SELECT block, player_uid, on_bench, CAST(row_number() OVER (PARTITION BY block ORDER BY on_bench, CASE WHEN on_bench THEN bench_order END NULLS FIRST, player_uid) AS INTEGER) AS shown_at, label FROM (SELECT *, coalesce(bench_order > 0, false) OR selected_role = 'squad' AS on_bench, CASE WHEN bench_order = 1 THEN 'Bench goalkeeper' WHEN bench_order > 1 THEN 'Bench ' || (bench_order - 1) WHEN selected_role = 'captain' THEN 'Captain' WHEN selected_role = 'vice_captain' THEN 'Vice captain' ELSE 'Starter' END AS label FROM sheet)")
def squad_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block's squad as it is shown: starters, then the bench in order, with labels."""
    from pyspark.sql import Window

    squad, _ = cheapest_squads(spark, sf_dir)
    k = F.row_number().over(Window.partitionBy("block").orderBy(F.desc("expected_points"), "player_uid"))
    role = F.when(F.col("k") == 1, "captain").when(F.col("k") == 2, "vice_captain").when(F.col("k") % 7 == 5, "squad").otherwise("starter")
    order = F.when(F.col("k") > 11, F.col("k") - 11).when(F.col("k") % 7 != 5, 0)
    rows = squad.withColumn("k", k).select("block", "player_uid", role.alias("selected_role"), order.alias("bench_order"))
    return decisions.squad_sheet(rows, ["block"]).select("block", "player_uid", "on_bench", "shown_at", "label")


# ------------------------------------------------------------------ exact line-ups


@query()
def lineup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eleven of each block's squad with the most expected points, and what it is worth with substitutions and captaincy."""
    squad, _ = cheapest_squads(spark, sf_dir)
    return lineups.expected_totals(lineups.nominal_lineups(squad, ["block"]), ["block"])


@query()
def exact_swap_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every affordable swap of each block's squad with its whole pool, valued exactly."""
    squad, df = cheapest_squads(spark, sf_dir)
    rows = written.once(lineups.nominal_lineups(squad, ["block"]), "lineups")
    return lineups.swap_gains(rows, df, ["block"], bank=20)
