"""The star-schema tables seen as a league: players' fixtures from ``events``, team fixtures from ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwise.operators import pit

#: Columns of the player-fixture fact, as SQL that Spark and DuckDB both read. ``d`` is the day, ``k`` the number in ``props``.
PARTS = {
    "d": "CAST(extract(day FROM ts) AS BIGINT)",
    "k": "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)",
}
FACT = {
    "season": "CAST(2020 + CAST(floor((d - 1) / 7.0) AS BIGINT) AS STRING) || '-' || lpad(CAST((2021 + CAST(floor((d - 1) / 7.0) AS BIGINT)) % 100 AS STRING), 2, '0')",
    "gameweek": "d",
    "player_uid": "user_id",
    "fixture_key": "event_id",
    "position": "CASE event_type WHEN 'error' THEN 'GKP' WHEN 'click' THEN 'DEF' WHEN 'view' THEN 'MID' WHEN 'signup' THEN 'FWD' ELSE 'AM' END",
    "kickoff_time": "ts",
    "available_time": "ts + INTERVAL 3 HOURS",
    "minutes": "CASE WHEN k < 20 THEN CAST(0 AS BIGINT) WHEN k > 90 THEN CAST(90 AS BIGINT) ELSE k END",
    "starts": "CASE WHEN k >= 55 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END",
    "total_points": "CASE WHEN k < 20 THEN CAST(0 AS BIGINT) ELSE CAST(floor(value) AS BIGINT) % 14 END",
    "goals_scored": "CASE WHEN k >= 20 AND event_id % 9 = 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END",
    "assists": "CASE WHEN k >= 20 AND event_id % 7 = 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END",
    "clean_sheets": "CASE WHEN event_id % 4 = 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END",
    "goals_conceded": "event_id % 5",
    "saves": "event_id % 8",
    "penalties_saved": "CASE WHEN event_id % 97 = 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END",
    "penalties_missed": "CASE WHEN event_id % 89 = 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END",
    "yellow_cards": "CASE WHEN event_id % 11 = 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END",
    "red_cards": "CASE WHEN event_id % 101 = 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END",
    "own_goals": "CASE WHEN event_id % 103 = 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END",
    "bonus": "event_id % 4",
    "bps": "event_id % 41",
    "defensive_contribution": "event_id % 17",
    "team_uid": "user_id % 20",
    "opponent_uid": "(user_id + 1 + event_id % 19) % 20",
    "was_home": "event_id % 2 = 0",
}
FIXTURE = {
    "fixture_key": "o_orderkey",
    "season": "CAST(extract(year FROM o_orderdate) AS STRING) || '-' || lpad(CAST((CAST(extract(year FROM o_orderdate) AS BIGINT) + 1) % 100 AS STRING), 2, '0')",
    "gameweek": "CAST(extract(month FROM o_orderdate) AS BIGINT)",
    "home_team_uid": "o_custkey % 20",
    "away_team_uid": "(o_custkey + 1 + o_orderkey % 19) % 20",
    "kickoff_time": "o_orderdate",
    "available_time": "o_orderdate + INTERVAL 3 HOURS",
    "home_goals": "CAST(floor(o_totalprice) AS BIGINT) % 4",
    "away_goals": "CAST(floor(o_totalprice) AS BIGINT) % 3",
}


def _select(columns: dict[str, str]) -> list[str]:
    return [f"{sql} AS {name}" for name, sql in columns.items()]


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player fixtures, with the managers (position AM)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.selectExpr("*", *_select(PARTS)).selectExpr(*_select(FACT))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player fixtures without managers, with the cutoff of their block (season, gameweek)."""
    return pit.with_cutoff(facts(spark, sf_dir).filter("position <> 'AM'"), ["season", "gameweek"])


def fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Team fixtures with the cutoff of their block."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return pit.with_cutoff(orders.selectExpr(*_select(FIXTURE)), ["season", "gameweek"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BASE = f"base AS (SELECT *, {', '.join(_select(PARTS))} FROM events)"
#: Common table expressions of the DuckDB counterparts.
FACT_SQL = f"WITH {_BASE}, fact AS (SELECT {', '.join(_select(FACT))} FROM base)"
PANEL_SQL = FACT_SQL + ", panel AS (SELECT *, min(kickoff_time) OVER (PARTITION BY season, gameweek) AS information_cutoff FROM fact WHERE position <> 'AM')"
FIXTURE_SQL = f"WITH fixture0 AS (SELECT {', '.join(_select(FIXTURE))} FROM orders), fixture AS (SELECT *, min(kickoff_time) OVER (PARTITION BY season, gameweek) AS information_cutoff FROM fixture0)"


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show."""
    return df.withColumns({n: F.round(n, places) + F.lit(0.0) for n, t in df.dtypes if t in ("double", "float")})
