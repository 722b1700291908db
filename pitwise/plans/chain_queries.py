"""Queries on the whole chain: coming rows, every model, projections, gates, evaluation, decision, states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwise.functions import states
from pitwise.operators import quality, relational

from . import chain, features
from .decision_queries import POOL_SQL, pool
from .feature_queries import _SUMS, FEATURES_SQL, PREDICTIONS_SQL, predictions
from .league import FIXTURE_SQL, fixtures, panel, table
from .model_queries import _EXPECTED_SQL, _HIER_SQL, _PARTS_SQL, components, minutes_frame

QUERIES: dict = {}


def query(sql: str | None = None, doubles: tuple[str, ...] = ()):
    def add(f):
        QUERIES[f.__name__] = (f, sql, list(doubles))
        return f

    return add


_COMING = ["season", "gameweek", "player_uid", "fixture_key", "position", "information_cutoff", "player_source_time", "prev_fixture_minutes", *_SUMS, "prior_season_minutes", "prior_season_appearances"]


@query(FEATURES_SQL + f" SELECT {', '.join(_COMING)} FROM feature WHERE (season, gameweek) = (SELECT (season, gameweek) FROM panel ORDER BY season DESC, gameweek DESC LIMIT 1)")
def coming_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows of the last block, made without its outcomes."""
    df = panel(spark, sf_dir)
    return chain.coming_rows(df, chain.last_block(df)).select(*_COMING)


# ---------------------------------------------------------------- models

_BY = "(PARTITION BY season, gameweek, team_uid, variant)"
_E90 = components.EVENTS
_CHAIN_PARTS = {**_PARTS_SQL, "expected_points_appearance": "p + r", "expected_points_goals_conceded": _PARTS_SQL["expected_points_goals_conceded"].replace("* p ELSE", "* r ELSE")}
#: The reference, the independent and the constrained models with minutes M3 and M7; p, s, r: chances to play, start, reach 60 minutes.
_MODELS_SQL = (
    _EXPECTED_SQL.partition(", e1 AS")[0]
    + ", mv AS (SELECT 'M3' AS variant, fixture_key, em / 90.0 AS p, em / 90.0 AS s, em / 90.0 AS r, em FROM hm UNION ALL SELECT 'M7', fixture_key, p_appearance, p_start, p_reached_60, expected_minutes FROM (" + _HIER_SQL + "))"
    + ", v1 AS (SELECT t.season, t.gameweek, t.team_uid, t.player_uid, t.fixture_key, t.position, variant, p, s, r, em, em / 90.0 AS x, ar, cold, 1.0 + t.team_uid % 4 / 4.0 AS te, 0.8 + t.opponent_uid % 5 / 5.0 AS oe, "
    + ", ".join(f"CASE WHEN cold THEN coalesce(g_{e}, 0) ELSE greatest(coalesce(r_{e}, g_{e}, 0), 0) END AS x_{e}" for e in _E90)
    + " FROM test t JOIN mv USING (fixture_key) LEFT JOIN cq USING (player_uid) LEFT JOIN cr ON cr.position = t.position CROSS JOIN ca)"
    + ", v2 AS (SELECT *, greatest(x, p * CASE WHEN cold THEN 0.35 ELSE 0.10 END) AS aw, CASE position WHEN 'GKP' THEN 0.001 WHEN 'DEF' THEN 0.02 WHEN 'MID' THEN 0.08 ELSE 0.14 END AS gp, CASE position WHEN 'GKP' THEN 0.001 WHEN 'DEF' THEN 0.025 WHEN 'MID' THEN 0.08 ELSE 0.06 END AS ap FROM v1)"
    + ", v3 AS (SELECT *, CASE WHEN x_goals_scored * aw > 0 THEN x_goals_scored * aw ELSE gp * aw END AS gw0, CASE WHEN x_assists * aw > 0 THEN x_assists * aw ELSE ap * aw END AS aw0 FROM v2)"
    + f", v4 AS (SELECT *, CASE WHEN sum(gw0) OVER {_BY} > 0 THEN gw0 ELSE gp END AS gw, CASE WHEN sum(aw0) OVER {_BY} > 0 THEN aw0 ELSE ap END AS asw FROM v3)"
    + f", v5 AS (SELECT *, gw / sum(gw) OVER {_BY} AS gs, asw / sum(asw) OVER {_BY} AS ash FROM v4)"
    + f", v6 AS (SELECT *, '{chain.CONSTRAINED}' || variant AS model, te * gs AS expected_goals, te * ar * ash AS expected_assists FROM v5 UNION ALL SELECT *, '{chain.INDEPENDENT}', x_goals_scored * x, x_assists * x FROM v5 WHERE variant = 'M3')"
    + ", v7 AS (SELECT *, exp(-oe) * r AS sheet, CASE WHEN position = 'GKP' THEN x_saves * x ELSE 0 END AS xs, CASE WHEN position = 'GKP' THEN least(greatest(x_penalties_saved * x, 0), 0.15) ELSE 0 END AS xps, "
    + ", ".join(f"least(greatest(x_{e} * x, 0), {components.CAPS[e]}) AS c_{e}" for e in ("penalties_missed", "yellow_cards", "red_cards", "own_goals", "bonus"))
    + ", x_defensive_contribution * x AS xd FROM v6)"
    + ", x0 AS (" + PREDICTIONS_SQL + " SELECT fixture_key, prediction FROM pred WHERE baseline = 'B5_EB_POINTS_PER90')"
    + ", models AS (SELECT model, season, gameweek, player_uid, fixture_key, p AS p_appearance, s AS p_start, em AS expected_minutes, expected_goals, expected_assists, " + " + ".join(f"({v})" for v in _CHAIN_PARTS.values()) + " AS expected_points FROM v7"
    + f" UNION ALL SELECT '{chain.REFERENCE}', season, gameweek, player_uid, fixture_key, NULL, NULL, NULL, 0, 0, coalesce(prediction, 0) FROM test LEFT JOIN x0 USING (fixture_key))"
)
_MODEL_DOUBLES = ["p_appearance", "p_start", "expected_minutes", "expected_goals", "expected_assists", "expected_points"]
_MODEL_COLUMNS = ["model", "season", "gameweek", "player_uid", "fixture_key", *_MODEL_DOUBLES]


def models(spark: SparkSession, sf_dir: str, variants: list[str]) -> DataFrame:
    """Every model's rows of the last season, forecast without its outcomes from what came before it."""
    df = minutes_frame(spark, sf_dir)
    train, test = df.filter("season < '2024-25'"), quality.without_targets(df.filter("season = '2024-25'"), chain.OUTCOMES)
    test = test.withColumns({"team_expected_goals": 1.0 + F.col("team_uid") % 4 / 4.0, "opponent_expected_goals": 0.8 + F.col("opponent_uid") % 5 / 5.0})
    reference = predictions(spark, sf_dir).filter("baseline = 'B5_EB_POINTS_PER90' AND season = '2024-25'")
    return chain.model_rows(train, test, reference, variants)


@query(_MODELS_SQL + f" SELECT {', '.join(_MODEL_COLUMNS)} FROM models", _MODEL_DOUBLES)
def xpoints_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference, independent and constrained models whose minutes have a closed form."""
    return models(spark, sf_dir, ["M3", "M7"]).select(*_MODEL_COLUMNS)


@query()
def xpoints_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five models, the one on fitted minutes (M5) included."""
    return models(spark, sf_dir, ["M3", "M5", "M7"]).select(*_MODEL_COLUMNS)


_PROJECTED = (
    ", projected AS (SELECT model, season, gameweek, player_uid, count(*) AS fixture_count, avg(expected_minutes) AS expected_minutes, 1 - product(1 - coalesce(p_appearance, 0)) AS p_appearance, 1 - product(1 - coalesce(p_start, 0)) AS p_start, sum(expected_points) AS expected_points FROM models GROUP BY ALL)"
    ", projection AS (SELECT *, CASE WHEN p_appearance > 0 THEN expected_points / p_appearance ELSE 0 END AS expected_points_given_appearance FROM projected)"
)
_PROJECTION_DOUBLES = ["expected_minutes", "p_appearance", "p_start", "expected_points", "expected_points_given_appearance"]


@query(_MODELS_SQL + _PROJECTED + " SELECT * FROM projection", _PROJECTION_DOUBLES)
def block_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models' rows added up by player and block."""
    return chain.block_projections(models(spark, sf_dir, ["M3", "M7"]))


def projected_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every player of the pool with the last block's constrained forecast; zeros for those without a fixture."""
    rows = models(spark, sf_dir, ["M3"]).filter(F.col("model") == chain.CONSTRAINED + "M3")
    last = relational.small(chain.last_block(panel(spark, sf_dir)))
    made = chain.block_projections(rows.join(last, ["season", "gameweek"]))
    return chain.with_blanks(made, pool(spark, sf_dir).drop("expected_points", "p_appearance").crossJoin(last), ["season", "gameweek", "player_uid"])


_POOL_COLUMNS = ["season", "gameweek", "player_uid", "club", "position", "price_tenths", "fixture_count", *_PROJECTION_DOUBLES]
_PROJECTED_POOL = (
    _MODELS_SQL + _PROJECTED
    + ", pool AS (" + POOL_SQL + " SELECT * FROM pool), z AS (SELECT season, gameweek FROM panel ORDER BY season DESC, gameweek DESC LIMIT 1)"
    + ", pp AS (SELECT z.season, z.gameweek, o.player_uid, club, position, price_tenths, coalesce(fixture_count, 0) AS fixture_count, " + ", ".join(f"coalesce(q.{c}, 0) AS {c}" for c in _PROJECTION_DOUBLES)
    + f" FROM pool o CROSS JOIN z LEFT JOIN projection q ON q.player_uid = o.player_uid AND q.season = z.season AND q.gameweek = z.gameweek AND q.model = '{chain.CONSTRAINED}M3')"
)


@query(_PROJECTED_POOL + f" SELECT {', '.join(_POOL_COLUMNS)} FROM pp", _PROJECTION_DOUBLES)
def candidate_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of the coming block: features, minutes, rates, expectations, sums and blanks in one plan."""
    return projected_pool(spark, sf_dir).select(*_POOL_COLUMNS)


_GATE = "SELECT '{n}' AS gate, (SELECT count(*) FROM k WHERE NOT coalesce({c}, FALSE)) = 0 AS passed"


@query(
    _PROJECTED_POOL
    + ", k AS (SELECT season, gameweek, player_uid, count(*) AS n, min(price_tenths) AS price, " + ", ".join(f"min({c}) AS {c}" for c in _PROJECTION_DOUBLES) + " FROM (SELECT * REPLACE (CASE WHEN player_uid % 97 = 0 THEN NULL ELSE price_tenths END AS price_tenths) FROM pp) GROUP BY ALL)"
    + " SELECT 'projections_present' AS gate, (SELECT count(*) FROM k) > 0 AS passed UNION ALL "
    + " UNION ALL ".join(_GATE.format(n=n, c=c) for n, c in {
        "projection_keys_unique": "n = 1", "identity_coverage": "player_uid IS NOT NULL", "official_prices_present": "price IS NOT NULL", "expected_minutes_valid": "expected_minutes BETWEEN 0 AND 90",
        "p_appearance_valid": "p_appearance BETWEEN 0 AND 1", "p_start_valid": "p_start BETWEEN 0 AND 1", "appearance_at_least_start": "p_appearance >= p_start", "nonnegative_xpoints": "expected_points >= 0", "conditional_xpoints_finite": "isfinite(expected_points_given_appearance)",
    }.items())
)
def publication_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named gates of the candidates' projections; some prices are taken away, so one gate does not pass."""
    gone = F.when(F.col("player_uid") % 97 != 0, F.col("price_tenths"))
    return chain.publication_gates(projected_pool(spark, sf_dir).withColumn("price_tenths", gone))


@query(
    _MODELS_SQL
    + f", f AS (SELECT m.*, minutes, starts, total_points FROM models m JOIN panel USING (fixture_key) WHERE model = '{chain.CONSTRAINED}M3')"
    + "".join(
        f"{sep} SELECT '{part}' AS part, unnest(['rows', 'mae', 'rmse', 'bias']) AS metric, unnest([CAST(count(*) AS DOUBLE), avg(abs({p} - {y})), sqrt(avg(({p} - {y}) ** 2)), avg({p} - {y})]) AS value FROM f"
        for sep, part, p, y in (("", "minutes", "expected_minutes", "minutes"), (" UNION ALL", "xpoints", "expected_points", "total_points"))
    )
    + " UNION ALL SELECT 'minutes', 'appearance_brier', avg((p_appearance - CASE WHEN minutes > 0 THEN 1 ELSE 0 END) ** 2) FROM f UNION ALL SELECT 'minutes', 'start_brier', avg((p_start - CASE WHEN starts > 0 THEN 1 ELSE 0 END) ** 2) FROM f UNION ALL SELECT 'xpoints', 'negative_expected_points', count(*) FILTER (expected_points < 0) FROM f",
    ["value"],
)
def frozen_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of the last season from the seasons before it, scored once its outcomes are in."""
    rows = models(spark, sf_dir, ["M3"]).filter(F.col("model") == chain.CONSTRAINED + "M3")
    return chain.frozen_scores(rows, panel(spark, sf_dir))


@query()
def chain_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the tables to the squad of the coming block."""
    return chain.decided(projected_pool(spark, sf_dir).drop("player_name", "block"), ["season", "gameweek"])


# ---------------------------------------------------------------- contracts


@query(FEATURES_SQL + " SELECT season, count(*) AS rows, count(*) FILTER (prior_season_minutes IS NULL) AS prior_season_minutes_missing, count(*) FILTER (prev_fixture_minutes IS NULL) AS prev_fixture_minutes_missing FROM feature GROUP BY 1")
def missing_by_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.missing_by(features.player_features(panel(spark, sf_dir)), ["season"], ["prior_season_minutes", "prev_fixture_minutes"])


_FAULTY = {"minutes": "CASE WHEN fixture_key % 60 = 0 THEN 130 WHEN fixture_key % 70 = 0 THEN 0 WHEN fixture_key % 85 = 0 THEN NULL ELSE minutes END", "starts": "CASE WHEN fixture_key % 80 = 0 THEN 2 ELSE starts END", "player_source_time": "CASE WHEN fixture_key % 90 = 0 THEN information_cutoff ELSE player_source_time END", "fixture_key": "fixture_key - CASE WHEN fixture_key % 100 = 0 THEN 1 ELSE 0 END", "player_uid": "0 * player_uid"}


@query(
    FEATURES_SQL + ", x AS (SELECT season, information_cutoff, " + ", ".join(f"{v} AS {k}" for k, v in _FAULTY.items()) + " FROM feature)"
    + " SELECT 'minutes' AS rule, count(*) FILTER (minutes IS NULL OR NOT minutes BETWEEN 0 AND 120) AS rows FROM x UNION ALL SELECT 'start_label', count(*) FILTER (starts NOT IN (0, 1)) FROM x UNION ALL SELECT 'start_without_minutes', count(*) FILTER (starts = 1 AND minutes <= 0) FROM x UNION ALL SELECT 'history_after_cutoff', count(*) FILTER (player_source_time >= information_cutoff) FROM x UNION ALL SELECT 'duplicate_key', CAST((SELECT count(*) FROM x) - (SELECT count(*) FROM (SELECT DISTINCT season, player_uid, fixture_key FROM x)) AS BIGINT)"
)
def minutes_frame_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults put into the frame of minutes, counted by rule."""
    df = features.player_features(panel(spark, sf_dir)).selectExpr("season", "information_cutoff", *[f"{v} AS {k}" for k, v in _FAULTY.items()])
    return quality.minutes_faults(df, ["season", "player_uid", "fixture_key"])


_BAD = {"away_team_uid": "CASE WHEN fixture_key % 90 = 0 THEN home_team_uid ELSE away_team_uid END", "kickoff_time": "CASE WHEN fixture_key % 130 = 0 THEN NULL ELSE kickoff_time END", "home_goals": "CASE WHEN fixture_key % 110 = 0 THEN -1.0 WHEN fixture_key % 115 = 0 THEN 1.5 ELSE CAST(home_goals AS DOUBLE) END", "away_goals": "CASE WHEN fixture_key % 120 = 0 THEN NULL ELSE away_goals END", "fixture_key": "fixture_key - CASE WHEN fixture_key % 200 = 0 THEN 1 ELSE 0 END"}


@query(
    FIXTURE_SQL + ", x AS (SELECT season, home_team_uid, information_cutoff, available_time, " + ", ".join(f"{v} AS {k}" for k, v in _BAD.items()) + " FROM fixture)"
    + " SELECT 'same_team' AS rule, count(*) FILTER (home_team_uid = away_team_uid) AS rows FROM x"
    + "".join(f" UNION ALL SELECT 'missing:{t}', count(*) FILTER ({t} IS NULL) FROM x" for t in ("kickoff_time", "information_cutoff", "available_time"))
    + "".join(f" UNION ALL SELECT 'count:{g}', count(*) FILTER ({g} IS NULL OR {g} < 0 OR {g} % 1 <> 0) FROM x" for g in ("home_goals", "away_goals"))
    + " UNION ALL SELECT 'duplicate_key', CAST((SELECT count(*) FROM x) - (SELECT count(*) FROM (SELECT DISTINCT season, fixture_key FROM x)) AS BIGINT)"
)
def fixture_table_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults put into the table of team fixtures, counted by rule."""
    df = fixtures(spark, sf_dir).selectExpr("season", "home_team_uid", "information_cutoff", "available_time", *[f"{v} AS {k}" for k, v in _BAD.items()])
    return quality.fixture_faults(df, ["season", "fixture_key"], ["kickoff_time", "information_cutoff", "available_time"], ["home_goals", "away_goals"])


_CHECKS = [f"event_id % {k} <> 0" for k in (7, 11, 13, 17, 19)]
_OUTCOME = "CASE event_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'done' WHEN 2 THEN 'failed' ELSE NULL END"
_HELD = ["WAITING_FOR_SEASON_LAUNCH", "NEEDS_RULE_REVIEW", "NEEDS_TEAM_IDENTITY_REVIEW", "NEEDS_PLAYER_IDENTITY_REVIEW", "NO_FORECASTABLE_GAMEWEEK"]


@query("SELECT event_id, CASE " + " ".join(f"WHEN NOT ({c}) THEN '{s}'" for c, s in zip(_CHECKS, _HELD, strict=True)) + f" ELSE CASE {_OUTCOME} WHEN 'running' THEN 'REFRESHING' WHEN 'done' THEN 'SUCCEEDED' WHEN 'failed' THEN 'FAILED_USING_LAST_SUCCESS' ELSE 'READY_TO_REFRESH' END END AS state FROM events")
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each run, from its checks and how it went."""
    return table(spark, sf_dir, "events").select("event_id", states.run_state(*[F.expr(c) for c in _CHECKS], F.expr(_OUTCOME)).alias("state"))
