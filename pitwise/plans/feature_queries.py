"""Queries on point-in-time features, folds and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwise.operators import pit

from . import baselines, features
from .league import FIXTURE_SQL, PANEL_SQL, fixtures, panel

QUERIES: dict = {}


def query(sql: str | None = None, doubles: tuple[str, ...] = ()):
    def add(f):
        QUERIES[f.__name__] = (f, sql, list(doubles))
        return f

    return add


_ROLL = ", ".join(f"CAST(sum({m}) OVER (PARTITION BY season, player_uid ORDER BY available_time, fixture_key ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS BIGINT) AS prev{n}_{m}_sum" for n in (3, 5) for m in features.MEASURES)
_TO_DATE = "CAST(sum(minutes) OVER w AS BIGINT) AS season_to_date_minutes, CAST(sum(CASE WHEN minutes > 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS season_to_date_appearances"
HISTORY_SQL = PANEL_SQL + f", history AS (SELECT season, player_uid, fixture_key, available_time, minutes AS prev_fixture_minutes, {_ROLL}, {_TO_DATE} FROM panel WINDOW w AS (PARTITION BY season, player_uid ORDER BY available_time, fixture_key ROWS UNBOUNDED PRECEDING))"
_SUMS = [f"prev{n}_{m}_sum" for n in (3, 5) for m in features.MEASURES] + ["season_to_date_minutes", "season_to_date_appearances"]
FEATURES_SQL = (
    HISTORY_SQL
    + ", seasons AS (SELECT season, lead(season) OVER (ORDER BY season) AS next FROM (SELECT DISTINCT season FROM panel)), prior AS (SELECT player_uid, next AS season, p.season AS prior_source_season, CAST(sum(minutes) AS BIGINT) AS prior_season_minutes, CAST(count(*) FILTER (minutes > 0) AS BIGINT) AS prior_season_appearances FROM panel p JOIN seasons USING (season) WHERE next IS NOT NULL GROUP BY ALL)"
    + f", feature AS (SELECT p.*, h.available_time AS player_source_time, h.prev_fixture_minutes, {', '.join(f'coalesce(h.{c}, 0) AS {c}' for c in _SUMS)}, prior_source_season, prior_season_minutes, prior_season_appearances FROM panel p ASOF LEFT JOIN history h ON p.season = h.season AND p.player_uid = h.player_uid AND p.information_cutoff > h.available_time LEFT JOIN prior ON prior.player_uid = p.player_uid AND prior.season = p.season)"
)
_KEYS = "season, player_uid, fixture_key"


@query(FEATURES_SQL + f" SELECT {_KEYS}, player_source_time, prev_fixture_minutes, {', '.join(_SUMS)} FROM feature")
def asof_strict_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.player_features(panel(spark, sf_dir))
    return df.select("season", "player_uid", "fixture_key", "player_source_time", "prev_fixture_minutes", *_SUMS)


@query(HISTORY_SQL + f" SELECT {_KEYS}, {', '.join(_SUMS[:10])} FROM history")
def rolling_3_5_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.player_history(panel(spark, sf_dir))
    return df.select("season", "player_uid", "fixture_key", *_SUMS[:10])


@query(HISTORY_SQL + f" SELECT {_KEYS}, season_to_date_minutes, season_to_date_appearances FROM history")
def expanding_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.player_history(panel(spark, sf_dir))
    return df.select("season", "player_uid", "fixture_key", "season_to_date_minutes", "season_to_date_appearances")


@query(PANEL_SQL + f" SELECT {_KEYS}, coalesce(sum(minutes) OVER (PARTITION BY season, player_uid ORDER BY kickoff_time, fixture_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS ran_before FROM panel")
def running_before_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.running_active(panel(spark, sf_dir)).select("season", "player_uid", "fixture_key", "ran_before")


_TEAM_SQL = FIXTURE_SQL + ", sides AS (SELECT season, fixture_key, available_time, home_team_uid AS team_uid, home_goals AS goals, away_goals AS other FROM fixture UNION ALL SELECT season, fixture_key, available_time, away_team_uid, away_goals, home_goals FROM fixture), form0 AS (SELECT season, team_uid, fixture_key, available_time, CAST(sum(goals) OVER w AS BIGINT) AS gf, CAST(sum(other) OVER w AS BIGINT) AS ga FROM sides WINDOW w AS (PARTITION BY season, team_uid ORDER BY available_time, fixture_key ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)), form AS (SELECT season, team_uid, available_time, arg_max(gf, fixture_key) AS gf, arg_max(ga, fixture_key) AS ga FROM form0 GROUP BY ALL)"


@query(_TEAM_SQL + " SELECT f.season, f.fixture_key, t.gf AS team_goals_for, t.available_time AS team_source_time, o.ga AS opponent_goals_against, o.available_time AS opponent_source_time FROM fixture f ASOF LEFT JOIN form t ON f.season = t.season AND f.home_team_uid = t.team_uid AND f.information_cutoff > t.available_time ASOF LEFT JOIN form o ON f.season = o.season AND f.away_team_uid = o.team_uid AND f.information_cutoff > o.available_time")
def asof_two_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixtures(spark, sf_dir)
    out = features.with_team_form(df, features.team_history(df), {"team": ("home_team_uid", ["goals_for"]), "opponent": ("away_team_uid", ["goals_against"])})
    return out.select("season", "fixture_key", "team_goals_for", "team_source_time", "opponent_goals_against", "opponent_source_time")


_LAGS = [f"lag{n}_{m}_mean" for n in (1, 3, 5, 10) for m in ("minutes", "starts")]
LAG_SQL = PANEL_SQL + ", hist AS (SELECT p.season, p.player_uid, p.fixture_key, h.minutes, h.starts, h.season AS hs, row_number() OVER (PARTITION BY p.fixture_key ORDER BY h.available_time DESC, h.kickoff_time DESC, h.fixture_key DESC) AS k FROM panel p LEFT JOIN panel h ON h.player_uid = p.player_uid AND h.available_time < p.information_cutoff)"


@query(LAG_SQL + f" SELECT {_KEYS}, " + ", ".join(f"coalesce(avg({m}) FILTER (k <= {n}), 0) AS lag{n}_{m}_mean" for n in (1, 3, 5, 10) for m in ("minutes", "starts")) + ", " + ", ".join(f"coalesce(sum({m}) FILTER (hs = season), 0) AS season_{m}_before" for m in ("minutes", "starts")) + " FROM hist GROUP BY ALL", [*_LAGS, "season_minutes_before", "season_starts_before"])
def lagged_rates_before_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pit.lagged_rates(panel(spark, sf_dir), "player_uid", "season", "information_cutoff", "available_time", ["kickoff_time", "fixture_key"], ["minutes", "starts"])
    return df.select("season", "player_uid", "fixture_key", *_LAGS, "season_minutes_before", "season_starts_before")


@query(FEATURES_SQL + f" SELECT {_KEYS}, prior_source_season, prior_season_minutes, prior_season_appearances FROM feature")
def prior_season_join_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.player_features(panel(spark, sf_dir))
    return df.select("season", "player_uid", "fixture_key", "prior_source_season", "prior_season_minutes", "prior_season_appearances")


@query(PANEL_SQL + ", t AS (SELECT player_uid, CAST(substr(season, 1, 4) AS BIGINT) AS y, sum(total_points) AS p FROM panel GROUP BY ALL) SELECT player_uid, (y + 1) || '-' || lpad(CAST((y + 2) % 100 AS VARCHAR), 2, '0') AS season, CAST(p AS BIGINT) AS before_points FROM t")
def prior_season_join_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baselines.previous_season_rates(panel(spark, sf_dir)).select("player_uid", "season", "before_points")


@query(PANEL_SQL + ", o AS (SELECT player_uid, season, max(team_uid) AS team_uid, max(position) AS position FROM panel GROUP BY ALL) SELECT player_uid, season, coalesce(lag(team_uid) OVER w <> team_uid, false) AS team_uid_changed, coalesce(lag(position) OVER w <> position, false) AS position_changed FROM o WINDOW w AS (PARTITION BY player_uid ORDER BY season)")
def season_lag_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.season_changes(panel(spark, sf_dir), "player_uid", "season", ["team_uid", "position"]).select("player_uid", "season", "team_uid_changed", "position_changed")


_FOLD = "season || '_gw' || lpad(CAST(gameweek AS VARCHAR), 2, '0') AS fold_id"


@query(PANEL_SQL + f" SELECT season, gameweek, min(information_cutoff) AS information_cutoff, CAST(count(*) AS BIGINT) AS test_rows, {_FOLD} FROM panel WHERE season IN ('2023-24', '2024-25') GROUP BY season, gameweek")
def folds_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.folds(panel(spark, sf_dir), "season", "gameweek", "information_cutoff", ["2023-24", "2024-25"])


@query(PANEL_SQL + f" SELECT season, gameweek, min(information_cutoff) AS information_cutoff, CAST(count(*) AS BIGINT) AS test_rows, {_FOLD} FROM panel p WHERE gameweek = (SELECT min(gameweek) FROM panel q WHERE q.season = p.season) GROUP BY season, gameweek")
def folds_first_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.folds(panel(spark, sf_dir), "season", "gameweek", "information_cutoff", first_block_only=True)


@query(PANEL_SQL + f", f AS (SELECT season, gameweek, {_FOLD}, min(information_cutoff) AS c FROM panel GROUP BY season, gameweek) SELECT f.fold_id, count(p.fixture_key) AS n, CAST(sum(p.total_points) AS BIGINT) AS points FROM f JOIN panel p ON p.available_time < f.c GROUP BY 1")
def fold_training_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel(spark, sf_dir)
    table = pit.folds(df, "season", "gameweek", "information_cutoff")
    return pit.training_totals(df, table, "available_time", "information_cutoff", {"n": F.lit(1), "points": F.col("total_points")}).filter("n is not null")


@query(PANEL_SQL + f", f AS (SELECT season, gameweek, {_FOLD}, min(information_cutoff) AS c FROM panel p WHERE gameweek = (SELECT min(gameweek) FROM panel q WHERE q.season = p.season) GROUP BY season, gameweek) SELECT f.fold_id, count(p.fixture_key) AS n FROM f JOIN panel p ON p.available_time < f.c AND p.season < f.season GROUP BY 1")
def fold_training_totals_by_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel(spark, sf_dir)
    table = pit.folds(df, "season", "gameweek", "information_cutoff", first_block_only=True)
    return pit.training_totals(df, table, "available_time", "information_cutoff", {"n": F.lit(1)}, season_before="season")


@query(FEATURES_SQL + ", a AS (SELECT count(*) FILTER (player_source_time >= information_cutoff) AS x, count(*) FILTER (available_time >= information_cutoff) AS y FROM feature), d AS (SELECT coalesce(sum(n - 1), 0) AS z FROM (SELECT count(*) AS n FROM feature GROUP BY season, player_uid)), u AS (SELECT unnest(['duplicate_keys', 'lineage_not_before_cutoff:player_source_time', 'lineage_not_before_cutoff:available_time']) AS check, unnest([CAST(z AS BIGINT), x, y]) AS rows FROM a, d) SELECT 'error' AS severity, * FROM u WHERE rows > 0")
def leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.player_features(panel(spark, sf_dir))
    known = {*_SUMS, "prev_fixture_minutes", "prior_season_minutes", "prior_season_appearances", "prior_source_season"}
    return pit.leakage_audit(df, ["season", "player_uid"], "information_cutoff", ["player_source_time", "available_time"], known)


@query(FEATURES_SQL + ", p AS (SELECT season, player_uid, prev5_minutes_sum > 0 OR season_to_date_appearances > 0 AS active, coalesce(prior_season_minutes, 0) <= 0 AND coalesce(prior_season_appearances, 0) <= 0 AND prev5_minutes_sum <= 0 AND season_to_date_appearances <= 0 AS cold FROM feature) SELECT season, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (active) AS BIGINT) AS active_rows, CAST(count(*) FILTER (cold) AS BIGINT) AS cold_rows, count(*) FILTER (active) / count(*) AS active_share FROM p GROUP BY 1", ["active_share"])
def population_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.player_features(panel(spark, sf_dir)).select("season", features.history_active().alias("active"), features.cold_start().alias("cold"))
    return df.groupBy("season").agg(F.count(F.lit(1)).alias("rows"), F.count_if("active").alias("active_rows"), F.count_if("cold").alias("cold_rows"), F.avg(F.col("active").cast("double")).alias("active_share"))


_CALENDAR = ", b6 AS (SELECT player_uid, (CAST(substr(season, 1, 4) AS BIGINT) + 1) || '-' || lpad(CAST((CAST(substr(season, 1, 4) AS BIGINT) + 2) % 100 AS VARCHAR), 2, '0') AS season, sum(total_points) AS bp, sum(minutes) AS bm, count(*) FILTER (minutes > 0) AS ba FROM panel GROUP BY ALL)"
PREDICTIONS_SQL = (
    FEATURES_SQL
    + _CALENDAR
    + f", f AS (SELECT season, gameweek, {_FOLD}, min(information_cutoff) AS c FROM panel GROUP BY season, gameweek)"
    + ", g AS (SELECT f.fold_id, avg(total_points) AS mean, CASE WHEN sum(minutes) > 0 THEN sum(total_points) * 90.0 / sum(minutes) ELSE avg(total_points) END AS per90 FROM f JOIN panel p ON p.available_time < f.c GROUP BY 1)"
    + ", pos AS (SELECT f.fold_id, position, avg(total_points) AS pm, CASE WHEN sum(minutes) > 0 THEN sum(total_points) * 90.0 / sum(minutes) END AS pr FROM f JOIN panel p ON p.available_time < f.c GROUP BY 1, 2)"
    + ", j AS (SELECT x.*, f.fold_id, g.mean, g.per90, coalesce(pm, g.mean) AS pm, coalesce(pr, g.mean) AS pr, bp, bm, ba FROM feature x JOIN f USING (season, gameweek) JOIN g ON g.fold_id = f.fold_id LEFT JOIN pos ON pos.fold_id = f.fold_id AND pos.position = x.position LEFT JOIN b6 ON b6.player_uid = x.player_uid AND b6.season = x.season)"
    + ", wide AS (SELECT fold_id, player_uid, fixture_key, season, gameweek, position, total_points, CAST(0 AS DOUBLE) AS \"B0_ZERO\", mean AS \"B1_GLOBAL_MEAN\", pm AS \"B2_POSITION_MEAN\""
    + "".join(f", CASE WHEN season_to_date_appearances > 0 THEN prev{n}_total_points_sum / least(season_to_date_appearances, {n}) ELSE mean END AS \"B3_RECENT_POINTS_P{n}\", least(prev{n}_minutes_sum / {n}.0, 90.0) / 90.0 * pr AS \"B4_RECENT_MINUTES_P{n}\"" for n in (3, 5))
    + ", least(prev5_minutes_sum / 5.0, 90.0) / 90.0 * (prev5_total_points_sum * 90.0 + per90 * 450.0) / (prev5_minutes_sum + 450.0) AS \"B5_EB_POINTS_PER90\", CASE WHEN bm > 0 AND ba > 0 THEN least(bm / greatest(ba, 1), 90.0) / 90.0 * (bp * 90.0 + per90 * 450.0) / (bm + 450.0) ELSE mean END AS \"B6_PREVIOUS_SEASON_GW1\" FROM j)"
    + ", pred AS (UNPIVOT (SELECT fold_id, player_uid, fixture_key, season, gameweek, position, total_points, " + ", ".join(f'CAST("{n}" AS DOUBLE) AS "{n}"' for n in baselines.NAMES) + " FROM wide) ON " + ", ".join(f'"{n}"' for n in baselines.NAMES) + " INTO NAME baseline VALUE prediction)"
)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel(spark, sf_dir)
    return baselines.predict(features.player_features(df), df, pit.folds(df, "season", "gameweek", "information_cutoff"))


@query(PREDICTIONS_SQL + " SELECT * FROM pred", ["prediction"])
def baselines_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir)


@query(PREDICTIONS_SQL + " SELECT fixture_key, prediction FROM pred WHERE baseline = 'B5_EB_POINTS_PER90'", ["prediction"])
def baseline_eb_shrinkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).filter("baseline = 'B5_EB_POINTS_PER90'").select("fixture_key", "prediction")


@query(PREDICTIONS_SQL + " SELECT fixture_key, prediction FROM pred WHERE baseline = 'B6_PREVIOUS_SEASON_GW1'", ["prediction"])
def baseline_previous_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).filter("baseline = 'B6_PREVIOUS_SEASON_GW1'").select("fixture_key", "prediction")


_RANKED = ", r AS (SELECT *, rank() OVER (PARTITION BY baseline ORDER BY prediction) + (count(*) OVER (PARTITION BY baseline, prediction) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY baseline ORDER BY total_points) + (count(*) OVER (PARTITION BY baseline, total_points) - 1) / 2.0 AS ra FROM (SELECT * REPLACE (round(prediction, 9) AS prediction) FROM pred))"


@query(PREDICTIONS_SQL + _RANKED + " SELECT baseline, CAST(count(*) AS BIGINT) AS rows, avg(abs(prediction - total_points)) AS mae, sqrt(avg((prediction - total_points) ** 2)) AS rmse, avg(prediction - total_points) AS bias, median(abs(prediction - total_points)) AS median_ae, CASE WHEN var_pop(rp) > 0 AND var_pop(ra) > 0 THEN corr(rp, ra) END AS spearman FROM r GROUP BY 1", ["mae", "rmse", "bias", "median_ae", "spearman"])
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines of all folds, scored: errors and rank correlation by baseline."""
    return baselines.scores(predictions(spark, sf_dir).withColumn("prediction", F.round("prediction", 9)))
