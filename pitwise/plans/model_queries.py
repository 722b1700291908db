"""Queries on goal, minutes and component models, and on the simulation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitwise.functions import scoring
from pitwise.operators import pit

from . import components, features, minutes, simulation, team
from .feature_queries import FEATURES_SQL, LAG_SQL
from .league import FACT_SQL, FIXTURE_SQL, PANEL_SQL, facts, fixtures, panel

QUERIES: dict = {}


def query(sql: str | None = None, doubles: tuple[str, ...] = ()):
    def add(f):
        QUERIES[f.__name__] = (f, sql, list(doubles))
        return f

    return add


_FOLD = "season || '_gw' || lpad(CAST(gameweek AS VARCHAR), 2, '0') AS fold_id"
_FOLDS = f", f AS (SELECT {_FOLD}, min(information_cutoff) AS c FROM fixture GROUP BY season, gameweek)"


def _folds(df: DataFrame, seasons: list[str] | None = None) -> DataFrame:
    return pit.folds(df, "season", "gameweek", "information_cutoff", seasons)


@query(FIXTURE_SQL + _FOLDS + " SELECT f.fold_id, CAST(count(*) AS BIGINT) AS n, avg(home_goals) AS home_mean, avg(away_goals) AS away_mean FROM f JOIN fixture x ON x.available_time < f.c GROUP BY 1", ["home_mean", "away_mean"])
def team_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixtures(spark, sf_dir)
    return team.league_means(df, _folds(df)).withColumn("n", F.col("n").cast("long"))


_CUT = "2000-01-01 00:00:00"
_T1_SQL = FIXTURE_SQL + f", k AS (SELECT * FROM fixture WHERE available_time < TIMESTAMP '{_CUT}'), m AS (SELECT avg(home_goals) AS hm, avg(away_goals) AS am FROM k), s AS (SELECT home_team_uid AS team_uid, true AS h, home_goals AS g, away_goals AS o, available_time, fixture_key FROM k UNION ALL SELECT away_team_uid, false, away_goals, home_goals, available_time, fixture_key FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY team_uid, h ORDER BY available_time DESC, fixture_key DESC) AS i FROM s), t AS (SELECT team_uid, (coalesce(sum(g) FILTER (h), 0) + 6 * max(hm)) / (count(*) FILTER (h) + 6) AS home_attack, (coalesce(sum(g) FILTER (NOT h), 0) + 6 * max(am)) / (count(*) FILTER (NOT h) + 6) AS away_attack, (coalesce(sum(o) FILTER (h), 0) + 6 * max(am)) / (count(*) FILTER (h) + 6) AS home_concede, (coalesce(sum(o) FILTER (NOT h), 0) + 6 * max(hm)) / (count(*) FILTER (NOT h) + 6) AS away_concede, CAST(count(*) AS BIGINT) AS matches FROM r, m WHERE i <= 8 GROUP BY 1)"


def _t1(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    df = fixtures(spark, sf_dir)
    known = df.filter(F.col("available_time") < F.lit(_CUT).cast("timestamp_ntz"))
    means = known.agg(F.avg("home_goals").alias("home_mean"), F.avg("away_goals").alias("away_mean"))
    return df, team.recent_rates(df, means, _CUT), means


@query(_T1_SQL + " SELECT * FROM t", ["home_attack", "away_attack", "home_concede", "away_concede"])
def team_shrunk_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t1(spark, sf_dir)[1]


@query(_T1_SQL + f" SELECT x.fixture_key, (coalesce(h.home_attack, hm) + coalesce(a.away_concede, hm)) / 2 AS expected_home_goals, (coalesce(a.away_attack, am) + coalesce(h.home_concede, am)) / 2 AS expected_away_goals FROM fixture x CROSS JOIN m LEFT JOIN t h ON h.team_uid = x.home_team_uid LEFT JOIN t a ON a.team_uid = x.away_team_uid WHERE x.kickoff_time >= TIMESTAMP '{_CUT}'", ["expected_home_goals", "expected_away_goals"])
def team_rate_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, rates, means = _t1(spark, sf_dir)
    later = df.filter(F.col("kickoff_time") >= F.lit(_CUT).cast("timestamp_ntz"))
    return team.predict_from_rates(later, rates, means).select("fixture_key", "expected_home_goals", "expected_away_goals")


_W = "pow(2.0, (epoch_us(available_time) - 788918400000000) / 86400e6 / 365.0)"


@query(FIXTURE_SQL + _FOLDS + f" SELECT f.fold_id, sum({_W} * home_goals) / sum({_W}) AS home_mean, sum({_W} * away_goals) / sum({_W}) AS away_mean, sum({_W}) ** 2 / sum({_W} ** 2) AS effective_n FROM f JOIN fixture x ON x.available_time < f.c GROUP BY 1", ["home_mean", "away_mean", "effective_n"])
def recency_weighted_means_ess(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixtures(spark, sf_dir)
    return team.weighted_means(df, _folds(df))


@query(FIXTURE_SQL + ", x AS (SELECT * FROM fixture WHERE home_team_uid < 18 OR season >= '1997-98'), s AS (SELECT home_team_uid AS t, home_goals AS g, away_goals AS o, available_time, fixture_key FROM x UNION ALL SELECT away_team_uid, away_goals, home_goals, available_time, fixture_key FROM x), z AS (SELECT *, min(available_time) OVER (PARTITION BY t) AS seen, row_number() OVER (PARTITION BY t ORDER BY available_time, fixture_key) AS i FROM s), l AS (SELECT min(available_time) AS start, (sum(home_goals) + sum(away_goals)) / (2.0 * count(*)) AS g FROM x) SELECT CAST(count(*) AS BIGINT) AS matches, count(DISTINCT t) AS teams, coalesce(ln((sum(z.g) + 18 * max(l.g)) / (count(*) + 18) / max(l.g)), 0) AS attack_effect, coalesce(ln((sum(z.o) + 18 * max(l.g)) / (count(*) + 18) / max(l.g)), 0) AS defence_effect FROM z, l WHERE i <= 38 AND seen > l.start + INTERVAL 300 DAYS", ["attack_effect", "defence_effect"])
def promoted_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixtures(spark, sf_dir).filter("home_team_uid < 18 or season >= '1997-98'")
    return team.newcomer_prior(df)


@query(FIXTURE_SQL + _FOLDS + f" SELECT f.fold_id, home_team_uid, away_team_uid, sum({_W}) * pow(0.5, (epoch_us(max(f.c)) - 788918400000000) / 86400e6 / 365.0) AS w, sum({_W} * home_goals) * pow(0.5, (epoch_us(max(f.c)) - 788918400000000) / 86400e6 / 365.0) AS wh FROM f JOIN fixture x ON x.available_time < f.c GROUP BY ALL", ["w", "wh"])
def weighted_pair_counts_all_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that the goal models are fitted from, in every fold."""
    df = fixtures(spark, sf_dir)
    return team.pair_counts(df, _folds(df)).select("fold_id", "home_team_uid", "away_team_uid", "w", "wh")


@query()
def fit_ridge_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of each fold that has history: weighted ridge Poisson."""
    df = fixtures(spark, sf_dir)
    return team.fit_poisson(team.pair_counts(df, _folds(df)))


@query()
def fit_dixon_coles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with low-score dependence."""
    df = fixtures(spark, sf_dir)
    return team.fit_poisson(team.pair_counts(df, _folds(df)), low_scores=True)


@query()
def rating_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected goals of all fixtures from the ratings as of their block; a first block without history has none."""
    df = fixtures(spark, sf_dir)
    folds = _folds(df)
    targets = df.join(F.broadcast(folds.select("season", "gameweek", "fold_id")), ["season", "gameweek"])
    made = team.predict_from_ratings(targets, team.fit_poisson(team.pair_counts(df, folds)))
    return made.select("fold_id", "fixture_key", "expected_home_goals", "expected_away_goals", "home_unseen", "away_unseen")


# ------------------------------------------------------------------- minutes

_STATE = "CASE WHEN minutes <= 0 THEN 'DNP' WHEN starts = 0 AND minutes < 60 THEN 'SUB_UNDER_60' WHEN starts = 0 THEN 'SUB_60_PLUS' WHEN minutes < 60 THEN 'START_UNDER_60' WHEN minutes < 90 THEN 'START_60_TO_89' ELSE 'START_90' END"


def minutes_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with states, lagged rates before each cutoff and the season before."""
    df = panel(spark, sf_dir)
    df = df.withColumns({"state": scoring.duration_state(F.col("minutes"), F.col("starts")), "appearance": (F.col("minutes") > 0).cast("long")})
    lagged = pit.lagged_rates(df, "player_uid", "season", "information_cutoff", "available_time", ["kickoff_time", "fixture_key"], ["minutes", "appearance", "starts"])
    prior = pit.prior_season(df, "player_uid", "season", {"prior_season_minutes": F.sum("minutes"), "prior_season_appearances": F.sum("appearance"), "prior_season_starts": F.sum("starts")})
    out = lagged.join(prior, ["player_uid", "season"], "left")
    nothing = (F.coalesce("prior_season_appearances", F.lit(0)) <= 0) & (F.col("lag10_appearance_mean") <= 0)
    return out.withColumn("cold_start", nothing)


@query(PANEL_SQL + f" SELECT {_STATE} AS state, CAST(count(*) AS BIGINT) AS n FROM panel GROUP BY 1")
def role_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).groupBy(scoring.duration_state(F.col("minutes"), F.col("starts")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


_EWMA_SQL = ", lag AS (SELECT fixture_key, " + ", ".join(f"coalesce(avg(minutes) FILTER (k <= {n}), 0) AS l{n}" for n in (1, 3, 10)) + " FROM hist GROUP BY 1)"


@query(LAG_SQL + _EWMA_SQL + " SELECT fixture_key, least(greatest(0.45 * l1 + 0.55 * (0.65 * l3 + 0.35 * l10), 0), 90) AS expected_minutes FROM lag", ["expected_minutes"])
def minutes_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = minutes.two_state(minutes.ewma_minutes())
    return minutes_frame(spark, sf_dir).select("fixture_key", minutes.expected_minutes(states).alias("expected_minutes"))


@query(FEATURES_SQL + " SELECT fixture_key, CASE WHEN coalesce(prior_season_appearances, 0) > 0 THEN least(prior_season_minutes / prior_season_appearances, 90) * prior_season_appearances / (prior_season_appearances + 4.0) ELSE 0 END AS expected_minutes FROM feature", ["expected_minutes"])
def minutes_prior_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minutes_frame(spark, sf_dir).select("fixture_key", minutes.previous_role_minutes().alias("expected_minutes"))


def _split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train on what was known before the last season's first block; test the last season."""
    return df.filter("season < '2024-25'"), df.filter("season = '2024-25'")


_FRAME_SQL = (
    LAG_SQL
    + ", lag AS (SELECT fixture_key, " + ", ".join(f"coalesce(avg({m}) FILTER (k <= {n}), 0) AS lag{n}_{a}_mean" for n in (3, 5, 10) for m, a in (("minutes", "minutes"), ("starts", "starts"), ("CASE WHEN minutes > 0 THEN 1 ELSE 0 END", "appearance")))
    + ", coalesce(sum(CASE WHEN minutes > 0 THEN 1 ELSE 0 END) FILTER (hs = season), 0) AS season_appearance_before, coalesce(sum(starts) FILTER (hs = season), 0) AS season_starts_before FROM hist GROUP BY 1)"
    + ", seasons AS (SELECT season, lead(season) OVER (ORDER BY season) AS next FROM (SELECT DISTINCT season FROM panel))"
    + ", prior AS (SELECT player_uid, next AS season, CAST(sum(minutes) AS DOUBLE) AS pm, CAST(count(*) FILTER (minutes > 0) AS DOUBLE) AS pa, CAST(sum(starts) AS DOUBLE) AS ps FROM panel JOIN seasons USING (season) WHERE next IS NOT NULL GROUP BY ALL)"
    + f", frame AS (SELECT p.*, l.* EXCLUDE (fixture_key), coalesce(pm, 0) AS pm, coalesce(pa, 0) AS pa, coalesce(ps, 0) AS ps, {_STATE} AS state, coalesce(pa, 0) <= 0 AND lag10_appearance_mean <= 0 AS cold FROM panel p JOIN lag l USING (fixture_key) LEFT JOIN prior USING (player_uid, season))"
    + ", train AS (SELECT * FROM frame WHERE season < '2024-25'), test AS (SELECT * FROM frame WHERE season = '2024-25')"
)


def _shares(alias: str) -> str:
    """Shares of the states with one added to each count, as columns alias0 to alias5."""
    return ", ".join(f"(count(*) FILTER (state = '{s}') + 1.0) / (count(*) + 6.0) AS {alias}{i}" for i, s in enumerate(minutes.STATES))


def _summary(p: list[str]) -> str:
    return f"1 - {p[0]} AS p_appearance, {p[3]} + {p[4]} + {p[5]} AS p_start, {p[2]} + {p[4]} + {p[5]} AS p_reached_60, {p[5]} AS p_played_90, " + " + ".join(f"{m} * {x}" for m, x in zip(minutes.STATE_MINUTES, p, strict=True)) + " AS expected_minutes"


_OUT = ["p_appearance", "p_start", "p_reached_60", "p_played_90", "expected_minutes"]
_BUCKETS = {
    "rb": "CASE WHEN lag5_minutes_mean <= 0 THEN 'none' WHEN lag5_minutes_mean <= 30 THEN 'low' WHEN lag5_minutes_mean <= 60 THEN 'medium' WHEN lag5_minutes_mean <= 120 THEN 'high' END",
    "sb": "CASE WHEN lag5_starts_mean <= 0 THEN 'none' WHEN lag5_starts_mean <= 0.34 THEN 'low' WHEN lag5_starts_mean <= 0.67 THEN 'medium' WHEN lag5_starts_mean <= 1.0 THEN 'high' END",
    "hb": "CASE WHEN pa <= 0 THEN 'none' WHEN pa <= 5 THEN 'thin' WHEN pa <= 20 THEN 'regular' WHEN pa <= 100 THEN 'heavy' END",
}
_BUCKET_SQL = (
    _FRAME_SQL
    + f", o AS (SELECT {_shares('o')} FROM train), tr AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _BUCKETS.items())} FROM train), te AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _BUCKETS.items())} FROM test)"
    + "".join(
        f", n{j} AS (SELECT {keys}, count(*) AS n, {_shares('w')} FROM tr GROUP BY {keys} HAVING count(*) >= 18), l{j} AS (SELECT {keys}, "
        + ", ".join(f"n / (n + 4.0) * w{i} + (1 - n / (n + 4.0)) * o{i} AS x{j}{i}" for i in range(6))
        + f" FROM n{j}, o)"
        for j, keys in enumerate(("position, rb", "position, sb", "hb"))
    )
    + ", m AS (SELECT fixture_key, " + ", ".join(f"(o{i} + " + " + ".join(f"coalesce(x{j}{i}, 0)" for j in range(3)) + ") / (1 + " + " + ".join(f"CASE WHEN x{j}0 IS NULL THEN 0 ELSE 1 END" for j in range(3)) + f") AS p{i}" for i in range(6))
    + " FROM te CROSS JOIN o LEFT JOIN l0 USING (position, rb) LEFT JOIN l1 USING (position, sb) LEFT JOIN l2 USING (hb))"
    + " SELECT fixture_key, " + _summary([f"p{i}" for i in range(6)]) + " FROM m"
)
_HIER_SQL = (
    _FRAME_SQL
    + f", o AS (SELECT {_shares('o')} FROM train), pl AS (SELECT position, count(*) AS n, {_shares('w')}, avg(CASE WHEN minutes > 0 THEN 1.0 ELSE 0.0 END) AS ra0, avg(CASE WHEN starts > 0 THEN 1.0 ELSE 0.0 END) AS rs0 FROM train GROUP BY position)"
    + ", pr AS (SELECT position, ra0, rs0, " + ", ".join(f"n / (n + 4.0) * w{i} + (1 - n / (n + 4.0)) * o{i} AS q{i}" for i in range(6)) + " FROM pl, o)"
    + ", a1 AS (SELECT t.*, coalesce(ra0, 0.25) AS ra, coalesce(rs0, 0.18) AS rs, ra0, rs0, " + ", ".join(f"coalesce(q{i}, 1.0 / 6) AS q{i}" for i in range(6))
    + ", CASE WHEN ps <= 0 AND pm > 0 THEN least(pa, greatest(pm - pa * 18.0, 0) / 72.0) ELSE ps END AS st, greatest(pa, pm / 90.0, gameweek - 1) AS fx FROM test t LEFT JOIN pr USING (position))"
    + ", a2 AS (SELECT *, least(greatest((pa + season_appearance_before + ra * 4) / (fx + 4), 0), 0.995) AS la, least(greatest((st + season_starts_before + rs * 4) / (fx + 4), 0), 0.995) AS ls, CASE WHEN lag5_appearance_mean <= 0 AND lag3_appearance_mean <= 0 AND pa > 0 THEN pa / 38.0 ELSE lag5_appearance_mean END AS l5, pm >= 1200 OR pa >= 20 OR fx >= 30 AS settled FROM a1)"
    + ", a3 AS (SELECT *, least(greatest(0.65 * l5 + 0.35 * lag3_appearance_mean, 0), 1) AS na, least(greatest(0.65 * lag5_starts_mean + 0.35 * lag3_starts_mean, 0), 1) AS ns, CASE WHEN settled THEN 0.72 ELSE 0.55 END AS w, position = 'GKP' AS gk FROM a2)"
    + ", a4 AS (SELECT *, CASE WHEN settled THEN greatest(w * la + (1 - w) * na, 0.62 * la) ELSE w * la + (1 - w) * na END AS wa, CASE WHEN settled THEN greatest(w * ls + (1 - w) * ns, 0.62 * ls) ELSE w * ls + (1 - w) * ns END AS ws, least(greatest(coalesce(ra0, 0.20) * 0.80, CASE WHEN gk THEN 0.035 ELSE 0.06 END), CASE WHEN gk THEN 0.42 ELSE 0.58 END) AS ca FROM a3)"
    + ", a5 AS (SELECT *, CASE WHEN cold THEN ca ELSE wa END AS a0, CASE WHEN cold THEN least(greatest(coalesce(rs0, 0.12) * 0.80, 0.015), least(CASE WHEN gk THEN 0.30 ELSE 0.38 END, ca)) ELSE ws END AS s0 FROM a4)"
    + ", a6 AS (SELECT *, least(greatest(a0, 0), 1) AS a, least(greatest(least(s0, a0), 0), 1) AS s, pm / greatest(pa, 1) AS ty FROM a5)"
    + ", a7 AS (SELECT *, greatest(a - s, 0) AS sub, q1 / (q1 + q2) AS early, " + ", ".join(f"0.55 * q{3 + i} / (q3 + q4 + q5) + 0.45 * CASE WHEN settled AND ty >= 78 THEN {x} WHEN ty >= 60 THEN {y} ELSE {z} END AS g{i}" for i, (x, y, z) in enumerate(((0.04, 0.08, 0.18), (0.20, 0.42, 0.52), (0.76, 0.50, 0.30)))) + " FROM a6)"
    + " SELECT fixture_key, " + _summary(["(1 - a)", "(sub * early)", "(sub * (1 - early))", "(s * g0)", "(s * g1)", "(s * g2)"]) + " FROM a7"
)


@query(_BUCKET_SQL, _OUT)
def minutes_bucket_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split(minutes_frame(spark, sf_dir))
    return minutes.bucket_ensemble(train, test).select("fixture_key", *[c.alias(n) for n, c in minutes.summary_probabilities(F.col("states")).items()])


@query(_HIER_SQL, _OUT)
def minutes_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split(minutes_frame(spark, sf_dir))
    return minutes.hierarchical(train, test).select("fixture_key", *[c.alias(n) for n, c in minutes.summary_probabilities(F.col("states")).items()])


SOFTMAX_NUMERIC = ["lag1_minutes_mean", "lag3_minutes_mean", "lag5_minutes_mean", "lag5_starts_mean", "prior_season_minutes"]


@query()
def softmax_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split(minutes_frame(spark, sf_dir))
    made = minutes.softmax_states(train, test, SOFTMAX_NUMERIC, ["position"], "fixture_key", "available_time")
    return made.select("fixture_key", *[c.alias(n) for n, c in minutes.summary_probabilities(F.col("states")).items()])


_SHIFT_SQL = (
    PANEL_SQL
    + ", z0 AS (SELECT season, gameweek, team_uid, fixture_key, 0.05 + minutes / 100.0 AS p_start_raw, least(greatest(0.05 + minutes / 100.0, 1e-6), 1 - 1e-6) AS p FROM panel),"
    + " g AS (SELECT season, gameweek, team_uid, list(ln(p / (1 - p))) AS z, count(*) AS n FROM z0 GROUP BY ALL),"
    + " b AS (SELECT season, gameweek, team_uid, z, 1 AS i, CAST(-30 AS DOUBLE) AS lo, CAST(30 AS DOUBLE) AS hi FROM g WHERE n >= 15 UNION ALL SELECT season, gameweek, team_uid, z, i + 1, CASE WHEN s > 11 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN s > 11 THEN (lo + hi) / 2 ELSE hi END FROM (SELECT *, list_sum(list_transform(z, lambda v: 1 / (1 + exp(-(v + (lo + hi) / 2))))) AS s FROM b) WHERE i <= 60),"
    + " h AS (SELECT season, gameweek, team_uid, (lo + hi) / 2 AS shift FROM b WHERE i = 61)"
    + " SELECT season, gameweek, team_uid, fixture_key, p_start_raw, coalesce(1 / (1 + exp(-(ln(p / (1 - p)) + shift))), p_start_raw) AS p_start, shift IS NOT NULL AS adjusted FROM z0 LEFT JOIN h USING (season, gameweek, team_uid)"
).replace("WITH ", "WITH RECURSIVE ", 1)


@query(_SHIFT_SQL, ["p_start_raw", "p_start"])
def lineup_logit_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start probabilities of each team and block shifted to eleven starters."""
    df = panel(spark, sf_dir).withColumn("p_start", F.lit(0.05) + F.col("minutes") / 100.0)
    keys = ["season", "gameweek", "team_uid"]
    return minutes.coherent_starts(df, keys, "fixture_key").select(*keys, "fixture_key", "p_start_raw", "p_start", "adjusted")


# ---------------------------------------------------------------- components

_POINTS = {
    "points_appearance": "CASE WHEN minutes >= 60 THEN 2 WHEN minutes > 0 THEN 1 ELSE 0 END",
    "points_goals": "goals_scored * CASE position WHEN 'GKP' THEN CASE WHEN CAST(substr(season, 1, 4) AS BIGINT) >= 2024 THEN 10 ELSE 6 END WHEN 'DEF' THEN 6 WHEN 'MID' THEN 5 ELSE 4 END",
    "points_assists": "assists * 3",
    "points_clean_sheets": "CASE WHEN minutes >= 60 THEN clean_sheets * CASE WHEN position IN ('GKP', 'DEF') THEN 4 WHEN position = 'MID' THEN 1 ELSE 0 END ELSE 0 END",
    "points_saves": "saves // 3",
    "points_penalties": "penalties_saved * 5 - penalties_missed * 2",
    "points_goals_conceded": "CASE WHEN position IN ('GKP', 'DEF') THEN -(goals_conceded // 2) ELSE 0 END",
    "points_cards": "-yellow_cards - 3 * red_cards",
    "points_own_goals": "-2 * own_goals",
    "points_bonus": "bonus",
    "points_defensive_contribution": "CASE WHEN (position = 'DEF' AND defensive_contribution >= 10) OR (position IN ('MID', 'FWD') AND defensive_contribution >= 12) THEN 2 ELSE 0 END",
}
POINTS_SQL = PANEL_SQL + ", pts AS (SELECT season, position, fixture_key, total_points, " + ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in _POINTS.items()) + " FROM panel), scored AS (SELECT *, CAST(" + " + ".join(_POINTS) + " AS BIGINT) AS points FROM pts)"


@query(POINTS_SQL + f" SELECT fixture_key, {', '.join(_POINTS)}, points FROM scored")
def scoring_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {n: c.cast("long") for n, c in scoring.realised_components().items()}
    return panel(spark, sf_dir).select("fixture_key", *[c.alias(n) for n, c in parts.items()], scoring.realised_points().alias("points"))


@query(POINTS_SQL + " SELECT season, position, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (points = total_points) AS BIGINT) AS exact_matches, avg(abs(points - total_points)) AS mean_abs_difference, max(abs(points - total_points)) AS max_abs_difference FROM scored GROUP BY 1, 2", ["mean_abs_difference"])
def scoring_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel(spark, sf_dir).withColumn("d", scoring.realised_points() - F.col("total_points"))
    return df.groupBy("season", "position").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("d") == 0).alias("exact_matches"), F.avg(F.abs("d")).alias("mean_abs_difference"), F.max(F.abs("d")).alias("max_abs_difference"))


@query(PANEL_SQL + ", train AS (SELECT * FROM panel WHERE season < '2024-25'), pr AS (SELECT position, CASE WHEN sum(minutes) > 0 THEN sum(goals_scored) * 90.0 / sum(minutes) ELSE 0 END AS g FROM train GROUP BY 1), pl AS (SELECT player_uid, sum(goals_scored) AS s, sum(minutes) AS m, arg_max(position, season || lpad(CAST(gameweek AS VARCHAR), 2, '0') || lpad(CAST(fixture_key AS VARCHAR), 12, '0')) AS position FROM train GROUP BY 1), r AS (SELECT player_uid, (s * 90.0 + g * 900.0) / (m + 900.0) AS rate FROM pl JOIN pr USING (position)) SELECT t.fixture_key, coalesce(r.rate, pr.g, 0) AS goals_scored_per90, r.rate IS NULL AS goals_scored_fallback FROM panel t LEFT JOIN r USING (player_uid) LEFT JOIN pr ON pr.position = t.position WHERE season = '2024-25'", ["goals_scored_per90"])
def component_rates_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split(panel(spark, sf_dir))
    return components.rates_for(test, train).select("fixture_key", "goals_scored_per90", "goals_scored_fallback")


def expected_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player rows of the last season with minutes, rates, shares and expected counts."""
    train, test = _split(minutes_frame(spark, sf_dir))
    states = minutes.two_state(minutes.ewma_minutes())
    made = components.rates_for(test.withColumns(minutes.summary_probabilities(states)), train)
    made = made.withColumns({"team_expected_goals": 1.0 + F.col("team_uid") % 4 / 4.0, "opponent_expected_goals": 0.8 + F.col("opponent_uid") % 5 / 5.0})
    return components.expectations(components.attacking_shares(made, ["season", "gameweek", "team_uid"]))


_E90 = components.EVENTS
_EXPECTED_SQL = (
    _FRAME_SQL
    + ", hm AS (SELECT fixture_key, least(greatest(0.45 * coalesce(avg(minutes) FILTER (k <= 1), 0) + 0.55 * (0.65 * coalesce(avg(minutes) FILTER (k <= 3), 0) + 0.35 * coalesce(avg(minutes) FILTER (k <= 10), 0)), 0), 90) AS em FROM hist GROUP BY 1)"
    + ", cr AS (SELECT position, " + ", ".join(f"CASE WHEN sum(minutes) > 0 THEN sum({e}) * 90.0 / sum(minutes) ELSE 0 END AS g_{e}" for e in _E90) + " FROM train GROUP BY 1)"
    + ", cp AS (SELECT player_uid, sum(minutes) AS m, arg_max(position, season || lpad(CAST(gameweek AS VARCHAR), 2, '0') || lpad(CAST(fixture_key AS VARCHAR), 12, '0')) AS position, " + ", ".join(f"sum({e}) AS {e}" for e in _E90) + " FROM train GROUP BY 1)"
    + ", cq AS (SELECT player_uid, " + ", ".join(f"({e} * 90.0 + g_{e} * 900.0) / (m + 900.0) AS r_{e}" for e in _E90) + " FROM cp JOIN cr USING (position))"
    + ", ca AS (SELECT least(greatest(CASE WHEN sum(goals_scored) > 0 THEN sum(assists) / sum(goals_scored) ELSE 0.72 END, 0.25), 0.95) AS ar FROM train)"
    + ", e1 AS (SELECT t.season, t.gameweek, t.team_uid, t.player_uid, t.fixture_key, t.position, em, em / 90.0 AS p, ar, cold, 1.0 + t.team_uid % 4 / 4.0 AS te, 0.8 + t.opponent_uid % 5 / 5.0 AS oe, "
    + ", ".join(f"CASE WHEN cold THEN coalesce(g_{e}, 0) ELSE greatest(coalesce(r_{e}, g_{e}, 0), 0) END AS x_{e}" for e in _E90)
    + " FROM test t JOIN hm USING (fixture_key) LEFT JOIN cq USING (player_uid) LEFT JOIN cr ON cr.position = t.position CROSS JOIN ca)"
    + ", e2 AS (SELECT *, CASE WHEN cold THEN greatest(p, p * 0.35) ELSE greatest(p, p * 0.10) END AS aw, CASE position WHEN 'GKP' THEN 0.001 WHEN 'DEF' THEN 0.02 WHEN 'MID' THEN 0.08 ELSE 0.14 END AS gp, CASE position WHEN 'GKP' THEN 0.001 WHEN 'DEF' THEN 0.025 WHEN 'MID' THEN 0.08 ELSE 0.06 END AS ap FROM e1)"
    + ", e3 AS (SELECT *, CASE WHEN x_goals_scored * aw > 0 THEN x_goals_scored * aw ELSE gp * aw END AS gw0, CASE WHEN x_assists * aw > 0 THEN x_assists * aw ELSE ap * aw END AS aw0 FROM e2)"
    + ", e4 AS (SELECT *, CASE WHEN sum(gw0) OVER b > 0 THEN gw0 ELSE gp END AS gw, CASE WHEN sum(aw0) OVER b > 0 THEN aw0 ELSE ap END AS asw FROM e3 WINDOW b AS (PARTITION BY season, gameweek, team_uid))"
    + ", e5 AS (SELECT *, gw / sum(gw) OVER b AS gs, asw / sum(asw) OVER b AS ash FROM e4 WINDOW b AS (PARTITION BY season, gameweek, team_uid))"
    + ", expected AS (SELECT *, te * gs AS expected_goals, te * ar * ash AS expected_assists, exp(-oe) * p AS sheet, CASE WHEN position = 'GKP' THEN x_saves * p ELSE 0 END AS xs, CASE WHEN position = 'GKP' THEN least(greatest(x_penalties_saved * p, 0), 0.15) ELSE 0 END AS xps, "
    + ", ".join(f"least(greatest(x_{e} * p, 0), {components.CAPS[e]}) AS c_{e}" for e in ("penalties_missed", "yellow_cards", "red_cards", "own_goals", "bonus"))
    + ", x_defensive_contribution * p AS xd FROM e5)"
)
_PLAYS = "CASE WHEN p > 0 THEN p ELSE 1.0 END"


def _poisson_sum(rate: str, term: str, first: int, last: int) -> str:
    """Sum of term(k) over a Poisson count, k written into the term; each probability on its own by its logarithm."""
    return "(" + " + ".join(f"({term.format(k=k)}) * exp(-{rate} + {k} * ln(greatest({rate}, 1e-300)) - lgamma({k + 1}))" for k in range(first, last)) + ")"


_SAVED, _LET = f"(greatest(xs, 0) / {_PLAYS})", "oe"
_TAIL = {k: f"(1 - {_poisson_sum(f'(greatest(xd, 0) / {_PLAYS})', '1', 0, k)})" for k in (10, 12)}
_PARTS_SQL = {
    "expected_points_appearance": "p + p",
    "expected_points_goals": "expected_goals * CASE position WHEN 'GKP' THEN CASE WHEN CAST(substr(season, 1, 4) AS BIGINT) >= 2024 THEN 10 ELSE 6 END WHEN 'DEF' THEN 6 WHEN 'MID' THEN 5 ELSE 4 END",
    "expected_points_assists": "expected_assists * 3",
    "expected_points_clean_sheets": "sheet * CASE WHEN position IN ('GKP', 'DEF') THEN 4 WHEN position = 'MID' THEN 1 ELSE 0 END",
    "expected_points_saves": f"p * {_poisson_sum(_SAVED, '{k} // 3', 3, 60)}",
    "expected_points_penalties": "xps * 5 - c_penalties_missed * 2",
    "expected_points_goals_conceded": f"CASE WHEN position IN ('GKP', 'DEF') THEN -1 * {_poisson_sum(_LET, '{k} // 2', 2, 40)} * p ELSE 0 END",
    "expected_points_cards": "-1 * c_yellow_cards - 3 * c_red_cards",
    "expected_points_own_goals": "-2 * c_own_goals",
    "expected_points_defensive_contribution": f"CASE WHEN position = 'DEF' THEN p * least(greatest({_TAIL[10]}, 0), 1) * 2 WHEN position IN ('MID', 'FWD') THEN p * least(greatest({_TAIL[12]}, 0), 1) * 2 ELSE 0 END",
    "expected_points_bonus": "c_bonus",
}


@query(_EXPECTED_SQL + " SELECT fixture_key, player_uid, " + ", ".join(f"{v} AS {k}" for k, v in _PARTS_SQL.items()) + " FROM expected", list(_PARTS_SQL))
def expected_points_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = expected_frame(spark, sf_dir)
    parts = scoring.expected_components()
    return df.select("fixture_key", "player_uid", *[c.alias(n) for n, c in parts.items()])


@query(_EXPECTED_SQL + " SELECT season, gameweek, team_uid, sum(expected_goals) - max(te) AS error, sum(gs) AS share_sum FROM expected GROUP BY ALL", ["error", "share_sum"])
def goal_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of a team's expected goals are handed out, in every block."""
    return components.conservation(expected_frame(spark, sf_dir), ["season", "gameweek", "team_uid"]).select("season", "gameweek", "team_uid", "error", "share_sum")


#: Rows of a fixture, both sides together, beyond which there are more rounds (about; rounds are even by id).
MOST_IN_FIXTURE = 80


def simulation_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every player row on two sides, team t against t + 10, in as many rounds as the most rows of one player, or as squads of real size need.

    A fixture's draws are one group, so fixtures must not grow with the table. A player's rows of a block fall into different rounds, and players start in different ones, so rounds are alike in size.
    """
    df = expected_frame(spark, sf_dir).withColumns({"pair": F.col("team_uid") % 10, "model": F.lit("M3")})
    df = df.withColumn("nth", F.row_number().over(Window.partitionBy("season", "gameweek", "player_uid").orderBy("fixture_key")))
    pair = Window.partitionBy("season", "gameweek", "pair")
    df = df.withColumn("rounds", F.greatest(F.max("nth").over(pair), F.ceil(F.count(F.lit(1)).over(pair) / MOST_IN_FIXTURE)))
    one = df.withColumn("fixture", (F.pmod(F.col("nth") + F.floor(F.col("player_uid") / 20), F.col("rounds")) * 10 + F.col("pair")).cast("long"))
    return one.withColumn("goal_value", scoring.goal_value(F.col("season"), F.col("position")))


@query()
def simulate_fixture_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulation.simulate(simulation_frame(spark, sf_dir))


@query()
def simulate_block_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws of a player's fixtures in a season added up and summarised."""
    return simulation.rollup(simulation_frame(spark, sf_dir), ["season", "player_uid"])


@query(FACT_SQL + " SELECT fixture_key, minutes FROM fact WHERE position = 'AM'")
def managers_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).filter("position = 'AM'").select("fixture_key", "minutes")
