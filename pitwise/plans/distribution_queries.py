"""Queries on exact distributions of points, for every row of every fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwise.functions import scoring

from . import distributions, rolling_queries
from .distributions import EDGE, HIGH, LOW, MOST_AGAINST, MOST_SAVES, MOST_SCORED, QUANTILES
from .rolling_queries import _EXPECTED_BY_FOLD, OFF_TIES

QUERIES: dict = {}


def query(sql: str, doubles: tuple[str, ...]):
    """Registers a query and its SQL, doubles rounded to six places in both."""

    def add(f):
        def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: F.round(F.col(c) + OFF_TIES, 6) + F.lit(0.0) for c in doubles})

        swap = ", ".join(f"round(CAST({c} AS DOUBLE) + {OFF_TIES}, 6) + 0.0 AS {c}" for c in doubles)
        QUERIES[f.__name__] = (settled, f"SELECT * REPLACE ({swap}) FROM ({sql}) AS q", [])
        return f

    return add


_POISSON = "exp(-{r} + n * ln(greatest({r}, 1e-300)) - lgamma(n + 1))".format
_GIVEN = "CASE WHEN p > 0 THEN greatest({}, 0) / p ELSE 0 END".format
_VALUE = "CASE position WHEN 'GKP' THEN CASE WHEN CAST(substr(season, 1, 4) AS BIGINT) >= 2024 THEN 10 ELSE 6 END WHEN 'DEF' THEN 6 WHEN 'MID' THEN 5 ELSE 4 END"
_BACK = "position IN ('GKP', 'DEF')"
_REACH = "CASE position WHEN 'DEF' THEN 10 WHEN 'MID' THEN 12 WHEN 'FWD' THEN 12 ELSE 99 END"
_N = "(SELECT unnest(range(0, {} + 1)) AS n)".format


def _once(rate: str, points: int) -> str:
    chance = f"least({_GIVEN(rate)}, 1)"
    return f"SELECT fixture_key, 0 AS d, 1 - {chance} AS pr FROM e UNION ALL SELECT fixture_key, {points}, {chance} FROM e"


#: Outcomes of each part, given that the player appears; the test frame's players who appear reach the hour.
_PART_SQL = [
    f"SELECT fixture_key, n // 3 AS d, sum({_POISSON(r=f'({_GIVEN("xs")})')}) AS pr FROM e, {_N(MOST_SAVES)} GROUP BY ALL",
    f"SELECT fixture_key, n * {_VALUE} AS d, {_POISSON(r=f'({_GIVEN("expected_goals")})')} AS pr FROM e, {_N(MOST_SCORED)}",
    f"SELECT fixture_key, n * 3 AS d, {_POISSON(r=f'({_GIVEN("expected_assists")})')} AS pr FROM e, {_N(MOST_SCORED)}",
    f"SELECT fixture_key, 1 + CASE WHEN n > 0 THEN 0 WHEN {_BACK} THEN 4 WHEN position = 'MID' THEN 1 ELSE 0 END - CASE WHEN {_BACK} THEN n // 2 ELSE 0 END AS d, sum({_POISSON(r='oe')}) AS pr FROM e, {_N(MOST_AGAINST)} WHERE p > 0 GROUP BY ALL UNION ALL SELECT fixture_key, 0, 1.0 FROM e WHERE p <= 0",
    _once("xps", 5), _once("c_penalties_missed", -2), _once("c_yellow_cards", -1), _once("c_red_cards", -3), _once("c_own_goals", -2),
    f"SELECT fixture_key, 0 AS d, CASE WHEN {_REACH} = 99 THEN 1 ELSE sum({_POISSON(r=f'({_GIVEN("xd")})')}) FILTER (n < {_REACH}) END AS pr FROM e, {_N(12)} GROUP BY fixture_key, position UNION ALL SELECT fixture_key, 2 AS d, CASE WHEN {_REACH} = 99 THEN 0 ELSE 1 - sum({_POISSON(r=f'({_GIVEN("xd")})')}) FILTER (n < {_REACH}) END FROM e, {_N(12)} GROUP BY fixture_key, position",
    "SELECT fixture_key, floor(b) + u AS d, CASE WHEN u = 1 THEN b - floor(b) ELSE 1 - (b - floor(b)) END AS pr FROM (SELECT fixture_key, least(" + _GIVEN("c_bonus") + ", 3) AS b FROM e), (SELECT unnest([0, 1]) AS u)",
]
_CHANCES_SQL = (
    _EXPECTED_BY_FOLD
    + ", e AS (SELECT * FROM expected)"
    + ", c0 AS (SELECT fixture_key, 1 AS d, CAST(1 AS DOUBLE) AS pr FROM e)"
    + "".join(f", o{k} AS ({part}), c{k + 1} AS (SELECT fixture_key, CAST(c.d + o.d AS BIGINT) AS d, sum(c.pr * o.pr) AS pr FROM c{k} c JOIN o{k} o USING (fixture_key) WHERE c.d + o.d BETWEEN {LOW} AND {HIGH} GROUP BY ALL)" for k, part in enumerate(_PART_SQL))
    + f", chances AS (SELECT fixture_key, d, sum(pr) AS pr FROM (SELECT fixture_key, d, p * pr / sum(pr) OVER (PARTITION BY fixture_key) AS pr FROM c{len(_PART_SQL)} JOIN e USING (fixture_key) UNION ALL SELECT fixture_key, 0, 1 - p FROM e) GROUP BY ALL)"
)
_KEYS = "season, gameweek, player_uid"


def _summary_sql(keys: str, chances: str) -> str:
    quantile = ", ".join(f"CAST(min(d) FILTER (upto >= {q} - {EDGE}) AS BIGINT) AS points_p{round(100 * q)}" for q in QUANTILES)
    tails = ", ".join(f"coalesce(sum(pr) FILTER ({t}), 0) AS {n}" for n, t in (("prob_eq_0", "d = 0"), ("prob_ge_1", "d >= 1"), ("prob_ge_5", "d >= 5"), ("prob_ge_10", "d >= 10")))
    return f"SELECT {keys}, sum(d * pr) AS points_mean, sqrt(greatest(sum(d * d * pr) - sum(d * pr) ** 2, 0)) AS points_std, {quantile}, {tails} FROM (SELECT *, sum(pr) OVER (PARTITION BY {keys} ORDER BY d) AS upto FROM {chances}) GROUP BY {keys}"


_DOUBLES = ("points_mean", "points_std", "prob_eq_0", "prob_ge_1", "prob_ge_5", "prob_ge_10")


def rates_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all folds with what the distribution of their points is made of."""
    return rolling_queries.expected_frame(spark, sf_dir).withColumn("goal_value", scoring.goal_value(F.col("season"), F.col("position")))


@query(_CHANCES_SQL + " " + _summary_sql("fixture_key", "chances"), _DOUBLES)
def exact_fixture_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, spread, quantiles and tails of each row's points, by exact convolution."""
    return distributions.fixture_figures(rates_frame(spark, sf_dir), ["fixture_key"])


@query(
    _CHANCES_SQL.replace("WITH ", "WITH RECURSIVE ", 1)
    + f", f AS (SELECT {_KEYS}, fixture_key, p, row_number() OVER (PARTITION BY {_KEYS} ORDER BY fixture_key) AS i, count(*) OVER (PARTITION BY {_KEYS}) AS n FROM e)".replace(", f AS", ", place AS")
    + f", x AS (SELECT {_KEYS}, i, n, d, pr FROM place JOIN chances USING (fixture_key))"
    + f", roll AS (SELECT {_KEYS}, 1 AS k, n, d, pr FROM x WHERE i = 1 UNION ALL SELECT season, gameweek, player_uid, k + 1 AS k, n, d, sum(pr) AS pr FROM (SELECT r.season, r.gameweek, r.player_uid, r.k, r.n, r.d + x.d AS d, r.pr * x.pr AS pr FROM roll r JOIN x ON x.season = r.season AND x.gameweek = r.gameweek AND x.player_uid = r.player_uid AND x.i = r.k + 1) GROUP BY ALL)"
    + f", block AS (SELECT {_KEYS}, d, pr FROM roll WHERE k = n)"
    + f" SELECT s.*, a.n, a.p_any FROM ({_summary_sql(_KEYS, 'block')}) s JOIN (SELECT {_KEYS}, count(*) AS n, 1 - product(1 - p) AS p_any FROM place GROUP BY ALL) a USING ({_KEYS})",
    (*_DOUBLES, "p_any"),
)
def exact_block_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of a player's fixtures in a block added up exactly."""
    keys = ["season", "gameweek", "player_uid"]
    return distributions.block_figures(rates_frame(spark, sf_dir), keys)
