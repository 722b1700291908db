"""Queries on models that are refitted at every fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwise.functions import scoring
from pitwise.operators import pit, written

from . import components, minutes, model_queries, rolling
from .league import FIXTURE_SQL, fixtures
from .model_queries import _BUCKETS, _EXPECTED_SQL, _FOLD, _FRAME_SQL, _HIER_SQL, _OUT, _PARTS_SQL, _summary

QUERIES: dict = {}


#: Added before rounding, so that shares which lie halfway between two decimals round alike on both sides.
OFF_TIES = 3e-8


def query(sql: str | None = None, doubles: tuple[str, ...] = ()):
    """Registers a query and its SQL, doubles rounded to six places in both."""

    def add(f):
        def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: F.round(F.col(c) + OFF_TIES, 6) + F.lit(0.0) for c in doubles})

        swap = ", ".join(f"round(CAST({c} AS DOUBLE) + {OFF_TIES}, 6) + 0.0 AS {c}" for c in doubles)
        QUERIES[f.__name__] = (settled, sql and (f"SELECT * REPLACE ({swap}) FROM ({sql}) AS q" if doubles else sql), [])
        return f

    return add


def frame(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The feature frame with fold ids, written once, and the folds."""
    rows = written.once(rolling.with_fold(model_queries.minutes_frame(spark, sf_dir)), "minutes-frame")
    return rows, model_queries._folds(rows)


# ------------------------------------------------------------------------ minutes

#: Frame rows with their fold, and what each fold trains on, row by row.
_FOLD_FRAME = _FRAME_SQL[: _FRAME_SQL.index(", train AS")] + (
    f", test AS (SELECT *, {_FOLD}, {', '.join(f'{v} AS {k}' for k, v in _BUCKETS.items())} FROM frame)"
    + ", f AS (SELECT fold_id, min(information_cutoff) AS c FROM test GROUP BY 1)"
    + ", train AS (SELECT f.fold_id, x.* EXCLUDE (fold_id) FROM f JOIN test x ON x.available_time < f.c)"
)


def _fold_shares(alias: str) -> str:
    return ", ".join(f"(count(*) FILTER (state = '{s}') + 1.0) / (count(state) + 6.0) AS {alias}{i}" for i, s in enumerate(minutes.STATES))


_OVERALL = f", o AS (SELECT f.fold_id, {_fold_shares('o')} FROM f LEFT JOIN train USING (fold_id) GROUP BY 1)"
_M6_SQL = (
    "".join(
        f", n{j} AS (SELECT fold_id, {keys}, count(*) AS n, {_fold_shares('w')} FROM train GROUP BY ALL HAVING count(*) >= 18), l{j} AS (SELECT fold_id, {keys}, "
        + ", ".join(f"n / (n + 4.0) * w{i} + (1 - n / (n + 4.0)) * o{i} AS x{j}{i}" for i in range(6))
        + f" FROM n{j} JOIN o USING (fold_id))"
        for j, keys in enumerate(("position, rb", "position, sb", "hb"))
    )
    + ", m AS (SELECT fold_id, fixture_key, " + ", ".join(f"(o{i} + " + " + ".join(f"coalesce(x{j}{i}, 0)" for j in range(3)) + ") / (1 + " + " + ".join(f"CASE WHEN x{j}0 IS NULL THEN 0 ELSE 1 END" for j in range(3)) + f") AS p{i}" for i in range(6))
    + " FROM test JOIN o USING (fold_id) LEFT JOIN l0 USING (fold_id, position, rb) LEFT JOIN l1 USING (fold_id, position, sb) LEFT JOIN l2 USING (fold_id, hb))"
)
_M7_SQL = (
    f", pl AS (SELECT fold_id, position, count(*) AS n, {_fold_shares('w')}, avg(CASE WHEN minutes > 0 THEN 1.0 ELSE 0.0 END) AS ra0, avg(CASE WHEN starts > 0 THEN 1.0 ELSE 0.0 END) AS rs0 FROM train GROUP BY ALL)"
    + ", pr AS (SELECT fold_id, position, ra0, rs0, " + ", ".join(f"n / (n + 4.0) * w{i} + (1 - n / (n + 4.0)) * o{i} AS q{i}" for i in range(6)) + " FROM pl JOIN o USING (fold_id))"
    + _HIER_SQL[_HIER_SQL.index(", a1 AS") :].replace("LEFT JOIN pr USING (position)", "LEFT JOIN pr USING (fold_id, position)").replace(" SELECT fixture_key, ", " SELECT 'M7' AS model, fold_id, fixture_key, ")
)
_BOTH_SQL = _FOLD_FRAME + _OVERALL + _M6_SQL + _M7_SQL + " UNION ALL SELECT 'M6', fold_id, fixture_key, " + _summary([f"p{i}" for i in range(6)]) + " FROM m"


@query(_BOTH_SQL, _OUT)
def minutes_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6 and M7 of every row, each fitted on what was known at the row's cutoff."""
    rows, folds = frame(spark, sf_dir)
    out = None
    for model, made in (("M6", rolling.bucket_ensemble(rows, folds)), ("M7", rolling.hierarchical(rows, folds))):
        part = made.select(F.lit(model).alias("model"), "fold_id", "fixture_key", *[c.alias(n) for n, c in minutes.summary_probabilities(F.col("states")).items()])
        out = part if out is None else out.unionByName(part)
    return out


@query(_FOLD_FRAME + f", k AS (SELECT fold_id, fixture_key, row_number() OVER (PARTITION BY fold_id ORDER BY available_time DESC, fixture_key DESC) AS i FROM train) SELECT fold_id, fixture_key FROM k WHERE i <= {minutes.MAX_FIT_ROWS}")
def latest_rows_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that each fold's softmax is fitted on: the latest before its cutoff."""
    rows, folds = frame(spark, sf_dir)
    return pit.latest_before(rows.select("fixture_key", "available_time"), folds, "available_time", "information_cutoff", "fixture_key", minutes.MAX_FIT_ROWS).select("fold_id", "fixture_key")


@query()
def softmax_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5 of every row, fitted at the row's cutoff."""
    rows, folds = frame(spark, sf_dir)
    made = rolling.softmax(rows, folds, model_queries.SOFTMAX_NUMERIC, ["position"])
    return made.select("fold_id", "fixture_key", *[c.alias(n) for n, c in minutes.summary_probabilities(F.col("states")).items()])


# --------------------------------------------------------------------- components

_RATES = [f"{e}_per90" for e in components.EVENTS]
_SEEN = "season || lpad(CAST(gameweek AS VARCHAR), 2, '0') || lpad(CAST(fixture_key AS VARCHAR), 12, '0')"
_RATE_SQL = (
    ", cr AS (SELECT fold_id, position, " + ", ".join(f"CASE WHEN sum(minutes) > 0 THEN sum({e}) * 90.0 / sum(minutes) ELSE 0 END AS g_{e}" for e in components.EVENTS) + " FROM train GROUP BY ALL)"
    + f", cp AS (SELECT fold_id, player_uid, sum(minutes) AS m, arg_max(position, {_SEEN}) AS position, " + ", ".join(f"sum({e}) AS {e}" for e in components.EVENTS) + " FROM train GROUP BY ALL)"
    + ", cq AS (SELECT fold_id, player_uid, " + ", ".join(f"({e} * 90.0 + g_{e} * 900.0) / (m + 900.0) AS r_{e}" for e in components.EVENTS) + " FROM cp JOIN cr USING (fold_id, position))"
    + ", ca AS (SELECT f.fold_id, least(greatest(CASE WHEN sum(goals_scored) > 0 THEN sum(assists) / sum(goals_scored) ELSE 0.72 END, 0.25), 0.95) AS ar FROM f LEFT JOIN train USING (fold_id) GROUP BY 1)"
)


@query(
    _FOLD_FRAME + _RATE_SQL + " SELECT t.fold_id, t.fixture_key, ar AS assisted_goal_rate, r_goals_scored IS NULL AS goals_scored_fallback, "
    + ", ".join(f"CASE WHEN cold THEN coalesce(g_{e}, 0) ELSE greatest(coalesce(r_{e}, g_{e}, 0), 0) END AS {e}_per90" for e in components.EVENTS)
    + " FROM test t JOIN ca USING (fold_id) LEFT JOIN cq USING (fold_id, player_uid) LEFT JOIN cr ON cr.fold_id = t.fold_id AND cr.position = t.position",
    [*_RATES, "assisted_goal_rate"],
)
def component_rates_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component rates per 90 minutes of every row, as its fold knew them."""
    rows, folds = frame(spark, sf_dir)
    return rolling.component_rates(rows, rows, folds).select("fold_id", "fixture_key", "assisted_goal_rate", "goals_scored_fallback", *_RATES)


def expected_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player rows of all folds with minutes, rates, shares and expected counts, all as their fold knew them."""
    rows, folds = frame(spark, sf_dir)
    states = minutes.two_state(minutes.ewma_minutes())
    made = rolling.component_rates(rows.withColumns(minutes.summary_probabilities(states)), rows, folds)
    made = made.withColumns({"team_expected_goals": 1.0 + F.col("team_uid") % 4 / 4.0, "opponent_expected_goals": 0.8 + F.col("opponent_uid") % 5 / 5.0})
    return written.once(components.expectations(components.attacking_shares(made, ["season", "gameweek", "team_uid"])), "expected-frame")


_LAST = _EXPECTED_SQL[_EXPECTED_SQL.index(", hm AS") : _EXPECTED_SQL.index(", cr AS")], _EXPECTED_SQL[_EXPECTED_SQL.index(", e1 AS") :]
_EXPECTED_BY_FOLD = _FOLD_FRAME + _LAST[0] + _RATE_SQL + _LAST[1].replace("SELECT t.season,", "SELECT t.fold_id, t.season,").replace(
    "LEFT JOIN cq USING (player_uid) LEFT JOIN cr ON cr.position = t.position CROSS JOIN ca", "JOIN ca USING (fold_id) LEFT JOIN cq USING (fold_id, player_uid) LEFT JOIN cr ON cr.fold_id = t.fold_id AND cr.position = t.position"
)


@query(_EXPECTED_BY_FOLD + " SELECT fold_id, fixture_key, player_uid, " + ", ".join(f"{v} AS {k}" for k, v in _PARTS_SQL.items()) + " FROM expected", list(_PARTS_SQL))
def expected_points_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected points of every row by component, from rates and shares refitted at every fold."""
    df = expected_frame(spark, sf_dir)
    return df.select("fold_id", "fixture_key", "player_uid", *[c.alias(n) for n, c in scoring.expected_components().items()])


# -------------------------------------------------------------------------- teams

_T1_BY_FOLD = (
    FIXTURE_SQL
    + f", x AS (SELECT *, {_FOLD} FROM fixture), f AS (SELECT fold_id, min(information_cutoff) AS c FROM x GROUP BY 1)"
    + ", mean AS (SELECT f.fold_id, avg(home_goals) AS hm, avg(away_goals) AS am FROM f JOIN fixture k ON k.available_time < f.c GROUP BY 1)"
    + "".join(
        f", {r}r AS (SELECT f.fold_id, k.{r}_team_uid AS t, home_goals, away_goals, row_number() OVER (PARTITION BY f.fold_id, k.{r}_team_uid ORDER BY k.available_time DESC, k.fixture_key DESC) AS i FROM f JOIN fixture k ON k.available_time < f.c)"
        f", {r}s AS (SELECT fold_id, t, sum(home_goals) AS {r}h, sum(away_goals) AS {r}a, count(*) AS {r}n FROM {r}r WHERE i <= 8 GROUP BY ALL)"
        for r in ("home", "away")
    )
    + " SELECT x.fold_id, fixture_key, "
    + ", ".join("(" + " + ".join(f"(coalesce({r}{side[0]}, 0) + 6 * {mean}) / (coalesce({r}n, 0) + 6)" for r in ("home", "away")) + f") / 2 AS expected_{side}_goals" for side, mean in (("home", "hm"), ("away", "am")))
    + " FROM x JOIN mean USING (fold_id) LEFT JOIN homes ON homes.fold_id = x.fold_id AND homes.t = x.home_team_uid LEFT JOIN aways ON aways.fold_id = x.fold_id AND aways.t = x.away_team_uid"
)


@query(_T1_BY_FOLD, ["expected_home_goals", "expected_away_goals"])
def team_rates_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 of every fixture whose fold knew a match."""
    df = rolling.with_fold(fixtures(spark, sf_dir))
    return rolling.team_rates(df, model_queries._folds(df)).select("fold_id", "fixture_key", "expected_home_goals", "expected_away_goals")
