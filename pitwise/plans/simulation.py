"""Seeded Monte-Carlo of whole fixtures: every goal of a team has one scorer who plays.

Fixtures are spread over tasks; a task holds one fixture's squads and draws at a time and returns
summaries, or the draws themselves where blocks are added up later. Seeds come from names, never
from partitions, so results do not depend on how Spark deals the work.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

DRAWS = 10_000
VERSION = "fixture-coherent-1"
NEEDED = ["season", "gameweek", "fixture", "model", "team_uid", "player_uid", "position", "p_appearance", "p_reached_60", "team_expected_goals", "goal_share", "assist_share", "assisted_goal_rate", "goal_value", "expected_saves", "expected_penalty_saves", "expected_penalty_misses", "expected_yellow_cards", "expected_red_cards", "expected_own_goals", "expected_defensive_contribution", "expected_bonus"]


def seed_of(*names: object) -> int:
    text = "\x1f".join(map(str, names)).encode()
    return int.from_bytes(hashlib.sha256(text).digest()[:8], "big")


def choose(weights: np.ndarray, open_: np.ndarray, u: np.ndarray) -> np.ndarray:
    """For each draw (column) a row, by weight among the open rows; equal weights if all are 0."""
    w = np.where(open_, weights[:, None], 0.0)
    w = np.where(w.sum(0) > 0, w, open_.astype(float))
    edges = np.cumsum(w, 0)
    return np.minimum((edges <= u * edges[-1]).sum(0), len(weights) - 1)


def active_weights(shares: np.ndarray, active: np.ndarray, slack: float = 1e-6, ridge: float = 1e-5) -> np.ndarray:
    """Weights with which draws among the active players give each player its share, on average over all draws.

    Draws where nobody is active don't count. With logarithms of weights x the wanted shares are
    where share @ x - mean(log(sum of exp(x) of the active)) is largest; that is concave, so Newton
    steps with halving climb until a step gains less than ``slack``. The ridge keeps weights finite
    where a share is out of reach (a player is active less often than its share asks for).
    """
    some = active.any(0)
    used = np.flatnonzero(active.any(1) & (shares > 0))
    if not some.any() or not len(used):
        return np.ones(len(shares))
    who = active[np.ix_(used, some)].astype(float)
    who = who[:, who.any(0)]
    n = who.shape[1]
    target = shares[used] / shares[used].sum()

    def climb(x: np.ndarray) -> tuple[float, np.ndarray]:
        part = np.exp(np.maximum(x - x.max(), -200.0))[:, None] * who
        total = part.sum(0)
        part /= total
        return target @ (x - x.max()) - np.log(total).mean() - ridge / 2 * (x @ x), part

    x = np.log(target)
    value, p = climb(x)
    while True:
        mean = p.mean(1)
        slope = target - mean - ridge * x
        step = np.linalg.solve(np.diag(mean + ridge) - p @ p.T / n, slope)
        if slope @ step / 2 < slack:
            break
        step /= max(1.0, np.abs(step).max() / 3)
        size, found = 1.0, None
        while found is None and size > 1e-3:
            new, q = climb(x + size * step)
            if new > value:
                found = x + size * step, new, q
            size /= 2
        if found is None:
            break
        x, value, p = found
    out = np.zeros(len(shares))
    out[used] = np.exp(np.maximum(x - x.max(), -200.0))
    return out


def fixture_draws(rows: pd.DataFrame, draws: int, seed: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """(rows in order, points of each row and draw, goals of each row and draw) of one fixture."""
    rows = rows.sort_values(["team_uid", "player_uid"]).reset_index(drop=True)
    names = (seed, VERSION, rows.model[0], rows.season[0], rows.gameweek[0], rows.fixture[0])
    n = len(rows)
    points, goals, apps, sixty = np.zeros((n, draws), np.int32), np.zeros((n, draws), np.int16), np.zeros((n, draws), bool), np.zeros((n, draws), bool)
    for i, r in enumerate(rows.itertuples(index=False)):
        rng = np.random.default_rng(seed_of(*names, r.player_uid, "player"))
        p = min(max(r.p_appearance, 0.0), 1.0)
        given = lambda x, p=p: max(x, 0.0) / p if p > 0 else 0.0
        apps[i] = rng.random(draws) < p
        sixty[i] = apps[i] & (rng.random(draws) < given(min(r.p_reached_60, p)))
        own = rng.poisson(given(r.expected_saves), draws) // 3
        own += 5 * (rng.random(draws) < given(r.expected_penalty_saves)) - 2 * (rng.random(draws) < given(r.expected_penalty_misses))
        own -= (rng.random(draws) < given(r.expected_yellow_cards)) + 3 * (rng.random(draws) < given(r.expected_red_cards)) + 2 * (rng.random(draws) < given(r.expected_own_goals))
        reach = {"DEF": 10, "MID": 12, "FWD": 12}.get(r.position)
        own += 2 * (rng.poisson(given(r.expected_defensive_contribution), draws) >= reach) if reach else 0
        bonus = min(given(r.expected_bonus), 3.0)
        own += int(bonus) + (rng.random(draws) < bonus - int(bonus))
        points[i] = own * apps[i]
    teams = list(dict.fromkeys(rows.team_uid))
    scored = {t: np.random.default_rng(seed_of(*names, t, "score")).poisson(max(float(rows.team_expected_goals[rows.team_uid == t].iloc[0]), 0.0), draws) for t in teams}
    for t in teams:
        at = np.flatnonzero(rows.team_uid == t)
        rng = np.random.default_rng(seed_of(*names, t, "who"))
        share = [np.maximum(rows[c].to_numpy(float)[at], 0.0) for c in ("goal_share", "assist_share")]
        share = [s / s.sum() if s.sum() > 0 else np.full(len(at), 1 / len(at)) for s in share]
        # a goal needs a scorer: where nobody plays, the likeliest player who could have does
        weight = active_weights(share[0], apps[at])
        best = int(np.argmax(weight))
        if rows.p_appearance[at[best]] > 0:
            apps[at[best], (scored[t] > 0) & ~apps[at].any(0)] = True
        assist_weight = active_weights(share[1], apps[at])
        value, helped = rows.goal_value.to_numpy(int)[at], float(rows.assisted_goal_rate.iloc[at[0]])
        for k in range(int(scored[t].max(initial=0))):
            which = np.flatnonzero((scored[t] > k) & apps[at].any(0))
            if not len(which):
                continue
            open_ = apps[np.ix_(at, which)]
            who = choose(weight, open_, rng.random(len(which)))
            np.add.at(goals, (at[who], which), 1)
            np.add.at(points, (at[who], which), value[who])
            rest = open_.copy()
            rest[who, np.arange(len(which))] = False
            help_ = rest.any(0) & (rng.random(len(which)) < helped)
            if help_.any():
                by = choose(assist_weight, rest[:, help_], rng.random(int(help_.sum())))
                np.add.at(points, (at[by], which[help_]), 3)
        against = next((scored[o] for o in teams if o != t), np.zeros(draws, int))
        back = rows.position.iloc[at].isin(["GKP", "DEF"]).to_numpy()
        sheet = np.where(back, 4, np.where(rows.position.iloc[at] == "MID", 1, 0))
        points[at] += (against == 0) * sixty[at] * sheet[:, None] - back[:, None] * (against // 2) * sixty[at]
    return rows, points + apps + sixty, goals


SUMMARY = "season string, gameweek long, fixture long, model string, team_uid long, player_uid long, simulated_points double, points_std double, points_p10 double, points_p50 double, points_p90 double, prob_eq_0 double, prob_ge_5 double, prob_ge_10 double, goals double"


def simulate(df: DataFrame, draws: int = DRAWS, seed: int = 6060) -> DataFrame:
    """Summaries of each player's draws in each fixture."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, points, goals = fixture_draws(rows, draws, seed)
        q = np.quantile(points, [0.1, 0.5, 0.9], axis=1)
        out = rows[["season", "gameweek", "fixture", "model", "team_uid", "player_uid"]].copy()
        out["simulated_points"], out["points_std"] = points.mean(1), points.std(1)
        out["points_p10"], out["points_p50"], out["points_p90"] = q
        out["prob_eq_0"], out["prob_ge_5"], out["prob_ge_10"] = (points == 0).mean(1), (points >= 5).mean(1), (points >= 10).mean(1)
        out["goals"] = goals.mean(1)
        return out

    return df.select(*NEEDED).groupBy("season", "gameweek", "fixture", "model").applyInPandas(run, SUMMARY)


def simulate_draws(df: DataFrame, draws: int, seed: int = 6060) -> DataFrame:
    """(season, gameweek, fixture, model, player_uid, p_appearance, draws array<int>): what block roll-ups add up."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, points, _ = fixture_draws(rows, draws, seed)
        out = rows[["season", "gameweek", "fixture", "model", "player_uid", "p_appearance"]].copy()
        out["draws"] = list(points)
        return out

    return df.select(*NEEDED).groupBy("season", "gameweek", "fixture", "model").applyInPandas(run, "season string, gameweek long, fixture long, model string, player_uid long, p_appearance double, draws array<int>")


def packed(points: np.ndarray) -> bytes:
    """A row's draws in the narrowest whole numbers that hold them, compressed: a digit for their width, then the numbers."""
    width = next(w for w in (1, 2, 4) if np.iinfo(f"i{w}").min <= points.min(initial=0) and points.max(initial=0) <= np.iinfo(f"i{w}").max)
    return bytes([width]) + zlib.compress(points.astype(f"<i{width}").tobytes(), 1)


def unpacked(draws: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(draws[1:]), f"<i{draws[0]}")


QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
FIGURES = ["points_mean", "points_std", *[f"points_p{round(100 * q)}" for q in QUANTILES], "prob_eq_0", "prob_ge_1", "prob_ge_5", "prob_ge_10"]


def figures_of(draws: np.ndarray) -> list[float]:
    """As ``metrics.draw_summary`` has them: mean, spread, interpolated quantiles, shares."""
    n, ordered = len(draws), np.sort(draws)
    mean = float(draws.sum()) / n
    at = [(n - 1) * q for q in QUANTILES]
    low, high = ([float(ordered[int(f(x))]) for x in at] for f in (np.floor, np.ceil))
    between = [a + (b - a) * (x - np.floor(x)) for a, b, x in zip(low, high, at, strict=True)]
    shares = [float(np.count_nonzero(t)) / n for t in (draws == 0, draws >= 1, draws >= 5, draws >= 10)]
    return [mean, float(np.sqrt(max(float((draws * draws).sum()) / n - mean**2, 0.0))), *between, *shares]


@F.arrow_udf(StructType([StructField(n, DoubleType()) for n in FIGURES]))
def _summed_figures(groups: pa.Array) -> pa.Array:
    made = [figures_of(sum(unpacked(d).astype(np.int64) for d in group)) for group in groups.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([m[i] for m in made], pa.float64()) for i in range(len(FIGURES))], FIGURES)


def rollup(df: DataFrame, keys: list[str], draws: int = DRAWS, seed: int = 6060) -> DataFrame:
    """(keys, figures, p_any): the draws of a key's fixtures added up, draw by draw, and summarised.

    Fixtures are simulated once and their draws go to their players' keys packed, some kilobytes a row.
    """
    types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, points, _ = fixture_draws(rows, draws, seed)
        return rows[[*keys, "p_appearance"]].assign(draws=[packed(p) for p in points])

    made = df.select(*NEEDED).groupBy("season", "gameweek", "fixture", "model").applyInPandas(run, f"{types}, p_appearance double, draws binary")
    listed = made.groupBy(*keys).agg(any_appearance().alias("p_any"), F.collect_list("draws").alias("_all"))
    return listed.select(*keys, "p_any", _summed_figures("_all").alias("_f")).select(*keys, "_f.*", "p_any")


def any_appearance(p: str = "p_appearance"):
    """Aggregate: probability of playing in at least one fixture of the block."""
    return 1 - F.product(1 - F.least(F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
