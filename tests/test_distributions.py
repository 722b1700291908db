"""Exact distributions of points against draws, plain loops and sums over all pairs."""

import math
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitwise.functions import probability
from pitwise.plans import distributions, simulation

DRAWS = 40_000


def fixture(sure=True, assisted=0.0, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for team in (1, 2):
        share = rng.random(11) + 0.1
        helps = rng.random(11) + 0.1
        for k, position in enumerate(["GKP"] + ["DEF"] * 4 + ["MID"] * 4 + ["FWD"] * 2):
            p = 1.0 if sure else float(rng.uniform(0.3, 1.0))
            rows.append({
                "season": "2024-25", "gameweek": 1, "fixture": 1, "model": "M", "team_uid": team, "player_uid": 100 * team + k, "position": position, "p_appearance": p, "p_reached_60": p * float(rng.uniform(0.4, 1.0)),
                "team_expected_goals": 1.4 if team == 1 else 0.9, "opponent_expected_goals": 0.9 if team == 1 else 1.4, "goal_share": share[k] / share.sum(), "assist_share": helps[k] / helps.sum(), "assisted_goal_rate": assisted,
                "goal_value": {"GKP": 10, "DEF": 6, "MID": 5, "FWD": 4}[position], "expected_saves": 2.5 if position == "GKP" else 0.0, "expected_penalty_saves": 0.05 if position == "GKP" else 0.0, "expected_penalty_misses": 0.02,
                "expected_yellow_cards": 0.2, "expected_red_cards": 0.02, "expected_own_goals": 0.01, "expected_defensive_contribution": 7.0, "expected_bonus": float(rng.uniform(0, 1.5)),
            })
    df = pd.DataFrame(rows)
    df["expected_goals"] = df.team_expected_goals * df.goal_share
    df["expected_assists"] = df.team_expected_goals * df.assisted_goal_rate * df.assist_share
    return df


def both(spark, df):
    """(chances of each row by player, draws by player)."""
    made = distributions.fixture_chances(spark.createDataFrame(df)).select("player_uid", "chances").collect()
    rows, points, _ = simulation.fixture_draws(df[simulation.NEEDED], DRAWS, 5)
    return {r.player_uid: np.array(r.chances) for r in made}, dict(zip(rows.player_uid, points, strict=True))


def test_agrees_with_draws_where_all_are_sure_to_play(spark):
    chances, draws = both(spark, fixture())
    values = np.arange(distributions.LOW, distributions.HIGH + 1)
    for uid, p in chances.items():
        x = draws[uid]
        assert p.sum() == pytest.approx(1)
        mean, spread = p @ values, math.sqrt(p @ values**2 - (p @ values) ** 2)
        assert abs(x.mean() - mean) < 5 * spread / math.sqrt(DRAWS)
        for least in (1, 5, 10):
            tail = p[values >= least].sum()
            assert abs((x >= least).mean() - tail) < 5 * math.sqrt(tail * (1 - tail) / DRAWS) + 1e-4


def test_means_are_near_the_draws_elsewhere(spark):
    """Helpers are drawn among those who did not score, and scorers among those who play: means stay close."""
    chances, draws = both(spark, fixture(sure=False, assisted=0.7))
    values = np.arange(distributions.LOW, distributions.HIGH + 1)
    apart = [abs(draws[u].mean() - p @ values) for u, p in chances.items()]
    tails = [abs((draws[u] >= 5).mean() - p[values >= 5].sum()) for u, p in chances.items()]
    assert max(apart) < 0.2 and max(tails) < 0.04


def test_blocks_are_sums_of_fixtures(spark):
    df = pd.concat([fixture(False, 0.5, s).head(5).assign(gameweek=1, fixture=s) for s in (1, 2, 3)])
    made = distributions.fixture_chances(spark.createDataFrame(df)).select("player_uid", "p_appearance", "chances").cache()
    alone = {}
    for r in made.collect():
        alone.setdefault(r.player_uid, []).append((r.p_appearance, r.chances))
    for r in distributions.block_chances(made, ["player_uid"]).collect():
        total = {0: 1.0}
        for _, c in alone[r.player_uid]:
            grown = {}
            for (a, p), (i, q) in product(total.items(), enumerate(c)):
                if p and q:
                    grown[a + i + distributions.LOW] = grown.get(a + i + distributions.LOW, 0.0) + p * q
            total = grown
        assert r.n == 3 and r.p_any == pytest.approx(1 - math.prod(1 - p for p, _ in alone[r.player_uid]))
        assert {r.low + i: p for i, p in enumerate(r.chances) if p > 1e-12} == pytest.approx({k: v for k, v in total.items() if v > 1e-12})


def test_floors_and_tails_in_closed_form(spark):
    rates = [0.0, 1e-6, 0.3, 1.0, 2.7, 9.0, 25.0]
    df = spark.createDataFrame([(r,) for r in rates], "r double")
    made = df.select("r", *[probability.poisson_floor_mean(F.col("r"), d).alias(f"f{d}") for d in (2, 3, 5)], *[probability.poisson_tail(F.col("r"), k).alias(f"t{k}") for k in (0, 1, 10, 12)]).collect()
    for row in made:
        p = [math.exp(-row.r)]
        for n in range(1, 200):
            p.append(p[-1] * row.r / n)
        for d in (2, 3, 5):
            assert row[f"f{d}"] == pytest.approx(sum(q * (n // d) for n, q in enumerate(p)), abs=1e-12)
        for k in (0, 1, 10, 12):
            assert row[f"t{k}"] == pytest.approx(1 - sum(p[:k]), abs=1e-12)


def test_figures_of_fixtures_and_blocks_read_from_the_arrays(spark):
    """Mean, spread, quantiles and tails of many rows of every position at once, against their arrays; blocks of one to four fixtures."""
    df = pd.concat([fixture(False, 0.5, s).assign(fixture=s) for s in range(1, 121)])
    df = df[df.fixture <= df.player_uid % 4 * 30 + 30]
    df["row"] = range(len(df))
    rows = spark.createDataFrame(df)
    arrays = {r.row: np.array(r.chances) for r in distributions.fixture_chances(rows).select("row", "chances").collect()}

    def check(got, p, low):
        v = np.arange(low, low + len(p))
        upto = np.cumsum(p)
        assert got.points_mean == pytest.approx(p @ v) and got.points_std == pytest.approx(math.sqrt(p @ v**2 - (p @ v) ** 2))
        assert [got.points_p10, got.points_p50, got.points_p90] == [v[np.argmax(upto >= q - distributions.EDGE)] for q in (0.1, 0.5, 0.9)]
        assert [got.prob_eq_0, got.prob_ge_1, got.prob_ge_5, got.prob_ge_10] == pytest.approx([p[v == 0].sum(), p[v >= 1].sum(), p[v >= 5].sum(), p[v >= 10].sum()])

    for r in distributions.fixture_figures(rows, ["row"]).collect():
        check(r, arrays[r.row], distributions.LOW)
    df["block"] = df.fixture % 30
    of = {k: list(g) for k, g in df.groupby(["player_uid", "block"]).row}
    found = distributions.block_figures(spark.createDataFrame(df), ["player_uid", "block"]).collect()
    assert len(found) == len(of) and {r.n for r in found} == {1, 2, 3, 4}
    for r in found:
        total = np.ones(1)
        for k in of[r.player_uid, r.block]:
            total = np.convolve(total, arrays[k])
        check(r, total, distributions.LOW * r.n)


def test_many_rows_take_seconds(spark):
    """The convolutions are made for batches: a row took some tens of milliseconds of a core before, 20,000 rows some minutes."""
    import time

    rows = spark.createDataFrame(fixture(False, 0.5)).crossJoin(spark.range(1000).withColumnRenamed("id", "copy")).repartition(8)
    distributions.fixture_figures(rows, ["player_uid"]).limit(1).collect()
    start = time.time()
    assert distributions.fixture_figures(rows, ["player_uid"]).filter("points_mean > 0").count() == 22_000
    assert time.time() - start < 30
