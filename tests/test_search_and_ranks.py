"""Ranks by strips, pruning, decision search and weights against plain versions."""

from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitwise.functions import text
from pitwise.operators import metrics, pit
from pitwise.plans import decisions, league, simulation

SF = "/root/testdata/sf0.001"


def squad_of(seed, n=15):
    rng = np.random.default_rng(seed)
    position = ["GKP"] * 2 + ["DEF"] * 5 + ["MID"] * 5 + ["FWD"] * 3
    return pd.DataFrame({"player_uid": np.arange(n), "position": position[:n], "club": rng.integers(0, 6, n).astype(str), "price_tenths": rng.integers(40, 100, n), "expected_points": rng.random(n) * 8, "p_appearance": rng.random(n)})


def test_ranks_against_pandas(spark):
    rng = np.random.default_rng(0)
    rows = pd.DataFrame({"g": rng.integers(0, 3, 400), "v": np.where(rng.random(400) < 0.3, 0.0, rng.normal(size=400).round(2) * 10.0 ** rng.integers(-3, 4, 400)), "k": rng.permutation(400)})
    df = spark.createDataFrame(rows)
    found = metrics.with_average_rank(df, ["g"], "v", "r").toPandas().sort_values("k")
    want = rows.sort_values("k").groupby("g").v.rank(method="average")
    assert found.r.to_numpy() == pytest.approx(want.to_numpy())
    binned = metrics.with_equal_count_bin(df, ["g"], "v", "k", 7).toPandas().sort_values("k").set_index("k").bin
    for _, part in rows.sort_values(["v", "k"]).groupby("g"):
        place = np.maximum(np.ceil(np.arange(len(part)) * 7 / (len(part) - 1)) - 1, 0).astype(int)
        assert binned.loc[part.k].tolist() == place.tolist()


def test_plans_hold_no_group_of_facts_in_one_window(spark):
    df = league.panel(spark, SF)
    audit = pit.leakage_audit(df.withColumn("t", F.col("kickoff_time")), ["fixture_key"], "information_cutoff", ["t"], set(), block="gameweek", first_block_zero=["goals_scored"], season="season")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    # the only windows are those of the panel itself, by season and block
    assert all("gameweek" in line for line in plan(audit).splitlines() if "Window [" in line)
    folds = pit.folds(df, "season", "gameweek", "information_cutoff", first_block_only=True)
    by_season = pit.training_totals(df, folds, "available_time", "information_cutoff", {"n": F.lit(1)}, season_before="season")
    # rows meet folds in time lines by season, never as a product
    assert any("_line" in line for line in plan(by_season).splitlines() if "Window [" in line)


def test_numbers_from_text(spark):
    df = spark.createDataFrame([("1.5",), (" 7 ",), ("n/a",), ("",), (None,), ("NaN",)], "t string")
    assert [r[0] for r in df.select(text.number_or_null(F.col("t"))).collect()] == [1.5, 7.0, None, None, None, None]
    assert [r[0] for r in df.select(text.number(F.col("t"), -1.0)).collect()] == [1.5, 7.0, -1.0, -1.0, -1.0, -1.0]


def test_undominated_against_counting(spark):
    rng = np.random.default_rng(2)
    n = 200
    rows = pd.DataFrame({"block": rng.integers(0, 2, n), "player_uid": np.arange(n), "position": rng.choice(decisions.POSITIONS, n), "club": rng.integers(0, 3, n).astype(str), "price_tenths": rng.integers(40, 60, n), "expected_points": rng.integers(0, 9, n).astype(float)})
    kept = {r.player_uid for r in decisions.undominated(spark.createDataFrame(rows), ["block"]).collect()}
    want = set()
    for r in rows.itertuples():
        rivals = rows[(rows.block == r.block) & (rows.position == r.position) & (rows.club == r.club) & (rows.expected_points >= r.expected_points)]
        before = rivals[[(p, -e, u) < (r.price_tenths, -r.expected_points, r.player_uid) for p, e, u in zip(rivals.price_tenths, rivals.expected_points, rivals.player_uid, strict=True)]]
        if len(before) < min(3, decisions.RULES.quota[decisions.POSITIONS.index(r.position)]):
            want.add(r.player_uid)
    assert kept == want and len(kept) < n


def test_node_limit_still_gives_a_squad():
    rng = np.random.default_rng(3)
    n = 50
    pool = pd.DataFrame({"player_uid": np.arange(n), "position": rng.choice(decisions.POSITIONS, n, p=[0.15, 0.3, 0.3, 0.25]), "club": np.where(rng.random(n) < 0.6, "a", rng.integers(0, 9, n).astype(str)), "price_tenths": rng.integers(40, 70, n), "expected_points": rng.random(n) * 5, "p_appearance": 0.9})
    pool.loc[pool.club == "a", "expected_points"] += 3
    some = decisions.optimal_squad(pool, node_limit=1)
    assert some["status"] == "feasible" and len(some["squad"]) == 15 and some["objective"] <= some["bound"]
    assert pool[pool.player_uid.isin(some["squad"])].club.value_counts().max() <= 3


def test_slot_values_score_every_replacement_exactly():
    squad = squad_of(5)
    choice = decisions.best_lineup(squad)
    slots = decisions.slot_values(squad, choice).set_index("player_uid")
    rng = np.random.default_rng(6)
    for uid in rng.choice(squad.player_uid, 5, replace=False):
        p, e = rng.random(), rng.random() * 8
        other = squad.copy()
        other.loc[other.player_uid == uid, ["p_appearance", "expected_points"]] = p, e
        s = slots.loc[uid]
        assert decisions.expected_realised(other, choice)["total"] == pytest.approx(p * s.if_plays + (1 - p) * s.if_not + e * s.per_point)


def test_best_realised_lineup_is_no_worse_than_the_nominal_one():
    squad = squad_of(7)
    best = decisions.best_realised_lineup(squad)
    nominal = decisions.expected_realised(squad, decisions.best_lineup(squad))["total"]
    assert best["objective"] >= nominal - 1e-9
    assert best["objective"] == pytest.approx(decisions.expected_realised(squad, best)["total"])


def test_combined_transfers_against_all_sets(spark):
    rng = np.random.default_rng(8)
    rows = [(o, int(rng.integers(40, 60)), str(o % 3), 100 + int(rng.integers(0, 6)), int(rng.integers(40, 65)), str(rng.integers(0, 4)), float(rng.integers(-2, 9))) for o in range(4) for _ in range(3)]
    options = pd.DataFrame(rows, columns=["out_uid", "out_price", "out_club", "in_uid", "in_price", "in_club", "gain"]).drop_duplicates(["out_uid", "in_uid"])
    clubs = {"0": 3, "1": 3, "2": 2, "3": 1}
    by_out = [[None, *g.itertuples(index=False)] for _, g in options.groupby("out_uid")]
    want = []
    for chosen in product(*by_out):
        moves = [c for c in chosen if c is not None]
        held = dict(clubs)
        for m in moves:
            held[m.out_club] -= 1
            held[m.in_club] = held.get(m.in_club, 0) + 1
        if len(moves) <= 2 and len({m.in_uid for m in moves}) == len(moves) and max(held.values()) <= 3 and 15 + sum(m.out_price - m.in_price for m in moves) >= 0:
            want.append((round(sum(m.gain for m in moves), 9), [(m.out_uid, m.in_uid) for m in moves]))
    squad = spark.createDataFrame([(7, c) for c, n in clubs.items() for _ in range(n)], "block long, club string")
    given = spark.createDataFrame(options.assign(block=7)[["block", *options.columns]])
    found = [(round(r.gain, 9), [tuple(m) for m in r.moves]) for r in decisions.legal_transfer_sets(squad, given, ["block"], 15, 2).collect()]
    assert sorted(found) == sorted(want) and len(want) > 5


def test_local_search_gains(spark):
    rng = np.random.default_rng(9)
    n = 60
    pool = pd.DataFrame({"block": 0, "player_uid": np.arange(n), "position": np.array(decisions.POSITIONS)[np.arange(n) % 4], "club": (np.arange(n) % 20).astype(str), "price_tenths": rng.integers(40, 70, n), "expected_points": rng.random(n) * 6, "p_appearance": rng.random(n) * 0.5 + 0.5})
    start = decisions.optimal_squad(pool)
    squad = pool[pool.player_uid.isin(start["squad"])]
    before = decisions.expected_realised(squad, decisions.best_lineup(squad))["total"]
    row = decisions.local_search(spark.createDataFrame(pool), ["block"], rounds=1).first()
    assert row.expected_total >= before - 1e-9 and len(row.squad.split(",")) == 15


def test_active_weights_meet_the_shares():
    rng = np.random.default_rng(10)
    shares = rng.random(12) + 0.2
    shares /= shares.sum()
    active = rng.random((12, 5000)) < rng.uniform(0.4, 0.9, 12)[:, None]
    weights = simulation.active_weights(shares, active)
    some = active[:, active.any(0)]
    got = (some * weights[:, None] / (weights @ some)).mean(1)
    assert got == pytest.approx(shares, abs=2e-3)
    # a share that is out of reach ends with finite weights, and draws without players don't count
    rare = np.zeros((2, 100), bool)
    rare[0, :10], rare[1, 5:90] = True, True
    assert np.isfinite(simulation.active_weights(np.array([0.9, 0.1]), rare)).all()
    assert (simulation.active_weights(np.array([0.5, 0.5]), np.zeros((2, 9), bool)) == 1).all()


def test_swap_options_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.randrange(2), uid, rng.choice(["DEF", "MID"]), rng.randrange(40, 60), rng.randrange(12) / 4) for uid in range(300)]
    schema = "block long, player_uid long, position string, price_tenths long, expected_points double"
    pool = spark.createDataFrame(rows, schema)
    squad = pool.filter("player_uid % 9 = 0")
    want = set()
    for b, out, place, price, points in (r for r in rows if r[1] % 9 == 0):
        free = [(-(x - points), uid, p) for c, uid, q, p, x in rows if c == b and q == place and uid % 9 and p <= price + 3]
        want |= {(b, place, out, price, uid, p, -gain, k) for k, (gain, uid, p) in enumerate(sorted(free)[:4], 1)}
    found = decisions.swap_options(squad, pool, ["block"], F.lit(3), 4)
    assert found.columns == ["block", "position", "out_uid", "out_price", "in_uid", "price_tenths", "gain", "rank"]
    assert {tuple(r) for r in found.collect()} == want and len(want) > 100


def test_swap_options_do_not_pair_a_squad_with_the_pool(spark):
    """20,000 owned and 180,000 free players of one position: 3.6 billion pairs."""
    import time

    pool = spark.range(200_000).selectExpr("CAST(0 AS BIGINT) AS block", "id AS player_uid", "'MID' AS position", "40 + id % 50 AS price_tenths", "CAST(id % 997 AS DOUBLE) AS expected_points")
    start = time.time()
    found = decisions.swap_options(pool.filter("player_uid % 10 = 3"), pool, ["block"], F.lit(10))
    assert found.count() == 60_000 and time.time() - start < 60
