"""Draws added up over fixtures, packed on their way."""

import numpy as np
import pandas as pd
from test_distributions import fixture

from pitwise.plans import simulation


def test_packed_draws_come_back():
    rng = np.random.default_rng(1)
    for points in (rng.integers(-5, 20, 10_000), rng.integers(-300, 300, 50), np.array([70_000, -1]), np.zeros(0, int)):
        assert (simulation.unpacked(simulation.packed(points)) == points).all()
    assert len(simulation.packed(rng.poisson(2, 10_000))) < 8_000  # 40,000 bytes as whole numbers of Spark


def test_rollup_adds_draws_of_all_fixtures(spark):
    df = pd.concat([fixture(False, 0.5, s).assign(fixture=s) for s in (1, 2, 3)])
    total, missing = {}, {}
    for s in (1, 2, 3):
        rows, points, _ = simulation.fixture_draws(df[df.fixture == s][simulation.NEEDED], 400, 6060)
        for uid, p, x in zip(rows.player_uid, rows.p_appearance, points, strict=True):
            total[uid], missing[uid] = total.get(uid, 0) + x, missing.get(uid, 1.0) * (1 - p)
    found = simulation.rollup(spark.createDataFrame(df), ["season", "player_uid"], 400).collect()
    assert len(found) == len(total)
    for r in found:
        x = total[r.player_uid]
        assert np.allclose([r.points_mean, r.points_std, r.points_p25, r.points_p90, r.prob_eq_0, r.prob_ge_5, r.p_any], [x.mean(), x.std(), np.quantile(x, 0.25), np.quantile(x, 0.9), (x == 0).mean(), (x >= 5).mean(), 1 - missing[r.player_uid]])
