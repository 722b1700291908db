"""Exact values of line-ups and swaps against all states of who plays."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitwise.plans import decisions, lineups


def tables(seed, blocks=3, extra=24):
    rng = np.random.default_rng(seed)
    rows = []
    for b in range(blocks):
        uid = 0
        for p, q in zip(decisions.POSITIONS, decisions.RULES.quota, strict=True):
            for k in range(q + extra // 4):
                chance = float(rng.choice([0.0, 1.0, rng.random()], p=[0.1, 0.2, 0.7]))
                rows.append((b, uid, p, str(rng.integers(0, 9)), int(rng.integers(40, 70)), float(rng.random() * 6) if chance else 0.0, chance, k < q))
                uid += 1
    return pd.DataFrame(rows, columns=["block", "player_uid", "position", "club", "price_tenths", "expected_points", "p_appearance", "owned"])


@pytest.fixture(scope="module")
def made(spark):
    frame = tables(4)
    pool = spark.createDataFrame(frame)
    rows = lineups.nominal_lineups(pool.filter("owned").drop("owned"), ["block"])
    return frame, pool.drop("owned"), rows.cache()


def choice_of(rows):
    """The line-up as the search over states takes it: starters in order, then the bench."""
    rows = rows.sort_values("place")
    return {"lineup": rows.player_uid[rows.starts].tolist(), "bench": rows.player_uid[~rows.starts].tolist(), "captain": rows.player_uid[rows.captain].item(), "deputy": rows.player_uid[rows.deputy].item()}


def test_totals(made):
    frame, _, rows = made
    local = rows.toPandas()
    found = {r.block: r.expected_total for r in lineups.expected_totals(rows, ["block"]).collect()}
    assert len(found) == 3
    for b, squad in local.groupby("block"):
        assert len(squad) == 15 and squad.starts.sum() == 11 and squad.captain.sum() == squad.deputy.sum() == 1
        assert found[b] == pytest.approx(decisions.expected_realised(squad, choice_of(squad))["total"])


def test_nominal_lineup_has_the_most_points(made):
    _, _, rows = made
    for _, squad in rows.toPandas().groupby("block"):
        best = 0.0
        for f in lineups.formations():
            best = max(best, sum(squad[squad.position == p].expected_points.nlargest(n).sum() for p, n in zip(decisions.POSITIONS, (1, *f), strict=True)))
        assert squad.expected_points[squad.starts].sum() == pytest.approx(best)


def test_every_affordable_swap(made):
    frame, pool, rows = made
    found = {(r.block, r.out_uid, r.in_uid): r for r in lineups.swap_gains(rows, pool, ["block"], bank=6).collect()}
    want = 0
    for b, squad in rows.toPandas().groupby("block"):
        choice, base = choice_of(squad), None
        base = decisions.expected_realised(squad, choice)["total"]
        free = frame[(frame.block == b) & ~frame.owned]
        for out in squad.itertuples():
            for new in free[free.position == out.position].itertuples():
                clubs = squad.club[squad.player_uid != out.player_uid].tolist() + [new.club]
                legal = clubs.count(new.club) <= 3 and new.price_tenths <= out.price_tenths + 6
                assert legal == ((b, out.player_uid, new.player_uid) in found)
                if not legal:
                    continue
                want += 1
                row = found[b, out.player_uid, new.player_uid]
                assert row.left == 6 + out.price_tenths - new.price_tenths
                if want % 7 == 0:  # all states of who plays, for one in seven
                    other = squad.copy()
                    other.loc[other.player_uid == out.player_uid, ["player_uid", "p_appearance", "expected_points"]] = new.player_uid, new.p_appearance, new.expected_points
                    swapped = {k: [new.player_uid if x == out.player_uid else x for x in v] if isinstance(v, list) else new.player_uid if v == out.player_uid else v for k, v in choice.items()}
                    assert row.gain == pytest.approx(decisions.expected_realised(other, swapped)["total"] - base, abs=1e-9)
    assert want == len(found) > 50


def test_no_python_in_the_plan(made):
    _, pool, rows = made
    plan = lineups.swap_gains(rows, pool, ["block"], bank=6)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert rows.filter(F.col("place").isNull()).count() == 0
