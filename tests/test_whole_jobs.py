"""Queries cover every fold, row and draw of their tables."""

import inspect
from collections import Counter

from pyspark.sql import functions as F

from pitwise.operators import pit
from pitwise.plans import catalogue, league, model_queries, simulation

SF = "/root/testdata/sf0.001"


def test_goal_models_fit_every_fold_with_history(spark):
    fixtures = league.fixtures(spark, SF)
    first = fixtures.agg(F.min("available_time")).first()[0]
    folds = pit.folds(fixtures, "season", "gameweek", "information_cutoff").filter(F.col("information_cutoff") > F.lit(first))
    want = {r.fold_id for r in folds.collect()}
    assert len({f[:4] for f in want}) > 1
    for name in ("fit_ridge_poisson", "fit_dixon_coles", "weighted_pair_counts_all_folds"):
        assert {r.fold_id for r in catalogue.queries()[name](spark, SF).select("fold_id").distinct().collect()} == want
    predicted = catalogue.queries()["rating_predictions"](spark, SF).select("fixture_key").collect()
    rows = fixtures.join(folds.select("season", "gameweek"), ["season", "gameweek"]).count()
    assert len(predicted) == len({r.fixture_key for r in predicted}) == rows


def test_simulation_keeps_every_player_row(spark):
    made = model_queries.simulation_frame(spark, SF).select("season", "gameweek", "fixture", "team_uid", "player_uid", "goal_share").collect()
    rows = model_queries.expected_frame(spark, SF).select("season", "gameweek", "team_uid", "player_uid", "goal_share").collect()
    assert Counter((r.season, r.gameweek, r.team_uid, r.player_uid, round(r.goal_share, 9)) for r in made) == Counter((*r[:4], round(r.goal_share, 9)) for r in rows)
    assert max(Counter(r[:5] for r in made).values()) == 1 < max(Counter(r[:4] for r in rows).values())
    assert all(r.fixture % 10 == r.team_uid % 10 for r in made)


def test_simulations_take_the_production_draws(spark, monkeypatch):
    taken = []
    for name in ("simulate", "simulate_draws"):
        made = getattr(simulation, name)
        monkeypatch.setattr(simulation, name, lambda *a, made=made, **b: (taken.append(inspect.signature(made).bind(*a, **b)), made(*a, **b))[1])
    for name in ("simulate_fixture_points", "simulate_block_rollup"):
        catalogue.queries()[name](spark, SF)
    for call in taken:
        call.apply_defaults()
    assert [c.arguments["draws"] for c in taken] == [10_000, 10_000]


def test_audit_sees_every_player(spark):
    audited = catalogue.queries()["constraint_audit_all"](spark, SF).agg(F.sum("players")).first()[0]
    assert audited == league.table(spark, SF, "part").count()
