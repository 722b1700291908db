"""The chain: coming rows know no outcomes, every model forecasts every row, gates and states tell what holds them up."""

import json

import pytest
from pyspark.sql import functions as F

from pitwise.functions import states
from pitwise.operators import quality
from pitwise.plans import catalogue, chain, chain_queries, features, league
from pitwise.sources import snapshots

SF = "/root/testdata/sf0.001"


def test_coming_rows_do_not_depend_on_their_outcomes(spark):
    panel = league.panel(spark, SF)
    last = chain.last_block(panel)
    season, gameweek = last.first()
    in_block = (F.col("season") == season) & (F.col("gameweek") == gameweek)
    lost = panel.withColumns({c: F.when(~in_block, F.col(c)) for c in ("minutes", "starts", "total_points", "goals_scored", "assists")})
    names = chain_queries._COMING
    told = sorted(map(str, chain.coming_rows(lost, last).select(*names).collect()))
    assert told and told == sorted(map(str, features.player_features(panel).filter(in_block).select(*names).collect()))


def test_models_take_no_outcomes(spark):
    df = league.panel(spark, SF)
    with pytest.raises(ValueError, match="outcome columns"):
        chain.model_rows(df, df, df.select("fixture_key", F.lit(0.0).alias("prediction")), ["M3"])


def test_every_model_forecasts_every_row_and_hands_out_all_goals(spark):
    rows = catalogue.queries()["xpoints_models"](spark, SF).join(league.panel(spark, SF).select("fixture_key", "team_uid"), "fixture_key").cache()
    want = league.panel(spark, SF).filter("season = '2024-25'").count()
    counts = {r.model: r["count"] for r in rows.groupBy("model").count().collect()}
    assert counts == dict.fromkeys((chain.REFERENCE, chain.INDEPENDENT, *(chain.CONSTRAINED + v for v in ("M3", "M5", "M7"))), want)
    given = rows.filter(F.col("model").startswith("X2")).groupBy("model", "gameweek", "team_uid").agg(F.sum("expected_goals").alias("g")).collect()
    assert given and all(abs(r.g - (1 + r.team_uid % 4 / 4)) < 1e-6 for r in given)


def test_projections_and_blanks(spark):
    rows = spark.createDataFrame([("m", "s", 1, 1, 2.0, 0.5, 0.5, 60.0), ("m", "s", 1, 1, 1.0, 0.5, 0.0, 30.0), ("m", "s", 1, 2, 0.0, 0.0, 0.0, 0.0)], "model string, season string, gameweek long, player_uid long, expected_points double, p_appearance double, p_start double, expected_minutes double")
    made = chain.block_projections(rows)
    one, two = made.orderBy("player_uid").collect()
    assert (one.fixture_count, one.expected_points, one.p_appearance, one.p_start, one.expected_minutes, one.expected_points_given_appearance) == (2, 3.0, 0.75, 0.5, 45.0, 4.0)
    assert two.expected_points_given_appearance == 0.0
    pool = spark.createDataFrame([("s", 1, 1), ("s", 1, 9)], "season string, gameweek long, player_uid long")
    out = {r.player_uid: r for r in chain.with_blanks(made, pool, pool.columns).collect()}
    assert out[1].expected_points == 3.0 and out[9].expected_points == out[9].p_appearance == out[9].fixture_count == 0
    assert chain.block_projections(rows.limit(0)).count() == 0


def test_gates_tell_what_is_wrong(spark):
    schema = "season string, gameweek long, player_uid long, price_tenths long, expected_minutes double, p_appearance double, p_start double, expected_points double, expected_points_given_appearance double"
    good = [("s", 1, 1, 50, 45.0, 0.5, 0.4, 2.0, 4.0), ("s", 1, 2, 50, 0.0, 0.0, 0.0, 0.0, 0.0)]
    gates = lambda rows: {r.gate: r.passed for r in chain.publication_gates(spark.createDataFrame(rows, schema)).collect()}
    assert all(gates(good).values())
    faults = {
        "projection_keys_unique": good[0], "identity_coverage": ("s", 1, None, *good[0][3:]), "official_prices_present": ("s", 1, 3, None, *good[0][4:]), "expected_minutes_valid": ("s", 1, 3, 50, None, *good[0][5:]),
        "appearance_at_least_start": ("s", 1, 3, 50, 45.0, 0.5, 0.6, 2.0, 4.0), "nonnegative_xpoints": (*("s", 1, 3), *good[0][3:7], -1.0, 4.0), "conditional_xpoints_finite": (*("s", 1, 3), *good[0][3:8], float("nan")),
    }
    for gate, row in faults.items():
        assert {g for g, ok in gates([*good, row]).items() if not ok} == {gate}
    assert not gates([])["projections_present"]


def test_validity_of_empty_tables(spark):
    minutes = spark.createDataFrame([], "season string, player_uid long, fixture_key long, minutes long, starts long, player_source_time timestamp, information_cutoff timestamp")
    assert {r.rows for r in quality.minutes_faults(minutes, ["season", "player_uid", "fixture_key"]).collect()} == {0}
    assert quality.missing_by(minutes, ["season"], ["minutes"]).count() == 0


def test_states(spark):
    rows = [(True, True, True, True, True, o) for o in (None, "running", "done", "failed")] + [tuple(j != i for j in range(5)) + ("done",) for i in range(5)] + [(None, True, True, True, True, "done")]
    df = spark.createDataFrame(rows, "a boolean, b boolean, c boolean, d boolean, e boolean, o string").coalesce(1)
    got = [r[0] for r in df.select(states.run_state(*[F.col(c) for c in "abcdeo"])).collect()]
    assert got == ["READY_TO_REFRESH", "REFRESHING", "SUCCEEDED", "FAILED_USING_LAST_SUCCESS", "WAITING_FOR_SEASON_LAUNCH", "NEEDS_RULE_REVIEW", "NEEDS_TEAM_IDENTITY_REVIEW", "NEEDS_PLAYER_IDENTITY_REVIEW", "NO_FORECASTABLE_GAMEWEEK", "WAITING_FOR_SEASON_LAUNCH"]
    assert set(got) == set(states.STATES)


def test_pinned_source(tmp_path):
    at = {"http://x/branch": json.dumps({"commit": {"sha": "abc"}}).encode(), "http://x/raw/abc/data/2024-25/gws/merged.csv": b"a,b\n1,2\n"}
    revision = snapshots.resolve_revision("http://x/branch", at.__getitem__)
    path = snapshots.take_pinned(tmp_path, "http://x/raw/", revision, "2024-25", "gws/merged.csv", at.__getitem__)
    assert path.read_bytes() == b"a,b\n1,2\n" and snapshots.read_metadata(path)["revision"] == "abc"
    for wrong in (b"{}", b"[]", b'{"commit": {"sha": ""}}', b"no json"):
        with pytest.raises(ValueError, match="no revision"):
            snapshots.resolve_revision("u", lambda _, w=wrong: w)
