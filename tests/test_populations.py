"""Reasons, bounds, ranks and labels on small tables."""

import pytest
from pyspark.sql import functions as F

from pitwise.operators import metrics, quality, relational
from pitwise.plans import decisions


def test_reasons_come_in_order(spark):
    rows = [(1, "player", True, False), (2, "manager", False, True), (3, "manager", False, None), (4, None, None, None), (5, "player", None, None)]
    df = spark.createDataFrame(rows, "id long, entity_type string, can_select boolean, removed boolean")
    found = {r.id: r.why for r in df.select("id", quality.exclusion_reason(df).alias("why")).collect()}
    assert found == {1: None, 2: "official_removed_true", 3: "official_can_select_false", 4: "non_player_entity", 5: None}
    bare = df.select("id")
    assert all(r.why is None for r in bare.select(quality.exclusion_reason(bare).alias("why")).collect())


GOOD = {"player_uid": "a", "player": "A B", "team": "T", "position": "MID", "price_tenths": "55", "expected_points": "4.5", "expected_minutes": "80", "p_appearance": "0.9", "p_start": "0.9", "prob_points_ge_5": "0.3"}
BAD = [("player_uid", " "), ("player", None), ("team", ""), ("position", "AM"), ("position", None), ("price_tenths", "0"), ("price_tenths", "5.5"), ("price_tenths", "x"), ("expected_points", "-1"), ("expected_points", "NaN"), ("expected_points", "Infinity"), ("expected_minutes", "91"), ("p_appearance", "1.1"), ("p_start", "0.95"), ("p_start", None), ("prob_points_ge_5", "2")]


def test_valid_forecast_rows(spark):
    rows = [GOOD, *[{**GOOD, k: v} for k, v in BAD]]
    df = spark.createDataFrame([tuple(r[c] for c in GOOD) for r in rows], ", ".join(f"{c} string" for c in GOOD))
    assert [r.ok for r in df.select(quality.valid_forecast().alias("ok")).collect()] == [True] + [False] * len(BAD)


def test_percent_rank(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 3.0), ("a", None), ("b", 7.0)], "g string, v double")
    found = metrics.with_percent_rank(df, ["g"], "v", "r").collect()
    assert sorted((r.g, r.v or 0, None if r.r is None else round(r.r, 6)) for r in found) == [("a", 0, None), ("a", 1.0, 0.5), ("a", 1.0, 0.5), ("a", 3.0, 1.0), ("b", 7.0, 1.0)]


def test_unstacked_populations(spark):
    df = spark.createDataFrame([("s", "x"), ("s", "x"), ("t", None)], "season string, p string")
    assert {tuple(r) for r in relational.unstacked(df, ["season"], "p", ["x", "y"]).collect()} == {("s", 2, 0), ("t", 0, 0)}


def test_squad_sheet(spark):
    rows = [(1, "captain", 0), (2, "vice_captain", None), (3, "starter", 0), (4, "squad", 1), (5, "squad", 3), (6, "squad", 2), (7, "squad", None)]
    df = spark.createDataFrame([(0, *r) for r in rows], "block long, player_uid long, selected_role string, bench_order int")
    found = decisions.squad_sheet(df, ["block"]).orderBy("shown_at").collect()
    assert [(r.player_uid, r.label) for r in found] == [(1, "Captain"), (2, "Vice captain"), (3, "Starter"), (7, "Starter"), (4, "Bench goalkeeper"), (6, "Bench 1"), (5, "Bench 2")]


@pytest.mark.parametrize("most", [0, 1, 3])
def test_no_transfer_is_a_legal_set(spark, most):
    squad = spark.createDataFrame([(0, "c")] * 3, "block long, club string")
    options = spark.createDataFrame([(0, 1, 50, "c", 9, 90, "d", 4.0)], "block long, out_uid long, out_price long, out_club string, in_uid long, in_price long, in_club string, gain double")
    legal = decisions.legal_transfer_sets(squad, options, ["block"], 10, most).select("gain", "bank", F.size("moves")).collect()
    assert [tuple(r) for r in legal] == [(0.0, 10, 0)]
