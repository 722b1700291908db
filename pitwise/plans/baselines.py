"""Chronological baselines for all folds in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwise.functions.probability import per_90
from pitwise.operators import metrics, pit

NAMES = ["B0_ZERO", "B1_GLOBAL_MEAN", "B2_POSITION_MEAN", "B3_RECENT_POINTS_P3", "B3_RECENT_POINTS_P5", "B4_RECENT_MINUTES_P3", "B4_RECENT_MINUTES_P5", "B5_EB_POINTS_PER90", "B6_PREVIOUS_SEASON_GW1"]
#: Minutes a match can have, matches of prior in the shrunk rate.
MINUTES_CAP, PRIOR_MATCHES = 90, 5


def training_statistics(panel: DataFrame, folds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per fold, and per fold and position: sums of points and minutes over what was known before the cutoff."""
    sums = {"n": F.lit(1), "points": F.col("total_points"), "played": F.col("minutes")}
    total = pit.training_totals(panel, folds, "available_time", "information_cutoff", sums)
    place = pit.training_totals(panel, folds, "available_time", "information_cutoff", sums, ["position"])
    named = total.select("fold_id", (F.col("points") / F.col("n")).alias("global_mean"), per_90(F.col("points"), F.col("played"), F.col("points") / F.col("n")).alias("global_per90"))
    mean = F.col("points") / F.col("n")
    place = place.select("fold_id", "position", mean.alias("position_mean"), F.when(F.col("played") > 0, F.col("points") * 90.0 / F.col("played")).alias("position_per90"))
    return named.filter("global_mean is not null"), place


def predict(features: DataFrame, panel: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold_id, player_uid, fixture_key, season, gameweek, position, total_points, baseline, prediction), long.

    Folds without any training row make no predictions.
    """
    total, place = training_statistics(panel, folds)
    df = features.join(F.broadcast(folds.select("season", "gameweek", "fold_id")), ["season", "gameweek"])
    df = df.join(F.broadcast(total), "fold_id").join(place, ["fold_id", "position"], "left")
    mean, rate = F.col("global_mean"), F.coalesce("position_per90", "global_mean")
    games = F.coalesce("season_to_date_appearances", F.lit(0))
    prior = PRIOR_MATCHES * 90.0
    made = {"B0_ZERO": F.lit(0.0), "B1_GLOBAL_MEAN": mean, "B2_POSITION_MEAN": F.coalesce("position_mean", mean)}
    for n in (3, 5):
        made[f"B3_RECENT_POINTS_P{n}"] = F.when(games > 0, F.col(f"prev{n}_total_points_sum") / F.least(games, F.lit(n))).otherwise(mean)
        made[f"B4_RECENT_MINUTES_P{n}"] = F.least(F.col(f"prev{n}_minutes_sum") / float(n), F.lit(float(MINUTES_CAP))) / 90.0 * rate
    recent = F.coalesce("prev5_minutes_sum", F.lit(0))
    shrunk = (F.coalesce("prev5_total_points_sum", F.lit(0)) * 90.0 + F.col("global_per90") * prior) / (recent + prior)
    made["B5_EB_POINTS_PER90"] = F.least(recent / 5.0, F.lit(float(MINUTES_CAP))) / 90.0 * shrunk
    before = previous_season_rates(panel)
    df = df.join(before, ["player_uid", "season"], "left")
    played, points, times = F.col("before_minutes"), F.col("before_points"), F.col("before_appearances")
    typical = F.least(played / F.greatest(times, F.lit(1)), F.lit(float(MINUTES_CAP)))
    made["B6_PREVIOUS_SEASON_GW1"] = F.when((played > 0) & (times > 0), typical / 90.0 * (points * 90.0 + F.col("global_per90") * prior) / (played + prior)).otherwise(mean)
    keys = ["fold_id", "player_uid", "fixture_key", "season", "gameweek", "position", "total_points"]
    wide = df.select(*keys, *[v.cast("double").alias(n) for n, v in made.items()])
    return wide.unpivot(keys, NAMES, "baseline", "prediction")


def previous_season_rates(panel: DataFrame) -> DataFrame:
    """Sums of the calendar season before, which lies wholly before any cutoff of the season."""
    sums = {"before_points": F.sum("total_points"), "before_minutes": F.sum("minutes"), "before_appearances": F.count_if(F.col("minutes") > 0)}
    return pit.prior_season(panel, "player_uid", "season", sums, calendar=True).drop("prior_source_season")


def by_player_block(predictions: DataFrame) -> DataFrame:
    """Fixtures of one player in one block added up."""
    keys = ["fold_id", "season", "gameweek", "player_uid", "baseline"]
    return predictions.groupBy(*keys).agg(F.min("position").alias("position"), F.sum("prediction").alias("prediction"), F.sum("total_points").alias("total_points"), F.count_distinct("fixture_key").alias("fixtures"))


def scores(predictions: DataFrame) -> DataFrame:
    return metrics.errors_with_rank_correlation(predictions, ["baseline"], "prediction", "total_points")
