"""Point-in-time features of player fixtures, and the populations that depend on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitwise.operators import pit, relational

MEASURES = ["minutes", "starts", "total_points", "goals_scored", "assists"]


def player_history(panel: DataFrame) -> DataFrame:
    """Rolling and season-to-date sums of every row, the row included; what a later cutoff may look up."""
    order = ["available_time", "fixture_key"]
    df = panel.withColumn("appearance", (F.col("minutes") > 0).cast("long"))
    df = pit.rolling_sums(df, ["season", "player_uid"], order, MEASURES)
    df = pit.running_sums(df, ["season", "player_uid"], order, {"season_to_date_minutes": "minutes", "season_to_date_appearances": "appearance"})
    kept = [c for c in df.columns if c.startswith(("prev", "season_to_date"))]
    return df.select("season", "player_uid", "fixture_key", F.col("available_time").alias("player_source_time"), F.col("minutes").alias("prev_fixture_minutes"), *kept)


def player_features(panel: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """``targets`` (the panel itself, if none) with each row's history as of its cutoff and the player's season before."""
    history = player_history(panel)
    values = [c for c in history.columns if c.startswith(("prev", "season_to_date"))]
    out = pit.as_of(panel if targets is None else targets, history, ["season", "player_uid"], "information_cutoff", "player_source_time", "fixture_key", values)
    out = out.na.fill(0, [v for v in values if v != "prev_fixture_minutes"])
    prior = pit.prior_season(panel, "player_uid", "season", {"prior_season_minutes": F.sum("minutes"), "prior_season_appearances": F.count_if(F.col("minutes") > 0)})
    return out.join(prior, ["player_uid", "season"], "left")


def team_history(fixtures: DataFrame, size: int = 3) -> DataFrame:
    """Goals for and against over each team's last fixtures, the fixture included."""
    sides = relational.both_sides(fixtures, ["season", "fixture_key", "available_time"], {"team_uid": ("home_team_uid", "away_team_uid"), "goals": ("home_goals", "away_goals")})
    df = pit.rolling_sums(sides, ["season", "team_uid"], ["available_time", "fixture_key"], ["goals", "opponent_goals"], (size,))
    return df.select("season", "team_uid", "fixture_key", F.col("available_time").alias("team_source_time"), F.col(f"prev{size}_goals_sum").alias("goals_for"), F.col(f"prev{size}_opponent_goals_sum").alias("goals_against"))


def with_team_form(targets: DataFrame, history: DataFrame, roles: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Team history as of the cutoff, once per role: ``roles`` maps a prefix to (team column, values)."""
    for prefix, (team, values) in roles.items():
        named = history.select("season", F.col("team_uid").alias(team), "fixture_key", F.col("team_source_time").alias(f"{prefix}_source_time"), *[F.col(v).alias(f"{prefix}_{v}") for v in values])
        targets = pit.as_of(targets, named.withColumnRenamed("fixture_key", "_tie"), ["season", team], "information_cutoff", f"{prefix}_source_time", "_tie", [f"{prefix}_{v}" for v in values])
    return targets


def history_active(first_block: Column | None = None) -> Column:
    """Same-season minutes or appearances before the cutoff; in a first block, those of the season before."""
    now = (F.coalesce("prev5_minutes_sum", F.lit(0)) > 0) | (F.coalesce("season_to_date_appearances", F.lit(0)) > 0)
    before = (F.coalesce("prior_season_minutes", F.lit(0)) > 0) | (F.coalesce("prior_season_appearances", F.lit(0)) > 0)
    return now if first_block is None else F.when(first_block, before).otherwise(now)


def cold_start() -> Column:
    """No history of either kind."""
    parts = ["prev5_minutes_sum", "season_to_date_appearances", "prior_season_minutes", "prior_season_appearances"]
    return F.greatest(*[F.coalesce(p, F.lit(0)).cast("long") for p in parts]) <= 0


def running_active(df: DataFrame) -> DataFrame:
    """``ran_before``: minutes in earlier rows of the season by row order, not bounded by the cutoff."""
    return pit.running_sums(df, ["season", "player_uid"], ["kickoff_time", "fixture_key"], {"_m": "minutes"}, exclusive=True).withColumn("ran_before", F.col("_m") > 0).drop("_m")
