"""Component rates of players and the expectations built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwise.functions.probability import clip, per_90, shrunk_mean
from pitwise.functions.scoring import by_position

# Minutes of prior, blend of transferred players, bounds and priors.
SHRINK_MINUTES, KEEP_OWN = 900.0, 0.72
ASSISTED_PRIOR, ASSISTED_BOUNDS = 0.72, (0.25, 0.95)
GOAL_PRIOR = {"GKP": 0.001, "DEF": 0.020, "MID": 0.080, "FWD": 0.140}
ASSIST_PRIOR = {"GKP": 0.001, "DEF": 0.025, "MID": 0.080, "FWD": 0.060}
EVENTS = ["goals_scored", "assists", "saves", "penalties_saved", "penalties_missed", "yellow_cards", "red_cards", "own_goals", "bonus", "bps", "defensive_contribution"]
#: Largest expected count of a rare event in one match.
CAPS = {"penalties_saved": 0.15, "penalties_missed": 0.15, "yellow_cards": 0.5, "red_cards": 0.15, "own_goals": 0.15, "bonus": 3.0}


def position_rates(train: DataFrame) -> DataFrame:
    """(position, {event}_position): events per 90 minutes of all players of a position."""
    sums = train.groupBy("position").agg(F.sum("minutes").alias("m"), *[F.sum(e).alias(e) for e in EVENTS])
    return sums.select("position", *[per_90(F.col(e), F.col("m")).alias(f"{e}_position") for e in EVENTS])


def player_rates(train: DataFrame) -> DataFrame:
    """(player_uid, {event}_rate): per 90 minutes, shrunk to the rate of the player's latest position."""
    latest = F.max_by("position", F.struct("season", "gameweek", "fixture_key"))
    sums = train.groupBy("player_uid").agg(F.sum("minutes").alias("m"), latest.alias("position"), *[F.sum(e).alias(e) for e in EVENTS])
    joined = sums.join(F.broadcast(position_rates(train)), "position")  # one row per position
    rate = lambda e: shrunk_mean(F.col(e) * 90.0, F.col("m"), F.col(f"{e}_position"), SHRINK_MINUTES)
    return joined.select("player_uid", *[rate(e).alias(f"{e}_rate") for e in EVENTS])


def assisted_rate(train: DataFrame) -> DataFrame:
    """One row: assists per goal, held within bounds."""
    ratio = F.when(F.sum("goals_scored") > 0, F.sum("assists") / F.sum("goals_scored")).otherwise(ASSISTED_PRIOR)
    return train.agg(clip(ratio, *ASSISTED_BOUNDS).alias("assisted_goal_rate"))


def rates_for(test: DataFrame, train: DataFrame) -> DataFrame:
    """``test`` with ``{event}_per90``: own rate, else the position's; newcomers of a club blended, cold starts the position's."""
    df = test.join(player_rates(train), "player_uid", "left").join(F.broadcast(position_rates(train)), "position", "left")
    return rates_given(df).crossJoin(F.broadcast(assisted_rate(train)))  # one row


def rates_given(df: DataFrame) -> DataFrame:
    """``{event}_per90`` from the ``{event}_rate`` and ``{event}_position`` of each row (null: none known)."""
    flag = lambda n: F.coalesce(F.col(n), F.lit(False)) if n in df.columns else F.lit(False)

    def rate(event: str) -> Column:
        place = F.coalesce(f"{event}_position", F.lit(0.0))
        own = F.greatest(F.coalesce(f"{event}_rate", place), F.lit(0.0))
        return F.when(flag("cold_start"), place).when(flag("transferred"), KEEP_OWN * own + (1 - KEEP_OWN) * place).otherwise(own)

    made = df.withColumns({f"{e}_per90": rate(e) for e in EVENTS})
    made = made.withColumns({f"{e}_fallback": F.col(f"{e}_rate").isNull() for e in ("goals_scored",)})
    return made.drop(*[f"{e}_{k}" for e in EVENTS for k in ("rate", "position")])


def attacking_shares(df: DataFrame, team: list[str]) -> DataFrame:
    """Shares of a team's goals and assists, their concentration and effective numbers of players."""
    exposure = clip(F.coalesce("expected_minutes", F.lit(0.0)), 0, 90) / 90
    plays = clip(F.coalesce("p_appearance", F.lit(0.0)), 0, 1)
    cold = F.coalesce(F.col("cold_start"), F.lit(False)) if "cold_start" in df.columns else F.lit(False)
    active = F.greatest(exposure, plays * 0.10)
    df = df.withColumn("active_weight", F.when(cold, F.greatest(active, plays * 0.35)).otherwise(active))
    w = Window.partitionBy(*team)
    for kind, rate, prior in (("goal", "goals_scored_per90", GOAL_PRIOR), ("assist", "assists_per90", ASSIST_PRIOR)):
        own = F.col(rate) * F.col("active_weight")
        floor = by_position(F.col("position"), prior, 0.01)
        df = df.withColumn("_w", F.when(own > 0, own).otherwise(floor * F.col("active_weight")))
        df = df.withColumn(f"{kind}_weight", F.when(F.sum("_w").over(w) > 0, F.col("_w")).otherwise(floor)).drop("_w")
        df = df.withColumn(f"{kind}_share", F.col(f"{kind}_weight") / F.sum(f"{kind}_weight").over(w))
        df = df.withColumn(f"{kind}_share_hhi", F.sum(F.col(f"{kind}_share") * F.col(f"{kind}_share")).over(w))
        df = df.withColumn(f"effective_{kind}_attackers", 1.0 / F.col(f"{kind}_share_hhi"))
    return df


def expectations(df: DataFrame, constrained: bool = True) -> DataFrame:
    """Expected counts of a match; goals from the team's expectation by share, or from the player's own rates."""
    exposure = clip(F.coalesce("expected_minutes", F.lit(0.0)), 0, 90) / 90
    reach = F.coalesce("p_reached_60", F.lit(0.0))
    keeper = F.col("position") == "GKP"
    count = lambda e: F.col(f"{e}_per90") * exposure if e not in CAPS else clip(F.col(f"{e}_per90") * exposure, 0, CAPS[e])
    if constrained:
        goals = F.col("team_expected_goals") * F.col("goal_share")
        assists = F.col("team_expected_goals") * F.col("assisted_goal_rate") * F.col("assist_share")
    else:
        goals, assists = F.col("goals_scored_per90") * exposure, F.col("assists_per90") * exposure
    return df.withColumns({
        "expected_goals": goals,
        "expected_assists": assists,
        "clean_sheet_probability": F.exp(-F.col("opponent_expected_goals")) * reach,
        "expected_saves": F.when(keeper, count("saves")).otherwise(0.0),
        "expected_penalty_saves": F.when(keeper, count("penalties_saved")).otherwise(0.0),
        "expected_penalty_misses": count("penalties_missed"),
        "expected_yellow_cards": count("yellow_cards"),
        "expected_red_cards": count("red_cards"),
        "expected_own_goals": count("own_goals"),
        "expected_defensive_contribution": count("defensive_contribution"),
        "expected_bonus": count("bonus"),
    })


def conservation(df: DataFrame, team: list[str]) -> DataFrame:
    """Goals handed out to players against the team's expectation."""
    sums = df.groupBy(*team).agg(F.sum("expected_goals").alias("allocated"), F.max("team_expected_goals").alias("expected"), F.sum("goal_share").alias("share_sum"))
    return sums.withColumn("error", F.col("allocated") - F.col("expected"))
