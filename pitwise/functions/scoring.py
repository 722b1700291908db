"""The points engine: realised and expected points as expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .probability import clip, poisson_floor_mean, poisson_tail
from .temporal import season_start

POSITIONS = ("GKP", "DEF", "MID", "FWD")


@dataclass(frozen=True)
class PointRules:
    """Fixed values of the scoring rules."""

    appearance: int = 1
    sixty_minutes: int = 1
    assist: int = 3
    clean_sheet_back: int = 4
    clean_sheet_mid: int = 1
    saves_per_point: int = 3
    penalty_save: int = 5
    penalty_miss: int = -2
    conceded_per_point: int = 2
    conceded: int = -1
    yellow_card: int = -1
    red_card: int = -3
    own_goal: int = -2
    defensive: int = 2
    defensive_from: tuple[tuple[str, int], ...] = (("DEF", 10), ("MID", 12), ("FWD", 12))
    goal: tuple[tuple[str, int], ...] = (("DEF", 6), ("MID", 5), ("FWD", 4))
    keeper_goal: int = 6
    keeper_goal_new: int = 10
    keeper_goal_new_from: int = 2024


RULES = PointRules()


def by_position(position: Column, values: dict[str, float], other: Column | float | None = None) -> Column:
    """The value of each position; ``other`` (null if not given) elsewhere."""
    out = None
    for name, value in values.items():
        out = F.when(position == name, F.lit(value)) if out is None else out.when(position == name, F.lit(value))
    return out.otherwise(other if isinstance(other, Column) else F.lit(other))


def goal_value(season: Column, position: Column, rules: PointRules = RULES) -> Column:
    """Points of a goal under the rules of the season; an error for other positions and malformed seasons."""
    keeper = F.when(season_start(season) >= rules.keeper_goal_new_from, rules.keeper_goal_new).otherwise(rules.keeper_goal)
    invalid = F.raise_error(F.concat(F.lit("no such position: "), F.coalesce(position, F.lit("null")))).cast("int")
    return F.when(position == "GKP", keeper).otherwise(by_position(position, dict(rules.goal), invalid))


def _count(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("long")


def realised_components(rules: PointRules = RULES) -> dict[str, Column]:
    """Points by component from event counts; nulls count as 0."""
    position, minutes = F.col("position"), _count("minutes")
    back = position.isin("GKP", "DEF")
    sheet = F.when(back, rules.clean_sheet_back).when(position == "MID", rules.clean_sheet_mid).otherwise(0)
    reach = by_position(position, dict(rules.defensive_from))
    whole = lambda n, by: F.floor(_count(n) / by).cast("long")
    return {
        "points_appearance": F.when(minutes >= 60, rules.appearance + rules.sixty_minutes).when(minutes > 0, rules.appearance).otherwise(0),
        "points_goals": _count("goals_scored") * goal_value(F.col("season"), position, rules),
        "points_assists": _count("assists") * rules.assist,
        "points_clean_sheets": F.when(minutes >= 60, _count("clean_sheets") * sheet).otherwise(0),
        "points_saves": whole("saves", rules.saves_per_point),
        "points_penalties": _count("penalties_saved") * rules.penalty_save + _count("penalties_missed") * rules.penalty_miss,
        "points_goals_conceded": F.when(back, whole("goals_conceded", rules.conceded_per_point) * rules.conceded).otherwise(0),
        "points_cards": _count("yellow_cards") * rules.yellow_card + _count("red_cards") * rules.red_card,
        "points_own_goals": _count("own_goals") * rules.own_goal,
        "points_bonus": _count("bonus"),
        "points_defensive_contribution": F.when(_count("defensive_contribution") >= reach, rules.defensive).otherwise(0),
    }


def realised_points(rules: PointRules = RULES) -> Column:
    """Total realised points of a row."""
    total = None
    for part in realised_components(rules).values():
        total = part if total is None else total + part
    return total.cast("long")


def expected_components(rules: PointRules = RULES) -> dict[str, Column]:
    """Expected points by component, from expected counts, appearance and 60-minute probabilities."""
    position = F.col("position")
    back = position.isin("GKP", "DEF")
    x = lambda n: F.coalesce(F.col(n), F.lit(0)).cast("double")
    plays = clip(x("p_appearance"), 0, 1)
    given = lambda n: F.greatest(x(n), F.lit(0.0)) / F.when(plays > 0, plays).otherwise(1.0)
    sheet = F.when(back, rules.clean_sheet_back).when(position == "MID", rules.clean_sheet_mid).otherwise(0)
    defensive = None
    for name, reach in rules.defensive_from:
        tail = plays * poisson_tail(given("expected_defensive_contribution"), reach) * rules.defensive
        defensive = F.when(position == name, tail) if defensive is None else defensive.when(position == name, tail)
    return {
        "expected_points_appearance": x("p_appearance") + x("p_reached_60"),
        "expected_points_goals": x("expected_goals") * goal_value(F.col("season"), position, rules),
        "expected_points_assists": x("expected_assists") * rules.assist,
        "expected_points_clean_sheets": x("clean_sheet_probability") * sheet,
        "expected_points_saves": plays * poisson_floor_mean(given("expected_saves"), rules.saves_per_point),
        "expected_points_penalties": x("expected_penalty_saves") * rules.penalty_save + x("expected_penalty_misses") * rules.penalty_miss,
        "expected_points_goals_conceded": F.when(back, rules.conceded * poisson_floor_mean(F.greatest(x("opponent_expected_goals"), F.lit(0.0)), rules.conceded_per_point) * x("p_reached_60")).otherwise(0.0),
        "expected_points_cards": x("expected_yellow_cards") * rules.yellow_card + x("expected_red_cards") * rules.red_card,
        "expected_points_own_goals": x("expected_own_goals") * rules.own_goal,
        "expected_points_defensive_contribution": defensive.otherwise(0.0),
        "expected_points_bonus": x("expected_bonus"),
    }


def selling_price(bought: Column, now: Column, fee: float = 0.5) -> Column:
    """The price now if it fell; else the purchase price and what the fee leaves of the gain, rounded down."""
    return F.when(now <= bought, now).otherwise(bought + F.floor((now - bought) * (1 - fee)).cast("long"))


def duration_state(minutes: Column, starts: Column) -> Column:
    """One of six states by start and minutes."""
    started = starts > 0
    return (
        F.when(F.coalesce(minutes, F.lit(0)) <= 0, "DNP")
        .when(~started & (minutes < 60), "SUB_UNDER_60")
        .when(~started, "SUB_60_PLUS")
        .when(minutes < 60, "START_UNDER_60")
        .when(minutes < 90, "START_60_TO_89")
        .otherwise("START_90")
    )
