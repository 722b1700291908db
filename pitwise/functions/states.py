"""States of an operational run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the states.
STATES = (
    "WAITING_FOR_SEASON_LAUNCH",
    "READY_TO_REFRESH",
    "REFRESHING",
    "NEEDS_RULE_REVIEW",
    "NEEDS_TEAM_IDENTITY_REVIEW",
    "NEEDS_PLAYER_IDENTITY_REVIEW",
    "NO_FORECASTABLE_GAMEWEEK",
    "SUCCEEDED",
    "FAILED_USING_LAST_SUCCESS",
)


def run_state(launched: Column, rules_known: Column, teams_known: Column, players_known: Column, forecastable: Column, outcome: Column) -> Column:
    """The state of a run: the first thing that holds it up, else how far it is; ``outcome`` is null, running, done or failed.

    A check that is null holds a run up like one that failed.
    """
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(no(launched), "WAITING_FOR_SEASON_LAUNCH")
        .when(no(rules_known), "NEEDS_RULE_REVIEW")
        .when(no(teams_known), "NEEDS_TEAM_IDENTITY_REVIEW")
        .when(no(players_known), "NEEDS_PLAYER_IDENTITY_REVIEW")
        .when(no(forecastable), "NO_FORECASTABLE_GAMEWEEK")
        .when(outcome == "running", "REFRESHING")
        .when(outcome == "done", "SUCCEEDED")
        .when(outcome == "failed", "FAILED_USING_LAST_SUCCESS")
        .otherwise("READY_TO_REFRESH")
    )
