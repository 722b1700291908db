"""The chain from coming fixtures to a decision: target rows, expectations of every model, projections of a block, evaluation."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitwise.functions import scoring
from pitwise.operators import quality, relational

from . import components, decisions, features, minutes, simulation

IDENTITY = ["season", "gameweek", "player_uid", "fixture_key", "position", "team_uid", "opponent_uid", "was_home", "kickoff_time", "information_cutoff"]
#: What is known of a fixture only once it has been played.
OUTCOMES = {"minutes", "starts", "total_points", "clean_sheets", "goals_conceded", "state", "appearance", "available_time", *components.EVENTS}
TEAM = ["season", "gameweek", "team_uid"]
MINUTES = ["p_appearance", "p_start", "p_reached_60", "expected_minutes"]
#: Names of the models.
REFERENCE, INDEPENDENT, CONSTRAINED = "X0_PHASE3_B5_EB_POINTS_PER90", "X1_INDEPENDENT_COMPONENT_RATES_M3", "X2_TEAM_CONSTRAINED_SIM_"
SOFTMAX_NUMERIC = ["lag1_minutes_mean", "lag3_minutes_mean", "lag5_minutes_mean", "lag5_starts_mean", "prior_season_minutes"]


def last_block(panel: DataFrame) -> DataFrame:
    """One row: the season and gameweek that come last."""
    return panel.agg(F.max(F.struct("season", "gameweek")).alias("b")).select("b.*")


def coming_rows(panel: DataFrame, block: DataFrame) -> DataFrame:
    """Feature rows of the fixtures of ``block``, made of their identities and of what was available before the cutoff."""
    targets = panel.join(relational.small(block), ["season", "gameweek"]).select(*IDENTITY)
    return features.player_features(panel, targets)


def played_minutes(train: DataFrame, frame: DataFrame, variants: list[str]) -> DataFrame:
    """(fixture_key, variant, probabilities, expected minutes) of the named minutes models, long."""
    made = {
        "M3": lambda: frame.withColumn("states", minutes.two_state(minutes.ewma_minutes())),
        "M5": lambda: minutes.softmax_states(train, frame, SOFTMAX_NUMERIC, ["position"], "fixture_key", "available_time"),
        "M7": lambda: minutes.hierarchical(train, frame),
    }
    told = minutes.summary_probabilities(F.col("states"))
    return reduce(DataFrame.unionByName, [made[v]().select("fixture_key", F.lit(v).alias("variant"), *[told[n].alias(n) for n in MINUTES]) for v in variants])


def with_points(df: DataFrame) -> DataFrame:
    """``df`` with expected points by component and in all."""
    parts = scoring.expected_components()
    return df.withColumns(parts).withColumn("expected_points", reduce(add, [F.col(n) for n in parts]))


def model_rows(train: DataFrame, frame: DataFrame, reference: DataFrame, variants: list[str]) -> DataFrame:
    """Rows of every model for each row of ``frame``: the reference forecast, independent rates, team-constrained rates by minutes model.

    ``frame`` has features and the team expectations but no outcomes; ``reference`` is
    (fixture_key, prediction). Rows that it lacks are forecast as 0, and its component values are 0.
    """
    frame = quality.target_free(frame, OUTCOMES)
    rated = components.rates_for(frame, train).join(played_minutes(train, frame, variants), "fixture_key")
    shared = components.attacking_shares(rated, [*TEAM, "variant"])
    held = with_points(components.expectations(shared)).withColumn("model", F.concat(F.lit(CONSTRAINED), "variant"))
    free = with_points(components.expectations(shared.filter("variant = 'M3'"), constrained=False)).withColumn("model", F.lit(INDEPENDENT))
    names = ["model", *IDENTITY, *MINUTES, "expected_goals", "expected_assists", *scoring.expected_components(), "expected_points"]
    direct = frame.join(reference.select("fixture_key", F.coalesce("prediction", F.lit(0.0)).alias("expected_points")), "fixture_key", "left").na.fill(0.0, ["expected_points"])
    blank = {n: F.lit(None).cast("double") for n in MINUTES} | {n: F.lit(0.0) for n in names if n.startswith("expected_") and n not in ("expected_points", "expected_minutes")}
    direct = direct.withColumns({"model": F.lit(REFERENCE), **blank})
    return reduce(DataFrame.unionByName, [x.select(*names) for x in (direct, free, held)])


def any_of(p: str) -> Column:
    return simulation.any_appearance(p)


def block_projections(rows: DataFrame) -> DataFrame:
    """Fixtures of a player in a block added up: points, chances to play at all, points if the player appears."""
    made = rows.groupBy("model", "season", "gameweek", "player_uid").agg(
        F.count(F.lit(1)).alias("fixture_count"),
        F.avg("expected_minutes").alias("expected_minutes"),
        any_of("p_appearance").alias("p_appearance"),
        any_of("p_start").alias("p_start"),
        F.sum("expected_points").alias("expected_points"),
    )
    return made.withColumn("expected_points_given_appearance", F.when(F.col("p_appearance") > 0, F.col("expected_points") / F.col("p_appearance")).otherwise(0.0))


def with_blanks(projections: DataFrame, pool: DataFrame, keys: list[str]) -> DataFrame:
    """``pool`` with its projections; players without a fixture in the block get zeros."""
    zeros = {"fixture_count": 0, "expected_minutes": 0.0, "p_appearance": 0.0, "p_start": 0.0, "expected_points": 0.0, "expected_points_given_appearance": 0.0}
    return pool.join(projections.select(*keys, *zeros), keys, "left").na.fill(zeros)


def publication_gates(projections: DataFrame, price: str = "price_tenths") -> DataFrame:
    """(gate, passed) of the projections of one model and block, in one pass besides the count of keys."""
    every = lambda c: F.count_if(~F.coalesce(c, F.lit(False))) == 0
    finite = lambda n: F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
    keys = projections.groupBy("season", "gameweek", "player_uid").agg(F.count(F.lit(1)).alias("n"), *[F.min(F.struct(n)).getField(n).alias(n) for n in (price, "expected_minutes", "p_appearance", "p_start", "expected_points", "expected_points_given_appearance")])
    checks = {
        "projections_present": F.count(F.lit(1)) > 0,
        "projection_keys_unique": every(F.col("n") == 1),
        "identity_coverage": every(F.col("player_uid").isNotNull()),
        "official_prices_present": every(F.col(price).isNotNull()),
        "expected_minutes_valid": every(F.col("expected_minutes").between(0, 90)),
        "p_appearance_valid": every(F.col("p_appearance").between(0, 1)),
        "p_start_valid": every(F.col("p_start").between(0, 1)),
        "appearance_at_least_start": every(F.col("p_appearance") >= F.col("p_start")),
        "nonnegative_xpoints": every(F.col("expected_points") >= 0),
        "conditional_xpoints_finite": every(finite("expected_points_given_appearance")),
    }
    return quality.gate_rows(keys, checks)


def frozen_scores(rows: DataFrame, actual: DataFrame) -> DataFrame:
    """(part, metric, value): forecasts frozen before a season against what came; outcomes are joined only here."""
    df = rows.join(actual.select("fixture_key", F.col("minutes").alias("_m"), F.col("starts").alias("_s"), F.col("total_points").alias("_p")), "fixture_key")
    square = lambda p, y: F.avg(F.pow(F.col(p) - F.when(F.col(y) > 0, 1.0).otherwise(0.0), 2))
    made = {}
    for part, p, y in (("minutes", "expected_minutes", "_m"), ("xpoints", "expected_points", "_p")):
        e = F.col(p) - F.col(y)
        made |= {(part, "rows"): F.count(F.lit(1)).cast("double"), (part, "mae"): F.avg(F.abs(e)), (part, "rmse"): F.sqrt(F.avg(e * e)), (part, "bias"): F.avg(e)}
    made |= {("minutes", "appearance_brier"): square("p_appearance", "_m"), ("minutes", "start_brier"): square("p_start", "_s"), ("xpoints", "negative_expected_points"): F.count_if(F.col("expected_points") < 0).cast("double")}
    wide = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(made.values())])
    pairs = F.array(*[F.struct(F.lit(a).alias("part"), F.lit(b).alias("metric"), F.col(f"c{i}").alias("value")) for i, (a, b) in enumerate(made)])
    return wide.select(F.explode(pairs).alias("p")).select("p.*")


def decided(projected: DataFrame, block: list[str]) -> DataFrame:
    """The exact squad of each block of a projected pool."""
    return decisions.decide(projected, block)
