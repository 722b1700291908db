"""Models refitted at the cutoff of every fold, in plans whose work grows with rows plus folds.

What a fold may train on is all that was known strictly before its cutoff. Counts per bucket and
position are running sums with the cutoffs as marks (``pit.training_totals``); counts per player are
read as of the cutoff on the player's own time line (``pit.totals_as_of``). No row is repeated per fold.
Tables of folds times positions or buckets are broadcast: they grow with the calendar, not with the rows, which
Spark's size estimate of an aggregate does not know.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwise.functions.probability import clip, per_90, shrunk_mean
from pitwise.operators import pit

from . import components, minutes, team

TIME, CUT = "available_time", "information_cutoff"


def with_fold(df: DataFrame) -> DataFrame:
    """``df`` with the id of the fold that its block is tested in."""
    return df.withColumn("fold_id", F.concat(F.col("season"), F.lit("_gw"), F.lpad(F.col("gameweek").cast("string"), 2, "0")))


def _state_counts() -> dict[str, Column]:
    return {f"s{i}": F.coalesce((F.col("state") == s).cast("long"), F.lit(0).cast("long")) for i, s in enumerate(minutes.STATES)}


def _shares() -> Column:
    """Shares of the states with one added to each count."""
    total = reduce(lambda a, b: a + b, [F.col(f"s{i}") for i in range(len(minutes.STATES))])
    return F.array(*[(F.col(f"s{i}") + 1.0) / (total + float(len(minutes.STATES))) for i in range(len(minutes.STATES))])


def state_totals(frame: DataFrame, folds: DataFrame, keys: list[str]) -> DataFrame:
    """(fold_id, keys, n, appeared, started, own): the state distribution of each group as of each fold that has rows of it."""
    sums = {**_state_counts(), "n": F.lit(1).cast("long"), "appeared": (F.col("minutes") > 0).cast("long"), "started": (F.col("starts") > 0).cast("long")}
    total = pit.training_totals(frame, folds, TIME, CUT, sums, keys).filter("n > 0")
    return total.select("fold_id", *keys, "n", "appeared", "started", *[f"s{i}" for i in range(len(minutes.STATES))], _shares().alias("own"))


def overall_states(places: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold_id, overall) of every fold, added up from positions; all states alike where nothing was known."""
    counts = [f"s{i}" for i in range(len(minutes.STATES))]
    summed = places.groupBy("fold_id").agg(*[F.sum(c).alias(c) for c in counts])
    return folds.select("fold_id").join(summed, "fold_id", "left").na.fill(0, counts).select("fold_id", _shares().alias("overall"))


def _weight() -> Column:
    return F.col("n") / (F.col("n") + minutes.SHRINK_MATCHES)


def bucket_ensemble(frame: DataFrame, folds: DataFrame) -> DataFrame:
    """M6 of every row, fitted on what its fold knew: ``states`` beside the row."""
    rows = minutes.buckets(frame)
    overall = overall_states(state_totals(rows, folds, ["position"]), folds)
    out, found = rows.join(F.broadcast(overall), "fold_id", "left"), [F.col("overall")]
    for i, keys in enumerate((["position", "recency_bucket"], ["position", "start_bucket"], ["history_bucket"])):
        leaf = state_totals(rows, folds, keys).filter(F.col("n") >= minutes.MIN_LEAF).join(F.broadcast(overall), "fold_id")
        leaf = leaf.select("fold_id", *keys, minutes.blended(_weight(), F.col("own"), F.col("overall")).alias(f"leaf{i}"))
        out = out.join(F.broadcast(leaf), ["fold_id", *keys], "left")
        found.append(F.col(f"leaf{i}"))
    return out.withColumn("states", minutes.mean_of(found)).drop("overall", *[f"leaf{i}" for i in range(3)])


def hierarchical(frame: DataFrame, folds: DataFrame) -> DataFrame:
    """M7 of every row with the position priors of its fold."""
    places = state_totals(frame, folds, ["position"])
    priors = places.join(F.broadcast(overall_states(places, folds)), "fold_id").select(
        "fold_id", "position", "n",
        minutes.blended(_weight(), F.col("own"), F.col("overall")).alias("prior"),
        (F.col("appeared") / F.col("n")).alias("appearance_rate"), (F.col("started") / F.col("n")).alias("start_rate"),
    )
    return minutes.hierarchical_given(frame.join(F.broadcast(priors), ["fold_id", "position"], "left"))


def component_rates(rows: DataFrame, history: DataFrame, folds: DataFrame) -> DataFrame:
    """``rows`` with ``{event}_per90`` and ``assisted_goal_rate`` as their fold knew them.

    A player's rate is shrunk to that of the position of the player's latest row known by then; players
    without one take their own position's, and where a position has no rows, none.
    """
    sums = {"m": F.col("minutes"), **{e: F.col(e) for e in components.EVENTS}}
    known = {"n_known": F.lit(1).cast("long"), **{f"{n}_sum": c for n, c in sums.items()}}
    own = pit.totals_as_of(rows, history, ["player_uid"], CUT, TIME, known, {"known_position": F.struct("season", "gameweek", "fixture_key", "position")})
    places = pit.training_totals(history, folds, TIME, CUT, sums, ["position"]).filter("m is not null")
    rates = [per_90(F.col(e), F.col("m")).alias(f"{e}_position") for e in components.EVENTS]
    df = own.join(F.broadcast(places.select("fold_id", "position", *rates)), ["fold_id", "position"], "left")
    at_known = places.select("fold_id", F.col("position").alias("known_position"), *[per_90(F.col(e), F.col("m")).alias(f"{e}_known") for e in components.EVENTS])
    df = df.join(F.broadcast(at_known), ["fold_id", "known_position"], "left")
    made = {f"{e}_rate": shrunk_mean(F.col(f"{e}_sum") * 90.0, F.col("m_sum"), F.col(f"{e}_known"), components.SHRINK_MINUTES) for e in components.EVENTS}
    df = components.rates_given(df.withColumns(made)).drop("known_position", *known, *[f"{e}_known" for e in components.EVENTS])
    both = places.groupBy("fold_id").agg(F.sum("goals_scored").alias("g"), F.sum("assists").alias("a"))
    share = F.when(F.col("g") > 0, F.col("a") / F.col("g")).otherwise(components.ASSISTED_PRIOR)
    assisted = folds.select("fold_id").join(both, "fold_id", "left").select("fold_id", clip(share, *components.ASSISTED_BOUNDS).alias("assisted_goal_rate"))
    return df.join(F.broadcast(assisted), "fold_id", "left")


def team_rates(fixtures: DataFrame, folds: DataFrame, recent: int = team.RECENT, shrink: int = team.SHRINK) -> DataFrame:
    """T1 of every fixture: expected goals from each side's last matches known by its fold, shrunk to the league's means then.

    A fixture whose fold knew no match is left out.
    """
    at = fixtures.join(F.broadcast(team.league_means(fixtures, folds).select("fold_id", "home_mean", "away_mean")), "fold_id")
    for role in ("home", "away"):
        line = Window.partitionBy(f"{role}_team_uid").orderBy(TIME, "fixture_key").rowsBetween(1 - recent, 0)
        sums = {f"_{role}_h": F.sum("home_goals").over(line), f"_{role}_a": F.sum("away_goals").over(line), f"_{role}_n": F.count(F.lit(1)).over(line)}
        history = fixtures.select(f"{role}_team_uid", F.col(TIME).alias(f"_{role}_time"), F.col("fixture_key").alias("_tie"), *[c.alias(n) for n, c in sums.items()])
        at = pit.as_of(at, history, [f"{role}_team_uid"], CUT, f"_{role}_time", "_tie", list(sums)).na.fill(0, list(sums))
    rate = lambda role, side: shrunk_mean(F.col(f"_{role}_{side[0]}"), F.col(f"_{role}_n"), F.col(f"{side}_mean"), shrink)
    both = {f"expected_{side}_goals": (rate("home", side) + rate("away", side)) / 2 for side in ("home", "away")}
    return at.withColumns(both)


def softmax(frame: DataFrame, folds: DataFrame, numeric: list[str], categorical: list[str], key: str = "fixture_key") -> DataFrame:
    """M5 of every row, fitted on the latest rows that its fold knew: one small fit a fold."""
    latest = pit.latest_before(frame.drop("fold_id"), folds, TIME, CUT, key, minutes.MAX_FIT_ROWS)
    return minutes.softmax_scores(frame, minutes.softmax_fits(latest, numeric, categorical, key), numeric, categorical)
