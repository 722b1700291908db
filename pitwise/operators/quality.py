"""Data-quality rules, counted in as few passes as they need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitwise.functions.temporal import season_of
from pitwise.functions.text import number_or_null


def not_null(*columns: str) -> dict[str, Column]:
    return {f"null:{c}": F.col(c).isNull() for c in columns}


def not_negative(*columns: str) -> dict[str, Column]:
    return {f"negative:{c}": F.col(c) < 0 for c in columns}


def in_range(column: str, low: float, high: float) -> dict[str, Column]:
    return {f"range:{column}": ~F.col(column).between(low, high)}


def one_of(column: str, *values: str) -> dict[str, Column]:
    return {f"enum:{column}": F.col(column).isNotNull() & ~F.col(column).isin(*values)}


def readable_time(column: str) -> dict[str, Column]:
    return {f"unreadable_time:{column}": F.col(column).isNotNull() & F.try_to_timestamp(F.col(column)).isNull()}


def no_marker(column: str, *markers: str) -> dict[str, Column]:
    """No synthetic-data marker stands in the text."""
    return {f"marker:{column}": reduce(lambda a, b: a | b, [F.lower(F.col(column)).contains(m) for m in markers])}


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, rows) for every rule, in one pass over the table."""
    wide = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(rules.values())])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"c{i}").alias("rows")) for i, n in enumerate(rules)])
    return wide.select(F.explode(pairs).alias("p")).select("p.*")


def surplus_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """(rows): how many rows a unique key would not allow."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("rows"))


def orphans(child: DataFrame, parent: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Rows of the child with a key that the parent lacks; null keys refer to nothing."""
    keys = parent.select(*[F.col(p).alias(f"_{c}") for c, p in on]).distinct()
    known = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c, _ in on])
    return child.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c, _ in on])).join(keys, known, "left_anti")


def forbidden_columns(columns: list[str], forbidden: set[str]) -> list[str]:
    """Columns whose name, in any case, is forbidden."""
    low = {f.lower() for f in forbidden}
    return sorted(c for c in columns if c.lower() in low)


def target_free(df: DataFrame, forbidden: set[str]) -> DataFrame:
    """``df``, once it has no outcome column; else an error."""
    found = forbidden_columns(df.columns, forbidden)
    if found:
        raise ValueError(f"outcome columns in a frozen table: {', '.join(found)}")
    return df


def without_targets(df: DataFrame, targets: set[str]) -> DataFrame:
    return df.drop(*forbidden_columns(df.columns, targets))


def conflicting_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose rows differ in any other column, with the number of versions."""
    rest = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.count_distinct(rest).alias("versions")).filter("versions > 1")


def identity_collisions(df: DataFrame, code: str, attributes: list[str]) -> DataFrame:
    """Codes that stand for more than one value of any attribute, with the counts."""
    counts = [F.count_distinct(a).alias(f"n_{a}") for a in attributes]
    return df.filter(F.col(code).isNotNull()).groupBy(code).agg(*counts).filter(F.greatest(*[F.col(f"n_{a}") for a in attributes]) > 1 if len(attributes) > 1 else F.col(f"n_{attributes[0]}") > 1)


def incomplete_sides(df: DataFrame, fixture: list[str], side: str) -> DataFrame:
    """Fixtures that lack a home or an away side."""
    return df.groupBy(*fixture).agg(F.count_distinct(side).alias("sides")).filter("sides <> 2")


def probability_faults(df: DataFrame, columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(rule, rows): probabilities out of bounds, null, or not summing to 1."""
    total = reduce(lambda a, b: a + b, [F.col(c) for c in columns])
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | ~F.col(c).between(-tolerance, 1 + tolerance) for c in columns])
    return violations(df, {"bounds": bad, "sum": F.abs(total - 1) > tolerance})


def gates(df: DataFrame, checks: dict[str, Column]) -> dict[str, bool]:
    """Named gates over one aggregate row; all must hold before anything is published."""
    row = df.agg(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()]).first()
    return row.asDict()


def gate_rows(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(gate, passed) of named gates over one aggregate row; a gate that can't be told is not passed."""
    wide = df.agg(*[F.coalesce(c, F.lit(False)).alias(f"c{i}") for i, c in enumerate(checks.values())])
    pairs = F.array(*[F.struct(F.lit(n).alias("gate"), F.col(f"c{i}").alias("passed")) for i, n in enumerate(checks)])
    return wide.select(F.explode(pairs).alias("p")).select("p.*")


def missing_by(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Rows of each group and how many lack each of the columns."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in columns])


def minutes_faults(df: DataFrame, keys: list[str], cutoff: str = "information_cutoff", source: str = "player_source_time") -> DataFrame:
    """(rule, rows) that break what a frame of minutes has to hold."""
    m, s = F.col("minutes"), F.col("starts")
    rules = {
        "minutes": F.coalesce(~m.between(0, 120), F.lit(True)),
        "start_label": ~s.isin(0, 1),
        "start_without_minutes": (s == 1) & (m <= 0),
        "history_after_cutoff": F.col(source) >= F.col(cutoff),
    }
    return violations(df, rules).unionByName(surplus_rows(df, keys).select(F.lit("duplicate_key").alias("rule"), "rows"))


def fixture_faults(df: DataFrame, keys: list[str], times: list[str], goals: list[str]) -> DataFrame:
    """(rule, rows) that break what a table of team fixtures has to hold."""
    rules = {"same_team": F.col("home_team_uid") == F.col("away_team_uid")}
    rules |= {f"missing:{t}": F.col(t).isNull() for t in times}
    rules |= {f"count:{g}": F.coalesce((F.col(g) < 0) | (F.col(g) % 1 != 0), F.lit(True)) for g in goals}
    return violations(df, rules).unionByName(surplus_rows(df, keys).select(F.lit("duplicate_key").alias("rule"), "rows"))


def require_gates(results: dict[str, bool]) -> None:
    failed = sorted(n for n, ok in results.items() if not ok)
    if failed:
        raise ValueError(f"gates failed: {', '.join(failed)}")


def side_faults(df: DataFrame) -> DataFrame:
    """(rule, rows): rows whose team isn't the one on their side of the fixture, or whose kickoff isn't the fixture's."""
    own = F.when(F.col("was_home"), F.col("home_team_uid")).otherwise(F.col("away_team_uid"))
    return violations(df, {"team_side": ~F.col("team_uid").eqNullSafe(own), "kickoff": ~F.col("kickoff_time").eqNullSafe(F.col("fixture_kickoff_time"))})


def candidate_faults(df: DataFrame, positions: tuple[str, ...], price: str = "price_tenths", points: str = "expected_points") -> DataFrame:
    """(rule, rows): candidates with a second row, no known position, no price of whole positive tenths, or no number of points."""
    cost = number_or_null(F.col(price))
    rules = {
        "position": ~F.coalesce(F.col("position").isin(*positions), F.lit(False)),
        "price": cost.isNull() | (cost <= 0) | (cost % 1 != 0),
        "points": number_or_null(F.col(points)).isNull(),
    }
    twice = surplus_rows(df, ["player_uid"]).select(F.lit("duplicate_player").alias("rule"), "rows")
    return violations(df, rules).unionByName(twice)


def artifact_faults(facts: DataFrame, keys: list[str], seasons: list[str], available: str, cutoff: str, lineage: list[str]) -> DataFrame:
    """(rule, rows): what keeps a reconstruction from being complete.

    Seasons missing or not asked for, keys missing or twice, results without an availability time
    or available at or before the cutoff, history times at or after the cutoff.
    """
    missing_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    rules = {"missing_key": missing_key, "missing_time": F.col(available).isNull() | F.col(cutoff).isNull(), "target_before_cutoff": F.col(available) <= F.col(cutoff), "season_not_asked": ~F.coalesce(F.col("season").isin(*seasons), F.lit(False))}
    rules |= {f"history_after_cutoff:{c}": F.col(c) >= F.col(cutoff) for c in lineage}
    asked = facts.sparkSession.createDataFrame([(s,) for s in seasons], "season string")
    absent = asked.join(facts.select("season").distinct(), "season", "left_anti").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("season_absent").alias("rule"), "rows")
    twice = surplus_rows(facts, keys).select(F.lit("duplicate_key").alias("rule"), "rows")
    return violations(facts, rules).unionByName(absent).unionByName(twice)


def completed_faults(df: DataFrame, keys: list[str], available: str, cutoff: Column, completed: str | None = None) -> DataFrame:
    """(rule, rows): completed inputs with keys twice, no time, known only at or after the cutoff, or not completed."""
    rules = {"missing_time": F.col(available).isNull(), "after_cutoff": F.col(available) >= cutoff}
    if completed:
        rules["not_completed"] = ~F.coalesce(F.col(completed), F.lit(False))
    twice = surplus_rows(df, keys).select(F.lit("duplicate_key").alias("rule"), "rows")
    return violations(df, rules).unionByName(twice)


def rule_differences(found: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(name, expected, found): rules (name, value) that are missing, new or of another value."""
    want = found.sparkSession.createDataFrame(sorted(expected.items()), "name string, expected string")
    both = want.join(found.select("name", F.col("value").cast("string").alias("found")), "name", "full")
    return both.filter(~F.col("expected").eqNullSafe(F.col("found")))


def season_identity(fixtures: DataFrame, season: str, teams: int = 20, events: int = 38, matches: int = 380, kickoff: str = "kickoff_time") -> DataFrame:
    """One row: the season that the kickoffs tell (seasons begin in June), counts, and whether all is as asked."""
    start = int(season[:4])
    sides = F.array_distinct(F.flatten(F.collect_set(F.array("home_team_uid", "away_team_uid"))))
    row = fixtures.agg(F.min(kickoff).alias("first"), F.max(kickoff).alias("last"), F.size(sides).alias("teams"), F.count_distinct("gameweek").alias("events"), F.count(F.lit(1)).alias("matches"))
    told = season_of(F.col("first"))
    window = F.year("first").isin(start, start + 1) & F.year("last").isin(start, start + 1)
    counts = (F.col("teams") == teams) & (F.col("events") == events) & (F.col("matches") == matches)
    return row.select(told.alias("inferred_season"), "teams", "events", "matches", (told == season).alias("season_ok"), window.alias("window_ok"), counts.alias("counts_ok"))


def first_reason(reasons: dict[str, Column]) -> Column:
    """The name of the first reason that holds (null counts as no), in the order given; null where none does."""
    out = None
    for name, test in reasons.items():
        test = F.coalesce(test, F.lit(False))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def exclusion_reason(df: DataFrame) -> Column:
    """Why a current player is left out of the selectable ones: removed, not selectable, no player; null: kept.

    A column that the table lacks excludes no one; an unknown ``can_select`` or ``removed`` neither.
    """
    tests = {
        "official_removed_true": ("removed", lambda c: c),
        "official_can_select_false": ("can_select", lambda c: ~c),
        "non_player_entity": ("entity_type", lambda c: ~c.eqNullSafe(F.lit("player"))),
    }
    return first_reason({name: test(F.col(c)) for name, (c, test) in tests.items() if c in df.columns} or {"none": F.lit(False)})


def valid_forecast(position: tuple[str, ...] = ("GKP", "DEF", "MID", "FWD")) -> Column:
    """Whether a projection row, its values perhaps text, may be shown: names are there, numbers are finite and within bounds."""
    number = lambda n: F.expr(f"try_cast(`{n}` as double)")
    within = lambda x, low, high=float("inf"): x.isNotNull() & ~F.isnan(x) & (x >= low) & (x <= high) & (x < float("inf"))
    named = lambda n: F.length(F.trim(F.coalesce(F.col(n).cast("string"), F.lit("")))) > 0
    price, plays = number("price_tenths"), number("p_appearance")
    tests = [named("player_uid"), named("player"), named("team"), F.col("position").isin(*position), within(price, 0.5) & (price == F.floor(price))]
    tests += [within(number("expected_points"), 0.0), within(number("expected_minutes"), 0.0, 90.0), within(plays, 0.0, 1.0), within(number("prob_points_ge_5"), 0.0, 1.0)]
    tests += [within(number("p_start"), 0.0) & (number("p_start") <= plays)]
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))
