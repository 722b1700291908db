"""Probability expressions over columns; no Python runs on rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    """``x`` held between the bounds; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def poisson_pmf(rate: Column, k: Column) -> Column:
    """P(N = k) for k of 0 to 20."""
    return F.exp(-rate) * F.pow(rate, k) / F.factorial(k.cast("int")).cast("double")


def poisson_pmf_upto(rate: Column, n: int | Column) -> Column:
    """Array of P(N = 0) .. P(N = n) by recurrence, for any n."""
    steps = F.sequence(F.lit(1), n if isinstance(n, Column) else F.lit(n))
    start = F.array(F.exp(-rate))
    grow = lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) * rate / k))
    return F.when(F.lit(n) == 0 if not isinstance(n, Column) else n == 0, start).otherwise(F.aggregate(steps, start, grow))


def poisson_tail(rate: Column, k: int | Column) -> Column:
    """P(N >= k); for a fixed k by nested multiplication, which stays within generated code."""
    if isinstance(k, int):
        if k <= 0:
            return F.lit(1.0)
        series = F.lit(1.0)
        for i in range(k - 1, 0, -1):
            series = 1 + rate / i * series
        return clip(1 - F.exp(-rate) * series, 0, 1)
    first = F.struct(F.exp(-rate).alias("p"), F.lit(0.0).alias("total"))
    step = lambda acc, i: F.struct((acc["p"] * rate / i).alias("p"), (acc["total"] + acc["p"]).alias("total"))
    below = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), first, step)["total"]
    return F.when(k <= 0, 1.0).otherwise(clip(1 - below, 0, 1))


def poisson_floor_mean(rate: Column, divisor: int) -> Column:
    """E[floor(N / divisor)], in closed form: the rate less the mean remainder, over the divisor.

    Chances of the remainders come from the count's generating function at the roots of unity.
    """
    turns = [2 * math.pi * k / divisor for k in range(1, divisor)]
    remainder = F.lit((divisor - 1) / 2)
    for turn in turns:
        swing = F.exp(rate * (math.cos(turn) - 1)) / divisor
        for r in range(1, divisor):
            remainder = remainder + r * swing * F.cos(rate * math.sin(turn) - r * turn)
    return (rate - remainder) / divisor


def low_score_factor(home: Column, away: Column, home_rate: Column, away_rate: Column, rho: Column) -> Column:
    """Dixon-Coles dependence of the four low scores; 1 elsewhere."""
    return (
        F.when((home == 0) & (away == 0), 1 - home_rate * away_rate * rho)
        .when((home == 0) & (away == 1), 1 + home_rate * rho)
        .when((home == 1) & (away == 0), 1 + away_rate * rho)
        .when((home == 1) & (away == 1), 1 - rho)
        .otherwise(F.lit(1.0))
    )


def score_cells(most: int) -> Column:
    """Array of all scores (h, a) up to ``most`` goals each, row by row."""
    goals = F.sequence(F.lit(0), F.lit(most))
    return F.flatten(F.transform(goals, lambda h: F.transform(F.sequence(F.lit(0), F.lit(most)), lambda a: F.struct(h.alias("h"), a.alias("a")))))


def outcome_probabilities(home_rate: Column, away_rate: Column, rho: Column | None = None, most: int = 20) -> Column:
    """struct(home, draw, away) over scores up to ``most``, scaled to sum to 1."""
    home, away = poisson_pmf_upto(home_rate, most), poisson_pmf_upto(away_rate, most)
    first = F.struct(F.lit(0.0).alias("home"), F.lit(0.0).alias("draw"), F.lit(0.0).alias("away"))

    def step(acc: Column, cell: Column) -> Column:
        p = F.element_at(home, cell["h"] + 1) * F.element_at(away, cell["a"] + 1)
        if rho is not None:
            p = p * low_score_factor(cell["h"], cell["a"], home_rate, away_rate, rho)
        add = lambda name, when: (acc[name] + F.when(when, p).otherwise(0.0)).alias(name)
        return F.struct(add("home", cell["h"] > cell["a"]), add("draw", cell["h"] == cell["a"]), add("away", cell["h"] < cell["a"]))

    def scaled(acc: Column) -> Column:
        total = acc["home"] + acc["draw"] + acc["away"]
        return F.struct(*[(acc[n] / total).alias(n) for n in ("home", "draw", "away")])

    return F.aggregate(score_cells(most), first, step, scaled)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def shrunk_mean(total: Column, count: Column, prior: Column, strength: float) -> Column:
    """(total + strength * prior) / (count + strength)."""
    return (total + strength * prior) / (count + strength)


def per_90(total: Column, minutes: Column, fallback: Column | float = 0.0) -> Column:
    """Rate for 90 minutes; the fallback where no minutes were played."""
    return F.when(minutes > 0, total * 90.0 / minutes).otherwise(fallback if isinstance(fallback, Column) else F.lit(float(fallback)))


#: SQL functions for sessions that want them by name; Catalyst inlines their bodies.
SQL_FUNCTIONS = {
    "poisson_pmf": "(rate DOUBLE, k INT) RETURNS DOUBLE RETURN exp(-rate) * pow(rate, k) / factorial(k)",
    "poisson_tail": "(rate DOUBLE, k INT) RETURNS DOUBLE RETURN 1 - aggregate(sequence(0, k - 1), 0D, (acc, i) -> acc + exp(-rate) * pow(rate, i) / factorial(i))",
    "normalize_name": "(name STRING) RETURNS STRING RETURN trim(regexp_replace(replace(lower(trim(name)), '&', ' and '), '[^a-z0-9]+', ' '))",
}


def register_sql_functions(spark) -> None:
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
