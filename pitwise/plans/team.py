"""Team goal models for many cutoffs in one plan.

Fits need no match rows: weighted counts per pair of teams are enough. A half-life weight is a
factor of the cutoff times a factor of the match, so counts up to any cutoff are running sums, and
each fold's fit gets one row per pair whatever the length of the history.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitwise.functions.probability import shrunk_mean
from pitwise.operators import pit, relational

# Recent matches per side and matches of prior (T1), half-life, ridge, bounds (T2, T3).
RECENT, SHRINK = 8, 6
HALF_LIFE_DAYS, RIDGE, RHO_RIDGE, RHO_BOUNDS = 365.0, 10.0, 25.0, (-0.19, 0.035)
RATE_BOUNDS = (0.05, 5.0)
LOW_HISTORY = 6


def league_means(fixtures: DataFrame, folds: DataFrame) -> DataFrame:
    """T0: (fold_id, n, home_mean, away_mean) over matches known before each cutoff."""
    sums = {"n": F.lit(1), "h": F.col("home_goals"), "a": F.col("away_goals")}
    total = pit.training_totals(fixtures, folds, "available_time", "information_cutoff", sums).filter("n > 0")
    return total.select("fold_id", "n", (F.col("h") / F.col("n")).alias("home_mean"), (F.col("a") / F.col("n")).alias("away_mean"))


def recent_rates(fixtures: DataFrame, means: DataFrame, cutoff: str, recent: int = RECENT, shrink: int = SHRINK) -> DataFrame:
    """T1 as of one cutoff: (team_uid, home_attack, away_attack, home_concede, away_concede, matches).

    Rates over each team's last home and last away matches, shrunk to the league's. ``means`` has
    one row (home_mean, away_mean).
    """
    known = fixtures.filter(F.col("available_time") < F.lit(cutoff).cast("timestamp_ntz"))
    sides = relational.both_sides(known, ["fixture_key", "available_time"], {"team_uid": ("home_team_uid", "away_team_uid"), "goals": ("home_goals", "away_goals")})
    last = relational.top_per_group(sides, ["team_uid", "is_home"], [F.desc("available_time"), F.desc("fixture_key")], recent)
    at = lambda home, c: F.coalesce(F.sum(F.when(F.col("is_home") == home, F.col(c))), F.lit(0))
    n = lambda home: F.count_if(F.col("is_home") == home)
    sums = last.groupBy("team_uid").agg(at(True, "goals").alias("hg"), at(True, "opponent_goals").alias("hc"), n(True).alias("hn"), at(False, "goals").alias("ag"), at(False, "opponent_goals").alias("ac"), n(False).alias("an"))
    df = sums.crossJoin(F.broadcast(means.select("home_mean", "away_mean")))  # one row of league means
    return df.select(
        "team_uid",
        shrunk_mean(F.col("hg"), F.col("hn"), F.col("home_mean"), shrink).alias("home_attack"),
        shrunk_mean(F.col("ag"), F.col("an"), F.col("away_mean"), shrink).alias("away_attack"),
        shrunk_mean(F.col("hc"), F.col("hn"), F.col("away_mean"), shrink).alias("home_concede"),
        shrunk_mean(F.col("ac"), F.col("an"), F.col("home_mean"), shrink).alias("away_concede"),
        (F.col("hn") + F.col("an")).alias("matches"),
    )


def predict_from_rates(targets: DataFrame, rates: DataFrame, means: DataFrame) -> DataFrame:
    """Expected goals as the mean of one side's attack and the other's conceding; unseen teams take the league's."""
    side = lambda role, cols: relational.small(rates.select(F.col("team_uid").alias(f"{role}_team_uid"), *[F.col(c).alias(f"{role}_{c}") for c in cols]))
    df = targets.join(side("home", ["home_attack", "home_concede"]), "home_team_uid", "left").join(side("away", ["away_attack", "away_concede"]), "away_team_uid", "left")
    df = df.crossJoin(F.broadcast(means.select("home_mean", "away_mean")))  # one row of league means
    home, away = F.col("home_mean"), F.col("away_mean")
    df = df.withColumn("expected_home_goals", (F.coalesce("home_home_attack", home) + F.coalesce("away_away_concede", home)) / 2)
    return df.withColumn("expected_away_goals", (F.coalesce("away_away_attack", away) + F.coalesce("home_home_concede", away)) / 2)


def weighted_means(fixtures: DataFrame, folds: DataFrame, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """(fold_id, home_mean, away_mean, effective_n): means with half-life weights, and (sum w)^2 / sum w^2."""
    w = _weight(half_life)
    sums = {"w": w, "w2": w * w, "h": w * F.col("home_goals"), "a": w * F.col("away_goals")}
    total = pit.training_totals(fixtures, folds, "available_time", "information_cutoff", sums).filter("w > 0")
    return total.select("fold_id", (F.col("h") / F.col("w")).alias("home_mean"), (F.col("a") / F.col("w")).alias("away_mean"), (F.col("w") * F.col("w") / F.col("w2")).alias("effective_n"))


def _weight(half_life: float):
    """The match's factor of its weight, counted from the start of 1995: differences to cutoffs are what matters."""
    days = (F.unix_micros(F.col("available_time").cast("timestamp")) - F.lit(788918400000000)) / F.lit(86400e6)
    return F.pow(F.lit(2.0), days / half_life)


def pair_counts(fixtures: DataFrame, folds: DataFrame, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """(fold_id, home_team_uid, away_team_uid, w, wh, wa, w00, w01, w10, w11): what T2 and T3 are fitted from."""
    w = _weight(half_life)
    cell = lambda h, a: F.when((F.col("home_goals") == h) & (F.col("away_goals") == a), w).otherwise(0.0)
    sums = {"w": w, "wh": w * F.col("home_goals"), "wa": w * F.col("away_goals"), **{f"w{h}{a}": cell(h, a) for h in (0, 1) for a in (0, 1)}}
    keys = ["home_team_uid", "away_team_uid"]
    total = pit.training_totals(fixtures, folds, "available_time", "information_cutoff", sums, keys).filter("w > 0")
    days = (pit.micros(F.col("information_cutoff")) - F.lit(788918400000000)) / F.lit(86400e6)
    scale = F.pow(F.lit(0.5), days / half_life)
    cuts = F.broadcast(folds.select("fold_id", scale.alias("scale")))
    return total.join(cuts, "fold_id").select("fold_id", *keys, *[(F.col(n) * F.col("scale")).alias(n) for n in sums])


def _design(rows: pd.DataFrame):
    teams = sorted(set(rows.home_team_uid) | set(rows.away_team_uid))
    index = {t: i for i, t in enumerate(teams)}
    return teams, rows.home_team_uid.map(index).to_numpy(), rows.away_team_uid.map(index).to_numpy()


def _objective(x: np.ndarray, rows: dict[str, np.ndarray], h: np.ndarray, a: np.ndarray, n: int, ridge: float, low_scores: bool):
    """Penalised negative log-likelihood and gradient; x is intercept, home advantage, attack, defence, rho."""
    c, home, att, dfn, rho = x[0], x[1], x[2 : 2 + n], x[2 + n : 2 + 2 * n], x[-1]
    lh, la = np.exp(c + home + att[h] + dfn[a]), np.exp(c + att[a] + dfn[h])
    value = (rows["w"] * (lh + la) - rows["wh"] * np.log(lh) - rows["wa"] * np.log(la)).sum() + ridge / 2 * (att @ att + dfn @ dfn)
    gh, ga, grho = rows["w"] * lh - rows["wh"], rows["w"] * la - rows["wa"], 0.0
    if low_scores:
        taus = {"w00": 1 - lh * la * rho, "w01": 1 + lh * rho, "w10": 1 + la * rho, "w11": np.full(len(h), 1 - rho)}
        if min(t.min() for t in taus.values()) <= 1e-9:
            return np.inf, x
        value -= sum((rows[k] * np.log(t)).sum() for k, t in taus.items())
        value += RHO_RIDGE / 2 * rho**2
        r = {k: rows[k] / t for k, t in taus.items()}
        gh = gh + r["w00"] * lh * la * rho - r["w01"] * lh * rho
        ga = ga + r["w00"] * lh * la * rho - r["w10"] * la * rho
        grho = (r["w00"] * lh * la - r["w01"] * lh - r["w10"] * la + r["w11"]).sum() + RHO_RIDGE * rho
    g = np.zeros_like(x)
    g[0], g[1] = gh.sum() + ga.sum(), gh.sum()
    g[2 : 2 + n] = np.bincount(h, gh, n) + np.bincount(a, ga, n) + ridge * att
    g[2 + n : 2 + 2 * n] = np.bincount(a, gh, n) + np.bincount(h, ga, n) + ridge * dfn
    g[-1] = grho
    return value, g


def minimise(f, x: np.ndarray, free: np.ndarray, bounds: tuple[float, float], rounds: int = 400, tolerance: float = 1e-7) -> tuple[np.ndarray, float, int]:
    """BFGS with backtracking over the free coordinates; the last one stays within bounds."""
    inverse = np.eye(len(x))
    value, g = f(x)
    step = 0
    for step in range(1, rounds + 1):
        g = np.where(free, g, 0.0)
        pinned = (x[-1] <= bounds[0] and g[-1] > 0) or (x[-1] >= bounds[1] and g[-1] < 0)
        if pinned:
            g[-1] = 0.0
        if np.abs(g).max() < tolerance:
            break
        d = -inverse @ g
        if pinned:
            d[-1] = 0.0
        if d @ g >= 0:
            inverse, d = np.eye(len(x)), -g
        t = 1.0
        while t > 1e-12:
            new = x + t * d
            new[-1] = min(max(new[-1], bounds[0]), bounds[1])
            v, ng = f(new)
            if np.isfinite(v) and v <= value + 1e-4 * (g @ (new - x)):
                break
            t /= 2
        else:
            break
        s, y = new - x, np.where(free, ng, 0.0) - g
        if s @ y > 1e-12:
            r = 1 / (s @ y)
            left = np.eye(len(x)) - r * np.outer(s, y)
            inverse = left @ inverse @ left.T + r * np.outer(s, s)
        x, value, g = new, v, ng
    return x, float(np.abs(np.where(free, g, 0.0)).max()), step


RATING_SCHEMA = "fold_id string, team_uid long, intercept double, home_advantage double, attack double, defence double, rho double, max_gradient double, rounds int"


def fit_group(low_scores: bool, ridge: float = RIDGE):
    """The fit of one fold from its pair counts; effects sum to zero by the ridge."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["home_team_uid", "away_team_uid"])
        teams, h, a = _design(rows)
        n = len(teams)
        counts = {k: rows[k].to_numpy(float) for k in ("w", "wh", "wa", "w00", "w01", "w10", "w11")}
        x = np.zeros(3 + 2 * n)
        mean_h, mean_a = counts["wh"].sum() / counts["w"].sum(), counts["wa"].sum() / counts["w"].sum()
        x[0] = np.log(max(mean_a, 1e-3))
        x[1] = np.log(max(mean_h, 1e-3)) - x[0]
        free = np.ones(len(x), bool)
        free[-1] = low_scores
        x, gradient, rounds = minimise(lambda v: _objective(v, counts, h, a, n, ridge, low_scores), x, free, RHO_BOUNDS)
        return pd.DataFrame({"fold_id": rows.fold_id.iloc[0], "team_uid": teams, "intercept": x[0], "home_advantage": x[1], "attack": x[2 : 2 + n], "defence": x[2 + n : 2 + 2 * n], "rho": x[-1], "max_gradient": gradient, "rounds": rounds})

    return run


def fit_poisson(counts: DataFrame, low_scores: bool = False) -> DataFrame:
    """T2 (T3 with low scores): ratings of every fold; each task fits folds from pair counts."""
    return counts.groupBy("fold_id").applyInPandas(fit_group(low_scores), RATING_SCHEMA)


def predict_from_ratings(targets: DataFrame, ratings: DataFrame) -> DataFrame:
    """Expected goals of targets (with fold_id) from fitted ratings; unseen teams have effect 0; rates are bounded."""
    league = ratings.groupBy("fold_id").agg(F.max("intercept").alias("intercept"), F.max("home_advantage").alias("home_advantage"), F.max("rho").alias("rho"))
    side = lambda role: ratings.select("fold_id", F.col("team_uid").alias(f"{role}_team_uid"), F.col("attack").alias(f"{role}_attack"), F.col("defence").alias(f"{role}_defence"))
    df = targets.join(league, "fold_id").join(side("home"), ["fold_id", "home_team_uid"], "left").join(side("away"), ["fold_id", "away_team_uid"], "left")
    effect = lambda c: F.coalesce(c, F.lit(0.0))
    bound = lambda rate: F.least(F.greatest(rate, F.lit(RATE_BOUNDS[0])), F.lit(RATE_BOUNDS[1]))
    home = F.exp(F.col("intercept") + F.col("home_advantage") + effect("home_attack") + effect("away_defence"))
    away = F.exp(F.col("intercept") + effect("away_attack") + effect("home_defence"))
    return df.withColumns({"expected_home_goals": bound(home), "expected_away_goals": bound(away), "home_unseen": F.col("home_attack").isNull(), "away_unseen": F.col("away_attack").isNull()})


def newcomer_prior(fixtures: DataFrame, days: int = 300, first: int = 38, strength: float = 3 * LOW_HISTORY) -> DataFrame:
    """(matches, teams, attack_effect, defence_effect): log rates of teams first seen ``days`` after the start, over their first matches."""
    sides = relational.both_sides(fixtures, ["fixture_key", "available_time"], {"team_uid": ("home_team_uid", "away_team_uid"), "goals": ("home_goals", "away_goals")})
    start = fixtures.agg(F.min("available_time").alias("start"), (F.sum("home_goals") + F.sum("away_goals")).alias("g"), F.count(F.lit(1)).alias("m"))
    own = sides.withColumn("seen", F.min("available_time").over(Window.partitionBy("team_uid")))
    late = own.crossJoin(F.broadcast(start)).filter(F.col("seen") > F.col("start") + F.expr(f"INTERVAL {days} DAYS"))  # one row of the league's start
    early = relational.top_per_group(late, ["team_uid"], [F.col("available_time"), F.col("fixture_key")], first)
    league = F.max(F.col("g") / (2.0 * F.col("m")))
    rate = lambda c: (F.sum(c) + strength * league) / (F.count(F.lit(1)) + strength)
    effect = lambda c: F.coalesce(F.ln(rate(c) / league), F.lit(0.0))
    return early.agg(F.count(F.lit(1)).alias("matches"), F.count_distinct("team_uid").alias("teams"), effect("goals").alias("attack_effect"), effect("opponent_goals").alias("defence_effect"))
