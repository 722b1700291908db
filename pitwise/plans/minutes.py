"""Minutes models: playing-time states from lagged rates, closed forms as expressions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitwise.functions import text
from pitwise.functions.probability import clip
from pitwise.operators import relational

# States in order, minutes that a state stands for, weights.
STATES = ("DNP", "SUB_UNDER_60", "SUB_60_PLUS", "START_UNDER_60", "START_60_TO_89", "START_90")
STATE_MINUTES = (0.0, 22.0, 65.0, 45.0, 75.0, 90.0)
EWMA, SHRINK_MATCHES, MIN_LEAF, MAX_FIT_ROWS = 0.45, 4.0, 18, 5000
SOFTMAX_RATE, SOFTMAX_L2, SOFTMAX_ROUNDS = 0.08, 0.002, 35
STARTERS, LEAST_CANDIDATES = 11.0, 15


def ewma_minutes() -> Column:
    """Last match against longer means, clipped to a match's length."""
    last, recent, longer = (F.coalesce(f"lag{n}_minutes_mean", F.lit(0.0)) for n in (1, 3, 10))
    return clip(EWMA * last + (1 - EWMA) * (0.65 * recent + 0.35 * longer), 0, 90)


def previous_role_minutes() -> Column:
    """Minutes per appearance of the season before, times its shrunk appearance rate."""
    minutes, times = F.coalesce("prior_season_minutes", F.lit(0)), F.coalesce("prior_season_appearances", F.lit(0))
    return clip(F.when(times > 0, clip(minutes / times, 0, 90) * times / (times + SHRINK_MATCHES)).otherwise(0.0), 0, 90)


def two_state(minutes: Column) -> Column:
    """State probabilities that put all expected minutes on full matches."""
    p = clip(minutes / STATE_MINUTES[-1], 0, 1)
    return F.array(1 - p, *[F.lit(0.0)] * 4, p)


def expected_minutes(states: Column) -> Column:
    return F.aggregate(F.zip_with(states, F.lit(list(STATE_MINUTES)), lambda p, m: p * m), F.lit(0.0), lambda a, x: a + x)


def summary_probabilities(states: Column) -> dict[str, Column]:
    p = lambda i: F.element_at(states, i + 1)
    return {"p_appearance": 1 - p(0), "p_start": p(3) + p(4) + p(5), "p_reached_60": p(2) + p(4) + p(5), "p_played_90": p(5), "expected_minutes": expected_minutes(states)}


def state_distribution() -> Column:
    """Aggregate: shares of the states with one added to each count."""
    counts = [F.count_if(F.col("state") == s) + 1.0 for s in STATES]
    total = F.count_if(F.col("state").isin(*STATES)) + float(len(STATES))
    return F.array(*[c / total for c in counts])


def blended(weight: Column, own: Column, other: Column) -> Column:
    return F.zip_with(own, other, lambda a, b: weight * a + (1 - weight) * b)


def buckets(df: DataFrame) -> DataFrame:
    """Buckets of recent minutes, recent starts and last season's appearances."""

    def bucket(value: Column, edges: tuple[float, ...], names: tuple[str, ...]) -> Column:
        out = F.when(value <= 0, names[0])
        for edge, name in zip(edges, names[1:], strict=True):
            out = out.when(value <= edge, name)
        return out

    return df.withColumns({
        "recency_bucket": bucket(F.coalesce("lag5_minutes_mean", F.lit(0.0)), (30, 60, 120), ("none", "low", "medium", "high")),
        "start_bucket": bucket(F.coalesce("lag5_starts_mean", F.lit(0.0)), (0.34, 0.67, 1.0), ("none", "low", "medium", "high")),
        "history_bucket": bucket(F.coalesce("prior_season_appearances", F.lit(0)), (5, 20, 100), ("none", "thin", "regular", "heavy")),
    })


def bucket_ensemble(train: DataFrame, test: DataFrame) -> DataFrame:
    """M6: the mean of the global distribution and of those of three bucketings with enough rows."""
    train, test = buckets(train), buckets(test)
    overall = train.agg(state_distribution().alias("overall"))
    out = test.crossJoin(F.broadcast(overall))  # one row
    found = [F.col("overall")]
    for i, keys in enumerate((["position", "recency_bucket"], ["position", "start_bucket"], ["history_bucket"])):
        leaf = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), state_distribution().alias("own")).filter(F.col("n") >= MIN_LEAF)
        weight = F.col("n") / (F.col("n") + SHRINK_MATCHES)
        leaf = leaf.crossJoin(F.broadcast(overall)).select(*keys, blended(weight, F.col("own"), F.col("overall")).alias(f"leaf{i}"))
        out = out.join(F.broadcast(leaf), keys, "left")  # at most positions times buckets rows
        found.append(F.col(f"leaf{i}"))
    return out.withColumn("states", mean_of(found)).drop("overall", *[f"leaf{i}" for i in range(3)])


def mean_of(distributions: list[Column]) -> Column:
    """The mean of those that are there."""
    have = F.array_compact(F.array(*distributions))
    return F.transform(F.sequence(F.lit(1), F.lit(len(STATES))), lambda k: F.aggregate(have, F.lit(0.0), lambda a, x: a + F.element_at(x, k)) / F.size(have))


def role_priors(train: DataFrame) -> DataFrame:
    """(position, rows, prior states, appearance and start rates), positions shrunk to all rows."""
    overall = train.agg(state_distribution().alias("overall"))
    place = train.groupBy("position").agg(F.count(F.lit(1)).alias("n"), state_distribution().alias("own"), F.avg((F.col("minutes") > 0).cast("double")).alias("appearance_rate"), F.avg((F.col("starts") > 0).cast("double")).alias("start_rate"))
    weight = F.col("n") / (F.col("n") + SHRINK_MATCHES)
    return place.crossJoin(F.broadcast(overall)).select("position", "n", blended(weight, F.col("own"), F.col("overall")).alias("prior"), "appearance_rate", "start_rate")


def _c(name: str, df: DataFrame) -> Column:
    return text.number(F.col(name)) if name in df.columns else F.lit(0.0)


def hierarchical(train: DataFrame, test: DataFrame) -> DataFrame:
    """M7 with position priors from ``train``."""
    return hierarchical_given(test.join(F.broadcast(role_priors(train)), "position", "left"))


def hierarchical_given(joined: DataFrame) -> DataFrame:
    """M7: role probabilities from long and recent history around position priors, then availability, then states.

    ``joined`` has the rows with their ``prior``, ``n``, ``appearance_rate`` and ``start_rate`` (null: none known).
    Fixed values throughout are the model's published weights.
    """
    c = lambda n: _c(n, joined)
    v = lambda n: F.col(f"_{n}")
    made: list[str] = []

    def step(df: DataFrame, **values: Column) -> DataFrame:
        """Columns that later steps read by name: an expression used many times is planned and computed once."""
        made.extend(f"_{n}" for n in values)
        return df.withColumns({f"_{n}": x for n, x in values.items()})

    df = step(joined, apps=c("prior_season_appearances"), minutes=c("prior_season_minutes"), known_starts=c("prior_season_starts"), seen=c("history_fixture_count"), lag3=c("lag3_appearance_mean"), lag5=c("lag5_appearance_mean"), price=c("price_tenths"), rate_a=F.coalesce("appearance_rate", F.lit(0.25)), rate_s=F.coalesce("start_rate", F.lit(0.18)))
    df = step(
        df,
        starts=F.when((v("known_starts") <= 0) & (v("minutes") > 0), F.least(v("apps"), F.greatest(v("minutes") - v("apps") * 18.0, F.lit(0.0)) / 72.0)).otherwise(v("known_starts")),
        fixtures=F.when(v("seen") > 0, v("seen")).otherwise(F.greatest(v("apps"), v("minutes") / 90.0, c("gameweek") - 1)),
        recent5=F.when((v("lag5") <= 0) & (v("lag3") <= 0) & (v("apps") > 0), v("apps") / F.greatest(v("seen"), F.lit(38.0))).otherwise(v("lag5")),
        typical=v("minutes") / F.greatest(v("apps"), F.lit(1.0)),
    )
    whole = v("fixtures") + SHRINK_MATCHES
    df = step(
        df,
        long_a=(v("apps") + c("season_appearance_before") + v("rate_a") * SHRINK_MATCHES) / whole,
        long_s=(v("starts") + c("season_starts_before") + v("rate_s") * SHRINK_MATCHES) / whole,
        recent_a=0.65 * v("recent5") + 0.35 * v("lag3"),
        recent_s=0.65 * c("lag5_starts_mean") + 0.35 * c("lag3_starts_mean"),
        settled=(v("minutes") >= 1200) | (v("apps") >= 20) | (v("fixtures") >= 30),
        boost=0.72 + 0.32 * F.when(v("price") > 0, clip((v("price") - 40.0) / 80.0, 0, 1)).otherwise(0.25),
    )
    df = step(df, held_a=clip(v("long_a"), 0, 0.995), held_s=clip(v("long_s"), 0, 0.995), w=F.when(v("settled"), 0.72).otherwise(0.55))
    warm = lambda k: v("w") * v(f"held_{k}") + (1 - v("w")) * clip(v(f"recent_{k}"), 0, 1)
    floor = lambda k: F.when(v("settled"), F.greatest(warm(k), 0.62 * v(f"held_{k}"))).otherwise(warm(k))
    boost = v("boost") * F.when(F.coalesce(F.col("transferred"), F.lit(False)), 1.05).otherwise(1.0) if "transferred" in df.columns else v("boost")
    keeper = F.col("position") == "GKP"
    df = step(df, lift=boost)
    df = step(df, cold_a=F.least(F.greatest(F.coalesce("appearance_rate", F.lit(0.20)) * v("lift"), F.when(keeper, 0.035).otherwise(0.06)), F.when(keeper, 0.42).otherwise(0.58)))
    cold_s = F.least(F.greatest(F.coalesce("start_rate", F.lit(0.12)) * v("lift"), F.lit(0.015)), F.least(F.when(keeper, 0.30).otherwise(0.38), v("cold_a")))
    cold = F.coalesce(F.col("cold_start"), F.lit(False))
    df = step(df, free_a=F.when(cold, v("cold_a")).otherwise(floor("a")), free_s=F.when(cold, cold_s).otherwise(floor("s")))
    plays, begins = available(df, v("free_a"), v("free_s"))
    df = step(df, plays=plays, begins=begins)
    df = step(df, a=clip(v("plays"), 0, 1), s=clip(F.least(v("begins"), v("plays")), 0, 1), p=F.coalesce("prior", F.lit([1.0 / 6] * 6)))
    p = lambda i: F.element_at("_p", i + 1)
    started = p(3) + p(4) + p(5)
    goal = F.when(v("settled") & (v("typical") >= 78), F.array(*map(F.lit, (0.04, 0.20, 0.76)))).when(v("typical") >= 60, F.array(*map(F.lit, (0.08, 0.42, 0.50)))).otherwise(F.array(*map(F.lit, (0.18, 0.52, 0.30))))
    df = step(df, goal=goal)
    mix = [0.55 * p(3 + i) / started + 0.45 * F.element_at("_goal", i + 1) for i in range(3)]
    sub = F.greatest(v("a") - v("s"), F.lit(0.0))
    early = p(1) / (p(1) + p(2))
    states = F.array(1 - v("a"), sub * early, sub * (1 - early), *[v("s") * m for m in mix])
    return df.withColumn("states", states).drop(*made, "prior", "n", "appearance_rate", "start_rate")


def available(df: DataFrame, plays: Column, begins: Column) -> tuple[Column, Column]:
    """Current availability: out if removed, not selectable or suspended; capped by stated chances; doubts and injuries count down."""
    if "status" not in df.columns:
        return plays, begins
    status = F.lower(F.coalesce("status", F.lit("")))
    flag = lambda n, default: F.coalesce(F.col(n), F.lit(default)) if n in df.columns else F.lit(default)
    out = flag("removed", False) | ~flag("can_select", True) | status.isin("u", "s")
    chance = F.greatest(_c("chance_of_playing_next_round", df), _c("chance_of_playing_this_round", df)) / 100.0
    cap = F.when(chance > 0, F.least(chance, F.lit(1.0))).otherwise(1.0)
    doubt = status.isin("d", "i")
    adjusted = lambda p, k: F.when(out, 0.0).otherwise(F.least(p, cap) * F.when(doubt, k).otherwise(1.0))
    return adjusted(plays, 0.55), adjusted(begins, 0.45)


def softmax_states(train: DataFrame, test: DataFrame, numeric: list[str], categorical: list[str], key: str, time: str) -> DataFrame:
    """M5: multinomial logistic regression by fixed gradient steps on the latest rows.

    The fit sees ``MAX_FIT_ROWS`` rows at most (a fixed window of the model), in one task; scoring
    is a projection over all test rows with the fitted weights.
    """
    latest = train.orderBy(F.desc(time), F.desc(key)).limit(MAX_FIT_ROWS).withColumn("fold_id", F.lit("all"))
    fitted = softmax_fits(latest, numeric, categorical, key)
    return softmax_scores(test.withColumn("fold_id", F.lit("all")), fitted, numeric, categorical).drop("fold_id")


def softmax_weights(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """(states, 1 + columns) weights for rows as they are; the first ``k`` columns are standardised within."""
    centre, spread = x[:, :k].mean(0), x[:, :k].std(0)
    spread[spread < 1e-6] = 1.0
    design = np.hstack([np.ones((len(x), 1)), (x[:, :k] - centre) / spread, x[:, k:]])
    w = np.zeros((design.shape[1], len(STATES)))
    share = y.sum(0) + 1
    w[0] = np.log(share / share.sum())
    for _ in range(SOFTMAX_ROUNDS):
        z = design @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = design.T @ (p - y) / len(y)
        g[1:] += SOFTMAX_L2 * w[1:]
        w -= SOFTMAX_RATE * g
    full = w.copy()
    full[1 : k + 1] = w[1 : k + 1] / spread[:, None]
    full[0] -= centre @ full[1 : k + 1]
    return full.T


def softmax_fits(latest: DataFrame, numeric: list[str], categorical: list[str], key: str) -> DataFrame:
    """(fold_id, levels, weights) of each fold: a fit of its ``MAX_FIT_ROWS`` rows at most, a row of its own.

    ``levels`` holds the values of each categorical column that the fold has seen; a value that it
    has not seen counts as none of them. Rows without a state are left out.
    """
    index = reduce(lambda a, i: a.when(F.col("state") == STATES[i], i), range(1, len(STATES)), F.when(F.col("state") == STATES[0], 0)).alias("y")
    columns = [F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in numeric]).alias("x"), F.array(*[F.col(c).cast("string") for c in categorical]).alias("c")]

    def fit(fold: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        values = list(zip(*rows.c, strict=True)) if categorical else []
        levels = [sorted({v for v in column if v is not None}) for column in values]
        hot = [[float(v == level) for v in column] for column, own in zip(values, levels, strict=True) for level in own]
        x = np.hstack([np.stack(rows.x), np.array(hot).reshape(-1, len(rows)).T])
        w = softmax_weights(x, np.eye(len(STATES))[rows.y.astype(int)], len(numeric))
        return pd.DataFrame({"fold_id": [fold[0]], "levels": [levels], "weights": [[list(r) for r in w]]})

    rows = latest.select("fold_id", F.col(key).alias("k"), *columns, index).filter("y is not null")
    return rows.groupBy("fold_id").applyInPandas(fit, "fold_id string, levels array<array<string>>, weights array<array<double>>")


def softmax_scores(rows: DataFrame, fitted: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """``rows`` with ``states`` by their fold's weights; all states alike where the fold has none."""
    one_hot = lambda c: lambda v: F.coalesce((F.col(c).cast("string") == v).cast("double"), F.lit(0.0))
    hot = [F.transform(F.get("levels", F.lit(i)), one_hot(c)) for i, c in enumerate(categorical)]
    x = F.concat(F.array(F.lit(1.0), *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in numeric]), *hot)
    scored = rows.join(relational.small(fitted), "fold_id", "left").withColumn("x", x)
    logit = F.transform("weights", lambda w: F.aggregate(F.zip_with(w, F.col("x"), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v))
    scored = scored.withColumn("z", logit).withColumn("e", F.transform("z", lambda v: F.exp(v - F.array_max("z"))))
    total = F.aggregate("e", F.lit(0.0), lambda a, v: a + v)
    states = F.coalesce(F.transform("e", lambda v: v / total), F.array(*[F.lit(1.0 / len(STATES))] * len(STATES)))
    return scored.withColumn("states", states).drop("x", "z", "e", "levels", "weights")


def coherent_starts(df: DataFrame, team: list[str], key: str, p_start: str = "p_start") -> DataFrame:
    """``p_start`` of each full team shifted on the logit scale until eleven start; small groups stay as they are.

    The shift is found by bisection over the team's probabilities, all teams at once: 60 rounds of
    one aggregate over an array per team, whose size is a squad's.
    """
    logits = F.collect_list(F.ln(clip(F.col(p_start), 1e-6, 1 - 1e-6) / (1 - clip(F.col(p_start), 1e-6, 1 - 1e-6))))
    teams = df.groupBy(*team).agg(logits.alias("z"), F.count(F.lit(1)).alias("n"))
    total = lambda shift: F.aggregate("z", F.lit(0.0), lambda a, v: a + 1 / (1 + F.exp(-(v + shift))))
    start = F.struct(F.lit(-30.0).alias("low"), F.lit(30.0).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = (s["low"] + s["high"]) / 2
        over = total(middle) > STARTERS
        return F.struct(F.when(over, s["low"]).otherwise(middle).alias("low"), F.when(over, middle).otherwise(s["high"]).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, halve, lambda s: (s["low"] + s["high"]) / 2)
    shifts = teams.select(*team, F.when(F.col("n") >= LEAST_CANDIDATES, found).alias("_shift"))
    out = df.join(shifts, team)
    held = clip(F.col(p_start), 1e-6, 1 - 1e-6)
    moved = 1 / (1 + F.exp(-(F.ln(held / (1 - held)) + F.col("_shift"))))
    return out.withColumns({"p_start_raw": F.col(p_start), "adjusted": F.col("_shift").isNotNull(), p_start: F.coalesce(moved, F.col(p_start))}).drop("_shift")
