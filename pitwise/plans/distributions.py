"""Exact distributions of points, without draws: arrays over whole points, convolved for batches of rows.

Given that a player appears, the parts of the score are taken as independent: saves, goals and
assists are Poisson counts with the expectations that the player's appearances must make up for,
rare events happen once or not, and what the opponents score counts for those who reach the hour.
A fixture's distribution is one array; a block's is the convolution of its fixtures'. A drawn
fixture hands each goal to one of those who happen to play, so a player who is not sure to play
scores from a mixture there; means agree, and so does the whole distribution where all are sure.

Spark makes a row's few rates, deals rows out and groups blocks; numpy adds the parts up for a batch at a time,
so neither shuffles nor files hold distributions unless they are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from pitwise.functions.probability import clip
from pitwise.functions.scoring import RULES, by_position

#: A fixture's points that are kept; chances beyond are left out (far less than a billionth at the rates of real matches) and the rest scaled to 1.
LOW, HIGH = -24, 95
#: Counts that are looked at: saves and opponents' goals, own goals scored and assists, defensive contributions.
MOST_SAVES, MOST_AGAINST, MOST_SCORED, MOST_DEFENSIVE = 59, 40, 12, 12
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
#: A quantile is the first value whose cumulated chance reaches it, up to rounding errors of sums.
EDGE = 1e-9
#: Fixtures that are convolved at once.
ROWS = 1024
#: Reach of positions that get no points for defending.
NEVER = 99
_ONCE = {"penalty_saves": RULES.penalty_save, "penalty_misses": RULES.penalty_miss, "yellow_cards": RULES.yellow_card, "red_cards": RULES.red_card, "own_goals": RULES.own_goal}
#: What a row's distribution is made of: points that go with its position, then rates and chances given that the player appears.
_RULED = ["back", "sheet", "goal_value", "reach"]
_RATES = ["plays", "saves", "goals", "assists", "against", "hour", "defensive", "bonus", *_ONCE]


def plays_of() -> Column:
    return clip(F.coalesce("p_appearance", F.lit(0.0)), 0, 1)


def rates() -> Column:
    """Array of a row's numbers in the order of _RULED and _RATES."""
    x = lambda n: F.greatest(F.coalesce(F.col(n), F.lit(0.0)).cast("double"), F.lit(0.0))
    plays = plays_of()
    given = lambda n: F.when(plays > 0, x(n) / plays).otherwise(0.0)
    position = F.col("position")
    back = F.coalesce(position.isin("GKP", "DEF"), F.lit(False))
    made = {
        "back": back.cast("int"),
        "sheet": F.when(back, RULES.clean_sheet_back).when(position == "MID", RULES.clean_sheet_mid).otherwise(0),
        "goal_value": F.coalesce("goal_value", F.lit(0)),
        "reach": by_position(position, dict(RULES.defensive_from), NEVER),
        "plays": plays,
        **{n: given(f"expected_{n}") for n in ("saves", "goals", "assists")},
        "against": x("opponent_expected_goals"),
        "hour": F.when(plays > 0, F.least(x("p_reached_60"), plays) / plays).otherwise(0.0),
        "defensive": given("expected_defensive_contribution"),
        "bonus": F.least(given("expected_bonus"), F.lit(3.0)),
        **{n: F.least(given(f"expected_{n}"), F.lit(1.0)) for n in _ONCE},
    }
    return F.array(*[made[n].cast("double") for n in (*_RULED, *_RATES)])


def poisson(rate: np.ndarray, most: int) -> np.ndarray:
    """P(N = 0) .. P(N = most) of each rate by recurrence, a column for each count."""
    out = np.empty((most + 1, len(rate)))
    out[0] = np.exp(-rate)
    for k in range(1, most + 1):
        out[k] = out[k - 1] * rate / k
    return out


def outcomes(r: dict[str, np.ndarray], back: bool, sheet: int, goal_value: int, reach: int) -> Iterator[dict[int, np.ndarray]]:
    """Each part of the score as points and their chances, for rows of one set of rules."""

    def summed(pairs) -> dict[int, np.ndarray]:
        made: dict[int, np.ndarray] = {}
        for d, p in pairs:
            made[d] = made[d] + p if d in made else p
        return made

    yield summed((n // RULES.saves_per_point, p) for n, p in enumerate(poisson(r["saves"], MOST_SAVES)))
    yield summed((n * goal_value, p) for n, p in enumerate(poisson(r["goals"], MOST_SCORED)))
    yield summed((n * RULES.assist, p) for n, p in enumerate(poisson(r["assists"], MOST_SCORED)))
    conceded = lambda n: RULES.conceded * (n // RULES.conceded_per_point) if back else 0
    against = [(RULES.sixty_minutes + (sheet if n == 0 else 0) + conceded(n), p * r["hour"]) for n, p in enumerate(poisson(r["against"], MOST_AGAINST))]
    yield summed([(0, 1 - r["hour"]), *against])
    for name, points in _ONCE.items():
        yield {0: 1 - r[name], points: r[name]}
    if reach < NEVER:
        much = np.maximum(1 - poisson(r["defensive"], MOST_DEFENSIVE)[:reach].sum(0), 0.0)
        yield {0: 1 - much, RULES.defensive: much}
    whole = np.floor(r["bonus"])
    part = r["bonus"] - whole
    yield {d: np.where(whole == d, 1 - part, 0.0) + np.where(whole + 1 == d, part, 0.0) for d in range(5)}


def chances_of(numbers: np.ndarray) -> np.ndarray:
    """Rows of ``rates`` to the chances of LOW to HIGH points, a row for each."""
    out = np.empty((len(numbers), HIGH - LOW + 1))
    kinds, kind = np.unique(numbers[:, : len(_RULED)], axis=0, return_inverse=True)
    for k, (back, sheet, value, reach) in enumerate(kinds):
        every = np.flatnonzero(kind.ravel() == k)
        for at in np.split(every, range(ROWS, len(every), ROWS)):
            r = dict(zip(_RATES, numbers[at, len(_RULED) :].T, strict=True))
            total = np.zeros((HIGH - LOW + 1, len(at)))
            total[RULES.appearance - LOW] = 1.0
            for part in outcomes(r, bool(back), int(sheet), int(value), int(reach)):
                grown = np.zeros_like(total)
                for d, p in part.items():
                    if p.any():
                        to, of = (slice(d, None), slice(None, len(total) - d)) if d >= 0 else (slice(None, d), slice(-d, None))
                        grown[to] += total[of] * p
                total = grown
            total *= r["plays"] / total.sum(0)
            total[-LOW] += 1 - r["plays"]
            out[at] = total.T
    return out


def block_of(fixtures: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """(chances, their least points) of the sum of independent fixtures; chances that cannot be are cut off, so sums stay short."""
    total, low = np.ones(1), 0
    for c in fixtures:
        some = np.flatnonzero(c > 0)
        total, low = np.convolve(total, c[some[0] : some[-1] + 1]), low + int(some[0]) + LOW
    return total, low


def blocks_of(numbers: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Blocks whose fixtures follow each other, ``sizes`` of them in each."""
    chances, ends = chances_of(numbers), np.cumsum(sizes)
    return [block_of(list(chances[a:b])) for a, b in zip(ends - sizes, ends, strict=True)]


FIGURES = {"points_mean": DoubleType(), "points_std": DoubleType(), **{f"points_p{round(100 * q)}": LongType() for q in QUANTILES}, "prob_eq_0": DoubleType(), "prob_ge_1": DoubleType(), "prob_ge_5": DoubleType(), "prob_ge_10": DoubleType()}
_STRUCT = StructType([StructField(n, t) for n, t in FIGURES.items()])


def figures(chances: np.ndarray, low: int) -> pa.StructArray:
    """Moments, quantiles and tails of distributions over ``low``, ``low`` + 1 and so on, a row for each."""
    values = np.arange(low, low + chances.shape[1])
    mean, upto = chances @ values, np.cumsum(chances, axis=1)
    share = lambda which: chances[:, which].sum(1)
    made = [mean, np.sqrt(np.maximum(chances @ (values * values) - mean * mean, 0.0))]
    made += [(upto < q - EDGE).sum(1) + low for q in QUANTILES]
    made += [share(values == 0), *[share(values >= least) for least in (1, 5, 10)]]
    return pa.StructArray.from_arrays([pa.array(m) for m in made], list(FIGURES))


def _matrix(rows: pa.ListArray) -> np.ndarray:
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), len(_RULED) + len(_RATES))


@F.arrow_udf(ArrayType(DoubleType()))
def _chances(rows: pa.Array) -> pa.Array:
    made = chances_of(_matrix(rows))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1]), pa.array(made.ravel()))


@F.arrow_udf(_STRUCT)
def _fixture_figures(rows: pa.Array) -> pa.Array:
    return figures(chances_of(_matrix(rows)), LOW)


@F.arrow_udf(_STRUCT)
def _block_figures(blocks: pa.Array) -> pa.Array:
    made = blocks_of(_matrix(blocks.flatten()), pc.list_value_length(blocks).to_numpy(zero_copy_only=False))
    parts = [_padded(made[a : a + ROWS]) for a in range(0, len(made), ROWS)] or [(np.empty((0, 1)), 0)]
    found = [figures(*p) for p in parts]
    return pa.concat_arrays(found)


def _padded(blocks: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, int]:
    """Distributions side by side over the points that any of them has."""
    low = min(b[1] for b in blocks)
    out = np.zeros((len(blocks), max(b[1] + len(b[0]) for b in blocks) - low))
    for row, (c, first) in zip(out, blocks, strict=True):
        row[first - low : first - low + len(c)] = c
    return out, low


@F.arrow_udf(StructType([StructField("chances", ArrayType(DoubleType())), StructField("low", IntegerType())]))
def _block_chances(blocks: pa.Array) -> pa.Array:
    flat = blocks.flatten()
    fixtures = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), HIGH - LOW + 1)
    ends = np.cumsum(pc.list_value_length(blocks).to_numpy(zero_copy_only=False))
    made = [block_of(list(fixtures[a:b])) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return pa.StructArray.from_arrays([pa.array([c for c, _ in made], pa.list_(pa.float64())), pa.array([low for _, low in made], pa.int32())], ["chances", "low"])


def fixture_chances(df: DataFrame, name: str = "chances") -> DataFrame:
    """``df`` with an array of the chances of LOW to HIGH points in the row's fixture."""
    return df.withColumn(name, _chances(rates()))


def fixture_figures(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, points ...) of the distribution of each row's points."""
    return df.select(*keys, _fixture_figures(rates()).alias("_f")).select(*keys, "_f.*")


def _grouped(df: DataFrame, keys: list[str], listed: Column) -> DataFrame:
    """(keys, n, p_any, _all): a block has few fixtures a player by the calendar."""
    rows = df.select(*keys, plays_of().alias("_p"), listed.alias("_x"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (1 - F.product(1 - F.col("_p"))).alias("p_any"), F.collect_list("_x").alias("_all"))


def block_chances(df: DataFrame, keys: list[str], chances: str = "chances") -> DataFrame:
    """(keys, n, p_any, chances, low): the fixtures of a key added up."""
    return _grouped(df, keys, F.col(chances)).select(*keys, "n", "p_any", _block_chances("_all").alias("_t")).select(*keys, "n", "p_any", "_t.chances", "_t.low")


def block_figures(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, p_any, points ...) of the sum of a key's fixtures; only their rates are shuffled."""
    return _grouped(df, keys, rates()).select(*keys, "n", "p_any", _block_figures("_all").alias("_f")).select(*keys, "n", "p_any", "_f.*")
