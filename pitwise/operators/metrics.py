"""Forecast metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwise.functions.probability import low_score_factor, poisson_pmf, poisson_pmf_upto

from . import relational, written


def correlation(x: str, y: str) -> Column:
    """Pearson correlation of the rows that have both; null where either side does not vary.

    By Spark's running moments: differences of sums of squares are not 0 for equal values of many rows.
    """
    spread = lambda c, other: F.var_pop(F.when(F.col(other).isNotNull(), F.col(c)))
    vx, vy = spread(x, y), spread(y, x)
    return F.when((vx > 0) & (vy > 0), F.covar_pop(x, y) / (F.sqrt(vx) * F.sqrt(vy)))


def strip_of(value: Column) -> Column:
    """A whole number that never falls as the value rises: 32 steps to a doubling above a millionth; nulls come first."""
    x = value.cast("double")
    return F.coalesce((F.signum(x) * F.floor(F.log2(1 + F.abs(x) * 1e6) * 32)).cast("long"), F.lit(-(1 << 62)))


def ranks_below(df: DataFrame, group: list[str], value: str, tie: str | None = None, counted: DataFrame | None = None) -> DataFrame:
    """``df`` with ``_below``: rows of the group that sort before the row's cell, and ``_cell``: rows of that cell.

    A cell is a value, parted by strips of ``tie`` if there is one. Cells are counted with partial
    sums, counts run within strips of values, and strips are moved up by the counts before them; so
    no task sorts a group, however many rows it has. ``counted`` has the same rows as ``df`` where
    those are at hand in a cheaper form.
    """
    cut = {"_v": F.col(value), "_strip": strip_of(F.col(value)), "_tie": strip_of(F.col(tie)) if tie else F.lit(0).cast("long")}
    rows = df.withColumns(cut)
    cells = (rows if counted is None else counted.withColumns(cut)).groupBy(*group, "_strip", "_v", "_tie").agg(F.count(F.lit(1)).alias("_cell"))
    strips = cells.groupBy(*group, "_strip").agg(F.sum("_cell").alias("_n"))
    over_strips = Window.partitionBy(*group).orderBy("_strip").rowsBetween(Window.unboundedPreceding, -1)
    strips = strips.select(*group, "_strip", F.coalesce(F.sum("_n").over(over_strips), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*group, "_strip").orderBy("_v", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_run", F.coalesce(F.sum("_cell").over(within), F.lit(0))).join(strips, [*group, "_strip"])
    cells = cells.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_v").alias("_cv"), F.col("_tie").alias("_ct"), (F.col("_start") + F.col("_run")).alias("_below"), "_cell")
    same = F.col("_v").eqNullSafe(F.col("_cv")) & (F.col("_tie") == F.col("_ct"))
    for i, g in enumerate(group):
        same = same & (F.col(g) == F.col(f"_g{i}"))
    return rows.join(cells, same).drop("_cv", "_ct", "_strip", *[f"_g{i}" for i in range(len(group))])


def with_average_rank(df: DataFrame, group: list[str], value: str, name: str, counted: DataFrame | None = None) -> DataFrame:
    """``df`` with the rank within the group; equal values share the mean of their ranks. Groups with a null key are left out."""
    return ranks_below(df, group, value, counted=counted).withColumn(name, F.col("_below") + (F.col("_cell") + 1) / 2).drop("_below", "_cell", "_v", "_tie")


def with_percent_rank(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the average rank within the group over the group's size; nulls of ``value`` have none and are not counted."""
    known = df.filter(F.col(value).isNotNull())
    sizes = known.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    ranked = with_average_rank(known, group, value, name).join(relational.small(sizes), group).withColumn(name, F.col(name) / F.col("_n")).drop("_n")
    return ranked.unionByName(df.filter(F.col(value).isNull()).withColumn(name, F.lit(None).cast("double")))


def error_metrics(prediction: str, actual: str) -> dict[str, Column]:
    error = F.col(prediction) - F.col(actual)
    return {
        "rows": F.count(F.lit(1)),
        "mae": F.avg(F.abs(error)),
        "rmse": F.sqrt(F.avg(error * error)),
        "bias": F.avg(error),
        "median_ae": F.median(F.abs(error)),
    }


def errors_with_rank_correlation(df: DataFrame, group: list[str], prediction: str, actual: str) -> DataFrame:
    """Error metrics and Spearman correlation of each group; groups with a null key are left out.

    The rows are written once; both ranks count their cells from that table.
    """
    rows = written.once(df.select(*group, prediction, actual), "ranked-rows")
    ranked = with_average_rank(with_average_rank(rows, group, prediction, "_rp", rows), group, actual, "_ra", rows)
    return ranked.groupBy(*group).agg(*[c.alias(n) for n, c in error_metrics(prediction, actual).items()], correlation("_rp", "_ra").alias("spearman"))


def errors_by_sets(df: DataFrame, sets: list[list[str]], prediction: str, actual: str) -> DataFrame:
    """Error metrics over several grouping sets in one query; ``grouping`` tells which."""
    every = sorted({c for s in sets for c in s})
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in every])
    return grouped.agg(F.grouping_id().cast("long").alias("grouping"), *[c.alias(n) for n, c in error_metrics(prediction, actual).items()])


def by_populations(df: DataFrame, populations: dict[str, Column]) -> DataFrame:
    """A row for each population that a row belongs to."""
    which = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in populations.items()]))
    return df.withColumn("population", F.explode(which))


def brier(probability: str, outcome: str) -> Column:
    d = F.col(probability) - F.col(outcome).cast("double")
    return F.avg(d * d)


def log_loss(probability: str, outcome: str, eps: float = 1e-12) -> Column:
    p = F.least(F.greatest(F.col(probability), F.lit(eps)), F.lit(1 - eps))
    return -F.avg(F.when(F.col(outcome).cast("int") == 1, F.ln(p)).otherwise(F.ln(1 - p)))


def multiclass_metrics(probabilities: list[str], actual_index: str, eps: float = 1e-12) -> dict[str, Column]:
    """Log loss, Brier score and accuracy for classes 0 .. n-1; of equal probabilities the first class counts."""
    p = F.array(*[F.col(c).cast("double") for c in probabilities])
    own = F.element_at(p, F.col(actual_index).cast("int") + 1)
    squares = F.aggregate(F.transform(p, lambda x, i: F.pow(x - F.when(i == F.col(actual_index), 1.0).otherwise(0.0), 2)), F.lit(0.0), lambda a, x: a + x)
    return {
        "log_loss": -F.avg(F.ln(F.least(F.greatest(own, F.lit(eps)), F.lit(1 - eps)))),
        "brier": F.avg(squares),
        "accuracy": F.avg((F.array_position(p, F.array_max(p)) == F.col(actual_index) + 1).cast("double")),
    }


def poisson_nll(rate: Column, count: Column) -> Column:
    """Negative log-likelihood of a count of 0 to 20."""
    return rate - count * F.ln(rate) + F.ln(F.factorial(count.cast("int")).cast("double"))


def joint_score_nll(home_rate: Column, away_rate: Column, home: Column, away: Column, rho: Column, eps: float = 1e-12) -> Column:
    """Negative log-likelihood of a score with low-score dependence."""
    p = poisson_pmf(home_rate, home) * poisson_pmf(away_rate, away) * low_score_factor(home, away, home_rate, away_rate, rho)
    return -F.ln(F.greatest(p, F.lit(eps)))


def likeliest_score(home_rate: Column, away_rate: Column, most: int = 8) -> Column:
    """struct(h, a) of the most probable score; of equal ones the first, home goals before away goals."""
    home, away = poisson_pmf_upto(home_rate, most), poisson_pmf_upto(away_rate, most)
    best = lambda p: F.array_position(p, F.array_max(p)).cast("int") - 1
    return F.struct(best(home).alias("h"), best(away).alias("a"))


def calibration(df: DataFrame, group: list[str], prediction: str, actual: str, bin_of: Column | str) -> DataFrame:
    """Rows, mean prediction and mean outcome of each bin; rows without a bin are left out."""
    binned = df.withColumn("bin", F.col(bin_of) if isinstance(bin_of, str) else bin_of).filter("bin is not null")
    return binned.groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("rows"), F.avg(prediction).alias("predicted"), F.avg(F.col(actual).cast("double")).alias("observed"))


def with_equal_count_bin(df: DataFrame, group: list[str], value: str, tie: str, bins: int, name: str = "bin") -> DataFrame:
    """``df`` with the 0-based quantile bin by rank; equal values are told apart by ``tie``. Groups with a null key are left out."""
    ranked = ranks_below(df, group, value, tie)
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    r = F.col("_below") + F.row_number().over(Window.partitionBy(*group, "_v", "_tie").orderBy(tie))
    binned = ranked.withColumn("_r", r).join(relational.small(sizes), group)
    place = F.when(F.col("_n") <= 1, 0).otherwise(F.greatest(F.ceil((F.col("_r") - 1) * bins / (F.col("_n") - 1)) - 1, F.lit(0))).cast("int")
    return binned.withColumn(name, place).drop("_below", "_cell", "_v", "_tie", "_r", "_n")


def edge_bin(value: Column, edges: list[float]) -> Column:
    """0-based bin of right-closed edges; the lowest edge belongs to the first bin; beyond the edges: null."""
    out = F.when(value < edges[0], None)
    for i, edge in enumerate(edges[1:]):
        out = out.when(value <= edge, F.lit(i))
    return out.cast("int")


def with_empty_bins(binned: DataFrame, groups: DataFrame, bins: int) -> DataFrame:
    """Calibration rows with the empty bins of each group as rows of 0."""
    every = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(binned, [*groups.columns, "bin"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def top_k(df: DataFrame, group: list[str], prediction: str, actual: str, tie: str, ks: tuple[int, ...]) -> DataFrame:
    """Of the k rows with the highest prediction per group: actual mean and overlap with the actual top k."""
    w = Window.partitionBy(*group)
    ranked = df.withColumns({"_rp": F.row_number().over(w.orderBy(F.desc(prediction), tie)), "_ra": F.row_number().over(w.orderBy(F.desc(actual), tie))})
    rows = ranked.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter("_rp <= k or _ra <= k")
    both = F.count_if((F.col("_rp") <= F.col("k")) & (F.col("_ra") <= F.col("k")))
    return rows.groupBy(*group, "k").agg(F.avg(F.when(F.col("_rp") <= F.col("k"), F.col(actual))).alias("top_actual_mean"), (both / F.greatest(F.count_if(F.col("_ra") <= F.col("k")), F.lit(1))).alias("overlap"))


def share_of_group(value: str, group: list[str], fallback: Column) -> Column:
    """A row's share of its group's sum; if the sum is 0, its share of the fallback."""
    w = Window.partitionBy(*group)
    total, other = F.sum(value).over(w), F.sum(fallback).over(w)
    return F.when(total > 0, F.col(value) / total).when(other > 0, fallback / other).otherwise(0.0)


def competition_bonus(score: str, eligible: Column, group: list[str]) -> Column:
    """3, 2 and 1 to the first three places among eligible rows; equal scores share a place and use up the next."""
    w = Window.partitionBy(*group, eligible).orderBy(F.desc(score))
    place = F.rank().over(w)
    return F.when(eligible & (place <= 3), 4 - place).otherwise(0).cast("long")


def paired(df: DataFrame, keys: list[str], model: str, left: str, right: str, values: list[str]) -> DataFrame:
    """Rows of two models side by side: ``left_{value}``, ``right_{value}``; one shuffle by key."""
    pick = lambda which, v: F.max(F.when(F.col(model) == which, F.col(v)))
    out = df.filter(F.col(model).isin(left, right)).groupBy(*keys).agg(F.count_distinct(model).alias("_n"), *[pick(m, v).alias(f"{side}_{v}") for side, m in (("left", left), ("right", right)) for v in values])
    return out.filter("_n = 2").drop("_n")


def draw_summary(draws: Column) -> dict[str, Column]:
    """Mean, spread, quantiles and tail shares of an array of draws; quantiles are interpolated."""
    n = F.size(draws)
    total = F.aggregate(draws, F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate(draws, F.lit(0.0), lambda a, x: a + x * x)
    ordered = F.array_sort(draws)

    def quantile(q: float) -> Column:
        at = (n - 1) * q
        low = F.element_at(ordered, F.floor(at).cast("int") + 1)
        high = F.element_at(ordered, F.ceil(at).cast("int") + 1)
        return low + (high - low) * (at - F.floor(at))

    share = lambda test: F.size(F.filter(draws, test)) / n
    return {
        "points_mean": total / n,
        "points_std": F.sqrt(F.greatest(squares / n - F.pow(total / n, 2), F.lit(0.0))),
        **{f"points_p{round(100 * q)}": quantile(q) for q in (0.1, 0.25, 0.5, 0.75, 0.9)},
        "prob_eq_0": share(lambda x: x == 0),
        "prob_ge_1": share(lambda x: x >= 1),
        "prob_ge_5": share(lambda x: x >= 5),
        "prob_ge_10": share(lambda x: x >= 10),
    }


def sum_draws(df: DataFrame, keys: list[str], draws: str) -> DataFrame:
    """Element-wise sums of the draws of a group, by position; no group is gathered as a list."""
    at = df.select(*keys, F.posexplode(draws).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.sum("_x").alias("_x"))
    return at.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias(draws))


def distribution_metrics(actual: str, tails: dict[str, tuple[str, int]], zero: str, central: tuple[str, str]) -> dict[str, Column]:
    """Brier scores of tails (name -> probability column and threshold), zero rates, coverage and width of a central range."""
    low, high = central
    flag = lambda c: c.cast("int").cast("double")
    made = {"rows": F.count(F.lit(1))}
    for name, (probability, least) in tails.items():
        d = F.col(probability) - flag(F.col(actual) >= least)
        made[name] = F.avg(d * d)
    inside = F.col(actual).between(F.col(low), F.col(high))
    return made | {"zero_rate_predicted": F.avg(zero), "zero_rate_actual": F.avg(flag(F.col(actual) == 0)), "coverage": F.avg(flag(inside)), "sharpness": F.avg(F.col(high) - F.col(low))}


def component_metrics(df: DataFrame, group: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """A row for each group and component: means, absolute error and the Brier score of whether it happens."""
    parts = F.array(*[F.struct(F.lit(n).alias("component"), F.coalesce(F.col(p).cast("double"), F.lit(0.0)).alias("p"), F.coalesce(F.col(a).cast("double"), F.lit(0.0)).alias("a")) for n, (p, a) in pairs.items()])
    long = df.select(*group, F.explode(parts).alias("x")).select(*group, "x.*")
    miss = F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0)) - (F.col("a") > 0).cast("int").cast("double")
    return long.groupBy(*group, "component").agg(F.count(F.lit(1)).alias("rows"), F.avg("p").alias("mean_prediction"), F.avg("a").alias("mean_actual"), F.avg(F.abs(F.col("p") - F.col("a"))).alias("mae"), F.avg(miss * miss).alias("event_brier"))
