"""Queries on metrics: errors, calibration, ranking, probabilities, draws, bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwise.functions import probability
from pitwise.operators import bootstrap, metrics, relational

from .league import FACT_SQL, FIXTURE_SQL, PANEL_SQL, facts, fixtures, panel, table

QUERIES: dict = {}


def query(sql: str | None = None, doubles: tuple[str, ...] = ()):
    def add(f):
        QUERIES[f.__name__] = (f, sql, list(doubles))
        return f

    return add


#: A forecast of points that needs no model: a fifth of the minutes' share with a wobble by fixture.
_FORECAST = "CAST(minutes AS DOUBLE) / 20.0 + CAST(fixture_key % 7 AS DOUBLE) / 3.0"
SCORED_SQL = PANEL_SQL + f", scored AS (SELECT *, {_FORECAST} AS prediction, CASE fixture_key % 3 WHEN 0 THEN 'X0' WHEN 1 THEN 'X1' ELSE 'X2' END AS model FROM panel)"
_ERRORS = "CAST(count(*) AS BIGINT) AS rows, avg(abs(prediction - total_points)) AS mae, sqrt(avg((prediction - total_points) ** 2)) AS rmse, avg(prediction - total_points) AS bias, median(abs(prediction - total_points)) AS median_ae"
_E = ["mae", "rmse", "bias", "median_ae"]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("fixture_key") % 3
    return panel(spark, sf_dir).withColumns({"prediction": F.expr(_FORECAST), "model": F.when(k == 0, "X0").when(k == 1, "X1").otherwise("X2")})


@query(SCORED_SQL + f" SELECT model, {_ERRORS} FROM scored GROUP BY 1", _E)
def metrics_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("model").agg(*[c.alias(n) for n, c in metrics.error_metrics("prediction", "total_points").items()])


@query(SCORED_SQL + f" SELECT model, position, season, CAST(grouping(model, position, season) AS BIGINT) AS grouping, {_ERRORS} FROM scored GROUP BY GROUPING SETS ((model), (model, season), (model, position))", _E)
def metrics_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.errors_by_sets(scored(spark, sf_dir), [["model"], ["model", "season"], ["model", "position"]], "prediction", "total_points")


@query(SCORED_SQL + f", p AS (SELECT *, 'all' AS population FROM scored UNION ALL SELECT *, 'played' FROM scored WHERE minutes > 0 UNION ALL SELECT *, 'started' FROM scored WHERE starts > 0) SELECT model, population, {_ERRORS} FROM p GROUP BY 1, 2", _E)
def metrics_population_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = metrics.by_populations(scored(spark, sf_dir), {"all": F.lit(True), "played": F.col("minutes") > 0, "started": F.col("starts") > 0})
    return df.groupBy("model", "population").agg(*[c.alias(n) for n, c in metrics.error_metrics("prediction", "total_points").items()])


@query(SCORED_SQL + ", r AS (SELECT model, season, rank() OVER (PARTITION BY model, season ORDER BY prediction) + (count(*) OVER (PARTITION BY model, season, prediction) - 1) / 2.0 AS a, rank() OVER (PARTITION BY model, season ORDER BY total_points) + (count(*) OVER (PARTITION BY model, season, total_points) - 1) / 2.0 AS b FROM scored) SELECT model, season, CASE WHEN var_pop(a) > 0 AND var_pop(b) > 0 THEN corr(a, b) END AS spearman FROM r GROUP BY 1, 2", ["spearman"])
def spearman_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.errors_with_rank_correlation(scored(spark, sf_dir), ["model", "season"], "prediction", "total_points").select("model", "season", "spearman")


@query(SCORED_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY prediction, fixture_key) AS k, count(*) OVER (PARTITION BY model) AS n FROM scored), b AS (SELECT *, CAST(CASE WHEN n <= 1 THEN 0 ELSE greatest(ceil((k - 1) * 10 / (n - 1)) - 1, 0) END AS INTEGER) AS bin FROM r) SELECT model, bin, CAST(count(*) AS BIGINT) AS rows, avg(prediction) AS predicted, avg(total_points) AS observed FROM b GROUP BY 1, 2", ["predicted", "observed"])
def calibration_equal_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = metrics.with_equal_count_bin(scored(spark, sf_dir), ["model"], "prediction", "fixture_key", 10)
    return metrics.calibration(binned, ["model"], "prediction", "total_points", "bin")


_EDGES = [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
_EDGE_SQL = "CAST(CASE WHEN prediction < 0 THEN NULL WHEN prediction <= 1 THEN 0 WHEN prediction <= 2 THEN 1 WHEN prediction <= 3 THEN 2 WHEN prediction <= 4 THEN 3 WHEN prediction <= 5 THEN 4 END AS INTEGER)"


@query(SCORED_SQL + f", b AS (SELECT *, {_EDGE_SQL} AS bin FROM scored) SELECT model, bin, CAST(count(*) AS BIGINT) AS rows, avg(prediction) AS predicted, avg(total_points) AS observed FROM b WHERE bin IS NOT NULL GROUP BY 1, 2", ["predicted", "observed"])
def calibration_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.calibration(scored(spark, sf_dir), ["model"], "prediction", "total_points", metrics.edge_bin(F.col("prediction"), _EDGES))


@query(SCORED_SQL + f", b AS (SELECT *, {_EDGE_SQL} AS bin FROM scored WHERE minutes = 0), c AS (SELECT model, bin, CAST(count(*) AS BIGINT) AS rows, avg(prediction) AS predicted, avg(total_points) AS observed FROM b WHERE bin IS NOT NULL GROUP BY 1, 2), g AS (SELECT DISTINCT model, CAST(i AS INTEGER) AS bin FROM scored, range(5) AS t(i)) SELECT model, bin, coalesce(rows, 0) AS rows, predicted, observed FROM g LEFT JOIN c USING (model, bin)", ["predicted", "observed"])
def calibration_with_empty_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    found = metrics.calibration(df.filter("minutes = 0"), ["model"], "prediction", "total_points", metrics.edge_bin(F.col("prediction"), _EDGES))
    return metrics.with_empty_bins(found, df.select("model").distinct(), 5)


_TOP = ", r AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY prediction DESC, fixture_key) AS rp, row_number() OVER (PARTITION BY {g} ORDER BY total_points DESC, fixture_key) AS ra FROM scored), x AS (SELECT * FROM r, (VALUES (5), (10)) AS t(k)) SELECT {g}, CAST(k AS INTEGER) AS k, avg(total_points) FILTER (rp <= k) AS top_actual_mean, count(*) FILTER (rp <= k AND ra <= k) / greatest(count(*) FILTER (ra <= k), 1) AS overlap FROM x WHERE rp <= k OR ra <= k GROUP BY ALL"


@query(SCORED_SQL + _TOP.format(g="season, gameweek"), ["top_actual_mean", "overlap"])
def topk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_k(scored(spark, sf_dir), ["season", "gameweek"], "prediction", "total_points", "fixture_key", (5, 10))


@query(SCORED_SQL + _TOP.format(g="model, position"), ["top_actual_mean", "overlap"])
def topk_by_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_k(scored(spark, sf_dir), ["model", "position"], "prediction", "total_points", "fixture_key", (5, 10))


@query("WITH p AS (SELECT l.*, least(greatest(CAST(d.n_chars AS DOUBLE) / 4000.0, 0.0), 1.0) AS p FROM labels l JOIN documents d USING (doc_id)) SELECT avg((p - quality) ** 2) AS brier, -avg(CASE WHEN quality = 1 THEN ln(least(greatest(p, 1e-12), 1 - 1e-12)) ELSE ln(1 - least(greatest(p, 1e-12), 1 - 1e-12)) END) AS log_loss, avg(p) AS predicted, avg(quality) AS observed FROM p", ["brier", "log_loss", "predicted", "observed"])
def brier_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", probability.clip(F.col("n_chars") / 4000.0, 0, 1).alias("p"))
    df = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return df.agg(metrics.brier("p", "quality").alias("brier"), metrics.log_loss("p", "quality").alias("log_loss"), F.avg("p").alias("predicted"), F.avg("quality").alias("observed"))


_RATES = {"home_rate": "1.0 + CAST(home_team_uid % 5 AS DOUBLE) / 5.0", "away_rate": "0.8 + CAST(away_team_uid % 4 AS DOUBLE) / 5.0"}
RATED_SQL = FIXTURE_SQL + f", rated AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _RATES.items())} FROM fixture)"


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures(spark, sf_dir).withColumns({k: F.expr(v) for k, v in _RATES.items()})


_PMF = "exp(-{r}) * pow({r}, {k}) / factorial(CAST({k} AS INTEGER))"
_TAU = "CASE WHEN h = 0 AND a = 0 THEN 1 + 0.1 * home_rate * away_rate WHEN h = 0 AND a = 1 THEN 1 - 0.1 * home_rate WHEN h = 1 AND a = 0 THEN 1 - 0.1 * away_rate WHEN h = 1 AND a = 1 THEN 1.1 ELSE 1.0 END"
GRID_SQL = RATED_SQL + ", pairs AS (SELECT DISTINCT home_rate, away_rate FROM rated), grid AS (SELECT home_rate, away_rate, CAST(h.h AS INTEGER) AS h, CAST(a.a AS INTEGER) AS a FROM pairs, range(21) AS h(h), range(21) AS a(a)), cell0 AS (SELECT *, " + _PMF.format(r="home_rate", k="h") + " * " + _PMF.format(r="away_rate", k="a") + f" AS p, {_TAU} AS tau FROM grid), cell AS (SELECT * FROM cell0)"


@query(GRID_SQL + " SELECT home_rate, away_rate, sum(p) FILTER (h > a) / sum(p) AS home, sum(p) FILTER (h = a) / sum(p) AS draw, sum(p) FILTER (h < a) / sum(p) AS away FROM cell GROUP BY 1, 2", ["home_rate", "away_rate", "home", "draw", "away"])
def outcome_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = rated(spark, sf_dir).select("home_rate", "away_rate").distinct()
    return pairs.withColumn("o", probability.outcome_probabilities(F.col("home_rate"), F.col("away_rate"))).select("home_rate", "away_rate", "o.*")


@query(GRID_SQL + " SELECT home_rate, away_rate, sum(p * tau) FILTER (h > a) / sum(p * tau) AS home, sum(p * tau) FILTER (h = a) / sum(p * tau) AS draw, sum(p * tau) FILTER (h < a) / sum(p * tau) AS away FROM cell GROUP BY 1, 2", ["home_rate", "away_rate", "home", "draw", "away"])
def dixon_coles_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = rated(spark, sf_dir).select("home_rate", "away_rate").distinct()
    return pairs.withColumn("o", probability.outcome_probabilities(F.col("home_rate"), F.col("away_rate"), F.lit(-0.1))).select("home_rate", "away_rate", "o.*")


@query(GRID_SQL + " SELECT DISTINCT home_rate, h AS goals, " + _PMF.format(r="home_rate", k="h") + " AS p FROM cell WHERE h <= 8", ["home_rate", "p"])
def poisson_goal_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = rated(spark, sf_dir).select("home_rate").distinct()
    return rates.select("home_rate", F.posexplode(probability.poisson_pmf_upto(F.col("home_rate"), 8)).alias("goals", "p"))


@query(RATED_SQL + ", r AS (SELECT DISTINCT home_rate AS rate FROM rated), n AS (SELECT rate, CAST(i AS INTEGER) AS i FROM r, range(20) AS t(i)) SELECT rate, 1 - sum(" + _PMF.format(r="rate", k="i") + ") FILTER (i < 3) AS tail, sum(" + _PMF.format(r="rate", k="i") + " * (i // 2)) AS half FROM n GROUP BY 1", ["rate", "tail", "half"])
def poisson_tail_and_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = rated(spark, sf_dir).select(F.col("home_rate").alias("rate")).distinct()
    return rates.select("rate", probability.poisson_tail(F.col("rate"), 3).alias("tail"), probability.poisson_floor_mean(F.col("rate"), 2).alias("half"))


@query(RATED_SQL + " SELECT season, avg(home_rate - home_goals * ln(home_rate) + ln(factorial(CAST(home_goals AS INTEGER)))) AS home_nll, avg(away_rate - away_goals * ln(away_rate) + ln(factorial(CAST(away_goals AS INTEGER)))) AS away_nll FROM rated GROUP BY 1", ["home_nll", "away_nll"])
def poisson_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rated(spark, sf_dir)
    one = lambda side: F.avg(metrics.poisson_nll(F.col(f"{side}_rate"), F.col(f"{side}_goals"))).alias(f"{side}_nll")
    return df.groupBy("season").agg(one("home"), one("away"))


@query(RATED_SQL + ", x AS (SELECT *, home_goals AS h, away_goals AS a FROM rated) SELECT season, -avg(ln(" + _PMF.format(r="home_rate", k="h") + " * " + _PMF.format(r="away_rate", k="a") + f" * ({_TAU}))) AS nll FROM x GROUP BY 1", ["nll"])
def joint_score_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    nll = metrics.joint_score_nll(F.col("home_rate"), F.col("away_rate"), F.col("home_goals"), F.col("away_goals"), F.lit(-0.1))
    return rated(spark, sf_dir).groupBy("season").agg(F.avg(nll).alias("nll"))


@query(GRID_SQL + ", best AS (SELECT home_rate, away_rate, h, a, row_number() OVER (PARTITION BY home_rate, away_rate ORDER BY round(p, 12) DESC, h, a) AS k FROM cell WHERE h <= 8 AND a <= 8) SELECT home_rate, away_rate, h, a FROM best WHERE k = 1", ["home_rate", "away_rate"])
def likeliest_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = rated(spark, sf_dir).filter("home_rate <> 1.0 and away_rate <> 1.0").unionByName(rated(spark, sf_dir)).select("home_rate", "away_rate").distinct()
    rounded = lambda c: F.transform(probability.poisson_pmf_upto(F.col(c), 8), lambda p: F.round(p, 12))
    best = lambda p: F.array_position(p, F.array_max(p)).cast("int") - 1
    return pairs.select("home_rate", "away_rate", best(rounded("home_rate")).alias("h"), best(rounded("away_rate")).alias("a"))


@query(RATED_SQL + ", c AS (SELECT season, unnest(['0-0', '0-1', '1-0', '1-1']) AS cell, unnest([0, 0, 1, 1]) AS h, unnest([0, 1, 0, 1]) AS a, home_rate, away_rate, home_goals, away_goals FROM rated) SELECT season, cell, avg(" + _PMF.format(r="home_rate", k="h") + " * " + _PMF.format(r="away_rate", k="a") + ") AS predicted, avg(CASE WHEN home_goals = h AND away_goals = a THEN 1.0 ELSE 0.0 END) AS observed FROM c GROUP BY 1, 2", ["predicted", "observed"])
def low_score_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(f"{h}-{a}").alias("cell"), F.lit(h).alias("h"), F.lit(a).alias("a")) for h in (0, 1) for a in (0, 1)])
    df = rated(spark, sf_dir).withColumn("c", F.explode(cells)).withColumns({"cell": F.col("c.cell")})
    p = probability.poisson_pmf(F.col("home_rate"), F.col("c.h")) * probability.poisson_pmf(F.col("away_rate"), F.col("c.a"))
    hit = ((F.col("home_goals") == F.col("c.h")) & (F.col("away_goals") == F.col("c.a"))).cast("double")
    return df.groupBy("season", "cell").agg(F.avg(p).alias("predicted"), F.avg(hit).alias("observed"))


@query(GRID_SQL + ", o AS (SELECT home_rate, away_rate, sum(p) FILTER (h > a) / sum(p) AS home, sum(p) FILTER (h = a) / sum(p) AS draw, sum(p) FILTER (h < a) / sum(p) AS away FROM cell GROUP BY 1, 2), x AS (SELECT r.season, o.home, o.draw, o.away, CASE WHEN home_goals > away_goals THEN 0 WHEN home_goals = away_goals THEN 1 ELSE 2 END AS y FROM rated r JOIN o USING (home_rate, away_rate)) SELECT season, -avg(ln(CASE y WHEN 0 THEN home WHEN 1 THEN draw ELSE away END)) AS log_loss, avg((home - CASE WHEN y = 0 THEN 1 ELSE 0 END) ** 2 + (draw - CASE WHEN y = 1 THEN 1 ELSE 0 END) ** 2 + (away - CASE WHEN y = 2 THEN 1 ELSE 0 END) ** 2) AS brier, avg(CASE WHEN (CASE WHEN home >= draw AND home >= away THEN 0 WHEN draw >= away THEN 1 ELSE 2 END) = y THEN 1.0 ELSE 0.0 END) AS accuracy FROM x GROUP BY 1", ["log_loss", "brier", "accuracy"])
def multiclass_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rated(spark, sf_dir)
    pairs = df.select("home_rate", "away_rate").distinct().withColumn("o", probability.outcome_probabilities(F.col("home_rate"), F.col("away_rate")))
    pairs = pairs.select("home_rate", "away_rate", F.round("o.home", 12).alias("home"), F.round("o.draw", 12).alias("draw"), F.round("o.away", 12).alias("away"))
    y = F.when(F.col("home_goals") > F.col("away_goals"), 0).when(F.col("home_goals") == F.col("away_goals"), 1).otherwise(2)
    joined = df.withColumn("y", y).join(relational.small(pairs), ["home_rate", "away_rate"])
    return joined.groupBy("season").agg(*[c.alias(n) for n, c in metrics.multiclass_metrics(["home", "draw", "away"], "y").items()])


@query(SCORED_SQL + ", s AS (SELECT *, sum(goals_scored) OVER g AS total, count(*) OVER g AS n FROM scored WINDOW g AS (PARTITION BY gameweek, team_uid)), h AS (SELECT gameweek, team_uid, fixture_key, CASE WHEN total > 0 THEN goals_scored / total ELSE 1.0 / n END AS share FROM s) SELECT gameweek, team_uid, sum(share * share) AS hhi, 1.0 / sum(share * share) AS effective FROM h GROUP BY 1, 2", ["hhi", "effective"])
def attacking_shares_hhi(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = metrics.share_of_group("goals_scored", ["gameweek", "team_uid"], F.lit(1.0))
    df = scored(spark, sf_dir).withColumn("share", share).groupBy("gameweek", "team_uid").agg(F.sum(F.col("share") * F.col("share")).alias("hhi"))
    return df.withColumn("effective", 1.0 / F.col("hhi"))


@query(FACT_SQL + ", e AS (SELECT fixture_key, rank() OVER (PARTITION BY gameweek, minutes > 0 ORDER BY bps DESC) AS r, minutes > 0 AS ok FROM fact) SELECT fixture_key, CAST(CASE WHEN ok AND r <= 3 THEN 4 - r ELSE 0 END AS BIGINT) AS bonus FROM e")
def bonus_competition_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select("fixture_key", metrics.competition_bonus("bps", F.col("minutes") > 0, ["gameweek"]).alias("bonus"))


@query("WITH x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, CAST(round(unnest(embedding) * 20) AS BIGINT) AS v FROM embeddings), s AS (SELECT vec_id, avg(v) AS points_mean, stddev_pop(v) AS points_std, quantile_cont(v, 0.1) AS points_p10, quantile_cont(v, 0.5) AS points_p50, quantile_cont(v, 0.9) AS points_p90, avg(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END) AS prob_eq_0, avg(CASE WHEN v >= 5 THEN 1.0 ELSE 0.0 END) AS prob_ge_5 FROM x GROUP BY 1) SELECT * FROM s", ["points_mean", "points_std", "points_p10", "points_p50", "points_p90", "prob_eq_0", "prob_ge_5"])
def draw_summary_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = F.transform("embedding", lambda x: F.round(x.cast("double") * 20).cast("double"))
    made = metrics.draw_summary(F.col("draws"))
    keep = ["points_mean", "points_std", "points_p10", "points_p50", "points_p90", "prob_eq_0", "prob_ge_5"]
    return table(spark, sf_dir, "embeddings").select("vec_id", draws.alias("draws")).select("vec_id", *[made[n].alias(n) for n in keep])


@query("WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(round(unnest(embedding) * 20) AS BIGINT) AS v FROM embeddings), s AS (SELECT label, i, sum(v) AS v FROM x GROUP BY 1, 2) SELECT label, avg(v) AS points_mean, max(v) AS most, min(v) AS least FROM s GROUP BY 1", ["points_mean", "most", "least"])
def draw_sum_by_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = F.transform("embedding", lambda x: F.round(x.cast("double") * 20).cast("double"))
    summed = metrics.sum_draws(table(spark, sf_dir, "embeddings").select("label", draws.alias("draws")), ["label"], "draws")
    return summed.select("label", metrics.draw_summary(F.col("draws"))["points_mean"].alias("points_mean"), F.array_max("draws").alias("most"), F.array_min("draws").alias("least"))


@query(SCORED_SQL + ", b AS (SELECT gameweek, player_uid, model, sum(total_points) AS pts FROM scored GROUP BY ALL), p AS (SELECT gameweek, player_uid, max(pts) FILTER (model = 'X0') AS l, max(pts) FILTER (model = 'X1') AS r FROM b WHERE model IN ('X0', 'X1') GROUP BY 1, 2 HAVING count(DISTINCT model) = 2) SELECT CAST(count(*) AS BIGINT) AS pairs, avg(CASE WHEN l > r THEN 1.0 ELSE 0.0 END) AS win_rate, avg(CASE WHEN l = r THEN 1.0 ELSE 0.0 END) AS tie_rate, avg(l - r) AS mean_difference FROM p", ["win_rate", "tie_rate", "mean_difference"])
def paired_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = scored(spark, sf_dir).groupBy("gameweek", "player_uid", "model").agg(F.sum("total_points").alias("pts"))
    df = metrics.paired(blocks, ["gameweek", "player_uid"], "model", "X0", "X1", ["pts"])
    left, right = F.col("left_pts"), F.col("right_pts")
    return df.agg(F.count(F.lit(1)).alias("pairs"), F.avg((left > right).cast("double")).alias("win_rate"), F.avg((left == right).cast("double")).alias("tie_rate"), F.avg(left - right).alias("mean_difference"))


@query()
def block_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile intervals of mean error differences, blocks of one gameweek resampled together."""
    df = scored(spark, sf_dir).withColumn("loss", F.abs(F.col("prediction") - F.col("total_points")))
    return bootstrap.block_intervals(df, ["season", "gameweek"], "model", "X0", "loss", replicates=300, seed=20260722)
