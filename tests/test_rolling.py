"""Models refitted at every fold: selection and fits against plain loops, and no look ahead."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitwise.operators import pit
from pitwise.plans import minutes, model_queries, rolling, rolling_queries

SF = "/root/testdata/sf0.001"
OUT = ["p_appearance", "p_start", "p_reached_60", "p_played_90", "expected_minutes"]


@pytest.fixture(scope="module")
def framed(spark):
    rows, folds = rolling_queries.frame(spark, SF)
    return rows, folds


def predictions(rows, history, folds):
    """Every by-fold model of ``rows``, as (fold, fixture) -> rounded values."""
    made = {}
    states = lambda df: [c.alias(n) for n, c in minutes.summary_probabilities(F.col("states")).items()]
    for name, df in (("M6", rolling.bucket_ensemble(history, folds)), ("M7", rolling.hierarchical(history, folds))):
        made |= {(name, r.fold_id, r.fixture_key): [round(r[c], 9) for c in OUT] for r in df.select("fold_id", "fixture_key", *states(df)).collect()}
    rates = rolling.component_rates(rows, history, folds)
    made |= {("rates", r.fold_id, r.fixture_key): [round(r.goals_scored_per90, 9), round(r.assists_per90, 9), round(r.assisted_goal_rate, 9)] for r in rates.select("fold_id", "fixture_key", "goals_scored_per90", "assists_per90", "assisted_goal_rate").collect()}
    return made


def test_later_results_change_no_earlier_fold(spark, framed):
    rows, folds = framed
    cuts = sorted((r.information_cutoff, r.fold_id) for r in folds.collect())
    middle, fold = cuts[len(cuts) // 2]
    # whatever is known from the cutoff on is turned upside down, the features of the rows stay
    late = F.col("available_time") >= F.lit(middle)
    turned = rows.withColumns({"state": F.when(late, "START_90").otherwise(F.col("state")), "minutes": F.when(late, 90).otherwise(F.col("minutes")).cast("long"), "starts": F.when(late, 1).otherwise(F.col("starts")).cast("long"), "goals_scored": F.when(late, 9).otherwise(F.col("goals_scored")).cast("long")})
    before, after = predictions(rows, rows, folds), predictions(rows, turned, folds)
    upto = {f for c, f in cuts if c <= middle}
    assert fold in upto and len(upto) > 3
    early = {k for k in before if k[1] in upto}
    assert early and all(before[k] == after[k] for k in early)
    assert any(before[k] != after[k] for k in before if k[1] not in upto)


@pytest.mark.parametrize("most", [1, 7, 64])
def test_latest_rows(spark, framed, most):
    rows, folds = framed
    data = [(r.available_time, r.fixture_key) for r in rows.select("available_time", "fixture_key").collect()]
    want = Counter()
    for f in folds.collect():
        want.update((f.fold_id, k) for _, k in sorted((x for x in data if x[0] < f.information_cutoff), reverse=True)[:most])
    found = pit.latest_before(rows.select("fixture_key", "available_time"), folds, "available_time", "information_cutoff", "fixture_key", most)
    assert Counter((r.fold_id, r.fixture_key) for r in found.collect()) == want


def test_softmax_of_three_folds_by_a_plain_loop(spark, framed):
    rows, folds = framed
    numeric = model_queries.SOFTMAX_NUMERIC
    data = [r.asDict() for r in rows.select("fold_id", "fixture_key", "available_time", "state", "position", *numeric).collect()]
    cuts = sorted((r.information_cutoff, r.fold_id) for r in folds.collect())
    found = {(r.fold_id, r.fixture_key): r.states for r in rolling.softmax(rows, folds, numeric, ["position"]).select("fold_id", "fixture_key", "states").collect()}
    for cut, fold in (cuts[0], cuts[5], cuts[-1]):
        known = sorted((r for r in data if r["available_time"] < cut), key=lambda r: r["fixture_key"])
        test = [r for r in data if r["fold_id"] == fold]
        if not known:
            assert all(found[fold, r["fixture_key"]] == pytest.approx([1 / 6] * 6) for r in test)
            continue
        levels = sorted({r["position"] for r in known})
        mean = [sum(r[n] or 0 for r in known) / len(known) for n in numeric]
        spread = [(sum(((r[n] or 0) - m) ** 2 for r in known) / len(known)) ** 0.5 for n, m in zip(numeric, mean, strict=True)]
        row = lambda r: [1.0, *[((r[n] or 0) - m) / (s if s >= 1e-6 else 1) for n, m, s in zip(numeric, mean, spread, strict=True)], *[float(r["position"] == v) for v in levels]]  # noqa: E731, B023
        x = np.array([row(r) for r in known])
        y = [minutes.STATES.index(r["state"]) for r in known]
        w = np.zeros((x.shape[1], 6))
        w[0] = [np.log((y.count(s) + 1) / (len(y) + 6)) for s in range(6)]
        for _ in range(minutes.SOFTMAX_ROUNDS):
            gradient = np.zeros_like(w)
            for xi, yi in zip(x, y, strict=True):
                e = np.exp(xi @ w - max(xi @ w))
                gradient += np.outer(xi, e / e.sum() - np.eye(6)[yi]) / len(x)
            w -= minutes.SOFTMAX_RATE * (gradient + minutes.SOFTMAX_L2 * np.vstack([np.zeros(6), w[1:]]))
        for r in test:
            e = np.exp(np.array(row(r)) @ w)
            assert found[fold, r["fixture_key"]] == pytest.approx(list(e / e.sum()), abs=1e-9)


def test_totals_as_of_are_strict(spark):
    history = spark.createDataFrame([("a", 1, 5, "x"), ("a", 2, 7, "y"), ("a", 2, 1, "z"), ("b", 1, 3, "w")], "k string, s long, v long, p string").withColumn("t", F.timestamp_seconds("s"))
    targets = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 9), ("c", 9), ("a", None)], "k string, s long").withColumn("c", F.timestamp_seconds("s"))
    found = pit.totals_as_of(targets, history, ["k"], "c", "t", {"v": F.col("v")}, {"p": F.struct("s", "v", "p")})
    assert {(r.k, r.s): (r.v, r.p) for r in found.collect()} == {("a", 1): (None, None), ("a", 2): (5, "x"), ("a", 3): (13, "y"), ("b", 9): (3, "w"), ("c", 9): (None, None), ("a", None): (None, None)}
