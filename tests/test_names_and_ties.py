"""Module constants that queries read, and the order of equally good players."""

import ast
from pathlib import Path

from pyspark.sql import functions as F

from pitwise.plans import decisions

PLANS = Path(decisions.__file__).parent


def test_no_module_assigns_a_name_twice():
    for path in sorted(PLANS.glob("*.py")):
        names = [t.id for node in ast.parse(path.read_text()).body if isinstance(node, ast.Assign) for t in node.targets if isinstance(t, ast.Name)]
        assert len(names) == len(set(names)), path.name


def test_finder_breaks_ties_as_told(spark):
    rows = [(1, "b", 50, 5.0, 0.5), (2, "a", 50, 5.0, 0.9), (3, "c", 40, 4.0, 0.5)]
    df = spark.createDataFrame(rows, "player_uid long, player_name string, price_tenths long, expected_points double, p_appearance double")
    uids = lambda found: [r.player_uid for r in found.collect()]
    assert uids(decisions.finder(df, F.lit(60))) == [2, 1, 3]
    assert uids(decisions.finder(df, F.lit(60), ties=((F.asc, "price_tenths"), (F.asc, "player_uid")))) == [1, 2, 3]


def test_value_finder_has_the_smaller_id_first(spark, tmp_path):
    from pitwise.plans import decision_queries

    # ids 83 apart have the same points; those 4150 apart the same chance to play as well
    rows = [(83 * k, f"n{k}", "b", 10) for k in range(1, 8)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = decision_queries.value_finder_top5(spark, str(tmp_path)).collect()
    assert [r.player_uid for r in found] == [83, 166, 249, 332, 415]


def test_equal_values_have_no_correlation_however_many(spark):
    from pitwise.operators import metrics

    values = [0.1, 0.7, 231708.5, 2317085.5, 1 / 3]
    df = spark.range(0, 300_000, 1, 16).crossJoin(spark.createDataFrame([(v,) for v in values], "x double")).selectExpr("x AS g", "x", "CAST(id % 977 AS DOUBLE) AS y", "IF(id % 3 = 0, NULL, x + id) AS z")
    found = df.groupBy("g").agg(metrics.correlation("x", "y").alias("xy"), metrics.correlation("y", "x").alias("yx"), metrics.correlation("y", "z").alias("yz")).collect()
    assert len(found) == len(values) and all(r.xy is None and r.yx is None and r.yz is not None for r in found)
