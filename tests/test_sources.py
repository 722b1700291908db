"""Sources, snapshots, publication and streams."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pitwise import cli
from pitwise.sources import snapshots, tables
from pitwise.streaming import live

SF = "/root/testdata/sf0.001"


def test_seasons(spark, tmp_path):
    df = spark.createDataFrame([("2022-23", 1), ("2023-24", 2)], "season string, v int")
    root = str(tmp_path)
    assert tables.write_seasons(df, root, "facts") == ["2022-23", "2023-24"]
    read = tables.read_seasons(spark, root, "facts", ["2023-24"])
    assert [(r.season, r.v) for r in read.collect()] == [("2023-24", 2)]
    assert tables.read_seasons(spark, root, "facts").count() == 2
    with pytest.raises(FileNotFoundError, match="2030-31"):
        tables.read_seasons(spark, root, "facts", ["2030-31"])
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_seasons(df, root, "facts")
    assert tables.read_tree(spark, root, without="2022").select("v").collect()[0].v == 2


def test_csv_and_union(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    tables.write_table(spark.createDataFrame([(1, "a")], "n int, s string"), path)
    assert tables.csv_columns(spark, path) == ["n", "s"]
    assert tables.read_csv(spark, path).dtypes == [("n", "string"), ("s", "string")]
    assert tables.read_csv(spark, path, "n int, s string").first().n == 1
    both = tables.union_all(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "b int"))
    assert both.columns == ["a", "b"] and both.count() == 2
    assert "&lt;b&gt;" in tables.html_table(spark.createDataFrame([("<b>",)], "s string"))


def test_event_live(spark, tmp_path):
    item = lambda i, v, p, m=None: {"identifier": i, "value": v, "points": p, "points_modification": m}
    payload = {"elements": [{"id": 1, "stats": {"minutes": "90"}, "explain": [{"fixture": 7, "stats": [item("minutes", 90, 2), item("goals_scored", 1, 4), item("goals_scored", 1, 4)]}]}, {"id": 2, "stats": {}, "explain": []}]}
    path = tmp_path / "live.json"
    path.write_text(json.dumps(payload))
    rows = tables.event_live_rows(tables.read_json(spark, str(path), tables.EVENT_LIVE))
    table = {r.player_id: r for r in tables.event_live_table(rows, ["minutes", "goals_scored"]).collect()}
    assert (table[1].minutes, table[1].goals_scored, table[1].event_points) == (90, 2, 10) and table[2].event_points == 0
    own = spark.createDataFrame([(1, 7, 10), (3, 7, 1)], "player_id long, fixture_id long, own long")
    status = tables.reconcile(tables.event_live_table(rows, ["minutes"]).select("player_id", "fixture_id", "event_points"), own, ["player_id", "fixture_id"], "event_points", "own")
    assert {r.player_id: r.status for r in status.collect()} == {1: "matched", 2: "no_reconstruction", 3: "no_event"}
    path.write_text("{broken")
    with pytest.raises(Exception, match="(?i)malformed|parse|broken"):
        tables.read_json(spark, str(path), tables.EVENT_LIVE).collect()


def test_snapshots(spark, tmp_path):
    early, late = datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 1, 2, tzinfo=UTC)
    first = snapshots.write_snapshot(tmp_path, "2024-25", "Event Live 1", b"{}", "http://x", early)
    second = snapshots.write_snapshot(tmp_path, "2024-25", "Event Live 1", b"{} ", "http://x", late)
    with pytest.raises(FileExistsError):
        snapshots.write_snapshot(tmp_path, "2024-25", "Event Live 1", b"", "http://x", late)
    latest = tables.latest_snapshots(spark, str(tmp_path)).collect()
    assert len(latest) == 1 and latest[0].path.endswith(second.name)
    assert snapshots.read_metadata(first)["content_length"] == 2
    digests = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in tables.with_digests(spark, str(tmp_path)).collect()}
    assert digests[first.name] == snapshots.read_metadata(first)["sha256"]
    first.write_bytes(b"other")
    with pytest.raises(ValueError, match="changed"):
        snapshots.read_metadata(first)


def test_fetch_retries_and_cache(tmp_path):
    calls, waits = [], []

    def opener(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("down")
        return b"[]"

    path = snapshots.cached_fetch(tmp_path, "2024-25", "fixtures", "http://x", opener=opener, sleep=waits.append)
    assert path.read_bytes() == b"[]" and len(calls) == 3 and waits == [0.5, 1.0]
    assert snapshots.cached_fetch(tmp_path, "2024-25", "fixtures", "http://x", offline=True) == path
    with pytest.raises(FileNotFoundError):
        snapshots.cached_fetch(tmp_path, "2024-25", "teams", "http://x", offline=True)
    with pytest.raises(ValueError, match="events"):
        snapshots.require_fields({"teams": []}, {"teams": list, "events": list})


def test_fingerprint_ignores_order(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    assert snapshots.table_fingerprint(df) == snapshots.table_fingerprint(df.orderBy(F.desc("id")).repartition(7).select("v", "id"))
    assert snapshots.table_fingerprint(df) != snapshots.table_fingerprint(df.filter("id > 0"))


def test_publication(tmp_path):
    good = lambda folder: (folder / "a.txt").write_text("x") and {"n": 1}
    done = snapshots.publish(tmp_path, "r1", good, "f1")
    assert done["state"] == "PUBLISHED" and snapshots.verify_run(tmp_path / "runs/r1") == []
    assert snapshots.publish(tmp_path, "r2", good, "f1")["state"] == "NO_CHANGE" and not (tmp_path / "runs/r2").exists()

    def bad(folder):
        (folder / "half.txt").write_text("x")
        raise RuntimeError("stage failed")

    with pytest.raises(RuntimeError):
        snapshots.publish(tmp_path, "r3", bad, "f3")
    assert json.loads((tmp_path / "latest.json").read_text())["run_id"] == "r1" and (tmp_path / "failed/r3/half.txt").exists()
    with snapshots.single_writer(tmp_path / "publish.lock"), pytest.raises(FileExistsError):
        snapshots.publish(tmp_path, "r4", good, "f4")
    (tmp_path / "runs/r1/a.txt").write_text("y")
    assert snapshots.verify_run(tmp_path / "runs/r1") == ["a.txt"]


def events_stream(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/events.parquet")
    for a in (1, 9, 17, 25):  # files in the order of time, as results arrive
        df.filter(F.dayofmonth("ts").between(a, a + 7)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(stream, tmp_path, each):
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None


def test_late_rows_are_set_aside(spark, tmp_path):
    df, stream = events_stream(spark, tmp_path)
    cut = lambda d: d.withColumns({"available": F.col("ts") + F.expr("INTERVAL 3 HOURS"), "cutoff": F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")})
    early, late = str(tmp_path / "early"), str(tmp_path / "late")
    put = lambda path: lambda b, _: b.write.mode("append").parquet(path)
    run(cut(stream), tmp_path, live.split_late("available", "cutoff", put(early), put(late)))
    n = cut(df).filter("available < cutoff").count()
    assert spark.read.parquet(early).count() == n and spark.read.parquet(late).count() == df.count() - n


def test_latest_rows_by_key(spark, tmp_path):
    df, stream = events_stream(spark, tmp_path)
    path = str(tmp_path / "latest")
    run(stream.select("user_id", "event_id", "ts"), tmp_path, live.merge_latest(path, ["user_id"], "event_id"))
    got = {r.user_id: r.event_id for r in live.read_latest(spark, path, ["user_id"], "event_id").collect()}
    assert got == {r.user_id: r.m for r in df.groupBy("user_id").agg(F.max("event_id").alias("m")).collect()}


def test_windowed_totals(spark, tmp_path):
    df, stream = events_stream(spark, tmp_path)
    stamped = live.with_availability(stream.withColumn("at", F.col("ts").cast("timestamp")), "at")
    out = str(tmp_path / "out")
    query = live.windowed_totals(live.unique_events(stamped, ["event_id"]), "at", "event_type", "value").writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    got = spark.read.parquet(out)
    want = df.groupBy(F.to_date("ts").alias("d"), "event_type").count()
    assert got.count() > 0
    joined = got.withColumn("d", F.to_date("start")).join(want, ["d", "event_type"])
    assert joined.filter("n <> count").count() == 0


def test_rolling_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    df, stream = events_stream(spark, tmp_path)
    out = str(tmp_path / "rolled")
    query = live.rolling_stream(stream, "user_id", "event_id", "ts", "value").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1 - live.LOOK_BACK, 0)
    want = df.withColumn("want", F.sum("value").over(w)).select(F.col("event_id").alias("id"), "want")
    joined = spark.read.parquet(out).join(want, "id")
    assert joined.count() == df.count() and joined.filter("abs(rolling - want) > 1e-6").count() == 0


def test_cli(capsys, spark, tmp_path):
    assert cli.main(["list"]) == 0 and "flagship" in capsys.readouterr().out
    assert cli.main(["run", "dq_duplicates", SF, str(tmp_path / "out.parquet")]) == 0
    assert spark.read.parquet(str(tmp_path / "out.parquet")).count() == 1
    assert cli.main(["publish", SF, str(tmp_path / "pub"), "r1", "dq_duplicates"]) == 0 and "PUBLISHED" in capsys.readouterr().out
    assert cli.main(["verify", str(tmp_path / "pub/runs/r1")]) == 0
