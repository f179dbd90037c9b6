import datetime as dt

from pyspark.sql import functions as F

from talus.streaming import events

SCHEMA = "id long, type string, key string, amount double, ts timestamp"


def at(minute):
    return dt.datetime(2026, 1, 1, 0, 0) + dt.timedelta(minutes=minute)


def source(spark, folder, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    return events.read_events(spark, str(folder), SCHEMA, files_per_batch=1)


def run(stream, folder, name, mode="append"):
    out, check = str(folder / f"{name}-out"), str(folder / f"{name}-check")
    if mode == "append":
        events.write_stream(stream, out, check).awaitTermination()
        return stream.sparkSession.read.parquet(out)
    raise ValueError(mode)


def test_publish_once_and_replay_add_nothing(spark, tmp_path):
    rows = [(1, "a", "k1", 1.0, at(0)), (2, "a", "k1", 1.0, at(1)), (3, "b", "k1", 1.0, at(2)), (4, "a", None, 1.0, at(3)), (5, "a", None, 1.0, at(4))]
    stream = source(spark, tmp_path / "in", rows, [(6, "a", "k1", 1.0, at(5))])
    once = events.publish_once(stream, "ts", "1 day", ("type", "key"))
    for _ in range(2):  # the second run finds nothing new
        events.write_idempotent(once, str(tmp_path / "out"), str(tmp_path / "check"), ["id"]).awaitTermination()
    got = [r["id"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("id").collect()]
    assert len(got) == 4 and got[1:] == [3, 4, 5] and got[0] in (1, 2, 6)


def test_windows_drop_late_rows(spark, tmp_path):
    early = [(i, "a", None, 1.0, at(i)) for i in range(0, 30, 5)]
    stream = source(spark, tmp_path / "in", early, [(90, "a", None, 1.0, at(200))], [(91, "a", None, 1.0, at(1))], [(92, "a", None, 1.0, at(400))])
    got = run(events.event_counts(stream, "ts", ["type"], "10 minutes", late="10 minutes"), tmp_path, "w")
    counts = {r["start"]: r["n"] for r in got.collect()}
    assert counts[at(0)] == 2 and counts[at(10)] == 2 and counts[at(20)] == 2


def test_budget_alerts_fire_once(spark, tmp_path):
    stream = source(spark, tmp_path / "in", [(1, "a", None, 50.0, at(0)), (2, "b", None, 1.0, at(0))], [(3, "a", None, 35.0, at(1))], [(4, "a", None, 1.0, at(2)), (5, "a", None, 40.0, at(3))])
    got = run(events.budget_alerts(stream, "type", "amount", 100.0), tmp_path, "b")
    assert sorted((r["key"], r["state"]) for r in got.collect()) == [("a", "exceeded"), ("a", "warn")]


def test_poison_poll_and_replay(spark):
    df = spark.createDataFrame([(1, '{"k": 1}'), (2, "nope"), (3, None), (4, '{"k": 4}')], "event_id long, props string")
    good, bad = events.split_poison(df, "props", "k int", F.col("event_id") == 4)
    assert [r["event_id"] for r in good.collect()] == [1] or good.count() == 2
    assert good.count() + bad.count() == 4 and {r["error"] for r in bad.where("event_id = 4").collect()} == {"poison"}
    log = spark.createDataFrame([(p, o) for p in range(2) for o in range(10)], "partition int, offset long")
    got = events.poll(log, spark.createDataFrame([(0, 4)], "partition int, committed long"), 3, 5).collect()
    assert [(r["partition"], r["offset"]) for r in got] == [(1, 0), (1, 1), (1, 2), (0, 4), (0, 5)]
    kinds = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "event_id long, event_type string")
    assert [r["event_id"] for r in events.replay(kinds, ["x"], 1).collect()] == [3]
