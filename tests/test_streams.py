"""Streams over landed files: keyed state, tombstones, resurrection, delivery and the ledger."""

import datetime as dt

from pyspark.sql import functions as F

from roleflow.streaming import events as E


def run(spark, frame, name, folder, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder / name)).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    return spark.table(name)


def land(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def at(minute):
    return dt.datetime(2026, 1, 1, 0, minute)


def test_keyed_state(spark, tmp_path):
    schema = "key long, ts timestamp, status string"
    rows = [(1, at(i), s) for i, s in enumerate("aabbca")] + [(2, at(1), "z"), (3, at(0), "x"), (3, at(1), "archived"), (3, at(2), "x"), (4, at(0), None), (4, at(1), None)]
    land(spark, tmp_path / "in", rows, schema)
    stream = E.observed(spark, str(tmp_path / "in"), schema)
    changed = run(spark, E.changes(stream), "changed", tmp_path)
    assert [(r["previous"], r["status"]) for r in changed.where("key = 1").orderBy("ts").collect()] == [(None, "a"), ("a", "b"), ("b", "c"), ("c", "a")]
    failed = run(spark, E.failure_counts(stream.select("key", "ts", (F.col("status") == "z").alias("ok"))), "failed", tmp_path, "update")
    assert {r["key"]: r["failures"] for r in failed.collect()} == {1: 6, 2: 0, 3: 3, 4: 2}
    kept = run(spark, E.without_recent_tombstones(stream), "kept", tmp_path)
    assert [r["ts"].minute for r in kept.where("key = 3").collect()] == [0] and kept.where("key = 1").count() == 6


def test_resurrection_and_delivery(spark, tmp_path):
    folder = str(tmp_path / "state")
    spark.createDataFrame([(1, "archived", dt.date(2026, 1, 1)), (2, "liked", dt.date(2026, 1, 1)), (3, "archived", dt.date(2026, 1, 1))], "id long, status string, last_seen date").write.parquet(f"{folder}/version=0")
    batch = spark.createDataFrame([(1, dt.datetime(2026, 1, 5)), (2, dt.datetime(2026, 1, 5)), (9, dt.datetime(2026, 1, 5))], "id long, ts timestamp")
    put = E.resurrect_into(folder)
    for _ in range(2):  # a replay gives the same version
        put(batch, 0)
        got = {r["id"]: (r["status"], r["last_seen"].day) for r in spark.read.parquet(f"{folder}/version=1").collect()}
        assert got == {1: ("unseen", 5), 2: ("liked", 5), 3: ("archived", 1), 9: ("unseen", 5)}
    sent = []
    give = E.deliver(str(tmp_path / "out"), lambda frame: sent.append(sorted(r["id"] for r in frame.collect())))
    give(batch.select("id"), 0)
    give(batch.select("id"), 0)
    give(batch.select("id").union(spark.createDataFrame([(11,)], "id long")), 1)
    assert sent == [[1, 2, 9], [1, 2, 9], [11]]


def test_ledger_takes_an_event_once(spark, tmp_path):
    rows = spark.createDataFrame([("review", "7", "x", at(1)), ("review", "7", "x", at(1)), ("review", "8", "y", at(2))], "kind string, ref string, detail string, ts timestamp")
    assert E.log_events(spark, str(tmp_path / "l"), rows).count() == 2
    assert E.log_events(spark, str(tmp_path / "l"), rows).count() == 0
    assert spark.read.parquet(str(tmp_path / "l")).count() == 2
