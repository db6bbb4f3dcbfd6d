"""Keyed state of streams: each micro-batch gives what one batch over all events so far gives, restarts included."""

import datetime as dt
import os
import random
import subprocess
import sys

import pandas as pd
import pytest
from pyspark.sql import functions as F

from roleflow.operators import rollups as G
from roleflow.plans import streams
from roleflow.streaming import events as E
from roleflow.streaming import processors as P

T0 = 1_760_000_000_000
EVENT = "key long, ms long, id long, status string, reason string"


@pytest.fixture(autouse=True, scope="module")
def one_partition(spark):
    """Small rows: a state store or a task each for every partition would be most of the time."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


class Stream:
    """Files that land one by one, and a query that stops after each and starts again from its checkpoint."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0
        (folder / "in").mkdir()

    def land(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(str(self.folder / "in" / f"f{self.n:03d}"))

    def run(self, make, mode="append", name="out"):
        source = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.folder / "in" / "*"))
        out = []
        query = make(source).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).outputMode(mode).option("checkpointLocation", str(self.folder / name)).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return out


def changes(rows, before=None):
    out, last, since, times = [], dict(before or {}), {}, {}
    for k, s in last.items():
        times[k, s] = 1
    for key, ms, id_, status, _ in sorted(rows, key=lambda r: r[1:3]):
        if key in last and last[key] == status:
            continue
        times[key, status] = times.get((key, status), 0) + 1
        out.append((key, id_, ms, last.get(key), status, since.get(key), times[key, status]))
        last[key], since[key] = status, ms
    return sorted(out, key=str)


def events(n, seed):
    rng = random.Random(seed)
    return [(rng.randint(1, 6), T0 + 1000 * i, i, rng.choice(["unseen", "liked", "passed", None]), "why") for i in range(n)]


def test_status_log_restarts_from_its_checkpoint(spark, tmp_path):
    stream, rows, got = Stream(spark, tmp_path, EVENT), events(300, 1), []
    for a, b in ((0, 90), (90, 91), (91, 300)):
        part = rows[a:b]
        random.Random(a).shuffle(part)
        stream.land(part)
        got += stream.run(lambda s: P.status_log(s))
    assert sorted(map(tuple, got), key=str) == changes(rows)
    batch = P.status_log(spark.createDataFrame(rows, EVENT))
    assert sorted(map(tuple, batch.collect()), key=str) == changes(rows)


def test_status_log_starts_from_the_stored_table(spark, tmp_path):
    rows = events(120, 2)
    stored = {1: "liked", 2: rows[0][3], 99: "passed"}
    initial = spark.createDataFrame([(k, s, None) for k, s in stored.items()], "key long, status string, ms long")
    stream = Stream(spark, tmp_path, EVENT)
    stream.land(rows[:50])
    got = stream.run(lambda s: P.status_log(s, initial))
    stream.land(rows[50:])
    got += stream.run(lambda s: P.status_log(s, initial))
    assert sorted(map(tuple, got), key=str) == changes(rows, stored)


def test_status_log_grows_a_column(spark, tmp_path):
    rows = events(80, 3)
    stream = Stream(spark, tmp_path, EVENT)
    stream.land(rows[:40])
    got = stream.run(lambda s: P.status_log(s))
    stream.land(rows[40:])
    got += stream.run(lambda s: P.status_log(s, extra=("reason",)))
    assert sorted(map(tuple, got), key=str) == changes(rows)


def test_failure_streaks(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randint(1, 4), T0 + i, i, rng.random() < 0.3) for i in range(200)]
    stream = Stream(spark, tmp_path, "key long, ms long, id long, ok boolean")
    done = []
    for a in range(0, 200, 100):
        stream.land(rows[a : a + 100])
        got = {r["key"]: (r["failures"], r["longest"]) for r in stream.run(lambda s: P.failure_streaks(s), "update")}
        done += rows[a : a + 100]
        for key, (n, longest) in got.items():
            run = best = 0
            for k, _, _, ok in done:
                if k == key:
                    run = 0 if ok else run + 1
                    best = max(best, run)
            assert (n, longest) == (run, best)


def test_a_silent_source_is_told_once_without_an_event_of_its_own(spark, tmp_path):
    day = lambda d: dt.datetime(2026, 1, 1) + dt.timedelta(days=d)
    stream = Stream(spark, tmp_path, "source long, ts timestamp")
    told = []
    for rows in ([(1, day(0)), (2, day(0)), (1, day(0.5))], [(2, day(10)), (2, day(15.2))], [(1, day(17)), (2, day(18))], [(2, day(33)), (2, day(50))], [(2, day(51))]):
        stream.land(rows)
        told += stream.run(lambda s: P.silent_sources(s, 14, "1 hour"))
    ms = lambda d: int(day(d).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    got = sorted((r["source"], r["last_ms"], r["stale_ms"]) for r in told)
    assert got == [(1, ms(0.5), ms(14.5)), (1, ms(17), ms(31)), (2, ms(18), ms(32)), (2, ms(33), ms(47))]


def test_review_cursor_equals_the_batch_after_every_micro_batch(spark, tmp_path):
    schema = "key long, ms long, id long, kind string"
    rng = random.Random(5)
    rows = [(1, T0 + i, i, rng.choice(["decided"] * 6 + ["reviewed", "skipped"])) for i in range(160)]
    rows[70] = (1, T0 + 20, 70, "reviewed")  # arrives late
    stream, done = Stream(spark, tmp_path, schema), []
    for a in range(0, 160, 40):
        stream.land(rows[a : a + 40])
        done += rows[a : a + 40]
        (got,) = stream.run(lambda s: P.review_cursor(s), "update")
        frame = spark.createDataFrame([(r[1], r[2], r[3]) for r in done], "ts long, id long, kind string")
        want = G.since_cursor(frame, F.col("kind") == "reviewed", F.col("kind") == "decided").first()["counted"]
        cursor = max((r[1] for r in done if r[3] == "reviewed"), default=None)
        first = min(((r[1], r[2]) for r in done if r[3] == "decided" and (cursor is None or r[1] > cursor)), default=(None, None))[1]
        assert (got["open"], got["cursor_ms"], got["first_id"]) == (want, cursor, first)


RUN = "source long, ms long, id long, n long, enabled boolean, errored long, live long"


def test_expected_range_equals_the_batch_run_by_run(spark, tmp_path):
    rng = random.Random(6)
    rows = [(s, T0 + i, i * 10 + s, rng.randint(1, 40), True, 0, 3) for i in range(40) for s in (1, 2)]
    stream, got = Stream(spark, tmp_path, RUN), []
    for a in range(0, 80, 32):
        stream.land(rows[a : a + 32])
        got += stream.run(lambda s: P.run_verdicts(s))
    batch = G.expected_range(spark.createDataFrame(rows, RUN), "n", "ms")
    want = {r["id"]: (r["low"], r["high"], r["in_range"]) for r in batch.collect()}
    assert {r["run"]: (r["low"], r["high"], r["verdict"] in P.CALM) for r in got} == want
    assert {r["verdict"] for r in got} == {"no baseline", "in range", "out of range"}


def test_hard_rules_and_the_alarm(spark, tmp_path):
    rows = [(1, T0, 1, 0, True, 0, 3), (1, T0 + 1, 2, 0, False, 0, 0), (1, T0 + 2, 3, 5, True, 4, 0), (2, T0, 4, 0, True, 2, 0), (3, T0, 5, 9, True, 1, 1)]
    stream = Stream(spark, tmp_path, RUN)
    stream.land(rows)
    stream.land([(3, T0 + 5, 6, 9, True, 0, 1)])
    alarms = []
    listener = P.Alarm("health", lambda batch, n: alarms.append((batch, n)))
    spark.streams.addListener(listener)
    try:
        got = stream.run(lambda s: P.watched(P.run_verdicts(s), "health"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    assert {r["run"]: r["verdict"] for r in got} == {1: "nothing new", 2: "in range", 3: "all failed", 4: "nothing new", 5: "no baseline", 6: "in range"}
    assert alarms == [(0, 3)]


@pytest.mark.parametrize("rows", [[], [(7, T0, 1, None, None)]])
def test_batches_of_little(spark, rows):
    out = P.status_log(spark.createDataFrame(rows, EVENT)).collect()
    assert [(r["key"], r["status"], r["times"]) for r in out] == [(k, None, 1) for k, *_ in rows]


def test_keyed_state_over_a_batch_in_a_session_without_streams(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
from roleflow.streaming import processors as P
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").config("spark.local.dir", "{tmp_path}").getOrCreate()
runs = spark.createDataFrame([(1, 5, 5, 3, True, 0, 1), (1, 6, 6, 9, True, 0, 1)], "source long, ms long, id long, n long, enabled boolean, errored long, live long")
print("got", [r["verdict"] for r in P.run_verdicts(runs).orderBy("ms").collect()])
seen = spark.createDataFrame([(1, 5, 5, "reviewed"), (1, 6, 6, "decided")], "key long, ms long, id long, kind string")
print("got", [tuple(r) for r in P.review_cursor(seen).collect()])
"""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=tmp_path, env={**os.environ, "PYTHONPATH": repo})
    assert [line for line in done.stdout.splitlines() if line.startswith("got")] == ["got ['no baseline', 'out of range']", "got [(1, 5, 1, 6)]"], done.stderr[-2000:]


def test_keyed_state_leaves_other_streams_startable(spark, tmp_path):
    (tmp_path / "in").mkdir()
    P.keyed_state(spark)
    spark.createDataFrame([(1, dt.datetime(2026, 1, 1), "a")], "key long, ts timestamp, status string").write.parquet(str(tmp_path / "in" / "f"))
    source = spark.readStream.schema("key long, ts timestamp, status string").parquet(str(tmp_path / "in" / "*"))
    for name, frame in (("changed", E.changes(source)), ("once", E.once(source, ("key",)))):
        out = []
        query = frame.writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert query.awaitTermination(60) and len(out) == 1


def test_a_streamed_table_may_be_a_folder_of_files(spark, tmp_path):
    """The stream found none of them before, and the result was empty."""
    rows = [(i, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i), i % 2, "ab"[i // 6 % 2], 1.0) for i in range(24)]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    frame.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got = streams.status_stream(spark, str(tmp_path)).collect()
    assert sorted((r["key"], r["id"], r["status"], r["times"]) for r in got) == [(k, i + k, "ab"[i // 6 % 2], i // 12 + 1) for k in (0, 1) for i in range(0, 24, 6)]


def test_the_status_log_asks_the_state_once_a_status():
    """A key of many events made three calls to the state for each change before."""

    class Kept:
        def __init__(self):
            self.values, self.calls = {}, 0

        def call(self):
            self.calls += 1
            return self.values

        exists = lambda self: None in self.call()
        get = lambda self: self.call()[None]
        update = lambda self, v: self.call().update({None: v})
        containsKey = lambda self, k: k in self.call()
        getValue = lambda self, k: self.call()[k]
        updateValue = lambda self, k, v: self.call().update({k: v})

    log = P.StatusLog()
    log.last, log.times = Kept(), Kept()
    for start in (0, 200):
        frame = pd.DataFrame({"ms": range(start, start + 200), "id": range(start, start + 200), "status": ["a", None] * 100})
        (got,) = log.handleInputRows((1,), iter([frame]), None)
        assert got["times"].tolist() == [start // 2 + i // 2 + 1 for i in range(200)]
    assert log.times.calls <= 12
