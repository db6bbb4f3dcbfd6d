"""Ledgers of source runs, screening lists and the rules of a review on small rows."""

import datetime as dt

from pyspark.sql import functions as F

from roleflow.operators import ledger as L
from roleflow.operators import resolve as R

ROW = "run_id string, source_key string, external_id string, seq long, outcome string, reason string"


def test_a_batch_recorded_again_changes_nothing(spark):
    one = spark.createDataFrame([("r", "s", "1", 1, "new", None), ("r", "s", "2", 2, "invalid", "junk"), ("r", "s", "2", 3, "new", None)], ROW)
    two = spark.createDataFrame([("r", "s", "2", 1, "existing", None), ("q", "s", "2", 1, "new", "x")], ROW)
    ledger = L.record(L.record(one.where("false"), one, L.OBSERVATION, "seq"), two, L.OBSERVATION, "seq")
    rows = sorted(map(tuple, ledger.collect()))
    assert rows == [("q", "s", "2", 1, "new", "x"), ("r", "s", "1", 1, "new", None), ("r", "s", "2", 1, "existing", "junk")]
    assert sorted(map(tuple, L.record(ledger, two, L.OBSERVATION, "seq").collect())) == rows
    assert sorted(map(tuple, L.record(ledger, two.drop("reason"), L.OBSERVATION, "seq").collect())) == rows


def test_accounts_tell_zero_from_failure(spark):
    seen = spark.createDataFrame([("r", "a", "1", 1, "new", None), ("r", "a", "1", 2, "existing", None), ("r", "b", "1", 1, "invalid", "junk")], ROW)
    said = spark.createDataFrame([("r", "a", 2), ("r", "zero", 0)], "run_id string, source_key string, advertised long")
    failed = spark.createDataFrame([("r", "broken", "http_503"), ("r", "b", "http_429")], "run_id string, source_key string, reason string")
    got = {r["source_key"]: (r["observed"], r["accepted"], r["rejected"], r["complete"], r["status"]) for r in L.run_accounts(seen, said, failed).collect()}
    assert got == {"a": (1, 2, 0, False, "incomplete"), "b": (1, 0, 1, False, "error: http_429"), "zero": (0, 0, 0, True, "empty"), "broken": (0, 0, 0, False, "error: http_503")}


def test_lists_share_no_row_and_artifacts_go(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "Acme"), (2, "liked", " Real  Org "), (3, "expiring", "View all\njobs"), (4, "unsure", None), (5, "skipped", "Acme"), (6, "archived", "x")], "id long, status string, org string")
    assert sorted((r["list"], r["id"]) for r in L.screen_lists(rows).collect()) == [("kept", 2), ("put aside", 5), ("to screen", 1), ("to screen", 3)]
    (tmp_path / "d.json").write_text('{\n"parsing_artifacts": ["View  all jobs ", "View all jobs"], "note": 1}')
    kept = L.without_artifacts(rows, L.artifacts(spark, str(tmp_path / "d.json")))
    assert sorted(r["id"] for r in kept.collect()) == [1, 2, 4, 5, 6]
    (tmp_path / "none.json").write_text("{}")
    assert L.without_artifacts(rows, L.artifacts(spark, str(tmp_path / "none.json"))).count() == 6


def test_requisitions_and_segments_hold_live_rows_together(spark):
    day = dt.date(2026, 3, 1)
    schema = "cluster long, id long, status string, last_seen date, urls array<string>, reqs array<string>, norm string, seg array<string>, desc string, body_len int"
    row = lambda c, i, status="unseen", urls=(), reqs=(), norm="n", seg=(), desc=None, n=0, seen=day: (c, i, status, seen, list(urls), list(reqs), norm, list(seg), desc, n)
    rows = [
        row(1, 1, urls=["u"]), row(1, 2, urls=["v", "u"]), row(1, 3, urls=["u"]),
        row(2, 1, reqs=["lever:1"]), row(2, 2, reqs=["lever:1", "lever:2"]), row(2, 3, reqs=["lever:2"]),
        row(3, 1, reqs=["lever:1"], urls=["a"]), row(3, 2, reqs=["lever:1"], urls=["b"]),
        row(4, 1, norm="x"), row(4, 2, norm="y", seg=["x"]),
        row(5, 1, norm="x", desc="p", n=900), row(5, 2, norm="y", seg=["x"], desc="q", n=1000),
        row(6, 1, norm="x"), row(6, 2, norm="y", seg=["x"]), row(6, 3, norm="z"),
        row(7, 1), row(7, 2, seen=day - dt.timedelta(days=30)), row(7, 3, "passed"),
        row(8, 1, "applied", urls=["u"]), row(8, 2, "interview", urls=["u"]),
    ]
    got = {r["cluster"]: r["disposition"] for r in R.review_disposition(spark.createDataFrame(rows, schema), F.lit(day)).collect()}
    assert got == {1: "merge", 2: "manual", 3: "merge", 4: "merge", 5: "manual", 6: "manual", 7: "merge", 8: "manual"}
