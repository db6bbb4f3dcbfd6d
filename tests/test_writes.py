"""Checked writes: faults, order, retries and what stays."""

from pyspark.sql import functions as F

from roleflow.operators import writes as O


def outcomes(frame):
    return {r["req"]: r["outcome"] for r in frame.collect()}


def test_statuses(spark):
    rows = spark.createDataFrame([(1, "unseen", 0, None), (2, "applied", 0, 5), (3, "liked", 0, None)], "id long, status string, status_at long, applied_at long")
    asked = [(1, 1, "applied", 10), (2, 1, "interview", 11), (3, 2, "declined", 12), (4, 9, "liked", 1), (5, 3, "odd", 1), (6, None, "liked", 1), (7, 3, " ", 1), (8, 1, "declined", 13)]
    after, told = O.save_statuses(rows, spark.createDataFrame(asked, "req long, id long, status string, at long"))
    assert sorted(map(tuple, after.collect())) == [(1, "declined", 13, 10), (2, "declined", 12, 5), (3, "liked", 0, None)]
    assert outcomes(told) == {1: "saved", 2: "saved", 3: "saved", 4: "not found", 5: "invalid", 6: "missing", 7: "missing", 8: "saved"}


def test_reports(spark):
    old = spark.createDataFrame([("a", "A", "grant", "x", 1, 1)], "slug string, title string, kind string, body string, created_at long, updated_at long")
    asked = [(1, "a", "A2", None, "y", 5), (2, "b", "B", "sector", "z", 6), (3, "b", "B2", "sector", "z", 7), (4, "c", "", "sector", "z", 8), (5, "d", "D", "poem", "z", 9)]
    after, told = O.save_reports(old, spark.createDataFrame(asked, "req long, slug string, title string, kind string, body string, at long"))
    assert sorted(map(tuple, after.collect())) == [("a", "A2", "other", "y", 1, 5), ("b", "B2", "sector", "z", 6, 7)]
    assert outcomes(told) == {1: "updated", 2: "created", 3: "updated", 4: "missing", 5: "invalid"}


def test_contacts(spark):
    old = spark.createDataFrame([("Ann", "", "met", "n")], "name string, group string, status string, notes string")
    asked = [(1, " Ann ", None, "replied", None), (2, "Bo", "x", None, "hi"), (3, "", "x", "met", ""), (4, "Cy", "x", "odd", "")]
    after, told = O.save_contacts(old, spark.createDataFrame(asked, "req long, name string, group string, status string, notes string"))
    assert sorted(map(tuple, after.collect())) == [("Ann", "", "replied", ""), ("Bo", "x", "planned", "hi")]
    assert outcomes(told) == {1: "saved", 2: "saved", 3: "missing", 4: "invalid"}


def test_feedback_is_only_added(spark):
    uid = lambda n: f"00000000-0000-0000-0000-{n:012d}"
    schema = "id string, rows array<string>, decision string, reason string, label string"
    old = spark.createDataFrame([(uid(1), [uid(50)], "liked", "r", "")], schema)
    known = spark.createDataFrame([(uid(51),), (uid(52).upper(),)], "id string")
    asked = [
        (1, uid(1), [uid(50)], "liked", "r", ""), (2, uid(1), [uid(51)], "liked", "r", ""), (3, uid(2), [uid(51), uid(52)], "passed", "why", "g"), (4, uid(2), [uid(51), uid(52)], "passed", "why", "g"), (5, uid(2), [uid(51)], "passed", "why", "g"),
        (6, uid(3), [uid(60)], "passed", "why", "g"), (7, "x", [uid(51)], "passed", "why", "g"), (8, uid(4), [], "passed", "why", "g"), (9, uid(4), [uid(51), uid(51)], "passed", "why", "g"), (10, uid(4), [uid(51)], "unsure", "why", "g"),
        (11, uid(4), [uid(51)], "passed", " ", "g"), (12, uid(4), [uid(51)], "passed", "x" * 4001, "g"), (13, uid(4), [uid(51)], "passed", "x", None), (14, uid(4), None, "passed", "x", ""), (15, uid(4), [uid(51)] + [uid(i) for i in range(100, 200)], "passed", "x", ""),
    ]
    after, told = O.add_feedback(old, spark.createDataFrame(asked, f"req long, {schema}"), known)
    assert outcomes(told) == {1: "saved", 2: "conflict", 3: "saved", 4: "saved", 5: "conflict", 6: "not found", 7: "invalid", 8: "invalid", 9: "repeated rows", **{i: "invalid" for i in range(10, 16)}}
    assert sorted(r["id"] for r in after.collect()) == [uid(1), uid(2)]
    again, told = O.add_feedback(after, spark.createDataFrame(asked, f"req long, {schema}"), known)
    assert sorted(map(str, again.collect())) == sorted(map(str, after.collect())) and again.where(F.col("reason") == "why").count() == 1
