"""The intake of a batch as one job, its replay, and runs that were killed between stages."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from roleflow.functions import keys as K
from roleflow.operators.intake import last_places
from roleflow.operators import intake as I
from roleflow.operators.stages import Run

STORE = "id long, org string, company_id long, hash string, title string, description string, snippet string, department string, deadline date, status string, status_reason string, score int, first_seen date, last_seen date, places array<struct<url:string,city:string,country:string>>"
BATCH = "pos long, source string, external_id string, org string, company_id long, title string, description string, snippet string, department string, deadline date, url string, city string, country string"
DAY, OLD = dt.date(2026, 3, 1), dt.date(2026, 1, 5)


@pytest.fixture(autouse=True, scope="module")
def one_partition(spark):
    """Small rows: a state store or a task each for every partition would be most of the time."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def body(word, n=60):
    return " ".join(f"{word}{i}" for i in range(n))


def stored(spark, *rows):
    made = [(i, "Acme", 1, None, title, text, None, None, None, status, "board_stale" if status == "archived" else None, score, OLD, OLD, [(url, city, None)]) for i, title, text, status, score, url, city in rows]
    return spark.createDataFrame(made, STORE).withColumn("hash", K.exact_key(F.col("org"), F.col("title"))).cache()


def posted(spark, *rows):
    return spark.createDataFrame([(p, "feed", f"x{p}", "Acme", 1, title, text, None, "Team", None, url, city, country) for p, title, text, url, city, country in rows], BATCH).cache()


@pytest.fixture(scope="module")
def given(spark):
    store = stored(
        spark,
        (1, "Data Analyst", body("a"), "unseen", None, "https://acme.org/1", "Oslo"),
        (2, "Policy Officer", body("b"), "archived", None, "https://acme.org/2", "Rome"),
        (3, "Head of Water (m/f/d)", body("c"), "liked", 80, "https://acme.org/3", None),
        (4, "Junk Manager", body("d"), "unseen", None, "https://acme.org/4", None),
        (5, "Untouched Role", body("e"), "unseen", None, "https://acme.org/5", "Bonn"),
    )
    batch = posted(
        spark,
        (0, "Data Analyst", body("a"), "https://acme.org/1?utm_source=z", "Oslo", "Norway"),
        (1, "Data Analyst", body("a"), "https://acme.org/1b", "Bergen", "Norway"),
        (2, "Policy Officer", body("b", 90), "https://acme.org/2", "Rome", None),
        (3, "Junk Manager", body("d"), "https://acme.org/4", None, None),
        (4, None, body("x"), "https://acme.org/x", None, None),
        (5, "New Engineer", body("f"), "https://acme.org/6", "Kyiv", None),
        (6, "New Engineer", body("f"), "https://acme.org/7", "Lviv", None),
        (7, "Buried Role", body("g"), "https://acme.org/8", None, None),
        (8, "Gone Role", body("h"), "https://acme.org/9", None, None),
        (9, "Long Buried Role", body("i"), "https://acme.org/10", None, None),
    )
    keys = spark.createDataFrame([("Buried Role", "score", dt.date(2026, 2, 1)), ("Gone Role", "gone_from_source", dt.date(2026, 2, 1)), ("Long Buried Role", "score", dt.date(2025, 1, 1))], "t string, reason string, archived_at date")
    return store, batch, keys.select(K.exact_key(F.lit("Acme"), F.col("t")).alias("key"), "reason", "archived_at")


def as_rows(frame):
    return sorted((r.asDict(recursive=True) for r in frame.collect()), key=lambda r: r["id"])


@pytest.mark.parametrize("board", [False, True])
def test_a_batch_and_its_replay(spark, given, board):
    store, batch, stones = given
    out = I.take_in(store, batch, stones, F.lit(DAY), board=board, words=("junk",))
    outcomes = {r["pos"]: (r["outcome"], r["reason"]) for r in out.outcomes.collect()}
    gone = ("archived", None) if board else ("new", None)
    assert outcomes == {0: ("existing", None), 1: ("existing", None), 2: ("existing", None), 3: ("invalid", "blacklist"), 4: ("invalid", "empty_title"), 5: ("new", None), 6: ("new", None), 7: ("archived", None), 8: gone, 9: ("new", None)}
    rows = as_rows(out.rows)
    by = {r["title"]: r for r in rows}
    assert len(rows) == 5 + (2 if board else 3) and len({r["id"] for r in rows}) == len(rows)
    assert {(p["url"], p["city"]) for p in by["Data Analyst"]["places"]} == {("https://acme.org/1", "Oslo"), ("https://acme.org/1b", "Bergen")}
    assert (by["Policy Officer"]["status"], by["Policy Officer"]["status_reason"], by["Policy Officer"]["last_seen"]) == ("unseen", None, DAY)
    assert (len(by["Policy Officer"]["description"]) > len(body("b"))) == (not board)
    assert (by["Junk Manager"]["last_seen"], by["Untouched Role"]["last_seen"]) == (DAY, OLD)
    assert {p["city"] for p in by["New Engineer"]["places"]} == {"Kyiv", "Lviv"} and by["New Engineer"]["first_seen"] == DAY
    ids = {r["pos"]: r["id"] for r in out.outcomes.collect()}
    assert ids[0] == 1 and ids[5] == ids[6] == by["New Engineer"]["id"] and ids[3] is None
    again = I.take_in(spark.createDataFrame(out.rows.collect(), STORE), batch, stones, F.lit(DAY), board=board, words=("junk",))
    assert as_rows(again.rows) == rows
    assert {r["outcome"] for r in again.outcomes.where("pos in (5, 6, 9)").collect()} == {"existing"}


def test_empty_sides(spark, given):
    store, batch, stones = given
    none = I.take_in(store.where("false"), batch, stones.where("false"), F.lit(DAY), board=False)
    assert none.rows.count() == 7 and none.outcomes.count() == 10
    quiet = I.take_in(store, batch.where("false"), stones, F.lit(DAY), board=False)
    assert as_rows(quiet.rows) == as_rows(store) and quiet.outcomes.count() == 0


class Killed(Exception):
    pass


def job(spark, folder, kill_after=None, version="1"):
    run, made = Run(spark, folder, "2026-03-01"), []

    def make(name, frame):
        def build():
            made.append(name)
            return frame()

        return build

    def dies(name):
        if kill_after == name:
            raise Killed

    a = run.stage("fetch", make("fetch", lambda: spark.range(10).withColumn("x", F.col("id") % 3)))
    dies("fetch")
    b = run.stage("filter", make("filter", lambda: a.where("x > 0")), version)
    dies("filter")
    c = run.stage("count", make("count", lambda: b.groupBy("x").count()))
    dies("count")
    return run, made, c


def test_a_killed_run_goes_on_where_it_was(spark, tmp_path):
    _, _, rows = job(spark, str(tmp_path / "whole"))
    want = sorted(map(tuple, rows.collect()))
    folder, ran = str(tmp_path / "killed"), []
    for name in ("fetch", "filter", "count"):
        with pytest.raises(Killed):
            job(spark, folder, name)
    run, made, rows = job(spark, folder)
    assert made == [] and sorted(map(tuple, rows.collect())) == want
    assert [r["stage"] for r in run.ledger().orderBy("began").collect()] == ["fetch", "filter", "count"] and not ran
    # A stage that dies while it writes has no entry; its rows are never read.
    broken = Run(spark, str(tmp_path / "broken"), "r")
    with pytest.raises(Exception, match="boom"):
        broken.stage("one", lambda: spark.range(5).select(F.raise_error(F.lit("boom"))))
    assert broken.stage("one", lambda: spark.range(5)).count() == 5 and broken.done == ["one"]


def test_a_new_version_does_what_follows_anew(spark, tmp_path):
    folder = str(tmp_path)
    assert job(spark, folder)[1] == ["fetch", "filter", "count"]
    run, made, _ = job(spark, folder, version="2")
    assert made == ["filter", "count"] and run.ledger().count() == 3
    assert job(spark, folder, version="2")[1] == []


def test_of_two_attempts_one_counts(spark, tmp_path):
    one, two = Run(spark, str(tmp_path), "r"), Run(spark, str(tmp_path), "r")
    first = two.stage("s", lambda: one.stage("s", lambda: spark.range(3)).limit(0))
    assert first.count() == 3 and one.done == ["s"] and two.done == []
    one.clear()
    assert Run(spark, str(tmp_path), "r").stage("s", lambda: spark.range(4)).count() == 4


def test_sightings_of_a_place_are_one_before_they_meet_the_stored_ones(spark):
    """A role that a batch brings many times hands on each place once, with its last link, in the order of those."""
    seen = spark.range(600).selectExpr("7L AS id", "id AS pos", "concat('https://e.org/', id) AS url", "CASE WHEN id % 3 > 0 THEN concat('C', id % 3) END AS city", "CASE WHEN id % 2 = 0 THEN 'X' END AS country")
    got = last_places(seen, "id").collect()
    assert [(r["id"], [p["url"] for p in r["_seen"]]) for r in got] == [(7, [f"https://e.org/{i}" for i in (594, 597, 598, 599)])]
