"""The data source of landed payloads, and postings from payloads whose shape drifts."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from roleflow.sources import landed as L


def put(root, source, day, name, text):
    folder = root / f"source={source}" / f"day={day}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    root = tmp_path_factory.mktemp("landed")
    for i in range(1000):
        source = ("greenhouse", "lever", "ashby", "workable")[i % 4]
        jobs = [{"id": i, "title": f"Analyst {i}", "text": f"Analyst {i}", "shortcode": f"s{i}", "jobUrl": f"u{i}"}]
        put(root, source, f"2026-01-0{1 + i % 5}", f"org{i}.json", json.dumps(jobs if source == "lever" else {"jobs": jobs}))
    put(root, "greenhouse", "2026-01-01", "cut.json", '{"jobs": [{"id": 1, "ti')
    put(root, "greenhouse", "2026-01-01", "blocked.json", '{"status": 429, "message": "slow down"}')
    put(root, "greenhouse", "2026-01-01", "moved.json", '{"positions": []}')
    put(root, "oracle_hcm", "2026-01-01", "none.json", '{"items": []}')
    put(root, "lever", "2026-01-01", "empty.json", "  ")
    put(root, "lever", "2026-01-01", "bytes.json", b"\xff\xfe\xfa")
    put(root, "lever", "2026-01-01", "zero.json", "[]")
    put(root, "rss", "2026-01-02", "feed.xml", "<rss><channel><item>")
    put(root, "rss", "2026-01-02", "good%20one.xml", "<rss><channel/></rss>")
    put(root, "page", "2026-01-02", "a.html", "<p>")
    put(root, "page", "someday", "b.html", "<p>")
    put(root, "page", "2026-01-02", "_SUCCESS", "")
    return root


def test_a_row_a_file_and_a_reason_for_what_is_broken(spark, store):
    rows = L.landed(spark, str(store)).collect()
    assert len(rows) == 1011
    reasons = {r["org"]: r["reason"] for r in rows if r["reason"]}
    assert set(reasons) == {"cut", "blocked", "moved", "none", "empty", "bytes", "feed"}
    assert reasons["blocked"] == "http_429" and reasons["moved"] == "no list at $.jobs" and reasons["empty"] == "empty" and reasons["cut"].startswith("no JSON") and reasons["feed"].startswith("no XML")
    assert reasons["bytes"].startswith("unreadable") and reasons["none"] == "no list at $.items[0].requisitionList"
    assert all((r["payload"] is None) == bool(r["reason"]) for r in rows)
    assert {r["org"]: r["day"] for r in rows if r["source"] == "page"} == {"a": dt.date(2026, 1, 2), "b": None}
    assert "good one" in {r["org"] for r in rows}
    report = {(r["source"], str(r["day"])): (r["files"], r["failed"]) for r in L.failures(L.landed(spark, str(store))).collect()}
    assert report["oracle_hcm", "2026-01-01"] == (1, 1) and report["greenhouse", "2026-01-01"] == (53, 3)


def test_filters_reach_the_listing_and_partitions_are_bounded(spark, store):
    frame = L.landed(spark, str(store), files="10")
    one = frame.where((F.col("source") == "lever") & (F.col("day") == dt.date(2026, 1, 3)))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan.replace("Filter (isnotnull", "") and one.count() == 50
    assert one.rdd.getNumPartitions() == 5
    assert frame.where(F.col("source").isin("rss", "page")).count() == 4
    reader = L.LandedReader(str(store), 1 << 30, 100)
    assert [len(p.files) for p in reader.partitions()] == [100] * 10 + [11]
    with pytest.raises(Exception, match="root"):
        spark.read.format("landed_payloads").load().collect()


def test_all_vendors_in_one_pass(spark, store):
    got = L.postings(L.landed(spark, str(store)))
    assert got.count() == 1000 and got.where("external_id is null or title is null").isEmpty()
    row = got.where("org = 'org7'").first()
    assert (row["source"], row["external_id"], row["title"]) == ("workable", "s7", "Analyst 7")


def test_a_drifting_field_costs_that_field_only(spark):
    def rows(source, payload):
        return L.postings(spark.createDataFrame([(source, "Acme", json.dumps(payload) if not isinstance(payload, str) else payload)], "source string, org string, payload string")).orderBy("title").collect()

    # A2: the location became an object, the department went, a number came for a title.
    a, b, c = rows("lever", [{"id": "a", "text": "Lead", "hostedUrl": "h", "categories": {"location": {"city": "X"}, "team": "T"}, "descriptionPlain": "Body"}, {"id": 7, "text": 12345, "categories": "none"}, {"id": "c", "text": "Ops", "categories": {"department": 5}}, {"id": "d", "name": "renamed"}, "text", None, 3])
    assert (b["title"], b["url"], b["location"], b["department"], b["description"]) == ("Lead", "h", None, "T", "Body")
    assert (a["title"], a["external_id"], a["location"]) == ("12345", "7", None) and c["department"] == "5"
    # A5: the place is a list, the name of the company is new.
    (a,) = rows("smartrecruiters", {"content": [{"id": "9", "name": "Ops", "location": ["Bonn"], "department": {"label": ""}}], "totalFound": "one"})
    assert (a["title"], a["external_id"], a["location"], a["department"]) == ("Ops", "9", None, None)
    # A11: one requisition without id, one with markup in another type's place.
    a, b = rows("oracle_hcm", {"items": [{"requisitionList": [{"Id": 1, "Title": "A", "PrimaryLocation": True, "ShortDescriptionStr": ["x"]}, {"Title": "B", "ShortDescriptionStr": "<p>Hi</p>"}]}]})
    assert (a["external_id"], a["location"], a["description"]) == ("1", "true", None) and b["description"] == "Hi" and len(b["external_id"]) == 12
    assert rows("lever", "{not json") == [] and rows("lever", "{}") == [] and rows("unknown", "[]") == [] and rows("greenhouse", '{"jobs": 5}') == []
