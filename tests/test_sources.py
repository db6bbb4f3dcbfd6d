"""Connectors and streams over small landed files."""

import datetime as dt
import json

from pyspark.sql import functions as F

from roleflow.sources import connectors as C
from roleflow.streaming import events as E


def rows(frame):
    return [r.asDict() for r in frame.orderBy("external_id").collect()]


def test_json_connectors(spark, tmp_path):
    def land(name, data):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(data))
        return C.REGISTRY[name](spark, str(path), "Acme")

    got = rows(land("greenhouse", {"jobs": [{"id": 5, "title": "Analyst", "absolute_url": "u", "location": {"name": "Oslo"}, "departments": [{"name": "Data"}], "content": "&lt;p&gt;Salary: $60,000&lt;/p&gt;Apply by 3 March 2026"}, {"id": 6, "title": " "}]}))
    assert len(got) == 1 and got[0]["department"] == "Data" and got[0]["deadline"] == dt.date(2026, 3, 3) and got[0]["compensation"] == "5,000" and "<" not in got[0]["description"]
    got = rows(land("lever", [{"id": "a", "text": "Lead", "hostedUrl": "h", "categories": {"location": "X", "team": "T"}, "descriptionPlain": "Body", "lists": [{"text": "You", "content": "<li>one</li>"}], "additionalPlain": "End"}]))
    assert got[0]["description"] == "Body\n\nYou\n- one\n\nEnd" and got[0]["department"] == "T"
    got = rows(land("ashby", {"jobs": [{"title": "Eng", "jobUrl": "u1", "descriptionPlain": "", "descriptionHtml": "<b>Hi</b>", "team": "Core"}]}))
    assert got[0]["description"] == "Hi" and len(got[0]["external_id"]) == 12 and got[0]["department"] == "Core"
    got = rows(land("smartrecruiters", {"offset": 0, "totalFound": 1, "content": [{"id": "9", "name": "Ops", "company": {"identifier": "acme"}, "location": {"city": "Bonn", "country": "de", "remote": True}}]}))
    assert got[0]["location"] == "Bonn, DE, remote" and got[0]["url"].endswith("/acme/9")
    got = rows(land("oracle_hcm", {"items": [{"TotalJobsCount": 2, "requisitionList": [{"Id": "1", "Title": "A", "PrimaryLocation": "P"}, {"Id": "1", "Title": "A", "PrimaryLocation": "P"}]}]}))
    assert len(got) == 1
    got = rows(land("adp", {"jobRequisitions": [{"itemID": "i", "requisitionTitle": "T", "payGradeRange": {"minimumRate": {"amountValue": 10, "currencyCode": "USD"}, "maximumRate": {"amountValue": 20}}}]}))
    assert got[0]["compensation"] == "10–20 USD"
    land("search_index", {"nbHits": 3, "hits": [{"objectID": "1", "title": "T", "company_name": "Org", "tags_city": [], "tags_country": ["NO"], "closes_at": 1767225600}]})
    got = rows(C.REGISTRY["search_index"](spark, str(tmp_path / "search_index.json"), "Board"))
    assert got[0]["org"] == "Org" and got[0]["location"] == "NO" and got[0]["deadline"] == dt.date(2026, 1, 1)
    run = C.incomplete_runs(spark, str(tmp_path / "search_index.json")).first()
    assert (run["advertised"], run["observed"], run["complete"]) == (3, 1, False)


def test_thread_and_markup(spark, tmp_path):
    thread = [{"story": 2, "story_created": 9, "id": 1, "parent": 2, "text": "Acme | Data Engineer | Remote (EU)<p>Body"}, {"story": 2, "story_created": 9, "id": 3, "parent": 1, "text": "Reply | x yz | a"}, {"story": 1, "story_created": 1, "id": 4, "parent": 1, "text": "Old | Title here | Remote"}, {"story": 2, "story_created": 9, "id": 5, "parent": 2, "text": "SEEKING WORK | Me here | Remote"}]
    (tmp_path / "t.json").write_text(json.dumps(thread))
    got = rows(C.REGISTRY["hiring_thread"](spark, str(tmp_path / "t.json"), "board"))
    assert [(r["org"], r["title"], r["location"]) for r in got] == [("Acme", "Data Engineer", "Remote (EU)")]
    (tmp_path / "p.html").write_text('<a href="/jobs/1">First <b>role</b></a><a href="/jobs/1">again</a><a href="/about">x</a>')
    assert [r["title"] for r in rows(C.REGISTRY["html_cards"](spark, str(tmp_path / "p.html"), "o"))] in (["First role"], ["again"])
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>T</title><link>l</link><description>&lt;p&gt;Hello&lt;/p&gt;</description></item></channel></rss>")
    assert rows(C.REGISTRY["rss"](spark, str(tmp_path / "f.xml"), "o"))[0]["description"] == "Hello"


def test_pages_and_vendors(spark):
    page = spark.createDataFrame([(1, "u", '<script type="application/ld+json">{"description": "<p>Real</p>"}</script><a href="https://r.org/?url=https%3A%2F%2Fjobs.lever.co%2Facme%2F1">x</a>')], "page_id long, url string, html string")
    assert C.posting_pages(page).first()["description"] == "Real"
    assert [tuple(r) for r in C.vendors_of(C.links_of(page)).collect()] == [("lever", "acme")]


def test_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("name,status\nAnn,met\n,met\nBo,odd\n")
    assert sorted((r["name"], r["status"]) for r in C.contacts_csv(spark, str(tmp_path / "c.csv")).collect()) == [("Ann", "met"), ("Bo", "planned")]
    (tmp_path / "r" / "research").mkdir(parents=True)
    (tmp_path / "r" / "research" / "one.md").write_text("intro\n# Title here\nbody")
    got = C.markdown_reports(spark, str(tmp_path / "r")).first()
    assert (got["slug"], got["title"], got["kind"]) == ("one", "Title here", "research")
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.txt").write_text('Sure:\n```json\n{"score": 7}\n```')
    assert C.model_results(spark, str(tmp_path / "m"), "score int").first()["result"]["score"] == 7


def test_streams_agree_with_batches(spark, tmp_path):
    data = [(1, 1, dt.datetime(2026, 1, 1, 0, i), s, 1.0) for i, s in enumerate("aabbca")] + [(2, 2, dt.datetime(2026, 1, 1, 1, 0), "z", 1.0)]
    frame = spark.createDataFrame(data, "key long, id long, ts timestamp, status string, value double")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = E.observed(spark, str(tmp_path / "in"), "key long, id long, ts timestamp, status string, value double")
    query = E.once(stream, ("key", "status")).writeStream.format("memory").queryName("first_only").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("first_only").count() == 4 == E.once(frame, ("key", "status")).count()
    E.write_once(frame, 0, str(tmp_path / "out"))
    E.write_once(frame, 0, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7
