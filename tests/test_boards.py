"""Every connector against a small invented payload, and the rules for scraped listings."""

import json

import pytest
from pyspark.sql import functions as F

from roleflow.operators import filters
from roleflow.sources import boards, connectors, listings  # noqa: F401

TAGS = [{"name": "Data"}]
CASES = {
    "workday": ({"jobPostings": [{"title": "Analyst", "externalPath": "/job/Paris/Analyst_JR1", "locationsText": "Paris"}]}, ("Analyst_JR1", "Acme", "Analyst", "Paris")),
    "bamboohr": ({"result": [{"id": "7", "jobOpeningName": "Lead", "location": {"city": "Oslo", "state": "NO"}, "isRemote": True, "departmentLabel": "Ops"}]}, ("7", "Acme", "Lead", "Remote, Oslo, NO")),
    "amazon": ({"jobs": [{"title": "SDE", "id_icims": "5", "job_path": "/en/jobs/5", "location": "US"}, {"title": "SDE", "id_icims": "5", "location": "US"}]}, ("5", "Acme", "SDE", "US")),
    "apple": ({"searchResults": [{"postingTitle": "Designer", "positionId": "9", "locations": [{"name": "Cork"}, {"city": "Rome"}], "team": {"teamName": "Art"}}]}, ("9", "Acme", "Designer", "Cork, Rome")),
    "arbeitnow": ({"data": [{"slug": "s1", "company_name": "Beta", "title": "Dev", "remote": True, "location": "Berlin", "description": "<p>Hi</p>", "tags": ["a", "b"], "visa_sponsorship": True}, {"slug": "s2", "title": "No employer"}]}, ("s1", "Beta", "Dev", "Remote, Berlin")),
    "remotive": ({"jobs": [{"id": 3, "company_name": "Beta", "title": "Dev", "candidate_required_location": "Europe", "salary": "10k"}]}, ("3", "Beta", "Dev", "Remote, Europe")),
    "idealist": ({"hits": [{"objectID": "i1", "name": "Officer", "orgName": "Fund", "url": {"en": "/job/1"}, "locationType": "REMOTE", "remoteZone": "WORLD", "country": "FR", "salaryMinimum": 50000, "salaryPeriod": "YEAR"}]}, ("i1", "Fund", "Officer", "Remote, worldwide, FR")),
    "tagged_index": ({"hits": [{"objectID": "t1", "title": "Head", "org": {"name": "Fund"}, "slug": "x", "locations": TAGS, "tags_area": TAGS, "has_salary": False, "salary_text": "100", "closes_at": "2026-05-01T00:00"}]}, ("t1", "Fund", "Head", "Data")),
    "fastforward": ({"results": {"count": 1, "jobs": [{"id": 4, "title": "VP  Featured", "organization": {"name": "NGO"}, "locations": [{"name": "NY"}], "work_mode": "remote", "compensation_amount_min_cents": 5000000, "compensation_amount_max_cents": 7000000, "compensation_public": True}]}}, ("4", "NGO", "VP", "Remote, NY")),
    "wordpress_jobs": ({"id": 8, "link": "https://x.org/8", "title": {"rendered": "Data &amp; AI"}, "detail": {"employer": "NGO", "location": "Goa", "expired": False}}, ("8", "NGO", "Data & AI", "Goa")),
    "curated_list": ({"jobs": [{"title": "Chief", "org": "Fund", "url": "https://f.org/1", "location": "Any", "part_time": True}, {"title": "Old", "org": "Fund", "url": "u", "expired": True}]}, (None, "Fund", "Chief", "Any")),
    "opportunity_rows": ({"id": "r1", "title": "Fellow", "applicationLink": "https://a.org", "opportunityTypes": ["Full-time Job"], "organizations": [{"name": " "}, {"name": "Lab"}], "locationFilter": ["Remote ", "UK"]}, ("r1", "Lab", "Fellow", "Remote, UK")),
}


@pytest.mark.parametrize("name", CASES)
def test_payload(spark, tmp_path, name):
    payload, want = CASES[name]
    (tmp_path / "p.json").write_text(json.dumps(payload))
    rows = connectors.REGISTRY[name](spark, str(tmp_path / "p.json"), "Acme").collect()
    assert len(rows) == 1
    got = rows[0]
    assert (got["external_id"] if want[0] else None, got["org"], got["title"], got["location"]) == want
    if name == "fastforward":
        assert got["compensation"] == "USD 50,000–70,000"
    if name == "arbeitnow":
        assert got["description"] == "Hi\n\nVisa sponsorship: yes | Tags: a, b"


def test_feed_and_table(spark, tmp_path):
    item = "<item><title>Officer</title><link>https://r.org/1</link><guid>g1</guid><description>&lt;p&gt;Organization: Relief&lt;/p&gt;&lt;p&gt;City: Goma&lt;/p&gt;&lt;p&gt;Country: DRC&lt;/p&gt;&lt;p&gt;Closing date: 5 Mar 2026&lt;/p&gt;Body</description></item>"
    (tmp_path / "f.xml").write_text(f"<rss><channel>{item}</channel></rss>")
    got = connectors.REGISTRY["reliefweb"](spark, str(tmp_path / "f.xml"), "x").first()
    assert (got["org"], got["location"], str(got["deadline"])) == ("Relief", "Goma, DRC", "2026-03-05")
    (tmp_path / "t.html").write_text('<table><tr class="data-row"><td><a class="jobTitle-link" href="/job/Nurse/123/">Nurse &amp; aide</a></td><td><span class="jobLocation">Bern</span></td></tr></table>')
    got = connectors.REGISTRY["successfactors"](spark, str(tmp_path / "t.html"), "Acme").first()
    assert (got["external_id"], got["title"], got["location"]) == ("123", "Nurse & aide", "Bern")


def test_extraction_results(spark):
    data = {
        "jobs": [
            {"title": "Programme Officer", "url": "jobs/1", "snippet": "Do things"},
            {"title": "Programme Officer", "url": "/jobs/2"},
            {"title": "Team Lead", "url": "/about/"},
            {"title": "Finance Director", "url": "/jobs/3", "snippet": "Ann Smith is the Director of Finance."},
            {"title": "Our people manager", "url": "/jobs/4"},
            {"title": "Grants Manager", "url": ""},
        ]
    }
    pages = spark.createDataFrame([("Acme", "https://a.org/careers/index.html", json.dumps(data)), ("Beta", "https://b.org/team/", json.dumps(data))], "org string, base_url string, data string")
    got = {(r["org"], r["title"], r["url"]) for r in listings.extracted_jobs(pages).collect()}
    assert got == {("Acme", "Programme Officer", "https://a.org/careers/jobs/1"), ("Acme", "Grants Manager", None)}
    text = "Featured insights. Latest news. Our funding partners."
    rows = spark.createDataFrame([(text,), ("# Careers\n" + text,)], "t string")
    assert [r["x"] for r in rows.select(listings.non_job_listing(F.col("t")).alias("x")).collect()] == [True, False]


def test_profile_sections():
    found = filters.hard_filters("<!-- x: 1 -->\nBan_Regions : Africa, (none), asia\nban_us_only: yes\nonsite_penalty: ten\nprose here\ntypo_field: 1\nkeep_countries: (none)")
    assert (found.ban_regions, found.ban_us_only, found.onsite_penalty, found.keep_countries, found.unknown) == (("africa", "asia"), True, 0, (), ("typo_field",))
    assert filters.hard_filters(None) == filters.HardFilters()


def test_archive_comes_before_removal(spark, tmp_path):
    from roleflow.operators import lifecycle as L

    rows = spark.createDataFrame([(1, "a", "na"), (2, "b", "nb")], "id long, key string, norm string")
    kept, stones = L.remove_rows(rows, spark.createDataFrame([(2,)], "id long"), str(tmp_path / "archive"), "filter", F.current_date())
    assert [r["id"] for r in kept.collect()] == [1] and {r["key"] for r in stones.collect()} == {"b", "nb"}
    assert json.loads(spark.read.parquet(str(tmp_path / "archive")).first()["payload"]) == {"id": "2", "key": "b", "norm": "nb"}
    one = filters.by_prefix(spark.createDataFrame([(12,), (13,), (20,)], "id long"), "2")
    assert [r["id"] for r in one.collect()] == [20] and filters.by_prefix(one.sparkSession.createDataFrame([(12,), (13,)], "id long"), "1").isEmpty()
