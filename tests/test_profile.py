"""Employers' rules of profiles, and the sitemap of a host whose tiles are empty."""

from roleflow.operators import filters as S
from roleflow.operators import profile as P
from roleflow.sources import boards as B

TEXT = """# Me
## COMPANY_TITLE_FILTERS
Only these titles, please.
<!-- - Hidden :: all -->
- Acme Inc :: Data , policy lead, DESC: climate, desc:, none
* Acme Inc :: data
Bare Works :: water
- Broken entry
- :: x
- Empty :: , -
## COMPANY_NEVER_FETCH

- Bad Corp
- Bad Corp
- Mixed :: x
prose about it
## OTHER
- Nobody
"""


def test_rules_of_employers(spark):
    profiles = spark.createDataFrame([("a", TEXT), ("b", "## COMPANY_NEVER_FETCH\nAcme Inc\nno dashes"), ("c", None), ("d", "no section\n- X :: y")], "profile string, text string")
    rules = P.employer_rules(profiles)
    assert sorted(map(tuple, rules.includes.collect())) == [("a", "Acme Inc", "desc", "climate"), ("a", "Acme Inc", "title", "data"), ("a", "Acme Inc", "title", "policy lead"), ("a", "Bare Works", "title", "water")]
    assert [tuple(r) for r in rules.never.collect()] == [("a", "Bad Corp")]
    warned = {(r["profile"], r["line"], r["reason"]) for r in rules.warnings.collect()}
    assert {(p, r) for p, _, r in warned} == {("a", "no patterns after ::"), ("a", "no name or no pattern"), ("a", "desc: without words"), ("a", "patterns belong to the other section"), ("b", "no entry, so inactive")}
    assert len(warned) == 6
    rows = spark.createDataFrame([(1, "ACME  inc", "Data Lead", ""), (2, "Acme Inc", "Cook", "on climate"), (3, "Acme Inc", "Cook", None), (4, "bad corp", "Data", ""), (5, "Free", "Any", "")], "id long, org string, title string, description string")
    mine = rules.includes.where("profile = 'a'"), rules.never.where("profile = 'a'")
    assert {r["id"]: r["reason"] for r in S.company_reasons(rows, *mine).collect()} == {1: None, 2: None, 3: "company_title_filter", 4: "company_never_fetch", 5: None}


def test_sitemap_stands_in_for_empty_tiles(spark, tmp_path):
    (tmp_path / "map.xml").write_text('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://x.org/job/Geneva-Lead/12/ </loc></url><url><loc>https://x.org/job/9</loc></url><url><loc></loc></url></urlset>')
    (tmp_path / "index.xml").write_text("<sitemapindex><sitemap><loc>https://x.org/a.xml</loc></sitemap><sitemap><loc>https://x.org/b.xml</loc></sitemap></sitemapindex>")
    links = [tuple(r) for r in B.sitemap_links(spark, str(tmp_path / "map.xml")).collect()]
    assert sorted(links) == [("https://x.org/job/9", None), ("https://x.org/job/Geneva-Lead/12/", None)]
    assert [tuple(r) for r in B.sitemap_links(spark, str(tmp_path / "index.xml")).collect()] == [(None, "sitemap_index")]
    page = '<div class="job"><span itemprop="title"> Lead &amp; Chief </span><style>x</style><span itemprop="description"><p>First</p></span><span itemprop="description"></span><span itemprop="description">Apply by 3 March 2026</span></div>'
    pages = spark.createDataFrame([("https://x.org/job/Geneva-Lead/12/", page), ("https://x.org/job/9", "<p>gone</p>")], "url string, html string")
    (row,) = B.marked_postings(pages, "X").collect()
    assert (row["external_id"], row["title"], row["description"], str(row["deadline"])) == ("12", "Lead & Chief", "First\n\nApply by 3 March 2026", "2026-03-03")
    found = B.marked_postings(pages, "X")
    assert B.with_fallback(found.where("false"), found).count() == 1
    assert B.with_fallback(found, found.withColumn("title", found["url"])).first()["title"] == "Lead & Chief"
