"""Queries of careers pages: their job cards and what changed in them, over the given pages with their menus made lists of positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roleflow.plans.bindings import Registry
from roleflow.plans.texts import _html as text_sql
from roleflow.plans.texts import _junk as junk_sql
from roleflow.session import table
from roleflow.sources import pages as P

REGISTRY = Registry()
q = REGISTRY.add

ITEM = r'<li><a href="/([^"]*)">([^<]*)</a></li>'
POSITION = '<li><a href="/jobs/{0}1"><b>{0}2 Manager</b></a><p>Remote {0}2</p></li>'


def _listing(pages: DataFrame) -> DataFrame:
    listed = F.regexp_replace("html", ITEM, POSITION.format("$"))
    return pages.select("page_id", "url", F.replace(F.replace(listed, F.lit("<nav>"), F.lit("<section>")), F.lit("</nav>"), F.lit("</section>")).alias("html"))


_ITEMS = rf"""listing AS (
  SELECT page_id, url, replace(replace(regexp_replace(html, '{ITEM}', '{POSITION.format(chr(92))}', 'g'), '<nav>', '<section>'), '</nav>', '</section>') AS html,
         regexp_extract_all(html, '{ITEM}', 1) AS link, regexp_extract_all(html, '{ITEM}', 2) AS word, regexp_extract(url, '^[a-z]+://[^/?#]*') AS site
  FROM pages),
item AS (SELECT page_id, url, site, unnest(link) AS link, unnest(word) AS word, unnest(range(len(link))) AS i FROM listing WHERE NOT ({junk_sql(text_sql('html'))['marketing']})),
card AS (
  SELECT page_id, url, site || '/jobs/' || link AS card_url, word || ' Manager' AS title, rtrim(rtrim('Remote ' || word), '.,;') AS location, rtrim('Remote ' || word, ' -–|:') AS snippet, i,
         count(*) OVER (PARTITION BY page_id, link) AS n, row_number() OVER (PARTITION BY page_id, link ORDER BY i) AS r FROM item)"""


@q(f"WITH {_ITEMS} SELECT page_id, title, card_url, location, snippet FROM card WHERE n < 3 AND r = 1 QUALIFY row_number() OVER (PARTITION BY page_id, title ORDER BY i) = 1")
def page_cards(spark, sf):
    return P.job_cards(_listing(table(spark, sf, "pages"))).select("page_id", "title", "card_url", "location", "snippet")


@q(
    f"""WITH {_ITEMS},
once AS (SELECT *, row_number() OVER (PARTITION BY page_id, title ORDER BY i) AS t FROM card WHERE n < 3 AND r = 1),
later AS (SELECT *, count(*) OVER (PARTITION BY page_id, card_url) AS n2, row_number() OVER (PARTITION BY page_id, card_url ORDER BY i) AS r2 FROM card WHERE page_id % 3 = 2 OR i > 0),
after AS (SELECT *, row_number() OVER (PARTITION BY page_id, title ORDER BY i) AS t FROM later WHERE n2 < 3 AND r2 = 1)
SELECT url, CAST(NULL AS VARCHAR) AS key, 'alive' AS change FROM pages WHERE page_id % 3 = 0
UNION ALL
SELECT coalesce(b.url, a.url), coalesce(b.card_url, a.card_url), CASE WHEN b.card_url IS NULL THEN 'new' WHEN a.card_url IS NULL THEN 'gone' WHEN b.page_id % 3 = 2 THEN 'changed' ELSE 'alive' END
FROM (SELECT * FROM once WHERE t = 1 AND page_id % 3 > 0) b FULL JOIN (SELECT * FROM after WHERE t = 1 AND page_id % 3 > 0) a ON a.page_id = b.page_id AND a.card_url = b.card_url"""
)
def changed_cards(spark, sf):
    listing = _listing(table(spark, sf, "pages"))
    before = listing.withColumn("url", F.concat("url", F.lit("#"), "page_id"))
    third = F.col("page_id") % 3
    same = F.regexp_replace("html", "<!--.*?-->", "<!-- fetched again -->")
    fewer = F.regexp_replace("html", "<ul><li>.*?</li>", "<ul>")
    after = before.withColumn("html", F.when(third == 0, same).when(third == 1, fewer).otherwise(F.replace("html", F.lit("<p>Remote "), F.lit("<p>Hybrid "))))
    return P.page_changes(before, after).select(F.regexp_replace("url", r"#\d+$", "").alias("url"), "key", "change")
