"""Queries of filter categories, exclusions and selections, each with its check in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from roleflow.functions import text as T
from roleflow.operators import classify as C
from roleflow.operators import joins as J
from roleflow.operators import rollups as G
from roleflow.plans.bindings import AS_OF, Registry, bound
from roleflow.session import table

REGISTRY = Registry()
q = REGISTRY.add

#: What the tables lack, made of the id, for both engines.
_FLAGS = (
    "id % 13 = 0 AS company_dropped",
    "id % 2 = 0 AS manual",
    "id % 17 = 0 AS rearchived",
    "id % 19 = 0 AS geo_excluded",
    "CASE WHEN id % 5 = 0 THEN '' WHEN id % 7 = 0 THEN substring(description, 1, 70) ELSE description END AS body",
    "CASE WHEN id % 10 = 0 THEN '' ELSE 'https://e.org/' END AS url",
    "DATE '2001-08-10' - CAST(id % 15 AS INT) AS first_seen",
    "CASE WHEN id % 3 = 0 THEN 'liked' ELSE 'unseen' END AS status",
)
_CATEGORY = f"""+f AS (SELECT id, org, lang, title, {', '.join(_FLAGS)} FROM posting),
k AS (SELECT *, CASE WHEN regexp_matches(lower(title), '\\b(?:worthless|stupid|idiot)(?:es|s)?\\b') THEN 'delete_blacklist' WHEN company_dropped THEN 'delete_company_filter'
WHEN regexp_matches(title, '(?i){T.TEST_POSTING}') AND NOT manual THEN 'delete_not_a_vacancy'
WHEN regexp_matches(title, '(?i){T.OFFERING}') AND NOT regexp_matches(title, '(?i){T.ROLE_NOUN}') AND len(regexp_extract_all(body, '(?i){T.POSTING.replace("'", "''")}')) <= 1 AND NOT manual THEN 'delete_not_a_vacancy'
WHEN body <> '' AND (regexp_matches(lower(body[:500]), '404 not found|page not found|error 404|access denied|cannot be displayed|every\\.org|donate to a fund|make a donation') OR length(regexp_replace(body, '^\\s+|\\s+$', '', 'g')) < 50) THEN 'delete_junk'
WHEN rearchived THEN 'delete_rearchived' WHEN geo_excluded THEN 'delete_geo' WHEN url <> '' AND length(trim(body)) = 0 AND date_diff('day', first_seen, {AS_OF}) > 7 THEN 'delete_stale_blind'
WHEN url <> '' AND length(trim(body)) = 0 THEN 'reenrich_blind' WHEN length(trim(body)) < 100 THEN 'reenrich_thin' ELSE 'ready' END AS category FROM f)"""


def _classified(spark, sf):
    rows = bound(spark, sf, "posting").selectExpr("id", "org", "lang", "title", *_FLAGS)
    columns = {k: F.col(k) for k in ("title", "url", "first_seen", "company_dropped", "manual", "rearchived", "geo_excluded")} | {"description": F.col("body")}
    return rows.withColumn("category", C.category(columns, ("idiot", "stupid", "worthless"), (), F.expr(AS_OF)))


@q(f"{_CATEGORY} SELECT id, category FROM k", "posting")
def classify_priority(spark, sf):
    return _classified(spark, sf).select("id", "category")


@q(
    f"""{_CATEGORY}, g AS (SELECT id, status, first(category) OVER (PARTITION BY org, lang ORDER BY length(body) DESC, id) AS f, bool_and(category = 'delete_geo') OVER (PARTITION BY org, lang) AS geo FROM k)
SELECT id, CASE WHEN status = 'unseen' THEN CASE WHEN f = 'delete_geo' THEN CASE WHEN geo THEN f END WHEN starts_with(f, 'delete_') THEN f END END AS reason FROM g""",
    "posting",
)
def exclusion_reason_group(spark, sf):
    rows = _classified(spark, sf).withColumn("n", F.length("body"))
    return C.group_reasons(rows, ["org", "lang"]).select("id", "reason")


@q(
    """SELECT id, CASE WHEN status = 'archived' THEN 'old' WHEN score < 20 THEN 'old' WHEN score < 60 THEN 'new' END AS reason,
CASE WHEN status = 'archived' THEN 'out_of_scope' WHEN score < 20 THEN 'kept' WHEN score < 60 THEN 'stamped' ELSE 'cleared' END AS change FROM vacancy""",
    "vacancy",
)
def reason_changes(spark, sf):
    v = bound(spark, sf, "vacancy")
    stored = v.select("id", F.lit("old").alias("stored_reason"))
    fresh = v.where("status <> 'archived'").selectExpr("id", "CASE WHEN score < 20 THEN 'old' WHEN score < 60 THEN 'new' END AS reason")
    return C.stamp(stored, fresh)


@q(
    """+h AS (SELECT id, list_filter([CASE WHEN regexp_matches(kind, '(?i)econ') THEN 'Economy' END, CASE WHEN regexp_matches(title, '(?i)ring|bolt') THEN 'Small' END, CASE WHEN regexp_matches(title, '(?i)widget') THEN 'Widget' END], lambda x: x IS NOT NULL) AS h FROM role)
SELECT CASE WHEN len(h) = 1 THEN h[1] ELSE 'Other' END AS function, count(*) AS n FROM h GROUP BY 1""",
    "role",
)
def function_batches(spark, sf):
    text = F.concat_ws("|", "kind", "title")
    named = C.functions_of(text, {"Economy": "^[^|]*econ", "Small": r"\|.*(?:ring|bolt)", "Widget": r"\|.*widget"})
    return bound(spark, sf, "role").groupBy(named.alias("function")).agg(F.count(F.lit(1)).alias("n"))


@q("SELECT id, CASE WHEN score IS NULL THEN 'score+facts' ELSE 'facts' END AS ask FROM vacancy WHERE status = 'unseen' AND (score IS NULL OR score < 40) ORDER BY board IS NULL, first_seen, id LIMIT 500", "vacancy")
def judge_queue(spark, sf):
    return C.judge_queue(bound(spark, sf, "vacancy"), 500).select("id", "ask")


@q(
    """SELECT company_id AS "group", max(score) AS best FROM vacancy GROUP BY company_id HAVING max(score) >= 95 AND NOT bool_or(id % 29 = 0)""",
    "vacancy",
)
def escalations(spark, sf):
    v = bound(spark, sf, "vacancy")
    scored = v.withColumn("scored_by", F.when(F.col("id") % 29 == 0, "strong").otherwise("light"))
    return C.escalations(scored, "company_id", 95, "strong")


@q(
    """+u AS (SELECT page_id AS id, regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '/[0-9]+$', '') AS url FROM pages), f AS (SELECT id, url, min(id) OVER (PARTITION BY url) AS holder FROM u)
SELECT id, holder FROM f WHERE id <> holder""".replace("+u", "WITH u", 1)
)
def cross_company_links(spark, sf):
    url = F.expr("regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '/[0-9]+$', '')")
    return J.same_link(table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.array(url).alias("urls"))).select("id", "holder")


@q(
    f"""SELECT count(*) FILTER (WHERE status = 'applied') AS waiting, CAST(max(CASE WHEN status = 'applied' THEN date_diff('day', first_seen, {AS_OF}) END) AS INT) AS oldest_days,
count(*) FILTER (WHERE first_seen > DATE '2001-06-01') AS since FROM vacancy""",
    "vacancy",
)
def waiting_block(spark, sf):
    waiting = F.col("status") == "applied"
    return bound(spark, sf, "vacancy").agg(
        F.count_if(waiting).alias("waiting"), F.max(F.when(waiting, F.datediff(F.expr(AS_OF), "first_seen"))).alias("oldest_days"), F.count_if(F.col("first_seen") > F.expr("DATE '2001-06-01'")).alias("since")
    )


@q(
    """SELECT source, count(*) AS fetched, count(*) FILTER (WHERE value >= 30) AS scored, count(*) FILTER (WHERE status = 'error') AS dropped, count(*) FILTER (WHERE value < 30 AND status <> 'error') AS unscored,
round(avg(CASE WHEN (value >= 30) = (status = 'purchase') THEN 1.0 ELSE 0.0 END::DOUBLE), 4) AS agreement FROM seen WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY source""",
    "seen",
)
def run_counts(spark, sf):
    rows = bound(spark, sf, "seen").where("ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00'")
    good = F.col("value") >= 30
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("fetched"), G.n(good).alias("scored"), G.n(F.col("status") == "error").alias("dropped"), G.n(~good & (F.col("status") != "error")).alias("unscored"),
        F.round(F.avg((good == (F.col("status") == "purchase")).cast("double")), 4).alias("agreement"),
    )


@q(
    """SELECT company_key, company, r.n AS total, coalesce(r.liked, 0) AS liked, coalesce(r.unseen, 0) AS unseen, coalesce(r.best, CAST(floor(balance) AS BIGINT)) AS score FROM company LEFT JOIN
(SELECT company_id, count(*) AS n, count(*) FILTER (WHERE status = 'liked') AS liked, count(*) FILTER (WHERE status = 'unseen') AS unseen, max(score) AS best FROM vacancy GROUP BY company_id) r ON r.company_id = company_key""",
    "vacancy",
    "company",
)
def company_catalogue(spark, sf):
    rolled = bound(spark, sf, "vacancy").groupBy("company_id").agg(
        F.count(F.lit(1)).alias("total"), G.n(F.col("status") == "liked").alias("liked"), G.n(F.col("status") == "unseen").alias("unseen"), F.max("score").alias("best")
    )
    joined = bound(spark, sf, "company").join(rolled, F.col("company_id") == F.col("company_key"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("company_key", "company", "total", zero("liked"), zero("unseen"), F.coalesce("best", F.floor("balance").cast("long")).alias("score"))


@q("SELECT id, status, score, last_seen FROM vacancy WHERE status = 'archived' ORDER BY last_seen DESC, id LIMIT 300", "vacancy")
def archive_newest(spark, sf):
    return bound(spark, sf, "vacancy").where("status = 'archived'").orderBy(F.desc("last_seen"), "id").limit(300).select("id", "status", "score", "last_seen")


@q("SELECT id, score, first_seen FROM vacancy WHERE score < 40 ORDER BY first_seen DESC NULLS LAST, id LIMIT 200", "vacancy")
def low_scored_recent(spark, sf):
    return bound(spark, sf, "vacancy").where("score < 40").orderBy(F.desc_nulls_last("first_seen"), "id").limit(200).select("id", "score", "first_seen")
