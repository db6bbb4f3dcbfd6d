"""Queries of filters, keys, places, values and listing rules over rows of the given tables, each with its check in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from roleflow import vocabulary as V
from roleflow.functions import keys as K
from roleflow.functions import places as P
from roleflow.functions import text as T
from roleflow.functions import values as D
from roleflow.operators import filters as S
from roleflow.operators import joins as J
from roleflow.operators import rollups as G
from roleflow.operators import screening as C
from roleflow.plans.bindings import AS_OF, Registry, bound
from roleflow.session import spread, table
from roleflow.sources import connectors, listings

REGISTRY = Registry()
q = REGISTRY.add


def _sql(text: str) -> str:
    return text.replace("'", "''")


def _values(names: str, rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, (int, float)) else f"'{_sql(x)}'" for x in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({names})"


RULES = [("Brand#1", "title", "ring|bolt"), ("brand#1 ", "title", "widget"), ("Brand#2", "desc", "economy"), ("Brand#3", "title", "nothing at all")]
NEVER = [("BRAND#4",), ("Brand#5",)]


@q(
    f"""+k AS (SELECT trim(lower(name)) AS k, list(struct_pack(s := scope, p := pattern)) AS r FROM {_values('name, scope, pattern', RULES)} GROUP BY 1), n AS (SELECT DISTINCT trim(lower(name)) AS k FROM {_values('name', NEVER)})
SELECT id, CASE WHEN n.k IS NOT NULL THEN 'company_never_fetch' WHEN k.k IS NOT NULL AND NOT len(list_filter(k.r, lambda x: regexp_matches(lower(CASE WHEN x.s = 'desc' THEN kind ELSE title END), x.p))) > 0 THEN 'company_title_filter' END AS reason
FROM role LEFT JOIN k ON k.k = lower(org) LEFT JOIN n ON n.k = lower(org)""",
    "role",
)
def company_rules(spark, sf):
    rows = bound(spark, sf, "role").withColumn("description", F.col("kind"))
    return S.company_reasons(rows, spark.createDataFrame(RULES, "name string, scope string, pattern string"), spark.createDataFrame(NEVER, "name string")).select("id", "reason")


@q(
    """SELECT id, (contains(lower(title), 'ring') OR contains(lower(title), 'widget')) AND NOT regexp_matches(lower(title), '\\bsmall(?:es|s)?\\b') AND NOT contains(lower(title), 'red')
AND (contains(lower(kind), 'eco') OR contains(lower(kind), 'prom')) AS keep FROM role""",
    "role",
)
def keyword_filter(spark, sf):
    keep = S.keyword_filter(F.col("title"), F.array("kind"), include=("Ring", "widget"), exclude=("small",), stems=("red",), places=("ECO", "prom"))
    return bound(spark, sf, "role").select("id", keep.alias("keep"))


@q(
    """+m AS (SELECT c_custkey AS id, c_name || ' <' || lower(replace(c_name, '#', '.')) || '@mail.' || lower(c_mktsegment) || '.org>' AS sender, 'Your ' || lower(c_mktsegment) || ' application ' || c_nationkey AS subject FROM customer)
SELECT id, CASE WHEN contains(sender, 'customer.000000001@') OR contains(sender, '.furniture.org') THEN NULL WHEN contains(sender, '.machinery.org') THEN 'platform' WHEN contains(sender, '.building.org') THEN 'employer'
WHEN contains(lower(subject), 'application 1') THEN 'status' END AS reason FROM m""".replace("+m", "WITH m", 1)
)
def mail_reasons(spark, sf):
    rows = table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_name || ' <' || lower(replace(c_name, '#', '.')) || '@mail.' || lower(c_mktsegment) || '.org>' AS sender", "'Your ' || lower(c_mktsegment) || ' application ' || c_nationkey AS subject")
    reason = S.mail_reason(F.col("sender"), F.col("subject"), own=("customer.000000001@mail.building.org", "customer.000000001@mail.household.org", "customer.000000001@mail.machinery.org", "customer.000000001@mail.automobile.org"), excluded=("furniture.org",), platforms=("machinery.org",), employers=("building.org",), phrases={"Application 1": "status"})
    return rows.select("id", reason.alias("reason"))


@q(
    f"""SELECT id, CASE WHEN status IN ('liked', 'archived') THEN status = 'liked' ELSE coalesce(score > 90, false) OR coalesce(score >= 40, false) END AS visible, list_contains(['to_apply', 'interview', 'liked', 'applied'], status) AS shown FROM vacancy"""
    ,
    "vacancy",
)
def visible_rows(spark, sf):
    v = bound(spark, sf, "vacancy")
    verdict = F.when(F.col("status") == "liked", "keep").when(F.col("status") == "archived", "kill")
    column = C.progress_column(F.col("status"), ("to_apply", "interview", "liked", "applied"))
    return v.select("id", C.visible(verdict, F.col("score") > 90, F.col("score")).alias("visible"), column.isNotNull().alias("shown"))


#: Requirements and comparisons of an order's lines, as a prepared result has them.
_LINES = (
    "l_orderkey AS id", "l_linenumber AS k", "CASE l_returnflag WHEN 'A' THEN 'skill' WHEN 'R' THEN 'language' ELSE 'location' END AS kind",
    "CASE l_linestatus WHEN 'O' THEN 'required' ELSE 'preferred' END AS strength", "CASE WHEN l_partkey % 7 = 0 THEN ' ' ELSE concat('q', l_partkey) END AS quote",
    "CASE WHEN l_quantity > 25 THEN 'possible_conflict' ELSE 'supported' END AS finding",
)


def _prepared(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(*_LINES)
    listed = F.array_sort(F.collect_list(F.struct("k", "kind", "strength", "quote", "finding")))
    grouped = rows.groupBy("id").agg(listed.alias("x"))
    required = F.transform("x", lambda r: F.struct(r["kind"].alias("kind"), r["strength"].alias("strength"), r["quote"].alias("quote"), r["finding"].alias("value")))
    compared = F.transform("x", lambda r, i: F.struct(i.alias("requirement"), r["finding"].alias("finding"), F.lit("").alias("note")))
    return grouped.select("id", required.alias("requirements"), compared.alias("comparison"))


@q(
    f"""+l AS (SELECT {', '.join(_LINES)} FROM lineitem), c AS (SELECT id, count(*) FILTER (WHERE strength = 'required' AND finding = 'possible_conflict' AND trim(quote) <> '' AND kind IN ('location', 'language')) AS e,
count(*) FILTER (WHERE strength = 'required' AND finding = 'possible_conflict' AND trim(quote) <> '' AND kind = 'skill') AS f, bool_or(kind = 'skill' AND strength = 'required' AND finding = 'supported') AS has FROM l GROUP BY id)
SELECT id, CASE WHEN e > 0 THEN 'eligibility' WHEN f > 0 THEN 'fit' END AS key, CAST(CASE WHEN e > 0 THEN e WHEN f > 0 THEN f ELSE 0 END AS INT) AS n, has FROM c""".replace("+l", "WITH l", 1)
)
def reason_batches(spark, sf):
    rows = _prepared(spark, sf)
    reason = C.reason_class(F.col("requirements"), F.col("comparison"), F.lit("v1"), F.lit("v1"))
    has = C.requirement_matches(F.col("requirements"), F.col("comparison"), kind="skill", strength="required", finding="supported")
    return rows.select("id", reason.alias("r"), has.alias("has")).select("id", "r.key", F.coalesce(F.size("r.reasons"), F.lit(0)).alias("n"), "has").withColumn("n", F.greatest("n", F.lit(0)))


@q("SELECT id, length(description) >= 200 AND NOT starts_with(lang, 'd') AND sha256(concat('v2', chr(31), title, chr(31), description)) NOT LIKE '0%' AS eligible FROM posting", "posting")
def preparable_rows(spark, sf):
    rows = bound(spark, sf, "posting")
    now = F.sha2(F.concat_ws("\x1f", F.lit("v2"), "title", "description"), 256)
    stored = F.when(now.startswith("0"), now)
    return rows.select("id", C.preparable(F.col("description"), F.col("lang").startswith("d"), stored, "v2", F.col("title")).alias("eligible"))


@q(
    """+t AS (SELECT id, lower(org) AS org, [lower(title), lower(kind), lower(title || ' ' || kind || ' role')] AS segs FROM role),
s AS (SELECT id, org, array_to_string(list_transform(str_split(x, ' '), lambda w: CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN w[: length(w) - 3] || 'y' WHEN length(w) > 3 AND w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is)$') THEN w[: length(w) - 1] ELSE w END), ' ') AS seg FROM t, unnest(segs) AS u(x))
SELECT substring(md5(org || '|' || seg), 1, 16) AS key, count(DISTINCT id) AS n FROM s WHERE len(str_split(seg, ' ')) >= 3 GROUP BY 1""",
    "role",
)
def segment_title_keys(spark, sf):
    title = F.concat_ws(", ", "title", "kind", F.concat_ws(" ", "title", "kind", F.lit("role")))
    # Before an inner explode the optimizer would make all keys once more, to see whether there are any.
    rows = spread(bound(spark, sf, "role"), "id").select("id", F.explode_outer(K.segment_keys(F.col("org"), title)).alias("key")).where("key is not null")
    return rows.groupBy("key").agg(F.count_distinct("id").alias("n"))


_LINKS = """CASE l_linenumber WHEN 1 THEN concat('https://boards.greenhouse.io/acme/jobs/', l_orderkey, '?gh_src=x') WHEN 2 THEN concat('https://e.org/apply?gh_jid=', l_partkey, '&utm_source=b')
WHEN 3 THEN concat('https://jobs.smartrecruiters.com/Acme/', 1000000 + l_partkey) WHEN 4 THEN concat('https://apply.workable.com/acme/j/AB', l_suppkey, '/') WHEN 5 THEN concat('https://acme.wd3.myworkdayjobs.com/en-GB/Site/job/Paris/Role_JR', 10000 + l_partkey)
WHEN 6 THEN concat('https://x.org/about/', l_partkey, '#team') ELSE concat('https://www.linkedin.com/jobs/view/role-', 1000000 + l_orderkey) END"""


@q(
    f"""+u AS (SELECT l_orderkey AS id, l_linenumber AS k, {_LINKS} AS url FROM lineitem)
SELECT id, k, CASE k WHEN 1 THEN concat('greenhouse:', regexp_extract(url, 'jobs/([0-9]+)', 1)) WHEN 2 THEN concat('greenhouse:', regexp_extract(url, 'gh_jid=([0-9]+)', 1)) WHEN 3 THEN concat('smartrecruiters:', regexp_extract(url, 'Acme/([0-9]+)', 1))
WHEN 4 THEN concat('workable:', lower(regexp_extract(url, '/j/([A-Za-z0-9]+)', 1))) WHEN 5 THEN concat('workday:', lower(regexp_extract(url, '_(JR[0-9]+)', 1))) END AS req,
CASE WHEN k = 5 THEN concat('https://acme.wd3.myworkdayjobs.com/wday/cxs/acme/Site/job/Paris/Role_', regexp_extract(url, '_(JR[0-9]+)', 1)) END AS detail, k = 6 AS about, CASE WHEN k > 6 THEN regexp_extract(url, '([0-9]+)$', 1) END AS linkedin FROM u""".replace("+u", "WITH u", 1)
)
def link_keys(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey AS id", "l_linenumber AS k", f"{_LINKS} AS url")
    u = F.col("url")
    return rows.select("id", "k", K.requisition_key(u).alias("req"), listings.workday_detail(u).alias("detail"), listings.non_job_url(u).alias("about"), listings.linkedin_id(u).alias("linkedin"))


@q(
    f"""+u AS (SELECT l_orderkey AS page_id, {_LINKS} AS link FROM lineitem), b AS (
SELECT page_id, 'greenhouse' AS vendor, 'acme' AS slug, unnest(['https://job-boards.greenhouse.io/acme', 'https://boards.greenhouse.io/acme']) AS board_url FROM u WHERE contains(link, 'greenhouse.io')
UNION ALL SELECT page_id, 'workable', unnest(['acme', 'acme', 'apply', 'apply']), unnest(['https://apply.workable.com/acme/', 'https://acme.workable.com', 'https://apply.workable.com/apply/', 'https://apply.workable.com']) FROM u WHERE contains(link, 'workable.com'))
SELECT DISTINCT page_id, vendor, slug, board_url FROM b""".replace("+u", "WITH u", 1)
)
def boards_in_links(spark, sf):
    return listings.boards_in_links(table(spark, sf, "lineitem").selectExpr("l_orderkey AS page_id", f"{_LINKS} AS link"))


@q(
    f"""+u AS (SELECT l_suppkey AS page_id, l_orderkey * 10 + l_linenumber AS pos, {_LINKS} AS link FROM lineitem), m AS (SELECT page_id, CASE WHEN contains(link, 'greenhouse') THEN 'greenhouse' ELSE 'workable' END AS vendor, link, min(pos) AS pos FROM u
WHERE contains(link, 'greenhouse.io/acme/jobs') OR contains(link, 'workable.com/acme/j/') GROUP BY ALL)
SELECT page_id, vendor, link FROM m QUALIFY row_number() OVER (PARTITION BY page_id, vendor ORDER BY pos, link) <= 3""".replace("+u", "WITH u", 1)
)
def postings_in_links(spark, sf):
    return listings.postings_in_links(table(spark, sf, "lineitem").selectExpr("l_suppkey AS page_id", "l_orderkey * 10 + l_linenumber AS at", f"{_LINKS} AS link"), 3)


@q(
    f"""+u AS (SELECT {_LINKS} AS link FROM lineitem)
SELECT DISTINCT CASE WHEN contains(link, 'greenhouse') THEN 'greenhouse' WHEN contains(link, 'smart') THEN 'smartrecruiters' WHEN contains(link, 'workable') THEN 'workable' ELSE 'workday' END AS vendor, 'acme' AS slug FROM u
WHERE regexp_matches(link, 'greenhouse|smart|workable|workday')""".replace("+u", "WITH u", 1)
)
def vendors_in_links(spark, sf):
    return connectors.vendors_of(table(spark, sf, "lineitem").selectExpr(f"{_LINKS} AS link"))


_SNIPPET = """CASE c_nationkey % 6 WHEN 0 THEN 'Ann Smith is the Director of Things for Acme.' WHEN 1 THEN concat('Acme ', c_mktsegment, ' | Remote') WHEN 2 THEN 'She has led teams for years' WHEN 3 THEN 'Marie Houn joined Acme in 2017'
WHEN 4 THEN 'The Director is the Lead of all' ELSE concat('**Big Fund**', ' - role ', c_custkey) END"""
_ROLE = """CASE c_custkey % 7 WHEN 0 THEN 'Senior Manager' WHEN 1 THEN 'Programme Officer at Good Works' WHEN 2 THEN 'Managers' WHEN 3 THEN 'What is a director?' WHEN 4 THEN 'Our team lead' WHEN 5 THEN concat(c_name, ' analyst') ELSE 'International Desk at Berlin Office' END"""


@q(
    f"""+r AS (SELECT c_custkey AS id, c_nationkey % 6 AS s, c_custkey % 7 AS t, c_custkey, c_mktsegment FROM customer)
SELECT id, s IN (0, 2, 3) AS bio, t IN (0, 1, 5) AS title, CASE WHEN t = 1 THEN 'Good Works' WHEN s = 1 THEN concat('Acme ', c_mktsegment) WHEN s = 5 THEN 'Big Fund' ELSE '[via Board]' END AS org FROM r""".replace("+r", "WITH r", 1)
)
def listing_rules(spark, sf):
    rows = table(spark, sf, "customer").selectExpr("c_custkey AS id", f"{_SNIPPET} AS snippet", f"{_ROLE} AS title")
    return rows.select("id", listings.bio_snippet(F.col("snippet")).alias("bio"), listings.title_like(F.col("title")).alias("title"), listings.listed_org(F.col("snippet"), F.col("title"), F.lit("Board")).alias("org"))


_PAY = """CASE c_custkey % 6 WHEN 0 THEN concat('Compensation: €', c_nationkey + 2, ',400 - €', c_nationkey + 5, ',100') WHEN 1 THEN concat('the salary range for this is $', c_nationkey + 60, ',000 - $', c_nationkey + 90, ',000 a year')
WHEN 2 THEN concat('GEL', c_nationkey + 10, ',000 - GEL', c_nationkey + 12, ',050') WHEN 3 THEN concat('Salary: £', c_nationkey + 1, ',234') WHEN 4 THEN concat('Compensation: ', c_nationkey + 100, ',000 - ', c_nationkey + 120, ',000 dinars') ELSE 'none' END"""


@q(
    """+p AS (SELECT c_custkey AS id, c_custkey % 6 AS k, c_nationkey AS n FROM customer)
SELECT id, CASE k WHEN 0 THEN CASE WHEN n + 2 >= 20 THEN concat('€', format('{:,}', CAST(round_even((n + 2) * 1000 / 12.0 + 400 / 12.0, 0) AS BIGINT)), '-€', format('{:,}', CAST(round_even(((n + 5) * 1000 + 100) / 12.0, 0) AS BIGINT)), '/mo')
  ELSE concat('€', n + 2, ',400-€', n + 5, ',100/mo') END
WHEN 1 THEN concat('$', format('{:,}', CAST(round_even((n + 60) * 1000 / 12.0, 0) AS BIGINT)), '-$', format('{:,}', CAST(round_even((n + 90) * 1000 / 12.0, 0) AS BIGINT)), '/mo')
WHEN 2 THEN concat('GEL ', n + 10, ',000-', n + 12, ',050/mo') WHEN 3 THEN CASE WHEN (n + 1) * 1000 + 234 > 20000 THEN concat('£', format('{:,}', CAST(round_even(((n + 1) * 1000 + 234) / 12.0, 0) AS BIGINT)), '/mo') ELSE concat('£', n + 1, ',234/mo') END
WHEN 4 THEN concat('RSD ', n + 100, ',000-', n + 120, ',000/mo') ELSE '' END AS pay FROM p""".replace("+p", "WITH p", 1)
)
def monthly_pay(spark, sf):
    return table(spark, sf, "customer").selectExpr("c_custkey AS id", f"{_PAY} AS t").select("id", D.monthly_pay(F.col("t")).alias("pay"))


@q(
    f"""+n AS (SELECT c_custkey AS id, lower(c_name) AS low, c_name, c_mktsegment FROM customer)
SELECT id, CASE WHEN id % 3 = 0 THEN c_name WHEN id % 3 = 1 THEN c_name ELSE concat(c_name, ' x') END AS canonical FROM n""".replace("+n", "WITH n", 1)
)
def canonical_names(spark, sf):
    c = table(spark, sf, "customer")
    names = c.selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) WHEN c_custkey % 3 = 1 THEN concat('alias  of ', c_name) ELSE concat(c_name, ' x') END AS name")
    known = c.selectExpr("c_name AS company", "array(concat('Alias of ', c_name)) AS aliases")
    return names.join(J.resolve_names(names.select("name"), known), "name").select("id", "canonical")


@q(
    """+c AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier)
SELECT concat('The Group ', n, 'x & ', k, 'y Works Ltd') AS name, min(k) AS company_key FROM c GROUP BY n, k""".replace("+c", "WITH c", 1)
)
def name_matches(spark, sf):
    s = table(spark, sf, "supplier")
    names = s.selectExpr("concat('The Group ', s_nationkey, 'x & ', s_suppkey, 'y Works Ltd') AS name").distinct()
    companies = s.selectExpr("s_suppkey AS company_key", "concat(s_suppkey, 'Y  works: Gróup ', s_nationkey, 'X') AS company", "CAST(array() AS array<string>) AS aliases", "0 AS rank")
    return J.matching_companies(names, companies)


_CITIES = {"paris": "France", "berlin": "Germany"}
_ALIASES = {"usa": "United States", "uk": "United Kingdom"}
_BUCKETS = {"france": "europe", "germany": "europe", "united states": "americas", "asia": "asia"}


@q(
    """+p AS (SELECT c_custkey AS id, CASE c_nationkey % 5 WHEN 0 THEN 'USA' WHEN 1 THEN 'France' END AS country, CASE c_nationkey % 3 WHEN 0 THEN 'Berlin' END AS city, CASE WHEN c_nationkey % 2 = 0 THEN 'Asia' END AS region, CASE WHEN c_custkey % 2 = 0 THEN 'based in the UK' ELSE 'Ukraine' END AS t,
CASE c_custkey % 4 WHEN 0 THEN 'Remote, US' WHEN 1 THEN 'Hybrid' WHEN 2 THEN 'on-site' END AS w FROM customer)
SELECT id, CASE WHEN country = 'USA' THEN 'United States' WHEN country IS NOT NULL THEN country WHEN city IS NOT NULL THEN 'Germany' WHEN t LIKE '%UK' THEN 'United Kingdom' END AS country,
CASE WHEN country = 'France' THEN 'europe' WHEN region = 'Asia' THEN 'asia' WHEN country IS NULL AND city IS NULL AND region IS NULL THEN 'unknown' ELSE 'other' END AS bucket,
CASE WHEN country = 'France' THEN false WHEN country = 'USA' THEN true ELSE false END AS banned, CASE w WHEN 'Remote, US' THEN 'remote' WHEN 'Hybrid' THEN 'hybrid' WHEN 'on-site' THEN 'onsite' END AS mode,
country = 'USA' IS TRUE AND coalesce(w, '') <> 'Remote, US' AS gone FROM p""".replace("+p", "WITH p", 1)
)
def place_rules(spark, sf):
    rows = table(spark, sf, "customer").selectExpr(
        "c_custkey AS id", "CASE c_nationkey % 5 WHEN 0 THEN 'USA' WHEN 1 THEN 'France' END AS country", "CASE c_nationkey % 3 WHEN 0 THEN 'Berlin' END AS city", "CASE WHEN c_nationkey % 2 = 0 THEN 'Asia' END AS region",
        "CASE WHEN c_custkey % 2 = 0 THEN 'based in the UK' ELSE 'Ukraine' END AS t", "CASE c_custkey % 4 WHEN 0 THEN 'Remote, US' WHEN 1 THEN 'Hybrid' WHEN 2 THEN 'on-site' END AS w",
    )
    country, city, region, mode = F.col("country"), F.col("city"), F.col("region"), P.work_mode(F.col("w"))
    lists = (("France",), ("USA",), ("nowhere",))
    places = F.array(F.struct(mode.alias("work_mode"), country.alias("country"), region.alias("region")))
    return rows.select(
        "id", P.canonical_country(country, city, F.col("t"), _CITIES, _ALIASES).alias("country"), P.bucket(country, city, region, _BUCKETS).alias("bucket"),
        P.banned(country, region, *lists).alias("banned"), mode.alias("mode"), P.all_excluded(places, *lists).alias("gone"),
    )


@q(
    f"""+d AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, o_orderkey % 6 AS k FROM orders)
SELECT id, CASE WHEN k = 5 THEN NULL WHEN k = 4 THEN NULL ELSE d END AS strict, CASE WHEN k IN (0, 1, 2, 3) THEN d END AS cue, CASE WHEN date_diff('day', {AS_OF}, d) = 0 THEN 'today' WHEN date_diff('day', {AS_OF}, d) = 1 THEN 'tomorrow' WHEN date_diff('day', {AS_OF}, d) = -1 THEN 'yesterday'
WHEN d > {AS_OF} THEN concat('in ', date_diff('day', {AS_OF}, d), ' days') ELSE concat(-date_diff('day', {AS_OF}, d), ' days ago') END AS said FROM d""".replace("+d", "WITH d", 1)
)
def date_values(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey AS id", "CAST(o_orderdate AS DATE) AS d", "o_orderkey % 6 AS k")
    iso = F.date_format("d", "yyyy-MM-dd")
    strict = F.when(F.col("k") == 5, F.lit("2026-02-30")).when(F.col("k") == 4, F.date_format("d", "dd/MM/yyyy")).otherwise(iso)
    shown = F.when(F.col("k") == 0, iso).when(F.col("k") == 1, F.date_format("d", "d MMMM yyyy")).when(F.col("k") == 2, F.date_format("d", "MMMM d, yyyy")).when(F.col("k") == 3, F.date_format("d", "dd/MM/yyyy")).otherwise("soon")
    return rows.select("id", D.strict_date(strict).alias("strict"), D.deadline_of(F.concat(F.lit("Role. Deadline: "), shown)).alias("cue"), D.relative_day(F.col("d"), F.expr(AS_OF)).alias("said"))


@q(
    """SELECT p_partkey AS id, CASE WHEN CAST(floor(p_retailprice) AS BIGINT) - 850 BETWEEN 0 AND 100 THEN CAST(greatest(0, floor(p_retailprice) - 850 - p_size) AS INT) END AS score,
concat('<b>', p_name, '</b> &amp; &quot;') AS t0, replace(concat('&lt;b&gt;', p_name, '&lt;/b&gt; &amp; &quot;'), 'zzz', '') AS escaped, concat('see token=', '***', ' at https://u:***@h.org ', p_name) AS masked,
[p_brand, p_type] AS chips FROM part"""
)
def scalar_values(spark, sf):
    rows = table(spark, sf, "part")
    raw = F.concat(F.lit("<b>"), "p_name", F.lit('</b> & "'))
    return rows.select(
        F.col("p_partkey").alias("id"), D.score_of(F.floor("p_retailprice") - 850, F.col("p_size").cast("int")).alias("score"), F.concat(F.lit("<b>"), "p_name", F.lit("</b> &amp; &quot;")).alias("t0"),
        T.escape_html(raw).alias("escaped"), T.mask_secrets(F.concat(F.lit("see token=abc123 at https://u:pw@h.org "), "p_name")).alias("masked"), P.chips(F.concat_ws(" ; ", "p_brand", "p_type", "p_brand")).alias("chips"),
    )


@q(
    """+s AS (SELECT id, regexp_replace(regexp_replace(description, '\\s+', ' ', 'g'), '^ | $', '', 'g') AS line, CASE WHEN lang = 'fr' THEN substring(description, 1, 400) END AS given FROM posting)
SELECT id, CASE WHEN length(given) > 0 THEN CASE WHEN length(trim(given)) <= 300 THEN trim(given) ELSE regexp_replace(trim(given)[:300], ' [^ ]*$', '') || '…' END WHEN length(line) <= 200 THEN line ELSE regexp_replace(line[:200], ' [^ ]*$', '') || '…' END AS summary FROM s""",
    "posting",
)
def summaries(spark, sf):
    rows = bound(spark, sf, "posting")
    given = F.when(F.col("lang") == "fr", F.substring("description", 1, 400))
    return rows.select("id", D.summary(given, F.col("description"), F.lit(None).cast("string")).alias("summary"))


@q(
    """+b AS (SELECT r_regionkey AS board, ['AFRICA', r_name, 'x'] AS tags FROM region)
SELECT board, list_filter(tags, lambda t: list_contains(['AFRICA', 'ASIA'], t)) AS hits, CAST(len(list_filter(tags, lambda t: list_contains(['AFRICA', 'ASIA'], t))) AS INT) AS n FROM b""".replace("+b", "WITH b", 1)
)
def recommended_boards(spark, sf):
    boards = table(spark, sf, "region").selectExpr("r_regionkey AS board", "array('AFRICA', r_name, 'x') AS tags")
    return S.board_matches(boards, "I have worked in Africa, and in Asia too; not in Asiatic studies")


@q(
    """+w AS (SELECT unnest(list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda w: length(w) >= 3))) AS word, kind FROM role), c AS (SELECT word, count(*) FILTER (WHERE kind = 'ECONOMY') AS hits, count(*) FILTER (WHERE kind = 'PROMO') AS good FROM w GROUP BY word),
f AS (SELECT word AS keyword, CASE WHEN length(word) > 4 THEN 'long' ELSE 'short' END AS factor FROM c)
SELECT factor, keyword, hits FROM f JOIN c ON c.word = f.keyword WHERE good <= 1000000 QUALIFY row_number() OVER (PARTITION BY factor ORDER BY hits DESC, word) = 1""",
    "role",
)
def factor_moves(spark, sf):
    words = F.filter(F.array_distinct(F.split(F.lower("title"), r"[^a-z0-9]+")), lambda w: F.length(w) >= 3)
    spread = bound(spark, sf, "role").select("kind", F.explode(words).alias("word"))
    counted = spread.groupBy("word").agg(F.count_if(F.col("kind") == "ECONOMY").alias("hits"), F.lit(0).alias("good"))
    named = counted.select(F.col("word").alias("keyword"), F.when(F.length("word") > 4, "long").otherwise("short").alias("factor"))
    return S.factor_keywords(counted, named)


@q(
    """SELECT 'missing_field' AS fault, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT DISTINCT 'dangling_alias', concat('alias ', c_nationkey) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)"""
)
def registry_faults(spark, sf):
    companies = table(spark, sf, "customer").selectExpr("c_name AS name", "nullif(c_mktsegment, 'BUILDING') AS strategy", "array(concat('alias ', c_nationkey)) AS aliases")
    known = table(spark, sf, "nation").where("n_regionkey < 3").selectExpr("concat('alias ', n_nationkey) AS name")
    return S.registry_faults(companies, known)


@q(
    f"""+r AS (SELECT p_partkey AS slug, CASE p_type WHEN 'ECONOMY' THEN 'grant' WHEN 'PROMO' THEN 'sector' WHEN 'STANDARD' THEN 'research' ELSE 'other' END AS kind, p_size AS updated FROM part)
SELECT slug, kind, CAST(list_position([{', '.join(f"'{k}'" for k in V.REPORT_KINDS)}], kind) AS INT) AS group_place, CAST(row_number() OVER (PARTITION BY kind ORDER BY updated DESC, slug) AS INT) AS place FROM r""".replace("+r", "WITH r", 1)
)
def report_groups(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey AS slug", "CASE p_type WHEN 'ECONOMY' THEN 'grant' WHEN 'PROMO' THEN 'sector' WHEN 'STANDARD' THEN 'research' ELSE p_type END AS kind", "p_size AS updated")
    return S.grouped_reports(rows).select("slug", "kind", "group_place", "place")


@q(f"SELECT id, score, deadline FROM vacancy ORDER BY CASE WHEN deadline >= {AS_OF} THEN date_diff('day', {AS_OF}, deadline) END ASC NULLS LAST, status = 'applied', id LIMIT 300", "vacancy")
def catalogue_by_deadline(spark, sf):
    rows = bound(spark, sf, "vacancy").withColumn("remote", F.col("status") == "applied")
    return S.catalogue_order(rows, "deadline", F.expr(AS_OF)).limit(300).select("id", "score", "deadline")


@q("SELECT company_key, company FROM company WHERE contains(lower(company || ' ' || segment), 'build') ORDER BY rank = 0 DESC, CASE rank WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 4 END, company LIMIT 100", "company")
def companies_by_tier(spark, sf):
    tier = F.when(F.col("rank") == 0, "S").when(F.col("rank") == 1, "A").when(F.col("rank") == 2, "C")
    rows = bound(spark, sf, "company").select("company_key", F.col("company").alias("name"), F.col("segment").alias("category"), (F.col("rank") == 0).alias("hot"), tier.alias("tier"))
    return S.company_table(rows, search="Build", sort="tier", ascending=True).limit(100).select("company_key", F.col("name").alias("company"))


@q("SELECT v.id, v.score, c.company FROM vacancy v JOIN company c ON v.company_id = c.company_key WHERE status <> 'archived' AND score >= 30 AND contains(lower(company), '00001') ORDER BY coalesce(score, 0) DESC, id LIMIT 200", "vacancy", "company")
def list_command(spark, sf):
    rows = S.company_of(bound(spark, sf, "vacancy"), bound(spark, sf, "company")).withColumnsRenamed({"company_name": "org", "first_seen": "created"})
    return S.listed(rows, least=30, org="00001").limit(200).select("id", "score", F.col("org").alias("company"))


@q("SELECT v.id, c.company AS company_name FROM vacancy v LEFT JOIN company c ON v.company_id = c.company_key", "vacancy", "company")
def company_links(spark, sf):
    return S.company_of(bound(spark, sf, "vacancy"), bound(spark, sf, "company")).select("id", "company_name")


@q(
    """+f AS (SELECT DISTINCT p_name AS factor, CASE WHEN min(p_partkey) OVER (PARTITION BY p_name) % 2 = 0 THEN 'strong' ELSE 'weak' END AS strength FROM part)
SELECT strength, count(*) AS n, list(factor ORDER BY factor) AS factors FROM f GROUP BY strength""".replace("+f", "WITH f", 1)
)
def preference_factors(spark, sf):
    lines = table(spark, sf, "part").selectExpr("p_partkey AS at", "concat('- ', CASE WHEN p_partkey % 2 = 0 THEN 'Strong' ELSE 'weak' END, ': ', p_name, ' ') AS text")
    return S.factors_by_strength(S.factors(lines))


@q(
    """SELECT id, CASE WHEN contains(lower(description), lower(org)) THEN 'org' WHEN n = 0 THEN 'neither' WHEN hits >= 0.5 * n THEN 'title' ELSE 'neither' END AS reason FROM (SELECT id, org, description, len(w) AS n, len(list_filter(w, lambda x: contains(lower(description), x))) AS hits
FROM (SELECT id, org, description, list_distinct(list_filter(regexp_split_to_array(lower(title), '[^\\pL\\pN]+'), lambda x: length(x) >= 3 AND x NOT IN ('the', 'and', 'for', 'with'))) AS w FROM posting))""",
    "posting",
)
def role_fit(spark, sf):
    rows = bound(spark, sf, "posting")
    return rows.select("id", connectors.fits_role(F.col("description"), F.col("org"), F.col("title"))["reason"].alias("reason"))
