"""Queries of text quality, keys, pages and resolution, each with its check in SQL where SQL has the functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from roleflow import vocabulary as V
from roleflow.functions import keys as K
from roleflow.functions import text as T
from roleflow.operators import resolve as R
from roleflow.operators import rollups as G
from roleflow.operators import screening as S
from roleflow.plans.bindings import AS_OF, VIEWS, Registry, bound
from roleflow.session import table
from roleflow.sources import connectors as C

REGISTRY = Registry()
q = REGISTRY.add
WORDS, STEMS = ("idiot", "stupid", "worthless"), ("pathetic",)


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _count(text: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, '(?i){_quoted(pattern)}')) AS INT)"


def _html(column: str) -> str:
    """html_to_text in SQL."""
    t = f"coalesce({column}, '')"
    for pattern, to in ((r"(?is)<script\b.*?</script\s*>", " "), (r"(?is)<style\b.*?</style\s*>", " "), (r"(?i)<\s*/?\s*(?:br|p|div|h[1-6]|ul|ol)(?:\s[^>]*)?\s*/?\s*>", "\n"), (r"(?i)<\s*li\b[^>]*>", "\n- "), (r"<[^>]+>", " ")):
        t = f"regexp_replace({t}, '{pattern}', '{to}', 'g')"
    for entity, sign in T.ENTITIES.items():
        t = f"replace({t}, '{entity}', '{_quoted(sign)}')"
    for pattern, to in (("[ \\t]+", " "), (" ?\\n ?", "\n"), ("\\n{3,}", "\n\n"), ("^\\s+|\\s+$", "")):
        t = f"regexp_replace({t}, '{pattern}', '{to}', 'g')"
    return t


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def _junk(t: str) -> dict[str, str]:
    """The page tests in SQL over the text ``t``."""
    posting = f"regexp_matches({t}, '(?i){_quoted(T.POSTING)}')"
    labels = f"len(list_distinct(list_transform(regexp_extract_all({t}, '(?i){_quoted(T.NAVIGATION)}'), lambda x: lower(x))))"
    marketing = " + ".join(f"regexp_matches({t}, '(?i){_quoted(m)}')::INT" for m in T.MARKETING)
    return {
        "error_page": f"length({t}) <= {T.ERROR_MOST} AND regexp_matches({t}[:{T.ERROR_HEAD}], '(?i){_quoted(T.ERROR_PAGE)}')",
        "navigation": f"CASE WHEN length({t}) <= {T.NAVIGATION_MOST} THEN {_count(t, T.NAVIGATION)} >= {T.NAVIGATION_SHORT} ELSE {labels} >= {T.NAVIGATION_LONG} AND NOT {posting} END",
        "script": f"{_count(t, T.SCRIPT)} >= {T.SCRIPT_LEAST}",
        "marketing": f"({marketing}) >= 2 AND {_count(t, T.POSTING)} <= 1",
    }


@q(f"SELECT id, {_count('description', T.NAVIGATION)} AS navigation, {_count('description', T.POSTING)} AS posting, {_count('description', T.COOKIE_WORD)} AS consent, {_count('description', T.SCRIPT)} AS script FROM posting", "posting")
def marker_counts(spark, sf):
    d = F.col("description")
    return bound(spark, sf, "posting").select("id", T.count_of(d, T.NAVIGATION).alias("navigation"), T.count_of(d, T.POSTING).alias("posting"), T.count_of(d, T.COOKIE_WORD).alias("consent"), T.count_of(d, T.SCRIPT).alias("script"))


@q(f"WITH p AS (SELECT page_id, {_html('html')} AS t FROM pages) SELECT page_id, {', '.join(f'{v} AS {k}' for k, v in _junk('t').items())} FROM p")
def page_junk_flags(spark, sf):
    t = F.col("t")
    pages = table(spark, sf, "pages").select("page_id", T.html_to_text(F.col("html")).alias("t"))
    return pages.select("page_id", T.is_error_page(t).alias("error_page"), T.is_navigation_junk(t).alias("navigation"), T.is_script_junk(t).alias("script"), T.is_marketing_page(t).alias("marketing"))


@q(f"SELECT page_id, CAST(length(regexp_replace({_html('html')}, '\\s+', ' ', 'g')) AS INT) AS n FROM pages")
def html_strip_length(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.length(T.html_to_line(F.col("html"))).alias("n"))


@q(
    """+m AS (SELECT id, CASE WHEN contains(lower(title), 'pathetic') THEN 'pathetic' ELSE nullif(regexp_extract(lower(title), '(?i)(?:\\bworthless(?:es|s)?\\b|\\bstupid(?:es|s)?\\b|\\bidiot(?:es|s)?\\b)', 0), '') END AS term FROM posting)
SELECT term, count(*) AS n FROM m GROUP BY term""",
    "posting",
)
def title_blacklist(spark, sf):
    term = T.blacklist_term(F.col("title"), WORDS, STEMS)
    return bound(spark, sf, "posting").groupBy(term.alias("term")).agg(F.count(F.lit(1)).alias("n"))


@q(
    """+j AS (SELECT id, CASE WHEN coalesce(description, '') = '' THEN NULL WHEN contains(lower(description[:500]), 'recaptcha') AND length(description) < 300 THEN 'recaptcha_only'
WHEN contains(lower(description[:500]), 'every.org') OR contains(lower(description[:500]), 'donate to a fund') OR contains(lower(description[:500]), 'make a donation') THEN 'donation_widget'
WHEN regexp_matches(lower(description[:500]), '404 not found|page not found|error 404|access denied|cannot be displayed') THEN 'error_page'
WHEN length(regexp_replace(description, '^\\s+|\\s+$', '', 'g')) < 50 THEN 'navigation_snippet' END AS reason FROM posting)
SELECT reason, count(*) AS n FROM j GROUP BY reason""",
    "posting",
)
def content_junk_reasons(spark, sf):
    return bound(spark, sf, "posting").groupBy(T.content_junk_reason(F.col("description")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@q(
    f"""SELECT count(*) FILTER (WHERE regexp_matches(title, '(?i){_quoted(T.OFFERING)}')) AS offering, count(*) FILTER (WHERE regexp_matches(title, '(?i){_quoted(T.ROLE_NOUN)}')) AS role,
count(*) FILTER (WHERE regexp_matches(title, '(?i){_quoted(T.TEST_POSTING)}')) AS test FROM posting""",
    "posting",
)
def not_a_vacancy_signals(spark, sf):
    t = F.col("title")
    return bound(spark, sf, "posting").agg(*[F.count_if(t.rlike(f"(?i){p}")).alias(k) for k, p in (("offering", T.OFFERING), ("role", T.ROLE_NOUN), ("test", T.TEST_POSTING))])


#: Titles, some of which name an offer or a test; both engines read them alike.
_TITLE = "CASE length(description) % 5 WHEN 0 THEN 'Impact Accelerator Program' WHEN 1 THEN 'Program Manager' WHEN 2 THEN 'TEST JOB - do not apply' WHEN 3 THEN '  ' ELSE title END"
_BODY = "CASE WHEN lang = 'fr' THEN concat('Requirements. How to apply. ', description) ELSE description END"


@q(
    f"""+t AS (SELECT trim({_TITLE}) AS t, {_BODY} AS d FROM posting), r AS (SELECT CASE WHEN t = '' THEN NULL WHEN regexp_matches(t, '(?i){_quoted(T.TEST_POSTING)}') THEN 'test posting, not a real job'
WHEN regexp_matches(t, '(?i){_quoted(T.OFFERING)}') AND NOT regexp_matches(t, '(?i){_quoted(T.ROLE_NOUN)}') AND {_count('d', T.POSTING)} <= 1 THEN 'a program or grant to apply to, not a job' END AS reason FROM t)
SELECT reason, count(*) AS n FROM r GROUP BY reason""",
    "posting",
)
def not_a_vacancy_reasons(spark, sf):
    reason = T.not_a_vacancy_reason(F.expr(_TITLE), F.expr(_BODY))
    return bound(spark, sf, "posting").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


#: Descriptions with what a fetched page adds to them, by the length of the text; both engines read it alike.
_SHOWN = """CASE length(description) % 9
WHEN 0 THEN concat('We use cookies. ', repeat('cookie policy and consent text here ', 40), description) WHEN 1 THEN concat('<p>', description, '</p><ul><li>one</li></ul>')
WHEN 2 THEN concat('home about us contact us menu login careers ', substring(description, 1, 100)) WHEN 3 THEN concat('404 not found ', substring(description, 1, 200))
WHEN 4 THEN concat(description, ' jQuery( jQuery( jQuery(') WHEN 5 THEN concat('Featured insights. Latest news. ', description) WHEN 6 THEN substring(description, 1, 60)
WHEN 7 THEN concat(description, ' This site uses cookies to improve.') ELSE description END"""


def _verdicts() -> str:
    """clean_description in SQL: ``id, org, t, bare, verdict`` of the shown descriptions."""
    banner, word, j = f"(?i)(?:{_quoted(T.COOKIE_BANNER)})", f"(?i)(?:{T.COOKIE_WORD})", _junk("t")
    return f"""+s0 AS (SELECT id, org, {_SHOWN} AS d FROM posting),
s1 AS (SELECT id, org, CASE WHEN regexp_matches(d, '(?i)<\\s*/?\\s*(?:br|p|div|li|ul|ol|h[1-6]|span|strong|em|b|i)\\b[^>]*>') THEN {_html('d')} ELSE {_strip('d')} END AS t FROM s0),
s2 AS (SELECT *, regexp_matches(t[:{T.COOKIE_HEAD}], '{banner}') AS has, length(regexp_extract(t[:{T.COOKIE_HEAD}], '(?s)^(.*?){banner}', 1)) AS opening, length(regexp_extract(t[:{T.COOKIE_HEAD}], '{banner}')) AS n,
  list_transform(regexp_split_to_array(t, '{word}'), lambda x: length(x)) AS gaps, list_transform(regexp_extract_all(t, '{word}'), lambda x: length(x)) AS ws FROM s1),
s3 AS (SELECT *, opening + n AS first, list_transform(range(1, len(ws) + 1), lambda i: struct_pack(b := CAST(list_sum(gaps[:i]) + coalesce(list_sum(ws[:i - 1]), 0) AS BIGINT), e := CAST(list_sum(gaps[:i]) + list_sum(ws[:i]) AS BIGINT))) AS places FROM s2),
s4 AS (SELECT *, list_transform(list_filter(places, lambda x: x.b >= first), lambda x: x.e) AS ends FROM s3),
s5 AS (SELECT *, list_concat([first], ends) AS stops, list_min(list_filter(range(1, len(ends) + 1), lambda i: ends[i] - list_concat([first], ends)[i] > {T.COOKIE_GAP})) AS gap FROM s4),
s6 AS (SELECT *, CASE WHEN has AND length({_strip('substring(t, 1, opening)')}) < {T.COOKIE_REST} THEN CASE WHEN gap IS NULL THEN stops[len(stops)] ELSE stops[gap] END END AS stop FROM s5),
s7 AS (SELECT *, instr(substring(t, stop + 1, 301), chr(10) || chr(10)) AS pa, instr(substring(t, stop + 1, 301), chr(10)) AS li FROM s6),
s8 AS (SELECT *, CASE WHEN pa BETWEEN 1 AND 300 THEN stop + pa - 1 WHEN li BETWEEN 1 AND 300 THEN stop + li - 1 ELSE stop END AS upto FROM s7),
s9 AS (SELECT *, CASE WHEN upto IS NOT NULL THEN {_strip('substring(t, upto + 1)')} WHEN regexp_matches(t, '{banner}') THEN regexp_replace(regexp_extract(t, '(?s)^(.*?){banner}', 1), '\\s+$', '') ELSE t END AS bare FROM s8),
v AS (SELECT *, CASE WHEN t = '' THEN 'empty' WHEN upto IS NOT NULL AND length(bare) < {T.COOKIE_REST} THEN 'cookie_wall' WHEN {j['error_page']} THEN 'error_page' WHEN ({j['navigation']}) OR {j['script']} THEN 'nav_junk'
  WHEN {j['marketing']} THEN 'marketing_page' WHEN length(bare) < {T.DESCRIPTION_LEAST} THEN 'too_short' ELSE 'ok' END AS verdict FROM s9)"""


def _cleaned(spark, sf):
    return bound(spark, sf, "posting").select("id", "org", T.clean_description(F.expr(_SHOWN)).alias("c")).select("id", "org", F.col("c.text").alias("bare"), "c.verdict")


@q(f"{_verdicts()} SELECT verdict, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS share, CAST(sum(CASE WHEN verdict = 'ok' THEN length(bare) END) AS BIGINT) AS chars FROM v GROUP BY verdict", "posting")
def description_verdicts(spark, sf):
    """Histogram of the quality verdict with its share, over all descriptions."""
    return G.verdict_histogram(_cleaned(spark, sf))


@q(f"{_verdicts()} SELECT id, org, verdict FROM v WHERE verdict <> 'ok' ORDER BY verdict, org, id LIMIT 10", "posting")
def description_worst(spark, sf):
    return G.worst_descriptions(_cleaned(spark, sf), 10)


@q(
    """+b AS (SELECT org, substring(md5(trim(regexp_replace(regexp_replace(lower(regexp_replace(description, '<[^>]+>', ' ', 'g')), '[^\\pL\\pN\\pM_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))), 1, 16) AS key,
length(trim(regexp_replace(regexp_replace(lower(regexp_replace(description, '<[^>]+>', ' ', 'g')), '[^\\pL\\pN\\pM_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS n FROM posting)
SELECT key, count(*) AS n, count(DISTINCT org) AS orgs FROM b WHERE n >= 1000 GROUP BY key HAVING count(*) > 1""",
    "posting",
)
def description_fingerprint_groups(spark, sf):
    keyed = bound(spark, sf, "posting").select("org", K.body_fingerprint(F.col("description")).alias("key")).where("key is not null")
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("org").alias("orgs")).where("n > 1")


@q(
    r"""+u AS (SELECT page_id, regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$', ['s', 'h', 'p', 'q']) AS x FROM pages),
k AS (SELECT page_id, x, array_to_string(list_filter(str_split(regexp_replace(x.q, '(?i)utm_[a-z]+=[^&]*', '', 'g'), '&'), lambda p: p <> '' AND lower(str_split(p, '=')[1]) NOT IN ('ref', 'src', 'source', 'fbclid', 'gclid', 'mc_cid', 'mc_eid', 'gh_src') AND NOT starts_with(lower(p), 'utm_')), '&') AS t FROM u)
SELECT page_id, concat(lower(x.s), '://', lower(x.h), regexp_replace(x.p, '/+$', ''), CASE WHEN t <> '' THEN '?' || t ELSE '' END) AS url FROM k""".replace("+u", "WITH u", 1)
)
def url_tracking_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", K.apply_url(F.col("url")).alias("url"))


@q(
    """SELECT key, count(*) AS n FROM (SELECT substring(md5(lower(org || '|' || array_to_string(list_transform(str_split(lower(title), ' '), lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is)$') THEN w[: length(w) - 1] ELSE w END), ' '))), 1, 16) AS key FROM role) GROUP BY key""",
    "role",
)
def normalized_title_keys(spark, sf):
    return bound(spark, sf, "role").groupBy(K.normalized_key(F.col("org"), F.col("title")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@q("SELECT substring(md5(lower(org || '|' || title)), 1, 16) AS key, min(id) AS first_id, count(*) AS n FROM role GROUP BY 1", "role")
def exact_title_keys(spark, sf):
    return bound(spark, sf, "role").groupBy(K.exact_key(F.col("org"), F.col("title")).alias("key")).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))


@q("""SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?i)href=["'']([^"''#\\s]+)["'']', 1)) AS link FROM pages""")
def page_links(spark, sf):
    return C.links_of(table(spark, sf, "pages"))


#: Pages, some of which carry structured data and some no container; both engines read them alike.
_PAGE = """CASE length(html) % 3 WHEN 0 THEN concat('<script type="application/ld+json">{"@type": "JobPosting", "description": "<p>Posting ', page_id, '</p><p>of a page</p>"}</script>', html)
WHEN 1 THEN replace(replace(html, '<article', '<section'), '</article', '</section') ELSE html END"""


@q(
    f"""WITH p AS (SELECT page_id, length(html) % 3 AS k, {_PAGE} AS html FROM pages), b AS (SELECT CASE WHEN k = 0 THEN 'json-ld' WHEN k = 1 THEN 'page' ELSE 'container' END AS how, CASE WHEN k = 0 THEN concat('<p>Posting ', page_id, '</p><p>of a page</p>')
WHEN k = 1 THEN html ELSE regexp_extract(html, '(?is)<(?:article|main)\\b[^>]*>(.*?)</(?:article|main)>', 1) END AS body FROM p) SELECT how, count(*) AS n, CAST(sum(length({_html('body')})) AS BIGINT) AS chars FROM b GROUP BY how"""
)
def page_descriptions(spark, sf):
    found = C.posting_pages(table(spark, sf, "pages").select("url", F.expr(_PAGE).alias("html")))
    return found.groupBy("how").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("description")).alias("chars"))


@q(
    """WITH RECURSIVE h AS (SELECT doc_id AS id, lang, unnest([md5(text), concat('c', n_chars)]) AS k FROM documents),
e AS (SELECT min(id) OVER (PARTITION BY lang, k) AS a, id AS b FROM h), u AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a) SELECT a AS id, min(b) AS cluster FROM r GROUP BY a"""
)
def connected_components(spark, sf):
    keys = F.explode(F.array(F.md5("text"), F.concat(F.lit("c"), F.col("n_chars").cast("string"))))
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("company_id"), keys.alias("key"))
    return R.clusters(rows, ["id"])


@q(
    """SELECT DISTINCT min(id) OVER (PARTITION BY org, title) AS src, id AS dst FROM role QUALIFY min(id) OVER (PARTITION BY org, title) <> id""",
    "role",
)
def hub_edges(spark, sf):
    rows = bound(spark, sf, "role").selectExpr("id", "org AS company_id", "title AS key")
    return R.hub_edges(rows, ["id"])


#: The measure by recursion: the longest common block of two stretches, then of what is left on either side of it.
_ALIKE = r"""WITH RECURSIVE role AS (SELECT {role} FROM part),
kind AS (SELECT org, t, min(id) AS id FROM (SELECT org, id, trim(regexp_replace(regexp_replace(lower({title}), '[^\w\s]', '', 'g'), '\s+', ' ', 'g')) AS t FROM role) WHERE t <> '' GROUP BY org, t),
gram AS (SELECT id, g, row_number() OVER (PARTITION BY id, g) AS k FROM (SELECT id, unnest(list_transform(range(1, length(t) + 1), lambda i: t[i:i])) AS g FROM kind)),
near AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM gram a JOIN gram b ON a.g = b.g AND a.k = b.k AND a.id < b.id GROUP BY a.id, b.id),
pair AS (
  SELECT a.org, a.id AS left_id, b.id AS right_id, a.t AS x, b.t AS y FROM near JOIN kind a ON a.id = near.a JOIN kind b ON b.id = near.b
  WHERE a.org = b.org AND 2.0 * common >= 0.85 * (length(a.t) + length(b.t))),
piece AS (
  SELECT org, left_id, right_id, x, y, {best} AS m FROM pair
  UNION ALL
  SELECT org, left_id, right_id, u.x, u.y, {inner} AS m
  FROM (SELECT org, left_id, right_id, unnest([{{'x': x[:m.i - 1], 'y': y[:m.j - 1]}}, {{'x': x[m.i + m.k:], 'y': y[m.j + m.k:]}}]) AS u FROM piece WHERE m.k > 0) s WHERE u.x <> '' AND u.y <> ''),
rated AS (SELECT org, left_id, right_id, sum(m.k) AS m FROM piece GROUP BY org, left_id, right_id)
SELECT org, left_id, right_id, false AS same, round(2.0 * m / (length(x) + length(y)), 4) AS ratio
FROM rated JOIN pair USING (org, left_id, right_id) WHERE 2.0 * m / (length(x) + length(y)) >= 0.85"""


def _alike(title: str) -> str:
    def block(x: str, y: str) -> str:
        places = f"flatten(list_transform(range(least(length({x}), length({y})), 0, -1), lambda k: list_transform(range(1, length({x}) - k + 2), lambda i: {{'k': k, 'i': i, 'j': strpos({y}, {x}[i:i + k - 1])}})))"
        return f"coalesce(list_filter({places}, lambda c: c.j > 0)[1], {{'k': 0, 'i': 0, 'j': 0}})"

    return _ALIKE.format(role=", ".join(VIEWS["role"][1]), title=title, best=block("x", "y"), inner=block("u.x", "u.y"))


def _plain(title):
    """A title in lower case without punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))


@q(_alike("title"))
def title_similarity_pairs(spark, sf):
    """Pairs of an employer's titles; each text stands for the rows that have it, so none is the same as another."""
    t = _plain(F.col("title"))
    return R.title_pairs(bound(spark, sf, "role"), compared=t, same=t)


@q(_alike("title || ' ' || kind"))
def look_alike_titles(spark, sf):
    t = _plain(F.concat_ws(" ", "title", "kind"))
    return R.title_pairs(bound(spark, sf, "role"), compared=t, same=t)


@q(
    f"""SELECT count(*) FILTER (WHERE coalesce(score >= 60, false) AND status NOT IN ({', '.join(f"'{s}'" for s in V.CLOSED)}) AND NOT coalesce(deadline < {AS_OF}, false)) AS applyable,
count(*) FILTER (WHERE status IN ('liked','to_apply','to_research','to_network','applied','test_task','interview','declined','accepted') OR coalesce(score >= 40, false)) AS dashboard,
count(*) FILTER (WHERE coalesce(score >= 50, false) AND date_diff('day', first_seen, {AS_OF}) <= 400 AND coalesce(deadline >= {AS_OF}, true)) AS facets FROM vacancy""",
    "vacancy",
)
def facet_filter(spark, sf):
    v, day = bound(spark, sf, "vacancy"), F.expr(AS_OF)
    return v.agg(
        F.count_if(S.applyable(F.col("score"), F.col("status"), F.col("deadline"), day)).alias("applyable"),
        F.count_if(S.on_dashboard(F.col("score"), F.col("status"))).alias("dashboard"),
        F.count_if(S.facets(least=50, max_age=400, deadline="open", as_of=day)).alias("facets"),
    )


@q(
    f"""SELECT id, CAST(date_diff('day', first_seen, {AS_OF}) AS INT) AS age, coalesce(deadline < {AS_OF}, false) AS expired, date_diff('day', last_seen, {AS_OF}) >= 14 AS stale,
coalesce(deadline < {AS_OF}, false) OR date_diff('day', last_seen, {AS_OF}) >= 14 AS gone FROM vacancy""",
    "vacancy",
)
def date_facts(spark, sf):
    v = bound(spark, sf, "vacancy")
    return v.select("id", S.date_facts(F.col("first_seen"), F.col("last_seen"), F.col("deadline"), F.expr(AS_OF)).alias("f")).select("id", "f.*")
