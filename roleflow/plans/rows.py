"""Queries of rules that judge one row, each with the rule itself in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from roleflow.functions import keys as K
from roleflow.functions import text as T
from roleflow.functions import values as D
from roleflow.plans.bindings import Registry, bound, sql
from roleflow.plans.texts import _SHOWN, STEMS, WORDS, _strip, _verdicts

REGISTRY = Registry()
q = REGISTRY.add

# Both engines read these alike.
_TITLED = "CASE WHEN id % 7 = 0 THEN '  ' WHEN id % 11 = 0 THEN concat(substring(title, 1, 30), ' stupid idea') ELSE title END"
_SNIPPET, _URL = "CASE WHEN id % 3 = 0 THEN repeat('s ', 40) ELSE ' s ' END", "CASE WHEN id % 5 = 0 THEN 'u' ELSE ' ' END"
_FROM = "CASE WHEN id % 4 = 0 THEN 'summary' WHEN id % 4 = 1 THEN 'feed' END"
_BARRED = f"(contains(lower({_TITLED}), '{STEMS[0]}') OR regexp_matches(lower({_TITLED}), '\\b(?:{'|'.join(WORDS)})(?:es|s)?\\b'))"
_LENGTH = f"length({_strip('description')})"


@q(
    f"""SELECT id, contains(lower(description), 'th th') OR contains(lower(description), ' de la ') AS phrases, {_LENGTH} >= 50 OR length({_strip(_SNIPPET)}) >= 50 OR {_strip(_URL)} <> '' AS enough,
  id % 2 = 0 AND (coalesce({_FROM}, '') = 'summary' OR length(description) < 400) AS summary_only FROM posting""",
    "posting",
)
def content_rules(spark, sf):
    d = F.col("description")
    return bound(spark, sf, "posting").select(
        "id", T.contains_any(d, ("th th", " de la ")).alias("phrases"), T.has_enough_content(d, F.expr(_SNIPPET), F.expr(_URL)).alias("enough"), T.is_unjudgeable_board_text(d, F.expr(_FROM), F.col("id") % 2 == 0).alias("summary_only")
    )


@q(
    f"""+j AS (SELECT id, {_BARRED} AS barred, CASE WHEN coalesce(description, '') = '' THEN NULL WHEN contains(lower(description[:500]), 'recaptcha') AND length(description) < 300 THEN 'recaptcha_only'
WHEN regexp_matches(lower(description[:500]), 'every\\.org|donate to a fund|make a donation|404 not found|page not found|error 404|access denied|cannot be displayed') THEN 'page' WHEN {_LENGTH} < 50 THEN 'short' END AS junk, {_LENGTH} = 0 AS bare FROM posting)
SELECT id, CASE WHEN barred THEN 'wrong_role' WHEN junk IS NOT NULL THEN 'not_a_job' WHEN bare THEN 'no_description' ELSE 'ready' END AS quality FROM j""",
    "posting",
)
def row_qualities(spark, sf):
    return bound(spark, sf, "posting").select("id", T.classify_quality(F.expr(_TITLED), F.col("description"), WORDS, STEMS).alias("quality"))


REGISTRY.sql["gate_reasons"] = sql(
    f"""{_verdicts()}, w AS (SELECT v.id, {_SHOWN.replace('description', 'p.description')} AS d, verdict IN ('cookie_wall', 'error_page', 'nav_junk', 'marketing_page') AS junk, p.title FROM v JOIN posting p USING (id)),
u AS (SELECT id, title, junk, length(CASE WHEN junk THEN '' ELSE {_strip('d')} END) >= 50 OR length({_strip(_SNIPPET)}) >= 50 OR {_strip(_URL)} <> '' AS usable FROM w)
SELECT id, CASE WHEN {_strip(_TITLED)} = '' THEN 'empty_title' WHEN {_BARRED} THEN 'blacklist' WHEN junk AND NOT usable THEN 'junk' WHEN NOT usable THEN 'thin' END AS reason FROM u""",
    "posting",
)


@q()
def gate_reasons(spark, sf):
    reason = T.gate_reason(F.expr(_TITLED), F.expr(_SHOWN), F.expr(_SNIPPET), F.expr(_URL), WORDS, STEMS)
    return bound(spark, sf, "posting").select("id", reason.alias("reason"))


@q(
    """SELECT id, regexp_replace(regexp_replace(lower(concat(' ', org, ' & ', title, '!')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  lower(org) || '::' || lower(title) || '::' || CASE WHEN id % 3 = 0 THEN '' ELSE 'bonn|paris' END || '::' || CASE WHEN id % 2 = 0 THEN '2001-02-03' ELSE '' END AS triage FROM role""",
    "role",
)
def row_keys(spark, sf):
    places = F.when(F.col("id") % 3 > 0, F.array(F.lit("Paris"), F.lit("Bonn")))
    day = F.when(F.col("id") % 2 == 0, F.lit("2001-02-03").cast("date"))
    return bound(spark, sf, "role").select("id", K.slug(F.concat(F.lit(" "), "org", F.lit(" & "), "title", F.lit("!"))).alias("slug"), K.triage_key(F.col("org"), F.col("title"), places, day).alias("triage"))


@q("SELECT id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(floor((epoch_us(TIMESTAMP '2024-02-10 12:00:00') // 1000000 - epoch_us(ts) // 1000000) / 86400) AS BIGINT) AS days FROM seen", "seen")
def row_times(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return bound(spark, sf, "seen").select("id", K.iso(F.col("ts")).alias("iso"), D.days_since(ts, F.expr("timestamp '2024-02-10 12:00:00'")).alias("days"))


_PAY = """CASE id % 5 WHEN 0 THEN concat('We offer a salary of $', CAST(40000 + id % 50000 AS STRING), ' to $', CAST(90000 + id % 1000 AS STRING), ' a year.') WHEN 1 THEN concat('Pay range: €', CAST(2 + id % 7 AS STRING), 'k')
WHEN 2 THEN concat('Compensation from the budget of $', CAST(50000 + id AS STRING)) WHEN 3 THEN concat('Stipend: GBP ', CAST(1000 + id % 9000 AS STRING)) ELSE concat('Raised $', CAST(40000 + id AS STRING)) END"""


@q(
    """+n AS (SELECT id, CASE id % 5 WHEN 0 THEN [round((40000 + id % 50000) / 12.0::DOUBLE), round((90000 + id % 1000) / 12.0::DOUBLE)] WHEN 1 THEN [(2 + id % 7) * 1000.0::DOUBLE] WHEN 3 THEN [CAST(1000 + id % 9000 AS DOUBLE)] END AS x FROM role)
SELECT id, list_min(x) AS low, list_max(x) AS high FROM n""",
    "role",
)
def monthly_figures(spark, sf):
    return bound(spark, sf, "role").select("id", D.pay(F.expr(_PAY)).alias("p")).select("id", "p.low", "p.high")
