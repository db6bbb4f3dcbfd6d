"""The keys, dates and classes of this library as functions of a session's SQL, for queries that are written as text.

They are SQL functions: their bodies become part of the query, so what they compute is pushed down and compiled with it. What a result
depends on in time is a parameter (``as_of``).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from roleflow import vocabulary as V
from roleflow.functions import keys as K
from roleflow.functions import text as T
from roleflow.sources import pages


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spaced(text: str) -> str:
    return f"trim(regexp_replace(coalesce({text}, ''), {_quoted(r'\s+')}, ' '))"


def _requisition(url: str) -> str:
    one = lambda p: f"regexp_extract(coalesce({url}, ''), {_quoted(p)}, 1)"
    return "coalesce(" + ", ".join(f"CASE WHEN {one(p)} <> '' THEN concat({_quoted(v + ':')}, lower({one(p)})) END" for v, p in K.REQUISITIONS) + ")"


def _tier(alignment: str, score: str) -> str:
    blend = f"bround({alignment} * {V.TIER_BLEND[0]}D + {score} * {V.TIER_BLEND[1]}D, 0)"
    return f"CASE WHEN {blend} IS NULL THEN NULL " + " ".join(f"WHEN {blend} >= {least} THEN '{letter}'" for letter, least in V.TIERS) + " ELSE 'C' END"


#: Name: parameters, type of the result, body.
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "bare_title": ("title STRING", "STRING", _spaced(f"regexp_replace(coalesce(title, ''), {_quoted(K.MODE_SUFFIX)}, '')")),
    "exact_key": ("org STRING, title STRING", "STRING", "substring(md5(lower(concat_ws('|', org, bare_title(title)))), 1, 16)"),
    "requisition_key": ("url STRING", "STRING", _requisition("url")),
    "company_tier": ("alignment DOUBLE, score DOUBLE", "STRING", _tier("alignment", "score")),
    "days_since": ("day DATE, as_of DATE", "INT", "datediff(as_of, day)"),
    "is_expired": ("deadline DATE, as_of DATE", "BOOLEAN", "coalesce(deadline < as_of, false)"),
    "is_stale": ("last_seen DATE, as_of DATE", "BOOLEAN", f"datediff(as_of, last_seen) >= {V.STALE_DAYS}"),
    "is_gone": ("deadline DATE, last_seen DATE, as_of DATE", "BOOLEAN", "is_expired(deadline, as_of) OR is_stale(last_seen, as_of)"),
    "is_closed": ("status STRING", "BOOLEAN", f"status IN ({', '.join(_quoted(s) for s in V.CLOSED)})"),
    "is_test_posting": ("title STRING", "BOOLEAN", f"coalesce(title, '') RLIKE {_quoted('(?i)' + T.TEST_POSTING)}"),
}


def register(spark: SparkSession) -> None:
    """All of :data:`FUNCTIONS`, and the table function ``job_cards(html, base_url)``, for this session."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    pages.register(spark)
