"""The intake of a batch over the given tables: small parts are what is stored, larger ones what was fetched."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from roleflow.functions import keys as K
from roleflow.operators import intake as I
from roleflow.operators.stages import Run
from roleflow.plans.bindings import AS_OF, Registry
from roleflow.session import cut, ensure_checkpoint_dir, table

REGISTRY = Registry()
q = REGISTRY.add
BARRED = ("hot",)

#: What both engines read alike.
_PART = (
    "p_partkey AS k", "p_brand AS org", "CAST(substring(p_brand, 7) AS BIGINT) AS company_id", "concat(p_name, ' ', p_type) AS title", "p_size AS size",
    "repeat(concat(p_brand, ' ', p_name, ' ', p_type, ' '), 12) AS description", "CASE WHEN p_partkey % 2 = 0 THEN concat('S ', p_partkey) END AS snippet",
    "CASE WHEN p_partkey % 5 = 0 THEN concat('D ', p_partkey % 3) END AS department", "concat('https://e.org/', p_partkey) AS url", "concat('City ', p_partkey % 7) AS city",
)


def _taken_in(spark, sf: str, board: bool) -> I.Intake:
    parts = table(spark, sf, "part").selectExpr(*_PART)
    old = parts.where("size <= 30").groupBy("org", "title").agg(F.min_by(F.struct("k", "company_id", "size", "description", "snippet", "department", "url", "city"), "k").alias("f")).select("org", "title", "f.*")
    status = F.when(F.col("size") % 4 == 0, "archived").when(F.col("size") % 9 == 0, "expiring").when(F.col("size") % 5 == 0, "liked").otherwise("unseen")
    first = F.expr("date_add(date '2001-01-01', cast(size as int))")
    store = old.select(
        F.col("k").alias("id"), "org", "company_id", K.exact_key(F.col("org"), F.col("title")).alias("hash"), "title", "description", "snippet", "department", F.lit(None).cast("date").alias("deadline"), status.alias("status"),
        F.when(status == "archived", "board_stale").alias("status_reason"), F.when(F.col("size") % 3 == 0, 50).alias("score"), first.alias("first_seen"), first.alias("last_seen"),
        F.array(F.struct("url", "city", F.lit(None).cast("string").alias("country"))).alias("places"),
    )
    batch = parts.where("size > 30").select(
        F.col("k").alias("pos"), F.lit("feed").alias("source"), F.col("k").cast("string").alias("external_id"), "org", "company_id", F.when(F.col("size") != 33, F.col("title")).alias("title"), "description", "snippet",
        "department", F.lit(None).cast("date").alias("deadline"), "url", "city", F.lit(None).cast("string").alias("country"),
    )
    stones = parts.where("size = 40").select(K.exact_key(F.col("org"), F.col("title")).alias("key"), F.when(F.col("k") % 2 == 0, "score").otherwise("gone_from_source").alias("reason"), F.date_sub(F.expr(AS_OF), 10).alias("archived_at"))
    return I.take_in(cut(store), batch, cut(stones), F.expr(AS_OF), board=board, words=BARRED)


def _sql(board: bool, body: str) -> str:
    bars = "TRUE" if board else "k % 2 = 0"
    return f"""WITH p AS (SELECT {', '.join(_PART)} FROM part),
st AS (SELECT *, CASE WHEN size % 4 = 0 THEN 'archived' WHEN size % 9 = 0 THEN 'expiring' WHEN size % 5 = 0 THEN 'liked' ELSE 'unseen' END AS status, DATE '2001-01-01' + CAST(size AS INT) AS first_seen
  FROM p WHERE size <= 30 QUALIFY row_number() OVER (PARTITION BY org, title ORDER BY k) = 1),
stone AS (SELECT DISTINCT org, title FROM p WHERE size = 40 AND {bars}),
bt AS (SELECT p.*, CASE WHEN size = 33 THEN 'empty_title' WHEN regexp_matches(title, '\\bhot\\b') THEN 'blacklist' END AS skip, (org, title) IN (SELECT (org, title) FROM stone) AS barred FROM p WHERE size > 30),
live AS (SELECT bt.*, st.k AS match FROM bt LEFT JOIN st USING (org, title) WHERE skip IS NULL AND NOT barred),
place AS (SELECT org, title, city, url, 1 AS fresh, k FROM live UNION ALL SELECT st.org, st.title, st.city, st.url, 0, st.k FROM st WHERE k IN (SELECT match FROM live)),
listed AS (SELECT org, title, string_agg(url || ' ' || city, '; ' ORDER BY url) AS places FROM (SELECT * FROM place QUALIFY row_number() OVER (PARTITION BY org, title, city ORDER BY fresh DESC, k DESC) = 1) GROUP BY org, title),
fact AS (SELECT org, title, any_value(match) AS match, arg_min(snippet, k) FILTER (WHERE snippet IS NOT NULL) AS sn, arg_min(department, k) FILTER (WHERE department IS NOT NULL) AS dp FROM live GROUP BY org, title)
{body}"""


_ROWS = f"""SELECT st.org, st.title, CASE WHEN f.match IS NOT NULL AND status IN ('archived', 'expiring') THEN 'unseen' ELSE status END AS status, CASE WHEN f.match IS NULL AND status = 'archived' THEN 'board_stale' END AS status_reason,
  CASE WHEN f.match IS NULL THEN snippet ELSE coalesce(snippet, sn) END AS snippet, CASE WHEN f.match IS NULL THEN department ELSE coalesce(department, dp) END AS department, first_seen,
  CASE WHEN f.match IS NOT NULL OR (st.org, st.title) IN (SELECT (org, title) FROM bt WHERE skip = 'blacklist') THEN {AS_OF} ELSE first_seen END AS last_seen, coalesce(l.places, url || ' ' || city) AS places
FROM st LEFT JOIN fact f ON f.match = st.k LEFT JOIN listed l ON l.org = st.org AND l.title = st.title
UNION ALL SELECT f.org, f.title, 'unseen', NULL, sn, dp, {AS_OF}, {AS_OF}, places FROM fact f JOIN listed l ON l.org = f.org AND l.title = f.title WHERE match IS NULL"""


def _shown(rows):
    places = F.array_join(F.array_sort(F.transform("places", lambda p: F.concat_ws(" ", p["url"], p["city"]))), "; ")
    return rows.select("org", "title", "status", "status_reason", "snippet", "department", "first_seen", "last_seen", places.alias("places"))


@q(_sql(False, _ROWS))
def intake_rows(spark, sf):
    return _shown(_taken_in(spark, sf, board=False).rows)


@q(_sql(True, _ROWS))
def board_intake_rows(spark, sf):
    """As a run of stages: a killed one goes on behind the last committed stage."""
    run = Run(spark, f"{ensure_checkpoint_dir(spark)}/runs", uuid.uuid4().hex)
    rows = run.stage("intake", lambda: _taken_in(spark, sf, board=True).rows)
    return run.stage("shown", lambda: _shown(rows))


@q(
    _sql(
        False,
        """SELECT k AS pos, CASE WHEN bt.skip IS NOT NULL THEN 'invalid' WHEN barred THEN 'archived' WHEN live.match IS NOT NULL THEN 'existing' ELSE 'new' END AS outcome, bt.skip AS reason, live.match AS id
FROM bt LEFT JOIN (SELECT k, match FROM live) live USING (k)""",
    )
)
def intake_outcomes(spark, sf):
    found = _taken_in(spark, sf, board=False).outcomes
    return found.select("pos", "outcome", "reason", F.when(F.col("outcome") == "existing", F.col("id")).alias("id"))
