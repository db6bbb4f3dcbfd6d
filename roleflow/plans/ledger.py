"""Queries of source runs, screening lists, non-employers and the exceptions of a review, each with its check in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from roleflow.operators import ledger as L
from roleflow.operators import resolve as R
from roleflow.plans.bindings import AS_OF, Registry, bound
from roleflow.plans.identity import _KEYS
from roleflow.session import cut, ensure_checkpoint_dir, table

REGISTRY = Registry()
q = REGISTRY.add

#: Sightings as observations of daily runs; both engines read them alike.
_OBSERVED = (
    "CAST(day AS STRING) AS run_id", "source AS source_key", "id % 40 AS external_id", "id AS seq",
    "CASE status WHEN 'view' THEN 'new' WHEN 'click' THEN 'existing' WHEN 'purchase' THEN 'archived' ELSE 'invalid' END AS outcome", "CASE status WHEN 'signup' THEN 'junk' WHEN 'error' THEN 'thin' END AS reason",
)


@q(
    f"""+o AS (SELECT {', '.join(_OBSERVED).replace('AS STRING', 'AS VARCHAR')} FROM seen)
SELECT run_id, source_key, external_id, arg_max(seq, seq) AS seq, arg_max(outcome, seq) AS outcome, arg_max(reason, seq) FILTER (WHERE reason IS NOT NULL) AS reason FROM o GROUP BY ALL""",
    "seen",
)
def observation_ledger(spark, sf):
    """Two batches, of which the second is recorded twice."""
    rows = bound(spark, sf, "seen").selectExpr(*_OBSERVED)
    early, late = rows.where("seq < 4000"), rows.where("seq >= 4000")
    ledger = rows.where("false")
    for batch in (early, late, late):
        ledger = cut(L.record(ledger, batch, L.OBSERVATION, "seq"))
    return ledger


@q(
    f"""+o AS (SELECT {', '.join(_OBSERVED).replace('AS STRING', 'AS VARCHAR')} FROM seen),
f AS (SELECT run_id, source_key, min(concat('http_', 500 + seq % 3)) AS failure FROM o WHERE seq % 97 = 0 GROUP BY ALL),
s AS (SELECT run_id, source_key, count(DISTINCT external_id) FILTER (WHERE source_key % 10 > 0) AS observed, count(*) FILTER (WHERE source_key % 10 > 0 AND outcome IN ('existing', 'new')) AS accepted,
  count(*) FILTER (WHERE source_key % 10 > 0 AND outcome NOT IN ('existing', 'new')) AS rejected, string_agg(DISTINCT reason, ',' ORDER BY reason) FILTER (WHERE source_key % 10 > 0) AS reasons, CASE WHEN source_key % 4 = 0 THEN 3 WHEN source_key % 10 = 0 THEN 0 END AS advertised FROM o GROUP BY run_id, source_key)
SELECT run_id, source_key, CAST(advertised AS BIGINT) AS advertised, observed, accepted, rejected, coalesce(reasons, '') AS reasons, coalesce(observed >= advertised, true) AND failure IS NULL AS complete,
  CASE WHEN failure IS NOT NULL THEN 'error: ' || failure WHEN observed < advertised THEN 'incomplete' WHEN observed = 0 THEN 'empty' ELSE 'ok' END AS status FROM s LEFT JOIN f USING (run_id, source_key)
WHERE source_key % 10 > 0 OR advertised IS NOT NULL OR failure IS NOT NULL""",
    "seen",
)
def source_run_accounts(spark, sf):
    rows = bound(spark, sf, "seen").selectExpr(*_OBSERVED)
    said = rows.where("source_key % 4 = 0 OR source_key % 10 = 0").select("run_id", "source_key", F.when(F.col("source_key") % 4 == 0, 3).otherwise(0).cast("long").alias("advertised"))
    failed = rows.where("seq % 97 = 0").select("run_id", "source_key", F.concat(F.lit("http_"), (500 + F.col("seq") % 3).cast("string")).alias("reason"))
    return L.run_accounts(rows.where("source_key % 10 > 0"), said, failed).withColumn("reasons", F.array_join("reasons", ","))


@q(
    """SELECT CASE WHEN status IN ('unseen', 'expiring') THEN 'to screen' WHEN status IN ('passed', 'skipped') THEN 'put aside' ELSE 'kept' END AS list, id
FROM vacancy WHERE status IN ('unseen', 'expiring', 'passed', 'skipped', 'liked', 'to_apply', 'to_research', 'to_network', 'applied', 'test_task', 'interview', 'accepted', 'declined')""",
    "vacancy",
)
def screen_lists(spark, sf):
    return L.screen_lists(bound(spark, sf, "vacancy"))


@q("SELECT org, count(*) AS n FROM role WHERE CAST(substring(org, 7) AS INT) % 5 > 0 GROUP BY org", "role")
def real_employers(spark, sf):
    """Without those that a landed file of decisions names."""
    role = bound(spark, sf, "role")
    folder = f"{ensure_checkpoint_dir(spark)}/decisions-{uuid.uuid4().hex}"
    named = role.where("CAST(substring(org, 7) AS INT) % 5 = 0").select(F.concat(F.lit("  "), "org", F.lit(" ")).alias("name")).distinct()
    named.agg(F.to_json(F.struct(F.collect_set("name").alias("parsing_artifacts"))).alias("value")).write.text(folder)
    return L.without_artifacts(role, L.artifacts(spark, folder)).groupBy("org").agg(F.count(F.lit(1)).alias("n"))


_MEMBER = f"""SELECT concat(company_id, '|', id % 60) AS cluster, id, CASE WHEN size % 11 = 0 THEN 'applied' WHEN size % 2 = 0 THEN 'unseen' ELSE 'passed' END AS status,
{AS_OF} - CAST(size % 20 AS INT) AS last_seen, concat('u', size % 4) AS url, CASE WHEN size % 3 > 0 THEN concat('r', size % 3) END AS req, seg1 AS norm, concat(company_id, '|', lower(title)) AS seg, "desc", body_len FROM p"""


@q(
    f"""WITH p AS (SELECT {', '.join(_KEYS)} FROM part), m AS ({_MEMBER}), l AS (SELECT * FROM m WHERE status = 'unseen' AND last_seen >= {AS_OF} - 14),
k AS (SELECT cluster, key, count(*) AS n FROM (SELECT cluster, 'u' || url AS key FROM l UNION ALL SELECT cluster, 'r' || req FROM l WHERE req IS NOT NULL) GROUP BY ALL), h AS (SELECT cluster, max(n) AS held FROM k GROUP BY cluster),
t AS (SELECT cluster, bool_or(a.norm = b.seg OR b.norm = a.seg) AND NOT bool_or(coalesce(a.desc <> b.desc AND a.body_len > 0 AND b.body_len > 0 AND least(a.body_len, b.body_len) * 3 >= greatest(a.body_len, b.body_len), false)) AS pair
  FROM l a JOIN l b USING (cluster) WHERE a.id < b.id GROUP BY cluster HAVING count(*) = 1),
g AS (SELECT cluster, count(*) AS n, count(*) FILTER (WHERE status = 'applied') AS applications, count(*) FILTER (WHERE status = 'unseen' AND last_seen >= {AS_OF} - 14) AS live FROM m GROUP BY cluster)
SELECT cluster, n, applications, live, CASE WHEN applications >= 2 OR (live >= 2 AND coalesce(held, 0) < live AND NOT coalesce(pair, false)) THEN 'manual' ELSE 'merge' END AS disposition
FROM g LEFT JOIN h USING (cluster) LEFT JOIN t USING (cluster) WHERE n > 1"""
)
def cluster_exceptions(spark, sf):
    """Clusters whose live rows a requisition or a segment of a title may hold together."""
    rows = table(spark, sf, "part").selectExpr(*[k.replace('"', "`") for k in _KEYS]).selectExpr(
        "concat(company_id, '|', id % 60) AS cluster", "id", "CASE WHEN size % 11 = 0 THEN 'applied' WHEN size % 2 = 0 THEN 'unseen' ELSE 'passed' END AS status", f"date_sub({AS_OF}, CAST(size % 20 AS INT)) AS last_seen",
        "array(concat('u', size % 4)) AS urls", "CASE WHEN size % 3 > 0 THEN array(concat('r', size % 3)) END AS reqs", "seg1 AS norm", "array(concat(company_id, '|', lower(title))) AS seg", "`desc`", "body_len",
    )
    return R.review_disposition(rows, F.expr(AS_OF))
