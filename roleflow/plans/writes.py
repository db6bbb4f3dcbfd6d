"""Queries of checked writes: requests are made of the given tables by rules over their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from roleflow import vocabulary as V
from roleflow.operators import writes as O
from roleflow.plans.bindings import Registry, bound

REGISTRY = Registry()
q = REGISTRY.add

_ASKED = (
    "id AS req", "CASE WHEN id % 13 = 0 THEN NULL WHEN id % 17 = 0 THEN -id ELSE id - id % 3 END AS id",
    "CASE id % 7 WHEN 0 THEN 'nonsense' WHEN 1 THEN '' WHEN 2 THEN 'applied' WHEN 3 THEN 'interview' WHEN 4 THEN 'passed' ELSE 'liked' END AS status", "last_seen AS at",
)
_STATUSES = ", ".join(f"'{s}'" for s in V.STATUSES)
_SENT = ", ".join(f"'{s}'" for s in V.APPLICATION)
_JUDGED = f"""+r AS (SELECT {', '.join(_ASKED)} FROM vacancy),
j AS (SELECT r.*, CASE WHEN r.id IS NULL OR trim(r.status) = '' THEN 'missing' WHEN r.status NOT IN ({_STATUSES}) THEN 'invalid' WHEN r.id NOT IN (SELECT id FROM vacancy) THEN 'not found' ELSE 'saved' END AS outcome FROM r)"""


def _saved(spark, sf):
    v = bound(spark, sf, "vacancy")
    rows = v.select("id", "status", F.col("first_seen").alias("status_at"), F.when(F.col("status") == "applied", F.col("first_seen")).alias("applied_at"))
    return O.save_statuses(rows, v.selectExpr(*_ASKED))


@q(
    f"""{_JUDGED}, l AS (SELECT id, arg_max(status, req) AS s, arg_max("at", req) AS t, arg_min("at", req) FILTER (WHERE status IN ({_SENT})) AS sent FROM j WHERE outcome = 'saved' GROUP BY id)
SELECT v.id, coalesce(l.s, v.status) AS status, coalesce(l.t, v.first_seen) AS status_at, coalesce(CASE WHEN v.status = 'applied' THEN v.first_seen END, l.sent) AS applied_at FROM vacancy v LEFT JOIN l USING (id)""".replace("AS at FROM", 'AS "at" FROM'),
    "vacancy",
)
def saved_statuses(spark, sf):
    return _saved(spark, sf)[0]


@q(f"{_JUDGED} SELECT outcome, count(*) AS n FROM j GROUP BY outcome".replace("AS at FROM", 'AS "at" FROM'), "vacancy")
def status_outcomes(spark, sf):
    return _saved(spark, sf)[1].groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
