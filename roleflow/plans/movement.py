"""Queries of joins, rankings and lifecycle, each with its check in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from roleflow import vocabulary as V
from roleflow.operators import joins as J
from roleflow.operators import lifecycle as L
from roleflow.operators import ranking as K
from roleflow.plans.bindings import AS_OF, Registry, bound
from roleflow.session import table

REGISTRY = Registry()
q = REGISTRY.add


def as_of():
    return F.expr(AS_OF)


APPLICATION = ", ".join(f"'{s}'" for s in V.APPLICATION)


@q("SELECT id, company, status, score, first_seen FROM vacancy JOIN company ON company_id = company_key WHERE status = 'unseen' AND (score IS NULL OR score < 0 OR score >= 80) ORDER BY first_seen DESC, id LIMIT 100", "vacancy", "company")
def top_k_priority(spark, sf):
    return J.select_postings(bound(spark, sf, "vacancy"), bound(spark, sf, "company"), status="unseen", least=80, limit=100).select("id", "company", "status", "score", "first_seen")


@q(
    """+c AS (SELECT company_id, count(*) AS n, count(*) FILTER (WHERE status = 'liked') AS liked FROM vacancy GROUP BY company_id)
SELECT company_key, coalesce(n, 0) AS n, coalesce(liked, 0) AS liked, CASE WHEN n IS NULL THEN 'silent' WHEN liked > 0 THEN 'engaged' WHEN n >= 3 THEN 'active' ELSE 'sparse' END AS segment
FROM company LEFT JOIN c ON company_id = company_key""",
    "vacancy",
    "company",
)
def company_left_audit(spark, sf):
    return J.company_audit(bound(spark, sf, "company"), bound(spark, sf, "vacancy")).select("company_key", "n", "liked", "segment")


@q("SELECT company_key, company FROM company c WHERE EXISTS (SELECT 1 FROM vacancy v WHERE v.company_id = c.company_key AND (v.status = 'liked' OR v.score >= 95))", "vacancy", "company")
def earned_semi(spark, sf):
    return J.earned_companies(bound(spark, sf, "company"), bound(spark, sf, "vacancy"), 95).select("company_key", "company")


@q("SELECT company_key, company FROM company c WHERE NOT EXISTS (SELECT 1 FROM vacancy v WHERE v.company_id = c.company_key AND (v.status = 'liked' OR v.score >= 95))", "vacancy", "company")
def unearned_anti(spark, sf):
    return J.earned_companies(bound(spark, sf, "company"), bound(spark, sf, "vacancy"), 95, keep=False).select("company_key", "company")


@q(
    f"""+stones AS (SELECT company_id AS key, CASE WHEN company_id % 4 = 0 THEN 'gone_from_source' WHEN company_id % 4 = 1 THEN NULL ELSE 'low_score' END AS reason, last_seen AS archived_at FROM vacancy WHERE status = 'archived')
SELECT id, company_id AS key, status FROM vacancy WHERE company_id NOT IN (SELECT key FROM stones WHERE archived_at >= {AS_OF} - 90 AND reason IS DISTINCT FROM 'gone_from_source')""",
    "vacancy",
)
def tombstone_anti(spark, sf):
    v = bound(spark, sf, "vacancy").withColumnRenamed("company_id", "key")
    reason = F.expr("CASE WHEN key % 4 = 0 THEN 'gone_from_source' WHEN key % 4 = 1 THEN NULL ELSE 'low_score' END")
    stones = v.where("status = 'archived'").select("key", reason.alias("reason"), F.col("last_seen").alias("archived_at"))
    return J.without_tombstones(v, stones, as_of(), include_gone=False).select("id", "key", "status")


@q("SELECT source, status, id FROM (SELECT *, row_number() OVER (PARTITION BY source, status ORDER BY ts DESC, id DESC) AS r FROM seen) WHERE r = 1", "seen")
def latest_observation(spark, sf):
    return J.latest(bound(spark, sf, "seen"), ["source", "status"], F.desc("ts"), F.desc("id")).select("source", "status", "id")


@q("SELECT conv_id, list(concat(role, ':', length(text)) ORDER BY role, text) AS evidence FROM conversations GROUP BY conv_id")
def evidence_lists(spark, sf):
    rows = table(spark, sf, "conversations").selectExpr("conv_id", "role AS source", "text AS content")
    return J.evidence_lists(rows, "conv_id").select("conv_id", F.transform("evidence", lambda x: F.concat(x["source"], F.lit(":"), F.length(x["content"]).cast("string"))).alias("evidence"))


@q(
    f"""+d AS (SELECT company_id, max(last_seen) AS last_fetched, count(*) FILTER (WHERE status = 'liked') > 0 AS engaged FROM vacancy WHERE status <> 'archived' GROUP BY company_id),
r AS (SELECT company AS name, round(date_diff('day', last_fetched, {AS_OF})::DOUBLE / (30 + company_key % 60)::DOUBLE, 4) AS ratio, coalesce(engaged, false) AS engaged FROM company LEFT JOIN d ON company_id = company_key),
k AS (SELECT *, CASE WHEN ratio IS NULL THEN 2 WHEN ratio >= 1 AND engaged THEN 0 WHEN ratio >= 1 THEN 1 END AS cohort FROM r)
SELECT name, ratio, CAST(cohort AS INT) AS cohort FROM k WHERE cohort IS NOT NULL ORDER BY cohort, ratio DESC NULLS LAST, name LIMIT 200""",
    "vacancy",
    "company",
)
def fetch_priority(spark, sf):
    d = bound(spark, sf, "vacancy").where("status <> 'archived'").groupBy("company_id").agg(F.max("last_seen").alias("last_fetched"), (F.count_if(F.col("status") == "liked") > 0).alias("engaged"))
    c = bound(spark, sf, "company").join(d, F.col("company_id") == F.col("company_key"), "left")
    rows = c.select(F.col("company").alias("name"), "last_fetched", F.coalesce("engaged", F.lit(False)).alias("engaged"), (30 + F.col("company_key") % 60).alias("ttl_days"))
    return K.due_first(rows, as_of(), 200).select("name", "ratio", "cohort")


@q("SELECT id, status, turn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY status ORDER BY first_seen, id) AS INT) AS turn FROM vacancy) ORDER BY turn, status LIMIT 100", "vacancy")
def stratified_round_robin(spark, sf):
    return K.round_robin(bound(spark, sf, "vacancy"), ["status"], ["first_seen", "id"], 100).select("id", "status", "turn")


@q("SELECT id, status = 'liked' AS positive, first_seen FROM vacancy ORDER BY 2 DESC, first_seen DESC, id LIMIT 4000", "vacancy")
def seed_records(spark, sf):
    return K.seeds(bound(spark, sf, "vacancy"), F.col("status") == "liked", 4000).select("id", "positive", "first_seen")


@q(
    """+r AS (SELECT id, quality = 1 AS positive, length(text) AS rich, row_number() OVER (PARTITION BY quality = 1 ORDER BY length(text) DESC, id) AS rn FROM (SELECT doc_id AS id, quality, text FROM labels JOIN documents USING (doc_id)))
SELECT id, positive, rich FROM r ORDER BY rn > 50, positive DESC, rn LIMIT 100""".replace("+r", "WITH r", 1)
)
def balanced_seeds(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").withColumnRenamed("doc_id", "id")
    return K.balanced_seeds(rows, F.col("quality") == 1, F.length("text").cast("long"), 100).select("id", "positive", "rich")


@q(
    f"""+l AS (SELECT *, CASE WHEN status = 'archived' THEN 'hidden' WHEN deadline < {AS_OF} THEN 'expired' WHEN status = 'expiring' THEN 'expiring' WHEN status IN ({APPLICATION}) THEN 'applied'
WHEN status = 'liked' AND deadline BETWEEN {AS_OF} AND {AS_OF} + 7 THEN 'urgent' WHEN status = 'liked' THEN 'liked' WHEN status = 'unseen' AND score >= 60 THEN 'new' ELSE 'rest' END AS list FROM vacancy)
SELECT id, list, CAST(row_number() OVER (PARTITION BY list ORDER BY deadline NULLS LAST, score DESC NULLS LAST, id) AS INT) AS place FROM l""",
    "vacancy",
)
def today_buckets(spark, sf):
    return K.today(bound(spark, sf, "vacancy"), as_of()).select("id", "list", "place")


@q(
    f"""+s AS (SELECT board, CAST(min(CASE WHEN deadline >= {AS_OF} THEN date_diff('day', {AS_OF}, deadline) END) AS INT) AS days, count(*) AS n FROM vacancy GROUP BY board)
SELECT board, days, n, CASE WHEN days IS NOT NULL THEN CAST(row_number() OVER (ORDER BY days NULLS LAST, board) AS INT) END AS number FROM s""",
    "vacancy",
)
def review_sections(spark, sf):
    return K.review_sections(bound(spark, sf, "vacancy"), "board", as_of())


@q("SELECT id, CAST((row_number() OVER (ORDER BY first_seen, id) - 1) // 15 AS BIGINT) AS batch FROM vacancy WHERE status = 'unseen' AND score IS NULL", "vacancy")
def judge_batches(spark, sf):
    rows = bound(spark, sf, "vacancy").where("status = 'unseen' and score is null")
    return K.batches(rows, [F.asc("first_seen"), F.asc("id")], 15).select("id", "batch")


@q("SELECT id, ts, true AS more FROM seen ORDER BY ts DESC, id LIMIT 25 OFFSET 50", "seen")
def observation_page(spark, sf):
    return K.page(bound(spark, sf, "seen"), [F.desc("ts"), F.asc("id")], 25, 2).select("id", "ts", "more")


@q(
    """+m AS (SELECT *, NOT (status = 'archived' OR coalesce(score >= 90, false)) AS rest FROM vacancy),
r AS (SELECT *, row_number() OVER (PARTITION BY rest ORDER BY md5(concat('7', '|', id))) AS k, count(*) OVER (PARTITION BY rest) AS n FROM m)
SELECT id, status, score FROM r WHERE NOT rest OR k <= round(n * 0.1)""",
    "vacancy",
)
def audit_sample(spark, sf):
    return K.audit_sample(bound(spark, sf, "vacancy"), F.col("status") == "archived", F.col("score"), 90, 0.1, "7").select("id", "status", "score")


@q(
    """+b AS (SELECT *, max(score) OVER (PARTITION BY org) AS best FROM role)
SELECT id, org, CAST(dense_rank() OVER (ORDER BY best DESC NULLS LAST, org) AS INT) AS group_place, CAST(row_number() OVER (PARTITION BY org ORDER BY score DESC NULLS LAST, id) AS INT) AS place FROM b""",
    "role",
)
def company_groups(spark, sf):
    return K.grouped_by_best(bound(spark, sf, "role"), "org").select("id", "org", "group_place", "place")


@q(
    f"""SELECT company_id, id, CASE WHEN status = 'applied' THEN CAST(date_diff('day', first_seen, {AS_OF}) AS INT) END AS waiting_days FROM
(SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY first_seen DESC NULLS LAST, id) AS r FROM vacancy WHERE status IN ({APPLICATION})) WHERE r = 1""",
    "vacancy",
)
def applications_table(spark, sf):
    rows = bound(spark, sf, "vacancy").where(F.col("status").isin(*V.APPLICATION)).withColumn("sent", F.col("first_seen"))
    return K.applications(rows, ["company_id"], as_of()).select("company_id", "id", "waiting_days")


@q(
    """+l AS (SELECT conv_id, text[:2000] AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text[:2000]) AS k FROM conversations),
r AS (SELECT conv_id, k, line, 0 AS part, length(line) AS n FROM l WHERE k = 1 UNION ALL
  SELECT l.conv_id, l.k, l.line, CASE WHEN r.n + 1 + length(l.line) <= 2000 THEN r.part ELSE r.part + 1 END, CASE WHEN r.n + 1 + length(l.line) <= 2000 THEN r.n + 1 + length(l.line) ELSE length(l.line) END
  FROM r JOIN l ON l.conv_id = r.conv_id AND l.k = r.k + 1)
SELECT conv_id, CAST(part AS INT) AS part, string_agg(line, chr(10) ORDER BY k) AS text FROM r GROUP BY conv_id, part""".replace("+l", "WITH RECURSIVE l", 1)
)
def message_parts(spark, sf):
    return K.pack(table(spark, sf, "conversations"), "conv_id", "turn", "text", 2000)


@q(f"SELECT id, CASE WHEN status = 'unseen' AND deadline < {AS_OF} THEN CASE WHEN score >= 60 THEN 'expiring' ELSE 'passed' END ELSE status END AS new_status FROM vacancy", "vacancy")
def expired_protect(spark, sf):
    return L.expire(bound(spark, sf, "vacancy"), as_of()).select("id", "new_status")


@q(f"SELECT id, board, last_seen FROM vacancy WHERE status = 'unseen' AND last_seen < {AS_OF} - 14 AND board IN ('board1', 'board2', 'board5')", "vacancy")
def stale_sources(spark, sf):
    fetched = spark.createDataFrame([("board1",), ("board2",), ("board5",)], "board string")
    return L.stale(bound(spark, sf, "vacancy"), fetched, as_of()).select("id", "board", "last_seen")


@q(
    """+r AS (SELECT id, company_id, status, score, CAST(id % 50 AS BIGINT) AS key, CAST(id % 77 AS BIGINT) AS norm FROM vacancy), l AS (SELECT DISTINCT company_id, CAST(id % 50 AS BIGINT) AS key FROM vacancy WHERE status <> 'unseen')
SELECT id, CASE WHEN score >= 60 THEN 'expiring' ELSE 'archived' END AS new_status FROM r WHERE status = 'unseen' AND company_id IN (SELECT company_id FROM l)
AND NOT EXISTS (SELECT 1 FROM l WHERE l.company_id = r.company_id AND l.key = r.key) AND NOT EXISTS (SELECT 1 FROM l WHERE l.company_id = r.company_id AND l.key = r.norm)""",
    "vacancy",
)
def gone_from_source(spark, sf):
    v = bound(spark, sf, "vacancy")
    rows = v.selectExpr("id", "company_id", "status", "score", "CAST(id % 50 AS BIGINT) AS key", "CAST(id % 77 AS BIGINT) AS norm")
    listing = v.where("status <> 'unseen'").selectExpr("company_id", "CAST(id % 50 AS BIGINT) AS key").distinct()
    return L.gone_from_source(rows, listing).select("id", "new_status")


@q(
    """+b AS (SELECT company_key, balance FROM company WHERE segment <> 'BUILDING'), c AS (SELECT company_key, -balance AS balance FROM company WHERE balance > 5000)
SELECT * FROM c UNION ALL SELECT * FROM b WHERE company_key NOT IN (SELECT company_key FROM c)""",
    "company",
)
def upsert_rows(spark, sf):
    c = bound(spark, sf, "company")
    base, fresh = c.where("segment <> 'BUILDING'"), c.where("balance > 5000").withColumn("balance", -F.col("balance"))
    return L.upsert(base.select("company_key", "balance"), fresh.select("company_key", "balance"), ["company_key"])


@q("SELECT company_key FROM company WHERE balance > 5000 AND segment = 'BUILDING'", "company")
def insert_if_absent(spark, sf):
    c = bound(spark, sf, "company")
    return L.insert_new(c.where("segment <> 'BUILDING'").select("company_key"), c.where("balance > 5000").select("company_key"), ["company_key"])


@q("SELECT CASE WHEN score >= 60 THEN 'approve' WHEN score < 25 THEN 'reject' ELSE 'pending' END AS decision, count(*) AS n FROM vacancy GROUP BY 1", "vacancy")
def auto_review(spark, sf):
    return bound(spark, sf, "vacancy").groupBy(L.route(F.col("score")).alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@q(
    """+m AS (SELECT *, status = 'error' AS bad, sum(CASE WHEN status = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS block FROM seen),
s AS (SELECT source, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY source, block ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM m)
SELECT source, max(streak) AS longest FROM s GROUP BY source""",
    "seen",
)
def failure_streaks(spark, sf):
    return L.streaks(bound(spark, sf, "seen"), "source", ["ts", "id"], F.col("status") == "error").groupBy("source").agg(F.max("streak").alias("longest"))


@q("SELECT id, source, status, previous FROM (SELECT *, lag(status) OVER (PARTITION BY source ORDER BY ts, id) AS previous FROM seen) WHERE previous IS DISTINCT FROM status", "seen")
def status_cdc(spark, sf):
    return L.status_changes(bound(spark, sf, "seen"), "source", ["ts", "id"], "status").select("id", "source", "status", "previous")


@q(
    """+req AS (SELECT id, company_id AS op, status, coalesce(score, 0) <> 77 AS ok FROM vacancy), w AS (SELECT op, bool_and(ok) AS every FROM req GROUP BY op)
SELECT id, CASE WHEN every THEN 'applied' WHEN ok THEN 'held' ELSE 'conflict' END AS outcome, CASE WHEN every THEN 'applied' ELSE status END AS status FROM req JOIN w USING (op)""",
    "vacancy",
)
def bulk_decision(spark, sf):
    v = bound(spark, sf, "vacancy")
    rows = v.selectExpr("id", "status", "coalesce(score, 0) AS revision", "CASE WHEN score > 50 THEN first_seen END AS applied_at")
    request = v.selectExpr("company_id AS op", "id", "status AS expected_status", "CASE WHEN score = 77 THEN -1 ELSE coalesce(score, 0) END AS expected_revision", "'applied' AS new_status")
    return L.bulk_decision(rows, request, as_of()).select("id", "outcome", "status")


@q(
    """+r AS (SELECT id, score AS old, CASE WHEN deadline IS NULL THEN NULL ELSE 50 END AS score, last_seen > first_seen + 35 AS changed FROM vacancy)
SELECT r.id, r.score, CASE WHEN v.status <> 'unseen' OR r.changed THEN 'skipped' WHEN v.score >= 40 THEN 'skipped' WHEN r.score IS NOT NULL THEN 'scored' ELSE 'prepared' END AS outcome FROM r JOIN vacancy v ON v.id = r.id""",
    "vacancy",
)
def compare_and_set(spark, sf):
    v = bound(spark, sf, "vacancy")
    results = v.selectExpr("id", "CASE WHEN last_seen > first_seen + 35 THEN 'other' ELSE 'h' END AS text_hash", "score AS old_score", "CASE WHEN deadline IS NULL THEN NULL ELSE 50 END AS score")
    return L.compare_and_set(v.withColumn("text_hash", F.lit("h")), results)


@q(
    f"SELECT id, CASE WHEN status = 'expiring' AND first_seen < {AS_OF} THEN 'unseen' ELSE status END AS status FROM vacancy",
    "vacancy",
)
def deferred_status(spark, sf):
    v = bound(spark, sf, "vacancy")
    s = F.when(F.col("status") == "expiring", "unsure").otherwise(F.col("status"))
    return v.select("id", L.deferred(s, F.col("first_seen"), as_of()).alias("status"))


@q("SELECT source, min(ts) AS start_ts, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY ts, id) AS s FROM (SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY source ORDER BY ts, id)) AS gap FROM seen)) GROUP BY source, s", "seen")
def session_activity(spark, sf):
    from roleflow.streaming.events import sessions

    return sessions(bound(spark, sf, "seen"), "2 hours")
