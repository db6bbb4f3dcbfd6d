"""Queries of rollups, health and evaluation, each with its check in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from roleflow import vocabulary as V
from roleflow.operators import rollups as R
from roleflow.plans.bindings import AS_OF, Registry, bound
from roleflow.session import table

REGISTRY = Registry()
q = REGISTRY.add


def as_of():
    return F.expr(AS_OF)


CLOSED = ", ".join(f"'{s}'" for s in V.CLOSED)


@q("""SELECT r_name, n_name, count(*) AS roles, count(*) FILTER (WHERE c_acctbal > 5000) AS liked, round(avg(c_acctbal), 1) AS avg_score
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")
def geo_rollup(spark, sf):
    joined = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return R.geo_rollup(joined, ["r_name", "n_name"], F.col("c_acctbal") > 5000, F.col("c_acctbal"))


@q(
    """SELECT company_id, count(*) AS roles, count(*) FILTER (WHERE score >= 60 AND status NOT IN (%s)) AS applyable, round(avg(score), 1) AS avg_score,
max(score) AS max_score, coalesce(max(score) >= 55, false) AS hot, CASE WHEN max(score) >= 55 THEN first(deadline ORDER BY score DESC NULLS LAST, id) END AS hot_deadline
FROM vacancy GROUP BY company_id""" % CLOSED,
    "vacancy",
)
def company_rollup(spark, sf):
    return R.company_rollup(bound(spark, sf, "vacancy"))


@q(
    """SELECT band, count(*) AS n, round(count(*)::DOUBLE * 100.0 / (SELECT count(*) FROM vacancy)::DOUBLE, 1) AS share
FROM (SELECT CASE WHEN score >= 70 THEN 'strong' WHEN score >= 50 THEN 'fair' ELSE 'weak' END AS band FROM vacancy) GROUP BY band""",
    "vacancy",
)
def score_band_share(spark, sf):
    return R.score_bands(bound(spark, sf, "vacancy"))


@q(
    """SELECT s.status, (SELECT count(*) FROM vacancy v WHERE v.status = s.status) AS n FROM (SELECT unnest([%s]) AS status) s""" % ", ".join(f"'{s}'" for s in V.STATUSES),
    "vacancy",
)
def status_counts(spark, sf):
    return R.counts_by_domain(bound(spark, sf, "vacancy"), "status", V.STATUSES)


@q(
    """SELECT count(*) FILTER (WHERE status IN ('applied','test_task','interview','declined','accepted')) AS sent, count(*) FILTER (WHERE status = 'applied') AS waiting,
count(*) FILTER (WHERE status IN ('test_task','interview')) AS in_progress, count(*) FILTER (WHERE status = 'accepted') AS accepted,
count(*) FILTER (WHERE status = 'declined') AS declined FROM vacancy""",
    "vacancy",
)
def application_counts(spark, sf):
    return R.application_counts(bound(spark, sf, "vacancy"))


@q(
    f"""SELECT count(*) FILTER (WHERE w AND age >= 7) AS stuck, count(*) FILTER (WHERE w AND age <= 7) AS fresh, CAST(max(CASE WHEN w THEN age END) AS INT) AS oldest
FROM (SELECT status = 'unseen' AND coalesce(score >= 60, false) AS w, date_diff('day', first_seen, {AS_OF}) AS age FROM vacancy)""",
    "vacancy",
)
def sla_latency(spark, sf):
    return R.latency(bound(spark, sf, "vacancy").withColumn("status_updated", F.lit(None).cast("date")), as_of())


@q(
    """SELECT count(*) AS rows, count(*) FILTER (WHERE score IS NULL OR score < 0) AS unscored,
count(*) FILTER (WHERE (score IS NULL OR score < 0) AND status = 'unseen') AS unscored_unseen FROM vacancy""",
    "vacancy",
)
def unscored_counts(spark, sf):
    return R.unscored_counts(bound(spark, sf, "vacancy"))


@q("SELECT board, count(*) AS n, count(*) FILTER (WHERE first_seen >= DATE '2001-01-01') AS recent FROM vacancy GROUP BY board", "vacancy")
def board_counts(spark, sf):
    return R.board_counts(bound(spark, sf, "vacancy"), F.expr("DATE '2001-01-01'"))


@q(
    f"""+boards AS (SELECT concat('board', s_suppkey) AS board, CAST(5 + s_suppkey % 20 AS INT) AS ttl_days, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE DATE '2001-08-01' - CAST(s_suppkey % 9 AS INT) END AS last_fetched FROM supplier),
c AS (SELECT board, count(*) AS n FROM vacancy GROUP BY board)
SELECT boards.board, coalesce(c.n, 0) AS n, coalesce(date_diff('day', last_fetched, {AS_OF}) >= ttl_days, true) AS overdue FROM boards LEFT JOIN c ON c.board = boards.board""",
    "vacancy",
)
def board_status(spark, sf):
    boards = table(spark, sf, "supplier").selectExpr(
        "concat('board', s_suppkey) AS board", "CAST(5 + s_suppkey % 20 AS INT) AS ttl_days", "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE DATE '2001-08-01' - CAST(s_suppkey % 9 AS INT) END AS last_fetched"
    )
    return R.board_status(boards, bound(spark, sf, "vacancy"), as_of())


@q(
    f"""+c AS (SELECT company_id, count(*) AS n, max(last_seen) AS last_success FROM vacancy GROUP BY company_id),
h AS (SELECT CASE WHEN company_key % 10 = 0 THEN 'board' ELSE 'ats' END AS strategy, company_key % 6 AS failures, coalesce(n, 0) AS n, last_success,
CASE WHEN company_key % 11 = 0 THEN NULL ELSE {AS_OF} END AS last_fetched FROM company LEFT JOIN c ON company_id = company_key),
k AS (SELECT CASE WHEN strategy = 'board' THEN 'BOARD_ONLY' WHEN last_fetched IS NULL THEN 'NEVER' WHEN failures >= 3 THEN 'BROKEN'
WHEN date_diff('day', last_success, {AS_OF}) < 14 AND n > 0 THEN 'OK' WHEN date_diff('day', last_success, {AS_OF}) >= 14 THEN 'STALE' WHEN n = 0 THEN 'EMPTY' ELSE 'UNKNOWN' END AS health FROM h)
SELECT health, count(*) AS n FROM k GROUP BY health""",
    "vacancy",
    "company",
)
def health_classes(spark, sf):
    counted = bound(spark, sf, "vacancy").groupBy("company_id").agg(F.count(F.lit(1)).alias("n"), F.max("last_seen").alias("last_success"))
    c = bound(spark, sf, "company").join(counted, F.col("company_key") == F.col("company_id"), "left")
    columns = {
        "strategy": F.when(F.col("company_key") % 10 == 0, "board").otherwise("ats"),
        "failures": F.col("company_key") % 6,
        "n": F.coalesce("n", F.lit(0)),
        "last_success": F.col("last_success"),
        "last_fetched": F.when(F.col("company_key") % 11 != 0, as_of()),
    }
    return c.groupBy(R.health_class(columns, as_of()).alias("health")).agg(F.count(F.lit(1)).alias("n"))


@q(
    """SELECT board, count(*) AS total, count(*) FILTER (WHERE c = 'delete') AS "delete", count(*) FILTER (WHERE c = 'enrich') AS enrich, count(*) FILTER (WHERE c = 'ready') AS ready
FROM (SELECT board, CASE WHEN score < 20 THEN 'delete' WHEN score IS NULL THEN 'enrich' ELSE 'ready' END AS c FROM vacancy) GROUP BY board ORDER BY total DESC, board LIMIT 15""",
    "vacancy",
)
def category_pivot(spark, sf):
    category = F.expr("CASE WHEN score < 20 THEN 'delete' WHEN score IS NULL THEN 'enrich' ELSE 'ready' END")
    return R.pivot_categories(bound(spark, sf, "vacancy").withColumn("category", category), "board", ("delete", "enrich", "ready"), 15)


@q(
    """+w AS (SELECT org, list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM posting),
g AS (SELECT org, array_to_string(w[i : i + k - 1], ' ') AS ngram FROM w, (SELECT unnest([2, 3]) AS k) s, unnest(range(1, greatest(len(w) - k + 2, 1))) AS t(i))
SELECT ngram, count(*) AS hits, count(DISTINCT org) AS orgs FROM g GROUP BY ngram HAVING count(*) >= 3 AND count(DISTINCT org) >= 2""",
    "posting",
)
def title_ngram_support(spark, sf):
    return R.ngram_support(bound(spark, sf, "posting"))


@q(
    """SELECT org, count(*) AS total, count(*) FILTER (WHERE score < 60) AS rejected FROM role GROUP BY org HAVING count(*) >= 5 AND count(*) FILTER (WHERE score < 60) > 0.5 * count(*)""",
    "role",
)
def rejecting_orgs(spark, sf):
    return R.rejecting_orgs(bound(spark, sf, "role").withColumn("rejected", F.col("score") < 60), share=0.5)


@q(
    """+w AS (SELECT DISTINCT id, score, unnest(regexp_split_to_array(lower(title), '[^a-z0-9]+')) AS word FROM posting),
c AS (SELECT word, count(*) FILTER (WHERE score < 15) AS hits, count(*) FILTER (WHERE score >= 60) AS good FROM w WHERE length(word) >= 3 GROUP BY word),
r AS (SELECT *, good = 0 AS clean, CAST(row_number() OVER (PARTITION BY good = 0 ORDER BY hits DESC, word) AS INT) AS rank FROM c WHERE hits >= 2)
SELECT word, hits, good, clean, rank FROM r WHERE rank <= 5""",
    "posting",
)
def filter_word_backtest(spark, sf):
    return R.filter_words(bound(spark, sf, "posting"), F.col("score") < 15, F.col("score") >= 60, 2, 5)


@q(
    """SELECT board, count(*) AS seen, count(*) FILTER (WHERE good) AS good FROM (SELECT DISTINCT id, good, unnest(boards) AS board FROM
(SELECT id, coalesce(score >= 100, false) AS good, [concat('b', company_id % 150), concat('b', id % 150)] AS boards FROM vacancy)) GROUP BY board HAVING count(*) >= 10 AND count(*) FILTER (WHERE good) = 0""",
    "vacancy",
)
def board_disable(spark, sf):
    rows = bound(spark, sf, "vacancy").selectExpr("coalesce(score >= 100, false) AS good", "array(concat('b', company_id % 150), concat('b', id % 150)) AS boards")
    return R.idle_boards(rows, 10)


@q("""+j AS (SELECT quality = 1 AS a, n_chars >= 1000 AS p FROM labels JOIN documents USING (doc_id)),
c AS (SELECT count(*) FILTER (WHERE a AND p) AS tp, count(*) FILTER (WHERE NOT a AND p) AS fp, count(*) FILTER (WHERE a AND NOT p) AS fn, count(*) FILTER (WHERE NOT a AND NOT p) AS tn FROM j)
SELECT tp, fp, fn, tn, round((tp + tn)::DOUBLE / nullif(tp + fp + fn + tn, 0), 4) AS agreement, round(tp::DOUBLE / nullif(tp + fp, 0), 4) AS precision,
round(tp::DOUBLE / nullif(tp + fn, 0), 4) AS recall, round(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 4) AS f1 FROM c""".replace("+j", "WITH j", 1))
def golden_confusion(spark, sf):
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return R.confusion(joined, F.col("quality") == 1, F.col("n_chars") >= 1000)


@q(
    """SELECT id, score, abs(score - 50) AS distance FROM (SELECT doc_id AS id, least(100, CAST(floor(n_chars / 50) AS BIGINT)) AS score, quality FROM labels JOIN documents USING (doc_id))
WHERE (score >= 50) <> (quality = 1) ORDER BY distance DESC, id LIMIT 50"""
)
def golden_disagreements(spark, sf):
    joined = bound(spark, sf, "posting").join(table(spark, sf, "labels").withColumnRenamed("doc_id", "id"), "id")
    return R.disagreements(joined, F.col("score"), F.col("quality") == 1, 50, 50).select("id", "score", "distance")


@q(
    """SELECT 'no_company' AS "check", count(*) AS bad FROM vacancy WHERE company_id IS NULL UNION ALL
SELECT 'dangling_company', count(*) FROM vacancy WHERE company_id NOT IN (SELECT company_key FROM company) UNION ALL
SELECT 'status', count(*) FROM vacancy WHERE status NOT IN (%s) UNION ALL
SELECT 'repeated_key', count(*) FROM (SELECT company_id, first_seen FROM vacancy GROUP BY ALL HAVING count(*) > 1) UNION ALL
SELECT 'deadline_before_sight', count(*) FROM vacancy WHERE deadline < first_seen""" % ", ".join(f"'{s}'" for s in V.STATUSES),
    "vacancy",
    "company",
)
def integrity_checks(spark, sf):
    v, c = bound(spark, sf, "vacancy"), bound(spark, sf, "company")
    return R.integrity(
        [
            ("no_company", v.where("company_id is null")),
            ("dangling_company", v.join(c, v["company_id"] == c["company_key"], "left_anti")),
            ("status", v.where(~F.col("status").isin(*V.STATUSES))),
            ("repeated_key", v.groupBy("company_id", "first_seen").count().where("count > 1")),
            ("deadline_before_sight", v.where("deadline < first_seen")),
        ]
    )


@q(
    """+c AS (SELECT company_id, count(*) AS actual FROM vacancy GROUP BY company_id)
SELECT company_key, CAST(company_key % 20 AS BIGINT) AS stored, coalesce(actual, 0) AS actual FROM company LEFT JOIN c ON company_id = company_key WHERE company_key % 20 IS DISTINCT FROM coalesce(actual, 0)""",
    "vacancy",
    "company",
)
def count_reconciliation(spark, sf):
    stored = bound(spark, sf, "company").selectExpr("company_key", "CAST(company_key % 20 AS BIGINT) AS stored")
    return R.recount(stored, bound(spark, sf, "vacancy").withColumnRenamed("company_id", "company_key"), "company_key").select("company_key", "stored", "actual")


@q(
    """+a AS (SELECT DISTINCT company_key AS id, lower(unnest([concat('alias', company_key % 700), concat('Name ', company_key)])) AS alias FROM company)
SELECT alias, count(DISTINCT id) AS claims FROM a GROUP BY alias HAVING count(DISTINCT id) > 1""",
    "company",
)
def shared_aliases(spark, sf):
    return R.shared_aliases(bound(spark, sf, "company").selectExpr("company_key AS id", "array(concat('alias', company_key % 700), concat('Name ', company_key)) AS aliases"))


@q(
    """SELECT count(*) AS "all", count(*) FILTER (WHERE lang <> 'en') AS language, count(*) FILTER (WHERE score >= 70) AS senior, count(*) FILTER (WHERE length(description) < 200) AS unclear FROM posting""",
    "posting",
)
def screen_groups(spark, sf):
    return R.overlapping_groups(
        bound(spark, sf, "posting"), {"all": F.lit(True), "language": F.col("lang") != "en", "senior": F.col("score") >= 70, "unclear": F.length("description") < 200}
    )


@q(
    """+d AS (SELECT source, day, count(*) AS n FROM seen GROUP BY source, day),
r AS (SELECT *, min(n) OVER w AS low, max(n) OVER w AS high FROM d WINDOW w AS (PARTITION BY source ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT source, day, n, low, high, coalesce(n BETWEEN low AND high, true) AS in_range FROM r""",
    "seen",
)
def run_range_last_k(spark, sf):
    daily = bound(spark, sf, "seen").groupBy("source", "day").agg(F.count(F.lit(1)).alias("n"))
    return R.expected_range(daily, "n", "day")


@q(
    """+e AS (SELECT day AS run, source AS employer, count(*) FILTER (WHERE status = 'error') AS gone, count(*) FILTER (WHERE status <> 'error') AS live FROM seen GROUP BY ALL)
SELECT run, CAST(sum(gone) AS BIGINT) AS gone, CAST(sum(live) AS BIGINT) AS live, count(*) FILTER (WHERE gone >= 3 AND gone >= 0.3 * (gone + live)) AS bad_employers, bool_or(gone >= 3 AND gone >= 0.3 * (gone + live)) AS dirty FROM e GROUP BY run""",
    "seen",
)
def dirty_runs(spark, sf):
    e = bound(spark, sf, "seen").groupBy(F.col("day").alias("run"), F.col("source").alias("employer")).agg(F.count_if(F.col("status") == "error").alias("gone"), F.count_if(F.col("status") != "error").alias("live"))
    return R.dirty_runs(e)


@q(
    """SELECT count(*) AS events, count(*) FILTER (WHERE status = 'purchase') AS counted FROM seen WHERE ts > (SELECT max(ts) FROM seen WHERE status = 'signup' AND source = 7)""",
    "seen",
)
def since_last_review(spark, sf):
    return R.since_cursor(bound(spark, sf, "seen"), (F.col("status") == "signup") & (F.col("source") == 7), F.col("status") == "purchase")


@q(
    """SELECT company_key, CASE WHEN b IS NULL THEN NULL WHEN b >= 82 THEN 'S' WHEN b >= 70 THEN 'A' WHEN b >= 55 THEN 'B' ELSE 'C' END AS tier FROM
(SELECT company_key, round_even((company_key % 101) * 0.7::DOUBLE + (company_key * 7 % 101) * 0.3::DOUBLE, 0) AS b FROM company)""",
    "company",
)
def company_tier(spark, sf):
    c = bound(spark, sf, "company")
    return c.select("company_key", R.tier((F.col("company_key") % 101).cast("double"), (F.col("company_key") * 7 % 101).cast("double")).alias("tier"))


@q(
    """SELECT id, org, lang FROM (SELECT *, row_number() OVER (PARTITION BY org, lang ORDER BY length(coalesce(description, '')) > 0 DESC, length(description) DESC NULLS LAST, id) AS r FROM posting) WHERE r = 1""",
    "posting",
)
def group_representatives(spark, sf):
    return R.representatives(bound(spark, sf, "posting"), ["org", "lang"]).select("id", "org", "lang")


@q("""+t AS (SELECT conv_id, turn, text, sum(length(text)) OVER (PARTITION BY conv_id) AS total FROM conversations)
SELECT conv_id, string_agg(CASE WHEN total > 500 THEN text[: CAST(floor(length(text)::DOUBLE * 500 / total) AS INT)] ELSE text END, chr(10) ORDER BY turn) AS content FROM t GROUP BY conv_id""".replace("+t", "WITH t", 1))
def proportional_trim(spark, sf):
    return R.trim_to_budget(table(spark, sf, "conversations"), "conv_id", "turn", "text", 500)


@q(
    """+r AS (SELECT *, CASE status WHEN 'applied' THEN 3 WHEN 'liked' THEN 2 WHEN 'unseen' THEN 1 ELSE 0 END AS rk, concat(company_id, '|', last_seen) AS k FROM vacancy),
g AS (SELECT k, first(id ORDER BY rk DESC, coalesce(score, -1) DESC, first_seen, id) AS survivor, list_sort(list(DISTINCT id)) AS ids, max(score) AS score, min(first_seen) AS first_seen, max(last_seen) AS last_seen, count(*) AS n FROM r GROUP BY k)
SELECT k, survivor, score, first_seen, last_seen, n, CAST(len(list_filter(ids, lambda x: x <> survivor)) AS INT) AS losers FROM g WHERE n > 1""",
    "vacancy",
)
def duplicate_survivors(spark, sf):
    rank = F.expr("CASE status WHEN 'applied' THEN 3 WHEN 'liked' THEN 2 WHEN 'unseen' THEN 1 ELSE 0 END")
    rows = bound(spark, sf, "vacancy").withColumn("rank", rank).withColumn("k", F.expr("concat(company_id, '|', last_seen)"))
    return R.merge_duplicates(rows, "k").withColumn("losers", F.size("losers"))


@q("""SELECT doc_id, count(*) AS n FROM (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS doc_id FROM events) GROUP BY doc_id""")
def json_prop_histogram(spark, sf):
    key = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").groupBy(key.alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
