"""Queries of identity resolution, merges and the life of rows, each with its check in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from roleflow import vocabulary as V
from roleflow.operators import identity as I
from roleflow.operators import joins as J
from roleflow.operators import lifecycle as L
from roleflow.operators import resolve as R
from roleflow.plans.bindings import AS_OF, Registry, bound
from roleflow.session import table

REGISTRY = Registry()
q = REGISTRY.add
DECIDED = ", ".join(f"'{s}'" for s in V.DECIDED)

#: Keys that parts have as postings; the larger ones are the batch, the others what is stored.
_KEYS = (
    "p_partkey AS id", "p_brand AS company_id", "lower(p_name) AS title", "concat(p_brand, '|', p_name, '|', p_type, '|', CAST(floor(p_retailprice) AS BIGINT) % 3) AS hash", "concat(p_brand, '|', p_name) AS norm",
    "CASE WHEN p_size % 4 = 0 THEN NULL ELSE concat('f', CAST(floor(p_retailprice * 10) AS BIGINT) % 11) END AS \"desc\"", "CAST(p_size * 100 AS INT) AS body_len", "concat('https://e.org/', p_brand, '/', CAST(floor(p_retailprice) AS BIGINT) % 30) AS url",
    "CASE WHEN p_type = 'PROMO' THEN concat('r:', CAST(floor(p_retailprice) AS BIGINT) % 40) END AS req", "concat(p_brand, '|', lower(p_type)) AS seg1",
    "CASE WHEN p_size % 5 = 0 THEN 'liked' ELSE 'unseen' END AS status", "CASE WHEN p_size % 3 = 0 THEN 50 END AS score", "DATE '2001-01-01' + CAST(p_size AS INT) AS first_seen", "p_size AS size",
)


def _parts(spark, sf):
    rows = table(spark, sf, "part").selectExpr(*[k.replace('"', "`") for k in _KEYS]).withColumn("seg", F.array("seg1"))
    batch = rows.where("size > 30").withColumnRenamed("id", "pos")
    stored = rows.where("size <= 30").withColumn("urls", F.array("url")).withColumn("reqs", F.when(F.col("req").isNotNull(), F.array("req")).otherwise(F.array().cast("array<string>")))
    # The exact key of a stored row is its own: the oldest holds it, the others carry another.
    first = J.latest(stored, ["hash"], F.asc("id"))
    return batch, first


def _words(a: str) -> str:
    stop = ", ".join(f"'{w}'" for w in I.TITLE_STOPWORDS)
    return f"list_filter(list_distinct(str_split({a}, ' ')), lambda w: w <> '' AND w NOT IN ({stop}))"


_SAME = f"(contains(a.title, b.title) OR contains(b.title, a.title) OR len(list_filter({_words('a.title')}, lambda w: NOT list_contains({_words('b.title')}, w))) = 0 OR len(list_filter({_words('b.title')}, lambda w: NOT list_contains({_words('a.title')}, w))) = 0)"
_OVERLAP = f"len(list_intersect({_words('a.title')}, {_words('b.title')})) / len(list_distinct(list_concat({_words('a.title')}, {_words('b.title')})))::DOUBLE"
_DIFFER = "coalesce(a.desc <> b.desc AND a.body_len > 0 AND b.body_len > 0 AND least(a.body_len, b.body_len) * 3 >= greatest(a.body_len, b.body_len), false)"
_SETTLED = f"(b.status IN ({DECIDED}) OR b.score IS NOT NULL)"

#: The resolver in SQL: exact keys first, then each posting in turn takes its first wish that is left.
_RESOLVED = f"""WITH RECURSIVE p AS (SELECT {', '.join(_KEYS)} FROM part), bt AS (SELECT * FROM p WHERE size > 30), st AS (SELECT * FROM p WHERE size <= 30 QUALIFY row_number() OVER (PARTITION BY hash ORDER BY id) = 1),
ex AS (SELECT a.id AS pos, b.id AS match, a.hash, a.desc AS fp, NOT {_DIFFER} OR row_number() OVER (PARTITION BY a.hash ORDER BY a.id) > 1 OR {_SETTLED} OR coalesce(a.req = b.req, false) AS stays FROM bt a JOIN st b USING (hash)),
exact AS (SELECT pos, CASE WHEN stays THEN match END AS match, CASE WHEN stays THEN 'exact' ELSE 'fork' END AS kind, CASE WHEN stays THEN hash ELSE substring(md5(concat(hash, '|', fp)), 1, 16) END AS insert_hash FROM ex),
rest AS (SELECT *, min(id) OVER (PARTITION BY hash) AS leader FROM bt WHERE id NOT IN (SELECT pos FROM exact)),
keys AS (SELECT id, company_id, first_seen, status IN ({DECIDED}) AS decided, unnest(['norm', 'desc', 'url', 'req', 'seg']) AS kind, unnest([norm, "desc", url, req, seg1]) AS key FROM st),
idx AS (SELECT * FROM keys WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY company_id, kind, key ORDER BY decided DESC, first_seen, id) = 1),
ask AS (SELECT id, unnest([1, 2, 3, 4, 5, 6]) AS step, unnest(['req', 'url', 'norm', 'desc', 'seg', 'seg']) AS how, unnest(['req', 'url', 'norm', 'desc', 'seg', 'norm']) AS kind, unnest([req, url, norm, "desc", norm, seg1]) AS key FROM rest WHERE id = leader),
hit AS (SELECT k.id AS pos, k.step, k.how, i.id AS match FROM ask k JOIN rest r ON r.id = k.id JOIN idx i ON i.company_id = r.company_id AND i.kind = k.kind AND i.key = k.key),
wish AS (SELECT h.pos, h.step, h.match, CASE WHEN how = 'url' THEN 'norm' ELSE how END AS kind FROM hit h JOIN rest a ON a.id = h.pos JOIN st b ON b.id = h.match WHERE (b.company_id, b.hash) NOT IN (SELECT company_id, hash FROM bt)
AND CASE how WHEN 'req' THEN coalesce(a.desc = b.desc, false) OR {_OVERLAP} >= 0.5 WHEN 'url' THEN {_SAME} WHEN 'seg' THEN NOT {_DIFFER} ELSE a.url = b.url OR {_SETTLED} END),
queue AS (SELECT pos, list(struct_pack(match := match, kind := kind) ORDER BY step) AS w, row_number() OVER (PARTITION BY company_id ORDER BY pos) AS n, company_id FROM wish JOIN rest r ON r.id = wish.pos GROUP BY pos, company_id),
turn AS (SELECT company_id, 0::BIGINT AS n, CAST([] AS BIGINT[]) AS taken, NULL::BIGINT AS pos, NULL::BIGINT AS match, NULL::VARCHAR AS kind FROM (SELECT DISTINCT company_id FROM queue)
UNION ALL SELECT company_id, n, CASE WHEN c IS NULL THEN taken ELSE list_append(taken, c.match) END, pos, c.match, c.kind FROM (SELECT t.company_id, q.n, t.taken, q.pos, list_filter(q.w, lambda x: NOT list_contains(t.taken, x.match))[1] AS c FROM turn t JOIN queue q ON q.company_id = t.company_id AND q.n = t.n + 1)),
resolved AS (SELECT pos, match, kind, insert_hash FROM exact UNION ALL SELECT r.id, t.match, CASE WHEN r.id <> r.leader THEN 'exact' ELSE coalesce(t.kind, 'new') END, r.hash FROM rest r LEFT JOIN (SELECT * FROM turn WHERE match IS NOT NULL) t ON t.pos = r.leader)"""


@q(f"{_RESOLVED} SELECT pos, match, kind, insert_hash FROM resolved")
def resolve_postings(spark, sf):
    batch, stored = _parts(spark, sf)
    return I.resolve_batch(batch, stored)


def _merge(spark, sf, board: bool):
    batch, stored = _parts(spark, sf)
    resolved = I.resolve_batch(batch, stored)
    text = F.when(F.col("size") % 2 == 0, F.expr("repeat('word ', CAST(size AS INT) * 3)"))
    columns = (text.alias("description"), F.when(F.col("size") % 3 == 0, F.concat(F.lit("snippet "), "title")).alias("snippet"), F.when(F.col("size") % 7 == 0, F.col("seg1")).alias("department"), F.when(F.col("size") % 5 == 0, F.col("first_seen")).alias("deadline"))
    status = F.when(F.col("size") % 4 == 0, "archived").when(F.col("size") % 9 == 0, "expiring").otherwise(F.col("status"))
    store = stored.select("id", "hash", "title", status.alias("status"), F.when(status == "archived", "board_stale").alias("status_reason"), *columns, "first_seen", F.col("first_seen").alias("last_seen"))
    return I.merge_batch(store, batch.select("pos", "title", *columns), resolved, F.expr(AS_OF), board=board)


def _merge_sql(board: bool) -> str:
    text = "CASE WHEN size % 2 = 0 THEN repeat('word ', size * 3) END"
    takes = "coalesce(length(s.d), 0) = 0" if board else "length(t) > coalesce(length(s.d), 0) + 100"
    return f"""{_RESOLVED}, f AS (SELECT *, {text} AS d, CASE WHEN size % 3 = 0 THEN concat('snippet ', title) END AS sn, CASE WHEN size % 7 = 0 THEN seg1 END AS dep, CASE WHEN size % 5 = 0 THEN first_seen END AS dl FROM p),
s0 AS (SELECT f.*, CASE WHEN size % 4 = 0 THEN 'archived' WHEN size % 9 = 0 THEN 'expiring' ELSE status END AS st0 FROM f WHERE id IN (SELECT id FROM st)),
j AS (SELECT r.match, r.kind IN ('norm', 'desc') AS rename, r.insert_hash, b.* FROM resolved r JOIN f b ON b.id = r.pos),
m AS (SELECT match, arg_min(sn, id) FILTER (WHERE sn IS NOT NULL) AS sn, arg_min(dep, id) FILTER (WHERE dep IS NOT NULL) AS dep, arg_min(dl, id) FILTER (WHERE dl IS NOT NULL) AS dl,
  first(d ORDER BY length(d) DESC NULLS LAST, id) FILTER (WHERE NOT rename) AS te, first(d ORDER BY length(d) DESC NULLS LAST, id) AS ta, arg_max(title, id) FILTER (WHERE rename) AS title, arg_max(insert_hash, id) FILTER (WHERE rename) AS hash FROM j WHERE match IS NOT NULL GROUP BY match),
u AS (SELECT s.*, m.sn AS msn, m.dep AS mdep, m.dl AS mdl, m.title AS mt, m.hash AS mh, CASE WHEN s.st0 IN ({DECIDED}) THEN m.te ELSE m.ta END AS t FROM s0 s JOIN m ON m.match = s.id)
SELECT id, coalesce(mh, hash) AS hash, coalesce(mt, title) AS title, CASE WHEN st0 IN ('archived', 'expiring') THEN 'unseen' ELSE st0 END AS status, NULL::VARCHAR AS status_reason, coalesce(sn, msn) AS snippet,
CASE WHEN coalesce({takes} AND length(t) > 0, false) THEN t ELSE s.d END AS description, coalesce(dep, mdep) AS department, coalesce(dl, mdl) AS deadline, first_seen, {AS_OF} AS last_seen FROM u s
UNION ALL SELECT NULL, insert_hash, title, 'unseen', NULL, sn, d, dep, dl, {AS_OF}, {AS_OF} FROM (SELECT * FROM j WHERE match IS NULL QUALIFY row_number() OVER (PARTITION BY insert_hash ORDER BY id) = 1)"""


@q(_merge_sql(False))
def merge_postings(spark, sf):
    return _merge(spark, sf, board=False)


@q(_merge_sql(True))
def merge_board_postings(spark, sf):
    return _merge(spark, sf, board=True)


@q(
    f"""{_RESOLVED}, g AS (SELECT id AS pos, CASE WHEN size % 10 = 1 THEN 'junk' END AS skip, size % 10 = 2 AS archived FROM bt)
SELECT g.pos, CASE WHEN skip IS NOT NULL THEN 'invalid' WHEN archived THEN 'archived' WHEN match IS NOT NULL THEN 'existing' ELSE 'new' END AS outcome, CASE WHEN skip IS NULL AND NOT archived THEN match END AS match FROM g LEFT JOIN resolved r ON r.pos = g.pos"""
)
def import_outcomes(spark, sf):
    batch, stored = _parts(spark, sf)
    gated = batch.select("pos", F.when(F.col("size") % 10 == 1, "junk").alias("skip"), (F.col("size") % 10 == 2).alias("archived"))
    return I.import_outcomes(gated, I.resolve_batch(batch, stored))


@q(f"WITH p AS (SELECT {', '.join(_KEYS)} FROM part) SELECT a.id AS ask, first(b.id ORDER BY b.first_seen, b.id) AS id FROM p a JOIN p b ON a.url = b.url AND a.size > 30 AND b.size <= 30 WHERE {_SAME} GROUP BY a.id")
def posting_url_lookup(spark, sf):
    rows = table(spark, sf, "part").selectExpr(*[k.replace('"', "`") for k in _KEYS]).withColumn("urls", F.array("url"))
    return I.by_posting_url(rows.where("size <= 30"), rows.where("size > 30").select(F.col("id").alias("ask"), "urls", "title"))


#: Links that parts of several brands share.
_SHARED = "concat('https://b.org/', CAST(floor(p_retailprice * 10) AS BIGINT) % 900)"


@q(
    f"""WITH RECURSIVE p AS (SELECT p_partkey AS id, p_brand AS company_id, lower(p_name) AS title, {_SHARED} AS url FROM part), e AS (SELECT a.id AS x, b.id AS y FROM p a JOIN p b ON a.url = b.url AND a.company_id <> b.company_id WHERE a.id = (SELECT min(c.id) FROM p c WHERE c.url = a.url) AND {_SAME}),
b2 AS (SELECT x, y FROM e UNION SELECT y, x FROM e), r AS (SELECT x AS a, x AS b FROM b2 UNION SELECT r.a, b2.y FROM r JOIN b2 ON r.b = b2.x), c AS (SELECT a AS id, min(b) AS cluster FROM r GROUP BY a), n AS (SELECT cluster FROM c JOIN p USING (id) GROUP BY cluster HAVING count(DISTINCT company_id) > 1)
SELECT id, company_id, cluster FROM c JOIN p USING (id) WHERE cluster IN (SELECT cluster FROM n)"""
)
def employer_clusters(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey AS id", "p_brand AS company_id", "lower(p_name) AS title", f"array({_SHARED}) AS urls")
    return I.across_companies(rows)


@q(
    """WITH c AS (SELECT s_suppkey AS id, s_nationkey AS n, s_nationkey // 5 AS cluster FROM supplier), m AS (SELECT n AS company_id, count(*) AS k, min(cluster) AS cluster FROM c GROUP BY n),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY k DESC, company_id) AS p FROM m)
SELECT r.company_id AS loser, w.company_id AS winner FROM r JOIN r w ON w.cluster = r.cluster AND w.p = 1 WHERE r.p > 1 AND r.company_id % 2 = w.company_id % 2"""
)
def employer_merges(spark, sf):
    rows = table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_nationkey AS company_id", "s_nationkey div 5 AS cluster")
    companies = rows.select("company_id").distinct().selectExpr("company_id", "CASE WHEN company_id % 2 = 0 THEN 'Even Works Ltd' ELSE 'The Odd Fund' END AS name", "DATE '2001-01-01' AS created")
    return I.company_merges(rows.select("id", "company_id", "cluster"), rows, companies)


@q(
    """WITH v AS (SELECT o_custkey % 400 AS cluster, o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'applied' WHEN '2-HIGH' THEN 'unseen' ELSE 'passed' END AS status, CAST(o_orderdate AS DATE) AS last_seen, concat('u', o_custkey) AS url FROM orders),
m AS (SELECT cluster, count(*) AS n, count(*) FILTER (WHERE status = 'applied') AS applications, count(*) FILTER (WHERE status = 'unseen' AND last_seen >= DATE '2001-08-10' - 14) AS live, count(DISTINCT url) FILTER (WHERE status = 'unseen' AND last_seen >= DATE '2001-08-10' - 14) AS links FROM v GROUP BY cluster)
SELECT cluster, n, applications, live, CASE WHEN applications >= 2 OR (live >= 2 AND links > 1) THEN 'manual' ELSE 'merge' END AS disposition FROM m WHERE n > 1"""
)
def cluster_dispositions(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_custkey % 400 AS cluster", "o_orderkey AS id", "CASE o_orderpriority WHEN '1-URGENT' THEN 'applied' WHEN '2-HIGH' THEN 'unseen' ELSE 'passed' END AS status", "CAST(o_orderdate AS DATE) AS last_seen", "array(concat('u', o_custkey)) AS urls"
    )
    return R.review_disposition(rows, F.expr(AS_OF))


@q("WITH m AS (SELECT c_custkey AS loser, min(c_custkey) OVER (PARTITION BY c_nationkey) AS survivor FROM customer) SELECT o_orderkey AS id, m.survivor AS company_id FROM orders LEFT JOIN m ON m.loser = o_custkey")
def repointed_rows(spark, sf):
    from pyspark.sql import Window as W

    moved = table(spark, sf, "customer").select(F.col("c_custkey").alias("loser"), F.min("c_custkey").over(W.partitionBy("c_nationkey")).alias("survivor"))
    return R.repoint(table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_custkey AS company_id"), moved, "company_id")


@q(
    """WITH s AS (SELECT s_suppkey AS id, s_nationkey AS n, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS survivor, lower(s_name) AS low FROM supplier)
SELECT survivor AS id, list_sort(list_distinct(list_concat(list(concat('alias ', n)), list(low) FILTER (WHERE id <> survivor)))) AS aliases FROM s GROUP BY survivor"""
)
def merged_companies(spark, sf):
    from pyspark.sql import Window as W

    rows = table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "array(concat('Alias ', s_nationkey)) AS aliases", "s_nationkey AS n")
    moved = rows.select(F.col("id").alias("loser"), F.min("id").over(W.partitionBy("n")).alias("survivor")).where("loser <> survivor")
    return R.merge_companies(rows.drop("n"), moved).select("id", "aliases")


@q(
    """WITH e AS (SELECT l_orderkey AS id, concat('https://e.org/', l_suppkey % 3) AS url, CASE WHEN l_linenumber % 2 = 0 THEN concat('c', l_suppkey % 2) END AS city FROM lineitem), k AS (SELECT DISTINCT id, url, city FROM e)
SELECT id, count(*) AS n FROM k WHERE city IS NOT NULL OR NOT EXISTS (SELECT 1 FROM k x WHERE x.id = k.id AND x.url = k.url AND x.city IS NOT NULL) GROUP BY id"""
)
def folded_places(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey AS id", "named_struct('url', concat('https://e.org/', l_suppkey % 3, '?utm_source=x'), 'city', CASE WHEN l_linenumber % 2 = 0 THEN concat('c', l_suppkey % 2) END, 'country', CAST(NULL AS STRING)) AS p")
    grouped = rows.groupBy("id").agg(F.collect_list("p").alias("places"))
    return grouped.select("id", F.size(R.fold_places(F.col("places"))).cast("long").alias("n"))


@q(
    """WITH t AS (SELECT o_orderkey AS id, o_custkey AS key, CASE o_orderpriority WHEN '1-URGENT' THEN 'interview' WHEN '2-HIGH' THEN 'applied' ELSE 'other' END AS status, CAST(o_orderdate AS DATE) AS last_seen, CASE WHEN o_orderstatus = 'F' THEN o_orderkey END AS review FROM orders),
r AS (SELECT *, row_number() OVER w AS rn, max(last_seen) OVER (PARTITION BY key) AS fresh, first(review IGNORE NULLS) OVER (PARTITION BY key ORDER BY CASE status WHEN 'interview' THEN 1 WHEN 'applied' THEN 2 ELSE 3 END, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS rv
FROM t WINDOW w AS (PARTITION BY key ORDER BY CASE status WHEN 'interview' THEN 1 WHEN 'applied' THEN 2 ELSE 3 END, id))
SELECT key, id, status, fresh AS last_seen, rv AS review FROM r WHERE rn = 1"""
)
def triage_board(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_custkey AS key", "CASE o_orderpriority WHEN '1-URGENT' THEN 'interview' WHEN '2-HIGH' THEN 'applied' ELSE 'other' END AS status", "CAST(o_orderdate AS DATE) AS last_seen", "CASE WHEN o_orderstatus = 'F' THEN o_orderkey END AS review")
    return R.triage(rows, ("interview", "applied")).select("key", "id", "status", "last_seen", "review")


# The life of rows.


@q("SELECT CAST(id AS VARCHAR) AS id, CAST(first_seen AS VARCHAR) AS seen, score FROM vacancy WHERE status = 'unseen' AND score < 30", "vacancy")
def archived_payloads(spark, sf):
    gone = L.to_archive(bound(spark, sf, "vacancy"), 30, force=True)
    payload = L.archive_payload(gone)
    return payload.select("id", F.get_json_object("payload", "$.first_seen").alias("seen"), F.get_json_object("payload", "$.score").cast("long").alias("score"))


@q("SELECT id, status FROM vacancy WHERE status = 'unseen' AND board = 'board3'", "vacancy")
def switched_off_board(spark, sf):
    v = bound(spark, sf, "vacancy")
    boards = v.select("board").distinct()
    return L.archive_board(v, boards, "board3").select("id", "status")


@q(f"SELECT DISTINCT k AS key, 'gone' AS reason, {AS_OF} AS archived_at FROM (SELECT unnest([concat('h', id), concat('n', company_id)]) AS k FROM vacancy WHERE status = 'archived')", "vacancy")
def written_tombstones(spark, sf):
    v = bound(spark, sf, "vacancy").selectExpr("concat('h', id) AS key", "concat('n', company_id) AS norm", "status AS new_status")
    return L.tombstones(v, "gone", F.expr(AS_OF))


_APPLICATION = ", ".join(f"'{s}'" for s in V.APPLICATION)


@q(
    f"""WITH v AS (SELECT *, CASE WHEN score > 50 THEN first_seen END AS applied_at, CASE WHEN score % 2 = 0 THEN 'archived' ELSE 'interview' END AS want FROM vacancy0)
SELECT id, CASE WHEN status IN ({_APPLICATION}) AND want = 'archived' THEN status ELSE want END AS new_status, coalesce(applied_at, CASE WHEN want = 'interview' THEN {AS_OF} END) AS new_applied_at, status IN ({_APPLICATION}) AND want = 'archived' AS refused FROM v""".replace("vacancy0", "(SELECT * FROM vacancy)").replace("WITH v", "+v", 1),
    "vacancy",
)
def status_writes(spark, sf):
    v = bound(spark, sf, "vacancy").withColumn("applied_at", F.when(F.col("score") > 50, F.col("first_seen")))
    want = F.when(F.col("score") % 2 == 0, "archived").otherwise("interview")
    return L.set_status(v, want, F.expr(AS_OF)).select("id", "new_status", "new_applied_at", "refused")


@q(
    f"""+r AS (SELECT company_id, max(score) AS score, {AS_OF} AS deadline, max(score) > 90 AS banned FROM vacancy GROUP BY company_id)
SELECT v.id, r.score, coalesce(v.deadline, r.deadline) AS deadline, CASE WHEN r.banned AND v.status = 'unseen' THEN 'archived' ELSE v.status END AS status FROM vacancy v JOIN r ON r.company_id = v.company_id""",
    "vacancy",
)
def score_fan_out(spark, sf):
    v = bound(spark, sf, "vacancy")
    results = v.groupBy("company_id").agg(F.collect_list("id").alias("ids"), F.max("score").alias("score")).select("ids", "score", F.expr(AS_OF).alias("deadline"), (F.col("score") > 90).alias("banned"))
    return L.fan_out_scores(v, results)


@q(f"SELECT board, max(last_seen) <= {AS_OF} - 30 AS due, coalesce(nullif(min(CASE WHEN score > 95 THEN status END), ''), 'none') AS filled FROM vacancy GROUP BY board", "vacancy")
def boards_due(spark, sf):
    rolled = bound(spark, sf, "vacancy").groupBy("board").agg(F.max("last_seen").alias("last"), F.min(F.when(F.col("score") > 95, F.col("status"))).alias("s"))
    return rolled.select("board", L.due_to_fetch(F.col("last"), F.lit(30), F.expr(AS_OF)).alias("due"), L.fill(F.col("s"), F.lit("none")).alias("filled"))


@q(
    """WITH s AS (SELECT DISTINCT p_name AS id FROM part WHERE p_size <= 10), n AS (SELECT p_name AS id, p_partkey AS seq, p_brand FROM part WHERE p_size > 10)
SELECT id, p_brand, CAST(3 AS INT) AS version FROM n WHERE id NOT IN (SELECT id FROM s) QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1 UNION ALL SELECT id, NULL, 2 FROM s"""
)
def versioned_set(spark, sf):
    parts = table(spark, sf, "part")
    store = parts.where("p_size <= 10").select(F.col("p_name").alias("id")).distinct().withColumn("version", F.lit(2))
    fresh = L.append_versioned(store, parts.where("p_size > 10").selectExpr("p_name AS id", "p_partkey AS seq", "p_brand"), F.expr(AS_OF))
    grown = store.select("id", F.lit(None).cast("string").alias("p_brand"), "version").unionByName(fresh.select("id", "p_brand", "version"))
    return L.as_of_version(grown, 3)


@q(
    """WITH j AS (SELECT l_orderkey AS id, CASE l_returnflag WHEN 'A' THEN 'KILL' WHEN 'R' THEN 'KEEP' ELSE 'maybe' END AS verdict, l_linenumber + 1 AS confidence, concat('Order  ', l_orderkey, CASE WHEN l_linestatus = 'O' THEN ' x' ELSE '' END) AS quote, l_linenumber AS seq FROM lineitem),
g AS (SELECT * FROM j WHERE verdict = 'KEEP' OR (verdict = 'KILL' AND confidence BETWEEN 1 AND 5) QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC, verdict, confidence NULLS FIRST, quote NULLS FIRST) = 1)
SELECT o_orderkey AS id, CASE WHEN verdict IS NULL THEN 'missing' WHEN verdict = 'KEEP' THEN 'kept' WHEN confidence >= 5 AND quote NOT LIKE '% x' THEN 'killed' ELSE 'held' END AS outcome FROM orders LEFT JOIN g ON g.id = o_orderkey"""
)
def judge_decisions(spark, sf):
    lines = table(spark, sf, "lineitem").selectExpr("l_orderkey AS id", "CASE l_returnflag WHEN 'A' THEN 'KILL' WHEN 'R' THEN 'KEEP' ELSE 'maybe' END AS verdict", "l_linenumber + 1 AS confidence", "concat('Order  ', l_orderkey, CASE WHEN l_linestatus = 'O' THEN ' x' ELSE '' END) AS quote", "l_linenumber AS seq")
    expected = table(spark, sf, "orders").selectExpr("o_orderkey AS id", "concat('this is order\\n', o_orderkey, ' of a customer') AS text")
    return L.decide(lines, expected)


@q(
    """WITH l AS (SELECT l_orderkey AS id, count(*) AS n, bool_or(l_returnflag = 'N' AND l_quantity > 45) AS kind, bool_or(l_discount > 0.09 AND l_quantity < 5) AS quote, bool_or(l_linenumber > 6) AS idx FROM lineitem GROUP BY l_orderkey)
SELECT id, CASE WHEN n = 5 THEN 'failed' WHEN n = 4 THEN 'seniority' WHEN n > 12 THEN 'too many requirements' WHEN kind THEN 'kind' WHEN quote THEN 'quote' WHEN idx THEN 'index' END AS fault FROM l"""
)
def result_faults(spark, sf):
    lines = table(spark, sf, "lineitem").selectExpr("l_orderkey AS id", "l_linenumber AS k", "CASE WHEN l_returnflag = 'N' AND l_quantity > 45 THEN 'other' ELSE 'skill' END AS kind", "CASE WHEN l_discount > 0.09 AND l_quantity < 5 THEN 'not there' ELSE 'A  Line' END AS quote", "l_linenumber > 6 AS far")
    grouped = lines.groupBy("id").agg(F.collect_list(F.struct("kind", F.lit("required").alias("strength"), "quote")).alias("requirements"), F.max("far").alias("far"), F.count(F.lit(1)).alias("n"))
    facts = F.struct("requirements", F.when(F.col("n") == 4, "odd").otherwise("senior").alias("seniority"))
    compared = F.array(F.struct(F.when(F.col("far"), 99).otherwise(0).alias("requirement"), F.lit("supported").alias("finding")))
    result = F.struct(F.when(F.col("n") == 5, "timeout").alias("failed"), facts.alias("posting_facts"), compared.alias("profile_comparison"))
    rows = grouped.select("id", result.alias("r"))
    return rows.select("id", L.result_fault(F.col("r"), F.lit("text with a line in it"), {"seniority": ("junior", "senior")}).alias("fault"))


@q(
    """WITH c AS (SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'approved' ELSE 'candidate' END AS status, c_custkey % 6 AS k FROM customer)
SELECT id, CASE WHEN k IN (0, 1) AND status = 'candidate' THEN 'inactive' ELSE status END AS new_status, CASE WHEN k IN (0, 1) AND status = 'candidate' THEN CASE k WHEN 0 THEN 'screen: no fit' ELSE 'screen-dup: clear mismatch' END END AS status_reason FROM c"""
)
def screen_drops(spark, sf):
    rows = table(spark, sf, "customer").selectExpr("c_custkey AS id", "CASE c_mktsegment WHEN 'BUILDING' THEN 'approved' ELSE 'candidate' END AS status", "c_custkey % 6 AS k")
    reply = F.when(F.col("k") == 0, 'Sure: {"keep": false, "reason": " no fit "}').when(F.col("k") == 1, '{"keep": "drop"}').when(F.col("k") == 2, '{"keep": true}').when(F.col("k") == 3, "{keep: no").when(F.col("k") == 4, "none")
    judged = rows.select("id", "k", L.screen_verdict(reply).alias("v"))
    drops = judged.where("not v.keep").select("id", "v.reason", F.when(F.col("k") == 1, "dup").otherwise("llm").alias("kind"))
    return L.apply_drops(rows, drops).select("id", "new_status", "status_reason")


@q("SELECT id, CASE WHEN status = 'unseen' AND company_id IN (SELECT company_key FROM company WHERE segment = 'BUILDING') THEN 'archived' ELSE status END AS new_status FROM vacancy", "vacancy", "company")
def inactive_employers(spark, sf):
    companies = bound(spark, sf, "company").withColumn("status", F.when(F.col("segment") == "BUILDING", "inactive").otherwise("approved"))
    return L.archive_inactive(bound(spark, sf, "vacancy"), companies).select("id", "new_status")


@q(
    """SELECT id, CASE WHEN k = 0 THEN 'conflict' WHEN k = 1 THEN 'same' WHEN k = 2 THEN 'created' ELSE 'saved' END AS outcome, CASE WHEN k = 0 THEN concat('n', id) WHEN k = 1 THEN concat('n', id) ELSE concat('m', id) END AS notes, CAST(CASE WHEN k = 3 THEN 1 ELSE 0 END AS INT) AS past FROM (SELECT id, id % 4 AS k FROM vacancy)""",
    "vacancy",
)
def application_notes(spark, sf):
    v = bound(spark, sf, "vacancy").select("id", (F.col("id") % 4).alias("k"))
    held = v.where("k <> 2").select("id", F.concat(F.lit("n"), F.col("id")).alias("notes"), F.array().cast("array<struct<recorded_at:date,notes:string>>").alias("history"))
    asked = v.select("id", F.concat(F.when(F.col("k") == 1, "n").otherwise("m"), F.col("id")).alias("notes"), F.when(F.col("k") == 0, "other").when(F.col("k") == 2, "").otherwise(F.concat(F.lit("n"), F.col("id"))).alias("expected"))
    return L.save_notes(held, asked, F.expr(AS_OF)).select("id", "outcome", "notes", F.size("history").alias("past"))


@q("SELECT id, status, deadline FROM vacancy ORDER BY deadline DESC NULLS LAST, id LIMIT 500", "vacancy")
def status_view(spark, sf):
    return L.ordered_view(bound(spark, sf, "vacancy"), ["status", "deadline"], "deadline").limit(500)


@q(
    """+a AS (SELECT company_id, min(id) AS posting FROM vacancy WHERE status = 'applied' GROUP BY company_id)
SELECT v.id, c.company, a.posting IS NOT NULL AS applied, CASE WHEN c.nation % 2 = 0 THEN 'EU' ELSE 'US' END AS best_region, CAST(CASE WHEN c.nation % 2 = 0 THEN 2 ELSE 1 END AS INT) AS n_places FROM vacancy v LEFT JOIN company c ON c.company_key = v.company_id LEFT JOIN a ON a.posting = v.id""",
    "vacancy",
    "company",
)
def dashboard_rows(spark, sf):
    v, c = bound(spark, sf, "vacancy"), bound(spark, sf, "company")
    places = F.when(F.col("nation") % 2 == 0, F.expr("array(named_struct('region', 'US', 'city', 'X', 'country', 'Us'), named_struct('region', 'EU', 'city', 'Y', 'country', 'Eu'))")).otherwise(F.expr("array(named_struct('region', 'US', 'city', 'X', 'country', 'Us'), named_struct('region', 'ZZ', 'city', 'X', 'country', 'Us'))"))
    located = v.join(c.select("company_key", "nation"), v["company_id"] == c["company_key"], "left").select("id", "company_id", places.alias("locations"))
    applied = v.where("status = 'applied'").groupBy("company_id").agg(F.min("id").alias("posting")).select("posting")
    shown = J.denormalise(located, c, applied, ("EU", "US"))
    return shown.select("id", "company", F.col("posting").isNotNull().alias("applied"), "best_region", F.size("places").alias("n_places"))


@q(
    f"""SELECT company_id, kind, key, first(id ORDER BY d DESC, first_seen, id) AS id FROM (SELECT p_partkey AS id, p_brand AS company_id, status IN ({DECIDED}) AS d, first_seen, unnest(['exact', 'norm', 'url']) AS kind,
unnest([substring(md5(lower(p_brand || '|' || p_name)), 1, 16), substring(md5(lower(p_brand || '|' || list_reduce(list_transform(str_split(lower(p_name), ' '), lambda w: CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN w[: length(w) - 3] || 'y' WHEN length(w) > 3 AND w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is)$') THEN w[: length(w) - 1] ELSE w END), lambda a, b: a || ' ' || b))), 1, 16), 'https://e.org/' || p_size]) AS key
FROM (SELECT *, CASE WHEN p_size % 5 = 0 THEN 'liked' ELSE 'unseen' END AS status, DATE '2001-01-01' + CAST(p_size AS INT) AS first_seen FROM part)) GROUP BY ALL"""
)
def key_index(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey AS id", "p_brand AS company_id", "p_brand AS org", "p_name AS title", "'' AS description", "array(concat('HTTPS://e.org/', p_size, '/?utm_source=a')) AS urls", "CASE WHEN p_size % 5 = 0 THEN 'liked' ELSE 'unseen' END AS status", "date_add(DATE '2001-01-01', CAST(p_size AS INT)) AS first_seen")
    return J.key_index(rows)
