"""Queries that run as streams: the table of events is read as it would land, keyed state is kept, and what came out is read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roleflow.plans.bindings import Registry, bound
from roleflow.session import ensure_checkpoint_dir
from roleflow.streaming import events as E
from roleflow.streaming import processors as P

REGISTRY = Registry()
q = REGISTRY.add


def streamed(spark: SparkSession, sf: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that ``make`` appends to a stream of the landed events, from a start without state."""
    P.keyed_state(spark)
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = E.observed(spark, sf, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double", "events.parquet")
    out = make(source)
    query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


_EVENT = "SELECT user_id AS key, epoch_us(ts) // 1000 AS ms, event_id AS id, event_type AS status FROM events"


@q(
    f"""WITH e AS ({_EVENT}), m AS (SELECT *, lag(status) OVER (PARTITION BY key ORDER BY ms, id) AS previous, row_number() OVER (PARTITION BY key ORDER BY ms, id) AS r FROM e),
c AS (SELECT * FROM m WHERE r = 1 OR previous IS DISTINCT FROM status)
SELECT key, id, ms, previous, status, lag(ms) OVER (PARTITION BY key ORDER BY ms, id) AS since, row_number() OVER (PARTITION BY key, status ORDER BY ms, id) AS times FROM c"""
)
def status_stream(spark, sf):
    return streamed(spark, sf, lambda s: P.status_log(s.select(F.col("user_id").alias("key"), F.unix_millis("ts").alias("ms"), F.col("event_id").alias("id"), F.col("event_type").alias("status"))))


@q(
    """WITH e AS (SELECT user_id AS source, epoch_us(ts) // 1000 AS ms FROM events), d AS (SELECT DISTINCT * FROM e),
n AS (SELECT *, lead(ms) OVER (PARTITION BY source ORDER BY ms) AS next FROM d)
SELECT source, ms AS last_ms, ms + 2 * 86400000 AS stale_ms FROM n
WHERE next - ms > 2 * 86400000 OR next IS NULL AND ms + 2 * 86400000 <= (SELECT max(ms) FROM e) - 86400000"""
)
def silent_sources(spark, sf):
    """Users of the month that the table covers, silent for two days."""
    return streamed(spark, sf, lambda s: P.silent_sources(s.select(F.col("user_id").alias("source"), "ts"), 2))


@q(
    """WITH d AS (SELECT source, epoch_ms(CAST(day AS TIMESTAMP)) AS ms, count(*) FILTER (WHERE status <> 'view') AS n, count(*) FILTER (WHERE status = 'error') AS errored, count(*) FILTER (WHERE status IN ('click', 'purchase')) AS live
  FROM (SELECT user_id AS source, event_type AS status, CAST(ts AS DATE) AS day FROM events) GROUP BY source, day),
r AS (SELECT *, min(n) OVER w AS low, max(n) OVER w AS high FROM d WINDOW w AS (PARTITION BY source ORDER BY ms ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT source, ms AS run, ms, n, low, high,
       CASE WHEN n = 0 THEN 'nothing new' WHEN errored > 0 AND live = 0 THEN 'all failed' WHEN low IS NULL THEN 'no baseline' WHEN n BETWEEN low AND high THEN 'in range' ELSE 'out of range' END AS verdict FROM r"""
)
def run_verdicts(spark, sf):
    """The processor over a frame: one batch of all runs."""
    count = lambda c: F.count_if(c).cast("long")
    ms = F.unix_millis(F.col("day").cast("timestamp"))
    daily = bound(spark, sf, "seen").groupBy("source", "day").agg(count(F.col("status") != "view").alias("n"), count(F.col("status") == "error").alias("errored"), count(F.col("status").isin("click", "purchase")).alias("live"))
    return P.run_verdicts(daily.select("source", ms.alias("ms"), ms.alias("id"), "n", F.lit(True).alias("enabled"), "errored", "live"))


@q(
    """WITH e AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS ms, event_id AS id, CASE event_type WHEN 'signup' THEN 'reviewed' WHEN 'purchase' THEN 'decided' ELSE 'skipped' END AS kind FROM events),
c AS (SELECT key, max(ms) FILTER (WHERE kind = 'reviewed') AS cursor_ms FROM e GROUP BY key),
o AS (SELECT key, count(*) AS open, min_by(id, (ms, id)) AS first_id FROM e JOIN c USING (key) WHERE kind = 'decided' AND (cursor_ms IS NULL OR ms > cursor_ms) GROUP BY key)
SELECT key, cursor_ms, coalesce(open, 0) AS open, first_id FROM c LEFT JOIN o USING (key)"""
)
def review_cursors(spark, sf):
    """The processor over a frame: the cursors after all events."""
    kind = F.when(F.col("status") == "signup", "reviewed").when(F.col("status") == "purchase", "decided").otherwise("skipped")
    return P.review_cursor(bound(spark, sf, "seen").select(F.col("source").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "id", kind.alias("kind")))
