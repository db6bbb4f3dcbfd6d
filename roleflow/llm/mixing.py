"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roleflow.session import cut

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Settings:
    """``rows``: about how many rows of one source, or of one stretch of the queue, are summed in one task."""

    weights: tuple[int, ...] = (1, 2, 3)
    repeats: int = 3
    share: float = 1.0
    rows: int = 20000
    #: Sources up to which their table is broadcast.
    few: int = 10000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row a source: ``source, source_size, weight, rank, target, level``.

    ``level`` is the virtual time at which the budget is used up: a source gets weight times level words, or
    ``repeats`` times its size where that is less, and what it cannot give goes to the others by weight.
    """
    weights = F.array(*[F.lit(w) for w in settings.weights])
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    named = sums.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", F.get(weights, (F.col("rank") - 1) % len(settings.weights)))
    full = named.withColumn("cap", settings.repeats * F.col("source_size"))
    # In order of the time at which they run dry, the first source that outlasts the level fixes it.
    dry = W.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    rest = W.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    budget = F.sum("source_size").over(everything) * F.lit(settings.share)
    level = (budget - F.coalesce(F.sum("cap").over(dry), F.lit(0))) / F.sum("weight").over(rest)
    tried = full.withColumn("try", level)
    kept = F.when(F.col("try") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "try"))
    settled = tried.withColumn("level", F.coalesce(F.min(kept).over(everything)["try"], F.max(F.col("cap") / F.col("weight")).over(everything)))
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level"))
    return settled.select("source", "source_size", "weight", "rank", target.alias("target"), F.col("level").cast("double").alias("level"))


def mix(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, mark, source, size, source_size, target, taken`` for every row of ``docs(doc_id, source, text)``.

    ``mark`` is a hash of the text. A document's virtual finish time is its source's words up to it, in the order of a hash of doc_id,
    over the source's weight; a second and third pass over the source follow on. Copies enter the mix by that time
    until the next one would exceed the budget. Null text has size 0; null source is a source of its own, the
    last; rows that agree in everything are taken in any order, which their result does not show. An
    empty table gives no rows; without any words all targets are 0.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = cut(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", F.xxhash64("text").alias("mark"), size_of(F.col("text")).alias("size"), key.alias("key")))
    plan = cut(targets(sized, settings))
    n_rows, n_sources = sized.count(), plan.count()
    small = F.broadcast if n_sources <= settings.few else (lambda df: df)
    stretches = max(16, n_rows // settings.rows)

    # The queue of each source: sums of stretches of the hash order first, then within a stretch.
    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * stretches / F.lit(1 << 32)).alias("part")
    queued = sized.select("*", part)
    sums = queued.groupBy("source", "part").agg(F.sum("size").alias("words"))
    sums = sums.select("source", "part", (F.sum("words").over(W.partitionBy("source").orderBy("part")) - F.col("words")).alias("ahead"))
    q, s = queued.alias("q"), sums.alias("s")
    queued = q.join(s, F.col("q.source").eqNullSafe(F.col("s.source")) & (F.col("q.part") == F.col("s.part"))).select("q.*", "s.ahead")
    order = W.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    queued = queued.withColumn("done", F.col("ahead") + F.sum("size").over(order))
    q, p = queued.alias("q"), small(plan).alias("p")
    queued = q.join(p, F.col("q.source").eqNullSafe(F.col("p.source"))).select("q.row", "q.doc_id", "q.mark", "q.source", "q.size", "q.key", "q.done", "p.source_size", "p.weight", "p.rank", "p.target", "p.level")

    # One queue of all sources' copies, again by sums of stretches.
    copies = queued.select("*", F.explode(F.sequence(F.lit(0), F.lit(settings.repeats - 1))).alias("copy"))
    copies = copies.withColumn("time", (F.col("done") + F.col("copy") * F.col("source_size")) / F.col("weight"))
    copies = copies.withColumn("part", F.when(F.col("level") > 0, F.floor(F.col("time") / F.col("level") * stretches)).otherwise(F.lit(0)))
    sums = copies.groupBy("part").agg(F.sum("size").alias("words"))
    sums = sums.select("part", (F.sum("words").over(W.orderBy("part")) - F.col("words")).alias("before"))
    order = W.partitionBy("part").orderBy("time", "rank", "copy", "key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    copies = copies.join(sums, "part").withColumn("upto", F.col("before") + F.sum("size").over(order))
    budget = plan.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"] * settings.share
    taken = F.sum(F.when(F.col("upto") <= F.lit(budget), F.col("size")).otherwise(F.lit(0)))
    return copies.groupBy("row", "doc_id", "mark", "source", "size", "source_size", "target").agg(taken.alias("taken")).drop("row")


def mixed(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``size, source_size, target, taken``.

    Rows that agree in doc_id and text share evenly, in whole words, what the mix takes of them.
    """
    names = ("size", "source_size", "target", "taken")
    plan = mix(docs, settings).groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(
        F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.expr("sum(taken) div count(*)").alias("taken")
    )
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in names]).alias("row")
    rows = docs.select(whole, F.xxhash64("text").alias("own"))
    both = rows.join(plan.where("taken > 0"), (F.col("own") == F.col("_mark")) & F.col("row.doc_id").eqNullSafe(F.col("_id")))
    return both.select("row.*", *names)


#: The same in SQL over a table ``documents``.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS cap,
         row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM sized GROUP BY source),
weighted AS (SELECT *, 1 + (rk - 1) % 3 AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS budget FROM named),
tried AS (
  SELECT *, (budget - coalesce(CAST(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
            / CAST(sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighted),
settled AS (SELECT (SELECT level FROM tried WHERE level * weight <= cap ORDER BY cap / weight, rk LIMIT 1) AS level),
plan AS (SELECT t.source, t.source_size, t.rk, t.weight, t.budget, least(CAST(t.cap AS DOUBLE), t.weight * s.level) AS target FROM tried t, settled s),
queued AS (
  SELECT s.*, p.source_size, p.weight, p.rk, p.target, p.budget,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS done
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
copies AS (SELECT *, CAST(done + c.copy * source_size AS DOUBLE) / weight AS t FROM queued, (SELECT unnest([0, 1, 2]) AS copy) c),
summed AS (SELECT *, CAST(sum(size) OVER (ORDER BY t, rk, copy, k, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM copies)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN upto <= budget THEN size ELSE 0 END) AS BIGINT) AS taken
FROM summed GROUP BY doc_id, source, size, source_size, target
"""
