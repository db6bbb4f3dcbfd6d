"""Orders, top-k, cohorts, batches and pages. Every order ends with an id, so ties have one result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roleflow import vocabulary as V
from roleflow.session import cut


def numbered(rows: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """``rows`` with ``name``: their place from 1 in a total order, which no task sees as a whole.

    Rows are dealt by ranges of the order and written once, so that the ranges stay what they are; a place is that inside
    the range and the rows of the ranges before it, of which there is one count each.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    upto = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = dealt.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_in", inside).join(before, "_range").withColumn(name, F.col("_in") + F.col("_before")).drop("_range", "_in", "_before")


def numbered_within(rows: DataFrame, group: str, order: Sequence[Column | str], name: str) -> DataFrame:
    """``rows`` with ``name``: their place from 1 inside their group, of which one may hold most rows. Null is a group.

    Groups stand one after the other in one order: a place in a group is the place in all less the groups before, a row each.
    """
    placed = numbered(rows, [F.asc_nulls_first(group), *order], "_all")
    before = W.orderBy(F.asc_nulls_first("_group")).rowsBetween(W.unboundedPreceding, -1)
    sizes = placed.groupBy(F.col(group).alias("_group")).count().select("_group", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_skip"))
    joined = placed.join(sizes, F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn(name, (F.col("_all") - F.col("_skip")).cast("int")).drop("_all", "_skip", "_group")


def due_first(rows: DataFrame, as_of: Column, top: int) -> DataFrame:
    """Employers to fetch: overdue and engaged, then overdue, then never fetched; most overdue first."""
    age = F.datediff(as_of, F.col("last_fetched"))
    ratio = F.round(age.cast("double") / F.col("ttl_days").cast("double"), 4)
    cohort = F.when(age.isNull(), 2).when((ratio >= 1) & F.col("engaged"), 0).when(ratio >= 1, 1)
    due = rows.withColumn("cohort", cohort).withColumn("ratio", ratio).where("cohort is not null")
    return due.orderBy("cohort", F.desc_nulls_last("ratio"), "name").limit(top)


def round_robin(rows: DataFrame, stratum: Sequence[str], order: Sequence[str], top: int) -> DataFrame:
    """The ``top`` rows that come up when the strata take turns, each in its own order."""
    w = W.partitionBy(*stratum).orderBy(*order)
    # No row can come up after more turns than rows are asked for; the bound lets each task keep its first ones only.
    return rows.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= top).orderBy("turn", *stratum).limit(top)


def seeds(rows: DataFrame, positive: Column, top: int) -> DataFrame:
    """All positives before negatives, the most recent first, up to ``top``."""
    return rows.withColumn("positive", positive).orderBy(F.desc("positive"), F.desc("first_seen"), "id").limit(top)


def balanced_seeds(rows: DataFrame, positive: Column, richness: Column, top: int) -> DataFrame:
    """Half of each class by richest content; what one class lacks comes from the other."""
    marked = rows.withColumn("positive", positive).withColumn("rich", richness)
    w = W.partitionBy("positive").orderBy(F.desc("rich"), "id")
    placed = marked.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top)
    return placed.orderBy(F.col("rn") > top // 2, F.desc("positive"), "rn").limit(top)


def today(rows: DataFrame, as_of: Column) -> DataFrame:
    """Route postings to the lists of the day, each with its own order."""
    s, d = F.col("status"), F.col("deadline")
    soon = d.between(as_of, F.date_add(as_of, 7))
    name = (
        F.when(s == "archived", "hidden")
        .when(d < as_of, "expired")
        .when(s == "expiring", "expiring")
        .when(s.isin(*V.APPLICATION), "applied")
        .when((s == "liked") & soon, "urgent")
        .when(s == "liked", "liked")
        .when((s == "unseen") & (F.col("score") >= V.PROTECT_SCORE), "new")
        .otherwise("rest")
    )
    order = [F.asc_nulls_last("deadline"), F.desc_nulls_last("score"), F.asc("id")]
    return numbered_within(rows.withColumn("list", name), "list", order, "place")


def review_sections(rows: DataFrame, section: str, as_of: Column) -> DataFrame:
    """Sections by their nearest open deadline, numbered; those without one come last and have no number."""
    days = F.datediff("deadline", as_of)
    nearest = rows.groupBy(section).agg(F.min(F.when(days >= 0, days)).alias("days"), F.count(F.lit(1)).alias("n"))
    w = W.orderBy(F.asc_nulls_last("days"), section)
    return nearest.withColumn("number", F.when(F.col("days").isNotNull(), F.row_number().over(w)))


def batches(rows: DataFrame, order: Sequence[Column], size: int) -> DataFrame:
    """Rows with the number of their batch in a global order that ends with an id."""
    return numbered(rows, order, "_place").withColumn("batch", F.floor((F.col("_place") - 1) / size)).drop("_place")


def page(rows: DataFrame, order: Sequence[Column], size: int, number: int) -> DataFrame:
    """A page of ``size`` rows with whether another follows."""
    found = rows.orderBy(*order).offset(size * number).limit(size + 1)
    n = found.withColumn("_r", F.row_number().over(W.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy()))
    return n.where(F.col("_r") <= size).withColumn("more", F.col("_n") > size).drop("_r", "_n")


def audit_sample(rows: DataFrame, sure: Column, score: Column, threshold: int, share: float, seed: str) -> DataFrame:
    """All sure and all well scored rows, and ``share`` of the rest in the order of a seeded hash."""
    rest = ~(sure | F.coalesce(score >= threshold, F.lit(False)))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("id").cast("string")))
    marked = rows.withColumn("_rest", rest).withColumn("_key", key)
    drawn = numbered(marked.where("_rest"), ["_key", "id"], "_place")
    n = drawn.count()
    half_up = int(n * share + 0.5)
    return marked.where("not _rest").unionByName(drawn.where(F.col("_place") <= half_up).drop("_place")).drop("_rest", "_key")


def grouped_by_best(rows: DataFrame, key: str) -> DataFrame:
    """Rows with the place of their group by its best score, and their own inside it."""
    groups = rows.groupBy(key).agg(F.max("score").alias("best"))
    # Only the groups, a row each, are put in one order.
    ranked = groups.withColumn("group_place", F.row_number().over(W.orderBy(F.desc_nulls_last("best"), key)))
    return numbered_within(rows, key, [F.desc_nulls_last("score"), "id"], "place").join(ranked, key)


def applications(rows: DataFrame, key: Sequence[str], as_of: Column) -> DataFrame:
    """One application a key, the last sent; days waited while it is open."""
    w = W.partitionBy(*key).orderBy(F.desc_nulls_last("sent"), "id")
    one = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return one.withColumn("waiting_days", F.when(F.col("status") == "applied", F.datediff(as_of, "sent")))


def pack(rows: DataFrame, group: str, order: str, text: str, limit: int) -> DataFrame:
    """Lines packed in order into parts of ``limit`` characters at most; a longer line is cut. A group is one message, so it is small."""
    cut = F.substring(text, 1, limit)
    lines = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, cut.alias("line")))).alias("lines"))
    fold = F.aggregate(
        F.transform("lines", lambda x: x["line"]),
        F.array().cast("array<string>"),
        lambda parts, line: F.when(
            (F.size(parts) > 0) & (F.length(F.element_at(parts, -1)) + 1 + F.length(line) <= limit),
            F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(F.concat_ws("\n", F.element_at(parts, -1), line))),
        ).otherwise(F.concat(parts, F.array(line))),
    )
    return lines.select(group, F.posexplode(fold).alias("part", "text"))
