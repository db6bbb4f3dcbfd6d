"""Entity resolution: duplicate clusters inside and across employers, folding of places and rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roleflow import vocabulary as V
from roleflow.functions import keys as K
from roleflow.functions.naming import let
from roleflow.operators.graph import connected_components
from roleflow.operators.lookalike import similarity, title_pairs  # noqa: F401


def hub_edges(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Edges from the first holder of each ``company_id, key`` to its later holders; later ones are not compared with each other."""
    first = rows.groupBy(F.col("company_id").alias("_company"), F.col("key").alias("_key")).agg(F.min_by("id", F.struct(*order)).alias("hub"))
    joined = rows.join(first, F.col("company_id").eqNullSafe(F.col("_company")) & F.col("key").eqNullSafe(F.col("_key")))
    return joined.where("id <> hub").select(F.col("hub").alias("src"), F.col("id").alias("dst")).distinct()


def clusters(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``id, cluster`` of rows that hold keys in common, directly or by others; a row alone is its own cluster."""
    found = connected_components(hub_edges(rows, order))
    ids = rows.select("id").distinct()
    return ids.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))


def review_disposition(members: DataFrame, as_of: Column) -> DataFrame:
    """Clusters of ``cluster, id, status, last_seen, urls``: manual with several applications, or several live rows that nothing holds together.

    Live rows are held together by a link that all of them have, and where ``members`` has these columns also by a requisition of all (``reqs``), or, two rows, by
    the one's whole title being a segment of the other's (``norm``, ``seg``) unless their bodies say otherwise (``desc``, ``body_len``). Keys are counted, so a
    cluster's rows never meet in one list.
    """
    has = set(members.columns)
    live = F.col("status").isin("unseen", "liked") & (F.col("last_seen") >= F.date_sub(as_of, V.STALE_DAYS))
    facts = [c for c in ("norm", "seg", "desc", "body_len") if c in has]
    pair = F.struct("id", *facts)
    grouped = members.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("status").isin(*V.APPLICATION)).alias("applications"),
        F.count_if(live).alias("live"),
        F.min_by(pair, F.when(live, F.col("id"))).alias("a"),
        F.max_by(pair, F.when(live, F.col("id"))).alias("b"),
    )
    named = lambda kind, c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.concat(F.lit(kind), x))
    keys = F.array_distinct(F.concat(named("url ", "urls"), *([named("req ", "reqs")] if "reqs" in has else [])))
    held = members.where(live).select("cluster", F.explode(keys).alias("key")).where("key is not null").groupBy("cluster", "key").count()
    held = held.groupBy("cluster").agg(F.max("count").alias("held"))
    together = F.coalesce(F.col("held") == F.col("live"), F.lit(False))
    if {"norm", "seg"} <= has:
        segment = F.array_contains("b.seg", F.col("a.norm")) | F.array_contains("a.seg", F.col("b.norm"))
        sized = (F.col("a.body_len") > 0) & (F.col("b.body_len") > 0) & (F.least("a.body_len", "b.body_len") * 3 >= F.greatest("a.body_len", "b.body_len"))
        differs = F.coalesce((F.col("a.desc") != F.col("b.desc")) & sized, F.lit(False)) if {"desc", "body_len"} <= has else F.lit(False)
        together |= (F.col("live") == 2) & F.coalesce(segment, F.lit(False)) & ~differs
    manual = (F.col("applications") >= 2) | ((F.col("live") >= 2) & ~together)
    judged = grouped.where("n > 1").join(held, "cluster", "left")
    return judged.select("cluster", "n", "applications", "live", F.when(manual, "manual").otherwise("merge").alias("disposition"))


def same_role_title(a: Column, b: Column, body_a: Column, body_b: Column) -> Column:
    """Whether two titles at one link are one role: contained, or alike in words, with bodies of a like length."""
    words = lambda c: F.array_distinct(F.split(K.strong_title(c), " "))
    x, y = words(a), words(b)
    both = F.size(F.array_intersect(x, y))
    jaccard = both.cast("double") / F.size(F.array_union(x, y)).cast("double")
    subset = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    n, m = F.length(body_a), F.length(body_b)
    sizes = F.coalesce(F.least(n, m) * 3 >= F.greatest(n, m), F.lit(True))
    return (subset | (jaccard >= 0.5)) & sizes


def repoint(children: DataFrame, moved: DataFrame, key: str) -> DataFrame:
    """Child rows with their parent replaced by its survivor; ``moved`` has ``loser, survivor``."""
    joined = children.join(moved, children[key] == moved["loser"], "left")
    return joined.select(*[F.coalesce("survivor", key).alias(c) if c == key else F.col(c) for c in children.columns])


def merge_companies(companies: DataFrame, moved: DataFrame) -> DataFrame:
    """Employers with losers dropped and their names and aliases, case aside, among the survivor's."""
    low = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)
    gone = companies.join(moved, companies["id"] == moved["loser"]).groupBy("survivor").agg(F.flatten(F.collect_list(F.array_append(low(F.col("aliases")), F.lower("name")))).alias("more"))
    kept = companies.join(moved, companies["id"] == moved["loser"], "left_anti").join(gone, F.col("id") == F.col("survivor"), "left")
    every = F.array_distinct(F.concat(low(F.col("aliases")), F.coalesce("more", F.array().cast("array<string>"))))
    return kept.select("id", "name", F.array_sort(F.filter(every, lambda a: a != F.lower("name"))).alias("aliases"))


def fold_places(places: Column) -> Column:
    """Places of ``array<struct<url,city,country>>`` folded by link: an entry without a place gives way to one of its link with a place."""
    keyed = F.transform(places, lambda x: F.struct(K.apply_url(x["url"]).alias("url"), x["city"].alias("city"), x["country"].alias("country")))
    bare = lambda x: x["city"].isNull() & x["country"].isNull()

    def folded(each: Column, placed: Column) -> Column:
        # Each place once before they meet, so that links seen many times cost no more than different ones.
        links = F.transform(placed, lambda p: p["url"])
        return F.concat(placed, let(links, lambda urls: F.filter(each, lambda x: bare(x) & ~F.array_contains(urls, x["url"]))))

    return let(F.array_distinct(keyed), lambda each: let(F.filter(each, lambda x: ~bare(x)), lambda placed: folded(each, placed)))


def triage(rows: DataFrame, priority: Sequence[str]) -> DataFrame:
    """One row a key, of the first status in ``priority``, with the freshest sight and the review of any row."""
    order = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("status"))
    rank = F.when(order == 0, len(priority) + 1).otherwise(order)
    everyone = W.partitionBy("key")
    w = everyone.orderBy(rank, "id")
    full = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    marked = rows.withColumn("_r", F.row_number().over(w)).withColumn("freshest", F.max("last_seen").over(everyone)).withColumn("any_review", F.first("review", ignorenulls=True).over(full))
    return marked.where("_r = 1").drop("_r", "last_seen", "review").withColumnsRenamed({"freshest": "last_seen", "any_review": "review"})


def resolve(batch: DataFrame, index: DataFrame) -> DataFrame:
    """The stored row that each fetched posting is, if any: ``id, match, kind`` by the first kind of key that hits.

    ``batch`` has ``id, company_id, kind, key`` rows, ``index`` is :func:`roleflow.operators.joins.key_index`. A stored row is
    taken by one posting of the batch only: the one of the strongest kind, then the smallest id; the others stay new.
    """
    strength = F.array_position(F.array(*[F.lit(k) for k in ("exact", "req", "url", "norm", "desc", "seg")]), F.col("kind"))
    hits = batch.join(index.withColumnRenamed("id", "match"), ["company_id", "kind", "key"]).withColumn("s", strength)
    mine = hits.withColumn("_r", F.row_number().over(W.partitionBy("id").orderBy("s", "match"))).where("_r = 1")
    taken = mine.withColumn("_t", F.row_number().over(W.partitionBy("match").orderBy("s", "id"))).where("_t = 1")
    ids = batch.select("id").distinct()
    return ids.join(taken.select("id", "match", "kind"), "id", "left")
