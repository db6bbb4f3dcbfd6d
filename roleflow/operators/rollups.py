"""Aggregations of postings, employers, boards and runs. Frames carry the columns that each docstring names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roleflow import vocabulary as V


def n(condition: Column) -> Column:
    return F.count_if(condition)


def mean1(value: Column) -> Column:
    return F.round(F.avg(value), 1)


def counts_by_domain(rows: DataFrame, column: str, domain: Sequence[str], other: str | None = None) -> DataFrame:
    """``column, n`` for every value of ``domain``, zero included; values outside it are left out, or counted as ``other``."""
    known = F.when(F.col(column).isin(*domain), F.col(column)).otherwise(F.lit(other))
    counted = rows.select(known.alias(column)).where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    names = [*domain, *([other] if other and other not in domain else [])]
    full = rows.sparkSession.createDataFrame([(x,) for x in names], f"{column} string")
    return full.join(counted, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def geo_rollup(rows: DataFrame, keys: Sequence[str], liked: Column, score: Column) -> DataFrame:
    """Rows, liked rows and mean score of each place."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("roles"), n(liked).alias("liked"), mean1(score).alias("avg_score"))


def company_rollup(rows: DataFrame, company: str = "company_id") -> DataFrame:
    """Roles, applyable roles, mean and best score of each employer; ``hot`` and its deadline where the best is high enough."""
    best = F.max(F.struct(F.col("score"), (-F.col("id")).alias("first"), "deadline"))
    applyable = (F.col("score") >= V.APPLYABLE_SCORE) & ~F.col("status").isin(*V.CLOSED)
    rolled = rows.groupBy(company).agg(F.count(F.lit(1)).alias("roles"), n(applyable).alias("applyable"), mean1(F.col("score")).alias("avg_score"), best.alias("best"))
    hot = F.coalesce(F.col("best.score") >= V.HOT_SCORE, F.lit(False))
    return rolled.select(company, "roles", "applyable", "avg_score", F.col("best.score").alias("max_score"), hot.alias("hot"), F.when(hot, F.col("best.deadline")).alias("hot_deadline"))


def band(score: Column) -> Column:
    return F.when(score >= 70, "strong").when(score >= 50, "fair").otherwise("weak")


def score_bands(rows: DataFrame) -> DataFrame:
    """Rows and share of each score band; a missing score is weak."""
    counted = rows.groupBy(band(F.col("score")).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    share = F.round(F.col("n").cast("double") * 100.0 / F.sum("n").over(W.partitionBy()).cast("double"), 1)
    return counted.select("band", "n", share.alias("share"))


def application_counts(rows: DataFrame) -> DataFrame:
    """Applications sent, waiting, in progress, accepted and declined."""
    s = F.col("status")
    return rows.agg(
        n(s.isin(*V.APPLICATION)).alias("sent"),
        n(s == "applied").alias("waiting"),
        n(s.isin("test_task", "interview")).alias("in_progress"),
        n(s == "accepted").alias("accepted"),
        n(s == "declined").alias("declined"),
    )


def latency(rows: DataFrame, as_of: Column) -> DataFrame:
    """Good unseen rows that wait too long (``stuck``), those still in time (``fresh``), and the oldest one's age."""
    age = F.datediff(as_of, F.coalesce("status_updated", "first_seen"))
    waiting = (F.col("status") == "unseen") & (F.col("score") >= V.PROTECT_SCORE)
    return rows.agg(n(waiting & (age >= V.SLA_DAYS)).alias("stuck"), n(waiting & (age <= V.SLA_DAYS)).alias("fresh"), F.max(F.when(waiting, age)).alias("oldest"))


def unscored_counts(rows: DataFrame) -> DataFrame:
    """A negative score waits for one as a missing score does."""
    waiting = F.col("score").isNull() | (F.col("score") < 0)
    unseen = F.col("status") == "unseen"
    return rows.agg(F.count(F.lit(1)).alias("rows"), n(waiting).alias("unscored"), n(waiting & unseen).alias("unscored_unseen"))


def board_counts(rows: DataFrame, since: Column) -> DataFrame:
    return rows.groupBy("board").agg(F.count(F.lit(1)).alias("n"), n(F.col("first_seen") >= since).alias("recent"))


def board_status(boards: DataFrame, rows: DataFrame, as_of: Column) -> DataFrame:
    """Every board with its rows, also without any; ``overdue`` once its age reaches its days to live."""
    counted = rows.groupBy("board").agg(F.count(F.lit(1)).alias("n"))
    age = F.datediff(as_of, F.col("last_fetched"))
    return boards.join(counted, "board", "left").select("board", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce(age >= F.col("ttl_days"), F.lit(True)).alias("overdue"))


def board_health(boards: DataFrame) -> DataFrame:
    """``board, failures, fetched, health``: broken after three failures in a row, empty if fetched without rows."""
    health = F.when(F.col("failures") >= 3, "broken").when(F.col("fetched") & (F.col("n") == 0), "empty").otherwise("ok")
    return boards.withColumn("health", health)


def health_class(c: dict[str, Column], as_of: Column) -> Column:
    """Health of an employer's source, by the first rule that holds."""
    age = F.datediff(as_of, c["last_success"])
    return (
        F.when(c["strategy"] == "board", "BOARD_ONLY")
        .when(c["last_fetched"].isNull(), "NEVER")
        .when(c["failures"] >= 3, "BROKEN")
        .when((age < V.STALE_DAYS) & (c["n"] > 0), "OK")
        .when(age >= V.STALE_DAYS, "STALE")
        .when(c["n"] == 0, "EMPTY")
        .otherwise("UNKNOWN")
    )


def pivot_categories(rows: DataFrame, key: str, categories: Sequence[str], top: int) -> DataFrame:
    """Rows of each category for the ``top`` keys with most rows."""
    per = [n(F.col("category") == c).alias(c) for c in categories]
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"), *per).orderBy(F.desc("total"), key).limit(top)


def ngram_support(rows: DataFrame, sizes: Sequence[int] = (2, 3), least: int = 3, orgs: int = 2) -> DataFrame:
    """Word n-grams of rejected titles in ``title, org`` that occur often enough and at employers enough."""
    words = F.filter(F.split(F.lower("title"), r"[^a-z0-9]+"), lambda w: w != "")
    base = rows.select("org", words.alias("w"))
    none = F.array().cast("array<string>")

    def grams(k: int) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.concat_ws(" ", *[F.get("w", i + j) for j in range(k)]))
        return F.when(F.size("w") >= k, made).otherwise(none)

    spread = base.select("org", F.explode(F.flatten(F.array(*[grams(k) for k in sizes]))).alias("ngram"))
    found = spread.groupBy("ngram").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("org").alias("orgs"))
    return found.where((F.col("hits") >= least) & (F.col("orgs") >= orgs))


def rejecting_orgs(rows: DataFrame, least: int = 5, share: float = 0.8) -> DataFrame:
    counted = rows.groupBy("org").agg(F.count(F.lit(1)).alias("total"), n(F.col("rejected")).alias("rejected"))
    return counted.where((F.col("total") >= least) & (F.col("rejected") > share * F.col("total")))


def filter_words(rows: DataFrame, garbage: Column, good: Column, least: int, top: int) -> DataFrame:
    """Words of garbage titles by the rows that hold them: the ``top`` that no good row holds, and the ``top`` that some do."""
    words = F.filter(F.array_distinct(F.split(F.lower("title"), r"[^a-z0-9]+")), lambda w: F.length(w) >= 3)
    spread = rows.select(garbage.alias("garbage"), good.alias("good"), F.explode(words).alias("word"))
    counted = spread.groupBy("word").agg(n(F.col("garbage")).alias("hits"), n(F.col("good")).alias("good")).where(F.col("hits") >= least)
    counted = counted.withColumn("clean", F.col("good") == 0)
    best = W.partitionBy("clean").orderBy(F.desc("hits"), "word")
    return counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def idle_boards(rows: DataFrame, least: int) -> DataFrame:
    """Boards of ``boards array, good`` that showed ``least`` rows or more, none of them good."""
    spread = rows.select(F.explode(F.array_distinct("boards")).alias("board"), "good")
    return spread.groupBy("board").agg(F.count(F.lit(1)).alias("seen"), n(F.col("good")).alias("good")).where((F.col("seen") >= least) & (F.col("good") == 0))


def confusion(rows: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    """Confusion matrix with agreement, precision, recall and F1; a ratio without cases is null."""
    c = rows.agg(n(actual & predicted).alias("tp"), n(~actual & predicted).alias("fp"), n(actual & ~predicted).alias("fn"), n(~actual & ~predicted).alias("tn"))
    d = {k: F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn")}
    ratio = lambda a, b: F.round(F.try_divide(a, b), 4)
    return c.select(
        "tp", "fp", "fn", "tn",
        ratio(d["tp"] + d["tn"], d["tp"] + d["fp"] + d["fn"] + d["tn"]).alias("agreement"),
        ratio(d["tp"], d["tp"] + d["fp"]).alias("precision"),
        ratio(d["tp"], d["tp"] + d["fn"]).alias("recall"),
        ratio(2 * d["tp"], 2 * d["tp"] + d["fp"] + d["fn"]).alias("f1"),
    )


def disagreements(rows: DataFrame, score: Column, verdict: Column, threshold: int, top: int) -> DataFrame:
    """Rows whose score and verdict differ, farthest from the threshold first."""
    wrong = (score >= threshold) != verdict
    return rows.where(wrong).withColumn("distance", F.abs(score - threshold)).orderBy(F.desc("distance"), "id").limit(top)


def integrity(checks: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """``check, bad``: the rows of each frame of offenders."""
    out = None
    for name, bad in checks:
        one = bad.agg(F.count(F.lit(1)).alias("bad")).select(F.lit(name).alias("check"), "bad")
        out = one if out is None else out.unionByName(one)
    return out


def recount(stored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Keys whose stored count differs from that of the rows, missing counts included."""
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("actual"))
    both = stored.join(counted, key, "left").withColumn("actual", F.coalesce("actual", F.lit(0)).cast("long"))
    return both.where(~F.col("stored").eqNullSafe(F.col("actual")))


def shared_aliases(rows: DataFrame) -> DataFrame:
    """Aliases of ``id, aliases`` that more than one employer claims."""
    spread = rows.select("id", F.explode("aliases").alias("alias")).distinct()
    return spread.groupBy(F.lower("alias").alias("alias")).agg(F.count_distinct("id").alias("claims")).where("claims > 1")


def overlapping_groups(rows: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """Rows of each group; a row may be in several, so they do not add up."""
    return rows.agg(*[n(c).alias(k) for k, c in groups.items()])


def expected_range(runs: DataFrame, value: str, order: str, last: int = 10) -> DataFrame:
    """Least and most of the ``last`` runs before each run of a source, and whether the run lies between them."""
    w = W.partitionBy("source").orderBy(order).rowsBetween(-last, -1)
    ranged = runs.withColumn("low", F.min(value).over(w)).withColumn("high", F.max(value).over(w))
    return ranged.withColumn("in_range", F.coalesce(F.col(value).between(F.col("low"), F.col("high")), F.lit(True)))


def dirty_runs(rows: DataFrame, least: int = 3, share: float = 0.3) -> DataFrame:
    """``run, employer, gone, live`` rolled up to runs that lost too much of an employer."""
    bad = (F.col("gone") >= least) & (F.col("gone") >= share * (F.col("gone") + F.col("live")))
    return rows.groupBy("run").agg(F.sum("gone").alias("gone"), F.sum("live").alias("live"), n(bad).alias("bad_employers"), F.max(bad).alias("dirty"))


def since_cursor(events: DataFrame, closing: Column, counted: Column) -> DataFrame:
    """Events after the latest closing one, all of them where none is."""
    cursor = events.where(closing).agg(F.max("ts").alias("cursor")).first()["cursor"]
    rest = events if cursor is None else events.where(F.col("ts") > F.lit(cursor))
    return rest.agg(F.count(F.lit(1)).alias("events"), n(counted).alias("counted"))


def tier(alignment: Column, score: Column) -> Column:
    """Letter of the weighted mean of two scores, rounded half to even."""
    blend = F.bround(alignment * V.TIER_BLEND[0] + score * V.TIER_BLEND[1], 0)
    out = F.when(blend.isNull(), F.lit(None).cast("string"))
    for letter, least in V.TIERS:
        out = out.when(blend >= least, letter)
    return out.otherwise("C")


def representatives(rows: DataFrame, keys: Sequence[str], text: str = "description") -> DataFrame:
    """One row of each group: one with a description, then the longest, then the smallest id."""
    # A null or empty text has length 0, so the length says also which rows have one; only keys, lengths and ids are grouped.
    best = F.max_by("id", F.struct(F.length(F.coalesce(F.col(text), F.lit(""))), -F.col("id"))).alias("id")
    chosen = rows.groupBy(*keys).agg(best).select("id")
    return rows.join(chosen, "id", "left_semi")


def trim_to_budget(rows: DataFrame, key: str, order: str, text: str, budget: int) -> DataFrame:
    """Sections of a key joined in order; if they exceed ``budget`` characters, each keeps its share from the head."""
    total = F.col("_total")
    sums = rows.groupBy(F.col(key).alias("_key")).agg(F.sum(F.length(text)).alias("_total"))
    keep = F.when(total > budget, F.floor(F.length(text) * F.lit(budget) / total)).otherwise(F.length(text)).cast("int")
    part = rows.join(sums, F.col(key).eqNullSafe(F.col("_key"))).select(key, order, F.substr(F.col(text), F.lit(1), keep).alias("part"))
    parts = F.array_sort(F.collect_list(F.struct(order, "part")))
    return part.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["part"]), "\n").alias("content"))


def verdict_histogram(cleaned: DataFrame) -> DataFrame:
    """Rows of ``verdict, bare`` by verdict: how many, their share in percent, and the characters that are kept."""
    counted = cleaned.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("bare")).alias("chars"))
    share = F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(W.partitionBy()), 2)
    return counted.select("verdict", "n", share.alias("share"), "chars")


def worst_descriptions(cleaned: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rejected descriptions by verdict and employer."""
    # A filter on the verdict itself would go below it, and the verdict be made once more.
    judged = cleaned.select("id", "org", F.explode_outer(F.array("verdict")).alias("verdict"))
    return judged.where("verdict <> 'ok'").orderBy("verdict", "org", "id").limit(top)


def merge_duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Groups of several rows with one key: the survivor, the others, and the fields that it takes from them.

    The survivor has the best status, then the highest score, then the earliest sight, then the smallest id. It gets the longest
    description, the highest score, the first and last sight of all.
    """
    best = F.max_by("id", F.struct(F.col("rank"), F.coalesce("score", F.lit(-1)), -F.unix_date("first_seen"), -F.col("id")))
    grouped = rows.groupBy(key).agg(
        best.alias("survivor"),
        F.array_sort(F.collect_set("id")).alias("ids"),
        F.max("score").alias("score"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.count(F.lit(1)).alias("n"),
    )
    return grouped.where("n > 1").withColumn("losers", F.expr("filter(ids, x -> x <> survivor)")).drop("ids")
