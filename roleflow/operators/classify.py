"""Filter categories of postings, reasons of exclusion, and selections for judging and scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roleflow import vocabulary as V
from roleflow.functions import text as T

CATEGORIES = (
    "delete_blacklist", "delete_company_filter", "delete_not_a_vacancy", "delete_junk", "delete_rearchived",
    "delete_geo", "delete_stale_blind", "reenrich_blind", "reenrich_thin", "ready",
)


def category(c: Mapping[str, Column], words: Sequence[str], stems: Sequence[str], as_of: Column) -> Column:
    """The first category whose rule holds.

    ``c`` has ``title, description, url, first_seen`` and the flags ``company_dropped, manual, rearchived, geo_excluded``. A blind row, with
    a link and no text, is stale once it is more than seven days old; a row without either is thin.
    """
    body = F.length(F.trim(F.coalesce(c["description"], F.lit(""))))
    linked = F.coalesce(c["url"], F.lit("")) != ""
    blind = linked & (body == 0)
    old = F.datediff(as_of, c["first_seen"]) > V.SLA_DAYS
    return (
        F.when(T.blacklist_term(c["title"], words, stems).isNotNull(), "delete_blacklist")
        .when(c["company_dropped"], "delete_company_filter")
        .when(T.not_a_vacancy_reason(c["title"], c["description"]).isNotNull() & ~c["manual"], "delete_not_a_vacancy")
        .when(T.content_junk_reason(c["description"]).isNotNull(), "delete_junk")
        .when(c["rearchived"], "delete_rearchived")
        .when(c["geo_excluded"], "delete_geo")
        .when(blind & old, "delete_stale_blind")
        .when(blind, "reenrich_blind")
        .when(body < T.DESCRIPTION_LEAST, "reenrich_thin")
        .otherwise("ready")
    )


def group_reasons(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``id, category, n, status`` with the reason that their group gives them.

    The group takes the category of its longest text; places exclude a group only if they exclude each of its rows. Only undecided
    rows keep a reason.
    """
    rolled = rows.groupBy(*keys).agg(F.max_by("category", F.struct(F.col("n"), -F.col("id"))).alias("_first"), F.min(F.col("category") == "delete_geo").alias("_geo"))
    group = F.when(F.col("_first") == "delete_geo", F.when(F.col("_geo"), F.col("_first"))).when(F.col("_first").startswith("delete_"), F.col("_first"))
    reasons = rolled.select(*[F.col(k).alias(f"_{k}") for k in keys], group.alias("_reason"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = rows.join(reasons, on, "left")
    return joined.withColumn("reason", F.when(F.col("status") == "unseen", F.col("_reason"))).drop("_reason", *[f"_{k}" for k in keys])


def stamp(rows: DataFrame, reasons: DataFrame) -> DataFrame:
    """Stored against computed reasons: ``id, reason, change`` with stamped, cleared, kept or out_of_scope."""
    joined = rows.join(reasons.select("id", F.col("reason").alias("_new"), F.lit(True).alias("_in")), "id", "left")
    change = (
        F.when(F.col("_in").isNull(), "out_of_scope")
        .when(F.col("stored_reason").eqNullSafe(F.col("_new")), "kept")
        .when(F.col("_new").isNull(), "cleared")
        .otherwise("stamped")
    )
    return joined.select("id", F.when(F.col("_in"), F.col("_new")).otherwise(F.col("stored_reason")).alias("reason"), change.alias("change"))


def functions_of(title: Column, patterns: Mapping[str, str]) -> Column:
    """The function whose pattern alone fits a title, else Other."""
    hits = F.filter(F.array(*[F.when(title.rlike(f"(?i){p}"), F.lit(k)) for k, p in patterns.items()]), lambda x: x.isNotNull())
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0))).otherwise("Other")


def judge_queue(rows: DataFrame, top: int) -> DataFrame:
    """Unseen rows that still need judging: no score or a low one; board rows first, then the oldest; what to ask of each."""
    open_rows = rows.where((F.col("status") == "unseen") & (F.col("score").isNull() | (F.col("score") < V.CATALOGUE_SCORE)))
    asked = F.when(F.col("score").isNull(), "score+facts").otherwise("facts")
    return open_rows.withColumn("ask", asked).orderBy(F.col("board").isNull(), "first_seen", "id").limit(top)


def escalations(rows: DataFrame, group: str, least: int, strong: str) -> DataFrame:
    """Groups of rows ``group, score, scored_by`` whose best member reaches ``least`` and that the strong model has not scored."""
    rolled = rows.groupBy(F.col(group).alias("group")).agg(F.max("score").alias("best"), F.max(F.col("scored_by") == strong).alias("done"))
    return rolled.where((F.col("best") >= least) & ~F.coalesce("done", F.lit(False))).select("group", "best")
