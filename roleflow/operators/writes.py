"""Writes that are checked before they count: statuses, reports, contacts and feedback. Each takes the state and a batch of requests and gives the
state after it and what became of each request. Requests have ``req``, their place in the order in which they came; the last one wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roleflow import vocabulary as V

# Bounds of a feedback.
MOST_IDS, MOST_REASON, MOST_LABEL = 100, 4000, 200
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def save_statuses(rows: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows ``id, status, status_at, applied_at`` after requests ``req, id, status, at``, and ``req, outcome``.

    ``missing`` lacks id or status, ``invalid`` has an unknown status, ``not found`` an unknown id; the rest is ``saved``. The first status of an application ever
    saved stamps ``applied_at``, which later stages leave as it is.
    """
    fault = F.when(F.col("id").isNull() | _blank(F.col("status")), "missing").when(~F.col("status").isin(*V.STATUSES), "invalid")
    known = rows.select(F.col("id").alias("_id"), F.lit(True).alias("_known"))
    judged = requests.withColumn("outcome", fault).join(known, F.col("id") == F.col("_id"), "left")
    judged = judged.withColumn("outcome", F.coalesce("outcome", F.when(F.col("_known").isNull(), "not found"), F.lit("saved")))
    sent = F.col("status").isin(*V.APPLICATION)
    last = judged.where("outcome = 'saved'").groupBy(F.col("id").alias("_id")).agg(
        F.max_by(F.struct("status", "at"), "req").alias("_last"), F.min_by("at", F.when(sent, F.col("req"))).alias("_sent")
    )
    joined = rows.join(last, rows["id"] == F.col("_id"), "left")
    after = joined.select(
        "id", F.coalesce("_last.status", "status").alias("status"), F.coalesce("_last.at", "status_at").alias("status_at"), F.coalesce("applied_at", "_sent").alias("applied_at")
    )
    return after, judged.select("req", "outcome")


def save_reports(reports: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports ``slug, title, kind, body, created_at, updated_at`` after requests ``req, slug, title, kind, body, at``, and ``req, outcome``.

    ``missing`` lacks slug, title or body, ``invalid`` has an unknown kind; without one it is ``other``. The first of a slug that wasn't there is ``created``,
    others ``updated``; a report keeps the time at which it was first written.
    """
    given = requests.withColumn("kind", F.when(_blank(F.col("kind")), "other").otherwise(F.col("kind")))
    empty = _blank(F.col("slug")) | _blank(F.col("title")) | _blank(F.col("body"))
    judged = given.withColumn("fault", F.when(empty, "missing").when(~F.col("kind").isin(*V.REPORT_KINDS), "invalid"))
    last = judged.where("fault is null").groupBy("slug").agg(F.max_by(F.struct("title", "kind", "body", "at"), "req").alias("n"), F.min("req").alias("_first"), F.min_by("at", "req").alias("_began"))
    old = reports.select("slug", F.struct("title", "kind", "body", "created_at", "updated_at").alias("o"))
    both = old.join(last, "slug", "full")
    pick = lambda c: F.coalesce(f"n.{c}", f"o.{c}").alias(c)
    after = both.select("slug", pick("title"), pick("kind"), pick("body"), F.coalesce("o.created_at", "_began").alias("created_at"), F.coalesce("n.at", "o.updated_at").alias("updated_at"))
    new = both.where("o is null").select(F.col("_first").alias("req"), F.lit("created").alias("_made"))
    outcomes = judged.join(new, "req", "left").select("req", F.coalesce("fault", "_made", F.lit("updated")).alias("outcome"))
    return after, outcomes


def save_contacts(contacts: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contacts ``name, group, status, notes`` after requests ``req, name, group, status, notes``, and ``req, outcome``.

    A contact is its name in its group, both trimmed. ``missing`` lacks a name, ``invalid`` has an unknown status; without one it is planned.
    """
    trimmed = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c)
    status = F.when(_blank(F.col("status")), "planned").otherwise(F.col("status")).alias("status")
    judged = requests.select("req", trimmed("name"), trimmed("group"), status, F.coalesce("notes", F.lit("")).alias("notes"))
    judged = judged.withColumn("outcome", F.when(F.col("name") == "", "missing").when(~F.col("status").isin(*V.CONTACT_STATUSES), "invalid").otherwise("saved"))
    last = judged.where("outcome = 'saved'").groupBy("name", "group").agg(F.max_by(F.struct("status", "notes"), "req").alias("n"))
    both = contacts.select("name", "group", F.struct("status", "notes").alias("o")).join(last, ["name", "group"], "full")
    return both.select("name", "group", F.coalesce("n", "o").alias("c")).select("name", "group", "c.*"), judged.select("req", "outcome")


def feedback_fault(id_: Column, rows: Column, decision: Column, reason: Column, label: Column) -> Column:
    """Why a feedback is none; null if it is one. Its rows are compared without case."""
    low = F.transform(rows, F.lower)
    bad = (
        F.coalesce(~id_.rlike(UUID), F.lit(True))
        | F.coalesce(~F.size(rows).between(1, MOST_IDS), F.lit(True))
        | F.coalesce(F.exists(rows, lambda r: r.isNull() | ~r.rlike(UUID)), F.lit(True))
        | F.coalesce(~decision.isin("liked", "passed"), F.lit(True))
        | _blank(reason)
        | (F.length(reason) > MOST_REASON)
        | F.coalesce(F.length(label) > MOST_LABEL, F.lit(True))
    )
    return F.when(bad, "invalid").when(F.size(F.array_distinct(low)) < F.size(low), "repeated rows")


def add_feedback(feedback: DataFrame, requests: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feedback ``id, rows, decision, reason, label`` after requests ``req`` and the same columns, and ``req, outcome``.

    Feedback is only ever added: the first request of an id counts, a retry with the same content is ``saved`` as well and one with another is a ``conflict``. A new one of
    whose rows ``known(id)`` lacks any is ``not found``.
    """
    fields = ("rows", "decision", "reason", "label")
    judged = requests.withColumn("id", F.lower("id")).withColumn("fault", feedback_fault(F.col("id"), F.col("rows"), F.col("decision"), F.col("reason"), F.col("label")))
    judged = judged.withColumn("rows", F.transform("rows", F.lower))
    spread = judged.where("fault is null").select("req", F.explode("rows").alias("_row"))
    lost = spread.join(known.select(F.lower("id").alias("_row")).distinct(), "_row", "left_anti").select("req").distinct().withColumn("_lost", F.lit(True))
    judged = judged.join(lost, "req", "left")
    old = feedback.select("id", F.struct(*fields).alias("o"))
    first = judged.where("fault is null and _lost is null").groupBy("id").agg(F.min_by(F.struct(*fields), "req").alias("n"))
    after = old.join(first, "id", "full").select("id", F.coalesce("o", "n").alias("f"))
    same = F.struct(*fields) == F.col("f")
    outcome = F.coalesce("fault", F.when(F.col("f").isNull(), "not found").when(same, "saved").otherwise("conflict"))
    return after.select("id", "f.*"), judged.join(after, "id", "left").select("req", outcome.alias("outcome"))
