"""State of postings over time: merges, tombstones, expiry, decisions, streaks and idempotent writes.

Each operation takes the state and a batch and gives the rows to write, so it can run twice without another effect.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roleflow import vocabulary as V


def upsert(base: DataFrame, changes: DataFrame, key: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``base`` with the rows of ``changes`` put in by key; columns in ``keep`` stay as they are where a row was there.

    Missing columns are null; a null key never matches, so such rows are added.
    """
    old = base.select(*[F.col(c).alias(f"_old_{c}") for c in base.columns])
    on = None
    for k in key:
        same = F.col(k) == F.col(f"_old_{k}")
        on = same if on is None else on & same
    joined = changes.join(old, on, "left")
    put = joined.select(*[F.coalesce(F.col(f"_old_{c}"), F.col(c)).alias(c) if c in keep else F.col(c) for c in base.columns])
    return base.join(changes, list(key), "left_anti").unionByName(put)


def insert_new(base: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows of ``rows`` whose key is not there yet, each key once."""
    return rows.dropDuplicates(list(key)).join(base, list(key), "left_anti")


def gone_from_source(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """Unseen rows of completely listed employers that neither key finds in ``listing(company_id, key)``: what becomes of them.

    Well scored rows expire, others are archived under both keys.
    """
    fresh = rows.where("status = 'unseen'").join(listing.select("company_id").distinct(), "company_id", "left_semi")
    absent = fresh.join(listing, ["company_id", "key"], "left_anti")
    names = listing.select("company_id", F.col("key").alias("norm"))
    absent = absent.join(names, ["company_id", "norm"], "left_anti")
    good = F.coalesce(F.col("score") >= V.PROTECT_SCORE, F.lit(False))
    return absent.withColumn("new_status", F.when(good, "expiring").otherwise("archived"))


def tombstones(changed: DataFrame, reason: str, at: Column) -> DataFrame:
    """Both keys of archived rows; rows that only expire get none."""
    gone = changed.where("new_status = 'archived'")
    return gone.select(F.explode(F.array("key", "norm")).alias("key"), F.lit(reason).alias("reason"), at.alias("archived_at")).dropDuplicates(["key"])


def expire(rows: DataFrame, as_of: Column) -> DataFrame:
    """Unseen rows past their deadline: passed, or expiring where the score protects them."""
    due = (F.col("status") == "unseen") & F.coalesce(F.col("deadline") < as_of, F.lit(False))
    good = F.coalesce(F.col("score") >= V.PROTECT_SCORE, F.lit(False))
    return rows.withColumn("new_status", F.when(due, F.when(good, "expiring").otherwise("passed")).otherwise(F.col("status")))


def stale(rows: DataFrame, fetched: DataFrame, as_of: Column, days: int = V.STALE_DAYS) -> DataFrame:
    """Unseen rows of boards fetched now that were last seen more than ``days`` ago."""
    old = rows.where((F.col("status") == "unseen") & (F.col("last_seen") < F.date_sub(as_of, days)))
    return old.join(fetched, "board", "left_semi")


def archive_board(rows: DataFrame, boards: DataFrame, board: str) -> DataFrame:
    """Unseen rows of a board that was switched off; none if its name stands for several boards."""
    one = boards.where(F.col("board") == board).groupBy("board").count().where("count = 1").select("board")
    return rows.where("status = 'unseen'").join(one, "board", "left_semi")


def set_status(rows: DataFrame, new: Column, at: Column, force: bool = False) -> DataFrame:
    """Rows with ``new_status, new_applied_at, refused``: an application keeps its first date and is archived only by force."""
    refused = F.col("status").isin(*V.APPLICATION) & (new == "archived") & F.lit(not force)
    sent = F.coalesce("applied_at", F.when(new.isin(*V.APPLICATION), at))
    return rows.select("*", F.when(refused, F.col("status")).otherwise(new).alias("new_status"), sent.alias("new_applied_at"), refused.alias("refused"))


def fan_out_scores(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Scores of ``results(ids, score, deadline, banned)`` for each of their ids; a deadline is filled only where it is missing.

    A banned place archives a row only while it is unseen.
    """
    spread = results.select(F.explode("ids").alias("id"), F.col("score").alias("new_score"), F.col("deadline").alias("new_deadline"), "banned")
    joined = rows.join(spread, "id")
    status = F.when(F.col("banned") & (F.col("status") == "unseen"), "archived").otherwise(F.col("status"))
    return joined.select("id", F.col("new_score").alias("score"), F.coalesce("deadline", "new_deadline").alias("deadline"), status.alias("status"))


def route(score: Column, approve: int = 60, reject: int = 25) -> Column:
    return F.when(score >= approve, "approve").when(score < reject, "reject").otherwise("pending")


def streaks(events: DataFrame, key: str, order: Sequence[str], bad: Column) -> DataFrame:
    """Events with the length of the run of bad ones that ends with each; a good one sets it to 0."""
    w = W.partitionBy(key).orderBy(*order)
    runs = events.withColumn("_bad", bad).withColumn("_block", F.sum((~F.col("_bad")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    inside = W.partitionBy(key, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return runs.withColumn("streak", F.sum(F.col("_bad").cast("long")).over(inside)).drop("_bad", "_block")


def status_changes(events: DataFrame, key: str, order: Sequence[str], status: str) -> DataFrame:
    """Events whose status differs from the one before, the first included."""
    before = F.lag(status).over(W.partitionBy(key).orderBy(*order))
    return events.withColumn("previous", before).where(~F.col("previous").eqNullSafe(F.col(status)))


def due_to_fetch(last: Column, ttl: Column, as_of: Column) -> Column:
    """By calendar days; what was never fetched is due."""
    return last.isNull() | (F.to_date(last) <= F.date_sub(as_of, ttl))


def fill(old: Column, new: Column) -> Column:
    """The old value unless it is missing or empty."""
    return F.coalesce(F.nullif(old, F.lit("")), new)


def bulk_decision(rows: DataFrame, request: DataFrame, applied_at: Column) -> DataFrame:
    """All rows of an operation of ``request(op, id, expected_status, expected_revision, new_status)``, or none: each row with ``outcome``.

    The outcome is ``applied`` only if every row of the operation is there as expected; else ``conflict`` for those that are not and ``held``
    for the rest.
    """
    joined = request.join(rows, "id", "left")
    ok = F.coalesce((F.col("status") == F.col("expected_status")) & (F.col("revision") == F.col("expected_revision")), F.lit(False))
    checked = joined.withColumn("ok", ok)
    whole = checked.groupBy(F.col("op").alias("_op")).agg(F.min("ok").alias("_all"))
    checked = checked.join(whole, F.col("op") == F.col("_op"))
    everything = F.col("_all")
    outcome = F.when(everything, "applied").when(F.col("ok"), "held").otherwise("conflict")
    sent = F.coalesce("applied_at", F.when(F.col("new_status").isin(*V.APPLICATION), applied_at))
    return checked.select("id", outcome.alias("outcome"), F.when(everything, F.col("new_status")).otherwise(F.col("status")).alias("status"), F.when(everything, sent).otherwise(F.col("applied_at")).alias("applied_at"))


def compare_and_set(rows: DataFrame, results: DataFrame, enough: int = V.CATALOGUE_SCORE) -> DataFrame:
    """Each result of ``results(id, text_hash, old_score, score)`` with its outcome.

    ``error`` for an unknown or repeated id; ``skipped`` where the row changed, is decided or scored well enough; ``scored`` with a
    score, ``prepared`` without.
    """
    again = F.count(F.lit(1)).over(W.partitionBy("id")) > 1
    marked = results.withColumn("_again", again)
    state = rows.select("id", F.col("status").alias("_status"), F.col("score").alias("_score"), F.col("text_hash").alias("_hash"))
    joined = marked.join(state, "id", "left")
    same = F.col("text_hash").eqNullSafe(F.col("_hash")) & F.col("old_score").eqNullSafe(F.col("_score"))
    outcome = (
        F.when(F.col("_status").isNull() | F.col("_again"), "error")
        .when((F.col("_status") != "unseen") | ~same, "skipped")
        .when(F.coalesce(F.col("_score") >= enough, F.lit(False)), "skipped")
        .when(F.col("score").isNotNull(), "scored")
        .otherwise("prepared")
    )
    return joined.select("id", "score", outcome.alias("outcome"))


def decide(judgements: DataFrame, expected: DataFrame, least: int = 5) -> DataFrame:
    """The last valid judgement of each expected id: ``killed`` only with full confidence and a quote that the text holds.

    ``judgements`` has ``id, verdict, confidence, quote, seq``, ``expected`` has ``id, text``. Others are ``held`` or ``kept``; an id
    without a valid judgement is ``missing``. Of several with the last ``seq`` the most careful counts: one that keeps, then the least confidence, then the
    first quote, none before any.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    valid = F.col("verdict").isin("KILL", "KEEP") & ((F.col("verdict") == "KEEP") | F.col("confidence").between(1, 5))
    w = W.partitionBy("id").orderBy(F.desc("seq"), F.asc("verdict"), F.asc("confidence"), F.asc("quote"))
    last = judgements.where(valid).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    joined = expected.join(last, "id", "left")
    quoted = F.coalesce((F.length("quote") > 0) & plain(F.col("text")).contains(plain(F.col("quote"))), F.lit(False))
    outcome = F.when(F.col("verdict").isNull(), "missing").when(F.col("verdict") == "KEEP", "kept").when((F.col("confidence") >= least) & quoted, "killed").otherwise("held")
    return joined.select("id", outcome.alias("outcome"))


def quotes_hold(quotes: Column, text: Column) -> Column:
    """Whether every quote of an array occurs in the text, white space and case aside."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    return F.coalesce(F.forall(quotes, lambda q: plain(text).contains(plain(q))), F.lit(False))


def deferred(status: Column, at: Column, as_of: Column) -> Column:
    """A deferred status is unseen again from the next day on."""
    return F.when((status == "unsure") & (F.to_date(at) < as_of), "unseen").otherwise(status)


def merge_artifacts(old: Column, new: Column) -> Column:
    """Two maps as one, the new one's values first."""
    empty = F.create_map().cast("map<string,string>")
    o, k = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(o, lambda key, _: ~F.map_contains_key(k, key)), k)


def archive_payload(rows: DataFrame) -> DataFrame:
    """Whole rows as archive records ``id, payload``: JSON with ISO dates, ids as text."""
    ids = [c for c in ("id", "company_id") if c in rows.columns]
    shown = rows.withColumns({c: F.col(c).cast("string") for c in ids})
    return shown.select("id", F.to_json(F.struct(*shown.columns), {"dateFormat": "yyyy-MM-dd", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss", "ignoreNullFields": "false"}).alias("payload"))


def to_archive(rows: DataFrame, threshold: int, *, force: bool) -> DataFrame:
    """Unseen rows with a score below the threshold; none unless it is forced, since a low score alone removes nothing."""
    low = rows.where((F.col("status") == "unseen") & (F.col("score") < threshold))
    return low if force else low.limit(0)


def remove_rows(rows: DataFrame, ids: DataFrame, folder: str, reason: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """What is left of ``rows`` without ``ids``, and the tombstones of what went, which is in the archive before either is read.

    The archive is written by Spark's own commit, so a folder without its mark of success was never finished; a failure there leaves
    the rows where they are. ``rows`` has ``id, key, norm``.
    """
    gone = rows.join(ids.select("id").distinct(), "id", "left_semi")
    archive_payload(gone).write.mode("errorifexists").parquet(folder)
    done = rows.sparkSession.read.parquet(folder).select("id")
    kept = rows.join(done, rows["id"].cast("string") == done["id"], "left_anti")
    removed = rows.join(done, rows["id"].cast("string") == done["id"], "left_semi").withColumn("new_status", F.lit("archived"))
    return kept, tombstones(removed, reason, at)


def append_versioned(store: DataFrame, records: DataFrame, at: Column) -> DataFrame:
    """The records that a versioned, append-only set takes: those with an id that it lacks, each once, stamped with the next version.

    ``store`` has ``id, version``; ``records`` have ``id, seq`` and go by seq.
    """
    last = store.agg(F.max("version").alias("last")).first()["last"] or 0
    first = records.where("coalesce(id, '') <> ''").withColumn("_r", F.row_number().over(W.partitionBy("id").orderBy("seq"))).where("_r = 1").drop("_r")
    fresh = first.join(store.select("id"), "id", "left_anti")
    return fresh.withColumn("version", F.lit(last + 1)).withColumn("labelled_at", at)


def as_of_version(store: DataFrame, version: int) -> DataFrame:
    """The set as it was when ``version`` was its last."""
    return store.where(F.col("version") <= version)


# What a prepared result may say.
REQUIREMENT_KINDS = ("skill", "domain", "education", "experience", "location", "language", "authorisation")
STRENGTHS = ("required", "preferred")
FINDINGS = ("supported", "possible_conflict", "unknown")
MOST_REQUIREMENTS = 12


def result_fault(result: Column, text: Column, levels: dict[str, Sequence[str]]) -> Column:
    """Why a prepared result is refused, by the first rule it breaks; null if it is clean.

    ``result`` is a struct ``failed, posting_facts(requirements(kind, strength, quote), <levels>), profile_comparison(requirement,
    finding)``. One quote that the text does not hold, white space and case aside, refuses all of it.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    facts, found = result["posting_facts"], result["profile_comparison"]
    required = facts["requirements"]
    bad = lambda c, allowed: ~F.coalesce(c.isin(*allowed), F.lit(False))
    some = lambda array, f: F.coalesce(F.exists(array, f), F.lit(False))
    out = F.when(result.isNull(), "no object").when(F.length(result["failed"]) > 0, "failed").when(facts.isNull(), "no facts")
    for name, allowed in levels.items():
        out = out.when(bad(facts[name], allowed), name)
    return (
        out.when(required.isNull(), "no requirements")
        .when(F.size(required) > MOST_REQUIREMENTS, "too many requirements")
        .when(some(required, lambda r: bad(r["kind"], REQUIREMENT_KINDS)), "kind")
        .when(some(required, lambda r: bad(r["strength"], STRENGTHS)), "strength")
        .when(some(required, lambda r: ~F.coalesce((F.length(F.trim(r["quote"])) > 0) & plain(text).contains(plain(r["quote"])), F.lit(False))), "quote")
        .when(found.isNull(), "no comparison")
        .when(some(found, lambda c: ~F.coalesce(c["requirement"].between(F.lit(0), F.size(required) - 1), F.lit(False))), "index")
        .when(some(found, lambda c: bad(c["finding"], FINDINGS)), "finding")
    )


def screen_verdict(reply: Column) -> Column:
    """Struct ``(keep, reason, fail_safe)`` of a model's reply: only an explicit no drops, whatever cannot be read keeps."""
    body = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\{.*\}", 0)
    said = F.get_json_object(body, "$.keep")
    read = F.when((body != "") & F.try_parse_json(body).isNotNull(), F.lit(True)).otherwise(F.lit(False))
    keep = ~read | ~F.coalesce(F.lower(F.trim(said)).isin("false", "no", "0", "drop"), F.lit(False))
    reason = F.coalesce(F.nullif(F.trim(F.get_json_object(body, "$.reason")), F.lit("")), F.when(keep, "plausible fit").otherwise("clear mismatch"))
    return F.struct(keep.alias("keep"), F.when(read, reason).otherwise("unparseable").alias("reason"), (~read).alias("fail_safe"))


def apply_drops(companies: DataFrame, drops: DataFrame) -> DataFrame:
    """Candidates of ``drops(id, reason, kind)`` as inactive with their reason; employers of any other status stay as they are."""
    one = drops.groupBy("id").agg(F.min(F.struct("kind", "reason")).alias("_d"))
    joined = companies.join(one, "id", "left")
    hit = F.col("_d").isNotNull() & (F.col("status") == "candidate")
    prefix = F.when(F.col("_d.kind") == "dup", "screen-dup: ").otherwise("screen: ")
    return joined.withColumn("new_status", F.when(hit, "inactive").otherwise(F.col("status"))).withColumn("status_reason", F.when(hit, F.concat(prefix, F.col("_d.reason")))).drop("_d")


def archive_inactive(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """``rows`` with ``new_status``: unseen rows of inactive employers are archived, all others stay."""
    off = companies.where("status = 'inactive'").select(F.col("company_key").alias("_off")).distinct()
    joined = rows.join(off, rows["company_id"] == F.col("_off"), "left")
    return joined.withColumn("new_status", F.when(F.col("_off").isNotNull() & (F.col("status") == "unseen"), "archived").otherwise(F.col("status"))).drop("_off")


def save_notes(applications: DataFrame, requests: DataFrame, at: Column) -> DataFrame:
    """Each request ``id, notes, expected`` against the notes as they are: ``id, outcome, notes, history``.

    A note changed elsewhere is a conflict and stays; the same text again changes nothing; else the old text joins the history. The notes of
    an application that is not there yet count as empty.
    """
    held = applications.select("id", F.col("notes").alias("_notes"), "history")
    joined = requests.join(held, "id", "left")
    now = F.coalesce("_notes", F.lit(""))
    outcome = F.when(now != F.col("expected"), "conflict").when(now == F.col("notes"), "same").when(F.col("_notes").isNull(), "created").otherwise("saved")
    past = F.coalesce("history", F.array().cast("array<struct<recorded_at:date,notes:string>>"))
    grown = F.when(outcome == "saved", F.array_append(past, F.struct(at.alias("recorded_at"), now.alias("notes")))).otherwise(past)
    return joined.select("id", outcome.alias("outcome"), F.when(outcome.isin("saved", "created"), F.col("notes")).otherwise(now).alias("notes"), grown.alias("history"))


def ordered_view(rows: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """A projection of whole tables for display, the latest first and rows without a date last."""
    return rows.select("id", *columns).orderBy(F.desc_nulls_last(order), "id")
