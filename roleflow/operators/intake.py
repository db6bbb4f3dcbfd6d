"""The daily intake as one job: gate, tombstones, resolution, merge, places and the ledger of outcomes of a batch of fetched postings.

Postings have ``pos, source, external_id, org, company_id, title, description, snippet, department, deadline, url, city, country``: their place in the
batch and what the fetch brought. Stored rows have ``id`` (long), ``org, company_id, hash, title, description, snippet, department, deadline, status, status_reason, score,
first_seen, last_seen`` and ``places``, an array of ``url, city, country``. A batch can be taken in again: it then changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roleflow.functions import keys as K
from roleflow.functions import text as T
from roleflow.functions.naming import let
from roleflow.operators import identity as I
from roleflow.operators.joins import without_tombstones
from roleflow.operators.resolve import fold_places
from roleflow.session import cut, spread

ROW = ("id", "org", "company_id", "hash", "title", "description", "snippet", "department", "deadline", "status", "status_reason", "score", "first_seen", "last_seen", "places")


PLACES = "array<struct<url:string,city:string,country:string>>"


@dataclass(frozen=True)
class Intake:
    """``rows``: all stored rows after the batch. ``outcomes``: ``pos, source, external_id, outcome, reason, id`` for each posting."""

    rows: DataFrame
    outcomes: DataFrame


def new_id(key: Column) -> Column:
    """The id of a new row: a digest of its key, so that a replay makes the same one."""
    return F.xxhash64(key)


def _keys(org: Column, title: Column, strong: Column, description: Column) -> tuple[Column, ...]:
    return (
        K.key16(org, strong).alias("norm"),
        K.body_fingerprint(description).alias("desc"),
        F.length(F.coalesce(description, F.lit(""))).alias("body_len"),
        strong.alias("title"),
        K.segment_keys(org, title, strong).alias("seg"),
    )


def posting_keys(postings: DataFrame) -> DataFrame:
    """What :func:`roleflow.operators.identity.resolve_batch` needs of a batch."""
    org, title, strong, body = F.col("org"), F.col("title"), F.col("_strong"), F.col("description")
    titled = postings.withColumn("_strong", K.strong_title(title))
    return titled.select("pos", "company_id", K.exact_key(org, title).alias("hash"), *_keys(org, title, strong, body), K.apply_url(F.col("url")).alias("url"), K.requisition_key(F.col("url")).alias("req"))


def stored_keys(store: DataFrame) -> DataFrame:
    """What it needs of the stored rows; their links are those of their places."""
    links = F.filter(F.transform(F.col("places"), lambda p: K.apply_url(p["url"])), lambda u: u != "")
    requisitions = F.filter(F.transform(F.col("places"), lambda p: K.requisition_key(p["url"])), lambda r: r.isNotNull())
    keys = _keys(F.col("org"), F.col("title"), F.col("_strong"), F.col("description"))
    return store.withColumn("_strong", K.strong_title(F.col("title"))).select("id", "company_id", "hash", *keys, F.array_distinct(links).alias("urls"), F.array_distinct(requisitions).alias("reqs"), "status", "score", "first_seen")


def place_name(place: Column) -> Column:
    return F.coalesce(place["city"], place["country"], F.lit(""))


def add_places(old: Column, new: Column) -> Column:
    """Places with those of new sightings, one for each name: a place that is seen again takes its newest link."""
    linked = F.transform(F.filter(new, lambda n: n["url"].isNotNull()), place_name)
    kept = let(linked, lambda names: F.filter(F.coalesce(old, F.array().cast(PLACES)), lambda p: ~F.array_contains(names, place_name(p))))
    return fold_places(F.concat(kept, new))


def last_places(seen: DataFrame, *keys: str) -> DataFrame:
    """``_seen``: of several sightings of a place under ``keys`` the last one, in the order of the batch."""
    place = F.struct("url", "city", "country")
    last = seen.withColumn("_place", place).groupBy(*keys, place_name(F.col("_place")).alias("_name")).agg(F.max("pos").alias("pos"), F.max_by("_place", "pos").alias("p"))
    return last.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda x: x["p"]).alias("_seen"))


def take_in(store: DataFrame, postings: DataFrame, stones: DataFrame, today: Column, *, board: bool, words: Sequence[str] = (), stems: Sequence[str] = ()) -> Intake:
    """The stored rows after a batch, and what became of each posting.

    A posting is ``invalid`` if the gate names a reason; the role that it repeats, if stored, still counts as seen today. It is ``archived`` if a tombstone of ``stones(key,
    reason, archived_at)`` of the last days bars its exact or normalised key; on the direct path (``board`` off) one for a listing that merely went away doesn't. Else
    it is ``existing`` where it is a stored row, which it then brings up to date, or ``new``. Postings that resolve to one row give it all their places.
    """
    store, postings = spread(store, "id"), spread(postings, "pos")
    gate = T.gate_reason(F.col("title"), F.col("description"), F.col("snippet"), F.col("url"), words, stems)
    exact = K.exact_key(F.col("org"), F.col("title"))
    gated = cut(postings.withColumn("skip", gate).withColumn("_hash", exact).withColumn("_norm", K.normalized_key(F.col("org"), F.col("title"))))
    passed = gated.where("skip is null")
    asked = passed.select("pos", F.explode(F.array_distinct(F.array("_hash", "_norm"))).alias("key"))
    barred = asked.join(without_tombstones(asked, stones, today, include_gone=board), ["pos", "key"], "left_anti").select("pos").distinct()
    barred = cut(barred)
    live = cut(passed.join(barred, "pos", "left_anti"))

    resolved = cut(I.resolve_batch(posting_keys(live), cut(stored_keys(store))))
    written = I.merge_batch(store, live, resolved, today, board=board)

    seen = resolved.join(live.select("pos", "url", "city", "country", "org", "company_id", "snippet", "department", "deadline", "description"), "pos")
    filled = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    first = lambda c: F.min_by(filled(c), F.when(filled(c).isNotNull(), F.col("pos"))).alias(f"_{c}")
    longest = F.max(F.struct(F.length("description").alias("n"), (-F.col("pos")).alias("p"), F.col("description").alias("d")))["d"].alias("_longest")
    facts = (F.min_by("org", "pos").alias("_org"), F.min_by("company_id", "pos").alias("_company"))
    of_row = last_places(seen.where("match is not null").select("pos", F.col("match").alias("id"), "url", "city", "country"), "id")
    # What a later posting of a new row brings fills it as it would a stored one.
    more = (first("snippet"), first("department"), F.min_by("deadline", F.when(F.col("deadline").isNotNull(), F.col("pos"))).alias("_deadline"), first("description"), longest)
    new = seen.where("match is null").withColumn("hash", F.col("insert_hash"))
    of_new = new.groupBy("hash").agg(*facts, *more).join(last_places(new, "hash"), "hash")

    old = store.select("id", "org", "company_id", "score", "places")
    updated = written.where("id is not null").join(old, "id").join(of_row, "id").withColumn("places", add_places(F.col("places"), F.col("_seen")))
    fresh = written.where("id is null").drop("id").join(of_new, "hash")
    fresh = fresh.withColumns({"id": new_id(F.col("hash")), "org": F.col("_org"), "company_id": F.col("_company"), "score": F.lit(None).cast(store.schema["score"].dataType), "places": add_places(F.lit(None).cast(PLACES), F.col("_seen"))})
    longer = F.coalesce(F.length("_longest") > F.length(F.coalesce("description", F.lit(""))) + 100, F.lit(False))
    text = F.coalesce(filled("description"), "_description") if board else F.when(longer, F.col("_longest")).otherwise(F.col("description"))
    fresh = fresh.withColumns({"snippet": F.coalesce(filled("snippet"), "_snippet"), "department": F.coalesce(filled("department"), "_department"), "deadline": F.coalesce("deadline", "_deadline"), "description": text})
    # What the gate held back is still listed.
    listed = gated.where("skip is not null and skip <> 'empty_title'").select("company_id", F.col("_hash").alias("hash")).distinct().withColumn("_listed", F.lit(True))
    rest = store.join(resolved.where("match is not null").select(F.col("match").alias("id")).distinct(), "id", "left_anti").join(listed, ["company_id", "hash"], "left")
    rest = rest.withColumn("last_seen", F.when(F.col("_listed"), today).otherwise(F.col("last_seen")))
    rows = rest.select(*ROW).unionByName(updated.select(*ROW)).unionByName(fresh.select(*ROW))

    marked = gated.join(barred.withColumn("archived", F.lit(True)), "pos", "left").select("pos", "source", "external_id", "skip", F.coalesce("archived", F.lit(False)).alias("archived"))
    outcomes = I.import_outcomes(marked, resolved).join(marked.select("pos", "source", "external_id", F.col("skip").alias("reason")), "pos")
    made = resolved.where("match is null").select("pos", new_id(F.col("insert_hash")).alias("_new"))
    outcomes = outcomes.join(made, "pos", "left").select("pos", "source", "external_id", "outcome", "reason", F.coalesce("match", F.when(F.col("outcome") == "new", F.col("_new"))).alias("id"))
    return Intake(rows, outcomes)
