"""Facets and requirement tests over nested screening facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roleflow import vocabulary as V


def applyable(score: Column, status: Column, deadline: Column, as_of: Column) -> Column:
    return F.coalesce(score >= V.APPLYABLE_SCORE, F.lit(False)) & ~status.isin(*V.CLOSED) & ~F.coalesce(deadline < as_of, F.lit(False))


def on_dashboard(score: Column, status: Column, floor: int = V.CATALOGUE_SCORE) -> Column:
    """An active decision, or a score that reaches the floor."""
    return status.isin("liked", "to_apply", "to_research", "to_network", *V.APPLICATION) | F.coalesce(score >= floor, F.lit(False))


def visible(verdict: Column, prepared: Column, score: Column, floor: int = V.CATALOGUE_SCORE) -> Column:
    """A verdict wins; without one, what is prepared or scored well enough shows."""
    return F.when(verdict.isNotNull(), verdict == "keep").otherwise(F.coalesce(prepared, F.lit(False)) | F.coalesce(score >= floor, F.lit(False)))


def facets(
    *,
    least: int | None = None,
    most: int | None = None,
    max_age: int | None = None,
    work_modes: tuple[str, ...] = (),
    place: str | None = None,
    search: str | None = None,
    deadline: str | None = None,
    as_of: Column | None = None,
) -> Column:
    """One condition of all facets that are given, over ``score, first_seen, deadline, locations, title, org``."""
    out = F.lit(True)
    if least is not None:
        out &= F.coalesce(F.col("score") >= least, F.lit(False))
    if most is not None:
        out &= F.coalesce(F.col("score") <= most, F.lit(False))
    if max_age is not None:
        out &= F.datediff(as_of, "first_seen") <= max_age
    if work_modes:
        out &= F.exists("locations", lambda x: F.coalesce(x["work_mode"].isin(*work_modes), F.lit(False)))
    if place:
        out &= F.exists("locations", lambda x: F.lower(F.concat_ws(" ", x["city"], x["country"], x["region"])).contains(place.lower()))
    if search:
        out &= F.lower(F.concat_ws(" ", "title", "org")).contains(search.lower())
    if deadline == "open":
        out &= F.coalesce(F.col("deadline") >= as_of, F.lit(True))
    elif deadline == "past":
        out &= F.coalesce(F.col("deadline") < as_of, F.lit(False))
    elif deadline == "none":
        out &= F.col("deadline").isNull()
    return out


def requirement_matches(requirements: Column, comparison: Column, *, kind: str | None = None, strength: str | None = None, finding: str | None = None) -> Column:
    """Whether one requirement meets all conditions at once; the comparison names requirements by their index."""
    joined = F.transform(requirements, lambda r, i: F.struct(r.alias("r"), F.try_element_at(F.filter(comparison, lambda c: c["requirement"] == i), F.lit(1)).alias("c")))

    def holds(x: Column) -> Column:
        out = F.lit(True)
        if kind:
            out &= x["r"]["kind"] == kind
        if strength:
            out &= x["r"]["strength"] == strength
        if finding:
            out &= F.coalesce(x["c"]["finding"] == finding, F.lit(False))
        return out

    return F.coalesce(F.exists(joined, holds), F.lit(False))


def date_facts(first_seen: Column, last_seen: Column, deadline: Column, as_of: Column) -> Column:
    """Struct ``(age, expired, stale, gone)``; the deadline's own day is open, fourteen days without sight are stale."""
    expired = F.coalesce(deadline < as_of, F.lit(False))
    stale = F.coalesce(F.datediff(as_of, last_seen) >= V.STALE_DAYS, F.lit(False))
    return F.struct(F.datediff(as_of, first_seen).alias("age"), expired.alias("expired"), stale.alias("stale"), (expired | stale).alias("gone"))


# Classes of reasons in the order in which they are tried, with the kinds of requirement that they hold.
REASON_CLASSES = (("eligibility", ("location", "language", "authorisation")), ("fit", ("skill", "domain", "education", "experience")))
#: Stages of progress that a column shows under another name.
STAGES = {"to_research": "to_apply", "to_network": "to_apply", "test_task": "interview"}


def reason_class(requirements: Column, comparison: Column, prepared: Column, current: Column) -> Column:
    """Struct ``(key, reasons)`` of the first class of which a required, quoted requirement may conflict; null where none does.

    It says something only if the row was prepared for its current text and profile.
    """
    asked = F.transform(
        F.filter(comparison, lambda c: (c["finding"] == "possible_conflict") & (c["requirement"] >= 0) & (c["requirement"] < F.size(requirements))),
        lambda c: F.struct(F.get(requirements, c["requirement"]).alias("r"), c["note"].alias("note")),
    )
    concerns = F.filter(asked, lambda x: (x["r"]["strength"] == "required") & (F.length(F.trim(x["r"]["quote"])) > 0))
    shown = F.transform(concerns, lambda x: F.struct(x["r"]["kind"].alias("kind"), x["r"]["quote"].alias("quote"), F.coalesce(F.nullif(x["note"], F.lit("")), x["r"]["value"], F.lit("")).alias("note")))
    out = F.when(~F.coalesce(prepared == current, F.lit(False)), None)
    def of(kinds: tuple[str, ...]) -> Column:
        return F.filter(shown, lambda x: x["kind"].isin(*kinds))

    for key, kinds in REASON_CLASSES:
        own = of(kinds)
        out = out.when(F.size(own) > 0, F.struct(F.lit(key).alias("key"), own.alias("reasons")))
    return out


def progress_column(status: Column, columns: tuple[str, ...]) -> Column:
    """The column of a board that shows a status, its older names folded; null where there is none."""
    folded = status
    for old, new in STAGES.items():
        folded = F.when(status == old, F.lit(new)).otherwise(folded)
    return F.when(folded.isin(*columns), folded)


def preparable(text: Column, junk: Column, prepared: Column, version: str, *parts: Column, least: int = 200) -> Column:
    """Whether a text is to be prepared: long enough, no page junk, and not prepared as it stands."""
    now = F.sha2(F.concat_ws("\x1f", F.lit(version), *parts, text), 256)
    return (F.length(F.coalesce(text, F.lit(""))) >= least) & ~junk & ~F.coalesce(prepared == now, F.lit(False))
