"""Places and work modes as column expressions over small, configured tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

REMOTE = r"(?i)\b(?:remote|work from home|wfh|anywhere|distributed)\b"
HYBRID = r"(?i)\bhybrid\b"
ONSITE = r"(?i)\bon[\s-]?site\b|\bin[\s-]office\b"


def _map(pairs: Mapping[str, str]) -> Column:
    items = [F.lit(x) for kv in sorted(pairs.items()) for x in kv]
    return F.create_map(*items) if items else F.create_map().cast("map<string,string>")


def lookup(pairs: Mapping[str, str], key: Column) -> Column:
    return F.try_element_at(_map(pairs), F.lower(F.trim(key)))


def alternation(words: Sequence[str]) -> str:
    body = "|".join(sorted((w.lower() for w in words), key=len, reverse=True))
    return rf"(?U)(?<!\w)(?:{body})(?!\w)" if body else r"(?!x)x"


def work_mode(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike(HYBRID), "hybrid").when(t.rlike(REMOTE), "remote").when(t.rlike(ONSITE), "onsite")


def canonical_country(country: Column, city: Column, text: Column, cities: Mapping[str, str], aliases: Mapping[str, str]) -> Column:
    """The country as given, else that of the city, else the first that the text names; aliases are folded."""
    names = sorted({*aliases, *aliases.values()})
    named = F.nullif(F.regexp_extract(F.lower(F.coalesce(text, F.lit(""))), alternation([n.lower() for n in names]), 0), F.lit(""))
    found = F.coalesce(F.nullif(F.trim(country), F.lit("")), lookup(cities, city), named)
    return F.coalesce(lookup(aliases, found), found)


def bucket(country: Column, city: Column, region: Column, buckets: Mapping[str, str]) -> Column:
    """Bucket of the country, else of the city, else of the region; ``other`` for a place of none, ``unknown`` without any."""
    some = F.coalesce(F.nullif(F.trim(country), F.lit("")), F.nullif(F.trim(city), F.lit("")), F.nullif(F.trim(region), F.lit("")))
    found = F.coalesce(lookup(buckets, country), lookup(buckets, city), lookup(buckets, region))
    return F.coalesce(found, F.when(some.isNull(), "unknown").otherwise("other"))


def banned(country: Column, region: Column, keep: Sequence[str], ban: Sequence[str], ban_regions: Sequence[str]) -> Column:
    """The keep list wins over the ban list, that over banned regions; an unknown country is not banned."""
    c = F.lower(F.trim(country))
    inside = lambda x, names: x.isin(*[n.lower() for n in names]) if names else F.lit(False)
    return F.coalesce(F.when(inside(c, keep), F.lit(False)).when(inside(c, ban), F.lit(True)).otherwise(c.isNotNull() & inside(F.lower(region), ban_regions)), F.lit(False))


def all_excluded(locations: Column, keep: Sequence[str], ban: Sequence[str], ban_regions: Sequence[str]) -> Column:
    """Whether every place of ``array<struct<work_mode,country,region>>`` is banned; a remote place or none at all keeps a role."""
    every = F.forall(locations, lambda x: banned(x["country"], x["region"], keep, ban, ban_regions))
    remote = F.exists(locations, lambda x: F.coalesce(x["work_mode"] == "remote", F.lit(False)))
    return F.coalesce((F.size(locations) > 0) & every & ~remote, F.lit(False))


def chips(text: Column) -> Column:
    """Places of a free text that ``;`` and ``/`` separate, each once, in order."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[;/]"), lambda p: F.trim(p))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))
