"""What users' profiles say of employers: titles that are wanted of one, employers that are never fetched, and lines that say neither."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Names of sections and forms of their lines.
TITLES, NEVER = "COMPANY_TITLE_FILTERS", "COMPANY_NEVER_FETCH"
HEADER = r"^##\s+([A-Z_]+)\s*$"
BULLET = r"^[-*]\s+(.*)$"
IN_BODY = "desc:"
EMPTY = ("", "(none)", "none", "-", "n/a")


@dataclass(frozen=True)
class EmployerRules:
    """``includes``: ``profile, name, scope, pattern``; ``never``: ``profile, name``; ``warnings``: ``profile, at, section, line, reason``."""

    includes: DataFrame
    never: DataFrame
    warnings: DataFrame


def section_lines(profiles: DataFrame) -> DataFrame:
    """``profile, at, section, line`` of profiles ``profile, text``: lines with something in them under the last heading before; comments are passed over."""
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?s)<!--.*?-->", "")
    lines = profiles.select("profile", F.posexplode(F.split(bare, "\r?\n")).alias("at", "line")).withColumn("line", F.trim("line"))
    name = F.nullif(F.regexp_extract("line", HEADER, 1), F.lit(""))
    # A profile is one file; its lines meet in one task, those of other profiles in others.
    upto = W.partitionBy("profile").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    marked = lines.withColumn("section", F.last(name, ignorenulls=True).over(upto))
    return marked.where((F.col("line") != "") & ~F.col("line").rlike(HEADER)).select("profile", "at", "section", "line")


def employer_rules(profiles: DataFrame) -> EmployerRules:
    """The rules of ``- employer :: pattern, desc: pattern`` and of ``- employer`` lines, each once, in :func:`roleflow.operators.filters.company_reasons`'s form.

    Patterns are lower-cased words that a title, or with ``desc:`` the body, must hold. Lines that look like an entry and are none have a warning, as has a list
    of employers with text but without an entry; prose is passed over.
    """
    lines = section_lines(profiles).where(F.col("section").isin(TITLES, NEVER))
    bullet = F.regexp_extract("line", BULLET, 1)
    lines = lines.withColumn("bullet", F.col("line").rlike(BULLET)).withColumn("body", F.trim(F.when(F.col("bullet"), bullet).otherwise(F.col("line"))))
    split = lines.withColumn("marked", F.contains("body", F.lit("::")))
    wanted = split.where((F.col("section") == TITLES) & (F.col("bullet") | F.col("marked")))
    wanted = wanted.withColumn("name", F.trim(F.split_part("body", F.lit("::"), F.lit(1)))).withColumn("rest", F.regexp_extract("body", r"::(.*)$", 1))
    patterns = F.filter(F.transform(F.split("rest", ","), lambda p: F.trim(F.lower(p))), lambda p: ~p.isin(*EMPTY))
    wanted = wanted.withColumn("patterns", F.when(F.col("marked"), patterns).otherwise(F.array().cast("array<string>")))
    good = F.col("marked") & (F.col("name") != "") & (F.size("patterns") > 0)
    spread = wanted.where(good).select("profile", "at", "section", "line", "name", F.explode("patterns").alias("p"))
    hollow = F.col("p") == IN_BODY
    in_body = F.col("p").startswith(IN_BODY)
    word = F.trim(F.when(in_body, F.substring("p", len(IN_BODY) + 1, 1 << 20)).otherwise(F.col("p")))
    includes = spread.where(~hollow).select("profile", "name", F.when(in_body, "desc").otherwise("title").alias("scope"), word.alias("pattern")).distinct()

    barred = split.where(F.col("section") == NEVER)
    entry = F.col("bullet") & ~F.col("marked") & (F.col("body") != "")
    never = barred.where(entry).select("profile", F.col("body").alias("name")).distinct()

    told = lambda rows, reason: rows.select("profile", "at", "section", "line", reason.alias("reason"))
    malformed = told(wanted.where(~good), F.when(~F.col("marked"), "no patterns after ::").otherwise("no name or no pattern"))
    empty = told(spread.where(hollow), F.lit("desc: without words"))
    mixed = told(barred.where("bullet and marked"), F.lit("patterns belong to the other section"))
    counted = barred.groupBy("profile").agg(F.count_if(entry).alias("n"), F.min("at").alias("at"), F.min_by("line", "at").alias("line"))
    silent = counted.where("n = 0").select("profile", "at", F.lit(NEVER).alias("section"), "line", F.lit("no entry, so inactive").alias("reason"))
    return EmployerRules(includes, never, malformed.unionByName(empty).unionByName(mixed).unionByName(silent))
