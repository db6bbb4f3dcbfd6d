"""Filters that a profile configures: employers, keywords, mail rules, boards; and reports about them."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roleflow import vocabulary as V
from roleflow.functions import keys as K
from roleflow.functions import text as T
from roleflow.operators.ranking import numbered_within


def company_reasons(rows: DataFrame, includes: DataFrame, never: DataFrame) -> DataFrame:
    """Rows of ``org, title, description`` with the reason why their employer's rules drop them, or null.

    ``never`` has ``name``. ``includes`` has ``name, scope, pattern`` with scope title or desc: a listed employer's role stays if any of its patterns
    fits; a description pattern keeps nothing without a description. Names meet without case and extra space.
    """
    named = rows.withColumn("_key", K.lookup_name(F.col("org")))
    rules = includes.select(K.lookup_name(F.col("name")).alias("_key"), "scope", "pattern").groupBy("_key").agg(F.collect_list(F.struct("scope", "pattern")).alias("_rules"))
    banned = never.select(K.lookup_name(F.col("name")).alias("_key"), F.lit(True).alias("_never")).distinct()
    joined = named.join(rules, "_key", "left").join(banned, "_key", "left")
    fits = F.exists(
        "_rules",
        lambda r: F.when(r["scope"] == "desc", F.regexp_like(F.lower(F.coalesce("description", F.lit(""))), r["pattern"])).otherwise(F.regexp_like(F.lower(F.coalesce("title", F.lit(""))), r["pattern"])),
    )
    reason = F.when(F.col("_never"), "company_never_fetch").when(F.col("_rules").isNotNull() & ~fits, "company_title_filter")
    return joined.withColumn("reason", reason).drop("_key", "_rules", "_never")


def dropped(rows: DataFrame) -> DataFrame:
    """How many rows each reason drops."""
    return rows.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def keyword_filter(title: Column, tags: Column, *, include: Sequence[str] = (), exclude: Sequence[str] = (), stems: Sequence[str] = (), places: Sequence[str] = ()) -> Column:
    """Any of ``include`` in the title, none of ``exclude`` as a word or ``stems`` as a part, one of ``places`` among the tags; an empty list asks nothing."""
    out = F.lit(True)
    if include:
        out &= T.contains_any(title, [w.lower() for w in include])
    if exclude or stems:
        out &= T.blacklist_term(title, exclude, stems).isNull()
    if places:
        wanted = [p.lower() for p in places]
        out &= F.exists(tags, lambda t: T.contains_any(t, wanted))
    return F.coalesce(out, F.lit(False))


def mail_reason(sender: Column, subject: Column, *, own: Sequence[str], excluded: Sequence[str], platforms: Sequence[str], employers: Sequence[str], phrases: Mapping[str, str]) -> Column:
    """Why a message matters, by rules in order: own and excluded senders do not, then platforms, employers (their subdomains too) and subject phrases."""
    address = F.lower(F.regexp_extract(sender, r"([^<\s]+@[^>\s]+)", 1))
    domain = F.element_at(F.split(address, "@"), -1)

    def under(names: Sequence[str]) -> Column:
        out = F.lit(False)
        for n in names:
            out |= (domain == n.lower()) | domain.endswith("." + n.lower())
        return out

    rule = F.when(address.isin(*[o.lower() for o in own]) | under(excluded), F.lit(None).cast("string")).when(under(platforms), "platform").when(under(employers), "employer")
    for phrase, reason in phrases.items():
        rule = rule.when(F.lower(subject).contains(phrase.lower()), reason)
    return rule


def board_matches(boards: DataFrame, profile: str) -> DataFrame:
    """Boards of ``board, tags`` by the tags that a profile text holds as whole words."""
    text = F.lit(profile.lower())
    hit = F.filter("tags", lambda t: F.regexp_like(text, F.concat(F.lit(r"\b"), F.regexp_replace(F.lower(t), r"([^a-z0-9 ])", r"\\$1"), F.lit(r"\b"))))
    found = boards.select("board", hit.alias("hits")).where("size(hits) > 0")
    return found.select("board", "hits", F.size("hits").alias("n")).orderBy(F.desc("n"), "board")


def factor_keywords(words: DataFrame, factors: DataFrame) -> DataFrame:
    """For each factor of ``factor, keyword`` the keyword that most garbage and no good row holds; ``words`` has ``word, hits, good``."""
    joined = factors.join(words.where("good = 0"), F.lower("keyword") == F.col("word"))
    w = W.partitionBy("factor").orderBy(F.desc("hits"), "word")
    return joined.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("factor", "keyword", "hits")


def registry_faults(companies: DataFrame, known: DataFrame) -> DataFrame:
    """Employers without a name or strategy, and aliases that name no known employer: ``fault, name``."""
    missing = companies.where("trim(coalesce(name, '')) = '' or strategy is null").select(F.lit("missing_field").alias("fault"), F.coalesce("name", F.lit("")).alias("name"))
    alias = companies.select(F.explode("aliases").alias("name"))
    dangling = alias.join(known.select("name"), "name", "left_anti").select(F.lit("dangling_alias").alias("fault"), "name")
    return missing.unionByName(dangling.distinct())


def grouped_reports(reports: DataFrame) -> DataFrame:
    """Reports with the place of their kind in the fixed order and their own in it, newest first."""
    kind = F.when(F.col("kind").isin(*V.REPORT_KINDS), F.col("kind")).otherwise("other")
    rank = F.array_position(F.array(*[F.lit(k) for k in V.REPORT_KINDS]), F.col("kind"))
    named = reports.withColumn("kind", kind).withColumn("group_place", rank.cast("int"))
    return numbered_within(named, "kind", [F.desc("updated"), "slug"], "place")


@dataclass(frozen=True)
class HardFilters:
    """What a profile excludes; as it stands it excludes nothing."""

    exclude_countries: tuple[str, ...] = ()
    exclude_title_keywords: tuple[str, ...] = ()
    ban_regions: tuple[str, ...] = ()
    keep_countries: tuple[str, ...] = ()
    ban_countries: tuple[str, ...] = ()
    ban_us_only: bool = False
    onsite_ok_regions: tuple[str, ...] = ()
    onsite_penalty: int = 0
    unknown: tuple[str, ...] = ()


# Words that stand for an empty field and for yes.
NOTHING, YES = ("", "(none)", "none", "-", "n/a"), ("yes", "true", "1", "on", "y")


def hard_filters(section: str | None) -> HardFilters:
    """The filters in a profile's section of ``key: value`` lines; comments and prose are passed over, unknown keys are named, bad values are defaults."""
    found: dict[str, object] = {}
    unknown = []
    kinds = {f.name: f.default for f in fields(HardFilters) if f.name != "unknown"}
    for line in re.sub(r"(?s)<!--.*?-->", "", section or "").splitlines():
        if not (m := re.match(r"^\s*([A-Za-z_]+)\s*:(.*)$", line)):
            continue
        key, raw = m[1].lower(), m[2].strip()
        empty = raw.lower() in NOTHING
        if key not in kinds:
            unknown.append(key)
        elif isinstance(kinds[key], bool):
            found[key] = not empty and raw.lower() in YES
        elif isinstance(kinds[key], int):
            found[key] = int(raw) if re.fullmatch(r"-?\d+", raw) else 0
        else:
            found[key] = () if empty else tuple(x for p in raw.split(",") if (x := p.strip().lower()) and x not in NOTHING)
    return HardFilters(**found, unknown=tuple(unknown))


def listed(rows: DataFrame, *, status: str | None = None, least: int | None = None, tier: str | None = None, org: str | None = None, buckets: Sequence[str] = (), sort: str = "score") -> DataFrame:
    """Postings under all conditions that are given, archived ones only if they are asked for, in one of three orders that end with the id.

    ``rows`` has ``id, org, status, score, tier, created`` and, for ``buckets``, an array of that name.
    """
    out = rows.where(F.col("status") == status) if status else rows.where(F.col("status") != "archived")
    if least is not None:
        out = out.where(F.col("score") >= least)
    if tier:
        out = out.where(F.col("tier") == tier)
    if org:
        out = out.where(F.lower("org").contains(org.lower()))
    if buckets:
        out = out.where(F.arrays_overlap("buckets", F.array(*[F.lit(b) for b in buckets])))
    orders = {"score": F.desc(F.coalesce("score", F.lit(0))), "recent": F.desc_nulls_last("created"), "company": F.asc(F.lower(F.coalesce("org", F.lit(""))))}
    return out.orderBy(orders[sort], "id")


def by_prefix(rows: DataFrame, prefix: str) -> DataFrame:
    """The row whose id begins with ``prefix``, if it is the only one."""
    hits = rows.where(F.col("id").cast("string").startswith(prefix)).limit(2)
    return hits if hits.count() == 1 else hits.limit(0)


def catalogue_order(rows: DataFrame, sort: str, as_of: Column) -> DataFrame:
    """Postings by score either way, missing ones last, or by open deadline, of which a past one is none; remote places come last in ties."""
    days = F.datediff("deadline", as_of)
    orders = {
        "score-desc": F.desc(F.coalesce("score", F.lit(-1))),
        "score-asc": F.asc(F.coalesce("score", F.lit(999))),
        "deadline": F.asc_nulls_last(F.when(days >= 0, days)),
    }
    return rows.orderBy(orders.get(sort, orders["score-desc"]), F.asc(F.coalesce("remote", F.lit(False))), "id")


#: Columns that employers may be sorted by; a missing value counts as the number beside it, or as empty text.
COMPANY_ORDERS = {
    "name": "", "tier": 4, "fit": -1, "score": -1, "vacancies": 0, "applyable": 0, "liked": 0, "freshness": "", "new": 0, "monitoring": 99, "category": "", "deadline": "",
}
TIER_ORDER = {"S": 0, "A": 1, "B": 2, "C": 3}


def company_table(rows: DataFrame, *, state: str | None = None, tier: str | None = None, search: str | None = None, sort: str = "score", ascending: bool = False) -> DataFrame:
    """Employers of a list, hot ones before all others, then by one of COMPANY_ORDERS and by name.

    ``tier`` may be ``unscored``. ``rows`` has ``name, state, hot`` and the columns of the orders.
    """
    out = rows
    if state:
        out = out.where(F.col("state") == state)
    if tier == "unscored":
        out = out.where(F.col("tier").isNull())
    elif tier:
        out = out.where(F.col("tier") == tier)
    if search:
        out = out.where(F.lower(F.concat_ws(" ", "name", "category")).contains(search.lower()))
    missing = COMPANY_ORDERS[sort]
    value = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TIER_ORDER.items() for x in kv]), F.col("tier")), F.lit(4)) if sort == "tier" else F.coalesce(F.col(sort), F.lit(missing))
    return out.orderBy(F.desc(F.coalesce("hot", F.lit(False))), value.asc() if ascending else value.desc(), "name")


def company_of(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """Each row with its employer's name; null where the row has none or the employer is not known."""
    known = companies.groupBy(F.col("company_key").alias("_key")).agg(F.min("company").alias("company_name"))
    return rows.join(known, rows["company_id"] == F.col("_key"), "left").drop("_key")


def factors(lines: DataFrame) -> DataFrame:
    """Preference factors ``factor, strength`` of profile lines ``at, text`` such as ``- strong: remote work``: each once, by its first line."""
    parts = lines.select("at", F.lower(F.regexp_extract("text", r"^\s*[-*]\s*(\w+)\s*:", 1)).alias("strength"), F.trim(F.regexp_extract("text", r"^\s*[-*]\s*\w+\s*:\s*(.+)$", 1)).alias("factor"))
    named = parts.where("factor <> ''").groupBy("factor").agg(F.min_by("strength", "at").alias("strength"))
    return named


def factors_by_strength(found: DataFrame) -> DataFrame:
    return found.groupBy("strength").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("factor")).alias("factors"))
