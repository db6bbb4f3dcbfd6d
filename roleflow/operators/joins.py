"""Joins of postings with employers, boards, evidence and tombstones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roleflow import vocabulary as V
from roleflow.functions import keys as K
from roleflow.session import spread


def awaiting(score: Column) -> Column:
    return score.isNull() | (score < 0)


def select_postings(
    rows: DataFrame,
    companies: DataFrame,
    *,
    status: str | None = None,
    exclude: Sequence[str] = (),
    company: str | None = None,
    prefix: str | None = None,
    unscored_only: bool = False,
    least: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Postings with their employer under all conditions that are given; the newest first where there is a limit."""
    joined = rows.join(companies, rows["company_id"] == companies["company_key"])
    if status:
        joined = joined.where(F.col("status") == status)
    if exclude:
        joined = joined.where(~F.col("status").isin(*exclude))
    if company:
        joined = joined.where(F.col("company") == company)
    if prefix:
        joined = joined.where(F.col("id").cast("string").startswith(prefix))
    if unscored_only:
        joined = joined.where(awaiting(F.col("score")))
    if least is not None:
        joined = joined.where(awaiting(F.col("score")) | (F.col("score") >= least))
    return joined.orderBy(F.desc("first_seen"), "id").limit(limit) if limit else joined


def company_audit(companies: DataFrame, rows: DataFrame, least: int = 3) -> DataFrame:
    """Every employer with its postings and the segment it falls in."""
    counted = rows.groupBy("company_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "liked").alias("liked"))
    joined = companies.join(counted, companies["company_key"] == counted["company_id"], "left")
    joined = joined.select(*companies.columns, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("liked", F.lit(0)).cast("long").alias("liked"))
    segment = F.when(F.col("n") == 0, "silent").when(F.col("liked") > 0, "engaged").when(F.col("n") >= least, "active").otherwise("sparse")
    return joined.withColumn("segment", segment)


def earned_companies(companies: DataFrame, rows: DataFrame, least: int, keep: bool = True) -> DataFrame:
    """Employers that have a liked or well scored posting, or with ``keep`` off those that have none."""
    good = rows.where((F.col("status") == "liked") | (F.col("score") >= least))
    return companies.join(good, companies["company_key"] == good["company_id"], "left_semi" if keep else "left_anti")


def without_tombstones(rows: DataFrame, stones: DataFrame, as_of: Column, *, include_gone: bool, days: int = V.TOMBSTONE_DAYS) -> DataFrame:
    """Rows whose ``key`` was not archived within ``days``; listings that merely went away count only with ``include_gone``."""
    live = stones.where(F.col("archived_at") >= F.date_sub(as_of, days))
    if not include_gone:
        live = live.where(~F.col("reason").eqNullSafe(F.lit("gone_from_source")))
    return rows.join(live, "key", "left_anti")


def latest(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The last row of each key in the given order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def key_index(rows: DataFrame) -> DataFrame:
    """The first holder of each key of an employer, decided rows before others: ``company_id, kind, key, id``.

    ``rows`` has ``id, company_id, org, title, description, urls, status, first_seen``.
    """
    rows = spread(rows, "id").withColumn("_strong", K.strong_title(F.col("title")))
    made = {
        "exact": F.array(K.exact_key(F.col("org"), F.col("title"))),
        "norm": F.array(K.key16(F.col("org"), F.col("_strong"))),
        "desc": F.array(K.body_fingerprint(F.col("description"))),
        "seg": K.segment_keys(F.col("org"), F.col("title"), F.col("_strong")),
        "url": F.transform("urls", K.apply_url),
        "req": F.transform("urls", K.requisition_key),
    }

    def pair(kind: str, values: Column) -> Column:
        return F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))

    pairs = F.flatten(F.array(*[pair(k, v) for k, v in made.items()]))
    # Before an inner explode the optimizer would make all keys once more, to see whether there are any.
    keyed = rows.select("id", "company_id", "status", "first_seen", F.explode_outer(pairs).alias("p")).where("p.key is not null and p.key <> ''")
    return first_of_keys(keyed.select("id", "company_id", "first_seen", "p.*", F.col("status").isin(*V.DECIDED).alias("decided")))


def first_of_keys(keyed: DataFrame) -> DataFrame:
    """The first holder of each key of rows ``id, company_id, kind, key, decided, first_seen``, decided ones before others: a sum by parts, so a key of many rows is no task of its own."""
    order = F.struct(F.coalesce(~F.col("decided"), F.lit(True)).alias("d"), F.col("decided").isNull().alias("n"), F.col("first_seen").alias("f"), F.col("id").alias("id"))
    return keyed.groupBy("company_id", "kind", "key").agg(F.min(order).alias("m")).select("company_id", "kind", "key", "m.id")


def same_link(rows: DataFrame) -> DataFrame:
    """Pairs of postings of any employers whose links agree: each later one with the first holder."""
    spread = rows.select("id", F.explode(F.array_distinct(F.transform("urls", K.apply_url))).alias("url")).where("url <> ''").distinct()
    # A link that many have is summed up before it is joined; a window would sort all its rows in one task.
    first = spread.groupBy("url").agg(F.min("id").alias("first"))
    return spread.join(first, "url").where("first <> id").select("id", F.col("first").alias("holder"), "url")


def matching_companies(names: DataFrame, companies: DataFrame) -> DataFrame:
    """For each ``name`` the employer it may be merged with: equal words in any order, equal when glued, or one an acronym of the other.

    Each reading of a name gives a key of each kind, so the three tests are one equi-join; of several the best rank wins, then the
    smallest key. ``companies`` has ``company_key, company, aliases, rank``.
    """

    def keyed(frame: DataFrame, reading: Column, *keep: str) -> DataFrame:
        words = frame.select(*keep, F.explode(reading).alias("w"))
        letters = K.acronym(F.col("w"))
        options = F.array(
            F.concat(F.lit("set:"), F.array_join(F.array_sort(F.array_distinct("w")), " ")),
            F.concat(F.lit("glue:"), F.array_join("w", "")),
            F.when(F.size("w") >= 3, F.concat(F.lit("glue:"), letters)),
        )
        return words.select(*keep, F.explode(options).alias("k")).where("k is not null").distinct()

    asked = keyed(names, K.name_readings(F.col("name")), "name")
    spread = companies.select("company_key", "rank", F.explode(F.concat(F.array("company"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("as"))
    known = keyed(spread, K.name_readings(F.col("as")), "company_key", "rank")
    found = asked.join(known, "k").groupBy("name", "company_key").agg(F.min("rank").alias("rank"))
    return latest(found, ["name"], F.asc("rank"), F.asc("company_key")).select("name", "company_key")


def resolve_names(names: DataFrame, companies: DataFrame) -> DataFrame:
    """Canonical name: the same spelling, else the same but for case, else that of an alias, else the name itself."""
    known = companies.select("company", F.col("company").alias("spelling"), F.lit(0).alias("o")).unionByName(companies.select("company", F.explode("aliases").alias("spelling"), F.lit(2).alias("o")))
    known = known.withColumn("low", K.lookup_name(F.col("spelling")))
    joined = names.withColumn("low", K.lookup_name(F.col("name"))).join(known, "low", "left")
    order = F.when(F.col("spelling") == F.col("name"), F.col("o")).otherwise(F.col("o") + 1)
    return latest(joined.withColumn("o", order), ["name"], F.asc("o"), F.asc("company")).select("name", F.coalesce("company", "name").alias("canonical"))


def evidence_lists(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("source", "content"))).alias("evidence"))


def denormalise(rows: DataFrame, companies: DataFrame, applications: DataFrame, priority: Sequence[str]) -> DataFrame:
    """Postings with headquarters and application, the best of their regions by ``priority``, and places to show."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(priority) for x in (r, i)])
    best = F.array_min(F.transform("locations", lambda x: F.struct(F.coalesce(F.try_element_at(order, x["region"]), F.lit(len(priority))).alias("p"), x["region"].alias("region"))))
    shown = F.array_distinct(F.filter(F.transform("locations", lambda x: F.concat_ws(", ", x["city"], x["country"])), lambda t: t != ""))
    joined = rows.join(companies, rows["company_id"] == companies["company_key"], "left").join(applications, rows["id"] == applications["posting"], "left")
    return joined.withColumn("best_region", best["region"]).withColumn("places", shown)
