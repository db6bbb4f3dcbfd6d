"""Which stored posting a fetched one is, and what the merge of a batch writes.

Postings of a batch have ``pos, company_id, hash, norm, desc, body_len, url, req, title, seg``: their place in the batch, the keys of
:mod:`roleflow.functions.keys` (``title`` is the strong title, ``seg`` the keys of its segments) and the length of their body. Stored
rows have ``id, company_id, hash, norm, desc, body_len, urls, reqs, title, seg, status, score, first_seen``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roleflow import vocabulary as V
from roleflow.functions import keys as K
from roleflow.functions import values as D
from roleflow.operators.graph import connected_components
from roleflow.operators.joins import first_of_keys
from roleflow.session import cut

# Words that never tell two titles at one link apart.
TITLE_STOPWORDS = ("of", "the", "a", "an", "and", "or", "for", "to", "on", "in", "at")
GONE = ("archived", "expiring")


def title_words(title: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.coalesce(title, F.lit("")), " "), lambda w: (w != "") & ~w.isin(*TITLE_STOPWORDS)))


def same_title(a: Column, b: Column) -> Column:
    """Whether two strong titles at one link are one role: one contains the other, or its words are among the other's."""
    x, y = title_words(a), title_words(b)
    subset = (F.size(x) > 0) & (F.size(y) > 0) & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))
    return F.coalesce((a != "") & (b != "") & (a.contains(b) | b.contains(a) | subset), F.lit(False))


def title_overlap(a: Column, b: Column) -> Column:
    """Jaccard overlap of two titles' words, 0 where one has none."""
    x, y = title_words(a), title_words(b)
    some = (F.size(x) > 0) & (F.size(y) > 0)
    return F.when(some, F.size(F.array_intersect(x, y)).cast("double") / F.size(F.array_union(x, y))).otherwise(0.0)


def different_bodies(fp_a: Column, fp_b: Column, n_a: Column, n_b: Column) -> Column:
    """Whether two bodies say that two roles differ: other fingerprints, and lengths within a third of each other."""
    sized = (n_a > 0) & (n_b > 0) & (F.least(n_a, n_b) * 3 >= F.greatest(n_a, n_b))
    return F.coalesce((fp_a != fp_b) & sized, F.lit(False))


def settled(status: Column, score: Column) -> Column:
    """A row that carries a decision or a real score."""
    return status.isin(*V.DECIDED) | F.coalesce(score >= 0, F.lit(False))


def first_holders(store: DataFrame) -> DataFrame:
    """The first holder of each key of an employer, decided rows before others: ``company_id, kind, key, id``."""
    one = lambda kind, c: F.transform(c, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))
    pairs = F.flatten(F.array(one("norm", F.array("norm")), one("desc", F.array("desc")), one("url", F.col("urls")), one("req", F.col("reqs")), one("seg", F.col("seg"))))
    decided = F.col("status").isin(*V.DECIDED).alias("decided")
    return first_of_keys(store.select("id", "company_id", "first_seen", decided, F.explode(pairs).alias("p")).select("id", "company_id", "first_seen", "decided", "p.*").where("key <> ''"))


def exact_hits(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Postings whose exact key is stored: ``pos, match, kind, insert_hash``; a body of its own makes a posting a fork of the stored role.

    It stays with the stored row if an earlier posting of the batch has the key too, the row is settled, or both carry one requisition.
    """
    row = store.select(F.col("id").alias("match"), F.col("hash").alias("_hash"), F.col("desc").alias("_desc"), F.col("body_len").alias("_len"), F.col("reqs").alias("_reqs"), F.col("status").alias("_status"), F.col("score").alias("_score"))
    joined = batch.join(row, F.col("hash") == F.col("_hash"))
    again = F.row_number().over(W.partitionBy("hash").orderBy("pos")) > 1
    differs = different_bodies(F.col("desc"), F.col("_desc"), F.col("body_len"), F.col("_len"))
    stays = ~differs | again | settled(F.col("_status"), F.col("_score")) | F.coalesce(F.array_contains("_reqs", F.col("req")), F.lit(False))
    marked = joined.select("pos", "match", "hash", stays.alias("stays"), F.when(~stays, K.sibling_key(F.col("hash"), F.col("desc"))).alias("salted"))
    sibling = store.select(F.col("id").alias("_sibling"), F.col("hash").alias("salted"))
    forked = marked.join(sibling, "salted", "left")
    kind = F.when(F.col("stays") | F.col("_sibling").isNotNull(), "exact").otherwise("fork")
    return forked.select("pos", F.when(F.col("stays"), F.col("match")).otherwise(F.col("_sibling")).alias("match"), kind.alias("kind"), F.coalesce("salted", "hash").alias("insert_hash"))


def options(batch: DataFrame, store: DataFrame, live: DataFrame) -> DataFrame:
    """Rows that a posting without an exact hit may be, in the order in which they are tried: ``pos, step, match, kind``.

    ``live`` has the exact keys ``company_id, hash`` that the batch lists: a stored row whose own title is listed too is another role.
    """
    asked = F.flatten(
        F.array(
            F.array(F.struct(F.lit(1).alias("step"), F.lit("req").alias("as"), F.lit("req").alias("kind"), F.col("req").alias("key"))),
            F.array(F.struct(F.lit(2).alias("step"), F.lit("url").alias("as"), F.lit("url").alias("kind"), F.col("url").alias("key"))),
            F.array(F.struct(F.lit(3).alias("step"), F.lit("norm").alias("as"), F.lit("norm").alias("kind"), F.col("norm").alias("key"))),
            F.array(F.struct(F.lit(4).alias("step"), F.lit("desc").alias("as"), F.lit("desc").alias("kind"), F.col("desc").alias("key"))),
            F.array(F.struct(F.lit(5).alias("step"), F.lit("seg").alias("as"), F.lit("seg").alias("kind"), F.col("norm").alias("key"))),
            F.transform("seg", lambda s, i: F.struct((i + 6).alias("step"), F.lit("seg").alias("as"), F.lit("norm").alias("kind"), s.alias("key"))),
        )
    )
    keyed = batch.select("pos", "company_id", "title", "desc", "body_len", "url", F.explode(asked).alias("o")).select("*", "o.*").drop("o").where("key <> ''")
    hits = keyed.join(first_holders(store), ["company_id", "kind", "key"])
    row = store.select("id", F.col("title").alias("_title"), F.col("desc").alias("_desc"), F.col("body_len").alias("_len"), "urls", "status", "score", F.col("company_id").alias("_company"), F.col("hash").alias("_hash"))
    listed = live.select(F.col("company_id").alias("_company"), F.col("hash").alias("_hash")).distinct()
    near = hits.join(row, "id").join(listed, ["_company", "_hash"], "left_anti")
    how, differs = F.col("as"), different_bodies(F.col("desc"), F.col("_desc"), F.col("body_len"), F.col("_len"))
    other_link = F.coalesce((F.col("url") != "") & (F.size("urls") > 0) & ~F.array_contains("urls", F.col("url")), F.lit(False))
    same_body = F.coalesce(F.col("desc") == F.col("_desc"), F.lit(False))
    fits = (
        F.when(how == "req", same_body | (title_overlap(F.col("title"), F.col("_title")) >= 0.5))
        .when(how == "url", same_title(F.col("title"), F.col("_title")))
        .when(how == "seg", ~differs)
        .otherwise(~other_link | settled(F.col("status"), F.col("score")))
    )
    kind = F.when(how == "url", "norm").otherwise(how)
    return near.where(fits).select("pos", "step", F.col("id").alias("match"), kind.alias("kind"))


def claim(wishes: DataFrame) -> DataFrame:
    """One wish ``pos, step, match, ...`` a posting, its first one that no earlier posting claims; each row is claimed once.

    The postings ask for their next wish together; a row keeps the earliest that asked, and what comes later than that one loses the
    wish for good, so the result is that of postings choosing one after the other.
    """
    wishes = cut(wishes)
    while True:
        first = wishes.withColumn("_r", F.row_number().over(W.partitionBy("pos").orderBy("step"))).where("_r = 1").drop("_r")
        held = first.groupBy("match").agg(F.min("pos").alias("_holder"))
        lost = wishes.join(held, "match").where("pos > _holder").select("pos", "step")
        left = cut(wishes.join(lost, ["pos", "step"], "left_anti"))
        if left.count() == wishes.count():
            return first
        wishes = left


def resolve_batch(batch: DataFrame, store: DataFrame) -> DataFrame:
    """``pos, match, kind, insert_hash`` for each posting: the stored row that it is with the key that told so, or a new row's key.

    Postings that share an exact key with an earlier one of the batch go where that one goes.
    """
    batch = cut(batch)
    exact = exact_hits(batch, store)
    rest = batch.join(exact.select("pos"), "pos", "left_anti")
    leader = F.min("pos").over(W.partitionBy("hash"))
    rest = cut(rest.withColumn("leader", leader))
    claimed = claim(options(rest.where("pos = leader"), store, batch.select("company_id", "hash")))
    led = rest.select("pos", "leader", "hash").join(claimed.select(F.col("pos").alias("leader"), "match", "kind"), "leader", "left")
    kind = F.when(F.col("pos") == F.col("leader"), F.coalesce("kind", F.lit("new"))).otherwise("exact")
    return exact.unionByName(led.select("pos", "match", kind.alias("kind"), F.col("hash").alias("insert_hash")))


def merge_batch(store: DataFrame, batch: DataFrame, resolved: DataFrame, today: Column, *, board: bool) -> DataFrame:
    """The rows that a resolved batch writes: stored rows as they are after it, and new ones without ``id``.

    ``store`` has ``id, hash, title, status, status_reason, snippet, description, department, deadline, last_seen, first_seen``, ``batch`` has
    ``pos, title, snippet, description, department, deadline``. What is listed again is alive: archived and expiring rows are unseen again
    and lose their reason. A match by normalised title or body is a new name for the row. Text fields are filled where they
    are missing; with ``board`` off a description also gives way to one that is longer by more than 100 characters. A decided row
    keeps its text on a match by name. Of several postings of a row the first that has a field gives it; the longest gives the text.
    """
    joined = resolved.join(batch, "pos")
    nonempty = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    first = lambda c: F.min_by(nonempty(c), F.when(nonempty(c).isNotNull(), F.col("pos")))
    rename = F.col("kind").isin("norm", "desc")
    given = F.coalesce("deadline", D.deadline_of(F.col("description")))
    facts = (
        first("snippet").alias("n_snippet"),
        first("department").alias("n_department"),
        F.min_by(given, F.when(given.isNotNull(), F.col("pos"))).alias("n_deadline"),
        F.max(F.when(~rename, F.struct(F.length("description").alias("n"), (-F.col("pos")).alias("p"), F.col("description").alias("d"))))["d"].alias("n_exact_text"),
        F.max(F.struct(F.length("description").alias("n"), (-F.col("pos")).alias("p"), F.col("description").alias("d")))["d"].alias("n_text"),
        F.max_by("title", F.when(rename, F.col("pos"))).alias("n_title"),
        F.max_by("insert_hash", F.when(rename, F.col("pos"))).alias("n_hash"),
    )
    seen = joined.where("match is not null").groupBy(F.col("match").alias("id")).agg(*facts)
    both = store.join(seen, "id")
    text = F.when(F.col("status").isin(*V.DECIDED), F.col("n_exact_text")).otherwise(F.col("n_text"))
    empty = F.length(F.coalesce("description", F.lit(""))) == 0
    longer = empty if board else F.length(text) > F.length(F.coalesce("description", F.lit(""))) + 100
    alive = F.col("status").isin(*GONE)
    updated = both.select(
        F.col("id").alias("id"),
        F.coalesce("n_hash", "hash").alias("hash"),
        F.coalesce("n_title", "title").alias("title"),
        F.when(alive, "unseen").otherwise(F.col("status")).alias("status"),
        F.when(~alive, F.col("status_reason")).alias("status_reason"),
        F.coalesce(nonempty("snippet"), "n_snippet").alias("snippet"),
        F.when(F.coalesce(longer & (F.length(text) > 0), F.lit(False)), text).otherwise(F.col("description")).alias("description"),
        F.coalesce(nonempty("department"), "n_department").alias("department"),
        F.coalesce("deadline", "n_deadline").alias("deadline"),
        "first_seen",
        today.alias("last_seen"),
    )
    fresh = joined.where("match is null").withColumn("_r", F.row_number().over(W.partitionBy("insert_hash").orderBy("pos"))).where("_r = 1")
    inserted = fresh.select(
        F.lit(None).cast(store.schema["id"].dataType).alias("id"), F.col("insert_hash").alias("hash"), "title", F.lit("unseen").alias("status"), F.lit(None).cast("string").alias("status_reason"),
        nonempty("snippet").alias("snippet"), "description", nonempty("department").alias("department"), given.alias("deadline"), today.alias("first_seen"), today.alias("last_seen"),
    )
    return updated.unionByName(inserted)


def import_outcomes(gated: DataFrame, resolved: DataFrame) -> DataFrame:
    """A row for each posting ``pos, skip, archived`` of a board: ``pos, outcome, match`` with invalid, archived, existing or new."""
    joined = gated.join(resolved.select("pos", "match"), "pos", "left")
    outcome = F.when(F.col("skip").isNotNull(), "invalid").when(F.col("archived"), "archived").when(F.col("match").isNotNull(), "existing").otherwise("new")
    return joined.select("pos", outcome.alias("outcome"), F.when(outcome == "existing", F.col("match")).alias("match"))


def by_posting_url(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The stored row, of any employer, at one of the links of ``asked(ask, urls, title)`` whose title fits; the oldest of several.

    Titles of a link meet once each, however many rows have them: the oldest row stands for the stored ones.
    """
    of_link = rows.select("id", "first_seen", F.col("title").alias("_title"), F.explode("urls").alias("url")).where("url <> ''")
    stored = of_link.groupBy("url", "_title").agg(F.min(F.struct("first_seen", "id")).alias("m"))
    links = asked.select("ask", "title", F.explode("urls").alias("url")).where("url <> ''")
    hits = links.select("url", "title").distinct().join(stored, "url").where(same_title(F.col("title"), F.col("_title")))
    found = hits.groupBy("url", "title").agg(F.min("m").alias("m"))
    return links.join(found, ["url", "title"]).groupBy("ask").agg(F.min("m").alias("m")).select("ask", "m.id")


def across_companies(rows: DataFrame) -> DataFrame:
    """Clusters of rows ``id, company_id, title, urls`` of different employers that share a link and a title: ``id, company_id, cluster``.

    Each later holder of a link is compared with its first one only.
    """
    spread = rows.select("id", "company_id", "title", F.explode(F.array_distinct("urls")).alias("url")).where("url <> ''")
    first = spread.groupBy("url").agg(F.min(F.struct("id", "company_id", "title")).alias("f"))
    edges = spread.join(first, "url").where((F.col("id") != F.col("f.id")) & (F.col("company_id") != F.col("f.company_id")) & same_title(F.col("title"), F.col("f.title")))
    found = connected_components(edges.select(F.col("f.id").alias("src"), F.col("id").alias("dst")))
    joined = found.join(rows.select(F.col("id").alias("node"), "company_id"), "node")
    several = joined.groupBy("component").agg(F.count_distinct("company_id").alias("n")).where("n > 1").select("component")
    return joined.join(several, "component").select(F.col("node").alias("id"), "company_id", F.col("component").alias("cluster"))


def company_merges(clusters: DataFrame, rows: DataFrame, companies: DataFrame) -> DataFrame:
    """Employers of a cluster whose names read as the winner's: ``loser, winner``; each loses once.

    The winner has most postings, then the earliest entry, then the smallest id. ``companies`` has ``company_id, name, created``.
    """
    counted = rows.groupBy("company_id").agg(F.count(F.lit(1)).alias("n"))
    state = companies.join(counted, "company_id", "left").select("company_id", "name", "created", F.coalesce("n", F.lit(0)).alias("n"))
    inside = clusters.select("cluster", "company_id").distinct().join(state, "company_id")
    place = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("n"), F.asc("created"), F.asc("company_id")))
    ranked = inside.withColumn("_r", place)
    winner = ranked.where("_r = 1").select("cluster", F.col("company_id").alias("winner"), F.col("name").alias("_winner"))
    reads = lambda c: F.transform(K.name_readings(c), lambda w: F.array_join(F.array_sort(F.array_distinct(w)), " "))
    pairs = ranked.where("_r > 1").join(winner, "cluster").where(F.arrays_overlap(reads(F.col("name")), reads(F.col("_winner"))))
    return pairs.groupBy(F.col("company_id").alias("loser")).agg(F.min_by("winner", F.struct("cluster")).alias("winner"))
