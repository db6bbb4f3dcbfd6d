"""Benchmark decontamination: a broadcast hash set of normalised test n-grams meets every window of every text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Settings:
    """``block_bytes``: n-grams broadcast at once; a larger benchmark takes several rounds over the texts."""

    window: int = 13
    block_bytes: int = 64 << 20


def words_of(text: Column) -> Column:
    """Words of a text, its A-Z lower-cased; null has none."""
    plain = F.octet_length(text) == F.char_length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), BETWEEN), "")


def _grams(words: Column, at: Column, length: Column, window: int) -> Column:
    """The ``length`` words from ``at`` on with a space between them."""
    return F.concat_ws(" ", *[F.when(length > k, F.get(words, at + k)) for k in range(window)])


def benchmark_grams(benchmark: DataFrame, window: int) -> DataFrame:
    """``gram, length, items``: each distinct window of the benchmark and the items that have it."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where("size(words) > 0")
    items = items.select("*", F.least(F.size("words"), F.lit(window)).alias("length"))
    spread = items.select("*", F.explode(F.expr("sequence(0, size(words) - length)")).alias("at"))
    grams = spread.select("item_id", "length", _grams(F.col("words"), F.col("at"), F.col("length"), window).alias("gram"))
    return grams.groupBy("gram", "length").agg(F.collect_set("item_id").alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, mark, spans, items`` for the documents that hold a benchmark window.

    ``mark`` is a hash of the text, which with doc_id names a row; ``spans`` are the windows found, as sorted
    (first word, end word); ``items`` the distinct items they come from. The set of n-grams is broadcast in blocks of
    bounded size; the match is on the n-grams themselves, so a hit needs no second look.
    """
    grams = benchmark_grams(benchmark, settings.window)
    shape = grams.agg(F.coalesce(F.sum(F.octet_length("gram") + 16 + 8 * F.size("items")), F.lit(0)).alias("bytes"), F.collect_set("length").alias("lengths")).first()
    blocks = -(-shape["bytes"] // settings.block_bytes) or 1
    lengths = sorted(shape["lengths"])
    texts = docs.select("doc_id", F.xxhash64("text").alias("mark"), words_of(F.col("text")).alias("words"))
    longest = lengths[-1] if lengths else settings.window
    if len(lengths) > 1:
        spread = texts.select("*", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("length"))
    else:
        spread = texts.select("*", F.lit(longest).alias("length"))
    spread = spread.where("size(words) >= length").select("*", F.explode(F.expr("sequence(0, size(words) - length)")).alias("at"))
    windows = spread.select("doc_id", "mark", "at", "length", _grams(F.col("words"), F.col("at"), F.col("length"), longest).alias("gram"))
    found = None
    for k in range(blocks):
        block = grams if blocks == 1 else grams.where(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == k)
        part = windows.join(F.broadcast(block.select("gram", "length", "items")), ["gram", "length"])
        found = part if found is None else found.unionByName(part)
    span = F.struct("at", (F.col("at") + F.col("length")).alias("end"))
    return found.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set(span)).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def covered(spans: Column) -> Column:
    """Words in the union of sorted spans."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["upto"], s["at"]))).alias("n"),
            F.greatest(a["upto"], s["end"]).alias("upto"),
        ),
        lambda a: a["n"].cast("long"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every row of ``docs`` with ``n_words, n_hit, items, spans, contaminated``; other columns stay as they are.

    A word is hit if it lies in a benchmark window; a document is contaminated if a twentieth of its words
    or more are. Null or empty texts, and texts without words, have none; rows that repeat get the same answer
    each; an item without item_id counts for hits but is not listed; an empty benchmark hits nothing.
    """
    added = ("n_words", "n_hit", "items", "spans", "contaminated")
    found = hits(docs, benchmark, settings).withColumnsRenamed({"doc_id": "id", "mark": "found"})
    # The row travels as one struct, so none of its columns can clash with those made here.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in added]).alias("row")
    rows = docs.select(whole, F.xxhash64("text").alias("own"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    joined = rows.join(found, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("found")), "left")
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0).cast("long"))
    out = joined.select("row.*", "n_words", n_hit.alias("n_hit"), "items", "spans")
    return out.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without its contaminated documents; all others stay unchanged."""
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    return contamination(packed, benchmark, settings).where("not contaminated").select("whole.*")


def strip(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with ``kept``: the words outside every benchmark window, normalised and joined by spaces."""
    found = contamination(docs, benchmark, settings).withColumn("_w", words_of(F.col("text")))
    inside = F.expr("transform(sequence(0, greatest(size(_w) - 1, 0)), i -> exists(coalesce(spans, array()), s -> s.at <= i and i < s.end))")
    kept = F.expr("array_join(transform(filter(arrays_zip(_w, _in), x -> not x._in and x._w is not null), x -> x._w), ' ')")
    return found.withColumn("_in", inside).withColumn("kept", kept).drop("_w", "_in")


SQL = r"""
WITH d AS (
  SELECT doc_id, text, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i + 1 : i + least(13, len(w))], ' ') AS gram
  FROM b, unnest(range(0, greatest(len(w) - least(13, len(w)) + 1, 0))) AS t(i) WHERE len(w) > 0),
h AS (
  SELECT d.doc_id, d.w, i, l.n, array_to_string(w[i + 1 : i + l.n], ' ') AS gram
  FROM d, (SELECT DISTINCT n FROM g) l, unnest(range(0, greatest(len(w) - l.n + 1, 0))) AS t(i)),
m AS (SELECT h.doc_id, h.i, h.n, g.item_id FROM h JOIN g ON h.gram = g.gram AND h.n = g.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
       FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(it.ids, '')) AS items_sha256,
       coalesce(hit.n_hit, 0) > 0 AND 20 * coalesce(hit.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
