"""Look-alike titles: a similarity join by rare pairs of letters, with exact bounds, and matching blocks in batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roleflow import vocabulary as V
from roleflow.functions import keys as K
from roleflow.session import cut

#: Cells of the tables that one step of a batch fills.
CELLS = 1 << 18


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts one after the other, and where each begins."""
    size = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.r_[0, np.cumsum(size)]


def _window(codes: np.ndarray, low: np.ndarray, high: np.ndarray, width: int, filler: int) -> np.ndarray:
    at = low[:, None] + np.arange(width)
    inside = at < high[:, None]
    return np.where(inside, codes[np.minimum(at, len(codes) - 1)].astype(np.int64), filler)


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the longest common block of two windows, the first in a and then in b: its length and starts."""
    n, width = len(a), b.shape[1]
    run, size, ends, at = np.zeros((n, width + 1), np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(a.shape[1]):
        run[:, 1:] = np.where(a[:, i : i + 1] == b, run[:, :-1] + 1, 0)
        j = run.argmax(axis=1)
        best = run[np.arange(n), j]
        better = best > size
        size[better], ends[better], at[better] = best[better], i + 1, j[better]
    return size, ends - size, at - size


def matched(x: list[str], y: list[str]) -> np.ndarray:
    """Characters in the matching blocks of each pair: the longest common block, then the same to the left and to the right of it.

    All pairs advance together: a step looks for the longest block of every stretch that is left, in tables of bounded size.
    """
    (a, a_off), (b, b_off) = _codes(x), _codes(y)
    total = np.zeros(len(x), np.int64)
    work = np.column_stack([np.arange(len(x)), a_off[:-1], a_off[1:], b_off[:-1], b_off[1:]])
    while len(work := work[(work[:, 2] > work[:, 1]) & (work[:, 4] > work[:, 3])]):
        work = work[np.argsort(np.maximum(work[:, 2] - work[:, 1], work[:, 4] - work[:, 3]), kind="stable")]
        after, start = [], 0
        while start < len(work):
            reach = np.maximum(work[start:, 2] - work[start:, 1], work[start:, 4] - work[start:, 3])
            fits = np.flatnonzero(reach * np.arange(1, len(reach) + 1) > CELLS)
            end = start + max(1, int(fits[0]) if len(fits) else len(reach))
            part = work[start:end]
            pair, a_low, a_high, b_low, b_high = part.T
            size, i, j = _longest(_window(a, a_low, a_high, int((a_high - a_low).max()), -1), _window(b, b_low, b_high, int((b_high - b_low).max()), -2))
            np.add.at(total, pair, size)
            i, j = a_low + i, b_low + j
            good = size > 0
            after.append(np.column_stack([pair, a_low, i, b_low, j])[good])
            after.append(np.column_stack([pair, i + size, a_high, j + size, b_high])[good])
            start = end
        work = np.concatenate(after)
    return total


def similarity(a: Column, b: Column) -> Column:
    """Share of matching blocks of two texts, from 0 to 1; it depends on the order of the two. 0 where one is empty or null."""

    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        x, y = x.fillna("").tolist(), y.fillna("").tolist()
        size = np.array([len(p) + len(q) for p, q in zip(x, y)], float)
        return pd.Series(np.divide(2.0 * matched(x, y), size, out=np.zeros(len(x)), where=size > 0))

    return F.pandas_udf(ratio, "double")(a, b)


def _bags(kinds: DataFrame) -> DataFrame:
    """With ``bag``: the pairs of letters of ``text``, each numbered by how often it came before, as strings."""
    letters = F.transform(F.sequence(F.lit(1), F.char_length("text") - 1), lambda i: F.col("text").substr(i, F.lit(2)))
    grams = kinds.withColumn("_grams", F.when(F.char_length("text") > 1, F.array_sort(letters)).otherwise(F.array().cast("array<string>")))
    # In sorted order a pair's number is its distance from the first of its kind.
    bag = F.transform("_grams", lambda g, i: F.concat(g, (i - F.array_position("_grams", g) + 2).cast("string")))
    return grams.withColumn("bag", bag).drop("_grams")


def candidates(kinds: DataFrame, least: float) -> DataFrame:
    """Pairs of ``org, id, text, bag`` that may reach the measure: ``org, left_id, right_id, x, y``.

    Texts of T characters with M in blocks have T - 2 M characters outside, at most one block more than these, and so at least 3 M - T - 1 pairs of
    letters in common, which is (3/2 least - 1) T - 1. With pairs in one order, rare ones first, two such texts meet in the first
    pairs of each, as many as it has beyond that bound: only these are joined. Where the bound is below 1, all texts meet in one mark.
    """
    if least <= 2 / 3:
        raise ValueError("below two thirds no number of common pairs follows from the measure")
    share, nearest = 1.5 * least - 1, least / (2 - least)
    bound = lambda chars: F.ceil(share * chars - 1 - 1e-9)
    rows = kinds.withColumn("n", F.char_length("text")).where("n > 0").withColumn("need", bound(F.col("n") * (1 + nearest)))
    spread = rows.select("org", "id", "n", "need", F.size("bag").alias("g"), F.explode("bag").alias("gram"))
    often = spread.groupBy("org", "gram").agg(F.count(F.lit(1)).alias("often"))
    ranked = spread.join(often, ["org", "gram"]).groupBy("org", "id", "n", "need", "g").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("order"))
    head = F.slice("order", F.lit(1), F.greatest(F.lit(0), F.col("g") - F.col("need") + 1).cast("int"))
    head = ranked.select("org", "id", "n", "g", F.posexplode(F.transform(head, lambda s: s["gram"])).alias("at", "gram"))
    # Both texts of a pair whose bound is below 1 have themselves a bound below 1.
    short = rows.where("need < 1").select("org", "id", "n", F.lit(1 << 20).alias("g"), F.lit(0).alias("at"), F.lit("").alias("gram"))
    keys = head.unionByName(short)
    a, b = keys.alias("a"), keys.alias("b")
    total = F.col("a.n") + F.col("b.n")
    # Behind the first pair of letters in common there are no more than what the shorter rest holds.
    left = F.least(F.col("a.g") - F.col("a.at"), F.col("b.g") - F.col("b.at"))
    on = (F.col("a.org") == F.col("b.org")) & (F.col("a.gram") == F.col("b.gram")) & (F.col("a.id") < F.col("b.id"))
    on &= (2.0 * F.least("a.n", "b.n") >= least * total) & (left >= bound(total))
    pairs = a.join(b, on).select(F.col("a.org").alias("org"), F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id")).distinct()
    of = kinds.select("id", "text", "bag", "same")
    both = pairs.join(of.toDF("left_id", "x", "_p", "_s"), "left_id").join(of.toDF("right_id", "y", "_q", "_t"), "right_id")
    common = F.size(F.array_intersect("_p", "_q"))
    return both.where((F.col("_s") != F.col("_t")) & (common >= bound(F.char_length("x") + F.char_length("y")))).select("org", "left_id", "right_id", "x", "y")


def title_pairs(rows: DataFrame, least: float = V.SIMILAR_TITLES, compared: Column | None = None, same: Column | None = None) -> DataFrame:
    """``org, left_id, right_id, same, ratio``: rows ``id, org, title`` of one employer whose titles are the same or alike, left_id below right_id.

    Titles that are the same (by default without place, level and plural) make a class: its first row is joined with each other row of a different text.
    Of different classes all pairs of different texts (by default the title in lower case) are found whose share of matching blocks is at least ``least``; a text stands for
    all rows that have it by the smallest id. Null and empty titles and null employers have no pairs.
    """
    texts = rows.select("org", "id", (F.lower("title") if compared is None else compared).alias("text"), (K.strong_title(F.col("title")) if same is None else same).alias("same"))
    kinds = texts.where("org is not null and text <> ''").groupBy("org", "text", "same").agg(F.min("id").alias("id"))
    kinds = cut(_bags(kinds))
    first = kinds.groupBy("org", "same").agg(F.min_by(F.struct("id", "text"), "id").alias("f"))
    stars = kinds.join(first, ["org", "same"]).where("id <> f.id").select("org", F.col("f.id").alias("left_id"), F.col("id").alias("right_id"), F.lit(True).alias("same"), F.col("f.text").alias("x"), F.col("text").alias("y"))
    pairs = stars.unionByName(candidates(kinds, least).withColumn("same", F.lit(False)))
    rated = pairs.withColumn("ratio", similarity(F.col("x"), F.col("y")))
    return rated.where(F.col("same") | (F.col("ratio") >= least)).select("org", "left_id", "right_id", "same", F.round("ratio", 4).alias("ratio"))
