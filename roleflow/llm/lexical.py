"""Ranked lexical search: an exact inner-product search in ball trees over sparse document vectors."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roleflow.llm.decontaminate import words_of
from roleflow.session import Scratch, cut

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Settings:
    """``terms``: item terms searched in one round, which bounds what is broadcast; ``block``: documents of one tree; ``leaf``: of one of its leaves."""

    k: int = 10
    terms: int = 1 << 13
    block: int = 1 << 12
    leaf: int = 16


class Rows:
    """Sparse integer rows: row r has the values ``value`` at the columns ``column`` from ``start[r]`` to ``start[r + 1]``."""

    def __init__(self, start: np.ndarray, column: np.ndarray, value: np.ndarray):
        self.start, self.column, self.value = start, column, value

    def take(self, order: np.ndarray) -> Rows:
        size = np.diff(self.start)[order]
        start = np.r_[0, np.cumsum(size)]
        at = np.repeat(self.start[order] - start[:-1], size) + np.arange(start[-1])
        return Rows(start, self.column[at], self.value[at])

    def dot(self, dense: np.ndarray, a: int, b: int) -> np.ndarray:
        """Products of the rows a to b, none of which is empty, with a dense vector of the same kind of numbers."""
        lo, hi = self.start[a], self.start[b]
        return np.add.reduceat(self.value[lo:hi] * dense[self.column[lo:hi]], self.start[a:b] - lo)


class BallTree:
    """Balls around blocks of rows, halved down to ``leaf`` rows; rows are put in the order of the leaves.

    A node has a centroid, the radius of its rows about it, and the radius term by term: how far a row's value lies above the centroid's. A query has few of
    all terms, so the one radius, into which all terms go, is often too wide for it, and the radii of its own terms are narrower. Radii are those about the
    centroid as it is kept, in single precision; each is rounded up by more than the sums that it came from can be wrong.
    """

    def __init__(self, rows: Rows, scale: np.ndarray, leaf: int):
        n, width = len(rows.start) - 1, len(scale)
        points = Rows(rows.start, rows.column, rows.value * scale[rows.column])
        square = np.add.reduceat(points.value**2, points.start[:-1])
        self.order, self.up = np.arange(n), [-1]
        self.span, centres, tops, radii, todo = [(0, n)], [], [], [], [0]
        self.leaves = []
        for node in todo:
            a, b = self.span[node]
            own, m, norm = points.take(self.order[a:b]), b - a, square[self.order[a:b]]
            centre = (np.bincount(own.column, weights=own.value, minlength=width) / m).astype(np.float32)
            top = np.zeros(width)
            np.maximum.at(top, own.column, own.value)
            centres.append(centre)
            tops.append((np.maximum(top - centre, 0) * (1 + 1e-6)).astype(np.float32))
            radii.append(math.sqrt(_distances(own, norm, centre.astype(float)).max()) * (1 + 1e-9))
            if m <= leaf:
                self.leaves.append(node)
                continue
            mid = a + self._halve(own, norm, centre.astype(float), self.order[a:b])
            for part in ((a, mid), (mid, b)):
                self.up.append(node)
                self.span.append(part)
                todo.append(len(self.span) - 1)
        self.centre, self.top, self.radius = np.array(centres), np.array(tops), np.array(radii)
        self.rows = rows.take(self.order)

    @staticmethod
    def _halve(own: Rows, norm: np.ndarray, centre: np.ndarray, order: np.ndarray) -> int:
        """Put rows near the one of two far points first, and those near the other one behind; the points move to their rows' middle twice."""
        m, width = len(norm), len(centre)
        row = np.repeat(np.arange(m), np.diff(own.start))

        def point(r: int) -> np.ndarray:
            dense = np.zeros(width)
            dense[own.column[own.start[r] : own.start[r + 1]]] = own.value[own.start[r] : own.start[r + 1]]
            return dense

        one = point(int(_distances(own, norm, centre).argmax()))
        two = point(int(_distances(own, norm, one).argmax()))
        for _ in range(3):
            lean = _distances(own, norm, one) - _distances(own, norm, two)
            side = lean > 0
            many = int(side.sum())
            if many in (0, m):
                break
            both = np.bincount(own.column + width * side[row], weights=own.value, minlength=2 * width).reshape(2, width)
            one, two = both[0] / (m - many), both[1] / many
        order[:] = order[np.argsort(lean, kind="stable")]
        least = m // 8
        return min(max(m - many, least, 1), m - max(least, 1))

    def bounds(self, column: np.ndarray, value: np.ndarray) -> np.ndarray:
        """For each node a number that no product of the query with one of its rows exceeds."""
        middle = self.centre[:, column] @ value
        reach = np.minimum(math.sqrt(value @ value) * self.radius, self.top[:, column] @ value)
        most = (middle + reach) * (1 + 1e-9) + 1e-3
        for node in range(1, len(most)):
            most[node] = min(most[node], most[self.up[node]])
        return most

    def search(self, column: np.ndarray, value: np.ndarray, dense: np.ndarray, ids: np.ndarray, best: list, k: int) -> int:
        """Put the rows of greatest score into ``best``, a sorted list of (-score, doc), best subtree first; the number of rows scored.

        ``dense`` has the integer weights of the query by column, ``column`` and ``value`` its scaled form for the bounds.
        """
        most, scored = self.bounds(column, value)[self.leaves], 0
        for i in np.argsort(-most, kind="stable").tolist():
            if len(best) == k and most[i] < -best[-1][0]:
                break
            a, b = self.span[self.leaves[i]]
            scores = self.rows.dot(dense, a, b)
            scored += b - a
            good = np.flatnonzero(scores >= (-best[-1][0] if len(best) == k else 1))
            if len(good):
                best += [(-int(scores[i]), int(ids[a + i])) for i in good]
                best.sort()
                del best[k:]
        return scored


def _distances(rows: Rows, norm: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Squared distances to a point, rounded up."""
    cross, own = np.add.reduceat(rows.value * dense[rows.column], rows.start[:-1]), float(dense @ dense)
    return np.maximum(norm - 2 * cross + own, 0) + 1e-12 * (norm + own)


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term, repeats``; rows of one item_id are one item."""
    return items.select("item_id", F.explode(words_of(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("repeats"))


def _vectors(docs: DataFrame, terms: list[str]) -> DataFrame:
    """``doc_id, n, terms, tfs``: the terms of a text, and how often it has those of the list."""
    numbers = docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(terms)})

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbers.value.get
        for batch in it:
            sizes, found = [], []
            for text in batch.column("text").to_pylist():
                words = TERM.findall((text or b"").lower())
                count = Counter(map(number, words))
                count.pop(None, None)
                sizes.append(len(words))
                found.append(sorted(count.items()))
            terms = pa.array([[t for t, _ in x] for x in found], pa.list_(pa.int32()))
            tfs = pa.array([[n for _, n in x] for x in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), terms, tfs], names=["doc_id", "n", "terms", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<long>").where("n > 0")


def _block(ids: list, sizes: list, columns: list, tfs: list, n: int, total: int) -> tuple[np.ndarray, Rows]:
    """Integer rows of documents: for each term the whole of a thousand million tf by 1000 tf + 8 m."""
    long = np.array([25 + 75 * size * n // total for size in sizes], np.int64)
    count = np.array([len(c) for c in columns], np.int64)
    column, tf = np.concatenate(columns), np.concatenate(tfs)
    value = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(long, count))
    return np.array(ids, np.int64), Rows(np.r_[0, np.cumsum(count)], column.astype(np.int64), value)


def _best(vectors: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n: int, total: int, settings: Settings) -> DataFrame:
    """``item int, doc_id, score``: of each task the ``k`` documents of greatest score for each query."""
    shared = vectors.sparkSession.sparkContext.broadcast((queries, weights))
    last = (1 << 63) - 1

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = shared.value
        scale = np.sqrt(weights.astype(float))
        best = [[] for _ in queries]

        def search(parts: list) -> None:
            ids, rows = _block(*(sum(x, []) for x in zip(*parts)), n, total)
            # Columns of weight 0 carry nothing; rows are never empty, since documents without any term aren't read.
            tree = BallTree(rows, scale, settings.leaf)
            ids = ids[tree.order]
            dense = np.zeros(len(weights), np.int64)
            for q, (column, repeats) in enumerate(queries):
                dense[column] = repeats * weights[column]
                tree.search(column, repeats * scale[column], dense, ids, best[q], settings.k)
                dense[column] = 0

        parts, held = [], 0
        for batch in it:
            ids = [last if x is None else x for x in batch.column("doc_id").to_pylist()]
            split = lambda c: [np.asarray(x) for x in batch.column(c).to_numpy(zero_copy_only=False)]
            parts.append((ids, batch.column("n").to_pylist(), split("terms"), split("tfs")))
            held += len(ids)
            if held >= settings.block:
                search(parts)
                parts, held = [], 0
        if parts:
            search(parts)
        rows = [(q, doc, -score) for q, own in enumerate(best) for score, doc in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    return vectors.where("size(terms) > 0").select(F.col("doc_id").cast("long"), "n", "terms", "tfs").mapInArrow(run, "item int, doc_id long, score long")


def _rounds(terms: DataFrame, most: int) -> list[Column]:
    """Conditions on item_id: ranges of about ``most`` rows of ``terms`` each."""
    total = terms.count()
    count = -(-total // most) or 1
    return [F.pmod(F.xxhash64("item_id"), F.lit(count)) == i for i in range(count)]


def search(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each item the ``k`` documents of ``docs(doc_id long, text)`` with the greatest score above 0.

    Terms are runs of digits, letters and all beyond ASCII, A-Z lower-cased. Scores are whole numbers and exact: ball trees over blocks
    of documents only leave out subtrees whose bound, rounded up, is below the k-th score that a task has so far. Null and empty texts have
    no terms and count nowhere; rows of one item_id are one item, whose terms add up; a null item_id is an item; each row of docs is a document
    of its own, so repeated ones have ranks of their own; a null doc_id comes last among equal scores; an empty table of either kind gives no rows;
    other columns are left out. Items are searched in rounds of about ``terms`` terms, one item with more in a round of its own.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        terms = scratch.put(item_terms(items))
        found, seen = None, None
        for rows in _rounds(terms, settings.terms):
            block = terms.where(rows).orderBy("item_id", "term").collect()
            names = sorted({r["term"] for r in block})
            vectors = scratch.put(_vectors(docs, names))
            seen = seen or vectors.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
            df = {r["t"]: r["n"] for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
            n, number = seen["n"], {t: i for i, t in enumerate(names)}
            weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(names))], np.int64)
            ids = list(dict.fromkeys(r["item_id"] for r in block))
            of = {i: ([], []) for i in ids}
            for r in block:
                of[r["item_id"]][0].append(number[r["term"]])
                of[r["item_id"]][1].append(r["repeats"])
            queries = [(np.array(c, np.int64), np.array(v, np.int64)) for c, v in of.values()]
            part = _best(vectors, queries, weights, n, seen["all"], settings)
            name = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
            order = W.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
            top = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.k)
            top = top.join(F.broadcast(name), "item").select("item_id", "rank", F.when(F.col("doc_id") < (1 << 63) - 1, F.col("doc_id")).alias("doc_id"), "score")
            found = top if found is None else found.unionByName(top)
        return cut(found)


#: The same in SQL over the tables ``documents`` and ``benchmark``.
SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
sized AS (SELECT doc_id, len(ws) AS n, ws FROM texts WHERE len(ws) > 0),
total AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sized),
items AS (
  SELECT item_id, term, count(*) AS c
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term),
tf AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(ws) AS term FROM sized)
  WHERE term IN (SELECT term FROM items) GROUP BY doc_id, n, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, total),
scored AS (
  SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM items JOIN tf USING (term) JOIN weight USING (term), total GROUP BY item_id, doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
