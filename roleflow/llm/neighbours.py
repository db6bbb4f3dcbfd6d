"""Approximate nearest neighbours by multiprobe p-stable hashing, with an exact ranking of what the tables return."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Cells of a projection, numbered from 0; the outermost are open.
CELLS = 8


@dataclass(frozen=True)
class Settings:
    """A query visits buckets of each table in order of estimated success, until a vector as near as its last wanted one is
    expected in one of the tables' visited buckets with a chance of ``goal``.

    How near that is, at most, a ``sample`` of the vectors tells. ``block``: vectors of a table that meet queries in one task.
    ``least``: candidates a table gives at any rate.
    """

    tables: int = 5
    projections: int = 5
    width: float = 1.0
    goal: float = 0.88
    sample: int = 4096
    least: int = 512
    block: int = 8192
    nearest: int = 20

    @property
    def buckets(self) -> int:
        return CELLS**self.projections


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def _directions(dim: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions, which are 2-stable, and offsets."""
    rng = np.random.default_rng(20)
    return rng.normal(size=(dim + 1, s.tables * s.projections)), rng.uniform(0, s.width, s.tables * s.projections)


def _projected(x: np.ndarray, longest: float, s: Settings, query: bool) -> np.ndarray:
    """Places on the (table, projection) lines in cells.

    A component is added to the vectors that makes all equally long, so the nearest in distance is the one of the largest
    inner product; queries are scaled to that length.
    """
    length = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / length if query else x / longest
    extra = np.zeros_like(length) if query else np.sqrt(np.maximum(0, 1 - (length / longest) ** 2))
    directions, offset = _directions(x.shape[1], s)
    return ((np.hstack([x, extra]) @ directions + offset) / s.width + CELLS / 2).reshape(len(x), s.tables, s.projections)


def _buckets(place: np.ndarray, s: Settings) -> np.ndarray:
    cell = np.clip(np.floor(place), 0, CELLS - 1).astype(np.int64)
    return (cell * CELLS ** np.arange(s.projections - 1, -1, -1)).sum(axis=2)


def _index(longest: float, s: Settings):
    """mapInPandas: a row for each vector and table."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in it:
            if not len(frame):
                continue
            bucket = _buckets(_projected(np.stack(frame["v"]).astype(float), longest, s, query=False), s)
            for t in range(s.tables):
                yield pd.DataFrame({"t": t, "bucket": bucket[:, t], "vec_id": frame["vec_id"], "v": frame["v"]})

    return run


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to seven digits (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) / np.sqrt(2 * np.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x > 0, 1 - tail, tail)


def _reach(x: np.ndarray, ids: np.ndarray, known: np.ndarray, known_ids: np.ndarray, longest: float, rank: int) -> np.ndarray:
    """For each query the distance, in the hashed space, to the vector of that rank in the sample, its own row aside."""
    length = np.linalg.norm(x, axis=1, keepdims=True)
    apart = 2 - 2 * (x / length) @ known.T / longest
    apart[ids[:, None] == known_ids[None, :]] = np.inf
    rank = min(rank, apart.shape[1]) - 1
    near = np.partition(apart, rank, axis=1)[:, rank]
    return np.sqrt(np.clip(np.where(np.isfinite(near), near, 4.0), 1e-6, 4.0))


def _visits(longest: float, s: Settings, directory: list[tuple[np.ndarray, np.ndarray]], known: np.ndarray, known_ids: np.ndarray, rank: int):
    """mapInPandas: of each query and table, a row for each first cell with visited buckets and their bits."""
    inner = s.buckets // CELLS
    held = [(np.stack(np.unravel_index(ids, (CELLS,) * s.projections), axis=1), counts, ids) for ids, counts in directory]
    enough = 1 - (1 - s.goal) ** (1 / s.tables)
    edges = np.r_[-np.inf, np.arange(1, CELLS), np.inf]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in it:
            for a in range(0, len(frame), 64):
                part = frame.iloc[a : a + 64]
                x = np.stack(part["v"]).astype(float)
                place = _projected(x, longest, s, query=True)
                spread = _reach(x, part["vec_id"].to_numpy(), known, known_ids, longest, rank) / s.width
                # The chance that a vector at that distance lies in each cell of each line.
                upto = _normal((edges - place[..., None]) / spread[:, None, None, None])
                chance = upto[..., 1:] - upto[..., :-1]
                for t, (cells, counts, ids) in enumerate(held):
                    hit = np.ones((len(part), len(ids)))
                    for k in range(s.projections):
                        hit *= chance[:, t, k][:, cells[:, k]]
                    order = np.argsort(-hit, axis=1, kind="stable")
                    won = np.cumsum(np.take_along_axis(hit, order, axis=1), axis=1)
                    before = np.cumsum(counts[order], axis=1) - counts[order]
                    rows, ranks = np.nonzero((won - np.take_along_axis(hit, order, axis=1) < enough) | (before < s.least))
                    bits = np.zeros((len(part), s.buckets), bool)
                    bits[rows, ids[order[rows, ranks]]] = True
                    bits = bits.reshape(len(part), CELLS, inner)
                    at, g = np.nonzero(bits.any(axis=2))
                    yield pd.DataFrame({"t": t, "g": g, "query_id": part["vec_id"].to_numpy()[at], "v": part["v"].to_numpy()[at], "bits": [y.tobytes() for y in np.packbits(bits[at, g], axis=1)]})

    return run


def _ranked(s: Settings):
    """cogroup: the nearest of a block's visited vectors for each of its queries."""
    inner = s.buckets // CELLS

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(rows) and len(queries):
            x, ids, bucket = np.stack(rows["v"]).astype(float), rows["vec_id"].to_numpy(), rows["bucket"].to_numpy() % inner
            for a in range(0, len(queries), 128):
                part = queries.iloc[a : a + 128]
                q = np.stack(part["v"]).astype(float)
                bits = np.unpackbits(np.frombuffer(b"".join(part["bits"]), np.uint8).reshape(len(part), -1), axis=1)[:, :inner].astype(bool)
                score = np.where(bits[:, bucket], q @ x.T, -np.inf)
                for i, own in enumerate(part["query_id"]):
                    line = np.where(ids == own, -np.inf, score[i])
                    if len(line) > s.nearest:
                        last = np.partition(line, len(line) - s.nearest)[len(line) - s.nearest]
                        near = np.flatnonzero(line >= last - 1e-9 * max(1.0, abs(last))) if np.isfinite(last) else np.flatnonzero(np.isfinite(line))
                    else:
                        near = np.flatnonzero(np.isfinite(line))
                    exact = (x[near] * q[i]).sum(axis=1)
                    best = near[np.lexsort((ids[near], -exact))[: s.nearest]]
                    out["query_id"].append(np.full(len(best), own))
                    out["vec_id"].append(ids[best])
                    out["score"].append((x[best] * q[i]).sum(axis=1))
        return pd.DataFrame({k: np.concatenate(v) if v else np.zeros(0, float if k == "score" else np.int64) for k, v in out.items()})

    return run


def search(vectors: DataFrame, queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each query row the vectors of largest inner product, but for those of its own vec_id.

    Both tables are ``(vec_id, embedding)``. Rows without vec_id, vectors that :func:`usable` rejects and those of another
    length than the table's longest take no part; equal scores go by vec_id; rows that repeat count once. The
    directory of a table has CELLS ** projections buckets at most, so it may be broadcast; a bucket of many
    vectors is dealt over blocks, each of which meets the queries by itself, so no vector is passed over.
    """
    s = settings
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    dim = good.agg(F.max(F.size("v")).alias("d")).first()["d"]
    good, asked = good.where(F.size("v") == (dim or 0)), asked.where(F.size("v") == (dim or 0))
    longest = float(np.sqrt(good.agg(F.max(norm).alias("m")).first()["m"] or 1.0))
    kind = good.schema["v"].dataType.simpleString()
    indexed = good.mapInPandas(_index(longest, s), f"t int, bucket long, vec_id long, v {kind}")
    found = indexed.groupBy("t", "bucket").count().toPandas()  # CELLS ** projections rows a table at most
    n = int(found.loc[found["t"] == 0, "count"].sum())
    directory = [(p["bucket"].to_numpy(), p["count"].to_numpy()) for t in range(s.tables) for p in [found[found["t"] == t].sort_values("bucket")]]
    first = found.assign(g=found["bucket"] // (s.buckets // CELLS)).groupby(["t", "g"])["count"].sum()
    blocks = {int(t) * CELLS + int(g): -(-int(c) // s.block) for (t, g), c in first.items()}
    many = F.array(*[F.lit(blocks.get(k, 1)) for k in range(s.tables * CELLS)])
    of = F.get(many, F.col("t") * CELLS + F.col("g"))
    rows = indexed.withColumn("g", F.floor(F.col("bucket") / F.lit(s.buckets // CELLS)).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), of).cast("int"))
    drawn = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(s.sample).toPandas()
    known = np.stack(drawn["v"]).astype(np.float32) if len(drawn) else np.zeros((0, dim or 0), np.float32)
    # What the sample has of that rank is no nearer, most likely, than what all have of the wanted one.
    rank = -(-s.nearest * len(drawn) // max(n, 1)) + 1
    visit = _visits(longest, s, directory, known, drawn["vec_id"].to_numpy(), rank)
    visits = asked.mapInPandas(visit, f"t int, g int, query_id long, v {kind}, bits binary")
    visits = visits.withColumn("block", F.explode(F.sequence(F.lit(0), of - 1)))
    key = ["t", "g", "block"]
    tasks = max(8, 4 * sum(blocks.values()) // 3)
    near = rows.repartition(tasks, *key).groupBy(*key).cogroup(visits.repartition(tasks, *key).groupBy(*key)).applyInPandas(_ranked(s), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = near.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.nearest)
    return best.select("query_id", "rank", "vec_id", "score")
