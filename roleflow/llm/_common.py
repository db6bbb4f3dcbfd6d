"""What several of the operators share: Arrow text buffers, word hashes, and sums of partial arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a task looks at together; a longer text is one piece.
CHUNK = 1 << 20
#: Partial arrays that one task adds up.
FAN_IN = 32

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def split_of(doc_id: Column | str, folds: int) -> Column:
    """The fold of a row: crc32 of doc_id as text, modulo ``folds``; null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit("")).cast("string").cast("binary")) % folds


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(1)
def _byte_codes() -> np.ndarray:
    return mix64((np.arange(256, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15)) | U64(1)


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and their inverses, at least ``n`` of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        base = 0xD6E8FEB86659FD93
        size = max(n, CHUNK + 1)
        _POWERS[:] = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, U64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps))
    return _POWERS[0], _POWERS[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash of bytes; differences times an inverse power hash any substring."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_byte_codes()[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def substring_hash(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inverse = powers(len(running))[1]
    return mix64((running[end] - running[start]) * inverse[start] + (end - start).astype(U64) * U64(0x9E3779B97F4A7C15))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the row offsets into them; null is the empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n, at = len(column), column.offset
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[at : at + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data, off


def pieces(off: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, a single longer row alone."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = b


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs without white space; ``off`` are offsets into ``data``."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    edge = edge[:-1] if len(data) else edge[:0]
    before = np.r_[False, inside[:-1]] if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge))
    after = np.r_[~inside[1:] | edge[1:], True] if len(data) else inside
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def slot() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def few_partitions(df: DataFrame, together: int = 8) -> DataFrame:
    """``df`` with up to ``together`` input splits in a task, so that tasks which send an array of fixed size are fewer.

    A task's share of the input stays bounded: a lost one costs no more at any size of the cluster or the input.
    """
    splits = df.rdd.getNumPartitions()
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-splits // together)))


def tree_sum(parts: DataFrame, key: str, slots: int, dtype: str = "float64") -> dict:
    """Add up partial arrays ``(key, slot long, v binary)``: at most FAN_IN of them meet in a task, in as many levels as needed.

    The result, one array a key, goes to the driver; the caller bounds keys and widths.
    """
    kind = parts.schema[key].dataType.simpleString()

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(frame["v"].iloc[0], dtype).copy()
        for v in frame["v"].iloc[1:]:
            total += np.frombuffer(v, dtype)
        return pd.DataFrame({key: [frame[key].iloc[0]], "slot": [int(frame["slot"].iloc[0]) // FAN_IN], "v": [total.tobytes()]})

    while True:
        last = slots <= FAN_IN
        group = [F.col(key)] if last else [F.col(key), F.expr(f"slot div {FAN_IN}").alias("up")]
        parts = parts.groupBy(*group).applyInPandas(add, f"{key} {kind}, slot long, v binary")
        slots = -(-slots // FAN_IN)
        if last:
            break
    return {r[key]: np.frombuffer(r["v"], dtype) for r in parts.select(key, "v").toLocalIterator()}


def batches(transform: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of one batch as a function for mapInArrow."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                yield from transform(batch)

    return run
