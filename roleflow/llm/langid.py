"""Language ID with hyperdimensional profiles: bound letter vectors, bundled n-grams, cosine with prototypes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roleflow.llm._common import U64, batches, mix64, slot, tree_sum

#: Characters that a task looks at together; a longer text is one piece.
PIECE = 1 << 18
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    width: int = 1024
    order: int = 3
    #: n-gram vectors made at a time while documents are bundled.
    block: int = 8192


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _vectors(grams: np.ndarray, order: int, width: int) -> np.ndarray:
    """The n-gram vectors: the product of the letters' random signs, the k-th letter's rotated by k places.

    ``grams`` is (n, order) code points. A letter's signs are the bits of a hash of its code
    point and place, so no table of letters has to be kept or shared.
    """
    used, at = np.unique(grams, return_inverse=True)
    at = at.reshape(grams.shape)
    seeds = (used[:, None].astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15) + np.arange(width // 64, dtype=U64) * U64(0xC2B2AE3D27D4EB4F)
    bits = np.unpackbits(mix64(seeds).view(np.uint8), axis=1)
    code = np.zeros((len(grams), width), np.uint8)
    for k in range(order):
        code ^= np.roll(bits, k, axis=1)[at[:, k]]
    return 1.0 - 2.0 * code.astype(np.float32)


def _profiles(texts: list[str | None], s: Settings) -> Iterator[tuple[int, np.ndarray]]:
    """First row of a piece and its rows' bundled n-gram vectors; all zero where a text has no letter.

    Letters are lower-cased; a run of other characters counts as one space, also at both ends.
    """
    a = 0
    while a < len(texts):
        b, size, low = a, 0, []
        while b < len(texts) and b - a < 256 and (b == a or size < PIECE):
            low.append((texts[b] or "").lower())
            size += len(low[-1])
            b += 1
        codes = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        rows = np.repeat(np.arange(b - a), np.array([len(t) + 1 for t in low]))
        rows = np.r_[0, rows].astype(np.int64)
        letter = _letters()[np.minimum(codes, 0x10FFFF)]
        keep = letter | np.r_[True, letter[:-1]]
        codes = np.where(letter, codes, 32)[keep]
        rows, letter = rows[keep], letter[keep]
        n = len(codes) - s.order + 1
        out = np.zeros((b - a, s.width), np.float32)
        if n > 0:
            # The middle letter decides the row: the space between two texts belongs to both.
            grams = np.stack([codes[k : k + n] for k in range(s.order)], axis=1)
            middle = s.order // 2
            valid = letter[middle : middle + n]
            grams, row = grams[valid], rows[middle : middle + n][valid]
            packed = np.zeros(len(grams), U64)
            for k in range(s.order):
                packed = packed * U64(0x110000) + grams[:, k].astype(U64)
            kinds, at, which = np.unique(packed, return_index=True, return_inverse=True)
            for lo in range(0, len(kinds), s.block):
                hi = min(lo + s.block, len(kinds))
                mine = (which >= lo) & (which < hi)
                counts = np.bincount(row[mine] * (hi - lo) + which[mine] - lo, minlength=(b - a) * (hi - lo)).reshape(b - a, hi - lo)
                out += counts.astype(np.float32) @ _vectors(grams[at[lo:hi]], s.order, s.width)
        yield a, out
        a = b


def fit(docs: DataFrame, settings: Settings = Settings()) -> dict[str, np.ndarray]:
    """Prototype of each language: the bundle of the unit profiles of all documents ``(text, lang)`` that have a letter.

    Documents without a language are left out. The executors add the bundles up; the driver gets
    one vector a language. The mean of the prototypes is taken off each, since what the
    languages share tells none of them apart.
    """
    width = settings.width

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in it:
            langs = np.asarray(batch.column("lang").to_pylist(), object)
            for first, found in _profiles(batch.column("text").to_pylist(), settings):
                norm = np.linalg.norm(found, axis=1, keepdims=True)
                unit = found / np.where(norm > 0, norm, 1)
                own = langs[first : first + len(found)]
                for lang in set(own):
                    sums.setdefault(lang, np.zeros(width + 1))
                    sums[lang][:-1] += unit[own == lang].sum(axis=0, dtype=float)
                    sums[lang][-1] += (norm[own == lang] > 0).sum()
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "slot": pa.array([slot()] * len(sums), pa.int64()), "v": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    rows = docs.select("text", "lang").where("lang is not null")
    sums = tree_sum(rows.mapInArrow(run, "lang string, slot long, v binary"), "lang", rows.rdd.getNumPartitions())
    return {k: v[:-1] / v[-1] for k, v in sorted(sums.items()) if v[-1]}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], *keep: str, settings: Settings = Settings()) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``lang_pred`` and ``score``, the cosine with that prototype cut to 0 to 1.

    The whole text counts. A text that is null, empty or without a letter gets ``und`` and 0, and so does every
    text when no prototype was learned; equal cosines go to the language first in order.
    """
    names = list(prototypes)
    table = np.array([prototypes[k] for k in names]).reshape(len(names), settings.width)
    centre = table.mean(axis=0) if len(names) > 1 else np.zeros(settings.width)
    table = table - centre
    table = (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        for first, found in _profiles(texts, settings):
            norm = np.linalg.norm(found, axis=1)
            has = norm > 0
            if not names or not has.any():
                continue
            unit = found[has] / norm[has, None] - centre.astype(np.float32)
            near = (unit @ table.T) / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
            at = first + np.flatnonzero(has)
            lang[at] = np.asarray(names, object)[near.argmax(axis=1)]
            score[at] = np.clip(near.max(axis=1), 0, 1)
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(lang.tolist(), pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    source = docs.select(*keep, F.col("text").alias("_text"))
    schema = "".join(f"`{n}` {t}, " for n, t in source.dtypes[:-1])
    return source.mapInArrow(batches(run), schema + "lang_pred string, score double")
