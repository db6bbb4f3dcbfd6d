"""Removal of long repeated strings by interval expansion on Burrows-Wheeler transforms."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roleflow.llm._common import U64, batches, mix64, powers, prefix_hash, substring_hash, utf8
from roleflow.session import Scratch, cut

#: Bytes of the strings whose hashes pick the anchors.
GRAM = 24
#: Window starts that are looked at together in a long text.
STRETCH = 1 << 18
#: Low bits of a packed hash that hold its place.
PLACE = 20
SEEN = 1 << 18


@dataclass(frozen=True)
class Settings:
    """``least``: bytes of a string that is removed where it repeats. ``block``: bytes that one transform takes, about.

    ``crowd``: bytes of different surroundings of one anchor above which its windows are compared by hash.
    """

    least: int = 400
    block: int = 1 << 19
    crowd: int = 1 << 20


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by running minima of blocks from either side."""
    n = len(v)
    padded = np.full(-(-n // width) * width, np.iinfo(v.dtype).max, v.dtype)
    padded[:n] = v
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Key, first and last window start of each run of windows with one key, and whether their anchors differ.

    A window's anchor is its first string of the smallest hash, so equal windows have their anchors at the same place. Its key is
    the hash of the anchor with all that follows or precedes it for half a window, whichever the window is sure to hold.
    """
    width = least - GRAM + 1
    half = (width - 1) // 2
    for a in range(0, len(data) - least + 1, STRETCH):
        part = data[a : a + STRETCH + least - 1]
        running = prefix_hash(part)
        n = len(part) - GRAM + 1
        h = mix64((running[GRAM:] - running[:n]) * powers(n)[1][:n])
        packed = (h >> U64(PLACE)) << U64(PLACE) | np.arange(n, dtype=U64)
        at = (_sliding_min(packed, width) & U64((1 << PLACE) - 1)).astype(np.int64)
        right = at - np.arange(len(at)) <= half
        start = np.where(right, at, at - half)
        key = substring_hash(running, start, start + GRAM + half) ^ right.astype(U64)
        new = np.r_[True, key[1:] != key[:-1]]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(at)] - 1
        moved = np.r_[False, at[1:] != at[:-1]] & ~new
        yield key[first].view(np.int64), a + first, a + last, np.logical_or.reduceat(moved, first)


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols or more, by doubling; symbols are 0 to 256, 0 ends each text."""
    n = len(codes)
    wide = np.zeros(n + 7, np.int64)
    wide[:n] = codes
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = key * 512 + wide[k : n + k]
    h = 7
    while True:
        order = np.argsort(key, kind="stable")
        new = np.r_[0, np.cumsum(np.diff(key[order]) != 0)]
        if h >= depth or new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        after = np.zeros(n, np.int64)
        after[: max(n - h, 0)] = rank[h:] + 1
        key = rank * (n + 2) + after
        h *= 2


def long_prefixes(codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order, and for each row but the first whether it shares ``least`` symbols or more with the row before.

    Breadth-first backward extension: all intervals of strings of length l give, a symbol to the left, those of
    length l + 1; where such an interval ends, the common prefix with what follows is l if no shorter was found. It stops at ``least``.
    """
    n = len(codes)
    order = suffix_order(codes, least + 1)
    bwt = codes[order - 1].astype(np.uint16)
    by_symbol = np.argsort(bwt, kind="stable")
    back = np.empty(n, np.int64)
    back[by_symbol] = np.arange(n)
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    before, behind = np.full(n, -1), np.full(n, n)
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    behind[by_symbol[:-1][same]] = by_symbol[1:][same]
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    low, high = np.array([0]), np.array([n - 1])
    for _ in range(least):
        sizes = high - low + 1
        lows, highs = np.repeat(low, sizes), np.repeat(high, sizes)
        rows = np.arange(len(lows)) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
        # The first and last row of each symbol inside an interval bound the interval it extends to.
        low, high = np.sort(back[rows[before[rows] < lows]]), np.sort(back[rows[behind[rows] > highs]])
        new = ~known[high + 1]
        low, high = low[new], high[new]
        known[high + 1] = True
        if not len(low):
            break
    return order, ~known[1:n]


def repeated_starts(texts: list[bytes], least: int) -> list[np.ndarray]:
    """For each text whether the ``least`` bytes from each place on also start anywhere else."""
    lengths = np.array([len(t) for t in texts])
    codes = np.zeros(int(lengths.sum()) + len(texts), np.int32)
    start = np.cumsum(lengths + 1) - lengths - 1
    for s, t in zip(start, texts, strict=True):
        codes[s : s + len(t)] = np.frombuffer(t, np.uint8)
        codes[s : s + len(t)] += 1
    order, long = long_prefixes(codes, least)
    found = np.zeros(len(codes), bool)
    found[order[1:][long]] = found[order[:-1][long]] = True
    out = []
    for s, n in zip(start, lengths, strict=True):
        out.append(found[s : s + max(n - least + 1, 0)])
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of true flags."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _anchor_rows(s: Settings):
    """mapInArrow: (key, tid, first, last, moved) of each text that a task has not seen yet."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[int, None] = OrderedDict()
        for batch in it:
            data, off = utf8(batch.column("text"))
            out: list[tuple] = []
            for row, tid in enumerate(batch.column("tid").to_pylist()):
                if off[row + 1] - off[row] < s.least or tid in seen:
                    continue
                seen[tid] = None
                if len(seen) > SEEN:
                    seen.popitem(last=False)
                for key, first, last, moved in anchors(data[off[row] : off[row + 1]], s.least):
                    out.append((key, np.full(len(key), tid, np.int64), first, last, moved))
                if len(out) >= 2000:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        key, tid, first, last, moved = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_pydict({"key": key, "tid": tid, "first": first.astype(np.int32), "last": last.astype(np.int32), "moved": pa.array(moved)})

    return run


def _surroundings(s: Settings, content: bool):
    """mapInArrow over (tid, text, places): the bytes around each place, or two hashes of them."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, off = utf8(batch.column("text"))
        out = {k: [] for k in ("key", "tid", "first", "last", "h1", "h2", "around", "moved")}
        size = 0
        for row, (tid, places) in enumerate(zip(batch.column("tid").to_pylist(), batch.column("places").to_pylist(), strict=True)):
            text = data[off[row] : off[row + 1]]
            first, last = (np.array([p[k] for p in places], np.int64) for k in ("first", "last"))
            if not content:
                running = prefix_hash(text)
                n = last - first + s.least
                h = (running[last + s.least] - running[first]) * powers(len(running))[1][first]
                out["h1"].append(mix64(h + n.astype(U64)).view(np.int64))
                other = np.zeros(len(text) + 1, U64)
                np.cumsum(mix64(text.astype(U64) + U64(77)) * powers(len(text))[0][: len(text)], out=other[1:])
                out["h2"].append(mix64((other[last + s.least] - other[first]) * powers(len(running))[1][first]).view(np.int64))
                out["first"].append(first)
                out["last"].append(last)
                out["key"].append(np.array([p["key"] for p in places], np.int64))
                out["tid"].append(np.full(len(places), tid, np.int64))
                out["moved"].append(np.array([p["moved"] for p in places], bool))
                continue
            for p, a, b in zip(places, first, last, strict=True):
                out["key"].append(p["key"])
                out["h1"].append(p["h1"])
                out["h2"].append(p["h2"])
                out["around"].append(text[a : b + s.least].tobytes())
                size += len(out["around"][-1])
            if size > 8 << 20:
                yield pa.RecordBatch.from_pydict({k: pa.array(out[k], pa.binary() if k == "around" else pa.int64()) for k in ("key", "h1", "h2", "around")})
                out, size = {k: [] for k in out}, 0
        if content and out["key"]:
            yield pa.RecordBatch.from_pydict({k: pa.array(out[k], pa.binary() if k == "around" else pa.int64()) for k in ("key", "h1", "h2", "around")})
        if not content and out["key"]:
            yield pa.RecordBatch.from_pydict({k: np.concatenate(out[k]) for k in ("key", "tid", "first", "last", "h1", "h2", "moved")})

    return batches(run)


def _transform(s: Settings):
    """applyInPandas: the repeated window starts of a block, as runs of places in each surroundings."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        key, h1, h2, a, b = [], [], [], [], []
        for row, flags in enumerate(repeated_starts(frame["around"].tolist(), s.least)):
            first, last = _runs(flags)
            a.append(first)
            b.append(last)
            key.append(np.full(len(first), frame["key"].iloc[row]))
            h1.append(np.full(len(first), frame["h1"].iloc[row]))
            h2.append(np.full(len(first), frame["h2"].iloc[row]))
        return pd.DataFrame({k: np.concatenate(v).astype(np.int64) for k, v in (("key", key), ("h1", h1), ("h2", h2), ("a", a), ("b", b))})

    return run


def _windows(s: Settings):
    """mapInArrow: two hashes of each window of a crowded anchor's surroundings."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        columns = [batch.column(k).to_pylist() for k in ("key", "h1", "h2", "around")]
        for key, h1, h2, around in zip(*columns, strict=True):
            text = np.frombuffer(around, np.uint8)
            n = len(text) - s.least + 1
            inverse = powers(len(text) + 1)[1][:n]
            running = prefix_hash(text)
            other = np.zeros(len(text) + 1, U64)
            np.cumsum(mix64(text.astype(U64) + U64(77)) * powers(len(text))[0][: len(text)], out=other[1:])
            w1, w2 = (mix64((r[s.least :] - r[:n]) * inverse).view(np.int64) for r in (running, other))
            yield pa.RecordBatch.from_pydict({"key": np.full(n, key), "h1": np.full(n, h1), "h2": np.full(n, h2), "a": np.arange(n, dtype=np.int64), "w1": w1, "w2": w2})

    return batches(run)


def _kept(s: Settings):
    """mapInArrow over (tid, text, spans): what is left of a text, and how much went."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, off = utf8(batch.column("text"))
        removed, spans, kept = [], [], []
        for row, found in enumerate(batch.column("spans").to_pylist()):
            text = data[off[row] : off[row + 1]]
            edge = np.zeros(len(text) + 1, np.int32)
            np.add.at(edge, [x["a"] for x in found], 1)
            np.add.at(edge, [x["b"] + s.least for x in found], -1)
            gone = np.cumsum(edge[:-1]) > 0
            removed.append(int(gone.sum()))
            spans.append(len(_runs(gone)[0]))
            kept.append(text[~gone].tobytes())
        yield pa.RecordBatch.from_pydict({"tid": batch.column("tid"), "removed": removed, "spans": spans, "left": pa.array(kept, pa.binary())})

    return batches(run)


def _repeated(long_rows: DataFrame, s: Settings, tables: Scratch) -> tuple[DataFrame, DataFrame]:
    """Texts ``tid, text, places`` that may hold repeats, and ``tid, spans`` with the runs (a, b) of repeated window starts."""
    found = tables.put(long_rows.select("tid", "text").mapInArrow(_anchor_rows(s), "key long, tid long, first int, last int, moved boolean"))
    # A key of two places, or of one that moves. Sums by key are made in each task first, so a common key is no hot group.
    place = F.xxhash64("tid", "first")
    twice = found.groupBy("key").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.max("moved").alias("m")).where("x <> y or m")
    twice = cut(twice.select("key"))  # a table of its own, so that the join may split a common key
    by_text = found.join(twice, "key", "left_semi").distinct().groupBy("tid").agg(F.collect_list(F.struct("key", "first", "last", "moved")).alias("places"))
    texts = cut(long_rows.select("tid", "text").join(by_text, "tid").dropDuplicates(["tid"]))

    around = cut(texts.mapInArrow(_surroundings(s, content=False), "key long, tid long, first long, last long, h1 long, h2 long, moved boolean"))
    kinds = around.groupBy("key", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("tid", "first", "last")).alias("one"), F.max("moved").alias("moved"))
    different = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max("moved").alias("moves"), F.sum(F.expr(f"one.last - one.first + {s.least}")).alias("bytes"))
    different = different.where("kinds > 1 or moves")
    chosen = cut(kinds.join(different, "key").select("key", "h1", "h2", "one.*", "bytes"))
    asked = chosen.groupBy("tid").agg(F.collect_list(F.struct("key", "first", "last", "h1", "h2")).alias("places"))
    held = texts.select("tid", "text").join(asked.withColumnRenamed("tid", "id"), F.col("tid") == F.col("id")).select("tid", "text", "places")
    held = held.mapInArrow(_surroundings(s, content=True), "key long, h1 long, h2 long, around binary")
    total = chosen.agg(F.coalesce(F.sum(F.expr(f"last - first + {s.least}")), F.lit(0)).alias("n"), F.coalesce(F.max("bytes"), F.lit(0)).alias("most")).first()
    blocks = max(1, -(-total["n"] // s.block))
    crowded = chosen.where(F.col("bytes") > s.crowd).select("key").distinct() if total["most"] > s.crowd else None
    calm = held.join(crowded, "key", "left_anti") if crowded else held
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")
    runs = calm.groupBy(block).applyInPandas(_transform(s), "key long, h1 long, h2 long, a long, b long")
    if crowded:
        windows = held.join(crowded, "key", "left_semi").mapInArrow(_windows(s), "key long, h1 long, h2 long, a long, w1 long, w2 long")
        windows = tables.put(windows)
        # Every row is a place of its own.
        twice = cut(windows.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2"))
        windows = windows.join(twice, ["w1", "w2"], "left_semi")
        # Neighbouring windows are one run.
        inside = W.partitionBy("key", "h1", "h2").orderBy("a")
        windows = windows.withColumn("island", F.col("a") - F.row_number().over(inside))
        windows = windows.groupBy("key", "h1", "h2", "island").agg(F.min("a").alias("a"), F.max("a").alias("b")).drop("island")
        runs = runs.unionByName(windows)
    same = kinds.where("n > 1").select("key", "h1", "h2", F.lit(0).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"))
    runs = runs.unionByName(same)
    spans = around.join(runs, ["key", "h1", "h2"]).select("tid", (F.col("first") + F.col("a")).alias("a"), F.when(F.col("b") < 0, F.col("last")).otherwise(F.col("first") + F.col("b")).alias("b"))
    return texts, cut(spans.groupBy("tid").agg(F.collect_set(F.struct("a", "b")).alias("spans")))


def remove_repeats(docs: DataFrame, settings: Settings = Settings(), digest: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` for every row of ``docs(doc_id, text)``; ``kept`` is binary, or its SHA-256.

    Removed is each byte of a ``least``-byte string that also starts anywhere else, in the same text or another, judged
    on the input. Null text is empty; a text shorter than ``least`` stays; a row that repeats makes all of a long
    enough text repeat; matches do not cross texts.

    Equal texts are one. Equal windows have equal keys, so only windows whose key occurs twice are looked at
    again; equal surroundings of a key are one, and repeated as they stand. Different ones meet by
    key in blocks of bounded size, each with a transform of its own. A key with more surroundings than fit has its windows
    compared by two hashes, in a shuffle with no large groups. Texts are told apart by 64 bits of hash.
    """
    s = settings
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tid", F.xxhash64("text", F.octet_length("text")))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    long_rows = rows.where(f"n_bytes >= {s.least}")
    copies = cut(long_rows.groupBy("tid").count().where("count > 1").select("tid", F.lit(True).alias("copied")))

    with Scratch(docs.sparkSession) as tables:
        texts, spans = _repeated(long_rows, s, tables)
    changed = texts.join(spans.withColumnRenamed("tid", "id"), F.col("tid") == F.col("id")).select("tid", "text", "spans")
    changed = changed.mapInArrow(_kept(s), "tid long, removed long, spans long, left binary")
    final: Column = (lambda c: F.sha2(c, 256)) if digest else (lambda c: c)
    changed = changed.select("tid", "removed", "spans", final(F.col("left")).alias("left"))
    own = rows.select("doc_id", "tid", "n_bytes", final(F.col("text").cast("binary")).alias("whole"))
    joined = own.join(copies, "tid", "left").join(changed, "tid", "left")
    gone = F.coalesce(F.col("copied"), F.lit(False)) & (F.col("n_bytes") >= s.least)
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, final(F.lit("").cast("binary"))).otherwise(F.coalesce("left", "whole")).alias("kept"),
    )
