"""Line deduplication: a sharded minimal perfect hash over repeated lines' hashes, which documents probe."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roleflow.llm._common import U64, mix64
from roleflow.session import Scratch, cut

BLANK = b" \t\n\x0b\x0c\r"
#: Stands for a null doc_id, which is one document, below all others.
NO_ID = -(1 << 63)
#: Bits a key has room for in a level of the hash.
ROOM = 1.6

KEYS = "hi long, lo long"
SHARD = "shard int, sizes array<int>, bits binary, prints binary, counts binary, last binary"


@dataclass(frozen=True)
class Settings:
    """``shard``: about how many keys one shard of the index has; ``resident``: keys that every task may hold (about 21 bytes each)."""

    min_chars: int = 20
    min_docs: int = 3
    shard: int = 1 << 16
    resident: int = 1 << 20


def long_lines(texts: list[bytes | None], least: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """The lines of each text and, of those whose key has ``least`` code points, text, line number and 128-bit hashes as (hi, lo)."""
    lines, rows, numbers, digests = [], [], [], []
    for row, text in enumerate(texts):
        own = (text or b"").split(b"\n")
        lines.append(own)
        for number, line in enumerate(own):
            if len(line) < least:
                continue
            key = line.strip(BLANK).lower()
            if len(key) >= least and (key.isascii() or len(key.decode()) >= least):
                rows.append(row)
                numbers.append(number)
                digests.append(xxhash.xxh3_128_digest(key))
    return lines, np.array(rows, np.int64), np.array(numbers, np.int64), np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def _place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    step = U64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return (mix64(hi.view(U64) ^ mix64(lo.view(U64) + step)) % U64(size)).astype(np.int64)


class PerfectHash:
    """Slots 0 to n - 1 for n different 128-bit keys; any other key has some slot or none.

    Keys that meet no other one in a level's bits stay there, the rest goes to the next level; a slot is the number of set bits before the key's own.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.before = np.r_[0, np.cumsum(np.bitwise_count(bits).astype(np.int64))]

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray) -> PerfectHash:
        levels, left = [], np.arange(len(hi))
        while len(left):
            size = -(-int(len(left) * ROOM) // 64 or 1) * 64
            at = _place(hi[left], lo[left], len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        bits = np.packbits(np.concatenate(levels), bitorder="little").view("<u8")
        return cls(np.array([len(x) for x in levels], np.int64), bits)

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        slots, left, base = np.full(len(hi), -1, np.int64), np.arange(len(hi)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = base + _place(hi[left], lo[left], level, size)
            word, bit = self.bits[at >> 6], (at & 63).astype(U64)
            here = (word >> bit) & U64(1) == 1
            ahead = np.bitwise_count(word[here] & ((U64(1) << bit[here]) - U64(1)))
            slots[left[here]] = self.before[at[here] >> 6] + ahead
            left, base = left[~here], base + size
        return slots


def _build(group: pa.Table) -> pa.Table:
    """One shard: a perfect hash over its keys, and by slot the fingerprint, the number of documents and the largest of them."""
    hi, lo, n, last = (group[c].to_numpy() for c in ("hi", "lo", "n", "last"))
    hashed = PerfectHash.build(hi, lo)
    order = np.argsort(hashed.slots(hi, lo))
    counts = np.minimum(n[order], 0xFFFFFFFF).astype(np.uint32)
    arrays = [hashed.bits, lo[order], counts, last[order]]
    return pa.table({"shard": group["shard"][:1].cast(pa.int32()), "sizes": pa.array([hashed.sizes.tolist()], pa.list_(pa.int32())), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("bits", "prints", "counts", "last"), arrays)}})


class Shard:
    """A built shard, ready for probes."""

    def __init__(self, row: dict):
        self.hashed = PerfectHash(np.array(row["sizes"], np.int64), np.frombuffer(row["bits"], "<u8"))
        self.prints, self.counts, self.last = (np.frombuffer(row[c], t) for c, t in (("prints", "<i8"), ("counts", "<u4"), ("last", "<i8")))

    def probe(self, hi: np.ndarray, lo: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are of this shard and in ``least`` documents, and the largest document of each such key."""
        slots = self.hashed.slots(hi, lo)
        known = slots >= 0
        known &= self.prints[slots] == lo
        known &= self.counts[slots] >= least
        return known, self.last[slots]


class Index:
    """Shards that a task holds at once."""

    def __init__(self, rows: list[dict], shards: int):
        self.shards, self.parts = shards, {r["shard"]: Shard(r) for r in rows}

    def probe(self, hi: np.ndarray, lo: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        known, last = np.zeros(len(hi), bool), np.zeros(len(hi), np.int64)
        of = hi % self.shards
        for shard, part in self.parts.items():
            here = np.flatnonzero(of == shard)
            if len(here):
                known[here], last[here] = part.probe(hi[here], lo[here], least)
        return known, last


def _id(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc")


def repeated(docs: DataFrame, settings: Settings) -> DataFrame:
    """``hi, lo, n, last``: each line key in at least ``min_docs`` documents, their number and the largest of them."""

    def lines(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            _, rows, _, keys = long_lines(batch.column("text").to_pylist(), settings.min_chars)
            whole = np.unique(np.column_stack([rows, keys]), axis=0) if len(rows) else np.zeros((0, 3), np.int64)
            doc = batch.column("doc").to_numpy()[whole[:, 0]]
            yield pa.RecordBatch.from_pydict({"hi": whole[:, 1].copy(), "lo": whole[:, 2].copy(), "doc": doc})

    found = docs.select(_id(docs), F.col("text").cast("binary").alias("text")).mapInArrow(lines, f"{KEYS}, doc long")
    # Rows of one doc_id are one document; where each has its own, rows need no second shuffle to be told apart.
    single = docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    held = F.count("*") if single else F.count_distinct("doc")
    return found.groupBy("hi", "lo").agg(held.alias("n"), F.max("doc").alias("last")).where(F.col("n") >= settings.min_docs)


def _shards(keys: DataFrame, count: int, settings: Settings) -> tuple[DataFrame, int]:
    shards = max(1, -(-count // settings.shard))
    return keys.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(_build, SHARD), shards


def _elsewhere(docs: DataFrame, keys: DataFrame, count: int, held: Callable[[], Index], settings: Settings) -> DataFrame:
    """``doc, lost``: the lines that documents lose by shards which no task holds beforehand.

    Probes go to their shard; a task reads a shard, then the probes of it one batch after the other. No key has more probes than
    one in ``resident`` of all, since those of more documents are resident.
    """
    least = settings.min_docs
    index, shards = _shards(keys, count, settings)

    def probes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident = held()
        for batch in it:
            _, rows, _, found = long_lines(batch.column("text").to_pylist(), settings.min_chars)
            hi, lo = found[:, 0].copy(), found[:, 1].copy()
            open_ = ~resident.probe(hi, lo, least)[0]
            hi, lo, doc = hi[open_], lo[open_], batch.column("doc").to_numpy()[rows[open_]]
            yield pa.RecordBatch.from_pydict({"shard": (hi % shards).astype(np.int32), "hi": hi, "lo": lo, "doc": doc})

    def answer(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = None, None
        for batch in it:
            of, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            hi, lo, doc = (batch.column(c).fill_null(0).to_numpy() for c in ("hi", "lo", "doc"))
            lost = np.zeros(len(of), bool)
            edges = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of)]
            for a, b in zip(edges[:-1], edges[1:]):
                if kind[a] == 0:
                    at, part = of[a], Shard(batch.slice(a, 1).to_pylist()[0])
                if at == of[a]:
                    known, last = part.probe(hi[a:b], lo[a:b], least)
                    lost[a:b] = known & (last != doc[a:b]) & (kind[a:b] == 1)
            yield pa.RecordBatch.from_pydict({"doc": doc[lost], "hi": hi[lost], "lo": lo[lost]})

    asked = docs.select(_id(docs), F.col("text").cast("binary").alias("text")).mapInArrow(probes, f"shard int, {KEYS}, doc long")
    both = index.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    lost = both.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(answer, f"doc long, {KEYS}")
    return lost.groupBy("doc").agg(F.collect_set(F.struct("hi", "lo")).alias("lost"))


def remove_lines(docs: DataFrame, settings: Settings = Settings(), digest: bool = False) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` for every row of ``docs(doc_id long, text)``; ``digest`` gives the SHA-256 of what is kept.

    Lines end at \\n. A line's key is the line without white space at its ends, A-Z lower-cased; keys of at least ``min_chars``
    code points in at least ``min_docs`` documents (different doc_id) lose all their lines but those of the largest doc_id. Null text is one
    empty line; null doc_id is one document, below all others; rows of one doc_id are one document and each keeps its row; other
    columns are left out; an empty table gives no rows. Lines are told apart by 128 bits of hash, of which 64 are kept as fingerprint.

    Keys below ``min_docs`` aren't indexed: the fingerprint tells them from those that are. Of the index, every task holds the keys of the most
    documents, ``resident`` at most; documents ask the shards of the rest where they are.
    """
    least = settings.min_docs
    with Scratch(docs.sparkSession) as scratch:
        keys = scratch.put(repeated(docs, settings))
        size = keys.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
        bar = 0 if size["n"] <= settings.resident else size["all"] // settings.resident + 1
        near = keys.where(F.col("n") >= bar)
        count = near.count() if bar else size["n"]
        index, shards = _shards(near, count, settings)
        resident = docs.sparkSession.sparkContext.broadcast(([r.asDict() for r in index.collect()], shards))
        held = lambda: Index(*resident.value)
        texts = docs.select("doc_id", _id(docs), F.col("text").cast("binary").alias("text"))
        if bar:
            lost = cut(_elsewhere(docs, keys.where(F.col("n") < bar), size["n"] - count, held, settings)).withColumnRenamed("doc", "_doc")
            texts = texts.join(lost, F.col("doc") == F.col("_doc"), "left").drop("_doc")
        else:
            texts = texts.withColumn("lost", F.lit(None).cast("array<struct<hi:bigint,lo:bigint>>"))

        def kept(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = held()
            for batch in it:
                lines, rows, numbers, found = long_lines(batch.column("text").to_pylist(), settings.min_chars)
                hi, lo = found[:, 0].copy(), found[:, 1].copy()
                known, last = index.probe(hi, lo, least)
                known &= last != batch.column("doc").to_numpy()[rows]
                gone = [set() for _ in lines]
                for row, number in zip(rows[known].tolist(), numbers[known].tolist()):
                    gone[row].add(number)
                more = batch.column("lost").to_pylist()
                if any(more):
                    more = [{(x["hi"], x["lo"]) for x in own or ()} for own in more]
                    for row, number, key in zip(rows.tolist(), numbers.tolist(), map(tuple, found.tolist())):
                        if key in more[row]:
                            gone[row].add(number)
                out = [b"\n".join(x for i, x in enumerate(own) if i not in drop) if drop else b"\n".join(own) for own, drop in zip(lines, gone)]
                out = [hashlib.sha256(x).hexdigest() if digest else x.decode() for x in out]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_lines": pa.array(map(len, lines), pa.int64()), "n_dropped": pa.array(map(len, gone), pa.int64()), "kept": pa.array(out, pa.string())})

        kind = docs.schema["doc_id"].dataType.simpleString()
        return texts.mapInArrow(kept, f"doc_id {kind}, n_lines long, n_dropped long, kept string")


#: The same in SQL over a table ``documents``.
SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT doc_id, i, line, c.k IS NOT NULL AND doc_id <> last AS gone FROM keyed LEFT JOIN common c USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
