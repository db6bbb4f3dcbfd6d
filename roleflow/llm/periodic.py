"""Periodic runs of words, found in a grammar: Re-Pair, runs across each nonterminal's boundary, translation to all its places."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roleflow.llm._common import CHUNK, U64, mix64, pieces, powers, substring_hash

RUN = "struct<start:bigint,length:bigint,period:bigint>"
#: Candidates, pairs of a nonterminal and a period, looked at together.
TOGETHER = 1 << 20


@dataclass(frozen=True)
class Settings:
    """A run has at least ``words`` words and ``times`` periods, two or more."""

    words: int = 6
    times: int = 4


@dataclass
class Grammar:
    """Symbols of a straight-line grammar: terminals first, then nonterminals in the order they were made.

    ``left``, ``right`` (-1 for terminals) and ``length`` by symbol, ``first`` a place of its expansion; ``rounds`` the numbers of symbols before
    each round; ``roots`` and ``places`` what is left of the text.
    """

    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    first: np.ndarray
    rounds: list[int]
    roots: np.ndarray
    places: np.ndarray


def re_pair(words: np.ndarray, places: np.ndarray, glued: np.ndarray) -> Grammar:
    """Re-Pair in rounds: all pairs that are more frequent than those they overlap are replaced together, until none occurs twice.

    ``glued`` tells which words belong with the next one; what is left then is paired in the same way to one symbol a stretch.
    """
    base = int(words.max()) + 1
    left, right, length, first = [np.full(base, -1)], [np.full(base, -1)], [np.ones(base, np.int64)], [np.zeros(base, np.int64)]
    long, symbol, count, rounds = np.ones(base, np.int64), words, base, []
    known, names = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for least in (2, 1):
        while True:
            where = np.flatnonzero(glued[:-1])
            pairs, kind, times = np.unique(symbol[where] << 32 | symbol[where + 1], return_inverse=True, return_counts=True)
            rank = np.zeros(len(pairs), np.int64)
            rank[np.lexsort((mix64(pairs.view(U64)), times))] = np.arange(1, len(pairs) + 1)
            rank[times < least] = 0
            if not rank.any():
                break
            weight = np.zeros(len(symbol), np.int64)
            weight[where] = rank[kind]
            before, after = np.r_[0, weight[:-1]], np.r_[weight[1:], 0]
            # A pair that overlaps itself is taken at every other place.
            index = np.arange(len(symbol))
            since = index - np.maximum.accumulate(np.where(weight != before, index, 0))
            chosen = np.flatnonzero((weight > 0) & (weight >= before) & (weight >= after) & (since % 2 == 0))
            taken = symbol[chosen] << 32 | symbol[chosen + 1]
            kinds, at, which = np.unique(taken, return_index=True, return_inverse=True)
            spot = np.searchsorted(known, kinds)
            old = np.zeros(len(kinds), bool)
            old[spot < len(known)] = known[spot[spot < len(known)]] == kinds[spot < len(known)]
            name = np.empty(len(kinds), np.int64)
            name[old] = names[spot[old]]
            fresh = kinds[~old]
            name[~old] = count + np.arange(len(fresh))
            a, b = fresh >> 32, fresh & 0xFFFFFFFF
            left.append(a)
            right.append(b)
            length.append(long[a] + long[b])
            first.append(places[chosen[at[~old]]])
            long = np.r_[long, length[-1]]
            rounds.append(count)
            count += len(fresh)
            known, names = np.r_[known, fresh], np.r_[names, name[~old]]
            order = np.argsort(known)
            known, names = known[order], names[order]
            symbol = symbol.copy()
            symbol[chosen] = name[which]
            glued = glued.copy()
            glued[chosen] = glued[chosen + 1]
            stay = np.ones(len(symbol), bool)
            stay[chosen + 1] = False
            symbol, places, glued = symbol[stay], places[stay], glued[stay]
    return Grammar(*(np.concatenate(x).astype(np.int64) for x in (left, right, length, first)), [*rounds, count], symbol, places)


def _extend(running: np.ndarray, at: np.ndarray, other: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How far the words from ``at`` and from ``other`` agree, on from there or ``back`` before it; ``most`` at most."""
    low, high = np.zeros(len(at), np.int64), most.copy()
    while (open_ := low < high).any():
        mid = (low + high + 1) >> 1
        if back:
            same = substring_hash(running, at - mid, at) == substring_hash(running, other - mid, other)
        else:
            same = substring_hash(running, at, at + mid) == substring_hash(running, other, other + mid)
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
    return low


def crossing(words: np.ndarray, grammar: Grammar, settings: Settings) -> np.ndarray:
    """Columns symbol, start, end, period: the runs across the boundary of each nonterminal, as places within it.

    A run holds the word after the boundary and the one a period before it, or starts less than a period before it and then holds three
    periods behind it (one less than ``times``, where that is fewer): words that must agree then leave few periods, of which equal stretches
    to both sides decide. A run of three periods or more that holds the first two words also holds one a period further to either side.
    """
    running = np.zeros(len(words) + 1, U64)
    step = powers(max(len(words), 1))[0]
    np.cumsum((mix64(words.astype(U64) * U64(0x9E3779B97F4A7C15)) | U64(1)) * step[: len(words)], out=running[1:])
    symbols = np.flatnonzero((grammar.left >= 0) & (grammar.length >= settings.words))
    reach = grammar.length[symbols] // settings.times
    found = []
    edges = np.r_[0, np.cumsum(reach)]
    a = 0
    while a < len(symbols):
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + TOGETHER, "right")) - 1)
        own = np.repeat(np.arange(a, b), reach[a:b])
        q = np.arange(len(own)) - (edges[own] - edges[a]) + 1
        x = symbols[own]
        low = grammar.first[x]
        high, bound = low + grammar.length[x], low + grammar.length[grammar.left[x]]
        same = lambda i, j: words[np.clip(i, 0, len(words) - 1)] == words[np.clip(j, 0, len(words) - 1)]
        far = min(3, settings.times - 1)
        ahead = np.flatnonzero((bound + far * q < high) & same(bound, bound + q))
        for k in range(2, far + 1):
            ahead = ahead[same(bound[ahead], bound[ahead] + k * q[ahead])]
        behind = np.flatnonzero((bound - q >= low) & same(bound, bound - q))
        if settings.times > 2:
            more = (bound[behind] + q[behind] < high[behind]) & same(bound[behind], bound[behind] + q[behind])
            more |= (bound[behind] - 2 * q[behind] >= low[behind]) & same(bound[behind], bound[behind] - 2 * q[behind])
            behind = behind[more]
        pick = np.r_[ahead, behind]
        at = np.r_[bound[ahead], bound[behind] - q[behind]]
        q, low, high, x = q[pick], low[pick], high[pick], x[pick]
        start = at - _extend(running, at, at + q, at - low, True)
        end = at + q + _extend(running, at, at + q, high - at - q, False)
        good = end - start >= np.maximum(settings.words, settings.times * q)
        found.append(np.column_stack([x, start - low, end - low, q])[good])
        a = b
    return _shortest(np.concatenate(found)) if found else np.zeros((0, 4), np.int64)


def _shortest(runs: np.ndarray) -> np.ndarray:
    """Of rows that differ in their last column only, the one where it is smallest."""
    runs = np.unique(runs, axis=0)
    return runs[np.r_[True, (runs[1:, :-1] != runs[:-1, :-1]).any(axis=1)]] if len(runs) else runs


def everywhere(grammar: Grammar, runs: np.ndarray) -> np.ndarray:
    """Columns start, end, period: the runs at all places of their symbols in the derivation."""
    own = np.bincount(runs[:, 0], minlength=len(grammar.left))
    has = own > 0
    for a, b in zip(grammar.rounds[:-1], grammar.rounds[1:]):
        has[a:b] |= has[grammar.left[a:b]] | has[grammar.right[a:b]]
    before = np.r_[0, np.cumsum(own)]
    symbol, place, out = grammar.roots, grammar.places, []
    while True:
        here = has[symbol]
        symbol, place = symbol[here], place[here]
        if not len(symbol):
            break
        many = own[symbol]
        at = np.repeat(before[symbol] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        shift = np.repeat(place, many)
        out.append(np.column_stack([runs[at, 1] + shift, runs[at, 2] + shift, runs[at, 3]]))
        inner = grammar.left[symbol] >= 0
        symbol, place = symbol[inner], place[inner]
        second = place + grammar.length[grammar.left[symbol]]
        symbol, place = np.r_[grammar.left[symbol], grammar.right[symbol]], np.r_[place, second]
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def runs_of(words: np.ndarray, off: np.ndarray, settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """Runs of several documents: ``words`` as numbers, ``off`` where each begins; document and (start, end, period) in all words.

    A word that a document has less than ``times`` times is in no run, nor are stretches of others shorter than ``words``; they break the text.
    """
    none = np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    if not len(words):
        return none
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    _, kind, times = np.unique(doc * (int(words.max()) + 1) + words, return_inverse=True, return_counts=True)
    alive = times[kind] >= settings.times
    edge = np.r_[True, (alive[1:] != alive[:-1]) | (doc[1:] != doc[:-1]), True]
    starts = np.flatnonzero(edge)
    alive &= np.repeat(np.diff(starts) >= settings.words, np.diff(starts))
    places = np.flatnonzero(alive)
    if not len(places):
        return none
    glued = np.r_[(np.diff(places) == 1) & (doc[places[1:]] == doc[places[:-1]]), False]
    grammar = re_pair(words[places], places, glued)
    found = everywhere(grammar, crossing(words, grammar, settings))
    # What a neighbour extends is a part of a run that another symbol has whole.
    low, high = off[doc[found[:, 0]]], off[doc[found[:, 0]] + 1]
    start, end, q = found.T
    grows = (start > low) & (words[start - 1] == words[np.minimum(start - 1 + q, len(words) - 1)])
    grows |= (end < high) & (words[np.minimum(end, len(words) - 1)] == words[end - q])
    found = _shortest(found[~grows])
    return doc[found[:, 0]], found


def _texts(column: list[bytes | None], settings: Settings) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """For each text its runs as (start, length, period), and the words that are kept."""
    split = [(text or b"").split() for text in column]
    number: dict[bytes, int] = {}
    words = np.array([number.setdefault(w, len(number)) for own in split for w in own], np.int64)
    off = np.r_[0, np.cumsum([len(own) for own in split])]
    doc, runs = runs_of(words, off, settings)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    dropped = np.cumsum(change)[:-1] > 0
    edges = np.searchsorted(doc, np.arange(len(split) + 1))
    for i, own in enumerate(split):
        mine = runs[edges[i] : edges[i + 1]]
        kept = own if not len(mine) else [own[j] for j in np.flatnonzero(~dropped[off[i] : off[i + 1]]).tolist()]
        yield [(int(s - off[i]), int(e - s), int(q)) for s, e, q in mine], b" ".join(kept)


def collapse(docs: DataFrame, settings: Settings = Settings(), digest: bool = False) -> DataFrame:
    """``doc_id, runs, collapsed`` for every row of ``docs(doc_id, text)``.

    A run is a stretch of words with smallest period q, at least ``words`` words and ``times`` periods long, that no neighbouring word extends;
    ``runs`` has them as (start, length, period) in this order. ``collapsed`` is the text, words joined by one space, without the words that
    a run holds after its first period, or with ``digest`` its SHA-256. Words are runs without white space, told apart exactly, stretches by 64 bits
    of hash. Null and empty texts have no words and no runs, and collapse to the empty text; repeated rows are so many rows; an empty table gives none; other
    columns are left out. Texts share a grammar in pieces of about 1 MB, a longer text alone; memory grows with the longest text.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column("text").to_pylist()
            runs, kept = [], []
            for a, b in pieces(np.r_[0, np.cumsum([len(t or b"") for t in texts])], CHUNK):
                for own, text in _texts(texts[a:b], settings):
                    runs.append([dict(zip(("start", "length", "period"), r)) for r in own])
                    kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(runs, kind), pa.array(kept, pa.string())], names=["doc_id", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, runs array<{RUN}>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where a tenth of the documents is made periodic from some word on, by a rule over crc32(doc_id); null doc_id isn't."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    cut = docs.select("doc_id", "text", words.alias("words"), F.expr("crc32(cast(cast(doc_id as string) as binary)) div 10").alias("g"))
    cut = cut.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    cut = cut.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.expr("cast(3 + g % 8 as int)") + 1)), F.lit(1), F.col("n") - F.col("a"))
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return cut.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


#: The same in SQL over a table ``documents``, for the query: every pair of equal words is a candidate.
SQL = r"""
WITH texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
             lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h
  FROM documents),
sized AS (SELECT doc_id, ws, h, h // 10 AS g, len(ws) AS n FROM texts),
cut AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM sized),
made AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) END AS ws
  FROM cut),
word AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(ws) AS w FROM made),
equal AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island
  FROM word x JOIN word y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretch AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM equal GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT doc_id, start, length, min(q) AS period FROM stretch GROUP BY doc_id, start, length),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs,
         first({'start': start, 'length': length, 'period': period} ORDER BY length DESC, start, period) AS best
  FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (
  SELECT word.doc_id, string_agg(w, ' ' ORDER BY word.i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY word.doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, CAST(best.period AS BIGINT) AS period,
       CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
