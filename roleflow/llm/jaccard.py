"""N-gram Jaccard join by PartEnum signatures, and the groups that its links form."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roleflow.llm._common import CHUNK, LOWER, U64, batches, mix64, pieces, prefix_hash, substring_hash, utf8, words
from roleflow.operators.graph import connected_components
from roleflow.session import Scratch, cut

#: Words of 64 bits in a sketch of a set.
SKETCH = 16
#: Texts whose signatures a task remembers not to give twice.
SEEN = 1 << 18
#: Names that are sent to all tasks at most.
FEW = 1 << 17
#: What a signature's last bits hold: its part, how many parts of its set have an empty signature, and which of two bands it is for.
#: The number is UNCOUNTED for a set of more parts than are told apart, and KEPT for one that keeps its empty signatures.
PARTS, EMPTY, UNCOUNTED, KEPT = 1 << 13, 255, 254, 255


@dataclass(frozen=True)
class Settings:
    """Two sets link if 100 * intersection >= ``percent`` * union; ``cells`` a part, of which one may differ.

    A signature that more than ``hot`` different sets share counts only for a set whose spare parts are fewer than its crowded and empty ones.
    """

    shingle: int = 3
    percent: int = 90
    cells: int = 3
    hot: int = 16


def shingles(data: np.ndarray, off: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes of each row that has words; A-Z lower-cased."""
    data = LOWER[data]
    start, end, row = words(data, off)
    if not len(start):
        return
    h = substring_hash(prefix_hash(data), start, end)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    last = np.r_[first[1:], len(row)]
    run = np.zeros(len(h), U64)
    for k in range(size):
        shifted = np.zeros(len(h), U64)
        shifted[: len(h) - k] = h[k:]
        run = mix64(run * U64(0x9E3779B97F4A7C15) + shifted + U64(k + 1))
    for a, b in zip(first, last, strict=True):
        if b - a >= size:
            yield int(row[a]), np.unique(run[a : b - size + 1])
        else:
            one = np.array([b - a], U64)
            for k in range(a, b):
                one = mix64(one * U64(0x9E3779B97F4A7C15) + h[k : k + 1])
            yield int(row[a]), one


def _names(found: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of a set of shingles."""
    with np.errstate(over="ignore"):
        return tuple(int(np.sum(mix64(found ^ U64(c)), dtype=U64).astype(np.int64)) for c in (0x243F6A8885A308D3, 0x13198A2E03707344))


def _sketch(found: np.ndarray) -> np.ndarray:
    """Parities of the set's elements in 64 * SKETCH cells: two sets differ in at least as many elements as sketches in bits."""
    cell = (mix64(found ^ U64(0xA4093822299F31D0)) & U64(SKETCH * 64 - 1)).astype(np.int64)
    bits = np.bincount(cell, minlength=SKETCH * 64).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64)


@lru_cache(8)
def _bands(percent: int) -> list[tuple[int, int]]:
    """Sizes in bands: whatever links with a set lies in its band or in one next to it."""
    out, low = [], 1
    while low < 1 << 40:
        out.append((low, 100 * low // percent))
        low = out[-1][1] + 1
    return out


@lru_cache(4096)
def _plan(band: int, percent: int, cells: int) -> tuple[int, int, int, int]:
    """Of a band with the next: parts, cells a part, cells a signature, spare parts; no parts if only equal sets link.

    The distance of two sets that link is k at most. With k // 2 + 1 + spare parts, more than ``spare`` of them differ
    in one element at most, and there all cells but one agree. For small k there is one part of k + 3 cells.
    """
    k = (100 - percent) * _bands(percent)[band][1] // percent
    if k == 0:
        return 0, 0, 0, 0
    if k <= 4:
        return 1, k + 3, 3, 0
    parts = k // 2 + 1
    spare = min(max(3, parts // 6), UNCOUNTED - 1)
    return parts + spare, cells, cells - 1, spare


def _signatures(found: np.ndarray, s: Settings) -> np.ndarray:
    """Signatures of a set for its band with the next and for the one before.

    The last bit tells the two apart; before it stands the number of parts with a signature without elements, which is no part of the
    name, and before that the part. Signatures without elements are left out while no more parts than the spare ones have such.
    """
    band = next(i for i, (_, high) in enumerate(_bands(s.percent)) if len(found) <= high)
    out = []
    for j in (band, band - 1):
        if j < 0:
            continue
        parts, cells, take, spare = _plan(j, s.percent, s.cells)
        if not parts:
            continue
        code = mix64(found + U64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        cell = ((code >> U64(8)) % U64(parts * cells)).astype(np.int64)
        sums = np.zeros(parts * cells, U64)
        np.add.at(sums, cell, code)
        sums, count = sums.reshape(parts, cells), np.bincount(cell, minlength=parts * cells).reshape(parts, cells)
        if take == cells - 1:  # all cells but one
            value, some = sums.sum(axis=1, keepdims=True, dtype=U64) - sums, count.sum(axis=1, keepdims=True) > count
        else:
            chosen = np.array(list(combinations(range(cells), take)))
            value, some = sums[:, chosen].sum(axis=2, dtype=U64), count[:, chosen].sum(axis=2) > 0
        part = np.arange(parts, dtype=U64)[:, None]
        salt = (part << U64(32)) + np.arange(value.shape[1], dtype=U64) + U64(j << 16)
        value = mix64(value + salt * U64(0x9E3779B97F4A7C15)) & ~U64((1 << 22) - 1) | (part % U64(PARTS)) << U64(9) | U64(j & 1)
        empty = int((~some.all(axis=1)).sum())
        told = KEPT
        if empty <= spare:
            value, told = value[some], empty
        out.append(value.ravel() | U64(told if parts <= PARTS else UNCOUNTED) << U64(1))
    return np.concatenate(out) if out else np.zeros(0, U64)


def _sets_of(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    data, off = utf8(batch.column("text"))
    for a, b in pieces(off, CHUNK // 2):
        for row, found in shingles(data[off[a] : off[b]], off[a : b + 1] - off[a], size):
            yield a + row, found


def _classes(s: Settings):
    """mapInArrow: of each document its text's mark, its set's size and name, and a sketch."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, f1, f2 = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
        sketch = np.zeros((batch.num_rows, SKETCH), np.int64)
        for row, found in _sets_of(batch, s.shingle):
            n[row] = len(found)
            f1[row], f2[row] = _names(found)
            sketch[row] = _sketch(found)
        cells = pa.ListArray.from_arrays(pa.array(np.arange(0, sketch.size + 1, SKETCH, dtype=np.int32)), pa.array(sketch.ravel()))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "mark": batch.column("mark"), "n": n, "f1": f1, "f2": f2, "sketch": cells})

    return batches(run)


def _signed(s: Settings):
    """mapInArrow: (sig, f1) rows, once for each different set of a task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[int, None] = OrderedDict()
        for batch in it:
            sigs, owner, held = [], [], 0
            for _, found in _sets_of(batch, s.shingle):
                name = _names(found)[0]
                if name in seen:
                    continue
                seen[name] = None
                if len(seen) > SEEN:
                    seen.popitem(last=False)
                sigs.append(_signatures(found, s).view(np.int64))
                owner.append(np.full(len(sigs[-1]), name, np.int64))
                held += len(sigs[-1])
                if held > 1 << 17:
                    yield pa.RecordBatch.from_pydict({"sig": np.concatenate(sigs), "f1": np.concatenate(owner)})
                    sigs, owner, held = [], [], 0
            if sigs:
                yield pa.RecordBatch.from_pydict({"sig": np.concatenate(sigs), "f1": np.concatenate(owner)})

    return run


def _spares(s: Settings) -> Column:
    """The spare parts of a set of ``n`` elements in its band (turn 0 or 1, as the band is even or odd) or in the one before."""
    highs = [high for _, high in _bands(s.percent)]
    spare = F.array(*[F.lit(_plan(j, s.percent, s.cells)[3]) for j in range(len(highs))])
    band = F.size(F.filter(F.array(*[F.lit(h) for h in highs]), lambda h: h < F.col("n")))
    return F.get(spare, band - F.pmod(band - F.col("turn"), F.lit(2)))


def _need(a: str, b: str) -> Column:
    """Signatures of one turn that two sets share if they link, of those that both keep.

    More parts than the spare ones agree. Of these, no more are lost than both sets have empty ones, if one leaves them out, and than both have
    crowded ones, if one passes over them; who passes over has enough spare parts for both, so one is left.
    """
    empty = F.expr(f"if(least({a}.empty, {b}.empty) >= {UNCOUNTED}, 0, least({a}.empty, {b}.empty))")
    crowded = F.expr(f"if({a}.passes or {b}.passes, least({a}.full, {b}.full), 0)")
    bound = F.greatest(F.col(f"{a}.spare") + 1 - empty - crowded, F.lit(1))
    return F.when(F.expr(f"{a}.empty = {UNCOUNTED} or {b}.empty = {UNCOUNTED}"), F.lit(1)).otherwise(bound)


def _set_rows(s: Settings):
    """mapInArrow: (f1, set) of the texts whose set has the name that is asked for."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        asked, names, out = batch.column("f1").to_pylist(), [], []
        for row, found in _sets_of(batch, s.shingle):
            if _names(found)[0] == asked[row]:
                names.append(asked[row])
                out.append(found.view(np.int64))
        yield pa.RecordBatch.from_pydict({"f1": pa.array(names, pa.int64()), "set": pa.array(out, pa.list_(pa.int64()))})

    return batches(run)


def _near(a: str, b: str, percent: int) -> Column:
    """What a link needs of the sizes and the sketches alone."""
    apart = " + ".join(f"bit_count({a}.sketch[{i}] ^ {b}.sketch[{i}])" for i in range(SKETCH))
    return F.expr(
        f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and ({apart}) * {100 + percent} <= {100 - percent} * ({a}.n + {b}.n)"
    )


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) of names whose sets link: by size and sketch first, then by the sets themselves."""
    near = pairs
    for side in "ab":
        near = near.join(classes.select(F.col("f1").alias(side), F.struct("n", "sketch").alias(f"_{side}")), side)
    near = cut(near.where(_near("_a", "_b", s.percent)).select("a", "b"))
    asked = near.select(F.explode(F.array("a", "b")).alias("f1")).distinct().join(classes.select("id", "f1"), "f1")
    asked = cut(asked.select(F.col("id").alias("doc_id"), "f1"))
    # A counted, small table of names goes to the texts; else both are shuffled.
    texts = docs.join(F.broadcast(asked) if asked.count() <= FEW else asked, "doc_id")
    # A doc_id may stand for several texts; only the one with the name is the class's.
    sets = cut(texts.mapInArrow(_set_rows(s), "f1 bigint, set array<bigint>").dropDuplicates(["f1"]))
    left, right = sets.select(F.col("f1").alias("a"), F.col("set").alias("x")), sets.select(F.col("f1").alias("b"), F.col("set").alias("y"))
    both = near.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.where(f"100 * common >= {s.percent} * (size(x) + size(y) - common)").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _members(docs: DataFrame, classes: DataFrame, s: Settings, tables: Scratch) -> DataFrame:
    """``sig, turn, f1, empty, full, passes, spare``: the signatures that several sets share, for the sets that need them."""
    signed = docs.where("text is not null and doc_id is not null").mapInArrow(_signed(s), "sig bigint, f1 bigint")
    told = F.shiftright("sig", 1).bitwiseAND(EMPTY).cast("short").alias("empty")
    signed = signed.select(F.col("sig").bitwiseAND(~(EMPTY << 1)).alias("sig"), told, "f1")
    over = W.partitionBy("sig")
    shared = signed.select("*", F.min("f1").over(over).alias("low"), F.max("f1").over(over).alias("high")).where("low < high")
    shared = shared.select("sig", "empty", "f1").distinct()
    shared = tables.put(shared.withColumn("size", F.count(F.lit(1)).over(over)))
    # A signature that too many share is needed only by a set whose spare parts do not make up for such parts.
    turn = F.col("sig").bitwiseAND(1).cast("int").alias("turn")
    part = F.when(F.col("size") > s.hot, F.shiftright("sig", 9).bitwiseAND(PARTS - 1))
    full = shared.groupBy("f1", turn).agg(F.count_distinct(part).cast("int").alias("full"), F.first("empty").alias("empty"))
    full = full.join(classes.select("f1", "n"), "f1").withColumn("spare", _spares(s))
    full = full.select("f1", "turn", "full", "spare", ((F.col("empty") < UNCOUNTED) & (F.col("full") <= F.col("spare") - F.col("empty"))).alias("passes"))
    joined = shared.withColumn("turn", turn).join(full, ["f1", "turn"]).where(f"size <= {s.hot} or not passes")
    return tables.put(joined.select("sig", "turn", "f1", "size", "empty", "full", "passes", "spare"))


def _links(docs: DataFrame, classes: DataFrame, s: Settings, tables: Scratch) -> DataFrame:
    """Links (src, dst) between names that join all that is linked; see :func:`groups`."""
    members = _members(docs, classes, s, tables)
    state = F.struct("f1", "empty", "full", "passes", "spare")
    weights = members.groupBy("f1").agg(F.sum("size").alias("weight"))
    heads = members.join(weights, "f1").groupBy("sig").agg(F.max(F.struct("weight", "f1", "empty", "full", "passes", "spare")).alias("h"))
    met = members.select("sig", "turn", state.alias("m")).join(heads, "sig").where("m.f1 <> h.f1")
    met = met.select(F.col("m.f1").alias("f1"), F.col("h.f1").alias("head"), "turn", _need("m", "h").alias("need"))
    tried = met.groupBy("f1", "head", "turn").agg(F.count(F.lit(1)).alias("shared"), F.first("need").alias("need")).where("shared >= need")
    links = cut(_verified(tried.select(F.least("f1", "head").alias("a"), F.greatest("f1", "head").alias("b")).distinct(), docs, classes, s))
    found = connected_components(links)

    # What is still apart inside a bucket, against the bucket's other components.
    placed = members.join(found.withColumnRenamed("node", "f1"), "f1", "left").withColumn("component", F.coalesce("component", "f1"))
    main = placed.join(heads.select("sig", F.col("h.f1").alias("head")), "sig").where("f1 = head").select("sig", F.col("component").alias("main"))
    mixed = placed.join(main, "sig").groupBy("sig", "main").agg(F.max(F.col("component") != F.col("main")).alias("apart")).where("apart")
    placed = placed.join(mixed.select("sig", "main"), "sig").join(classes.select("f1", "n", "sketch"), "f1")
    placed = tables.put(placed.select("sig", "turn", "f1", "n", "empty", "full", "passes", "spare", "component", "main", "sketch"))
    m, h = placed.where("component <> main").alias("m"), placed.alias("h")
    across = (
        (F.col("m.sig") == F.col("h.sig"))
        & (F.col("m.component") != F.col("h.component"))
        & ((F.col("h.component") == F.col("h.main")) | (F.col("m.f1") < F.col("h.f1")))
        & _near("m", "h", s.percent)
    )
    both = m.join(h, across).select(F.least("m.f1", "h.f1").alias("a"), F.greatest("m.f1", "h.f1").alias("b"), "m.turn", _need("m", "h").alias("need"))
    rest = both.groupBy("a", "b", "turn").agg(F.count(F.lit(1)).alias("shared"), F.first("need").alias("need")).where("shared >= need")
    return links.unionByName(_verified(cut(rest.select("a", "b").distinct()), docs, classes, s))


def _labelled(docs: DataFrame, s: Settings, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """Rows ``doc_id, mark, n, f1, f2`` of all documents, and ``n, f1, f2, id, component_id, component_f1`` of their classes.

    A component is named by its class of the smallest doc_id, and by that one's name. With ``by_id`` classes that hold rows of one
    doc_id are linked by it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    named = cut(docs.mapInArrow(_classes(s), f"doc_id {kind}, mark bigint, n bigint, f1 bigint, f2 bigint, sketch array<bigint>"))
    known = named.where("n > 0 and doc_id is not null")
    classes = cut(known.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("id"), F.first("sketch").alias("sketch")))
    with Scratch(docs.sparkSession) as tables:
        links = _links(docs, classes, s, tables)
        if by_id:
            same = known.groupBy("doc_id").agg(F.min("f1").alias("src"), F.max("f1").alias("last")).where("src < last")
            same = same.join(known.select("doc_id", F.col("f1").alias("dst")), "doc_id").where("src <> dst")
            links = links.unionByName(same.select("src", "dst"))
        found = connected_components(links)
    with_id = classes.select("f1", "id").join(found.withColumnRenamed("node", "f1"), "f1")
    first = with_id.groupBy("component").agg(F.min(F.struct("id", "f1")).alias("x")).select("component", F.col("x.id").alias("least_id"), F.col("x.f1").alias("least_f1"))
    labels = found.join(first, "component").select(F.col("node").alias("f1"), "least_id", "least_f1")
    joined = classes.join(labels, "f1", "left")
    return named.drop("sketch"), joined.select("n", "f1", "f2", "id", F.coalesce("least_id", "id").alias("component_id"), F.coalesce("least_f1", "f1").alias("component_f1"))


def groups(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``.

    Links are exact and none is lost. Equal sets are one class before anything is compared, so copies cost nothing.
    Classes that share a signature are candidates: first each with the one of its bucket that
    shares most signatures; what these links leave apart is then compared across the
    parts, never inside one. Candidates are compared on whole sets. A text without words, null included, has
    no shingle and links with nothing; a row without doc_id links with nothing and has no component; rows of one doc_id
    and different texts are one node, and each has the number of its own shingles.
    """
    named, classes = _labelled(docs, settings, by_id=True)
    joined = named.join(classes.select("n", "f1", "f2", "component_id"), ["n", "f1", "f2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def deduplicate(docs: DataFrame, settings: Settings = Settings(shingle=5, percent=80, cells=2)) -> DataFrame:
    """``docs`` with one document of each group, that of the smallest doc_id; its columns stay.

    Texts without words are in no group and stay, and so does a row without doc_id. A text is judged by itself: rows of one doc_id and
    different texts are different documents. Of rows that repeat, one stays.
    """
    named, classes = _labelled(docs, settings, by_id=False)
    rows = named.where("n > 0 and doc_id is not null").join(classes, ["n", "f1", "f2"])
    stays = (F.col("f1") == F.col("component_f1")) & (F.col("doc_id") == F.col("component_id"))
    rows = cut(rows.select("doc_id", "mark", stays.alias("stays")))
    again = rows.where("stays").groupBy("doc_id", "mark").count().where("count > 1").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    gone = rows.where("not stays").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    on = (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_mark"))
    kept = docs.join(gone, on, "left_anti")
    if again.isEmpty():
        return kept
    several = kept.join(again, on, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, on, "left_anti").unionByName(several)


#: The same links in SQL over a table ``documents``.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
  FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(c.m AS BIGINT) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = d.doc_id
"""
