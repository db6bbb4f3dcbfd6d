"""Language model scores: a hashed maximum-entropy model with a class-factored softmax, beside a unigram base."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roleflow.llm._common import CHUNK, LOWER, U64, batches, few_partitions, mix64, pieces, prefix_hash, slot, substring_hash, tree_sum, utf8, words

#: Word endings are hashed to so many; a token's code ends in that of its ending.
ENDINGS = 1 << 12
#: Positions of a text that are looked at together.
STEP = 1 << 14
#: The code of the end of a text.
END = np.uint64(0x5851F42D4C957000)


@dataclass(frozen=True)
class Settings:
    """``common``: tokens counted in arrays, taken from ``sample`` documents; all others are counted by a shuffle.

    Which tokens are common changes no result, only the way to it. ``classes``: classes of tokens by their endings; ``cells``: parts
    of each class, by a token's hash. ``rounds``: parts of the training documents, after each of which the executors' updates are averaged.
    """

    common: int = 1 << 16
    sample: int = 2000
    classes: int = 16
    cells: int = 8
    buckets: int = 1 << 15
    rounds: int = 2
    rate: float = 0.4


def _tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the tokens of each row with its end, and their rows."""
    data = LOWER[data]
    start, end, row = words(data, off)
    running = prefix_hash(data)
    tail = substring_hash(running, np.maximum(start, end - 3), end) & U64(ENDINGS - 1)
    code = substring_hash(running, start, end) & ~U64(ENDINGS - 1) | tail
    n = len(off) - 1
    rows = np.r_[row, np.arange(n)]
    order = np.argsort(rows, kind="stable")
    return np.r_[code, np.full(n, END)][order], rows[order]


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, off = utf8(batch.column("text"))
    for a, b in pieces(off, CHUNK // 2):
        codes, rows = _tokens(data[off[a] : off[b]], off[a : b + 1] - off[a])
        yield a, b, codes, rows


class Common:
    """The common tokens: each has a place of its own in a table addressed by its hash."""

    def __init__(self, codes: np.ndarray, size: int):
        self.mask = U64(8 * size - 1)
        self.table = np.zeros(8 * size, U64)
        self.table[self._at(codes[::-1])] = codes[::-1]  # of two at one place the commoner stays

    def _at(self, codes: np.ndarray) -> np.ndarray:
        return ((codes >> U64(20)) & self.mask).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Places of the codes, or -1."""
        at = self._at(codes)
        return np.where(self.table[at] == codes, at, -1)


def _kind(codes: np.ndarray, s: Settings) -> np.ndarray:
    """A token's ending and cell as one number."""
    return ((codes & U64(ENDINGS - 1)) * U64(s.cells) + ((codes >> U64(40)) & U64(s.cells - 1))).astype(np.int64)


def _common(docs: DataFrame, s: Settings) -> Common:
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(s.sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codes, n = np.unique(np.concatenate([c for *_, c, _ in _chunks(batch)]), return_counts=True)
        yield pa.RecordBatch.from_pydict({"code": codes.view(np.int64), "n": n.astype(np.int64)})

    top = texts.mapInArrow(batches(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "code").limit(s.common)
    codes = top.toPandas()["code"].to_numpy(np.int64).view(U64)
    return Common(np.r_[END, codes[codes != END]], s.common)


def _counts(common: Common, s: Settings):
    """mapInArrow over training texts: counts of common tokens, of endings in each cell, and of endings with the ending before."""
    size = len(common.table)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, kinds_of, pairs = np.zeros(size), np.zeros(ENDINGS * s.cells), np.zeros(ENDINGS * 64)
        for batch in it:
            for *_, codes, rows in _chunks(batch):
                at = common.find(codes)
                seen += np.bincount(at[at >= 0], minlength=size)
                last = (codes & U64(ENDINGS - 1)).astype(np.int64)
                kinds_of += np.bincount(_kind(codes, s), minlength=len(kinds_of))
                near = rows[1:] == rows[:-1]
                pairs += np.bincount(np.r_[last[1:][near] * 64 + last[:-1][near] % 64, last[:-1][near] * 64 + last[1:][near] % 64], minlength=len(pairs))
        kinds = {"seen": seen, "kinds": kinds_of, "pairs": pairs}
        yield pa.RecordBatch.from_pydict({"kind": list(kinds), "slot": pa.array([slot()] * 3, pa.int64()), "v": pa.array([x.tobytes() for x in kinds.values()], pa.binary())})

    return run


def _classes(ending: np.ndarray, pairs: np.ndarray, k: int) -> np.ndarray:
    """A class for each ending by k-means over the endings around it; the table has a fixed size."""
    x = np.sqrt(pairs.reshape(ENDINGS, 64) / np.maximum(pairs.reshape(ENDINGS, 64).sum(axis=1, keepdims=True), 1))
    centres = [x[int(np.argmax(ending))]]
    for _ in range(k - 1):
        far = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0) * np.sqrt(ending)
        centres.append(x[int(np.argmax(far))])
    centres = np.array(centres)
    for _ in range(20):
        label = np.argmin((x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1), axis=1)
        for c in range(k):
            w = ending * (label == c)
            if w.sum():
                centres[c] = (x * w[:, None]).sum(axis=0) / w.sum()
    return label


def _features(codes: np.ndarray, rows: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of what stands before each token: nothing, one word, its ending, two words, and the second alone."""
    before = np.where(np.r_[False, rows[1:] == rows[:-1]], np.r_[END, codes[:-1]], END)
    two = np.where(np.r_[False, False, rows[2:] == rows[:-2]][: len(rows)], np.r_[END, END, codes[:-2]][: len(rows)], END)
    tail = before & U64(ENDINGS - 1)
    keys = (before, tail, before * U64(3) + two, two)
    hashed = [mix64(x * U64(0x9E3779B97F4A7C15) + U64(i + 1)) & U64(buckets - 2) for i, x in enumerate(keys)]
    return np.stack([np.full(len(codes), buckets - 1, U64), *hashed]).astype(np.int64)


def _scores(weights: np.ndarray, offsets: np.ndarray, features: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Scores of the classes and, beside them, of the cells of class ``y``, each less the largest of its part of the row.

    Every feature has weights for both; a class adds weights of its own to those of the cells.
    """
    k = len(offsets)
    z = weights.take(features[0], axis=0)
    for f in features[1:]:
        z += weights.take(f, axis=0)
    z[:, k:] += offsets.take(y, axis=0)
    for part in (z[:, :k], z[:, k:]):
        part -= part.max(axis=1, keepdims=True)
    return z


def _logs(weights: np.ndarray, offsets: np.ndarray, features: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of the classes, and of the cells of class ``y``."""
    z = _scores(weights, offsets, features, y)
    return tuple(p - np.log(np.exp(p).sum(axis=1, keepdims=True)) for p in (z[:, : len(offsets)], z[:, len(offsets) :]))


def _chances(weights: np.ndarray, offsets: np.ndarray, features: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Probabilities of the classes and, beside them, of the cells of class ``y``."""
    z = _scores(weights, offsets, features, y)
    np.exp(z, out=z)
    for part in (z[:, : len(offsets)], z[:, len(offsets) :]):
        part /= part.sum(axis=1, keepdims=True)
    return z


def _sums(f: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of ``f`` with the sums of their rows of ``x``, over the root of their number."""
    f = f.astype(np.uint16)
    order = np.argsort(f, kind="stable")
    f = f[order]
    first = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
    n = np.diff(np.r_[first, len(f)])[:, None].astype(np.float32)
    return f[first].astype(np.int64), np.add.reduceat(x.take(order, axis=0), first, axis=0) / np.sqrt(n)


def _updates(model: tuple[np.ndarray, ...], label: np.ndarray, s: Settings):
    """mapInArrow over training texts: gradient steps on all weights from those of ``model`` on, and what they changed."""

    def step(w: np.ndarray, q: np.ndarray, at: np.ndarray, g: np.ndarray) -> None:
        q[at] += g * g
        w[at] -= s.rate * g / np.sqrt(q[at] + 1e-6)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, q, offsets, squares = (x.copy() for x in model)
        touched, classes = np.zeros(s.buckets, np.float32), np.zeros(s.classes, np.float32)
        for batch in it:
            for *_, codes, rows in _chunks(batch):
                features, kind = _features(codes, rows, s.buckets), _kind(codes, s)
                y, cell = label[kind // s.cells], kind % s.cells
                for a in range(0, len(codes), STEP):
                    part, own, own_cell = features[:, a : a + STEP], y[a : a + STEP], cell[a : a + STEP]
                    miss = _chances(w, offsets, part, own)
                    line = np.arange(len(own))
                    miss[line, own] -= 1
                    miss[line, s.classes + own_cell] -= 1
                    for f in part:
                        at, g = _sums(f, miss)
                        step(w, q, at, g)
                        touched[at] = 1
                    at, g = _sums(own, miss[:, s.classes :])
                    step(offsets, squares, at, g)
                    classes[at] = 1
        moved = [((w - model[0]) * touched[:, None]), ((q - model[1]) * touched[:, None]), ((offsets - model[2]) * classes[:, None]), ((squares - model[3]) * classes[:, None]), touched, classes]
        v = np.concatenate([x.ravel() for x in moved]).astype(np.float32)
        yield pa.RecordBatch.from_pydict({"kind": ["w"], "slot": pa.array([slot()], pa.int64()), "v": pa.array([v.tobytes()], pa.binary())})

    return run


def _train(training: DataFrame, label: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Weights after each position of the training documents was used once; a row's change is the mean of the tasks that saw it."""
    shapes = [(s.buckets, s.classes + s.cells)] * 2 + [(s.classes, s.cells)] * 2
    model = tuple(np.zeros(x, np.float32) for x in shapes)
    ends = np.cumsum([a * b for a, b in shapes])
    for k in range(s.rounds):
        part = training.where(F.pmod(F.xxhash64("text"), F.lit(s.rounds)) == k).select("text")
        sums = tree_sum(part.mapInArrow(_updates(model, label, s), "kind string, slot long, v binary"), "kind", part.rdd.getNumPartitions(), "float32")
        if sums:
            *moved, seen = np.split(sums["w"], ends)
            by = np.maximum(seen[: s.buckets], 1)[:, None], np.maximum(seen[s.buckets :], 1)[:, None]
            model = tuple(x + m.reshape(x.shape) / by[i // 2] for i, (x, m) in enumerate(zip(model, moved, strict=True)))
    return model[0], model[2]


def _rare(common: Common):
    """mapInArrow: (code, doc, n, train) of the tokens that are not common, once for each text."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        mark = batch.column("mark").to_numpy()
        train = np.asarray(batch.column("train").to_pylist(), bool)
        for a, b, codes, rows in _chunks(batch):
            far = common.find(codes) < 0
            codes, rows = codes[far], rows[far]
            order = np.lexsort((codes, rows))
            codes, rows = codes[order], rows[order]
            first = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (rows[1:] != rows[:-1])]) if len(codes) else np.zeros(0, np.int64)
            n = np.diff(np.r_[first, len(codes)]).astype(np.int32)
            own = a + rows[first]
            # The sign tells whether the text is one to learn from.
            yield pa.RecordBatch.from_pydict({"code": codes[first].view(np.int64), "mark": mark[own], "n": np.where(train[own], n, -n).astype(np.int32)})

    return batches(run)


def _local(common: Common, seen: np.ndarray, weights: np.ndarray, offsets: np.ndarray, label: np.ndarray, shares: np.ndarray, s: Settings):
    """mapInArrow: of each text what needs no shuffle: its common tokens' logs, and those of its tokens' classes and cells."""
    logs, known = np.log10(seen + 0.5), seen > 0

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = batch.num_rows
        tokens, hits, base, context = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        for a, b, codes, rows in _chunks(batch):
            size = b - a
            at = common.find(codes)
            near = at >= 0
            tokens[a:b] = np.bincount(rows, minlength=size)
            base[a:b] = np.bincount(rows[near], logs[at[near]], minlength=size)
            hits[a:b] = np.bincount(rows[near], known[at[near]], minlength=size)
            kind = _kind(codes, s)
            y, cell = label[kind // s.cells], kind % s.cells
            features = _features(codes, rows, s.buckets)
            for i in range(0, len(codes), STEP):
                j = min(i + STEP, len(codes))
                own, own_cell, line = y[i:j], cell[i:j], np.arange(j - i)
                z = _scores(weights, offsets, features[:, i:j], own)
                log = z[line, own].astype(float) + z[line, s.classes + own_cell]
                np.exp(z, out=z)
                log -= np.log(z[:, : s.classes].sum(axis=1)) + np.log(z[:, s.classes :].sum(axis=1))
                log = log / np.log(10) - shares[own, own_cell]
                context[a:b] += np.bincount(rows[i:j], log, minlength=size)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "train": batch.column("train"), "mark": batch.column("mark"), "n_tokens": tokens, "hits": hits, "base": base, "context": context})

    return batches(run)


def score(docs: DataFrame, train: "F.Column", settings: Settings = Settings()) -> DataFrame:
    """``doc_id, train, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs(doc_id, text)``.

    ``train`` is a condition on doc_id: the rows to learn from. Tokens are words and one end a text, so a null or
    empty text is one end. The base is the smoothed unigram probability. The model gives a token its
    class by what stands before, from hashed n-gram and skip features, then its cell of that class from the same features, times its share
    of the cell: (c + 0.5) / (N + 0.5 (V + 1)) with N and V of that cell, all unseen words of a cell together being one more. Both
    softmaxes are trained by gradients. A token's class is that of its ending, its cell one of its hash's, so unseen words have both.
    Counts are those of all training rows; rows that repeat count and are scored each. Without training rows every probability of the base is 1.

    Tokens that a sample shows to be common are counted in arrays of fixed size. All others are counted by token, in
    the tasks first, and go back to their texts as sums. Texts are told apart by 64
    bits of a hash over doc_id and text.
    """
    s = settings
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("mark"), F.coalesce(train, F.lit(False)).alias("train"))
    training = few_partitions(rows.where("train").select("text"))
    common = _common(rows, s)
    sums = tree_sum(training.mapInArrow(_counts(common, s), "kind string, slot long, v binary"), "kind", training.rdd.getNumPartitions())
    seen = sums.get("seen", np.zeros(len(common.table)))
    tokens_of = sums.get("kinds", np.zeros(ENDINGS * s.cells))
    label = _classes(tokens_of.reshape(ENDINGS, s.cells).sum(axis=1), sums.get("pairs", np.zeros(ENDINGS * 64)), s.classes)
    weights, offsets = _train(training, label, s)

    # Rare tokens: one row a token and text. Of a text that repeats, each row has them, so its sums are divided by their number.
    rare = rows.select("text", "mark", "train").mapInArrow(_rare(common), "code long, mark long, n int")
    counts = rare.groupBy("code").agg(F.sum(F.greatest("n", F.lit(0))).alias("c"))
    joined = rare.join(counts, "code")
    n = F.abs("n")
    far = joined.groupBy("mark").agg(F.sum(n * F.log10(F.col("c") + 0.5)).alias("far_base"), F.sum(F.when(F.col("c") > 0, n).otherwise(0)).alias("far_hits"))
    again = rows.groupBy("mark").count().where("count > 1")
    far = far.join(again, "mark", "left").select(
        "mark", (F.col("far_base") / F.coalesce("count", F.lit(1))).alias("far_base"), F.expr("far_hits div coalesce(count, 1)").alias("far_hits")
    )

    distinct = np.zeros(ENDINGS * s.cells)
    place = F.col("code").bitwiseAND(ENDINGS - 1) * s.cells + F.shiftright("code", 40).bitwiseAND(s.cells - 1)
    for r in counts.where("c > 0").groupBy(place.alias("kind")).count().toLocalIterator():  # ENDINGS * cells rows at most
        distinct[r["kind"]] += r["count"]
    distinct += np.bincount(_kind(common.table[seen > 0], s), minlength=len(distinct))
    n_all, v_all = float(tokens_of.sum()), float(distinct.sum())
    cell = np.repeat(label, s.cells) * s.cells + np.tile(np.arange(s.cells), ENDINGS)
    n_cell, v_cell = (np.bincount(cell, x, minlength=s.classes * s.cells) for x in (tokens_of, distinct))
    shares = np.log10(n_cell + 0.5 * (v_cell + 1)).reshape(s.classes, s.cells)
    one = float(np.log10(n_all + 0.5 * (v_all + 1)))

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, train boolean, mark long, n_tokens long, hits long, base double, context double"
    local = rows.mapInArrow(_local(common, seen, weights, offsets, label, shares, s), schema)
    joined = local.join(far, "mark", "left")
    base = F.col("base") + F.coalesce("far_base", F.lit(0.0))
    return joined.select(
        "doc_id", "train", "n_tokens", (F.col("hits") + F.coalesce("far_hits", F.lit(0))).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (base - F.col("n_tokens") * F.lit(one)).alias("base_score"), (base + F.col("context")).alias("score"),
    )
