"""Toxicity: a linear classifier over character n-grams whose features carry naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roleflow.llm._common import batches
from roleflow.session import cut

ORDERS = (3, 4, 5, 6)
PAD = "\0" * (max(ORDERS) - 1)
#: Partitions of the bounded sample that the classifier is fitted on: each sends the driver an array for each pass.
PARTS = 4
#: Characters that a task looks at together; a longer text is one piece.
PIECE = 1 << 17


@dataclass(frozen=True)
class Settings:
    """``sample``: labelled documents that the classifier is fitted on, at most; it goes over them ``passes`` times at most,
    or until the gradient is ``close`` of what it was at first."""

    sample: int = 16384
    buckets: int = 1 << 18
    smoothing: float = 1.0
    penalty: float = 2e-5
    passes: int = 60
    close: float = 1e-3
    threshold: float = 0.7


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, code points of the lower-cased padded texts, and the row of each code point."""
    a = 0
    while a < len(texts):
        b, size, low = a, 0, []
        while b < len(texts) and (b == a or size < PIECE):
            low.append((texts[b] or "").lower() + PAD)
            size += len(low[-1])
            b += 1
        codes = np.frombuffer((PAD + "".join(low)).encode("utf-32-le", "surrogatepass"), np.uint32)
        rows = np.repeat(np.arange(b - a, dtype=np.int64), [len(t) for t in low])
        yield a, codes, np.r_[np.zeros(len(PAD), np.int64), rows]
        a = b


def _grams(codes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each order with the bucket of the n-gram that starts at each code point; a longer hash grows from the shorter."""
    shift = np.uint32(32 - buckets.bit_length() + 1)
    h = np.full(len(codes), 0x811C9DC5, np.uint32)
    for k in range(max(ORDERS)):
        h = h[: len(codes) - k]
        h ^= codes[k:]
        h *= np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(16)
        if k + 1 in ORDERS:
            yield k + 1, (h * np.uint32(0x85EBCA6B)) >> shift


def _present(texts: list[str | None], buckets: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """First row and number of rows of each piece, and its distinct (row, bucket) in order as row * buckets + bucket."""
    for first, codes, rows in _pieces(texts):
        n = int(rows[-1]) + 1
        kind = np.uint32 if n * buckets <= 1 << 32 else np.int64
        start = (rows * buckets).astype(kind)
        # An n-gram that begins in the padding belongs to the text that follows it.
        keys = np.concatenate([start[order - 1 :] + grams for order, grams in _grams(codes, buckets)], dtype=kind)
        keys.sort()
        yield first, n, keys[np.r_[True, keys[1:] != keys[:-1]]]


def _packed(keys: np.ndarray) -> bytes:
    """Ascending keys as the gaps between them, a byte each; a byte of 255 goes on to the next one."""
    gap = np.diff(keys.astype(np.int64), prepend=0)
    more = gap // 255
    out = np.full(len(gap) + int(more.sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = gap % 255
    return out.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    gap = np.frombuffer(data, np.uint8)
    return np.cumsum(gap, dtype=np.int64)[gap != 255]


def present_of(buckets: int):
    """mapInArrow: labels and packed buckets of the documents, a row a piece."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        label = np.asarray(batch.column("label").to_pylist(), np.uint8)
        for first, n, keys in _present(batch.column("text").to_pylist(), buckets):
            yield pa.RecordBatch.from_pydict({"label": pa.array([label[first : first + n].tobytes()], pa.binary()), "grams": pa.array([_packed(keys)], pa.binary())})

    return batches(run)


def _sums(packed: DataFrame, buckets: int, weights: np.ndarray | None = None, bias: float = 0.0) -> list[np.ndarray]:
    """Sums over all documents of what each adds to its buckets, the last cell being that of every document.

    Without ``weights`` they are the documents of each label; with them the gradient of the logistic loss, and in an
    array of one cell the loss itself. The driver gets an array of fixed size from each of the PARTS partitions that :func:`fit` makes.
    """
    low = None if weights is None else weights.astype(np.float32)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss = np.zeros((2 if low is None else 1, buckets + 1)), 0.0
        for batch in it:
            for label, data in zip(batch.column("label").to_pylist(), batch.column("grams").to_pylist(), strict=True):
                y, keys = np.frombuffer(label, np.uint8).astype(float), _unpacked(data)
                row, gram = keys // buckets, keys % buckets
                if low is None:
                    parts = (1 - y, y)
                else:
                    z = np.bincount(row, low[gram], minlength=len(y)) + bias
                    loss += float(np.sum(np.logaddexp(0, z) - y * z))
                    parts = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y,)
                for out, x in zip(total, parts, strict=True):
                    out[:-1] += np.bincount(gram, x[row], minlength=buckets)
                    out[-1] += x.sum()
        yield pa.RecordBatch.from_pydict({"v": pa.array([total.astype(np.float32).tobytes()], pa.binary()), "loss": [loss]})

    total, loss = np.zeros((2 if low is None else 1, buckets + 1)), 0.0
    for r in packed.mapInArrow(run, "v binary, loss double").collect():
        total += np.frombuffer(r["v"], np.float32).reshape(total.shape)
        loss += r["loss"]
    return [*total, np.array([loss])]


def _minimum(f, x: np.ndarray, passes: int, close: float) -> np.ndarray:
    """Where ``f``, which gives value and gradient, is least: limited-memory BFGS until the gradient's norm is ``close`` of the first."""
    value, g = f(x)
    first, moves, used = float(np.linalg.norm(g)), [], 1
    while used < passes and np.linalg.norm(g) > close * first:
        d, stack = g.copy(), []
        for s, y, rho in reversed(moves):
            stack.append(rho * (s @ d))
            d -= stack[-1] * y
        if moves:
            s, y, _ = moves[-1]
            d *= (s @ y) / (y @ y)
        else:
            d /= first
        for (s, y, rho), alpha in zip(moves, reversed(stack), strict=True):
            d += s * (alpha - rho * (y @ d))
        step, slope = 1.0, float(g @ d)
        while used < passes:
            new, grad = f(x - step * d)
            used += 1
            if new <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = -step * d, grad - g
        x, value, g = x + s, new, grad
        if s @ y > 1e-12:
            moves = [*moves[-7:], (s, y, 1 / float(s @ y))]
    return x


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    settings: Settings


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on ``labelled(text, label 0/1)``, which the caller bounds (see :func:`labelled_sample`).

    Every n-gram bucket that the rows hold has a weight. Each document's buckets are made once and stay in the
    checkpoint folder; counts and gradients over them are summed on the executors, and the driver gets arrays of fixed size only.
    With no rows, or rows of one label only, every score is that label's smoothed share.
    """
    s = settings
    rows = labelled.select("text", F.col("label").cast("int").alias("label")).coalesce(PARTS)
    packed = cut(rows.mapInArrow(present_of(s.buckets), "label binary, grams binary"))
    neg, pos, _ = _sums(packed, s.buckets)
    (neg, n0), (pos, n1) = (neg[:-1], float(neg[-1])), (pos[:-1], float(pos[-1]))
    if not n0 or not n1:
        share = (n1 + 1) / (n0 + n1 + 2)
        return Model(np.zeros(s.buckets), float(np.log(share / (1 - share))), settings)
    p = (pos + s.smoothing) / (n1 + 2 * s.smoothing)
    q = (neg + s.smoothing) / (n0 + 2 * s.smoothing)
    ratio = np.log(p / q)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        g, total = _sums(packed, s.buckets, w[:-1] * ratio, float(w[-1]))
        value = float(total[0]) / (n0 + n1) + s.penalty / 2 * float(w[:-1] @ w[:-1])
        return value, g / (n0 + n1) * np.r_[ratio, 1.0] + s.penalty * np.r_[w[:-1], 0.0]

    start = np.zeros(s.buckets + 1)
    start[-1] = np.log((n1 + 1e-3) / (n0 + 1e-3))
    w = _minimum(loss, start, s.passes, s.close)
    return Model(w[:-1] * ratio, float(w[-1]), settings)


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``score`` (0 to 1) and ``predicted``; one row in, one row out.

    Every code point of a text counts. A null text is an empty one and gets the score of a text without
    known n-grams. Columns of ``docs`` that are not named in ``keep`` are not read.
    """
    weights, bias, s = model.weights, model.bias, model.settings

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        z = np.full(len(texts), bias)
        for first, n, keys in _present(texts, s.buckets):
            z[first : first + n] += np.bincount(keys // s.buckets, weights[keys % s.buckets], minlength=n)
        out = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(out), pa.array((out >= s.threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    source = docs.select(*keep, F.col("text").alias("_text"))
    schema = "".join(f"`{n}` {t}, " for n, t in source.dtypes[:-1])
    return source.mapInArrow(batches(run), schema + "score double, predicted int")


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rule, bound: int) -> DataFrame:
    """At most ``bound`` labelled documents ``(text, label)`` in hash order of their id; ``rule`` is a condition on doc_id.

    Labels that are null or not 0 or 1 are left out; of several labels of a document the largest counts. The
    ids are bounded, so they are broadcast and no text is shuffled.
    """
    ids = (
        labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & rule)
        .groupBy("doc_id")
        .agg(F.max(column).alias("label"))
        .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id")
        .limit(bound)
    )
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "label")
