"""Quality classifier: random-indexing word vectors pooled per document, then a small calibrated network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roleflow.llm._common import CHUNK, LOWER, SPACE, U64, batches, few_partitions, mix64, pieces, prefix_hash, slot, substring_hash, tree_sum, utf8
from roleflow.session import cut


@dataclass(frozen=True)
class Settings:
    """``sample``: labelled documents that the network is fitted on, at most."""

    sample: int = 16384
    buckets: int = 1 << 13
    width: int = 64
    nonzero: int = 4
    hidden: int = 32
    steps: int = 600
    threshold: float = 0.3


def _kinds() -> np.ndarray:
    """Of each byte: 0 white space, 1 letters, digits and all beyond ASCII, 2 other marks."""
    kind = np.full(256, 2, np.uint8)
    kind[SPACE] = 0
    kind[48:58] = kind[65:91] = kind[97:123] = kind[128:] = 1
    return kind


def _tokens(data: np.ndarray, off: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each token: a run of word bytes or of other marks, upper case told from lower."""
    kind = _kinds()[data]
    new = np.empty(len(data), bool)
    new[:1] = True
    new[1:] = kind[1:] != kind[:-1]
    new[off[:-1][off[:-1] < len(data)]] = True
    at = np.flatnonzero(new)
    ends = np.r_[at[1:], len(data)]
    word = kind[at] > 0
    at, ends = at[word], ends[word]
    lower = LOWER[data]
    # Case counts once a token: whether its first and last bytes are capitals.
    caps = (lower[at] != data[at]).astype(U64) + U64(2) * (lower[ends - 1] != data[ends - 1]).astype(U64)
    h = substring_hash(prefix_hash(lower), at, ends) + caps * U64(0x9E3779B97F4A7C15)
    return (mix64(h) & U64(buckets - 1)).astype(np.int64), np.searchsorted(off, at, "right") - 1


def _index(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's sparse random vector."""
    code = mix64(np.arange(s.buckets * s.nonzero, dtype=U64) + U64(12345)).reshape(s.buckets, s.nonzero)
    return (code % U64(s.width)).astype(np.int64), 1.0 - 2.0 * ((code >> U64(40)) & U64(1)).astype(np.float64)


def word_vectors(docs: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """A vector for each bucket of words: the sum of the random vectors of the words next to it, over all ``docs``.

    Sums are damped and scaled to unit length; a bucket that no document holds stays zero.
    """
    block = 1024

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = _index(s)
        total = np.zeros(s.buckets * s.width)
        for batch in it:
            data, off = utf8(batch.column(0))
            for a, b in pieces(off, CHUNK // 2):
                token, row = _tokens(data[off[a] : off[b]], off[a : b + 1] - off[a], s.buckets)
                near = row[1:] == row[:-1]
                left, right = token[:-1][near], token[1:][near]
                for k in range(s.nonzero):
                    total += np.bincount(np.r_[left * s.width + place[right, k], right * s.width + place[left, k]], np.r_[sign[right, k], sign[left, k]], minlength=len(total))
        cells = total.astype(np.float32).reshape(-1, block * s.width)
        yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(cells)), pa.int32()), "slot": pa.array([slot()] * len(cells), pa.int64()), "v": pa.array([x.tobytes() for x in cells], pa.binary())})

    texts = few_partitions(docs.select("text"))
    sums = tree_sum(texts.mapInArrow(run, "block int, slot long, v binary"), "block", texts.rdd.getNumPartitions(), "float32")
    table = np.concatenate([sums[k] for k in sorted(sums)]).reshape(s.buckets, s.width).astype(float) if sums else np.zeros((s.buckets, s.width))
    table = np.sign(table) * np.log1p(np.abs(table))
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _pool(column: pa.Array, vectors: np.ndarray, s: Settings) -> np.ndarray:
    """Mean word vector of each whole text, with the log count of words; zero for an empty text."""
    data, off = utf8(column)
    out = np.zeros((len(off) - 1, s.width + 1), np.float32)
    for a, b in pieces(off, CHUNK // 4):
        token, row = _tokens(data[off[a] : off[b]], off[a : b + 1] - off[a], s.buckets)
        if len(token):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            n = np.diff(np.r_[first, len(row)])
            at = a + row[first]
            out[at, :-1] = np.add.reduceat(vectors[token], first, axis=0) / n[:, None]
            out[at, -1] = np.log1p(n) / 8
    return out


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float
    settings: Settings

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_logit(x, self.layers) / self.temperature, -700, 700)))


def _logit(x: np.ndarray, layers: tuple[np.ndarray, ...]) -> np.ndarray:
    mean, scale, w1, b1, w2, b2 = layers
    return np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2


def _train(x: np.ndarray, y: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """Two layers by Adam on full batches of the bounded sample; the classes weigh the same."""
    rng = np.random.default_rng(7)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - mean) / scale
    p = [rng.normal(0, 0.3 / np.sqrt(z.shape[1]), (z.shape[1], s.hidden)), np.zeros(s.hidden), rng.normal(0, 0.3, s.hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, s.steps + 1):
        h = np.tanh(z @ p[0] + p[1])
        d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y) / len(y)
        back = d[:, None] * p[2] * (1 - h * h)
        grads = [z.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True)]
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return (mean, scale, *p)


def fit(docs: DataFrame, labelled: DataFrame, s: Settings = Settings()) -> Model:
    """Word vectors from all of ``docs(text)``, the network from the bounded ``labelled(text, label)``.

    A fifth of the sample is kept from training and sets the temperature that makes the
    probabilities fit it. With no labels, or one label only, every score is the smoothed share.
    """
    vectors = word_vectors(docs, s)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = _pool(batch.column(0), vectors, s)
        yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])

    got = labelled.select("text", F.col("label").cast("int").alias("label")).mapInArrow(batches(run), "label int, x binary").toPandas()
    y = got["label"].to_numpy(float)
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(y), s.width + 1).astype(float)
    order = np.lexsort((*x.T[:3], y))  # the rows come in any order
    x, y = x[order], y[order]
    if len(set(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        w = s.width + 1
        return Model(vectors, (np.zeros(w), np.ones(w), np.zeros((w, s.hidden)), np.zeros(s.hidden), np.zeros(s.hidden), np.array([np.log(share / (1 - share))])), 1.0, s)
    held = np.arange(len(y)) % 5 == 2
    layers = _train(x[~held], y[~held], s)
    z = _logit(x[held], layers)
    options = np.geomspace(0.25, 4, 41)
    loss = [np.mean(np.logaddexp(0, -(2 * y[held] - 1) * z / t)) for t in options] if held.any() else [0.0]
    return Model(vectors, layers, float(options[int(np.argmin(loss))]) if held.any() else 1.0, s)


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``score`` (0 to 1, higher is better) and ``predicted``; one row in, one row out.

    The whole text counts; a null or empty text gets the score of the zero vector.
    """
    s = model.settings

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = model.probability(_pool(batch.column(batch.num_columns - 1), model.vectors, s))
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(out.astype(float)), pa.array((out >= s.threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    source = docs.select(*keep, F.col("text").alias("_text"))
    schema = "".join(f"`{n}` {t}, " for n, t in source.dtypes[:-1])
    return source.mapInArrow(batches(run), schema + "score double, predicted int")
