"""The registered queries on the given small tables: held-out accuracy, recall and brute force."""

import hashlib
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from roleflow.llm import queries

SF = "/root/testdata/sf0.001"
MORE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


def test_quality_and_toxicity_hold_out(spark):
    labels = spark.read.parquet(f"{MORE}/labels.parquet")
    good = queries.op1_quality(spark, MORE).where("held_out").join(labels, "doc_id")
    assert good.where("predicted = quality").count() >= 0.9 * good.count()
    toxic = queries.op9_toxicity(spark, MORE).where("held_out").join(labels, "doc_id")
    assert toxic.where("predicted = toxic").count() >= 0.9 * toxic.count()
    assert toxic.where("predicted = 1 and toxic = 0").isEmpty()


def test_language_holds_out(spark):
    langs = spark.read.parquet(f"{MORE}/documents.parquet").select("doc_id", "lang")
    found = queries.op3_language(spark, MORE).where("held_out").join(langs, "doc_id")
    assert found.where("lang_pred = lang").count() >= 0.97 * found.count()


def test_language_model_beats_the_base(spark):
    held = queries.op8_lm(spark, MORE).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held["s"] > held["b"]


def test_neighbours_recall(spark):
    t = pq.read_table(f"{MORE}/embeddings.parquet")
    x, ids = np.array(t["embedding"].to_pylist(), float), np.array(t["vec_id"])
    got = {}
    for r in queries.op6_nearest(spark, MORE).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -9
        best = set(ids[np.argsort(-score)[:20]].tolist())
        hits, total = hits + len(best & got[int(ids[i])]), total + 20
    assert hits >= 0.9 * total


def test_secret_columns(spark, texts):
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in queries.op10_secrets(spark, SF).collect():
        t = texts[r["doc_id"]] or ""
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in found) for i in range(3)]


def test_repeats_match_brute_force(spark, texts):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    seen: dict[int, int] = {}
    for t in raw.values():
        for i in range(len(t) - 399):
            h = hash(t[i : i + 400])
            seen[h] = seen.get(h, 0) + 1
    for r in queries.op5_suffixes(spark, SF).collect():
        t = raw[r["doc_id"]]
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if seen[hash(t[i : i + 400])] > 1:
                gone[i : i + 400] = True
        left = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(t), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())


def test_neighbours_in_clusters_take_few_candidates(spark):
    """Where vectors lie in clusters, a query finds its own without visiting most of the others; components keep their type."""
    from roleflow.llm import neighbours

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(200, 24))
    x = np.repeat(centres / np.linalg.norm(centres, axis=1, keepdims=True), 40, axis=0)
    x = x + 0.02 * rng.normal(size=x.shape)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4).cache()
    got = neighbours.search(frame, frame.where("vec_id % 400 = 0")).toPandas()
    hits = 0
    for i, part in got.groupby("query_id"):
        score = x @ x[i]
        score[i] = -9
        order = np.argsort(-score)[:20]
        hits += len(set(order.tolist()) & set(part["vec_id"]))
        best = part.sort_values("rank").iloc[0]
        assert abs(best["score"] - float(np.dot(x[i], x[int(best["vec_id"])]))) < 1e-12
    assert hits >= 0.9 * len(got)
    s, longest = neighbours.Settings(least=0), float(np.linalg.norm(x, axis=1).max())
    bucket = neighbours._buckets(neighbours._projected(x, longest, s, query=False), s)
    tables = [np.unique(bucket[:, t], return_counts=True) for t in range(s.tables)]
    visit = neighbours._visits(longest, s, tables, x[::2].astype(np.float32), np.arange(len(x))[::2], 11)
    import pandas as pd

    inner, seen = s.buckets // neighbours.CELLS, 0
    for f in visit(iter([pd.DataFrame({"vec_id": np.arange(0, len(x), 400), "v": list(x[::400])})])):
        for r in f.itertuples():
            bits = np.unpackbits(np.frombuffer(r.bits, np.uint8))[:inner].astype(bool)
            seen += int(((bucket[:, r.t] // inner == r.g) & bits[bucket[:, r.t] % inner]).sum())
    assert seen / s.tables < 0.1 * len(x) * (len(x) // 400)
