"""Lexical search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np

from roleflow.llm import lexical

DOCS = "doc_id long, text string, score long, rank string, n string, terms string, item string"
ITEMS = "item_id string, text string, doc_id string, score string, term string"


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=10):
    split = [(d, Counter(t), len(t)) for d, text, *_ in docs if (t := terms(text))]
    n, total = len(split), sum(s for *_, s in split)
    df = Counter(t for _, c, _ in split for t in c)
    asked = {}
    for item, text, *_ in items:
        asked.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, query in asked.items():
        scored = []
        for doc, count, size in split:
            m = 25 + 75 * size * n // total
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * count[t] // (1000 * count[t] + 8 * m)) for t, r in query.items() if count[t])
            if s > 0:
                scored.append((-s, math.inf if doc is None else doc, doc))
        out += [(item, i + 1, doc, -s) for i, (s, _, doc) in enumerate(sorted(scored, key=lambda x: x[:2])[:k])]
    return sorted(out, key=str)


def given(seed=4, n=700):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Über", "x2", "Ça", "日本"]
    text = lambda most: " ".join(rng.choice(vocabulary[: rng.choice([20, 100, 304])]) + rng.choice(["", ",", "."]) for _ in range(rng.randint(1, most)))
    docs = [(i, text(60)) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "!!! ..."), (None, docs[5][1]), (n + 3, "w1 " * 50_000), (n + 4, docs[7][1]), (n + 5, docs[7][1]), docs[9], docs[9]]
    items = [(f"i{j}", text(12)) for j in range(25)] + [("copy", docs[7][1]), ("none", "zzz qqq"), ("empty", ""), ("null", None), (None, "w1 w2"), ("i3", "w250 w251"), ("common", "w1 W1 w1")]
    return [(a, b, 1, "x", "x", "x", "x") for a, b in docs], [(a, b, "x", "x", "x") for a, b in items]


def test_search_matches_scoring_every_document(spark):
    docs, items = given()
    want = brute(docs, items)
    for settings, parts in ((lexical.Settings(), 2), (lexical.Settings(terms=40, block=64, leaf=4), 3), (lexical.Settings(block=1, leaf=1), 1)):
        found = lexical.search(spark.createDataFrame(docs, DOCS).repartition(parts), spark.createDataFrame(items, ITEMS), settings)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(r) for r in found.collect()), key=str) == want
    assert len(want) > 200


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame(x, s) for x, s in zip(given(n=20), (DOCS, ITEMS)))
    assert lexical.search(docs.where("false"), items).collect() == []
    assert lexical.search(docs, items.where("false")).collect() == []
    assert lexical.search(docs.withColumn("text", docs["text"].substr(1, 0)), items).collect() == []


def test_bounds_hold_and_leave_out_most_of_clustered_rows():
    rng = np.random.default_rng(5)
    columns, values = [], []
    for i in range(4000):
        own = 20 * (i % 40) + rng.choice(20, 12, replace=False)
        columns.append(np.sort(own))
        values.append(rng.integers(200_000, 900_000, 12))
    rows = lexical.Rows(np.r_[0, np.cumsum([12] * 4000)], np.concatenate(columns).astype(np.int64), np.concatenate(values))
    weights = rng.integers(1, 9000, 800)
    tree = lexical.BallTree(rows, np.sqrt(weights.astype(float)), 32)
    scored = 0
    for c in range(40):
        column = 20 * c + np.arange(20)
        dense = np.zeros(800, np.int64)
        dense[column] = weights[column]
        every = tree.rows.dot(dense, 0, 4000)
        for most, (a, b) in zip(tree.bounds(column, np.sqrt(weights[column].astype(float))), tree.span):
            assert most >= every[a:b].max()
        best = []
        scored += tree.search(column, np.sqrt(weights[column].astype(float)), dense, tree.order, best, 10)
        assert best == sorted((-int(s), int(d)) for s, d in zip(every, tree.order))[:10]
    assert scored < 0.1 * 40 * 4000
